"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, and its result a staged table. A node with very many
links is reduced to one row before the shuffle of the minimum, and stands on the many side of the
join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkveil.llm.common import stage


def star(links: DataFrame) -> DataFrame:
    """Large star, then small star."""
    both = links.union(links.select("v", "u"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    down = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(down, "u")
    return small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(down).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    ``links``: two columns of numbers, null-free; a node linked to itself alone is left out.
    """
    u, v = links.columns
    now = stage(links.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v").distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if state == seen:
            break
        seen, now = state, stage(star(now))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
