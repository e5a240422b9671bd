"""Document fingerprints from spots: chains of content words behind common words.

A text is lower-cased and cut into words (letters and digits). A run of common words is an anchor; the
``CHAIN`` content words behind it, which may have common words between them, make up its chain, and
anchor and chain together, hashed to 32 bits, one signature. The fingerprint of a text is its set of
signatures, written as sorted runs of eight hexadecimal digits.

Two fingerprints are compared by Jaccard similarity, pruned: sets are told apart by their lengths
first, since a set of a signatures and one of b >= a are at most a / b alike. Pairs beyond
``length_classes`` of each other, and pairs whose prefixes in order of rarity share nothing, are never
compared (``near_pairs``).

Everything is DataFrame functions. To find the next document, rows are dealt out by ranges of the id and
take the next row of their range; the last of a range takes the first of the next, from a table with one
row for each range.

Defined results: a null text is empty; a text without a chain has the empty fingerprint, which is equal
(1.0) to another empty one and unlike (0.0) all others; a null ``doc_id`` comes after all others; rows with
equal ids are ordered by a hash of the text; a single document is its own next; repeated rows stay; an
empty table gives an empty result. Extra columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.llm.common import stage

CHAIN = 2
COMMON = (
    "a an and are as at be but by for from had has have he in is it its not of on or she that the their they this to was were which with "
    "auf das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von zu zum "
    "au aux ce dans du elle en est et il la le les mais ne ou par pas pour qu que qui se sur un une "
    "al con de del el ella lo los las más no para por su y"
).split()
_MARK = "\x01"


def units(text: Column) -> Column:
    """Content words, each with the common words before it (marked)."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    marked = F.transform(words, lambda w: F.when(w.isin(COMMON), F.concat(F.lit(_MARK), w)).otherwise(w))
    return F.regexp_extract_all(F.array_join(marked, " "), F.lit(rf"(?<!\S)((?:{_MARK}\S++ )*+[^{_MARK} ]\S*+)"), F.lit(1))


def signatures(name: str) -> Column:
    """Sorted distinct signatures from a column of ``units``."""
    content = lambda i: F.substring_index(F.get(name, i), " ", -1)
    spot = lambda u, i: F.when(
        u.startswith(_MARK) & (i + CHAIN <= F.size(name)), F.hash(u, *(content(i + k) for k in range(1, CHAIN)))
    )
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(name, spot))))


def written(name: str) -> Column:
    """A set of signatures as text."""
    digits = F.transform(name, lambda x: F.lpad(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.lower(F.array_join(digits, ""))


def likeness(a: str, b: str) -> Column:
    """Jaccard similarity; sets of which one is empty are not intersected."""
    shared = F.size(F.array_intersect(a, b))
    least, most = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, 1.0).when(least == 0, 0.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def by_ranges(docs: DataFrame) -> DataFrame:
    """(part, key, tie, doc_id, text): documents dealt out by descending id, staged; part 0 has the largest."""
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keyed = base.select(F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")).alias("key"), F.xxhash64("text").alias("tie"), "doc_id", "text")
    ranged = keyed.repartitionByRange(F.desc("key"), F.desc("tie"))
    return stage(ranged.select(F.spark_partition_id().alias("part"), "*"))


def with_next(ranged: DataFrame) -> DataFrame:
    """Each document with its ``signs`` and the ``text`` and ``signs`` of the next."""
    first = ranged.groupBy("part").agg(F.max(F.struct("key", "tie")).alias("first"))
    # One small row for each range, of which there are as many as shuffle partitions; so no text is shuffled here.
    heads = ranged.join(F.broadcast(first), "part").where((F.col("key") == F.col("first.key")) & (F.col("tie") == F.col("first.tie"))).dropDuplicates(["part"])
    order = Window.orderBy("part")
    one = heads.select("part", "text", units(F.col("text")).alias("u")).withColumn("head", F.struct("text", signatures("u").alias("signs"))).select("part", "head")
    after = one.select(
        F.col("part").alias("of"),
        F.coalesce(F.lead("head").over(order), F.first("head").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("head"),
    )
    along = Window.partitionBy("part").orderBy(F.desc("key"), F.desc("tie"))
    signed = ranged.repartition("part").withColumn("u", units(F.col("text"))).withColumn("signs", signatures("u")).drop("u")
    following = signed.withColumn("next", F.lead(F.struct("text", "signs")).over(along))
    joined = following.join(after, F.col("part") == F.col("of"))
    return joined.select("doc_id", "text", "signs", F.coalesce("next", "head").alias("next"))


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are."""
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next.text"), F.lit(1), half))
    rows = with_next(by_ranges(docs)).select("doc_id", n.alias("n_chars"), "signs", F.col("next.signs").alias("next_signs"), edited.alias("edited"))
    rows = rows.withColumn("u", units(F.col("edited"))).withColumn("edited_signs", signatures("u"))
    return rows.select(
        "doc_id",
        F.col("n_chars").cast("long").alias("n_chars"),
        F.sha2(F.col("edited"), 256).alias("edited_sha256"),
        written("signs").alias("fingerprint"),
        written("edited_signs").alias("edited_fingerprint"),
        likeness("signs", "edited_signs").alias("near_edited"),
        likeness("signs", "next_signs").alias("near_next"),
    )


def near_pairs(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(a, b, likeness) of sets at least so alike, and the documents of each set: see ``memberships``.

    Equal sets are one row. Sets are partitioned by length class; a set looks in its own and the next class,
    by the rarest of its signatures.
    """
    sets = memberships(docs).where(F.size("signs") > 0).groupBy("set").agg(F.first("signs").alias("signs"))
    frequency = sets.select(F.explode("signs").alias("s")).groupBy("s").count()
    ordered = (
        sets.select("set", F.explode("signs").alias("s")).join(frequency, "s")
        .groupBy("set").agg(F.transform(F.array_sort(F.collect_list(F.struct("count", "s"))), lambda x: x["s"]).alias("signs"))
    )
    size = F.size("signs")
    prefix = F.slice("signs", F.lit(1), size - F.ceil(size * similarity - 1e-9).cast("int") + 1)
    length_class = F.floor(F.log(size.cast("double")) / F.lit(-math.log(similarity)) + 1e-9)
    rows = ordered.select("set", "signs", size.alias("n"), length_class.alias("class"), F.explode(prefix).alias("s"))
    a = rows.select(F.col("set").alias("a"), F.col("signs").alias("x"), F.col("n").alias("na"), "class", "s")
    b = rows.select(F.col("set").alias("b"), F.col("signs").alias("y"), F.col("n").alias("nb"), F.explode(F.array(F.col("class") - 1, F.col("class"))).alias("class"), "s")
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = a.join(b, ["class", "s"]).where(shorter & (F.col("na") >= F.col("nb") * similarity - 1e-9))
    return met.select("a", "b", likeness("x", "y").alias("likeness")).where(F.col("likeness") >= similarity - 1e-12).distinct()


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, set, signs): the set of each document, named by a hash of the fingerprint."""
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = text.select("doc_id", units(F.col("text")).alias("u")).select("doc_id", signatures("u").alias("signs"))
    return signed.select("doc_id", F.sha2(written("signs"), 256).alias("set"), "signs")
