"""Helpers on columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Inside a lambda Spark evaluates an expression again wherever it is written; a lambda
    variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


#: Sorted arrays are searched among the first entry of every so many, then among so many.
CHUNK = 64


def with_heads(entries: Column, field: str) -> Column:
    """A not empty array of structs, sorted by a field, made ready for ``sorted_lookup``."""
    firsts = F.sequence(F.lit(0), F.size(entries) - 1, F.lit(CHUNK))
    return F.struct(F.transform(firsts, lambda i: F.get(entries, i)[field]).alias("heads"), entries.alias("entries"))


def last_up_to(known: Column, field: str, value: Column) -> Column:
    """The last entry whose field is at most the value; null where there is none."""
    chunk = F.size(F.filter(known["heads"], lambda h: h <= value)) - 1
    near = F.slice(known["entries"], F.greatest(chunk, F.lit(0)) * CHUNK + 1, F.lit(CHUNK))
    return F.try_element_at(F.filter(near, lambda e: e[field] <= value), F.lit(-1))


def sorted_lookup(known: Column, field: str, value: Column) -> Column:
    """The entry whose field equals the value; null where there is none."""
    return let(last_up_to(known, field, value), lambda e: F.when(e[field] == value, e))
