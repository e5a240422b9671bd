"""Finding all matches of a regular expression, with offsets, in one pass over the text."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.functions.arrays import let
from inkveil.functions.text import CHECKS
from inkveil.rules import Category, Pattern

# Cleaned text holds no control characters, so this one can fence the matches.
FENCE = "\u0001"


def guarded(text: Column, pattern: Pattern, run: Column, otherwise: Column) -> Column:
    """``run``, unless a literal, or a simpler expression, that every match needs is absent."""
    present = F.lit(False) if pattern.requires else F.lit(True)
    for literal in pattern.requires:
        present = present | text.contains(literal)
    if pattern.needs:
        present = present & text.rlike(pattern.needs)
    return F.when(present, run).otherwise(otherwise) if pattern.requires or pattern.needs else run


def fenced(text: Column, pattern: Pattern) -> Column:
    """The text with a fence on both sides of every match."""
    return guarded(text, pattern, F.regexp_replace(text, pattern.java, f"{FENCE}$0{FENCE}"), text)


def _valid_matches(text: Column, pattern: Pattern) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern.java), F.lit(0))
    return F.filter(found, CHECKS[pattern.valid])


def occurs(text: Column, pattern: Pattern) -> Column:
    found = F.size(_valid_matches(text, pattern)) > 0 if pattern.valid else text.rlike(pattern.java)
    return guarded(text, pattern, found, F.lit(False))


def occurrences(text: Column, pattern: Pattern) -> Column:
    n = F.size(_valid_matches(text, pattern)) if pattern.valid else F.regexp_count(text, F.lit(pattern.java))
    return guarded(text, pattern, n, F.lit(0))


def passes(check: Column, match_text: Column, patterns: Iterable[Pattern]) -> Column:
    """Does a match pass the check named in a column? ``patterns`` are those that may stand there."""
    out = F.lit(True)
    for name in sorted({p.valid for p in patterns if p.valid}):
        out = F.when(check == name, CHECKS[name](match_text)).otherwise(out)
    return out


def any_occurs(text: Column, category: Category) -> Column:
    """Does any pattern of the category occur? Stops at the first that does."""
    found = F.lit(False)
    for pattern, _ in category.distinct_patterns():
        found = found | occurs(text, pattern)
    return found


# Pieces are read in chunks of this many; even, so that every chunk begins with a gap.
_CHUNK = 32


# Up to this many bytes the text before each match is measured anew, which is cheaper than to join pieces.
_SHORT = 512

# Up to this many bytes the lengths of the pieces before a match are summed, this many at most behind a sum made once.
_SUMMED, _SUM_BITS = 2048, 4


def hit_rows(fenced_rows: DataFrame, columns: Sequence[str], fenced_text: str = "fenced") -> DataFrame:
    """One row for each match in the column of fenced texts: ``columns``, then the fields of ``hits``.

    The same as ``hits`` made into rows, but a match costs no array function: texts are cut into pieces by a plain
    generator, long ones in chunks, each with the number of code points and of matches before it.
    """
    fenced = F.col(fenced_text)

    def chunk(part: Column, offset: Column, i: Column) -> Column:
        done = i * F.lit(_CHUNK // 2)
        return F.struct(offset.alias("_offset"), done.alias("_done"), F.array_join(part, FENCE).alias("_part"))

    whole = F.array(F.struct(F.lit(0).alias("_offset"), F.lit(0).alias("_done"), fenced.alias("_part")))
    parts = F.when(F.octet_length(fenced) <= _SHORT, whole).otherwise(let(F.split(fenced, FENCE, -1), lambda pieces: _in_chunks(pieces, chunk)))
    pieces = fenced_rows.select(*columns, F.inline(parts)).select(
        *columns, "_offset", "_done", "_part", F.posexplode(F.split("_part", FENCE, -1)).alias("_piece", "match_text")
    )
    before = F.call_function("substring_index", F.col("_part"), F.lit(FENCE), F.col("_piece"))
    found = pieces.where(F.col("_piece").bitwiseAND(F.lit(1)) == 1).select(
        *columns,
        (F.col("_done") + F.shiftright("_piece", 1)).alias("match_idx"),
        "match_text",
        (F.col("_offset") + F.length(before) - F.col("_piece") + 1).alias("start"),
    )
    return found.withColumn("end", F.col("start") + F.length("match_text"))


def hits(fenced_text: Column) -> Column:
    """``array<struct<match_idx, match_text, start, end>>`` of a fenced text.

    Split at the fences, even pieces are gaps and odd pieces are matches; a match starts where
    the pieces before it end. Offsets count code points, half open.
    """
    return F.when(F.octet_length(fenced_text) <= _SUMMED, _short_hits(fenced_text)).otherwise(_long_hits(fenced_text))


def _short_hits(fenced_text: Column) -> Column:
    """Each piece is measured once; what lies before a match is a sum of lengths."""
    step = 1 << _SUM_BITS
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda n, length: n + length)

    def read(pieces: Column) -> Column:
        return let(F.transform(pieces, lambda p: F.length(p)), lambda lengths: summed(pieces, lengths))

    def summed(pieces: Column, lengths: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(lengths), F.lit(step))
        sums = F.transform(firsts, lambda first: total(F.slice(lengths, first, F.lit(step))))
        offsets = let(sums, lambda known: F.transform(known, lambda _, i: total(F.slice(known, F.lit(1), i))))
        return let(offsets, lambda known: found(pieces, lengths, known))

    def found(pieces: Column, lengths: Column, offsets: Column) -> Column:
        def one(piece: Column, number: Column) -> Column:
            chunk = F.shiftright(number, _SUM_BITS - 1)
            start = F.get(offsets, chunk) + total(F.slice(lengths, chunk * step + 1, 2 * number + 1 - chunk * step))
            return F.struct(number.alias("match_idx"), piece.alias("match_text"), start.alias("start"))

        return F.transform(F.filter(pieces, lambda _, i: i.bitwiseAND(F.lit(1)) == 1), one)

    def ended(h: Column) -> Column:
        end = h["start"] + F.length(h["match_text"])
        return F.struct(*[h[c].alias(c) for c in ("match_idx", "match_text", "start")], end.alias("end"))

    return F.transform(let(F.split(fenced_text, FENCE, -1), read), ended)


def _long_hits(fenced_text: Column) -> Column:
    """The pieces before are joined and measured within a chunk only, so the work stays small in long texts."""

    def read(pieces: Column) -> Column:
        return F.flatten(_in_chunks(pieces, in_chunk))

    def in_chunk(part: Column, offset: Column, i: Column) -> Column:
        chunk = F.struct(part.alias("part"), offset.alias("offset"), (i * F.lit(_CHUNK // 2)).alias("done"))
        return let(chunk, lambda c: F.transform(_one_to(F.floor(F.size(c["part"]) / 2)), one_of(c)))

    def one_of(c: Column):
        def one(i: Column) -> Column:
            start = c["offset"] + _length(F.slice(c["part"], F.lit(1), 2 * i - 1))
            return let(
                F.struct(F.get(c["part"], 2 * i - 1).alias("text"), start.alias("start")),
                lambda h: F.struct(
                    (c["done"] + i - 1).alias("match_idx"),
                    h["text"].alias("match_text"),
                    h["start"].alias("start"),
                    (h["start"] + F.length(h["text"])).alias("end"),
                ),
            )

        return one

    return let(F.split(fenced_text, FENCE, -1), read)


def starts(pieces: Column) -> Column:
    """Where each piece of a text begins, in code points; measured by chunks like ``hits``."""

    def in_chunk(part: Column, offset: Column, _: Column) -> Column:
        chunk = F.struct(part.alias("part"), offset.alias("offset"))
        return let(chunk, lambda c: F.transform(c["part"], lambda _, i: c["offset"] + _length(F.slice(c["part"], F.lit(1), i))))

    return F.flatten(_in_chunks(pieces, in_chunk))


def _in_chunks(pieces: Column, make: Callable[[Column, Column, Column], Column]) -> Column:
    """An array of what ``make`` makes of each chunk of pieces, the code points before it and its number.

    Each chunk is measured once and what lies before it is a sum, so long texts are not read again for every chunk.
    """
    firsts = F.sequence(F.lit(1), F.size(pieces), F.lit(_CHUNK))
    part = lambda first: F.slice(pieces, first, F.lit(_CHUNK))

    def chunk(first: Column, i: Column, lengths: Column) -> Column:
        offset = F.aggregate(F.slice(lengths, F.lit(1), i), F.lit(0), lambda n, length: n + length)
        return make(part(first), offset, i)

    lengths = F.transform(firsts, lambda first: _length(part(first)))
    return let(lengths, lambda known: F.transform(firsts, lambda first, i: chunk(first, i, known)))


def _length(pieces: Column) -> Column:
    return F.length(F.array_join(pieces, ""))


def _one_to(n: Column) -> Column:
    return F.slice(F.sequence(F.lit(0), n.cast("int")), F.lit(2), n.cast("int"))
