"""Text functions. All are expressions on columns; none needs Python workers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Characters replaced when text is cleaned. The capital O becomes a zero everywhere.
CLEAN_FROM = "|O¡¦—–\u00ad"
CLEAN_TO = "I0iI---"

# Everything that is not printable, the plain space excepted. Line feeds and tabs go without
# leaving a space. Printable ASCII is ruled out first: it is nearly all of the text, and the
# Unicode categories are slow to ask.
_UNPRINTABLE = r"[[^ -~]&&[\p{C}\p{Z}]]"
# Unicode space, and the four separators which count as space too.
_SPACE_RUN = r"(?U)[[^!-~]&&[\s\x1c-\x1f]]+"


#: What cleaning takes away or makes one space of: a run that holds anything unprintable, of several spaces,
#: or of spaces at an end.
SHORTENED = rf"[ {_UNPRINTABLE}]*{_UNPRINTABLE}[ {_UNPRINTABLE}]*| {{2,}}|\A +| +\z"


def repaired(text: Column) -> Column:
    """Characters often misread, one for one."""
    for wrong, right in zip(CLEAN_FROM, CLEAN_TO):
        text = F.replace(text, F.lit(wrong), F.lit(right))
    return text


def clean_text(text: Column) -> Column:
    """Repair characters often misread, drop unprintable ones, collapse and trim spaces."""
    printable = F.regexp_replace(repaired(text), _UNPRINTABLE, "")
    return F.trim(F.regexp_replace(printable, " {2,}", " "))


def normalize_ws(text: Column) -> Column:
    """Every run of white space, line feeds included, becomes one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, _SPACE_RUN, " "))


def luhn_valid(text: Column) -> Column:
    """Luhn check over the digits in the text; text without digits passes."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (digits == "") | F.call_function("luhn_check", digits)


def ssn_valid(text: Column) -> Column:
    """Area not 000, 666 or 9xx; group not 00; serial not 0000."""
    return text.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")


#: Checks that a pattern can ask of its matches.
CHECKS = {"luhn": luhn_valid, "ssn": ssn_valid}


def preview(text: Column, start: Column, end: Column, replacement: Column, width: int = 20) -> Column:
    """Context before and after a hit, and the passage with the replacement in place."""
    before = F.substring(text, F.greatest(start - width, F.lit(0)) + 1, F.least(start, F.lit(width)))
    after = F.substring(text, end + 1, F.lit(width))
    return F.struct(
        before.alias("before"),
        after.alias("after"),
        F.concat(before, replacement, after).alias("proposed"),
    )


#: Characters in a piece of a text that is read at many places.
PIECE = 64


def in_pieces(text: Column) -> Column:
    """A text as an array of pieces of ``PIECE`` characters, the last one shorter; for ``preview_in``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def preview_in(pieces: Column, start: Column, end: Column, replacement: Column, width: int = 20) -> Column:
    """``preview`` from the text's pieces: a hit costs the few pieces it looks at, however long the text is."""

    def part(first: Column, n: Column) -> Column:
        piece = F.floor(first / PIECE).cast("int")
        near = F.array_join(F.slice(pieces, piece + 1, F.lit(width // PIECE + 2)), "")
        return F.substring(near, first - piece * PIECE + 1, n)

    before = part(F.greatest(start - width, F.lit(0)), F.least(start, F.lit(width)))
    after = part(end, F.lit(width))
    return F.struct(
        before.alias("before"),
        after.alias("after"),
        F.concat(before, replacement, after).alias("proposed"),
    )
