"""Forms made from customer records, with personal data known by construction.

Texts follow from the key by arithmetic, so the true spans are known and quality can be
measured.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from inkveil.sources.blocks import pages_from_records

# Fixed values of the forms.
FIRST_NAMES = ("Anna", "Peter", "Maria", "James", "Lucia", "Henri", "Greta", "Tomas")
LAST_NAMES = ("Keller", "Smith", "Garcia", "Dupont", "Meyer", "Silva", "Brown", "Lindt")


def digits(key: Column, factor: int, width: int) -> Column:
    """``width`` digits that follow from the key."""
    value = F.pmod(key * F.lit(factor) + F.lit(factor), F.lit(10**width))
    return F.lpad(value.cast("string"), width, "0")


def full_name(key: Column) -> Column:
    first = F.get(F.array(*[F.lit(n) for n in FIRST_NAMES]), F.pmod(key, F.lit(8)).cast("int"))
    last = F.get(F.array(*[F.lit(n) for n in LAST_NAMES]), F.pmod(key * 3 + 1, F.lit(8)).cast("int"))
    return F.concat(first, F.lit(" "), last)


def card(key: Column) -> Column:
    return F.concat(F.lit("4"), digits(key, 104729, 15))


def ssn(key: Column) -> Column:
    return F.concat_ws("-", digits(key, 37, 3), digits(key, 11, 2), digits(key, 101, 4))


def customer_pages(customer: DataFrame) -> DataFrame:
    """One form page for each customer: ten rows, each with its label."""
    key = F.col("c_custkey")
    return pages_from_records(
        customer,
        key,
        [
            ("Client:", [F.col("c_name")]),
            ("Full Name:", [full_name(key)]),
            ("Account No:", [digits(key, 7919, 12)]),
            ("Phone:", [F.concat(digits(key, 13, 3), F.lit("-555-"), digits(key, 17, 4))]),
            (
                "E-mail:",
                [F.concat(F.lit("user"), key, F.lit("@mail"), F.pmod(key, F.lit(7)), F.lit(".example.com"))],
            ),
            ("Address:", [F.concat(F.pmod(key, F.lit(900)) + 1, F.lit(" Main Street"))]),
            ("Zip:", [digits(key, 23, 5)]),
            ("Segment:", [F.col("c_mktsegment"), F.concat(F.lit("nation "), F.col("c_nationkey"))]),
            ("Card:", [card(key)]),
            ("SSN:", [ssn(key)]),
        ],
    )


# Category and block number of the form's true personal data; each fills its block.
GOLD_BLOCKS = (
    ("Names", 3),
    ("Account Numbers", 5),
    ("Phone Numbers", 7),
    ("Email Addresses", 9),
    ("Addresses", 11),
    ("Addresses", 13),
    ("Account Numbers", 18),
)


def gold_spans(pages: DataFrame) -> DataFrame:
    """True spans of the forms."""
    spans = [
        F.struct(
            F.lit(number).cast("long").alias("block_no"),
            F.lit(category).alias("category"),
            F.lit(0).alias("start"),
            F.length(F.get("blocks", F.lit(number))["text"]).alias("end"),
        )
        for category, number in GOLD_BLOCKS
    ]
    return pages.select("doc_id", "page_no", F.inline(F.array(*spans)))
