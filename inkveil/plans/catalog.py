"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from inkveil.functions.replacement import (
    REPLACEMENT_RULES, ReplacementRule, add_replacement, replacement_text,
)
from inkveil.functions.text import clean_text, in_pieces, luhn_valid, preview_in
from inkveil.operators import detect as D, many_rules as many, in_place, layout, numbering, ocr_text, profiles, redact, reports, rewrite, wide_pages
from inkveil.plans.pipeline import text_context
from inkveil.rules import BRACKETED_PHONE, CARD_PATTERN, DEFAULT_RULES, SSN_PATTERN, RuleSet, update_patterns
from inkveil.settings import load_settings
from inkveil.sources import blocks as B, forms, keys
from inkveil.sources.store import stage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The tables given here are a file or a few; searching them is spread over so many tasks.
SPREAD = 32

CARD_RULES = RuleSet().add_pattern("CreditCard", CARD_PATTERN, (r"\bcard",), "[REDACTED CARD]", 0.5, valid="luhn")
SSN_RULES = RuleSet().add_pattern("SSN", SSN_PATTERN, (r"\bssn\b",), "[REDACTED SSN]", 0.5, valid="ssn")
CUSTOM_RULES = DEFAULT_RULES.add_pattern(
    "Phone Numbers", BRACKETED_PHONE, requires=("+",)
).add_pattern("IP Addresses", r"\b\d{1,3}(?:\.\d{1,3}){3}\b", (r"\bhost\b",), None, 0.6)
OVERRIDES = {
    "Account Numbers": {"threshold": 0.7, "replacement": "[ACCOUNT]"},
    "Email Addresses": {"threshold": 0.5},
    "Postcards": {"threshold": 0.1},
}
# Replacement rules by which the query shows each way of formatting.
SHOWN_REPLACEMENTS = {
    **REPLACEMENT_RULES,
    "Names": ReplacementRule("{category}-{index}", "[NAME]"),
    "Addresses": ReplacementRule("[{city}-{index}]", "[REDACTED-ADDRESS]"),
}
SHOWN_REPLACEMENTS = add_replacement(
    SHOWN_REPLACEMENTS,
    "Account Numbers",
    ReplacementRule("[ACC-{index:03d}]", preserve_last=True, preserve_year=True),
)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _documents(spark, sf) -> DataFrame:
    return B.read_table(spark, f"{sf}/documents.parquet", SPREAD)


def _doc_context(spark, sf) -> DataFrame:
    return text_context(_documents(spark, sf))


def _form_pages(spark, sf) -> DataFrame:
    return forms.customer_pages(B.read_table(spark, f"{sf}/customer.parquet", SPREAD))


def _form_context(spark, sf) -> DataFrame:
    return layout.page_context(_form_pages(spark, sf))


#: What is put into the documents' texts, so that cleaning has something to take away: (found, put in its place).
NOISE = ((" the ", "  the\t "), (", ", ",\u200b "), (" de ", "\u00a0 de  "), ("\n", " \n\u00ad  "))


def _noisy_context(spark, sf) -> DataFrame:
    text = F.col("text")
    for found, put in NOISE:
        text = F.replace(text, F.lit(found), F.lit(put))
    return text_context(_documents(spark, sf).withColumn("text", text))


# --- sources -------------------------------------------------------------------------------


@query
def blocks_from_text(spark, sf):
    return B.blocks_from_text(_documents(spark, sf))


@query
def blocks_from_turns(spark, sf):
    turns = B.read_table(spark, f"{sf}/conversations.parquet", SPREAD)
    return B.blocks_from_text(turns, doc_id="conv_id", part="turn")


@query
def blocks_from_records(spark, sf):
    return B.blocks_of(_form_pages(spark, sf))


@query
def rejects(spark, sf):
    """Blocks from customers; a negative balance gives an inverted box, one segment no text."""
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    blocks = customer.select(
        F.col("c_custkey").alias("doc_id"),
        F.lit(0).cast("long").alias("page_no"),
        F.when(F.col("c_nationkey") != 7, F.lit(0)).cast("long").alias("block_no"),
        F.lit(0.0).alias("x0"),
        F.lit(0.0).alias("y0"),
        F.col("c_acctbal").alias("x1"),
        F.lit(10.0).alias("y1"),
        F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("text"),
    )
    _, bad = B.split_rejects(blocks)
    return bad.select("doc_id", "page_no", F.coalesce("block_no", F.lit(-1)).alias("block_no"), "reason")


# --- text ----------------------------------------------------------------------------------


@query
def clean_text_blocks(spark, sf):
    return B.blocks_from_text(_documents(spark, sf)).select(
        "doc_id", "page_no", "block_no", clean_text(F.col("text")).alias("cleaned")
    )


@query
def luhn_valid_cards(spark, sf):
    customer = spark.read.parquet(f"{sf}/customer.parquet")
    card = forms.card(F.col("c_custkey"))
    return customer.select(
        "c_custkey",
        card.alias("card"),
        luhn_valid(card).alias("card_ok"),
        luhn_valid(F.regexp_replace(card, r"(\d{4})", "$1 ")).alias("spaced_ok"),
        luhn_valid(F.col("c_mktsegment")).alias("segment_ok"),
    )


# --- layout --------------------------------------------------------------------------------


def _form_blocks(spark, sf) -> DataFrame:
    return B.blocks_of(_form_pages(spark, sf))


@query
def merge_blocks(spark, sf):
    return layout.merge_blocks(layout.assemble_pages(_form_blocks(spark, sf)))


@query
def table_cells(spark, sf):
    return _doc_context(spark, sf).select("doc_id", "page_no", "block_no", "is_table_cell")


@query
def neighbor_text(spark, sf):
    return _doc_context(spark, sf).select(
        "doc_id", "page_no", "block_no", "preceding_text", "following_text"
    )


@query
def block_context(spark, sf):
    """From a plain block table: pages are brought together, large ones sent another way."""
    return layout.block_context(_form_blocks(spark, sf))


@query
def wide_page_context(spark, sf):
    """One page for each nation, its customers scattered over it; every page taken as large."""
    customer = B.read_table(spark, f"{sf}/customer.parquet", SPREAD)
    key = F.col("c_custkey")
    x0 = (F.pmod(key * 37, F.lit(40)) * 9).cast("double")
    y0 = (F.pmod(F.floor(key / 50) * 3, F.lit(120)) * 4).cast("double")
    blocks = customer.select(
        F.col("c_nationkey").cast("long").alias("doc_id"),
        F.lit(0).cast("long").alias("page_no"),
        key.alias("block_no"),
        x0.alias("x0"),
        y0.alias("y0"),
        (x0 + 20 + F.pmod(key, F.lit(11)) * 30).alias("x1"),
        (y0 + 8 + F.pmod(key, F.lit(5)) * F.pmod(key, F.lit(5)) * 11).alias("y1"),
        F.col("c_name").alias("text"),
    )
    return layout.block_context(blocks, max_page_blocks=0)


@query
def merge_long_runs(spark, sf):
    """All customers as one run of fragments on slightly uneven lines: none can be cut off beforehand."""
    customer = B.read_table(spark, f"{sf}/customer.parquet", SPREAD)
    key = F.col("c_custkey")
    y0 = (F.pmod(key * 7, F.lit(23)) * 4 / 10).cast("double")
    blocks = customer.select(
        F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("page_no"), key.alias("block_no"),
        (key * 10).cast("double").alias("x0"), y0.alias("y0"), (key * 10 + 8).cast("double").alias("x1"), (y0 + 8).alias("y1"),
        F.col("c_name").alias("text"),
    )
    return wide_pages.merge_blocks(wide_pages.in_reading_order(blocks)).drop("seq")


# --- detection -----------------------------------------------------------------------------


@query
def confidence_score(spark, sf):
    return D.score_table(_doc_context(spark, sf)).drop("label_hit")


@query
def label_hit(spark, sf):
    return D.score_table(_form_context(spark, sf)).select(*D.BLOCK_KEYS, "category", "label_hit")


@query
def detect_pii(spark, sf):
    return D.detect(_doc_context(spark, sf))


@query
def match_offsets(spark, sf):
    return D.detect(_form_context(spark, sf), keep=["text"]).select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "match_idx", "start", "end",
        F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("span_text"),
    )


@query
def raw_offsets(spark, sf):
    """Places of the matches in the text before cleaning, and what stands there."""
    matches = D.detect_in_source(_noisy_context(spark, sf), keep=["raw_text"])
    return matches.select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "match_idx", "start", "raw_start", "raw_end",
        F.col("raw_text").substr(F.col("raw_start") + 1, F.col("raw_end") - F.col("raw_start")).alias("raw_match"),
    )


@query
def ordered_matches(spark, sf):
    # stored: a sort reads its rows twice, to find the ranges and to deal the rows out to them
    return redact_columns(reports.ordered_matches(stage(D.detect(_form_context(spark, sf)))))


def redact_columns(matches: DataFrame) -> DataFrame:
    return matches.select(*D.BLOCK_KEYS, "category", "pattern_idx", "start", "end", "replacement")


@query
def custom_pattern(spark, sf):
    return D.detect(_doc_context(spark, sf), CUSTOM_RULES).select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "match_text", "start", "replacement"
    )


#: A rule set given whole, in place of the default one.
OWN_RULES = update_patterns(
    {
        "Numbers": {"patterns": [r"\b\d{3,}\b", r"\b\d+[.,]\d+\b"], "labels": [r"\btotal"], "replacement": "[NUMBER]", "confidence_threshold": 0.5},
        "Hosts": {"patterns": [r"\b[a-z0-9-]+\.example\.[a-z]+\b"], "labels": [r"\bhost"]},
        "Marks": {"patterns": [r"[#$%&*]{3,}"], "labels": [r"\bmark"], "confidence_threshold": 0.6},
    }
)


@query
def own_rules(spark, sf):
    return D.detect(_doc_context(spark, sf), OWN_RULES).select(*D.BLOCK_KEYS, "category", "pattern_idx", "match_text", "start", "replacement")


#: The category of the rules that ``many_rules`` makes from the documents, and their number.
WATCHLIST = RuleSet().add_pattern("Watchlist", r"\bx\b", ("client",), "[LISTED]", 0.5)
N_RULES = 5000


@query
def many_rules(spark, sf):
    """Five thousand rules from a table: a listed word, alone or with the word after it."""
    documents = _documents(spark, sf)
    listed = documents.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{8,}"), F.lit(0))).alias("literal")).distinct()
    listed = listed.orderBy("literal").limit(N_RULES)
    number = F.row_number().over(Window.orderBy("literal")).cast("long") - 1
    regex = F.concat(F.lit(r"\b"), "literal", F.lit(r"\b(?: [a-z]+)?"))
    rules = stage(listed.select(number.alias("rule_id"), F.lit("Watchlist").alias("category"), "literal", regex.alias("regex")))
    return many.detect_many(text_context(documents), rules, WATCHLIST)


@query
def card_numbers(spark, sf):
    """Valid card numbers only: the check is part of the rule."""
    return D.detect(_doc_context(spark, sf), CARD_RULES).select(*D.BLOCK_KEYS, "match_text", "start", "end")


@query
def ssn(spark, sf):
    """Valid numbers only: the check is part of the rule."""
    return D.detect(_form_context(spark, sf), SSN_RULES).select(*D.BLOCK_KEYS, "match_text", "confidence")


@query
def match_preview(spark, sf):
    matches = D.detect(_doc_context(spark, sf).withColumn("pieces", in_pieces(F.col("text"))), keep=["pieces"])
    shown = preview_in(F.col("pieces"), F.col("start"), F.col("end"), F.col("replacement"))
    return matches.select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "match_idx", "match_text", "confidence", shown.alias("p")
    ).select("*", "p.*").drop("p")


# --- redaction -----------------------------------------------------------------------------


@query
def redact_blocks(spark, sf):
    return redact.redact_blocks(_doc_context(spark, sf))


@query
def redact_selected(spark, sf):
    return redact.redact_blocks(
        _form_context(spark, sf), selection={"Names": False, "Phone Numbers": True}
    )


@query
def exclude_matches(spark, sf):
    """Account matches of customers in debt are deselected; the rest is redacted."""
    context = _form_context(spark, sf)
    matches = stage(D.detect(context, min_confidence=redact.MIN_CONFIDENCE))
    in_debt = spark.read.parquet(f"{sf}/customer.parquet").where("c_acctbal < 0")
    excluded = matches.where("category = 'Account Numbers'").join(
        in_debt.select(F.col("c_custkey").alias("doc_id")), "doc_id", "left_semi"
    )
    return redact.redact_matched(context, redact.exclude_matches(matches, excluded))


@query
def dedupe_spans(spark, sf):
    return redact.dedupe_spans(_doc_context(spark, sf))


@query
def redact_spans(spark, sf):
    return redact.redact_spans(_form_context(spark, sf))


@query
def redact_spans_text(spark, sf):
    return redact.redact_spans(_doc_context(spark, sf))


@query
def redact_cards(spark, sf):
    """Valid card numbers are replaced in place; an invalid one stays."""
    return redact.redact_spans(_doc_context(spark, sf), CARD_RULES, min_confidence=0.5)


@query
def redact_documents(spark, sf):
    return redact.redact_documents(_documents(spark, sf))


@query
def redact_documents_at_table_score(spark, sf):
    """From 0.6 a hit in a table cell is enough, so most lines are redacted."""
    return redact.redact_documents(_documents(spark, sf), min_confidence=0.6)


@query
def redact_documents_in_place(spark, sf):
    """Without a shuffle: every text is rewritten in its own row."""
    return in_place.redact_in_place(_documents(spark, sf))


@query
def redact_documents_in_place_at_table_score(spark, sf):
    return in_place.redact_in_place(_documents(spark, sf), min_confidence=0.6)


@query
def redact_document_spans_in_place(spark, sf):
    """Only the matches are replaced, in the text as it was."""
    return in_place.redact_in_place(_documents(spark, sf), min_confidence=0.6, spans=True)


@query
def redact_spans_in_source(spark, sf):
    return in_place.redact_spans_in_source(_noisy_context(spark, sf), min_confidence=0.6)


#: Three profiles: their categories' replacement, threshold and whether they are enabled.
PROFILES = [
    ("strict", "Names", "[PERSON]", 0.6, None),
    ("strict", "Account Numbers", None, 0.6, None),
    ("contacts", "Names", None, None, False),
    ("contacts", "Account Numbers", None, None, False),
    ("contacts", "Email Addresses", "[MAIL]", 0.5, True),
    ("quiet", "Names", None, 0.9, None),
    ("quiet", "Addresses", "[PLACE]", 0.6, None),
    ("quiet", "Account Numbers", None, 0.95, None),
    ("quiet", "Phone Numbers", None, 0.8, None),
    ("quiet", "Email Addresses", None, 0.8, None),
]


@query
def redact_by_profile(spark, sf):
    """Documents of some sources under one profile each; those of other sources under the rules alone."""
    number = F.regexp_extract("source", "[0-9]+", 0).cast("int")
    named = F.when(number < 5, "strict").when(number < 10, "contacts").when(number < 15, "quiet")
    documents = _documents(spark, sf).withColumn("profile", named)
    settings = spark.createDataFrame(PROFILES, profiles.SCHEMA)
    return profiles.redact_by_profile(documents, settings)


@query
def redact_by_settings(spark, sf):
    """All documents under the settings that hold where no file is given, as one profile."""
    documents = _documents(spark, sf)
    settings = profiles.settings_table(spark, {"default": load_settings(spark)})
    redacted = profiles.redact_by_profile(documents.withColumn("profile", F.lit("default")), settings)
    return redacted.drop("profile")


@query
def redact_blocks_at_table_score(spark, sf):
    return redact.redact_blocks(_doc_context(spark, sf), min_confidence=0.6)


@query
def audit_log(spark, sf):
    return redact.audit_log(D.detect(_doc_context(spark, sf), min_confidence=redact.MIN_CONFIDENCE))


# --- replacements --------------------------------------------------------------------------


def _numbered_text(spark, sf, scope):
    matches = stage(D.detect(_doc_context(spark, sf)))
    return numbering.replacement_index(matches, scope).select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "start", "index"
    )


@query
def replacement_index(spark, sf):
    return _numbered_text(spark, sf, "document")


@query
def replacement_index_corpus(spark, sf):
    return _numbered_text(spark, sf, "corpus")


@query
def consistent_pseudonyms(spark, sf):
    matches = stage(D.detect(_doc_context(spark, sf)))
    return numbering.consistent_pseudonyms(matches, "corpus").select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "start", "value", "index"
    )


@query
def consistent_names(spark, sf):
    matches = stage(D.detect(_form_context(spark, sf), min_confidence=redact.MIN_CONFIDENCE))
    numbered = numbering.consistent_pseudonyms(matches, "document")
    return numbered.select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "start", "value",
        F.concat("category", F.lit("-"), "index").alias("pseudonym"),
    )


@query
def replacement_format(spark, sf):
    matches = stage(D.detect(_form_context(spark, sf), min_confidence=redact.MIN_CONFIDENCE))
    numbered = numbering.replacement_index(matches, "document")
    c, t, i = F.col("category"), F.col("match_text"), F.col("index")
    return numbered.select(
        *D.BLOCK_KEYS, "category", "pattern_idx", "start",
        replacement_text(c, t, i).alias("by_default_rules"),
        replacement_text(c, t, i, SHOWN_REPLACEMENTS).alias("by_own_rules"),
        replacement_text(c, t, i, SHOWN_REPLACEMENTS, ("index", "category")).alias("with_category"),
    )


@query
def pseudonymized_text(spark, sf):
    """Equal values get equal tokens in all documents."""
    return rewrite.replace_numbered(_documents(spark, sf), min_confidence=0.6)


@query
def numbered_text(spark, sf):
    """Every match has a number of its own, counted within its document."""
    return rewrite.replace_numbered(_documents(spark, sf), min_confidence=0.6, scope="document", consistent=False)


def _by_path(spark, sf) -> DataFrame:
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return _documents(spark, sf).select(path.alias("path"), "text")


@query
def pseudonyms_by_path(spark, sf):
    """Documents known by a path: detection and numbering in the order of the paths."""
    documents = _by_path(spark, sf)
    known = keys.dictionary(documents, "path")
    matches = stage(D.detect(text_context(keys.numbered(documents, "path", known))))
    numbered = numbering.consistent_pseudonyms(matches, "corpus")
    shown = numbered.select("doc_id", "page_no", "block_no", "category", "pattern_idx", "start", "value", "index")
    return keys.restored(shown, "path", known)


@query
def counts_by_path(spark, sf):
    documents = _by_path(spark, sf)
    known = keys.dictionary(documents, "path")
    return keys.restored(reports.document_counts(text_context(keys.numbered(documents, "path", known))), "path", known)


# --- reports -------------------------------------------------------------------------------


@query
def pii_counts(spark, sf):
    return reports.pii_counts(_doc_context(spark, sf))


@query
def categories(spark, sf):
    return reports.category_usage(_form_context(spark, sf))


@query
def rules_override(spark, sf):
    rules = DEFAULT_RULES.override(OVERRIDES)
    usage = reports.category_usage(_doc_context(spark, sf), rules)
    return usage.join(rules.settings_dataframe(spark), ["category", "category_ord"]).select(
        "category", "replacement", "threshold", "n_matches"
    )


@query
def matches_by_doc(spark, sf):
    grouped = reports.matches_by_page(D.detect(_doc_context(spark, sf)))
    one = lambda m: F.concat_ws(":", m["block_no"], m["pattern_idx"], m["start"], m["match_text"])
    return grouped.select(
        "doc_id", "page_no", "part", "category", "n_matches",
        F.array_join(F.transform("matches", one), " / ").alias("matches"),
    )


@query
def pattern_distribution(spark, sf):
    """Totals are shown as pattern -1 and category ``all``."""
    counted = reports.pattern_distribution(_doc_context(spark, sf))
    return counted.fillna("all", ["category"]).fillna(-1, ["pattern_idx"])


@query
def hit_quantiles(spark, sf):
    """Totals are shown as pattern -1 and category ``all``."""
    counted = reports.hit_quantiles(_doc_context(spark, sf))
    return counted.fillna("all", ["category"]).fillna(-1, ["pattern_idx"])


@query
def match_lists(spark, sf):
    """Whole lists of documents, in parts of 100 matches."""
    parts = reports.match_lists(stage(D.detect(_doc_context(spark, sf))), part_size=100)
    one = lambda m: F.concat_ws(":", m["page_no"], m["block_no"], m["pattern_idx"], m["start"], m["match_text"])
    return parts.withColumn("matches", F.array_join(F.transform("matches", one), " / "))


@query
def batch_summary(spark, sf):
    return reports.batch_summary(_doc_context(spark, sf))


@query
def top_pii_docs(spark, sf):
    return reports.top_documents(_doc_context(spark, sf))


@query
def detection_quality(spark, sf):
    pages = _form_pages(spark, sf)
    found = D.detect(layout.page_context(pages), min_confidence=redact.MIN_CONFIDENCE)
    return reports.detection_quality(found, forms.gold_spans(pages))


@query
def ocr_page_text(spark, sf):
    words = B.words_from_text(_documents(spark, sf), lambda d, w: F.pmod(d * 31 + w * 17, F.lit(100)))
    return ocr_text.ocr_page_text(words)
