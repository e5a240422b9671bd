"""Whole jobs: from a stored table to counts, matches or a redacted copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from inkveil.functions.replacement import ReplacementRule
from inkveil.operators import detect as detection, in_place, layout, profiles, redact, reports, rewrite
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.settings import load_settings
from inkveil.sources import blocks as block_source, keys, store


#: Name of a helper column that no table has.
_PROFILE = "_inkveil_own_profile"


def text_context(df: DataFrame, **columns) -> DataFrame:
    """Blocks with context of a text table (or stream). No shuffle."""
    return layout.page_context(block_source.pages_from_text(df, **columns))


def read_context(
    spark: SparkSession, path: str, text_table: bool = True, spread: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """Blocks with context of a stored text table, or of a stored block table; and the rows that
    cannot be used, with the reason."""
    if text_table:
        table = block_source.read_table(spark, path, spread)
        usable, rejects = block_source.split_text_rejects(table)
        return text_context(usable), rejects
    usable, rejects = block_source.split_rejects(block_source.read_blocks(spark, path))
    return layout.block_context(usable), rejects


def get_supported_categories(rules: RuleSet = DEFAULT_RULES) -> list[str]:
    return rules.names()


def detect_pii(
    spark: SparkSession,
    path: str,
    rules: RuleSet = DEFAULT_RULES,
    text_table: bool = True,
    key: str = "doc_id",
    min_confidence: float = 0.0,
) -> DataFrame:
    """All matches in a stored table. Documents may be known by a ``key`` of any type (text tables)."""
    found = lambda context: detection.detect(context, rules, min_confidence)
    if not text_table:
        return found(read_context(spark, path, False)[0])
    table, _ = block_source.split_text_rejects(block_source.read_table(spark, path), key)
    if keys.is_whole(table, key):
        return found(text_context(table, doc_id=key))
    known = keys.dictionary(table, key)
    return keys.restored(found(text_context(keys.numbered(table, key, known))), key, known)


def count_pii(
    spark: SparkSession, path: str, rules: RuleSet = DEFAULT_RULES, text_table: bool = True
) -> DataFrame:
    """Matches by category in a stored table."""
    return reports.pii_counts(read_context(spark, path, text_table)[0], rules)


def anonymize(
    spark: SparkSession,
    path: str,
    output_path: str | None = None,
    selected_categories: Mapping[str, bool] | None = None,
    min_confidence: float = redact.MIN_CONFIDENCE,
    rules: RuleSet = DEFAULT_RULES,
    spans: bool = False,
    audit_path: str | None = None,
    rejects_path: str | None = None,
    text_table: bool = True,
    numbers: str | None = None,
    scope: str = "corpus",
    key: str = "doc_id",
    replacements: Mapping[str, ReplacementRule] | None = None,
    settings: Mapping[str, str] | None = None,
    profile: str | None = None,
) -> str:
    """Write a redacted copy beside the input and return its path.

    Of a text table every row and every column comes back, with its text redacted in its own row; a null text
    stays null. ``spans`` redacts the matched text instead of the whole line. With ``audit_path`` the
    log of what was changed is written too. ``rejects_path`` takes the rows that could not be searched, with the reason; for a
    block table, whose output leaves such rows out, it has to be given where there are any.

    ``numbers`` asks for numbered replacements of the matches in a text table, under the rules of ``replacements``: a number
    for each ``match``, or one for each distinct ``value``; counted through the whole table in the order of ``key``, or within each row
    (``scope``).

    ``settings`` names settings files by profile; the rows of a text table are redacted under the profile in their column
    ``profile``, or all under the only one. Thresholds, enabled categories and tokens are then the files'.
    """
    if numbers not in (None, "match", "value") or (numbers and not text_table):
        raise ValueError("numbers are for text tables: 'match' or 'value'")
    if settings and (numbers or not text_table or (profile is None and len(settings) != 1)):
        raise ValueError("settings are for text tables without numbers; several of them need a profile column")
    if text_table:
        table = block_source.read_table(spark, path)
        rejects = block_source.split_text_rejects(table, key)[1] if rejects_path else None
        if settings:
            loaded = profiles.settings_table(spark, {n: load_settings(spark, p) for n, p in settings.items()}, rules)
            named = table if profile else table.withColumn(_PROFILE, F.lit(next(iter(settings))))
            chosen = rules.selected(selected_categories)
            redacted = profiles.redact_by_profile(named, loaded, profile or _PROFILE, chosen, spans=spans).select(*table.columns)
        elif numbers:
            redacted = rewrite.replace_numbered(
                table, rules, min_confidence, selected_categories, key, replacements=replacements, scope=scope, consistent=numbers == "value"
            )
        else:
            redacted = in_place.redact_in_place(table, rules, min_confidence, selected_categories, spans=spans)
    else:
        usable, rejects = block_source.split_rejects(block_source.read_blocks(spark, path))
        context = layout.block_context(usable)
        redaction = redact.redact_spans if spans else redact.redact_blocks
        redacted = redaction(context, rules, min_confidence, selected_categories)
    if rejects_path:
        rejects.write.mode("errorifexists").parquet(rejects_path)
    elif not text_table and not rejects.isEmpty():
        raise ValueError(f"{path} holds rows that cannot be used; give a rejects_path for them")
    written = store.write_redacted(redacted, path, output_path)
    if audit_path:
        chosen = rules.selected(selected_categories)
        if text_table:
            matches = detect_pii(spark, path, chosen, key=key, min_confidence=min_confidence).withColumnRenamed(key, "doc_id")
        else:
            matches = detection.detect(context, chosen, min_confidence)
        redact.audit_log(matches).write.mode("errorifexists").parquet(audit_path)
    return written
