"""Settings as data: a profile for each row, joined as a column.

A settings table has a row for each profile and category: ``replacement``, ``threshold``, ``enabled``, each null where the rules' own
value holds. A profile's rows become one map from category to settings, which travels with the document; thresholds,
selection and tokens are read from it, so one plan serves any number of profiles.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkveil.operators.in_place import redacted_text
from inkveil.operators.redact import MIN_CONFIDENCE
from inkveil.rules import DEFAULT_RULES, RuleSet

#: Name of a helper column that no table has.
_PROFILE = "_inkveil_profile"

SCHEMA = T.StructType(
    [
        T.StructField("profile", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("replacement", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("enabled", T.BooleanType()),
    ]
)

# Categories as settings files call them.
FILE_NAMES = {"PhoneNumbers": "Phone Numbers", "Email": "Email Addresses"}


def settings_table(spark: SparkSession, settings: Mapping[str, Mapping], rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The settings table of loaded settings files (``settings.load_settings``), by profile name.

    Only listed categories are enabled, the threshold is that of ``pattern_matching``, the replacement a category's ``custom`` token.
    Names that no rule has are ignored.
    """
    rows = []
    for profile, own in settings.items():
        named = lambda names: {FILE_NAMES.get(n, n) for n in names}
        enabled = named(own["enabled_categories"]) if "enabled_categories" in own else None
        tokens = {FILE_NAMES.get(n, n): r.get("custom") for n, r in own.get("replacement_patterns", {}).items()}
        threshold = own.get("confidence_thresholds", {}).get("pattern_matching")
        for c in rules.categories:
            rows.append((profile, c.name, tokens.get(c.name), None if threshold is None else float(threshold), None if enabled is None else c.name in enabled))
    return spark.createDataFrame(rows, SCHEMA)


def profile_maps(settings: DataFrame) -> DataFrame:
    """(profile, map): a row for each profile. Two rows for one category of a profile are an error when read."""
    own = F.struct("replacement", F.col("threshold").cast("double").alias("threshold"), "enabled")
    return settings.groupBy("profile").agg(F.map_from_entries(F.collect_list(F.struct("category", own.alias("own")))).alias(_PROFILE))


def redact_by_profile(
    documents: DataFrame,
    settings: DataFrame,
    profile: str = "profile",
    rules: RuleSet = DEFAULT_RULES,
    min_confidence: float = 0.0,
    text: str = "text",
    spans: bool = False,
) -> DataFrame:
    """The documents redacted, each under the profile that its column ``profile`` names; every row and column stays.

    A row with no or an unknown profile follows the rules alone, from ``MIN_CONFIDENCE``; ``min_confidence`` holds for all others
    beside the profile's thresholds.
    """
    maps = profile_maps(settings).withColumnRenamed("profile", "_inkveil_name")
    joined = documents.join(maps, F.col(profile) == F.col("_inkveil_name"), "left")
    own = redacted_text(F.col(text), rules, min_confidence, spans=spans, profile=F.col(_PROFILE))
    plain = redacted_text(F.col(text), rules, MIN_CONFIDENCE, spans=spans)
    return joined.withColumn(text, F.when(F.col(_PROFILE).isNull(), plain).otherwise(own)).select(*documents.columns)
