"""User settings: JSON over defaults."""

from __future__ import annotations

import copy
import logging

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

# Settings that hold where the user gives none.
DEFAULT_SETTINGS = {
    "replacement_patterns": {
        "Names": {"default": "[REDACTED]", "custom": "[NAME]", "format": "{category}-{index}"},
        "PhoneNumbers": {"default": "[PHONE]", "custom": "XXX-XXX-XXXX", "format": "{category}-{index}"},
    },
    "confidence_thresholds": {"ocr": 0.8, "pattern_matching": 0.9},
    "enabled_categories": ["Names", "PhoneNumbers", "SSN", "Email"],
}


def load_settings(spark: SparkSession, path: str | None = None) -> dict:
    """Settings from a JSON file of one object.

    Top-level keys of the file replace the defaults whole. A file that cannot be read gives a
    warning and the defaults. The file is configuration: one row, read on the driver.
    """
    settings = copy.deepcopy(DEFAULT_SETTINGS)
    if path:
        try:
            user = _plain(spark.read.json(path, multiLine=True).head())
            if "_corrupt_record" in user:
                raise ValueError("not a JSON object")
            settings.update(user)
        except (PySparkException, TypeError, ValueError) as e:
            logging.getLogger(__name__).warning("could not load settings from %s: %s", path, e)
    return settings


def _plain(value):
    """A row as nested dictionaries, without the fields that only other objects have."""
    if hasattr(value, "asDict"):
        return {k: _plain(v) for k, v in value.asDict().items() if v is not None}
    return [_plain(v) for v in value] if isinstance(value, list) else value
