"""Detection rules as immutable values.

A rule set is small configuration, so it lives on the driver and is compiled into
literal Spark expressions; nothing here is joined, shuffled or broadcast at run time.
``RuleSet.to_dataframe`` gives the same rules as a table for inspection and joins.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from inkveil.functions.text import CHECKS

# ---------------------------------------------------------------------------
# Detection patterns, context labels, tokens and thresholds.
# They decide which text is reported and must stay as they are.
# ---------------------------------------------------------------------------
NAME_PATTERNS = (
    r"\b[A-Z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*(?:[A-Z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*){1,2}\b",
    r"\b[A-Za-z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*(?:[A-Za-z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*){1,2}\b",
    r"\b[A-Za-z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*(?:[A-Za-z][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*){1,2}\b",
    r"\b[A-Z][a-z]+(?:[A-Z][a-z]+){1,2}\b",
    r"\b[A-Z0O][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*(?:[A-Z0O][a-zçéèêëíìîïñóòôöúùûü]+[.\s-]*){1,2}\b",
    r"\b(?:[A-Z]\.?\s*){1,2}[A-Z][a-zçéèêëíìîïñóòôöúùûü]+(?:\s+[A-Z][a-zçéèêëíìîïñóòôöúùûü]+)*\b",
)
NAME_LABELS = (
    r"\b(?:name|full[\s-]*name|customer|client|account[\s-]*holder|prepared[\s-]*by|signed[\s-]*by)\b[:\s]*$",
    r"^[:\s]*name[:\s]*",
    r"\b(?:mr|mrs|ms|dr|prof)[.\s]+",
    r"\b(?:signature|signed|approved)\s+(?:by|of)[:\s]*",
    r"\b(?:authorized|certified|verified)\s+(?:by|for)[:\s]*",
    r"\b(?:employee|manager|supervisor|agent)[:\s]*",
)
ACCOUNT_PATTERNS = (
    r"\b[0-9O]{1,4}[\s-]*[0-9O]{1,4}[\s-]*[0-9O]{1,4}[\s-]*[0-9O]{1,4}\b",
    r"\b[A-Z]{2}[\s-]*[0-9O]{2}(?:[\s-]*[0-9O]{4}){2,4}\b",
    r"\b[0-9O]{10,16}\b",
    r"\b[O0-9lI]{10,16}\b",
    r"\b(?:[0-9O]{4}[\s-]*){4}\b",
    r"\b[0-9O]{1,5}(?:[- /.\\][0-9O]{1,5}){2,5}\b",
)
ACCOUNT_LABELS = (
    r"\b(?:account|acc|account[\s-]*no|reference|ref|number)\b[:\s]*$",
    r"^[:\s]*account[:\s]*",
    r"\b(?:acc|acct|account)[\s-]*(?:number|#|no)[:\s]*",
    r"\b(?:iban|swift|routing|card|credit|debit)[:\s]*",
    r"\b(?:ref|reference|transaction)[\s-]*(?:number|#|no)[:\s]*",
)
ADDRESS_PATTERNS = (
    r"\b\d+[\s-]+[A-Za-z\s-]+(?:Road|Street|Ave|Avenue|Boulevard|Blvd|Lane|Drive|Dr|Circle|Cir|Court|Ct|Place|Pl|Square|Sq|Way|Parkway|Pkwy)[.,\s]*\b",
    r"\b(?:P\.?[\s-]*O\.?[\s-]*Box|Post[\s-]*Office[\s-]*Box|PO[\s-]*Box|P0[\s-]*Box)[\s-]*[0-9O]+\b",
    r"\b(?:Apt|Suite|Unit|Building|Bldg|Room|Rm)\.?[\s-]*[A-Za-z0-9-]+\b",
    r"\b\d+[\s-]+[A-Za-z\s-]+(?:Rd|St|Av|Ave|Blvd|Ln|Dr|Cir|Ct|Pl|Sq)[.,\s]*\b",
    r"\b[A-Z][0-9O][A-Z][\s-]*[0-9O][A-Z][0-9O]\b",
    r"\b[0-9O]{5}(?:[-\s][0-9O]{4})?\b",
)
ADDRESS_LABELS = (
    r"\b(?:address|location|residence|mailing|shipping|billing)\b[:\s]*$",
    r"^[:\s]*address[:\s]*",
    r"\b(?:street|avenue|road|boulevard|lane|drive)[:\s]*",
    r"\b(?:city|state|zip|postal|province|country)[:\s]*",
    r"\b(?:deliver|ship|send)[\s-]*to[:\s]*",
)
PHONE_PATTERNS = (
    r"\+\s*\d[\s-]*(?:\d[\s-]*){6,14}\b",
    r"\b(?:\+\s*1[-\s]*)?(?:\d{3}|\(\d{3}\))[-\s]*\d{3}[-\s]*\d{4}\b",
    r"\b(?:ext|x|ex)\.?\s*\d{2,5}\b",
    r"\b[O0-9lI]{3}[\s-]*[O0-9lI]{3}[\s-]*[O0-9lI]{4}\b",
    r"\b\d{3}[.]\d{3}[.]\d{4}\b",
)
PHONE_LABELS = (
    r"\b(?:phone|tel|telephone|mobile|cell|fax|contact)[\s-]*(?:number|no|#)?[:\s]*$",
    r"^[:\s]*(?:phone|tel|telephone|mobile|cell|fax)[:\s]*",
    r"\b(?:call|dial|contact)[:\s]*",
    r"\b(?:phone|tel|telephone|mobile|cell|fax)[:\s]*",
)
EMAIL_PATTERNS = (
    r"\b[A-Za-z0-9._%+-]+[\s]*@[\s]*[A-Za-z0-9.-]+[\s]*\.[\s]*[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9._%+-]+(?:@|＠|[\s]*@[\s]*|[\s]*\(?at\)?[\s]*)[A-Za-z0-9.-]+(?:\.|\(?dot\)?)[A-Za-z]{2,}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.(?:com|org|net|edu|gov|mil|biz|info|mobi|name|aero|asia|jobs|museum)\b",
    r"\b[A-Za-z0-9._%+-]+\s*[@＠]\s*[A-Za-z0-9.-]+\s*\.\s*[A-Za-z]{2,}\b",
)
EMAIL_LABELS = (
    r"\b(?:email|e-mail|mail|contact)[\s-]*(?:address)?[:\s]*$",
    r"^[:\s]*(?:email|e-mail|mail)[:\s]*",
    r"\b(?:send|contact|reach)[\s-]*(?:at|via|by)[:\s]*",
    r"\b(?:email|e-mail|mail)[:\s]*",
)
# Every match of a label above begins, after colons and spaces, with one of these words.
LABEL_WORDS = {
    "Names": (
        "name", "full", "customer", "client", "account", "prepared", "signed", "mr", "mrs", "ms", "dr",
        "prof", "signature", "approved", "authorized", "certified", "verified", "employee", "manager",
        "supervisor", "agent",
    ),
    "Account Numbers": (
        "account", "acc", "acct", "reference", "ref", "number", "iban", "swift", "routing", "card",
        "credit", "debit", "transaction",
    ),
    "Addresses": (
        "address", "location", "residence", "mailing", "shipping", "billing", "street", "avenue", "road",
        "boulevard", "lane", "drive", "city", "state", "zip", "postal", "province", "country", "deliver",
        "ship", "send",
    ),
    "Phone Numbers": ("phone", "tel", "telephone", "mobile", "cell", "fax", "contact", "call", "dial"),
    "Email Addresses": ("email", "e-mail", "mail", "contact", "send", "reach"),
}
TOKENS = {
    "Names": "[REDACTED NAME]",
    "Account Numbers": "[REDACTED ACCOUNT]",
    "Addresses": "[REDACTED ADDRESS]",
    "Phone Numbers": "[REDACTED PHONE]",
    "Email Addresses": "[REDACTED EMAIL]",
}
THRESHOLDS = {
    "Names": 0.55,
    "Account Numbers": 0.6,
    "Addresses": 0.55,
    "Phone Numbers": 0.55,
    "Email Addresses": 0.55,
}
DEFAULT_THRESHOLD = 0.7
# ---------------------------------------------------------------------------

# The last name pattern repeats a group without bound, which can exhaust the JVM's stack on
# long text. A word here always ends at a word boundary, so the repetition never needs to give
# a word back and may be possessive: same matches, constant stack.
_NAME_WORD = r"[A-Z][a-zçéèêëíìîïñóòôöúùûü]+\b"
_INITIALS_THEN_WORDS = rf"\b(?:[A-Z]\.?\s*){{1,2}}{_NAME_WORD}(?:\s+{_NAME_WORD})*+"

# What every match of a pattern above holds. Most texts have none of it, and it is found without Unicode folding or
# word boundaries, both of which are slow. Case ignored, a letter class also takes the long s, the Kelvin sign and the two Turkish i.
_O, _ODD_LETTERS = "[0-9Oo]", "\u017f\u212a\u0131\u0130"
_OIL = "[0-9OoIiLl\u0131\u0130]"
_LONE = r"(?U:[\s-]*)"
ACCOUNT_NEEDS = {
    0: _LONE.join([_O] * 4),
    1: rf"{_O}{{4}}",
    2: rf"{_O}{{10}}",
    3: rf"{_OIL}{{10}}",
    4: rf"{_O}{{4}}",
    5: rf"{_O}[- /.\\]{_O}",
}
ADDRESS_NEEDS = {
    0: r"(?U:\d[\s-])",
    1: r"[Bb][Oo][Xx]",
    3: r"(?U:\d[\s-])",
    4: rf"{_O}.{_LONE}{_O}.{_O}",
    5: rf"{_O}{{5}}",
}
PHONE_NEEDS = {
    1: r"(?U:\d{4})",
    2: r"(?U:\d{2})",
    3: rf"{_OIL}{{4}}",
    4: r"(?U:\d{3})[.](?U:\d{3})",
}
EMAIL_NEEDS = {1: rf"(?:\.|[Dd][Oo][Tt]\)?)[A-Za-z{_ODD_LETTERS}]{{2}}"}


@dataclass(frozen=True)
class Pattern:
    """One regular expression.

    ``requires``: a match always holds at least one of these literals; a cheap substring test
    then spares the regex. ``scan``: equivalent expression to run instead of ``regex``. ``valid``: a
    check of ``functions.text.CHECKS`` that a match has to pass to count. ``needs``: a simpler expression, without flags,
    that is found in every match; where the text has none, the regex is spared too.
    """

    regex: str
    requires: tuple[str, ...] = ()
    scan: str | None = None
    valid: str | None = None
    needs: str | None = None

    @property
    def java(self) -> str:
        # i: ignore case; U: Unicode word, digit and space classes and Unicode case folding.
        return "(?iU)" + _fold_letter_classes(self.scan or self.regex)


@dataclass(frozen=True)
class Category:
    name: str
    patterns: tuple[Pattern, ...] = ()
    labels: tuple[str, ...] = ()
    replacement: str | None = None
    threshold: float = DEFAULT_THRESHOLD
    # Words of which every label match holds one, at a word's beginning; None if not known.
    label_words: tuple[str, ...] | None = None

    @property
    def token(self) -> str:
        return self.replacement if self.replacement is not None else f"[REDACTED {self.name}]"

    @property
    def label_regex(self) -> str | None:
        return any_of(self.labels)

    def distinct_patterns(self) -> list[tuple[Pattern, tuple[int, ...]]]:
        """Patterns that differ in effect, each with the pattern numbers it stands for.

        Every number is still reported, but equal expressions are run once.
        """
        groups: dict[tuple, tuple[Pattern, list[int]]] = {}
        for i, p in enumerate(self.patterns):
            groups.setdefault((p.java, p.valid), (p, []))[1].append(i)
        return [(p, tuple(idx)) for p, idx in groups.values()]


@dataclass(frozen=True)
class RuleSet:
    categories: tuple[Category, ...] = field(default_factory=tuple)

    @property
    def label_hint(self) -> str | None:
        """Finds whatever a label of any category cannot do without: one of the label words, or
        the labels themselves where their words are not known."""
        words = {w for c in self.categories if c.labels and c.label_words for w in c.label_words}
        labels = [l for c in self.categories if not c.label_words for l in c.labels]
        return any_of([*labels, *([_word_start(words)] if words else [])])

    def names(self) -> list[str]:
        return [c.name for c in self.categories]

    def get(self, name: str) -> Category | None:
        return next((c for c in self.categories if c.name == name), None)

    def add_pattern(
        self,
        category: str,
        pattern: str,
        labels: Iterable[str] = (),
        replacement: str | None = None,
        confidence_threshold: float = DEFAULT_THRESHOLD,
        requires: Iterable[str] = (),
        valid: str | None = None,
    ) -> RuleSet:
        """New rule set with one more pattern; ``valid`` names a check that its matches have to pass.

        For a category that already exists, ``replacement`` and ``confidence_threshold`` are
        ignored and pattern and labels are appended.
        """
        check_regex(pattern)
        labels = tuple(labels)
        for l in labels:
            re.compile(l)
        if valid is not None and valid not in CHECKS:
            raise ValueError(f"no such check: {valid!r}; there are {sorted(CHECKS)}")
        added = Pattern(pattern, tuple(requires), valid=valid)
        if self.get(category) is None:
            return RuleSet(
                self.categories
                + (Category(category, (added,), labels, replacement, confidence_threshold),)
            )
        return RuleSet(
            tuple(
                replace(
                    c,
                    patterns=c.patterns + (added,),
                    labels=c.labels + labels,
                    label_words=None if labels else c.label_words,
                )
                if c.name == category
                else c
                for c in self.categories
            )
        )

    def override(self, settings: Mapping[str, Mapping[str, object]]) -> RuleSet:
        """Replacement and threshold settings for known categories; unknown ones are ignored."""
        return RuleSet(
            tuple(
                replace(
                    c,
                    replacement=settings.get(c.name, {}).get("replacement", c.replacement),
                    threshold=settings.get(c.name, {}).get("threshold", c.threshold),
                )
                for c in self.categories
            )
        )

    def with_profile(self, settings: DataFrame, profile: str) -> RuleSet:
        """Settings of one saved profile, from a table like ``settings_dataframe``'s.

        Such a table has a row per category and profile: configuration, read on the driver.
        """
        rows = settings.where(F.col("profile") == profile).collect()
        twice = {r.category for r in rows if sum(x.category == r.category for x in rows) > 1}
        if twice:
            raise ValueError(f"profile {profile!r} has several rows for {sorted(twice)}")
        chosen = {r.category: {k: r[k] for k in ("replacement", "threshold") if r[k] is not None} for r in rows}
        return self.override(chosen)

    def without(self, excluded: Iterable[str]) -> RuleSet:
        excluded = set(excluded)
        return RuleSet(tuple(c for c in self.categories if c.name not in excluded))

    def selected(self, selection: Mapping[str, bool] | None) -> RuleSet:
        """Category selection: no selection keeps all, and so does a missing key."""
        return self.without(n for n, on in (selection or {}).items() if not on)

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        """One row per pattern and per label."""
        rows = []
        for n, c in enumerate(self.categories):
            rows += [(c.name, n, "pattern", i, p.regex) for i, p in enumerate(c.patterns)]
            rows += [(c.name, n, "label", i, l) for i, l in enumerate(c.labels)]
        return spark.createDataFrame(rows, RULE_SCHEMA)

    def settings_dataframe(self, spark: SparkSession, profile: str = "default") -> DataFrame:
        """One row per category: token and detection threshold."""
        rows = [(profile, c.name, n, c.token, c.threshold) for n, c in enumerate(self.categories)]
        return spark.createDataFrame(rows, SETTINGS_SCHEMA)


RULE_SCHEMA = T.StructType(
    [
        T.StructField("category", T.StringType(), False),
        T.StructField("category_ord", T.IntegerType(), False),
        T.StructField("kind", T.StringType(), False),
        T.StructField("idx", T.IntegerType(), False),
        T.StructField("regex", T.StringType(), False),
    ]
)
SETTINGS_SCHEMA = T.StructType(
    [
        T.StructField("profile", T.StringType(), False),
        T.StructField("category", T.StringType(), False),
        T.StructField("category_ord", T.IntegerType(), False),
        T.StructField("replacement", T.StringType(), True),
        T.StructField("threshold", T.DoubleType(), True),
    ]
)


def update_patterns(patterns: Mapping[str, Mapping[str, object]]) -> RuleSet:
    """A whole rule set from plain settings: patterns, labels, replacement, confidence_threshold."""
    rules = []
    for name, c in patterns.items():
        for p in c.get("patterns", ()):
            check_regex(p)
        rules.append(
            Category(
                name,
                tuple(Pattern(p) for p in c.get("patterns", ())),
                tuple(c.get("labels", ())),
                c.get("replacement"),
                float(c.get("confidence_threshold", DEFAULT_THRESHOLD)),
            )
        )
    return RuleSet(tuple(rules))


def check_regex(pattern: str) -> None:
    """Refuse what the offset arithmetic cannot handle; warn about what may exhaust the stack."""
    compiled = re.compile(pattern, re.IGNORECASE)
    for probe in ("", "a", "1", "a 1.", "-- @"):
        if any(m.end() == m.start() for m in compiled.finditer(probe)):
            raise ValueError(f"pattern matches empty text: {pattern!r}")
    if re.search(r"(?<!\\)\)(?:\*|\+|\{\d+,\})(?!\+)", pattern):
        warnings.warn(
            f"unbounded group loop, use a possessive one to bound the stack: {pattern!r}",
            stacklevel=3,
        )


def any_of(labels: Iterable[str]) -> str | None:
    """One expression for several labels.

    Most begin with a word boundary, which is slow to test; it is written once in front of all
    of them rather than tried again for each.
    """
    at_word, others = [], []
    for l in labels:
        if l.startswith(r"\b") and not _has_bare_alternative(l):
            at_word.append(f"(?:{l[2:]})")
        else:
            others.append(f"(?:{l})")
    if at_word:
        others.append(r"\b(?:" + "|".join(at_word) + ")")
    return "(?iU)" + "|".join(others) if others else None


def _word_start(words: Iterable[str]) -> str:
    """Finds a word that begins with one of some words. Those with the same first letter share
    it, so that most other words are passed over after one look."""
    by_letter: dict[str, list[str]] = {}
    for w in sorted(words):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    return r"\b(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items()) + ")"


def _has_bare_alternative(regex: str) -> bool:
    """Is there a ``|`` outside all brackets?"""
    rest = re.sub(r"\\.", "", regex)
    rest = re.sub(r"\[\]?[^\]]*\]", "", rest)
    while (inner := re.sub(r"\([^()]*\)", "", rest)) != rest:
        rest = inner
    return "|" in rest


def _fold_letter_classes(regex: str) -> str:
    """Case is ignored, so ``A-Za-z`` inside a character class says no more than ``A-Z``."""
    return re.sub(r"\[[^\]]*\]", lambda m: m.group().replace("A-Za-z", "A-Z"), regex)


def _patterns(regexes, requires=None, scans=None, needs=None) -> tuple[Pattern, ...]:
    return tuple(
        Pattern(r, (requires or {}).get(i, ()), (scans or {}).get(i), needs=(needs or {}).get(i))
        for i, r in enumerate(regexes)
    )


def _category(name, patterns, labels) -> Category:
    return Category(name, patterns, labels, TOKENS[name], THRESHOLDS[name], LABEL_WORDS[name])


DEFAULT_RULES = RuleSet(
    (
        _category("Names", _patterns(NAME_PATTERNS, scans={5: _INITIALS_THEN_WORDS}), NAME_LABELS),
        _category("Account Numbers", _patterns(ACCOUNT_PATTERNS, needs=ACCOUNT_NEEDS), ACCOUNT_LABELS),
        _category("Addresses", _patterns(ADDRESS_PATTERNS, needs=ADDRESS_NEEDS), ADDRESS_LABELS),
        _category("Phone Numbers", _patterns(PHONE_PATTERNS, {0: ("+",)}, needs=PHONE_NEEDS), PHONE_LABELS),
        _category(
            "Email Addresses",
            _patterns(EMAIL_PATTERNS, {0: ("@",), 2: ("@",), 3: ("@", "＠")}, needs=EMAIL_NEEDS),
            EMAIL_LABELS,
        ),
    )
)

# Written as "+1 (nnn) nnn-nnnn" a number escapes the phone patterns above: a boundary is asked
# for where there is none. This addition finds it; it is not part of the default rules.
BRACKETED_PHONE = r"\+\s*1[\s-]*\(\d{3}\)[\s-]*\d{3}[\s-]*\d{4}\b"
EXTENDED_RULES = DEFAULT_RULES.add_pattern("Phone Numbers", BRACKETED_PHONE, requires=("+",))

# Candidates for card and social security numbers; the checks "luhn" and "ssn" tell which are valid.
CARD_PATTERN = r"\b\d(?:[ -]?\d){12,18}\b"
SSN_PATTERN = r"\b\d{3}-\d{2}-\d{4}\b"
