"""The same results in SQL for DuckDB, written apart from the Spark code.

DuckDB's regular expressions know word boundaries and case for ASCII only. So they run on a
*shadow* of the text: of the same length, in lower case, with letters outside ASCII shown by
capital letters, which lower-case text has to spare. ``E`` stands for the accented letters that
names may hold, ``X`` for any other letter.
"""

from __future__ import annotations

from inkveil.plans import catalog
from inkveil.rules import DEFAULT_RULES, RuleSet
from inkveil.sources import forms

ACCENTED = "çéèêëíìîïñóòôöúùûü"
WIDE_SPACES = r"\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def clean(t: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(translate({t}, '|O¡¦—–\u00ad', 'I0iI---'), "
        f"'[\\p{{C}}{WIDE_SPACES}]', '', 'g'), ' {{2,}}', ' ', 'g'))"
    )


def spaced(t: str) -> str:
    return f"trim(regexp_replace({t}, '[\\s\\x0B\\x1C-\\x1F\\x85{WIDE_SPACES}]+', ' ', 'g'))"


def shadow(t: str) -> str:
    return (
        f"regexp_replace(translate(lower({t}), '{ACCENTED}', '{'E' * len(ACCENTED)}'), "
        f"'[ªµºß-öø-ɏͰ-ϿЀ-ӿ]', 'X', 'g')"
    )


def shadow_regex(regex: str) -> str:
    return regex.lower().replace(ACCENTED, "E").replace(r"\d", "[0-9]")


def labels_hit(labels) -> str:
    regex = q("|".join(f"(?:{shadow_regex(l)})" for l in labels))
    return f"(regexp_matches(pre_shadow, {regex}) OR regexp_matches(post_shadow, {regex}))"


# --- tables --------------------------------------------------------------------------------

DOC_RAW = """
lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
raw AS (
  SELECT doc_id, i // 40 AS page_no, i AS block_no, 0.0::DOUBLE AS x0, (12 * (i % 40))::DOUBLE AS y0,
         (6 * length(text))::DOUBLE AS x1, (12 * (i % 40) + 10)::DOUBLE AS y1, text
  FROM lines WHERE text <> '')"""

TURN_RAW = """
lines AS (
  SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS text,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations),
raw AS (
  SELECT conv_id AS doc_id, turn * 4294967296 + i // 40 AS page_no, i AS block_no, 0.0::DOUBLE AS x0,
         (12 * (i % 40))::DOUBLE AS y0, (6 * length(text))::DOUBLE AS x1,
         (12 * (i % 40) + 10)::DOUBLE AS y1, text
  FROM lines WHERE text <> '')"""


def digits(key: str, factor: int, width: int) -> str:
    return f"lpad((({key} * {factor} + {factor}) % {10**width})::VARCHAR, {width}, '0')"


def _names(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


K = "c_custkey"
CARD = f"'4' || {digits(K, 104729, 15)}"
SSN = f"{digits(K, 37, 3)} || '-' || {digits(K, 11, 2)} || '-' || {digits(K, 101, 4)}"
FORM_FIELDS = [
    ("Client:", ["c_name"]),
    (
        "Full Name:",
        [f"{_names(forms.FIRST_NAMES)}[{K} % 8 + 1] || ' ' || {_names(forms.LAST_NAMES)}[({K} * 3 + 1) % 8 + 1]"],
    ),
    ("Account No:", [digits(K, 7919, 12)]),
    ("Phone:", [f"{digits(K, 13, 3)} || '-555-' || {digits(K, 17, 4)}"]),
    ("E-mail:", [f"'user' || {K} || '@mail' || {K} % 7 || '.example.com'"]),
    ("Address:", [f"({K} % 900 + 1) || ' Main Street'"]),
    ("Zip:", [digits(K, 23, 5)]),
    ("Segment:", ["c_mktsegment", "'nation ' || c_nationkey"]),
    ("Card:", [CARD]),
    ("SSN:", [SSN]),
]


def _form_raw() -> str:
    rows = []
    for r, (label, values) in enumerate(FORM_FIELDS):
        y = f"{40 * r}.0::DOUBLE AS y0, {40 * r + 10}.0::DOUBLE AS y1"
        rows.append(f"SELECT {K}, {len(rows)} AS block_no, 0.0::DOUBLE AS x0, 60.0::DOUBLE AS x1, {y}, {q(label)} AS text FROM customer")
        left = "80"
        for v in values:
            rows.append(
                f"SELECT {K}, {len(rows)}, ({left})::DOUBLE, ({left} + 6 * length({v}))::DOUBLE, "
                f"{40 * r}.0, {40 * r + 10}.0, {v} FROM customer"
            )
            left = f"{left} + 6 * length({v}) + 10"
    union = " UNION ALL ".join(rows)
    return f"raw AS (SELECT {K} AS doc_id, 0 AS page_no, block_no, x0, y0, x1, y1, text FROM ({union}))"


FORM_RAW = _form_raw()

# Blocks of a page folded into merged ones: the list so far is carried along, its last entry is
# the current block.
MERGED = """
folded AS (
  SELECT doc_id, page_no, list_reduce(
    list([{'block_no': block_no, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'text': text}] ORDER BY block_no),
    lambda acc, b: CASE
      WHEN abs(b[1].y0 - acc[-1].y0) < 5 AND abs(b[1].x0 - acc[-1].x1) < 15
      THEN list_append(acc[:-2], {'block_no': acc[-1].block_no, 'x0': acc[-1].x0, 'y0': acc[-1].y0,
                                  'x1': b[1].x1, 'y1': acc[-1].y1, 'text': acc[-1].text || ' ' || b[1].text})
      ELSE list_concat(acc, b) END) AS bs
  FROM raw GROUP BY ALL),
merged AS (SELECT doc_id, page_no, unnest(b) FROM (SELECT doc_id, page_no, unnest(bs) AS b FROM folded))"""

CONTEXT = f"""
paired AS (
  SELECT m.doc_id, m.page_no, m.block_no,
    count(*) FILTER (WHERE (abs(r.y0 - m.y0) < 10 OR abs(r.x0 - m.x0) < 10)
      AND NOT (r.x0 = m.x0 AND r.y0 = m.y0 AND r.x1 = m.x1 AND r.y1 = m.y1)) >= 2 AS is_table_cell,
    string_agg(r.text, ' ' ORDER BY r.block_no) FILTER (WHERE m.x0 > 0 AND r.x0 < m.x0
      AND r.x1 > greatest(0, m.x0 - 150) AND r.y0 < m.y1 + 10 AND r.y1 > m.y0 - 10) AS pre,
    string_agg(r.text, ' ' ORDER BY r.block_no) FILTER (WHERE r.x0 < m.x1 + 150 AND r.x1 > m.x1
      AND r.y0 < m.y1 + 10 AND r.y1 > m.y0 - 10) AS post
  FROM merged m JOIN raw r ON m.doc_id = r.doc_id AND m.page_no = r.page_no
  GROUP BY m.doc_id, m.page_no, m.block_no),
ctx AS (
  SELECT m.doc_id, m.page_no, m.block_no, m.x0, m.y0, m.x1, m.y1, m.text AS raw_text, {clean('m.text')} AS text,
    {clean(spaced("coalesce(pre, '')"))} AS preceding_text, {clean(spaced("coalesce(post, '')"))} AS following_text,
    is_table_cell
  FROM merged m JOIN paired p ON m.doc_id = p.doc_id AND m.page_no = p.page_no AND m.block_no = p.block_no),
shaded AS MATERIALIZED (
  SELECT *, {shadow('text')} AS shadow, {shadow('preceding_text')} AS pre_shadow, {shadow('following_text')} AS post_shadow
  FROM ctx)"""

NOISY_TEXT = "text"
for _found, _put in catalog.NOISE:
    NOISY_TEXT = f"replace({NOISY_TEXT}, {q(_found)}, {q(_put)})"
NOISY_RAW = DOC_RAW.replace("FROM documents)", f"FROM (SELECT doc_id, {NOISY_TEXT} AS text FROM documents))")
NOISY_CTX = f"WITH {NOISY_RAW}, {MERGED}, {CONTEXT}"

DOC_CTX = f"WITH {DOC_RAW}, {MERGED}, {CONTEXT}"
FORM_CTX = f"WITH {FORM_RAW}, {MERGED}, {CONTEXT}"


def scored(rules: RuleSet) -> str:
    """One row for each block and category."""
    entries = ", ".join(
        f"{{'category': {q(c.name)}, 'category_ord': {i}, 'label_hit': {labels_hit(c.labels)}, "
        f"'threshold': {float(c.threshold)}::DOUBLE, 'replacement': {q(c.token)}}}"
        for i, c in enumerate(rules.categories)
    )
    return f"""
per_category AS (SELECT *, unnest([{entries}]) AS c FROM shaded WHERE length(text) >= 2),
scored AS MATERIALIZED (
  SELECT * EXCLUDE (c), c.category, c.category_ord, c.label_hit, c.threshold, c.replacement,
    0.5::DOUBLE + CASE WHEN c.label_hit THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN is_table_cell THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS confidence
  FROM per_category)"""


def matches(rules: RuleSet, min_confidence: float = 0.0) -> str:
    """One row for each match, as CTE ``matches``."""
    runs = " UNION ALL ".join(
        f"""SELECT doc_id, page_no, block_no, text, category, category_ord, {j} AS pattern_idx, confidence, replacement,
            regexp_replace(shadow, {q('(' + shadow_regex(p.regex) + ')')}, chr(1) || '\\1' || chr(1), 'g') AS fenced
            FROM scored WHERE category = {q(c.name)} AND confidence >= greatest(threshold, {min_confidence}::DOUBLE)"""
        for c in rules.categories
        for j, p in enumerate(c.patterns)
    )
    return f"""{scored(rules)},
runs AS ({runs}),
pieces AS (
  SELECT * EXCLUDE (fenced), unnest(string_split(fenced, chr(1))) AS piece,
    generate_subscripts(string_split(fenced, chr(1)), 1) AS pos
  FROM runs WHERE contains(fenced, chr(1))),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY doc_id, page_no, block_no, category, pattern_idx
    ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS "start" FROM pieces),
matches AS MATERIALIZED (
  SELECT doc_id, page_no, block_no, category, category_ord::INTEGER AS category_ord, pattern_idx::INTEGER AS pattern_idx,
    (pos // 2 - 1)::INTEGER AS match_idx, substring(text, "start" + 1, length(piece)) AS match_text,
    "start", ("start" + length(piece))::INTEGER AS "end", confidence, replacement, text
  FROM placed WHERE pos % 2 = 0)"""


def profiled() -> str:
    """Documents redacted under the profile of their source: all matches from 0.5, kept by the profile's thresholds."""
    rows = ", ".join(
        f"({q(p)}, {q(c)}, {q(t) if t else 'NULL'}, {f'{x}::DOUBLE' if x is not None else 'NULL'}, {'NULL' if on is None else on})"
        for p, c, t, x, on in catalog.PROFILES
    )
    open_rules = DEFAULT_RULES.override({n: {"threshold": 0.5} for n in DEFAULT_RULES.names()})
    thresholds = ", ".join(f"({q(c.name)}, {float(c.threshold)}::DOUBLE)" for c in DEFAULT_RULES.categories)
    return f"""
WITH named AS (
  SELECT *, CASE WHEN n < 5 THEN 'strict' WHEN n < 10 THEN 'contacts' WHEN n < 15 THEN 'quiet' END AS profile
  FROM (SELECT *, regexp_extract(source, '[0-9]+')::INT AS n FROM documents))
SELECT d.doc_id, string_agg(coalesce(r.tokens, d.line), chr(10) ORDER BY d.i) AS text, any_value(lang) AS lang, any_value(source) AS source,
  any_value(n_chars) AS n_chars, any_value(profile) AS profile
FROM (SELECT * EXCLUDE (n), unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM named) d
LEFT JOIN (
  {DOC_CTX}, {matches(open_rules)},
  settings(profile, category, replacement, threshold, enabled) AS (VALUES {rows}),
  own(category, threshold) AS (VALUES {thresholds}),
  kept AS (
    SELECT DISTINCT m.doc_id, m.block_no, m.category_ord, coalesce(s.replacement, m.replacement) AS token
    FROM matches m JOIN (SELECT doc_id, CASE WHEN n < 5 THEN 'strict' WHEN n < 10 THEN 'contacts' WHEN n < 15 THEN 'quiet' END AS profile
      FROM (SELECT doc_id, regexp_extract(source, '[0-9]+')::INT AS n FROM documents)) p ON p.doc_id = m.doc_id
    JOIN own o ON o.category = m.category LEFT JOIN settings s ON s.profile = p.profile AND s.category = m.category
    WHERE coalesce(s.enabled, true)
      AND m.confidence >= CASE WHEN p.profile IS NULL THEN greatest(o.threshold, 0.7::DOUBLE) ELSE coalesce(s.threshold, o.threshold) END)
  SELECT doc_id, block_no, string_agg(token, ' ' ORDER BY category_ord) AS tokens FROM kept GROUP BY ALL) r ON r.doc_id = d.doc_id AND r.block_no = d.i
GROUP BY d.doc_id"""


KEYS = "doc_id, page_no, block_no"


def redacted(ctx: str, rules: RuleSet, min_confidence: float = 0.7) -> str:
    return f"""{ctx}, {matches(rules, min_confidence)},
tokens AS (
  SELECT {KEYS}, string_agg(replacement, ' ' ORDER BY category_ord) AS tokens
  FROM (SELECT DISTINCT {KEYS}, category_ord, replacement FROM matches) GROUP BY ALL)
SELECT c.doc_id, c.page_no, c.block_no, x0, y0, x1, y1, coalesce(tokens, raw_text) AS text, tokens IS NOT NULL AS redacted
FROM ctx c LEFT JOIN tokens t ON c.doc_id = t.doc_id AND c.page_no = t.page_no AND c.block_no = t.block_no"""


# Spans kept of a block: longest first, each unless it overlaps one kept before.
KEPT = f"""
kept AS (
  SELECT {KEYS}, unnest(kept) AS s FROM (
    SELECT {KEYS}, list_reduce(
      list([{{'start': "start", 'end': "end", 'category': category, 'category_ord': category_ord,
              'pattern_idx': pattern_idx, 'match_text': match_text, 'replacement': replacement}}]
        ORDER BY "end" - "start" DESC, category_ord, pattern_idx, "start"),
      lambda acc, x: CASE WHEN len(list_filter(acc, lambda k: k.start < x[1].end AND x[1].start < k.end)) > 0
        THEN acc ELSE list_concat(acc, x) END) AS kept
    FROM (SELECT DISTINCT ON ({KEYS}, "start", "end") * FROM matches
          ORDER BY {KEYS}, "start", "end", category_ord, pattern_idx)
    GROUP BY ALL))"""


def spans_redacted(ctx: str, rules: RuleSet, min_confidence: float = 0.7, keep: str = "true") -> str:
    kept = KEPT.replace("* FROM matches", f"* FROM matches WHERE {keep}")
    return f"""{ctx}, {matches(rules, min_confidence)}, {kept},
gaps AS (
  SELECT {KEYS}, s, lag(s.end, 1, 0) OVER (PARTITION BY {KEYS} ORDER BY s.start) AS gap FROM kept),
rebuilt AS (
  SELECT g.doc_id, g.page_no, g.block_no,
    string_agg(substring(c.text, gap + 1, s.start - gap) || s.replacement, '' ORDER BY s.start)
      || substring(any_value(c.text), max(s.end) + 1) AS new_text
  FROM gaps g JOIN ctx c ON g.doc_id = c.doc_id AND g.page_no = c.page_no AND g.block_no = c.block_no
  GROUP BY g.doc_id, g.page_no, g.block_no)
SELECT c.doc_id, c.page_no, c.block_no, x0, y0, x1, y1, coalesce(new_text, raw_text) AS text, new_text IS NOT NULL AS redacted
FROM ctx c LEFT JOIN rebuilt r ON c.doc_id = r.doc_id AND c.page_no = r.page_no AND c.block_no = r.block_no"""


# Every character of the source that cleaning keeps, with its place in the cleaned text.
PLACES = f"""
letters AS (
  SELECT {KEYS}, unnest(regexp_extract_all(raw_text, '(?s).')) AS c, generate_subscripts(regexp_extract_all(raw_text, '(?s).'), 1) - 1 AS pos FROM ctx),
printable AS (
  SELECT {KEYS}, pos, c, lag(c) OVER (PARTITION BY {KEYS} ORDER BY pos) AS before
  FROM (SELECT {KEYS}, pos, translate(c, '|O¡¦—–\u00ad', 'I0iI---') AS c FROM letters) WHERE NOT regexp_matches(c, '[\\p{{C}}{WIDE_SPACES}]')),
places AS MATERIALIZED (
  SELECT {KEYS}, list(pos ORDER BY pos) AS ps FROM printable WHERE c <> ' ' OR before <> ' ' GROUP BY ALL)"""

RAW_MATCHES = f"""
raw_matches AS (
  SELECT m.*, c.raw_text, ps["start" + 1]::INTEGER AS raw_start, (ps["end"] + 1)::INTEGER AS raw_end
  FROM matches m JOIN ctx c ON c.doc_id = m.doc_id AND c.page_no = m.page_no AND c.block_no = m.block_no
  JOIN places p ON p.doc_id = m.doc_id AND p.page_no = m.page_no AND p.block_no = m.block_no)"""


def source_spans_redacted(ctx: str, rules: RuleSet, min_confidence: float) -> str:
    """Blocks with spans replaced in the text before cleaning."""
    return f"""{ctx}, {matches(rules, min_confidence)}, {KEPT}, {PLACES},
placed_spans AS (
  SELECT s.replacement AS token, k.doc_id, k.page_no, k.block_no, ps[s.start + 1] AS a, ps[s.end] + 1 AS z
  FROM kept k JOIN places p ON p.doc_id = k.doc_id AND p.page_no = k.page_no AND p.block_no = k.block_no),
gaps AS (SELECT *, lag(z, 1, 0) OVER (PARTITION BY {KEYS} ORDER BY a) AS gap FROM placed_spans),
rebuilt AS (
  SELECT g.doc_id, g.page_no, g.block_no,
    string_agg(substring(c.raw_text, gap + 1, a - gap) || token, '' ORDER BY a) || substring(any_value(c.raw_text), max(z) + 1) AS new_text
  FROM gaps g JOIN ctx c ON g.doc_id = c.doc_id AND g.page_no = c.page_no AND g.block_no = c.block_no
  GROUP BY g.doc_id, g.page_no, g.block_no)
SELECT c.doc_id, c.page_no, c.block_no, x0, y0, x1, y1, coalesce(new_text, raw_text) AS text, new_text IS NOT NULL AS redacted
FROM ctx c LEFT JOIN rebuilt r ON c.doc_id = r.doc_id AND c.page_no = r.page_no AND c.block_no = r.block_no"""


def documents_redacted(min_confidence: float, blocks: str | None = None) -> str:
    """Documents with redacted lines put back."""
    blocks = blocks or redacted(DOC_CTX, DEFAULT_RULES, min_confidence)
    return f"""
SELECT d.doc_id, string_agg(coalesce(r.text, d.line), chr(10) ORDER BY d.i) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars
FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) d
LEFT JOIN (SELECT * FROM ({blocks}) WHERE redacted) r ON r.doc_id = d.doc_id AND r.block_no = d.i
GROUP BY d.doc_id"""


def usage(rules: RuleSet) -> str:
    """Matches by category, zero included."""
    rows = ", ".join(
        f"({i}, {q(c.name)}, {q(c.token)}, {float(c.threshold)}::DOUBLE)" for i, c in enumerate(rules.categories)
    )
    return f"""
usage AS (
  SELECT r.category_ord, r.category, r.replacement, r.threshold, count(m.doc_id) AS n_matches
  FROM (VALUES {rows}) r(category_ord, category, replacement, threshold)
  LEFT JOIN matches m ON m.category = r.category GROUP BY ALL)"""


DOC_MATCHES = f"{DOC_CTX}, {matches(DEFAULT_RULES)}"
FORM_MATCHES = f"{FORM_CTX}, {matches(DEFAULT_RULES)}"
FORM_LABELLED = f"{FORM_CTX}, {matches(DEFAULT_RULES, 0.7)}"
MATCH_COLUMNS = (
    f'{KEYS}, category, category_ord, pattern_idx, match_idx, match_text, "start", "end", confidence, replacement'
)
FORM_INDEX = f"""{FORM_LABELLED},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY page_no, block_no, pattern_idx, "start") AS "index"
  FROM matches)"""


def pseudonyms(scope: str) -> str:
    return f"""
valued AS (SELECT *, lower(trim(match_text)) AS value FROM matches),
firsts AS (
  SELECT {scope}, value, min(row(doc_id, page_no, block_no, pattern_idx, "start")) AS first FROM valued GROUP BY ALL),
numbers AS (SELECT *, row_number() OVER (PARTITION BY {scope} ORDER BY first) AS "index" FROM firsts)"""


def numbered_documents(numbers: str) -> str:
    """Documents with kept spans replaced; ``numbers`` gives CTE ``numbered`` from CTE ``spans``."""
    return f"""
SELECT d.doc_id, string_agg(coalesce(r.new_text, d.line), chr(10) ORDER BY d.i) AS text, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars
FROM (SELECT *, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) d
LEFT JOIN (
  {DOC_CTX}, {matches(DEFAULT_RULES, 0.6)}, {KEPT}, {PLACES},
  spans AS (
    SELECT k.doc_id, k.page_no, k.block_no, s.category AS category, s.pattern_idx AS pattern_idx, s.start AS "start", s.match_text AS match_text,
      ps[s.start + 1] AS a, ps[s.end] + 1 AS z
    FROM kept k JOIN places p ON p.doc_id = k.doc_id AND p.page_no = k.page_no AND p.block_no = k.block_no),
  {numbers},
  gaps AS (SELECT *, {NUMBERED_TOKEN} AS token, lag(z, 1, 0) OVER (PARTITION BY {KEYS} ORDER BY a) AS gap FROM numbered)
  SELECT g.doc_id, g.block_no,
    string_agg(substring(c.raw_text, gap + 1, a - gap) || token, '' ORDER BY a) || substring(any_value(c.raw_text), max(z) + 1) AS new_text
  FROM gaps g JOIN ctx c ON g.doc_id = c.doc_id AND g.page_no = c.page_no AND g.block_no = c.block_no
  GROUP BY g.doc_id, g.page_no, g.block_no) r ON r.doc_id = d.doc_id AND r.block_no = d.i
GROUP BY d.doc_id"""


NUMBERED_TOKEN = """CASE category
  WHEN 'Email Addresses' THEN '[EMAIL-' || "index" || ']' || CASE WHEN contains(match_text, '@') THEN '@' || split_part(match_text, '@', 2) ELSE '' END
  WHEN 'Phone Numbers' THEN '[PHONE-' || "index" || ']'
  ELSE '[' || category || '-' || "index" || ']' END"""

CONSISTENT = """
  valued AS (SELECT *, lower(trim(match_text)) AS value FROM spans),
  firsts AS (SELECT category, value, min(row(doc_id, page_no, block_no, pattern_idx, "start")) AS first FROM valued GROUP BY ALL),
  numbers AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY first) AS "index" FROM firsts),
  numbered AS (SELECT v.*, "index" FROM valued v JOIN numbers n ON n.category = v.category AND n.value = v.value)"""

COUNTED = """
  numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY page_no, block_no, pattern_idx, "start") AS "index" FROM spans)"""

PATHS = "SELECT doc_id, source || '/' || lang || '/' || doc_id AS path FROM documents"


def _gold() -> str:
    rows = ", ".join(f"({q(c)}, {b})" for c, b in forms.GOLD_BLOCKS)
    return f"""
gold AS (
  SELECT doc_id, page_no, block_no, g.category, 0 AS "start", length(text) AS "end"
  FROM raw JOIN (VALUES {rows}) g(category, block) ON g.block = raw.block_no)"""


WIDE_RAW = """
raw AS (
  SELECT c_nationkey AS doc_id, 0 AS page_no, c_custkey AS block_no, x0, y0,
    x0 + 20 + c_custkey % 11 * 30 AS x1, y0 + 8 + (c_custkey % 5) * (c_custkey % 5) * 11 AS y1, c_name AS text
  FROM (SELECT *, (c_custkey * 37 % 40 * 9)::DOUBLE AS x0, (c_custkey // 50 * 3 % 120 * 4)::DOUBLE AS y0 FROM customer))"""

RUN_RAW = """
raw AS (
  SELECT 0 AS doc_id, 0 AS page_no, c_custkey AS block_no, (c_custkey * 10)::DOUBLE AS x0, y0, (c_custkey * 10 + 8)::DOUBLE AS x1,
    y0 + 8 AS y1, c_name AS text FROM (SELECT *, (c_custkey * 7 % 23 * 4)::DOUBLE / 10 AS y0 FROM customer))"""

CTX_COLUMNS = f"{KEYS}, x0, y0, x1, y1, raw_text, text, preceding_text, following_text, is_table_cell"

luhn = lambda t: (
    f"(list_sum(list_transform(list_reverse(string_split(regexp_replace({t}, '[^0-9]', '', 'g'), '')), "
    "lambda d, i: CASE WHEN d = '' THEN 0 WHEN i % 2 = 1 THEN d::INT WHEN d::INT * 2 > 9 THEN d::INT * 2 - 9 "
    "ELSE d::INT * 2 END)) % 10 = 0)"
)

SHOWN = """CASE category
  WHEN 'Email Addresses' THEN '[EMAIL-' || "index" || ']' || CASE WHEN contains(match_text, '@') THEN '@' || split_part(match_text, '@', 2) ELSE '' END
  WHEN 'Phone Numbers' THEN '[PHONE-' || "index" || ']'
  WHEN 'Names' THEN {names}
  WHEN 'Addresses' THEN '[REDACTED-ADDRESS]'
  WHEN 'Account Numbers' THEN '[ACC-' || printf('%03d', "index") || ']-' || right(match_text, 4)
    || CASE WHEN regexp_full_match(right(match_text, 4), '[0-9]{{4}}') THEN ' (' || right(match_text, 4) || ')' ELSE '' END
  ELSE '[REDACTED]' END"""

DISTRIBUTION = """
by_doc AS (SELECT doc_id, category, pattern_idx, count(*) AS n FROM matches GROUP BY ALL),
slots AS (SELECT unnest({slots}) AS s),
p AS (SELECT s.category AS category, s.pattern_idx AS pattern_idx, coalesce(sum(n), 0)::BIGINT AS n_matches, count(n) AS n_docs,
        coalesce(max(n), 0) AS max_per_doc FROM slots LEFT JOIN by_doc b ON b.category = s.category AND b.pattern_idx = s.pattern_idx GROUP BY ALL),
c AS (SELECT s.category AS category, -1 AS pattern_idx, coalesce(sum(n), 0)::BIGINT AS n_matches, count(n) AS n_docs, coalesce(max(n), 0)::BIGINT AS max_per_doc
      FROM (SELECT DISTINCT s.category AS category FROM slots) s LEFT JOIN (SELECT doc_id, category, sum(n) AS n FROM by_doc GROUP BY ALL) d ON d.category = s.category GROUP BY ALL),
t AS (SELECT 'all' AS category, -1 AS pattern_idx, coalesce(sum(n), 0)::BIGINT AS n_matches, count(*) AS n_docs, coalesce(max(n), 0)::BIGINT AS max_per_doc
      FROM (SELECT doc_id, sum(n) AS n FROM by_doc GROUP BY ALL))
SELECT * FROM p UNION ALL SELECT * FROM c UNION ALL SELECT * FROM t"""

HIT_QUANTILES = """
units AS (
  SELECT 'document' AS level, doc_id, 0 AS page_no, category, pattern_idx FROM matches
  UNION ALL SELECT 'page', doc_id, page_no, category, pattern_idx FROM matches),
cells AS (
  SELECT level, category, pattern_idx, count(*) AS n FROM units GROUP BY level, doc_id, page_no, category, pattern_idx
  UNION ALL SELECT level, category, -1, count(*) FROM units GROUP BY level, doc_id, page_no, category
  UNION ALL SELECT level, 'all', -1, count(*) FROM units GROUP BY level, doc_id, page_no)
SELECT level, category, pattern_idx, count(*) AS n_units, quantile_disc(n, 0.5) AS p50, quantile_disc(n, 0.9) AS p90, quantile_disc(n, 0.99) AS p99, max(n) AS most
FROM cells GROUP BY level, category, pattern_idx"""

SLOTS = "[" + ", ".join(
    f"{{'category': {q(c.name)}, 'pattern_idx': {j}}}"
    for c in DEFAULT_RULES.categories
    for j in range(len(c.patterns))
) + "]"

MANY_RULES = rf"""
listed AS (
  SELECT row_number() OVER (ORDER BY word) - 1 AS rule_id, word
  FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{{8,}}')) AS word FROM documents) ORDER BY word LIMIT {catalog.N_RULES}),
words AS (SELECT DISTINCT {KEYS}, unnest(regexp_extract_all(shadow, '[a-z0-9]+')) AS word FROM shaded WHERE length(text) >= 2),
runs AS MATERIALIZED (
  SELECT s.doc_id, s.page_no, s.block_no, s.text, rule_id, is_table_cell, regexp_matches(pre_shadow, 'client') OR regexp_matches(post_shadow, 'client') AS label_hit,
    regexp_replace(shadow, '(\b' || l.word || '\b(?: [a-z]+)?)', chr(1) || '\1' || chr(1), 'g') AS fenced
  FROM words w JOIN listed l ON l.word = w.word
  JOIN shaded s ON s.doc_id = w.doc_id AND s.page_no = w.page_no AND s.block_no = w.block_no),
pieces AS (
  SELECT * EXCLUDE (fenced), unnest(string_split(fenced, chr(1))) AS piece, generate_subscripts(string_split(fenced, chr(1)), 1) AS pos
  FROM runs WHERE contains(fenced, chr(1))),
placed AS (
  SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY {KEYS}, rule_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS "start" FROM pieces)
SELECT {KEYS}, 'Watchlist' AS category, rule_id, (pos // 2 - 1)::INTEGER AS match_idx, substring(text, "start" + 1, length(piece)) AS match_text,
  "start", ("start" + length(piece))::INTEGER AS "end",
  0.5::DOUBLE + CASE WHEN label_hit THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN is_table_cell THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END AS confidence,
  '[LISTED]' AS replacement
FROM placed WHERE pos % 2 = 0"""

SQL: dict[str, str] = {
    "blocks_from_text": f"WITH {DOC_RAW} SELECT * FROM raw",
    "blocks_from_turns": f"WITH {TURN_RAW} SELECT * FROM raw",
    "blocks_from_records": f"WITH {FORM_RAW} SELECT * FROM raw",
    "rejects": """
        SELECT * FROM (
          SELECT c_custkey AS doc_id, 0::BIGINT AS page_no, CASE WHEN c_nationkey <> 7 THEN 0 ELSE -1 END AS block_no,
            CASE WHEN c_nationkey = 7 THEN 'missing_key' WHEN c_mktsegment = 'MACHINERY' THEN 'missing_text'
                 WHEN c_acctbal < 0 THEN 'inverted_box' END AS reason FROM customer) WHERE reason IS NOT NULL""",
    "clean_text_blocks": f"WITH {DOC_RAW} SELECT {KEYS}, {clean('text')} AS cleaned FROM raw",
    "luhn_valid_cards": f"""
        SELECT c_custkey, card, {luhn('card')} AS card_ok, {luhn('card')} AS spaced_ok, {luhn('c_mktsegment')} AS segment_ok
        FROM (SELECT *, {CARD} AS card FROM customer)""",
    "merge_blocks": f"WITH {FORM_RAW}, {MERGED} SELECT * FROM merged",
    "table_cells": f"{DOC_CTX} SELECT {KEYS}, is_table_cell FROM ctx",
    "neighbor_text": f"{DOC_CTX} SELECT {KEYS}, preceding_text, following_text FROM ctx",
    "block_context": f"{FORM_CTX} SELECT {CTX_COLUMNS} FROM ctx",
    "wide_page_context": f"WITH {WIDE_RAW}, {MERGED}, {CONTEXT} SELECT {CTX_COLUMNS} FROM ctx",
    "merge_long_runs": f"WITH {RUN_RAW}, {MERGED} SELECT * FROM merged",
    "confidence_score": f"""{DOC_CTX}, {scored(DEFAULT_RULES)}
        SELECT {KEYS}, is_table_cell, category, confidence, confidence >= threshold AS reported FROM scored""",
    "label_hit": f"{FORM_CTX}, {scored(DEFAULT_RULES)} SELECT {KEYS}, category, label_hit FROM scored",
    "detect_pii": f"{DOC_MATCHES} SELECT {MATCH_COLUMNS} FROM matches",
    "match_offsets": f"""{FORM_MATCHES} SELECT {KEYS}, category, pattern_idx, match_idx, "start", "end", match_text AS span_text FROM matches""",
    "ordered_matches": f"""{FORM_MATCHES} SELECT {KEYS}, category, pattern_idx, "start", "end", replacement FROM matches
        ORDER BY doc_id, category_ord, page_no, block_no, pattern_idx, "start" """,
    "custom_pattern": f"""{DOC_CTX}, {matches(catalog.CUSTOM_RULES)} SELECT {KEYS}, category, pattern_idx, match_text, "start", replacement FROM matches""",
    "many_rules": f"{DOC_CTX}, {MANY_RULES}",
    "card_numbers": f"""{DOC_CTX}, {matches(catalog.CARD_RULES)} SELECT {KEYS}, match_text, "start", "end" FROM matches WHERE {luhn('match_text')}""",
    "ssn": f"""{FORM_CTX}, {matches(catalog.SSN_RULES)}
        SELECT {KEYS}, match_text, confidence FROM matches WHERE match_text[1:3] NOT IN ('000', '666') AND match_text[1] <> '9'
          AND match_text[5:6] <> '00' AND match_text[8:11] <> '0000'""",
    "match_preview": f"""{DOC_MATCHES}
        SELECT {KEYS}, category, pattern_idx, match_idx, match_text, confidence, before, after, before || replacement || after AS proposed
        FROM (SELECT *, right(left(text, "start"), 20) AS before, left(substring(text, "end" + 1), 20) AS after FROM matches)""",
    "redact_blocks": redacted(DOC_CTX, DEFAULT_RULES),
    "redact_selected": redacted(FORM_CTX, DEFAULT_RULES.without(["Names"])),
    "exclude_matches": redacted(FORM_CTX, DEFAULT_RULES).replace(
        "FROM matches) GROUP BY ALL",
        "FROM matches WHERE NOT (category = 'Account Numbers' AND doc_id IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0))) GROUP BY ALL",
    ),
    "dedupe_spans": f"""{DOC_MATCHES}, {KEPT}
        SELECT {KEYS}, s.category AS category, s.pattern_idx AS pattern_idx, s.start AS "start", s.end AS "end", s.match_text AS match_text FROM kept""",
    "redact_spans": spans_redacted(FORM_CTX, DEFAULT_RULES),
    "redact_spans_text": spans_redacted(DOC_CTX, DEFAULT_RULES),
    "redact_cards": spans_redacted(DOC_CTX, catalog.CARD_RULES, 0.5, luhn("match_text")),
    "redact_documents": documents_redacted(0.7),
    "redact_documents_at_table_score": documents_redacted(0.6),
    "redact_documents_in_place": documents_redacted(0.7),
    "redact_documents_in_place_at_table_score": documents_redacted(0.6),
    "redact_document_spans_in_place": documents_redacted(0.6, source_spans_redacted(DOC_CTX, DEFAULT_RULES, 0.6)),
    "redact_spans_in_source": source_spans_redacted(NOISY_CTX, DEFAULT_RULES, 0.6),
    "raw_offsets": f"""{NOISY_CTX}, {matches(DEFAULT_RULES)}, {PLACES}, {RAW_MATCHES}
        SELECT {KEYS}, category, pattern_idx, match_idx, "start", raw_start, raw_end, substring(raw_text, raw_start + 1, raw_end - raw_start) AS raw_match FROM raw_matches""",
    "redact_blocks_at_table_score": redacted(DOC_CTX, DEFAULT_RULES, 0.6),
    "audit_log": f"""{DOC_CTX}, {matches(DEFAULT_RULES, 0.7)}
        SELECT {KEYS}, category, pattern_idx, "start", "end", confidence, replacement, sha256(match_text) AS match_sha256 FROM matches""",
    "replacement_index": f"""{DOC_MATCHES} SELECT {KEYS}, category, pattern_idx, "start",
        row_number() OVER (PARTITION BY doc_id, category ORDER BY page_no, block_no, pattern_idx, "start") AS "index" FROM matches""",
    "replacement_index_corpus": f"""{DOC_MATCHES} SELECT {KEYS}, category, pattern_idx, "start",
        row_number() OVER (PARTITION BY category ORDER BY doc_id, page_no, block_no, pattern_idx, "start") AS "index" FROM matches""",
    "consistent_pseudonyms": f"""{DOC_MATCHES}, {pseudonyms('category')}
        SELECT {KEYS}, v.category, pattern_idx, "start", v.value, "index" FROM valued v JOIN numbers n ON n.category = v.category AND n.value = v.value""",
    "consistent_names": f"""{FORM_LABELLED}, {pseudonyms('doc_id, category')}
        SELECT v.doc_id, page_no, block_no, v.category, pattern_idx, "start", v.value, v.category || '-' || "index" AS pseudonym
        FROM valued v JOIN numbers n ON n.doc_id = v.doc_id AND n.category = v.category AND n.value = v.value""",
    "replacement_format": f"""{FORM_INDEX}
        SELECT {KEYS}, category, pattern_idx, "start",
          CASE category WHEN 'Names' THEN '[REDACTED]' WHEN 'Addresses' THEN '[REDACTED]' WHEN 'Account Numbers' THEN '[REDACTED]'
            ELSE {SHOWN.format(names="''")} END AS by_default_rules,
          {SHOWN.format(names="'[NAME]'")} AS by_own_rules,
          {SHOWN.format(names="'Names-' || " + '"index"')} AS with_category FROM numbered""",
    "pseudonymized_text": numbered_documents(CONSISTENT),
    "numbered_text": numbered_documents(COUNTED),
    "pseudonyms_by_path": f"""{DOC_MATCHES},
        valued AS (SELECT m.*, path, lower(trim(match_text)) AS value FROM matches m JOIN ({PATHS}) p ON p.doc_id = m.doc_id),
        firsts AS (SELECT category, value, min(row(encode(path), page_no, block_no, pattern_idx, "start")) AS first FROM valued GROUP BY ALL),
        numbers AS (SELECT category, value, row_number() OVER (PARTITION BY category ORDER BY first) AS "index" FROM firsts)
        SELECT path, page_no, block_no, v.category, pattern_idx, "start", v.value, "index" FROM valued v JOIN numbers n ON n.category = v.category AND n.value = v.value""",
    "counts_by_path": f"""{DOC_MATCHES} SELECT path, category, count(*) AS n_matches FROM matches m JOIN ({PATHS}) p ON p.doc_id = m.doc_id GROUP BY ALL""",
    "pii_counts": f"{DOC_MATCHES} SELECT category, count(*) AS n_matches FROM matches GROUP BY ALL",
    "categories": f"{FORM_MATCHES}, {usage(DEFAULT_RULES)} SELECT category_ord, category, n_matches FROM usage",
    "rules_override": f"""{DOC_CTX}, {matches(DEFAULT_RULES.override(catalog.OVERRIDES))}, {usage(DEFAULT_RULES.override(catalog.OVERRIDES))}
        SELECT category, replacement, threshold, n_matches FROM usage""",
    "matches_by_doc": f"""{DOC_MATCHES} SELECT doc_id, page_no, block_no // 4096 AS part, category, count(*) AS n_matches,
        string_agg(block_no || ':' || pattern_idx || ':' || "start" || ':' || match_text, ' / ' ORDER BY block_no, pattern_idx, "start") AS matches
        FROM matches GROUP BY doc_id, page_no, part, category""",
    "pattern_distribution": f"{DOC_MATCHES}, {DISTRIBUTION.format(slots=SLOTS)}",
    "redact_by_profile": profiled(),
    "redact_by_settings": documents_redacted(
        0.0,
        redacted(DOC_CTX, DEFAULT_RULES.without(["Account Numbers", "Addresses"]).override(
            {n: {"threshold": 0.9} for n in DEFAULT_RULES.names()} | {"Names": {"threshold": 0.9, "replacement": "[NAME]"}, "Phone Numbers": {"threshold": 0.9, "replacement": "XXX-XXX-XXXX"}}
        ), 0.0),
    ),
    "own_rules": f"""{DOC_CTX}, {matches(catalog.OWN_RULES)} SELECT {KEYS}, category, pattern_idx, match_text, "start", replacement FROM matches""",
    "hit_quantiles": f"{DOC_MATCHES}, {HIT_QUANTILES}",
    "match_lists": f"""{DOC_MATCHES},
        numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, category ORDER BY page_no, block_no, pattern_idx, "start") - 1 AS place FROM matches)
        SELECT doc_id, category, place // 100 AS part, place // 100 * 100 AS first, count(*)::INTEGER AS n_matches,
          string_agg(page_no || ':' || block_no || ':' || pattern_idx || ':' || "start" || ':' || match_text, ' / ' ORDER BY place) AS matches
        FROM numbered GROUP BY doc_id, category, place // 100""",
    "batch_summary": f"""{DOC_MATCHES},
        labelled AS (SELECT DISTINCT {KEYS} FROM matches WHERE confidence >= 0.7)
        SELECT 'documents scanned' AS metric, (SELECT count(DISTINCT doc_id) FROM ctx) AS n
        UNION ALL SELECT 'documents with personal data', (SELECT count(DISTINCT doc_id) FROM matches)
        UNION ALL SELECT 'documents redacted', (SELECT count(DISTINCT doc_id) FROM labelled)
        UNION ALL SELECT 'blocks scanned', (SELECT count(*) FROM ctx)
        UNION ALL SELECT 'blocks redacted', (SELECT count(*) FROM labelled)
        UNION ALL SELECT 'matches: ' || r.category, count(m.doc_id) FROM (VALUES {', '.join(f'({q(n)})' for n in DEFAULT_RULES.names())}) r(category)
          LEFT JOIN matches m ON m.category = r.category GROUP BY r.category""",
    "top_pii_docs": f"{DOC_MATCHES} SELECT doc_id, count(*) AS n_matches FROM matches GROUP BY doc_id ORDER BY n_matches DESC, doc_id LIMIT 10",
    "detection_quality": f"""{FORM_LABELLED}, {_gold()},
        found AS (SELECT DISTINCT {KEYS}, category, "start", "end" FROM matches),
        compared AS (SELECT coalesce(f.category, g.category) AS category, f.doc_id IS NOT NULL AS p, g.doc_id IS NOT NULL AS g
          FROM found f FULL JOIN gold g ON f.doc_id = g.doc_id AND f.page_no = g.page_no AND f.block_no = g.block_no
            AND f.category = g.category AND f."start" = g."start" AND f."end" = g."end")
        SELECT category, count(*) FILTER (p AND g) AS true_positives, count(*) FILTER (p AND NOT g) AS false_positives,
          count(*) FILTER (g AND NOT p) AS false_negatives,
          CASE WHEN bool_or(p) THEN count(*) FILTER (p AND g) / count(*) FILTER (p) END AS precision,
          CASE WHEN bool_or(g) THEN count(*) FILTER (p AND g) / count(*) FILTER (g) END AS recall
        FROM compared GROUP BY category""",
    "ocr_page_text": """
        WITH words AS (
          SELECT doc_id, unnest(string_split(text, ' ')) AS text, generate_subscripts(string_split(text, ' '), 1) - 1 AS word_no FROM documents),
        rated AS (SELECT *, word_no // 400 AS page_no, (doc_id * 31 + word_no * 17) % 100 AS conf FROM words)
        SELECT doc_id, page_no, coalesce(string_agg(trim(text), ' ' ORDER BY word_no) FILTER (conf > 60 AND trim(text) <> ''), '') AS page_text,
          coalesce(avg(conf) FILTER (conf > 60 AND trim(text) <> ''), 0.0)::DOUBLE AS mean_conf
        FROM rated GROUP BY doc_id, page_no""",
}
