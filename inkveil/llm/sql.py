"""The queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from inkveil.llm.licenses import PHRASES, TEMPLATES, window_words, words

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w),
keyed AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM windows),
firsts AS (SELECT k, min(doc_id) AS d FROM keyed GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM (SELECT doc_id, i FROM keyed JOIN firsts USING (k) WHERE d < doc_id), range(13) r(j)),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(ws)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)"""

SUFFIXES = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
keyed AS (SELECT doc_id, i, substr(h, (2 * i + 1)::INT, 200) AS k FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM b)),
firsts AS (SELECT k, min(row(doc_id, i)) AS f FROM keyed GROUP BY k),
hits AS (SELECT doc_id, i FROM keyed JOIN firsts USING (k) WHERE row(doc_id, i) > f),
marked AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS new FROM hits),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM marked),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS from_ FROM spans),
cut AS (
  SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(substr(h, (2 * from_ + 1)::INT, (2 * (a - from_))::INT), '' ORDER BY a) AS head
  FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(from_hex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256
FROM b LEFT JOIN cut USING (doc_id)"""


def licenses(threshold: float = 0.8) -> str:
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    text = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({text(label)}, [{', '.join(text(w.decode()) for w in sorted(set(words(t.encode()))))}], {window_words(t)})" for label, t in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT doc_id, i - 1 AS i, {text(label)} AS label FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) WHERE "
        + " AND ".join(f"ws[i + {k}] = {text(w)}" for k, w in enumerate(phrase.split()))
        for phrase, label in PHRASES.items()
    )
    return f"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS ws FROM lowered),
numbered AS (SELECT row_number() OVER () AS r, * FROM d),
templates AS (SELECT * FROM (VALUES {templates}) v(label, need, width)),
begun AS (
  SELECT r, doc_id, label, need, unnest(range(1, len(ws) + 1)) AS i, ws, width FROM numbered, templates
  WHERE len(list_intersect(ws, need)) >= ceil({threshold} * len(need) - 1e-9)),
held AS (
  SELECT r, doc_id, label, need, i, list_filter(list_transform(ws[i : i + width - 1], lambda w, k: CASE WHEN list_contains(need, w) THEN k END), lambda k: k IS NOT NULL) AS hits,
    len(list_intersect(ws[i : i + width - 1], need)) AS n
  FROM begun WHERE list_contains(need, ws[i])),
windows AS (SELECT r, doc_id, label, i AS first, i + hits[-1] - 1 AS last, n, n / len(need) AS share FROM held WHERE n >= ceil({threshold} * len(need) - 1e-9)),
met AS (
  SELECT * FROM windows w WHERE NOT EXISTS (
    SELECT 1 FROM windows v WHERE v.r = w.r AND v.first <= w.last AND w.first <= v.last AND (v.n > w.n OR (v.n = w.n AND v.share > w.share)))),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(i) AS first, max(i) AS last, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, list_sort(list(DISTINCT label)) AS labels FROM (SELECT doc_id, label FROM met UNION ALL SELECT doc_id, label FROM places) GROUP BY doc_id),
shares AS (SELECT doc_id, max(share) AS share FROM met GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first AS first_word, last AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels, coalesce(array_to_string(every.labels, ','), '') AS labels,
  CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN shares USING (doc_id)"""


NEGATIVES = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.r AS b, b.vec_id, a.l = b.l AS alike, list_inner_product(a.q, b.q)::BIGINT AS s
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
near AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id, b) <= 5),
met AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.s DESC, n.vec_id, n.b) AS rank
  FROM near p JOIN scored n ON n.a = p.a AND NOT n.alike AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS ln FROM words GROUP BY ALL HAVING count(DISTINCT id) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(ln) AS total FROM kept GROUP BY lang),
groups AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (g.total + 5 * v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (ln + 5)) // (l.total + 5 * v)::HUGEINT AS q
  FROM groups g JOIN kept USING (lang) JOIN langs l USING (lang) LEFT JOIN counts USING (lang, source, term)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM cells a JOIN cells b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM cells WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

SQL = {
    "op1_substrings": SUBSTRINGS,
    "op8_licenses": licenses(),
    "op10_suffixes": SUFFIXES,
    "op12_hard_negatives": NEGATIVES,
    "op13_divergence": DIVERGENCE,
}
