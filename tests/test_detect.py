import random

import pytest
from pyspark.sql import functions as F

from inkveil.operators import detect as D, redact, reports
from inkveil.rules import DEFAULT_RULES, RuleSet
import models

SCHEMA = (
    "doc_id long, page_no long, block_no long, x0 double, y0 double, x1 double, y1 double, "
    "raw_text string, text string, preceding_text string, following_text string, is_table_cell boolean"
)
WORDS = [
    "Jane", "Doe", "Müller", "Renée", "ßtraße", "Äpfel", "éa", "J.", "W", "12", "1999", "0O12", "1lI4567890",
    "Main", "Street", "Broadway", "PO", "Box", "K1A", "0B1", "90210-1234", "+44", "20", "7946", "0958",
    "555-1234", "(202)", "202.555.0143", "ext.", "x", "a.b@mail.com", "＠", "@", "at", "dot", "site.org", "_", "-",
    "4539 1488 0343 6467", "GB82", "1234", "united", "Apt", "4B", "naïve", "é9", "10.0.0.1", "٣٤٥",
]
LABELS = ["", "", "Name:", "my account", "Phone no:", "tel", "mail", "see", "ship to", "E-mail address:", "dr. x", "CARD:", "éname"]


def random_blocks(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        text = models.clean(rnd.choice([" ", "  ", "-"]).join(rnd.choices(WORDS, k=rnd.randrange(1, 14))))
        before, after = (models.clean(rnd.choice(LABELS)) for _ in range(2))
        rows.append((i // 9, i // 3 % 3, i % 3, 0.0, 0.0, 1.0, 1.0, "raw " + text, text, before, after, rnd.random() < 0.5))
    return rows


@pytest.fixture(scope="module")
def rows():
    return random_blocks(11, 400)


@pytest.fixture(scope="module")
def blocks(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def expected(rows):
    return {r[:3]: models.detect(*r[8:]) for r in rows}


def test_detect_equals_model(blocks, expected):
    got = {k: [] for k in expected}
    for m in D.detect(blocks).collect():
        got[(m.doc_id, m.page_no, m.block_no)].append(
            (m.category, m.pattern_idx, m.match_idx, m.match_text, m.start, m.end, m.confidence)
        )
    assert sum(map(len, got.values())) > 2000
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in expected.items()}


def test_span_is_the_match_text(blocks):
    m = D.detect(blocks, keep=["text"])
    span = F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start"))
    assert m.where(span != F.col("match_text")).count() == 0


@pytest.mark.parametrize("floor", [0.0, 0.7, 0.85])
def test_counts_are_the_matches_counted(blocks, floor):
    counts = D.match_counts(blocks, min_confidence=floor).agg(
        *[F.sum(F.get("counts", F.lit(i))) for i in range(5)]
    ).head()
    rows = {r.category: r["count"] for r in D.detect(blocks, min_confidence=floor).groupBy("category").count().collect()}
    assert [rows.get(n, 0) for n in DEFAULT_RULES.names()] == list(counts)


def test_the_four_scores(spark):
    rows = [(i, 0, 0, 0.0, 0.0, 1.0, 1.0, "t", "Jane Doe", l, "", t)
            for i, (l, t) in enumerate([("", False), ("", True), ("Name:", False), ("Name:", True)])]
    table = D.score_table(spark.createDataFrame(rows, SCHEMA)).where("category = 'Names'").orderBy("doc_id").collect()
    assert [(r.label_hit, r.confidence, r.reported) for r in table] == [
        (False, 0.5, False), (False, 0.6, True), (True, 0.8, True), (True, 0.9, True)
    ]


def test_own_label_in_the_block_does_not_count(spark):
    row = (0, 0, 0, 0.0, 0.0, 1.0, 1.0, "t", "Phone: 555-123-4567", "", "", False)
    assert D.detect(spark.createDataFrame([row], SCHEMA)).count() == 0


def test_short_blocks_are_skipped(spark):
    row = (0, 0, 0, 0.0, 0.0, 1.0, 1.0, "7", "7", "x", "", True)
    rules = RuleSet().add_pattern("Digits", r"\d", ["x"], None, 0.5)
    assert D.detect(spark.createDataFrame([row], SCHEMA), rules).count() == 0


def test_category_without_labels_or_replacement(spark):
    row = (0, 0, 0, 0.0, 0.0, 1.0, 1.0, "t", "AB-1234", "x", "", False)
    rules = RuleSet().add_pattern("Plates", r"\b[A-Z]{2}-\d{4}\b", confidence_threshold=0.5)
    (m,) = D.detect(spark.createDataFrame([row], SCHEMA), rules).collect()
    assert (m.confidence, m.replacement) == (0.5, "[REDACTED Plates]")


@pytest.mark.parametrize("selection", [None, {"Names": False, "Addresses": True}])
def test_redact_blocks(blocks, rows, expected, selection):
    dropped = {n for n, on in (selection or {}).items() if not on}
    got = {(r.doc_id, r.page_no, r.block_no): (r.text, r.redacted)
           for r in redact.redact_blocks(blocks, selection=selection).collect()}
    assert len(got) == len(rows)
    for r in rows:
        found = {m[0] for m in expected[r[:3]] if m[6] >= 0.7} - dropped
        tokens = " ".join(c.token for c in DEFAULT_RULES.categories if c.name in found)
        assert got[r[:3]] == ((tokens, True) if found else (r[7], False))


def test_redaction_by_matches_is_the_same(blocks):
    direct = redact.redact_blocks(blocks)
    joined = redact.redact_matched(blocks, D.detect(blocks))
    assert direct.exceptAll(joined).count() == 0 == joined.exceptAll(direct).count()


def test_excluded_matches_do_not_redact(blocks):
    matches = D.detect(blocks, min_confidence=0.7)
    left = redact.exclude_matches(matches, matches.where("category = 'Names'"))
    assert left.where("category = 'Names'").count() == 0
    assert left.count() == matches.where("category <> 'Names'").count()


def test_dedupe_spans(blocks, expected):
    got = {k: [] for k in expected}
    for m in redact.dedupe_spans(blocks).collect():
        got[(m.doc_id, m.page_no, m.block_no)].append((m.category, m.pattern_idx, m.start, m.end))
    for k, matches in expected.items():
        assert sorted(got[k], key=lambda m: m[2]) == [(m[0], m[1], m[4], m[5]) for m in models.dedupe(matches)]


def test_redact_spans(blocks, rows, expected):
    got = {(r.doc_id, r.page_no, r.block_no): r.text for r in redact.redact_spans(blocks).collect()}
    for r in rows:
        kept = models.dedupe([m for m in expected[r[:3]] if m[6] >= 0.7])
        text, at = "", 0
        for m in kept:
            text += r[8][at:m[4]] + DEFAULT_RULES.get(m[0]).token
            at = m[5]
        assert got[r[:3]] == (text + r[8][at:] if kept else r[7])


def test_audit_log_hides_the_text(blocks):
    log = redact.audit_log(D.detect(blocks))
    assert "match_text" not in log.columns and log.where("length(match_sha256) <> 64").count() == 0


def test_reports(blocks, rows, expected):
    every = [m for ms in expected.values() for m in ms]
    counts = {r.category: r.n_matches for r in reports.pii_counts(blocks).collect()}
    assert counts == {n: k for n in DEFAULT_RULES.names() if (k := sum(m[0] == n for m in every))}
    docs = {}
    for k, ms in expected.items():
        docs[k[0]] = docs.get(k[0], 0) + len(ms)
    best = sorted((d for d in docs if docs[d]), key=lambda d: (-docs[d], d))[:5]
    assert [(r.doc_id, r.n_matches) for r in reports.top_documents(blocks, 5).collect()] == [(d, docs[d]) for d in best]
    dist = {(r.category, r.pattern_idx): (r.n_matches, r.n_docs) for r in reports.pattern_distribution(blocks).collect()}
    assert dist[("Names", 3)] == (
        sum(m[:2] == ("Names", 3) for m in every),
        len({k[0] for k, ms in expected.items() if any(m[:2] == ("Names", 3) for m in ms)}),
    )
    assert dist[(None, None)] == (len(every), sum(n > 0 for n in docs.values()))
    summary = {r.metric: r.n for r in reports.batch_summary(blocks).collect()}
    assert summary["blocks scanned"] == len(rows)
    assert summary["blocks redacted"] == sum(any(m[6] >= 0.7 for m in ms) for ms in expected.values())
    pages = reports.matches_by_page(D.detect(blocks))
    assert pages.agg(F.sum("n_matches")).head()[0] == len(every)


def test_no_personal_data_gives_no_rows(spark):
    row = (0, 0, 0, 0.0, 0.0, 1.0, 1.0, "t", "--", "", "", True)
    assert reports.pii_counts(spark.createDataFrame([row], SCHEMA)).count() == 0


def test_quality(spark):
    keys = "doc_id long, page_no long, block_no long, category string, start int, end int"
    span = lambda b, s, e: (0, 0, b, "C", s, e)
    predicted = spark.createDataFrame([span(0, 0, 4), span(0, 0, 4), span(1, 0, 3)], keys)
    gold = spark.createDataFrame([span(0, 0, 4), span(2, 1, 2), span(1, 0, 4)], keys)
    (r,) = reports.detection_quality(predicted, gold).collect()
    assert (r.true_positives, r.false_positives, r.false_negatives, r.precision, r.recall) == (1, 1, 2, 0.5, 1 / 3)
