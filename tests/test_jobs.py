"""Whole jobs, streams, plans, and the queries against SQL."""

import os

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F

import __spark_entry__ as entry
import compare
from inkveil.operators.in_place import redact_in_place
from inkveil.operators.ocr_text import ocr_page_text
from inkveil.operators.redact import redact_blocks, redact_documents
from inkveil.plans import pipeline
from inkveil.sources import store
from inkveil.sources.store import CLEANUP, stage
from inkveil.sources.blocks import blocks_from_text, read_table
from inkveil.streaming import redaction
from inkveil.streaming.redaction import redact_stream, write_apart, write_stream

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(
    "path, name",
    [("/a/b.parquet", "/a/b-anonymized.parquet"), ("/a/b", "/a/b-anonymized"), ("b.c.d", "b.c-anonymized.d"),
     ("s3://x.y/t/", "s3://x.y/t-anonymized"), ("/a/.b", "/a/.b-anonymized")],
)
def test_output_name(path, name):
    assert store.anonymized_path(path) == name


@pytest.fixture
def letters(spark, tmp_path):
    text = "Dear all\nplease call the office about this, the number is new\n202-555-0143\nBye"
    path = str(tmp_path / "letters.parquet")
    spark.createDataFrame([(1, text), (2, "nothing\nhere")], "doc_id long, text string").write.parquet(path)
    return path


def test_anonymize_writes_a_new_table(spark, letters, tmp_path):
    log = str(tmp_path / "log")
    out = pipeline.anonymize(spark, letters, audit_path=log)
    assert out == letters.replace(".parquet", "-anonymized.parquet")
    written = {r.doc_id: r.text for r in spark.read.parquet(out).collect()}
    source = {r.doc_id: r.text for r in spark.read.parquet(letters).collect()}
    assert written[2] == source[2] and written[1] != source[1]
    assert written[1].count("\n") == source[1].count("\n")
    assert spark.read.parquet(log).count() > 0
    matches = pipeline.detect_pii(spark, letters).where("confidence >= 0.7").collect()
    assert matches and not any(m.match_text in written[1] for m in matches)
    with pytest.raises(AnalysisException):
        pipeline.anonymize(spark, letters)


def test_every_row_and_column_comes_back(spark, tmp_path):
    path, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    rows = [("a/1", "x\n\n y  O", "en", 1), ("a/1", None, "de", 2), (None, "a\nb", None, 3), ("b", "", "fr", 4), ("c", "\n \n", "fr", 5)]
    spark.createDataFrame(rows, "doc_id string, text string, lang string, n int").write.parquet(path)
    for spans in (False, True):
        out = pipeline.anonymize(spark, path, str(tmp_path / f"out{spans}"), spans=spans, rejects_path=bad + str(spans))
        assert sorted(map(tuple, spark.read.parquet(out).collect()), key=str) == sorted(rows, key=str)
    found = sorted((r.n, r.reason) for r in spark.read.parquet(bad + "True").collect())
    assert found == [(2, "missing_text"), (3, "missing_key")]


def test_rejected_blocks_are_kept_or_refused(spark, tmp_path):
    path, bad = str(tmp_path / "t"), str(tmp_path / "bad")
    rows = [(1, 0, 0, 0.0, 0.0, 9.0, 9.0, "a"), (1, 0, 1, 0.0, 20.0, 9.0, 29.0, None)]
    spark.createDataFrame(rows, "doc_id long, page_no long, block_no long, x0 double, y0 double, x1 double, y1 double, text string").write.parquet(path)
    with pytest.raises(ValueError):
        pipeline.anonymize(spark, path, text_table=False)
    out = pipeline.anonymize(spark, path, spans=True, rejects_path=bad, text_table=False)
    assert spark.read.parquet(out).count() == 1
    assert [(r.block_no, r.reason) for r in spark.read.parquet(bad).collect()] == [(1, "missing_text")]


def test_block_table_gives_the_same_as_text(spark, letters, tmp_path):
    blocks = str(tmp_path / "blocks")
    blocks_from_text(spark.read.parquet(letters)).write.parquet(blocks)
    a = pipeline.detect_pii(spark, letters)
    b = pipeline.detect_pii(spark, blocks, text_table=False)
    assert a.count() > 0 and a.exceptAll(b).count() == 0 == b.exceptAll(a).count()


def test_stream_gives_the_same_as_batch(spark, letters, tmp_path):
    spark.createDataFrame([(3, None), (4, "\n\n"), (None, "x")], "doc_id long, text string").write.mode("append").parquet(letters)
    stream = spark.readStream.schema("doc_id long, text string").parquet(letters)
    out = str(tmp_path / "out")
    query = write_stream(redact_stream(stream), out, str(tmp_path / "cp"))
    query.awaitTermination(120)
    batch = redact_in_place(spark.read.parquet(letters))
    streamed = spark.read.parquet(out)
    assert streamed.count() == batch.count() == 5 and streamed.exceptAll(batch).count() == 0


def test_stream_with_rejects_survives_a_restart(spark, letters, tmp_path, monkeypatch):
    spark.createDataFrame([(3, None), (None, "x")], "doc_id long, text string").write.mode("append").parquet(letters)
    out, bad, cp = (str(tmp_path / n) for n in ("out", "bad", "cp"))
    run = lambda: write_apart(spark.readStream.schema("doc_id long, text string").parquet(letters), out, bad, cp)
    working = redaction.redact_in_place
    monkeypatch.setattr(redaction, "redact_in_place", lambda *a, **k: working(*a, **k).withColumn("text", F.raise_error(F.lit("lost"))))
    with pytest.raises(StreamingQueryException):
        run().awaitTermination(120)  # rejects are written, then the batch fails
    assert spark.read.parquet(bad).count() == 2
    monkeypatch.setattr(redaction, "redact_in_place", working)
    run().awaitTermination(120)
    spark.createDataFrame([(5, "late"), (6, None)], "doc_id long, text string").write.mode("append").parquet(letters)
    run().awaitTermination(120)
    assert sorted((r.doc_id is None, r.doc_id, r.reason) for r in spark.read.parquet(bad).collect() if r.doc_id) == [(False, 3, "missing_text"), (False, 6, "missing_text")]
    assert spark.read.parquet(bad).count() == 3
    usable = working(spark.read.parquet(letters).where("doc_id is not null and text is not null"))
    assert spark.read.parquet(out).drop("batch").exceptAll(usable).count() == 0 == usable.exceptAll(spark.read.parquet(out).drop("batch")).count()
    assert spark.read.parquet(out).count() == 3


def test_ocr_words(spark):
    words = [(1, 0, 2, " b ", 60.1), (1, 0, 1, "a", 61.0), (1, 0, 3, "no", 60.0), (1, 0, 4, "  ", 99.0), (1, 2, 5000, "z", 70.0), (1, 2, 1, "y", 80.0), (1, 1, 0, "x", 5.0)]
    df = spark.createDataFrame(words, "doc_id long, page_no long, word_no long, text string, conf double")
    got = {r.page_no: (r.page_text, r.mean_conf) for r in ocr_page_text(df).collect()}
    assert got == {0: ("a b", (61.0 + 60.1) / 2), 1: ("", 0.0), 2: ("y z", 75.0)}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_text_is_redacted_without_shuffle_or_python(spark):
    redacted = redact_blocks(pipeline.text_context(spark.read.parquet(f"{SF}/documents.parquet")))
    p = plan(redacted)
    assert "Exchange" not in p and "Python" not in p and "Join" not in p
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in p


def test_documents_are_redacted_in_one_pass(spark):
    for spans in (False, True):
        p = plan(redact_in_place(spark.read.parquet(f"{SF}/documents.parquet"), spans=spans))
        assert not any(word in p for word in ("Exchange", "Python", "Join", "Generate", "Sort", "Aggregate"))


def test_counts_shuffle_counters_only(spark):
    p = plan(entry.queries()["top_pii_docs"](spark, SF))
    texts = [l for l in p.splitlines() if "Exchange" in l and "text" in l and "doc_id" in l]
    assert all("REPARTITION_BY_NUM" in l for l in texts)
    assert "Python" not in p and "CartesianProduct" not in p and "NestedLoop" not in p


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = compare.tables(SF).execute(entry.oracle_sql()[name]).df()
    assert compare.difference(got, want) is None


def test_a_table_of_many_splits_is_not_shuffled(spark, tmp_path):
    spark.range(40).repartition(8).write.parquet(f"{tmp_path}/t")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "100000")
    try:
        few, many = (read_table(spark, f"{tmp_path}/t", n) for n in (9, 8))
        plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
        assert "Repartition" in plan(few) and "Repartition" not in plan(many)
        assert sorted(r.id for r in few.collect()) == sorted(r.id for r in many.collect()) == list(range(40))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_table_written_between_steps_leaves_no_shuffle_setting(spark):
    staged = stage(spark.range(100).repartition(4))
    assert staged.count() == 100 and spark.conf.get(CLEANUP, None) in (None, "false")
    names = os.listdir(staged.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0])
    assert any(n.endswith(".zstd.parquet") for n in names)


def test_lines_are_cleaned_and_scored_once(spark):
    """Dropping the lines that stay works nothing out a second time."""
    documents = spark.createDataFrame([(1, "name: Ann Lee\nx"), (2, None), (3, "")], "doc_id long, text string")
    plan = redact_documents(documents, min_confidence=0.6)._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.split("\n") if "Filter " in line[:60]]
    assert filters and not any("RLIKE" in line or "regexp_replace" in line for line in filters)


def test_ocr_words_in_any_order(spark):
    """Numbers across runs, equal ones and null ones: as sorted by number and then by word."""
    words = [(n, f"w{n}") for n in (0, 1, 9, 10, 255, 256, 4095, 4096, 4097, 8192, 70000)] + [(10, "a"), (10, "z"), (None, "none"), (-1, "minus")]
    words = words[::-1] + [(5, "\u00e9\U0001f600"), (6, "  out  ")]
    df = spark.createDataFrame([(1, 0, n, w, 90.0) for n, w in words], "doc_id long, page_no long, word_no long, text string, conf double").repartition(4)
    [row] = ocr_page_text(df).collect()
    assert row.page_text == " ".join(w.strip() for _, w in sorted(words, key=lambda x: (x[0] is not None, x[0] or 0, x[1])))
    assert "struct(word_no" not in ocr_page_text(df)._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["ordered_matches", "exclude_matches"])
def test_matches_read_twice_are_found_once(spark, tmp_path, name):
    """A sort reads its rows twice, and so does leaving out some of them: the patterns run before, into a stored table."""
    rows = [(i, f"Customer#{i}", i % 25, i - 3.0, "BUILDING") for i in range(6)]
    schema = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/customer.parquet")
    found = entry.queries()[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "/stage-" in plan and "\\u0001" not in plan and "\u0001" not in plan
    assert found.count() > 0
