import hashlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkveil.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [
    "Hello, world! It's 2024; they'll say 'tis 3rd.", "", None, " \t\n \x85", "ÉCOLE über straße Ñandú", "a<|endoftext|>b <|startoftext|>",
    "<|endoftext", "''s $$'s x'S I'M", "é café ﬁ Σας ΟΔΟΣ", "日本語 テスト ١٢٣ ¼ x²", "a\x1cb\x1dc\x00d", "İstanbul ǅ", "x" * 3000, "lö" * 50 + " emoji 👍🏽 zero​width",
    "tab\tnew\nline\r\x0b\x0c", "Hello, world!", "123456 7.5% a_b-c", "K Å ß ſ", "﻿bom", "क्षि नमस्ते",
]


def expected(text):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_same_ids_and_text_as_the_library(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "y"), (None, "a b", "z")], "doc_id long, text string, words string")
    got = bpe.encode_decode(docs, PATH).collect()
    assert len(got) == len(TEXTS) + 2
    for row in got:
        text = TEXTS[row.doc_id] if row.doc_id is not None else "a b"
        assert (row.ids, row.decoded) == expected(text), text


def test_digest_and_empty_table(spark):
    docs = spark.createDataFrame([(7, "one two")], "doc_id long, text string")
    row = bpe.encode_decode(docs, PATH, bpe.digest, bpe.DIGEST).collect()
    ids, text = expected("one two")
    want = (7, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert [tuple(r) for r in row] == [want]
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0


def test_ids_of_a_block_are_rows_once(spark):
    """However many tasks hold words of a block, an id is one row of it."""
    parts = [(3, [5, 7]), (3, [5, 7, 9]), (3, []), (4, [7])]
    by_block = spark.createDataFrame([(b, len(ids), bpe.pack(np.array(ids, np.int64))) for b, ids in parts], "block long, n_used int, used binary")
    pieces = spark.createDataFrame([(5, "five"), (7, "seven"), (9, "nine")], "id int, piece string")
    found = bpe.pieces_by_block(by_block.repartition(4), pieces)
    got = {row.block: sorted(zip(row.known, row.pieces)) for row in found.collect()}
    assert got == {3: [(5, "five"), (7, "seven"), (9, "nine")], 4: [(7, "seven")]}
    rows = spark.createDataFrame([(i, "one two three " * 3 + str(i)) for i in range(40)], "doc_id long, text string").repartition(4)
    shared = spark.sparkContext.broadcast(open(PATH, encoding="utf-8").read())
    lists = bpe.split_documents(rows, shared).where("words is not null").select("block", "words").localCheckpoint()
    words = bpe.encode_words(lists.selectExpr("explode(words) word"), shared)
    packed = bpe.ids_by_block(lists, words).collect()
    for row in packed:
        assert bpe.unpack(row.used, row.n_used).tolist() == sorted(set(bpe.unpack(row.ids, row.n_ids).tolist()))
