"""BPE encoding and decoding with a table of distinct words.

1. Texts are split into words exactly as the tokenizer does. The documents of a block (a run of about
   ``BLOCK`` bytes of one partition) share a word list; each document keeps the places of its words in
   it. Both are staged.
2. The distinct words of all blocks are encoded, each once, through the tokenizers library.
3. The ids come back by a join on the word, are packed by block, and put in each document's
   places. To decode, the distinct ids of each block are joined with the pieces of the vocabulary.

Splitting: special tokens are cut out first, wherever they stand. A text whose characters all lie
below U+0250 (where normal form C changes nothing) is lower-cased and split by the tokenizer's pattern
here; any other goes through the library's own normalizer and pre-tokenizer. Words are split again to
themselves, so encoding a word by itself gives its ids in every text.

Defined results: null and empty texts have no ids and an empty decoded text; repeated rows and ids
are kept; unknown ids decode to nothing; an empty table gives an empty result; further columns are
not looked at.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from inkveil.llm.common import discard, stage

BLOCK = 32 << 20
#: Documents packed into one row.
PACK = 256
#: Characters up to U+024F: runs of letters, single digits, runs of others; white space as the library has it.
_PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r \x85\xa0\p{L}\p{N}]+")
_OTHER = regex.compile(r"[^\x00-ɏ]")


def plain_tokenizer(model: str) -> Tokenizer:
    tokenizer = Tokenizer.from_str(model)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


class Splitter:
    """Words of a text, as the tokenizer sees them."""

    def __init__(self, model: str):
        self.tokenizer = plain_tokenizer(model)
        special = [t["content"] for t in json.loads(model)["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.specials = frozenset(special)

    def _words(self, text: str) -> list[str]:
        if not _OTHER.search(text):
            return _PATTERN.findall(text.lower())
        normal = self.tokenizer.normalizer.normalize_str(text)
        # Offsets count characters of the normal text; the pieces themselves are in byte symbols.
        return [normal[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]

    def words(self, text: str) -> list[str]:
        if self.special is None or "<" not in text:
            return self._words(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.specials else self._words(part)
        return out


def pack(values: np.ndarray) -> bytes:
    """Small numbers as compressed planes of bytes, lowest first."""
    return pa.compress(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 4 * n, "zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


SPLIT = "block long, doc_ids array<long>, sizes array<int>, places binary, words array<string>"


def split_documents(docs: DataFrame, shared) -> DataFrame:
    """Rows of two kinds, by block: packs of documents (their words' places), and the word list.

    The word list runs from the most to the least frequent word, so that most places are small.
    """

    def run(batches):
        splitter = Splitter(shared.value)
        first = TaskContext.get().partitionId() << 20
        block, size, known, ids, places = 0, 0, {}, [], []

        def flush():
            if not ids:
                return
            flat = np.concatenate([*places, np.zeros(0, np.int32)])
            order = np.argsort(-np.bincount(flat, minlength=len(known)), kind="stable")
            rank = np.empty(len(known), np.int64)
            rank[order] = np.arange(len(order))
            words = np.array(list(known), object)[order].tolist()
            rows = [(None, None, None, words)]
            for a in range(0, len(ids), PACK):
                own = places[a : a + PACK]
                rows.append((ids[a : a + PACK], list(map(len, own)), pack(rank[np.concatenate(own)]), None))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.string()))
            columns = [pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([pa.array([first + block] * len(rows), pa.int64()), *columns], ["block", "doc_ids", "sizes", "places", "words"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                text = text.as_py() or ""
                own = splitter.words(text)
                for w in own:
                    if w not in known:
                        known[w] = len(known)
                places.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
                ids.append(doc)
                size += len(text)
                if size >= BLOCK:
                    yield from flush()
                    block, size, known, ids, places = block + 1, 0, {}, [], []
                    pa.default_memory_pool().release_unused()
        yield from flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SPLIT)


def encode_words(words: DataFrame, shared) -> DataFrame:
    """(word, ids): every distinct word encoded once."""

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads hold memory of their own
        tokenizer = plain_tokenizer(shared.value)
        for batch in batches:
            for a in range(0, max(1, len(batch)), 2000):
                part = tokenizer.encode_batch_fast(batch.slice(a, 2000).to_pylist(), add_special_tokens=False)
                ids = [e.ids for e in part]
                out = pa.array(ids, pa.list_(pa.int32())) if a == 0 else pa.concat_arrays([out, pa.array(ids, pa.list_(pa.int32()))])
            yield out

    return words.distinct().select("word", encode("word").alias("ids"))


def ids_by_block(lists: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(block, n, n_ids, place, size, ids, n_used, used): the ids of each block's words, packed by task and block; ``used`` are
    the distinct ones in order."""

    def run(batches):
        kept: dict[int, list] = {}
        for batch in batches:
            block = batch.column("block").to_numpy()
            ids = batch.column("ids")
            size = ids.value_lengths().to_numpy()
            order = np.argsort(block, kind="stable")
            taken = ids.take(pa.array(order))
            at, flat, ends = batch.column("place").to_numpy()[order], taken.flatten().to_numpy(), np.r_[0, np.cumsum(size[order])]
            bounds = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                kept.setdefault(int(block[order[a]]), []).append((at[a:b], size[order[a:b]], flat[ends[a] : ends[b]]))
        for number, parts in kept.items():
            at, size, flat = (np.concatenate(x) for x in zip(*parts))
            used = np.unique(flat)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([number], pa.int64()), "n": pa.array([len(at)], pa.int32()), "n_ids": pa.array([len(flat)], pa.int32()),
                "place": [pack(at)], "size": [pack(size)], "ids": [pack(flat)], "n_used": pa.array([len(used)], pa.int32()), "used": [pack(used)],
            })

    located = lists.select("block", F.posexplode("words").alias("place", "word"))
    joined = located.join(vocabulary, "word").select("block", "place", "ids")
    return joined.mapInArrow(run, "block long, n int, n_ids int, place binary, size binary, ids binary, n_used int, used binary")


def pieces_by_block(by_block: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, known, pieces): the pieces of all ids that stand in a block; at most as many as the tokenizer has."""

    def run(parts: pa.Table) -> pa.Table:
        stands = np.zeros(0, bool)
        for n, data in zip(parts.column("n_used").to_pylist(), parts.column("used").to_pylist()):
            own = unpack(data, n)
            if n and own[-1] >= len(stands):
                stands = np.r_[stands, np.zeros(own[-1] + 1 - len(stands), bool)]
            stands[own] = True
        ids = np.flatnonzero(stands).astype(np.int32)
        return pa.table({"block": pa.array(np.full(len(ids), parts.column("block")[0].as_py())), "id": pa.array(ids)})

    # An id that several tasks met is one row of its block.
    used = by_block.select("block", "n_used", "used").groupBy("block").applyInArrow(run, "block long, id int")
    pairs = F.collect_list(F.struct("id", "piece")).alias("pairs")
    return used.join(pieces, "id").groupBy("block").agg(pairs).select("block", F.col("pairs.id").alias("known"), F.col("pairs.piece").alias("pieces"))


def join_back(packs: DataFrame, by_block: DataFrame, finish: Callable, columns: str) -> DataFrame:
    """Put the ids of a block's words in each document's places, and the pieces of the ids of each word together."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        packed = zip(*(right.column(c).to_pylist() for c in ("n", "n_ids", "place", "size", "ids")))
        parts = [(unpack(p, n), unpack(s, n), unpack(i, m)) for n, m, p, s, i in packed if n is not None]
        words = max((int(p.max()) + 1 for p, _, _ in parts), default=0)
        size, start = np.zeros(words, np.int64), np.zeros(words, np.int64)
        flat = np.concatenate([np.zeros(0, np.int64), *(i for _, _, i in parts)])
        begin = 0
        for p, s, i in parts:
            size[p], start[p] = s, begin + np.cumsum(s) - s
            begin += len(i)
        known = {i: p for ids, own in zip(right.column("known").to_pylist(), right.column("pieces").to_pylist()) for i, p in zip(ids or (), own or ())}
        text = [" ".join([known[i] for i in flat[a : a + n].tolist() if i in known]) for a, n in zip(start.tolist(), size.tolist())]
        rows = []
        for ids, sizes, data in zip(*(left.column(c).to_pylist() for c in ("doc_ids", "sizes", "places"))):
            at = unpack(data, sum(sizes))
            for doc, n in zip(ids, sizes):
                own, at = at[:n], at[n:]
                many = size[own]
                index = np.repeat(start[own] - np.cumsum(many) + many, many) + np.arange(many.sum())
                rows.append((doc, *finish(flat[index], " ".join([text[w] for w in own.tolist() if size[w]]))))
        return pa.table([pa.array([r[i] for r in rows], arrow.types[i]) for i in range(len(arrow))], schema=arrow)

    schema = f"doc_id long, {columns}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return packs.groupBy("block").cogroup(by_block.groupBy("block")).applyInArrow(run, schema)


def ids_and_text(ids: np.ndarray, text: str):
    return ids.astype(np.int32), text


def encode_decode(docs: DataFrame, path: str, finish: Callable = ids_and_text, columns: str = "ids array<int>, decoded string") -> DataFrame:
    """``doc_id`` and what ``finish`` makes of a document's ids and decoded text.

    ``path``: the tokenizer's file, read by the driver; executors get its content.
    """
    context = docs.sparkSession.sparkContext
    with open(path, encoding="utf-8") as f:
        model = f.read()
    shared = context.broadcast(model)
    vocab = [(i, p) for p, i in plain_tokenizer(model).get_vocab(True).items()]  # as many as the tokenizer has
    pieces = docs.sparkSession.createDataFrame(vocab, "id int, piece string")
    split = stage(split_documents(docs, shared))
    lists = split.where("words is not null").select("block", "words")
    vocabulary = stage(encode_words(lists.select(F.explode("words").alias("word")), shared))
    by_block = stage(ids_by_block(lists, vocabulary))
    discard(vocabulary)
    with_pieces = by_block.drop("n_used", "used").unionByName(pieces_by_block(by_block, pieces), allowMissingColumns=True)
    return join_back(split.where("words is null").drop("words"), with_pieces, finish, columns)


def digest(ids: np.ndarray, text: str):
    """Count and SHA-256 of the ids (little-endian, 32 bits), SHA-256 of the decoded text."""
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def ids_and_digest(ids: np.ndarray, text: str):
    return len(ids), ids.astype(np.int32), hashlib.sha256(text.encode()).hexdigest()


IDS = "n_tokens long, ids array<int>, decoded_sha256 string"
