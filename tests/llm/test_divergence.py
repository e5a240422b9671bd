import random
import re
from collections import Counter, defaultdict

import pytest

from inkveil.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string"


def brute(rows, least_docs, most):
    """All shares of all groups by plain counting."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, *_ in rows:
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", folded)
        groups[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in {k[0] for k in groups}:
        kept = sorted((t for t, n in docs[lang].items() if n >= least_docs), key=str.encode)
        own = {s: c for (x, s), c in groups.items() if x == lang}
        whole = Counter()
        for c in own.values():
            whole.update(c)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(whole)
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:most])):
                out |= {(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)}
    return out


def corpus(sources, seed=3):
    r = random.Random(seed)
    words = [a + b for a in ("ka", "Lu", "é", "ß", "mo", "日") for b in ("", "x", "yy", "Z", "ñ")]
    rows = []
    for i in range(240):
        text = " ".join(r.choice(words[: r.randrange(5, 30)]) + r.choice(["", ",", "1", "-", "@"]) for _ in range(r.randrange(40)))
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(sources)))
    return rows


def found(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("tile,sweep,most", [(64, 1024, 50), (3, 4, 3)])
def test_same_as_brute_force(spark, monkeypatch, tile, sweep, most):
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "SWEEP", sweep)
    monkeypatch.setattr(divergence, "BLOCK", 7)
    monkeypatch.setattr(divergence, "BUCKET", 9)
    monkeypatch.setattr(divergence, "MOST_HELD", 40)
    monkeypatch.setattr(divergence, "PIECE", 16)
    rows = corpus([f"s{i}" for i in range(8)] + ["é", "", None])
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows, 4, most)
    assert {r[2] for r in want} == {"pair", "term"}
    assert found(divergence.audit(docs, least_docs=4, most=most)) == want


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rows = [(1, None, None, None), (1, "b a B", "x", "s"), (1, "b a B", "x", "s"), (2, "a c", "x", "t"), (3, "", "y", "u"), (4, "1 2 3", "y", "v"), (None, "z", "w", "s")]
    docs = spark.createDataFrame([(*r, 1, "q", 2, "n") for r in rows], SCHEMA + ", n int, term string, number int, kept string")
    want = brute(rows, 2, 50)
    assert ("y", "u", "pair", "v", 0, 1) in want
    assert found(divergence.audit(docs, least_docs=2)) == want


def test_long_text_and_one_word_everywhere(spark):
    long = "lo ng " * 400_000 + "x" * 3_000_000
    rows = [(0, long, "en", "a"), *((i, "common word", "en", "ab"[i % 2]) for i in range(1, 60))]
    assert found(divergence.audit(spark.createDataFrame(rows, SCHEMA), least_docs=1)) == brute(rows, 1, 50)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_counts_beyond_64_bits_of_the_product(spark):
    row = spark.range(1).select(divergence.share(divergence.F.lit(10**12), divergence.F.lit(3 * 10**12), divergence.F.lit(1000), 10**9)).first()
    assert row[0] == 1 + 10**9 * (10**12 + 5) // (3 * 10**12 + 5000)
