import hashlib
import random
import re


from inkveil.llm import spots


def chains(text):
    """Signatures as tuples: anchor run and two content words."""
    out, run, units = set(), [], []
    for w in re.findall(r"[^\W_]+", text.lower()):
        if w in spots.COMMON:
            run.append(w)
        else:
            units.append((tuple(run), w))
            run = []
    for (anchors, w), (_, after) in zip(units, units[1:]):
        if anchors:
            out.add((anchors, w, after))
    return out


def jaccard(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def corpus(seed=1):
    r = random.Random(seed)
    words = ["the", "of", "a", "der", "und", "Katze", "dog", "runs", "ñandú", "été", "x1", "house", "Über", "tree"]
    text = lambda n: " ".join(r.choice(words) + r.choice(["", "", ",", "."]) for _ in range(n))
    rows = [(i * 7, text(r.randrange(60))) for i in range(60)]
    rows += [(1001, rows[3][1]), (1002, rows[3][1]), (1003, None), (1004, ""), (1005, "the of the"), (1006, "👍🏽é the cat sat"), (-5, "the " * 3000 + "end of all"), (1007, text(20000))]
    return rows


def test_same_as_plain_python(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(6)
    got = {r.doc_id: r for r in spots.fingerprint_digest(docs).collect()}
    ring = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for i, (d, t) in enumerate(ring):
        after = ring[(i + 1) % len(ring)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert len(r.fingerprint) == 8 * len(chains(t)) and len(r.edited_fingerprint) == 8 * len(chains(edited))
        assert abs(r.near_edited - jaccard(chains(t), chains(edited))) < 1e-9
        assert abs(r.near_next - jaccard(chains(t), chains(after))) < 1e-9
    assert got[1001].fingerprint == got[1002].fingerprint


def test_null_ids_repeated_rows_and_small_tables(spark):
    docs = spark.createDataFrame([(None, "the cat sat"), (None, "the dog ran"), (2, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    assert spots.fingerprint_digest(docs).count() == 4
    one = spots.fingerprint_digest(docs.where("doc_id = 2").limit(1)).collect()
    assert one[0].near_next == 1.0
    assert spots.fingerprint_digest(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    plan = spots.fingerprint_digest(spark.createDataFrame([(1, "x")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_pairs_same_as_brute_force(spark):
    r = random.Random(2)
    base = [("the " if i % 3 else "") + f"w{i}" for i in range(90)]
    rows = []
    for i in range(60):
        own = [w if r.random() > 0.01 * (i % 5) else f"v{r.randrange(99)}" for w in base[r.randrange(4) : r.randrange(60, 90)]]
        rows.append((i, " ".join(own)))
    rows = [(i, t if i % 7 else rows[i - i % 3][1]) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    member = {m.doc_id: m["set"] for m in spots.memberships(docs).collect()}
    got = {frozenset((p.a, p.b)): p.likeness for p in spots.near_pairs(docs).collect()}
    want = {}
    for i, t in rows:
        for j, u in rows:
            if i < j and member[i] != member[j] and jaccard(chains(t), chains(u)) >= 0.8:
                want[frozenset((member[i], member[j]))] = jaccard(chains(t), chains(u))
    assert want and got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
