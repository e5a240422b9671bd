import random
import re

from inkveil.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, threshold=0.8):
    own = words(text)
    places = [(i, label) for p, label in licenses.PHRASES.items() for i in range(len(own)) if own[i : i + len(p.split())] == p.split()]
    windows = []
    for label, template in licenses.TEMPLATES:
        t, size = set(words(template)), len(words(template))
        size += -(-size // 4)
        for i, w in enumerate(own):
            held = [k for k in range(i, min(i + size, len(own))) if own[k] in t] if w in t else []
            n = len({own[k] for k in held})
            if n and n >= threshold * len(t) - 1e-9:
                windows.append((i, held[-1], n, n / len(t), label))
    kept = [w for w in windows if not any(v[0] <= w[1] and w[0] <= v[1] and v[2:4] > w[2:4] for v in windows)]
    found, share = {w[4] for w in kept}, max((w[3] for w in kept), default=0.0)
    base = {x for _, x in places}
    starts = [i for i, _ in places]
    return (
        len(own), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(sorted(base)), ",".join(sorted(base | found)), 1.0 if base else share,
    )


def test_same_as_brute_force(spark):
    r = random.Random(2)
    texts = [None, "", "\n\n", "cc by cc by", "All rights\nreserved", "ALL RIGHTS RESERVED. all rights reserved", "general public license" * 2, "x" * 9 + " cc by", "Ä cc by-nc é", "cc  -- BY", "cc\x0bby", "á " * 40000 + "cc by"]
    for _ in range(300):
        line = words(r.choice(licenses.TEMPLATES)[1])
        for _ in range(r.randrange(4)):
            if line and r.random() < 0.6:
                del line[r.randrange(len(line))]
            else:
                line.insert(r.randrange(len(line) + 1), r.choice(["the", "ñu", "x9"]))
        if r.random() < 0.3:
            r.shuffle(line)
        texts.append("some text the\n" + " ".join(line).title() + r.choice(["", "\nmore of the text", " and so on"]))
    docs = spark.createDataFrame([(i, t, 1.5) for i, t in enumerate(texts)] + [(3, texts[3], 0.0), (None, texts[4], 0.0)], "doc_id long, text string, score double")
    got = licenses.scan_licenses(docs).collect()
    assert len(got) == len(texts) + 2
    for row in got:
        text = texts[row.doc_id if row.doc_id is not None else 4]
        want = brute(text)
        assert tuple(row)[1:7] == want[:6] and abs(row.score - want[6]) < 1e-9, text
    assert licenses.scan_licenses(docs.limit(0)).count() == 0


def by_text(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in sorted(licenses.scan_licenses(docs).collect(), key=lambda r: r.doc_id)]


def test_every_template_wrapped_at_every_word(spark):
    texts, want = [], []
    for label, template in licenses.TEMPLATES:
        own = template.split()
        for i in range(1, len(own) + 1):
            texts.append("before it\n * " + " ".join(own[:i]) + "\n * " + " ".join(own[i:]) + "\nand after")
            want.append(label)
    got = by_text(spark, texts)
    base = {"gpl-3": "gpl,gpl-3", "cc-by": "cc-by", "cc-by-nc": "cc-by,cc-by-nc", "cc-by-sa": "cc-by,cc-by-sa", "reserved": "reserved"}
    assert got == [base.get(w, w) for w in want]


def test_scattered_words_are_no_license(spark):
    filler = " ".join(f"w{i}" for i in range(60))
    scattered = f" {filler} ".join(["licensed", "under", "cc", "by", "4", "0"])
    long_ago = f"Licensed under the {filler} Apache License, {filler} Version 2.0"
    assert by_text(spark, [scattered, long_ago]) == ["", ""]


def test_two_licenses_side_by_side_and_many_in_one_text(spark):
    one, two = licenses.TEMPLATES[6][1], licenses.TEMPLATES[0][1]
    assert by_text(spark, [f"{one}. {two}", (one + "\n") * 3000 + two, "by " * 5000 + "Licensed under CC BY-SA 4.0"]) == ["apache-2.0,mit", "apache-2.0,mit", "cc-by,cc-by-sa"]
