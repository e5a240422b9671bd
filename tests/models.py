"""Plain Python models, slow and simple, against which results are checked."""

import re

from inkveil.rules import DEFAULT_RULES


def clean(text):
    text = text.translate(str.maketrans("|O¡¦—–­", "I0iI---"))
    return " ".join("".join(c for c in text if c.isprintable()).split())


def merge(blocks):
    """``blocks``: (no, x0, y0, x1, y1, text) in order."""
    out = []
    for no, x0, y0, x1, y1, text in blocks:
        if out and abs(y0 - out[-1][2]) < 5 and abs(x0 - out[-1][3]) < 15:
            out[-1][3] = x1
            out[-1][5] += " " + text
        else:
            out.append([no, x0, y0, x1, y1, text])
    return [tuple(b) for b in out]


def near(rect, raw):
    left, top, right, bottom = rect
    texts = [b[5] for b in raw if left < right and b[1] < right and b[3] > left and b[2] < bottom and b[4] > top]
    return clean(" ".join(" ".join(texts).split()))


def context(raw):
    """(no, raw text, text, preceding, following, table cell) of every merged block of a page."""
    out = []
    for no, x0, y0, x1, y1, text in merge(raw):
        box = (x0, y0, x1, y1)
        beside = [
            b for b in raw if b[1:5] != box and (abs(b[2] - y0) < 10 or abs(b[1] - x0) < 10)
        ]
        out.append(
            (
                no, text, clean(text),
                near((max(0, x0 - 150), y0 - 10, x0, y1 + 10), raw),
                near((x1, y0 - 10, x1 + 150, y1 + 10), raw),
                len(beside) >= 2,
            )
        )
    return out


def detect(text, preceding, following, table, rules=DEFAULT_RULES):
    """(category, pattern, match number, text, start, end, confidence) of every reported match."""
    out = []
    if len(text) < 2:
        return out
    for c in rules.categories:
        beside = [t for t in (preceding, following) if t]
        hit = any(re.search(l, t, re.I) for l in c.labels for t in beside)
        score = 0.5 + (0.3 if hit else 0.0) + (0.1 if table else 0.0)
        if score < c.threshold:
            continue
        for i, p in enumerate(c.patterns):
            for k, m in enumerate(re.finditer(p.regex, text, re.I)):
                out.append((c.name, i, k, m.group(), m.start(), m.end(), score))
    return out


def dedupe(matches, rules=DEFAULT_RULES):
    rank = {c.name: i for i, c in enumerate(rules.categories)}
    kept = []
    for m in sorted(matches, key=lambda m: (m[4] - m[5], rank[m[0]], m[1], m[4])):
        if all(m[5] <= k[4] or k[5] <= m[4] for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: m[4])


def luhn(text):
    total = 0
    for i, d in enumerate(int(c) for c in reversed(text) if "0" <= c <= "9"):
        total += sum(divmod(d * 2, 10)) if i % 2 else d
    return total % 10 == 0
