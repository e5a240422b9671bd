"""Main text of web pages by two passes of rules over blocks.

A page is cut into blocks at the start and end of block elements. The first pass classes each block by
length, link density and density of stop words: ``good`` (long, many stop words), ``near`` (fewer), ``bad`` (mostly
links, or long without stop words), ``short`` (too little to tell). In the second pass ``near`` and ``short`` blocks
take the label of their nearest decided neighbours: good between good ones, bad between bad ones; between a good and a bad one a
``near`` block is good and a ``short`` one takes the nearer one's label (by blocks; a tie is bad).

Markup goes before the rules where it speaks plainly. Scripts, styles, forms, menus, page headers, footers, sidebars and
elements whose class, id or role names an advert, a notice, comments or the like hold no blocks at all. Where a
page has an ``article`` (else ``main``), its blocks are the candidates, its ends count as good neighbours, short blocks are bad between bad ones
only, and stop words decide nothing in it: an article keeps paragraphs of any length in any language, lists of links excepted. Without such an element, the ends of a page
count as bad neighbours (as good ones where no block is good by itself but some are near). Where hardly any block of a page has stop words (another language, or none), length and links decide alone.

One pass over each page in a Python task, no shuffle; memory is that of one page. Scanning goes forward only, so time is
in proportion to the page.

Defined results: null or empty html gives an empty text; markup that is cut off counts to the end of the page; a ``<`` that
begins no tag is text; unknown character references stay as they are; equal rows give equal results; no page gives no row;
other columns are left aside.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of HTML by their role in a page.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist head math object select svg template video".split())
FRAME = frozenset("aside dialog footer form header menu nav search".split())
#: Start of the second closes an open first.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An end tag does not reach beyond these, but for those of WHOLE; lists keep their items apart from those around them.
FENCE = frozenset("article body main table td th".split())
WHOLE = frozenset("article body html main table".split())
LISTS = frozenset("dl ol select table ul".split())

#: Words in class, id or role that name what is not the article.
ASIDE = frozenset(
    "ad ads adbox adsense advert advertisement advertising adverts alert alertdialog banner breadcrumb breadcrumbs byline complementary consent "
    "contentinfo cookie cookies copyright disclaimer footer footnav gdpr legal login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notices notification outbrain overlay pager pagination paywall popup promo promoted promotion recommended related "
    "search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription taboola tagcloud teaser toc toolbar widget widgets".split()
)
COMMENTS = frozenset("comment comments commentlist discussion disqus feedback replies reply respond responses".split())
OFFERS = frozenset("ad ads advert advertisement promo promoted related sponsored teaser".split())
#: Words in class, id or role after which a name says what a page has, not what the element is.
ABOUT = frozenset("has no with without".split())

#: Frequent function words, by language (Danish and Norwegian, Dutch, English, French, German, Italian, Polish, Portuguese, Spanish, Swedish).
STOP = frozenset(
    "af at den der det en er for har i ikke med og på som til "
    "aan de een en het in is maar met niet op te van voor zijn "
    "a an and are as at be but by for from has have he in is it not of on or that the this to was were which with you "
    "au aux avec ce dans de des du elle en est et il je la le les ne nous on ou par pas pour qui que sa se sur un une vous "
    "aber als am an auch auf aus bei das dem den der des die ein eine einer er es für ich im in ist mit nicht sich sie und von war wie zu zum "
    "che con da del della di e gli ha il la le lo ma non per più si sono un una "
    "do i jak jest na nie o od po się to w z za że "
    "ao as com da do dos e em mais na no não o os para por que se um uma "
    "al como con de del el en es la las lo los más no o para pero por que se su un una y "
    "att av den det en ett för har inte med och på som till är".split()
)

#: Characters below which a block is too short to tell, and from which it can be good by itself.
SHORT, LONG = 70, 200
#: Shares: of links from which a block is bad; of stop words from which it is near or good.
LINKS, FEW, MANY = 0.33, 0.15, 0.30

SPACE = re.compile(r"\s+")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""\s*/?\s*([^\s=>/]+)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>]*))?|\s*/?\s*""")
WORD = re.compile(r"[^\W\d_]+")
PART = re.compile(r"[a-z0-9]+")
HIDDEN = re.compile(r"display\s*:\s*none")
CAMEL = re.compile(r"([a-z0-9])([A-Z])")


def tokens(page: str):
    """("text", text, None), ("start", name, attributes), ("end", name, None) in order of the page."""
    at, size = 0, len(page)
    while at < size:
        here = page.find("<", at)
        if here < 0:
            yield "text", page[at:], None
            return
        if here > at:
            yield "text", page[at:here], None
        after = page[here + 1 : here + 2]
        if page.startswith("<!--", here):
            if page.startswith(("->", ">"), here + 4):
                at = page.find(">", here) + 1
                continue
            ends = [x + 3 for x in (page.find("-->", here + 4),) if x >= 0]
            at = min(ends, default=size)
        elif after in ("!", "?") or (after == "/" and not NAME.match(page, here + 2)):
            if after == "/" and here + 2 >= size:
                yield "text", page[here:], None
                return
            close = page.find(">", here)
            at = close + 1 if close >= 0 else size
        elif after == "/":
            name = NAME.match(page, here + 2)
            close = page.find(">", name.end())
            at = close + 1 if close >= 0 else size
            yield "end", name.group().lower(), None
        elif name := NAME.match(page, here + 1):
            own, at, attributes = name.group().lower(), name.end(), {}
            while at < size and page[at] != ">":
                found = ATTRIBUTE.match(page, at)
                if found.end() == at:
                    at += 1
                    continue
                at = found.end()
                if found.group(1):
                    attributes.setdefault(found.group(1).lower(), (found.group(2) or "").strip("\"'"))
            at += 1
            yield "start", own, attributes
            if own in RAW:
                close = re.compile(rf"</{own}(?=[\s/>])", re.IGNORECASE).search(page, at)
                at = close.start() if close else size
        else:
            yield "text", "<", None
            at = here + 1


def named(attributes: dict) -> set[str]:
    """What class, id and role call an element."""
    words, before = set(), ""
    for key in ("class", "id", "role"):
        for word in PART.findall(CAMEL.sub(r"\1 \2", html.unescape(attributes.get(key, ""))).lower()):
            if before not in ABOUT:
                words.add(word)
            before = word
    return words


def reason(name: str, attributes: dict, within: bool, by_names: bool) -> str | None:
    """Why an element and all in it is not the article: ``unseen``, ``comments``, ``aside``; None where it may be.

    ``within``: whether it stands in an article already.
    """
    if name in UNSEEN or name in RAW or "hidden" in attributes or attributes.get("aria-hidden") == "true" or HIDDEN.search(attributes.get("style", "")):
        return "unseen"
    words = named(attributes) if attributes and by_names else set()
    if words & COMMENTS:
        return "comments"
    if name in ("html", "body", "main"):
        return None
    if name in ("article", "h1"):
        return "aside" if words & OFFERS else None
    if name == "header" or "header" in words:
        own = within or (name != "header" and words & {"article", "entry", "post", "section", "story"})
        return None if own else "aside"
    return "aside" if name in FRAME or words & ASIDE else None


def resumes(name: str, stack: list) -> bool:
    """Whether an element left out by what surrounds it is the article all the same.

    A form or a header around the page, or one that was never closed, says nothing about the article in it.
    """
    if stack[-1][1] != "aside" or name not in ("article", "main"):
        return False
    outer = next(n for n, why in stack if why == "aside")
    return name == "main" or (outer in ("form", "header") and not {n for n, _ in stack} & {"aside", "dialog", "nav"})


class Block:
    __slots__ = ("text", "linked", "heading", "region")

    def __init__(self, text: str, linked: int, heading: bool, region: str | None):
        self.text, self.linked, self.heading, self.region = text, linked, heading, region


def blocks_of(page: str, by_names: bool = True) -> list[Block]:
    """Blocks of visible text outside of menus, adverts, comments and the like."""
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, str | None]] = []  # open elements and the reason why they are left out
    names: Counter[str] = Counter()  # of open elements, how many of each
    why = None

    def close_block():
        nonlocal parts
        if parts:
            text = SPACE.sub(" ", "".join(p for p, _ in parts)).strip()
            if text:
                linked = SPACE.sub(" ", "".join(p for p, link in parts if link)).strip()
                region = "article" if names["article"] else "main" if names["main"] else None
                found.append(Block(text, len(linked), any(names[h] for h in HEADINGS), region))
            parts = []

    def pop_to(at: int):
        nonlocal why
        names.subtract(n for n, _ in stack[at:])
        del stack[at:]
        why = stack[-1][1] if stack else None

    def last(wanted, fence=frozenset()) -> int:
        """Place of the innermost of these open elements, not looking beyond a fence; -1 for none."""
        if not any(names[n] for n in wanted):
            return -1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in wanted:
                return i
            if stack[i][0] in fence:
                break
        return -1

    def open_element(name: str, attributes: dict):
        nonlocal why
        implied = [({"a"}, FENCE)] if name == "a" else []
        if name in BLOCKS:
            close_block()
            implied = [({"p"}, FENCE | {"button"})]
            if name in CLOSES:
                implied.append((CLOSES[name], LISTS))
            if name in HEADINGS and stack and stack[-1][0] in HEADINGS:
                implied.append((HEADINGS, frozenset()))
            if name != "head":
                implied.append(({"head"}, frozenset()))
        for wanted, fence in implied:
            if (at := last(wanted, fence)) >= 0:
                pop_to(at)
        if name in VOID:
            return
        if why is None or resumes(name, stack):
            why = reason(name, attributes, bool(names["article"] or names["main"]), by_names)
        stack.append((name, why))
        names[name] += 1

    def close_element(name: str):
        if name in BLOCKS:
            close_block()
        at = last(HEADINGS if name in HEADINGS else {name}, frozenset() if name in WHOLE else FENCE - {name})
        if at < 0:
            return
        within = name not in BLOCKS and any(n in BLOCKS for n, _ in stack[at:])
        if within and stack[at][1] == (stack[at - 1][1] if at else None):
            names[stack.pop(at)[0]] -= 1  # an inline element that ends in a later block than it began in: it alone ends
            at = len(stack)
        pop_to(at)

    for kind, value, attributes in tokens(page):
        if kind == "text" or value == "br":
            if why is None:
                parts.append((" " if kind != "text" else html.unescape(value), names["a"] > 0))
        elif kind == "start":
            open_element(value, attributes)
        else:
            close_element(value)
    close_block()
    return found


def stop_share(text: str) -> float:
    words = WORD.findall(text.lower())
    return sum(w in STOP for w in words) / len(words) if words else 0.0


def first_pass(block: Block, by_words: bool, article: bool) -> str:
    """``good``, ``near``, ``bad`` or ``short``."""
    size = len(block.text)
    if block.linked > LINKS * size and not (article and block.heading):
        return "bad"
    if size < SHORT:
        return "short" if not block.linked or article else "bad"
    if article or not by_words:
        return "good" if article or size >= LONG else "near"
    share = stop_share(block.text)
    if share >= MANY:
        return "good" if size >= LONG else "near"
    return "near" if share >= FEW else "bad"


def second_pass(labels: list[str], ends: str) -> list[bool]:
    """Which blocks are kept; ``ends`` is the label of what lies before the first and after the last."""

    def neighbours(order):
        """For each block, the nearest decided label on one side and its distance."""
        out, label, distance = {}, ends, 0
        for i in order:
            distance += 1
            out[i] = label, distance
            if labels[i] in ("good", "bad"):
                label, distance = labels[i], 0
        return out

    before, after = neighbours(range(len(labels))), neighbours(reversed(range(len(labels))))
    kept = []
    for i, label in enumerate(labels):
        (left, far_left), (right, far_right) = before[i], after[i]
        if label in ("near", "short"):
            if left != right:
                label = "good" if label == "near" or ends == "good" else left if far_left < far_right else right if far_right < far_left else "bad"
            else:
                label = left
        kept.append(label == "good")
    return kept


def kept_blocks(blocks: list[Block]) -> list[Block]:
    """The two passes over the article's blocks, or over all where the page names no article."""
    for region in ("article", "main"):
        own = [b for b in blocks if b.region == region]
        if own:
            labels = [first_pass(b, False, True) for b in own]
            return [b for b, k in zip(own, second_pass(labels, "good")) if k]
    by_words = any(len(b.text) >= SHORT and stop_share(b.text) >= FEW for b in blocks)
    labels = [first_pass(b, by_words, False) for b in blocks]
    ends = "bad" if "good" in labels else "good" if "near" in labels else "bad"
    kept = second_pass(labels, ends)
    # a heading belongs to the block after it
    return [b for i, b in enumerate(blocks) if kept[i] or (b.heading and labels[i] == "short" and any(kept[i + 1 : i + 2]))]


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by line feeds.

    Where nothing is left, classes and ids are not believed: a wrapper may be named after its sidebar.
    """
    kept = kept_blocks(blocks_of(page)) or kept_blocks(blocks_of(page, by_names=False))
    return "\n".join(b.text for b in kept)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``."""

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column("html")]
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"),
                "url": batch.column("url"),
                "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            })

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
