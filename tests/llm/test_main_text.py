import random
import re
from html.parser import HTMLParser

import pytest

from inkveil.llm import main_text

PROSE = "The house is in the town and it was there for a long time, as the old man with the dog said to the people of it. "


def article(*blocks):
    return "<article>" + "".join(blocks) + "</article>"


class Plain(HTMLParser):
    """The article of a page without boilerplate in it, by the parser of the standard library."""

    BREAK = {"article", "p", "h1", "h2", "ul", "li", "div", "blockquote", "section", "figure", "figcaption"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.raw, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        self.raw += tag in ("script", "style")
        if tag in self.BREAK:
            self.blocks.append("")
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag):
        if tag in self.BREAK:
            self.blocks.append("")
        self.inside -= tag == "article"
        self.raw -= tag in ("script", "style")

    def handle_data(self, data):
        if self.inside and not self.raw:
            self.blocks[-1] += data

    def text(self):
        return "\n".join(t for b in self.blocks if (t := re.sub(r"\s+", " ", b).strip()))


def test_pages_same_as_another_parser(spark):
    r = random.Random(4)
    words = ["the", "of", "Katze", "é&eacute;", "a &lt; b", "x&amp;y", "&nbsp;", "日本", "&#8364;5", "b &am", "10%"]
    text = lambda n: " ".join(r.choice(words) for _ in range(r.randrange(1, n)))
    rows = []
    for i in range(200):
        blocks = []
        for _ in range(r.randrange(1, 9)):
            t = text(40)
            blocks.append(r.choice([f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>{t}</b> {t}</p>", f"<h2 id=x>{t}</h2>", f"<ul><li>{t}<li>{t}</li></ul>", f"<blockquote>\n{t}\t{t}</blockquote>", f"<figure><img alt='{t}'><figcaption>{t}</figcaption></figure>", f"<p>{t}<script>if (a < b) '</p>';</script> {t}</p>"]))
        page = f'<!DOCTYPE html><html><head><title>{text(9)}</title><style>p > b {{}}</style></head><body><nav><a href="/x">{text(9)}</a></nav><div class="ad">{PROSE}</div>'
        page += article(*blocks) + f"<footer>{PROSE}</footer>" + r.choice(["", "</body></html>"])
        rows.append((i, "u", page))
    got = {x.page_id: x for x in main_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i, _, page in rows:
        plain = Plain()
        plain.feed(page)
        plain.close()
        assert got[i].text == plain.text(), page
        assert got[i].n_chars == len(got[i].text)


@pytest.mark.parametrize(
    "part",
    [
        "<nav><p>{}</nav>", "<header><p>{}</p></header>", "<footer>{}</footer>", "<aside><p>{}</p></aside>", "<form><p>{}<input></form>", "<div class='ad-slot'><div><p>{}</p></div></div>",
        "<div id=sidebar><p>{}</p></div>", "<div class='CookieNotice'>{}</div>", "<section id='comments'><article class='comment'><p>{}</p></article></section>", "<ul class=menu><li>{}</ul>",
        "<script>{}</script>", "<style>{}</style>", "<!-- <p>{}</p> -->", "<div role=navigation>{}</div>", "<noscript>{}</noscript>", "<p style='display: none'>{}</p>", "<template><p>{}</p></template>",
        "<div class='reader-comments'><p>{}</p></div>", "<select><option>{}</select>", "<textarea>{}</textarea>", "<p><a href=/x>{}</a></p>",
    ],
)
def test_what_is_no_article(part):
    part = part.format("Unwanted. " + PROSE * 3)
    want = "\n".join([PROSE.strip(), "Short.", "End."])
    inside = f"<p>{PROSE}</p>{part}<p>Short.</p>"
    for page in (article(inside, "<p>End."), f"<body>{part}<main>{inside}<p>End.</main>{part}", f"{part}{article(inside, '<h2>End.</h2>')}{part}", f"<div class='has-sidebar content'>{article(inside, '<p>End.')}</div>"):
        if part.startswith("<header") and page.startswith(("<article", "<div")):
            continue  # the header of an article is its heading
        if part.startswith("<header"):
            page = page.replace(inside, f"<p>{PROSE}</p><p>Short.</p>")
        assert main_text.main_text(page) == want, page


def test_rules_where_no_article_is_named():
    links = "<ul>" + "".join(f"<li><a href=/{i}>Page {i}</a>" for i in range(9)) + "</ul>"
    long = PROSE * 3
    page = f"<div>{links}</div><div>Log in</div><div><h1>Title</h1><p>{long}</p><p>Brief one.</p><p>{long}</p><p>{PROSE}</p></div><div>Copyright 2020</div><div>{links}</div>"
    assert main_text.main_text(page) == "\n".join(["Title", long.strip(), "Brief one.", long.strip(), PROSE.strip()])


def test_passes():
    labels = ["bad", "short", "good", "near", "short", "good", "short", "short", "bad", "near", "bad"]
    assert main_text.second_pass(labels, "bad") == [False, False, True, True, True, True, True, False, False, False, False]
    assert main_text.second_pass(["short", "near"], "good") == [True, True]
    assert main_text.second_pass(["short", "bad"], "bad") == [False, False]
    block = lambda t, linked=0: main_text.Block(t, linked, False, None)
    first = lambda b: main_text.first_pass(b, True, False)
    assert first(block(PROSE * 3)) == "good" and first(block(PROSE)) == "near"
    assert first(block("zork " * 60)) == "bad" and first(block("zork")) == "short"
    assert first(block("zork", 4)) == "bad" and first(block(PROSE * 3, 300)) == "bad"


def test_broken_markup_and_references():
    f = main_text.main_text
    assert f("") == f("<") == f("</") == f("<!--") == f("<a") == f("<article") == ""
    assert f("<article>a < b, c <3, &lt;p&gt; &unknown; &amp;amp; &am</article>") == "a < b, c <3, <p> &unknown; &amp; &am"
    assert f("<article>&am<b>p;</b></article>") == "&am" + "p;"
    assert f("<article><p title='a > b'>x</p><!-- <p>y --><p>z") == "x\nz"
    assert f("<form action=/x><article><p>in a form around the page</article></form>") == "in a form around the page"
    assert f("<article><p>one\r\n\ttwo&nbsp; three</p>") == "one two three"
    assert f("<div class='page sidebar-right'><div>" + PROSE * 3 + "</div></div>") == (PROSE * 3).strip()


def test_long_pages_in_proportion(spark):
    page = article("<p>" + "word &amp; " * 400_000, "<div>" * 3000, "<!--" * 20_000)
    assert main_text.main_text(page) == ("word & " * 400_000).strip()
    assert main_text.main_text("<" * 300_000 + "a" * 10) == "<" * 299_999
    assert main_text.main_text("<article>" + "<div>" * 100_000 + "deep") == "deep"


def test_nulls_repeats_clashing_columns_and_empty_table(spark):
    rows = [(1, None, None, "t", 5), (None, "u", "<article>x</article>", "t", 5), (2, "u", "", "t", 5), (2, "u", "", "t", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = sorted(map(tuple, main_text.extract(df).collect()), key=str)
    assert got == sorted([(1, None, "", 0), (None, "u", "x", 1), (2, "u", "", 0), (2, "u", "", 0)], key=str)
    assert main_text.extract(df.limit(0)).count() == 0
