"""Extraction rules, and agreement with a stack-based parser on the page table."""

import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.operators.pages import extract_pages

DATA = "/root/testdata/sf0.001"
LONG = "a text that is long enough to be kept"


def page(spark, html, **options):
    rows = spark.createDataFrame([(1, "https://h.example/x", html)], "page_id bigint, url string, html string")
    return extract_pages(rows, "2025-01-01 00:00:00", **options).first()


@pytest.mark.parametrize(
    "body, content",
    [
        (f"<main>{LONG} main</main><article>{LONG} article</article>", f"{LONG} main"),
        (f"<article>{LONG} article</article><main>{LONG} main</main>", f"{LONG} main"),
        (f"<div id=content>{LONG} id</div>", f"{LONG} id"),
        (f"<div class='a content b'>{LONG} class</div>", f"{LONG} class"),
        (f"<div class='contents'>{LONG} none</div>", f"{LONG} none"),
        (f'<p>out</p><DIV class="x post-content"><div>{LONG}</div> in</DIV><p>out</p>', f"{LONG} in"),
        (f"<article>{LONG} <article>inner</article> tail</article> out", f"{LONG} inner tail"),
        (f"<main></main><article>{LONG}</article>", f"{LONG}"),
        (f"<main> </main><article>{LONG}</article>", ""),
        (f"<p>{LONG}</p><p>glued</p>", f"{LONG}glued"),
        (f"<nav>x<nav>y</nav>z</nav><p>{LONG}</p>", LONG),
        (f"<header>x<nav>y</nav>z</header><p>{LONG}</p><footer>f</footer><aside>s</aside>", LONG),
        (f"<NAV>x</NAV><p>{LONG}</p>", LONG),
        (f"<!-- <nav> --><p>{LONG}</p><!-- </p> -->", LONG),
        (f'<script>var t="</p><nav>";</script><style>p{{}}</style><p>{LONG}</p>', LONG),
        (f"<p>{LONG} 1 < 2 &amp; 3</p>", f"{LONG} 1 < 2 & 3"),
        (f"<meta id=content><p>{LONG}</p>", LONG),
        ("<p>short</p>", ""),
        ("<p>" + "x" * 20 + "</p>", ""),
        ("<p>" + "x" * 21 + "</p>", "x" * 21),
    ],
)
def test_content(spark, body, content):
    # A matched main without any text falls back to the whole body.
    if body.startswith("<main></main>"):
        content = LONG
    assert page(spark, f"<html><head><title>t</title></head><body>{body}</body></html>")["content"] == content


def test_page_without_body_is_kept_with_empty_content(spark):
    row = page(spark, "<html><head><title> T </title></head></html>")
    assert (row["title"], row["content"], row["word_count"], row["char_count"]) == ("T", "", 0, 0)


def test_failed_fetch_is_dropped(spark):
    assert page(spark, None) is None


@pytest.mark.parametrize(
    "head, title",
    [
        ("", ""),
        ("<title></title>", ""),
        ("<title>\n a &amp; b </title>", "a & b"),
        ("<header><title>hidden</title></header>", ""),
        ("<TITLE>up</TITLE>", "up"),
    ],
)
def test_title(spark, head, title):
    assert page(spark, f"<head>{head}</head><body></body>")["title"] == title


@pytest.mark.parametrize(
    "meta, value",
    [
        ('<meta name="description" content="a &lt; b">', "a < b"),
        ("<meta content='single' name='description'>", "single"),
        ("<meta charset=utf-8><META NAME=description CONTENT=bare>", "bare"),
        ('<meta name="Description" content="no">', ""),
        ('<meta name="description">', ""),
        ('<meta name="description" content="">', ""),
        ('<meta property="og:description" content="no">', ""),
    ],
)
def test_description(spark, meta, value):
    assert page(spark, f"<head>{meta}</head><body></body>")["description"] == value


@pytest.mark.parametrize(
    "raw, text",
    [
        ("a &amp b", "a & b"), ("&am", "&am"), ("&amp;lt;", "&lt;"), ("&ampx", "&x"), ("&#65;&#x42;", "AB"),
        ("&eacute;&Eacute;", "éÉ"), ("&#128512;", "😀"), ("&nosuch; &amp;", "&nosuch; &"), ("&#0;", "\ufffd"),
        ("&lt;&gt;&quot;&copy;&middot;", '<>"©·'), ("&", "&"), ("AT&T &eacute", "AT&T é"), ("&#xD800;", "\ufffd"),
    ],
)
def test_entities(one, raw, text):
    assert one(F.expr(H.decode_entities("t")), t=raw) == text


def test_own_selectors(spark):
    html = f"<body><article>{LONG} a</article><section class=story>{LONG} s</section></body>"
    assert page(spark, html, selectors=[".story"])["content"] == f"{LONG} s"


class Reader(HTMLParser):
    """Straightforward tree walk over the same rules."""

    SKIP = {"script", "style", "nav", "header", "footer", "aside"}

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.skipping, self.stack = [], []
        self.parts = {"article": [], "body": [], "title": []}
        self.closed = set()

    def handle_starttag(self, tag, attrs):
        if self.skipping or tag in self.SKIP:
            self.skipping.append(tag)
        elif tag in self.parts:
            self.stack.append(tag)

    def handle_endtag(self, tag):
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
        elif tag in self.stack:
            self.stack.remove(tag)
            self.closed.add(tag)

    def put(self, text):
        if not self.skipping:
            for tag in self.stack:
                if tag not in self.closed:
                    self.parts[tag].append(text)

    def handle_data(self, data):
        self.put(data)

    def handle_charref(self, name):
        self.put(chr(int(name[1:], 16) if name[0] in "xX" else int(name)))

    def handle_entityref(self, name):
        known = {"amp": "&", "copy": "©", "middot": "·", "quot": '"', "lt": "<", "gt": ">", "nbsp": "\xa0"}
        self.put(known.get(name, f"&{name}"))


def test_agrees_with_a_parser(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    ours = {r["page_id"]: r for r in extract_pages(pages, "2025-01-01 00:00:00").collect()}
    for row in pages.collect():
        reader = Reader()
        reader.feed(row["html"])
        reader.close()
        text = "".join(reader.parts["article"]) or "".join(reader.parts["body"])
        text = re.sub(r"\s+", " ", text).strip()
        assert ours[row["page_id"]]["content"] == (text if len(text) > 20 else "")
        assert ours[row["page_id"]]["title"] == "".join(reader.parts["title"]).strip()


def test_references_agree_with_the_standard_library(spark):
    import html
    from html.entities import html5

    texts = [f"a &{name} b" for name in sorted(html5)] + [f"&{name.rstrip(';')}x1;" for name in sorted(html5)]
    texts += [f"&#{n};" for n in (0, 1, 9, 11, 13, 31, 65, 127, 128, 146, 150, 159, 160, 55296, 64976, 65534, 128512, 1114111, 1114112, 99999999)]
    texts += ["&#x92;", "&#X0041", "&#x;", "&#;", "& ;", "&&amp;", "&bogus; &am", "it&apos;s &check; &lbrace;"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.expr(H.decode_entities("t")).alias("x"))
    wrong = [(r["t"], r["x"], html.unescape(r["t"])) for r in frame.collect() if r["x"] != html.unescape(r["t"])]
    assert not wrong, wrong[:5]
