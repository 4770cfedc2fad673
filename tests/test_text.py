import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import render as R
from corpusloom.functions import text as T


@pytest.mark.parametrize(
    "raw",
    ["", "   ", "\n\n", "a b", " a\u0085\x1cb ", "x\t\ty  z　", " one two", "plain", "\x0bv\x0c"],
)
def test_squash_words_and_strip_follow_python(one, raw):
    assert one(T.squash("t"), t=raw) == " ".join(raw.split())
    assert one(T.word_count("t"), t=raw) == len(raw.split())
    assert one(T.words(T.squash("t")), t=raw) == raw.split()
    assert one(T.strip("t"), t=raw) == raw.strip()
    assert one(T.is_blank("t"), t=raw) == (raw.strip() == "")


def test_char_count_is_code_points(one):
    assert one(T.char_count("t"), t="😀é") == 2


@pytest.mark.parametrize("size, kept", [(20, False), (21, True)])
def test_substantial_border(one, size, kept):
    assert one(T.substantial("t"), t="x" * size) == ("x" * size if kept else "")


def test_url_hash_known_answer(one):
    assert one(T.url_hash("u"), u="https://www.ksrevenue.gov/dovindex.html") == "fc17a449f21e"


@pytest.mark.parametrize(
    "url, domain, target",
    [
        ("https://user:pw@Host.example:8080/a?b#c", "user:pw@Host.example:8080", "/a?b"),
        ("http://a_b.com", "a_b.com", "/"),
        ("http:///x", "", "/x"),
        ("https://h.example/p?q=a|b", "h.example", "/p?q=a|b"),
        ("no url", "", "/"),
    ],
)
def test_url_parts(one, url, domain, target):
    assert one(T.url_domain("u"), u=url) == domain
    assert one(T.url_target("u"), u=url) == target


@pytest.mark.parametrize(
    "url, ok", [("http://a", True), ("https://a", True), ("HTTP://a", False), ("ftp://a", False), ("a", False)]
)
def test_scheme_is_case_sensitive(one, url, ok):
    assert one(T.has_web_scheme("u"), u=url) is ok


@pytest.mark.parametrize("size", [149, 150, 151, 199, 200, 201])
def test_previews(one, size):
    text = ("ab\n" * 100)[:size]
    assert one(T.preview("t"), t=text) == text[:200].replace("\n", " ") + "..."
    for limit in (150, 200):
        expected = text[:limit] + "..." if len(text) > limit else text
        assert one(T.short_preview("t", limit), t=text) == expected


@pytest.mark.parametrize("path, stem", [("/a/b c.pdf", "b c"), ("x.tar.gz", "x.tar"), ("/d/noext", "noext")])
def test_file_stem(one, path, stem):
    assert one(T.file_stem("p"), p=path) == stem


def test_floor_average_and_lookup(one):
    assert one(T.floor_average("a", "b"), a=7, b=2) == 3
    assert one(T.floor_average("a", "b"), a=7, b=0) is None
    assert one(T.lookup(F.create_map(F.lit("k"), F.lit("v")), "k", "d")) == "v"
    assert one(T.lookup(F.create_map(F.lit("k"), F.lit("v")), "z", "d")) == "d"
    assert one(T.lookup(F.lit(None).cast("map<string,string>"), "z", "d")) == "d"


def test_iso_timestamp(one):
    assert one(T.iso_timestamp("t"), t=dt.datetime(2025, 7, 2, 9, 15, 40, 984467)) == "2025-07-02T09:15:40.984467"
    assert one(T.iso_timestamp("t"), t=dt.datetime(2025, 7, 2)) == "2025-07-02T00:00:00"


def test_megabytes(one):
    assert one(T.megabytes("n"), n=3 * 1024 * 1024) == 3.0


def test_chunk_markdown(one):
    got = one(R.chunk_markdown("t", "u", "d", "s", "b"), t="T", u="U", d="D", s="S", b="B")
    assert got.split("\n") == ["# T", "", "**Source URL:** U", "**Domain:** D", "**Scraped:** S", "", "---", "", "B", ""]


def test_prompt_and_block(one):
    assert one(R.prompt("c", "q"), c="C", q="Q").split("\n") == [
        "Based on the following context, answer the question:", "", "Context:", "C", "", "Question: Q", "", "Answer:",
    ]
    assert one(R.context_block("r", F.lit(None), "t"), r=2, t=" x \n") == "[Document 2] (Source: Unknown):\nx"
