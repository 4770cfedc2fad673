import pytest

from corpusloom.operators import stats as S

DOCS = [("a", "one two"), ("a", "x"), (None, "  "), ("b", "é é é")]


@pytest.fixture
def documents(spark):
    return spark.createDataFrame(DOCS, "source string, text string")


def test_source_stats(documents):
    got = {r["source"]: (r["documents"], r["percentage"]) for r in S.source_stats(documents).collect()}
    assert got == {"a": (2, 50.0), "unknown": (1, 25.0), "b": (1, 25.0)}


def test_totals(documents, spark):
    assert tuple(S.corpus_totals(documents).first()) == (4, 6, 15, 1)
    empty = spark.createDataFrame([], "source string, text string")
    assert tuple(S.corpus_totals(empty).first()) == (0, 0, 0, None)


def test_file_stats_and_list(documents):
    got = {r["source"]: tuple(r)[1:] for r in S.file_stats(documents).collect()}
    assert got["a"] == (2, 3, 8, 1.5, 1, 2)
    assert [r["source"] for r in S.file_list(documents).collect()] == [None, "a", "b"]


def test_ingest_summary(spark):
    urls = spark.createDataFrame([("http://a",), ("https://b",), ("ftp://c",), ("http://d",)], "url string")
    text = "word " * 1005
    pages = spark.createDataFrame([(text.strip(), 1005), ("", 0)], "content string, word_count bigint")
    row = S.ingest_summary(urls, pages).first()
    assert (row["pages"], row["valid_urls"], row["processed_ratio"]) == (2, 3, round(2 / 3, 6))
    assert (row["chunks"], row["chunk_words"], row["page_words"], row["avg_words_per_page"]) == (1, 1000, 1005, 502)


def test_content_summary(spark, documents):
    names = spark.createDataFrame([("a", "z_summary.md"), ("a", "summary.md"), ("w", "s.md")], "source string, summary_file string")
    got = {r["source"]: (r["chunks"], r["summary_file"]) for r in S.content_summary(documents.na.drop(), summaries=names).collect()}
    assert got == {"a": (2, "summary.md"), "b": (1, None), "w": (None, "s.md")}
