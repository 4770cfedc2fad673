"""Corpus statistics; all aggregates combine per task before they shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import render as R
from corpusloom.functions import text as T
from corpusloom.operators.chunking import CHUNK_WORDS, MIN_CHUNK_CHARS, chunk_rows
from corpusloom.session import stage

# Fixed value: the source name of a document without one.
MISSING_SOURCE = "unknown"


def source_stats(documents: DataFrame, source: str = "source") -> DataFrame:
    """Documents per source and their share in percent."""
    counts = documents.groupBy(F.coalesce(F.col(source), F.lit(MISSING_SOURCE)).alias("source")).agg(
        F.count("*").alias("documents")
    )
    # A row a source: the total is theirs, and the documents are scanned once.
    counts = stage(counts, "source-counts")
    total = counts.agg(F.sum("documents").alias("n")).scalar()
    share = F.lit(100.0) * F.col("documents") / total
    return counts.withColumn("percentage", F.round(share, 6))


def corpus_totals(documents: DataFrame, text: str = "text") -> DataFrame:
    """Documents, words, characters and the integer average of words."""
    return documents.select(text).agg(
        F.count("*").alias("total_documents"),
        F.coalesce(F.sum(T.word_count(text)), F.lit(0)).alias("total_words"),
        F.coalesce(F.sum(T.char_count(text)), F.lit(0)).alias("total_chars"),
    ).withColumn("avg_words", T.floor_average("total_words", "total_documents"))


def file_stats(documents: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    measured = documents.select(source, text).select(
        F.col(source).alias("source"), T.word_count(text).alias("words"), T.char_count(text).alias("chars")
    )
    return measured.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("words").alias("total_words"),
        F.sum("chars").alias("total_chars"),
        F.round(F.avg("words"), 6).alias("avg_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
    )


def file_list(documents: DataFrame, source: str = "source") -> DataFrame:
    return documents.select(F.col(source).alias("source")).distinct().orderBy("source")


def ingest_summary(
    urls: DataFrame,
    pages_clean: DataFrame,
    size: int = CHUNK_WORDS,
    minimum_chars: int = MIN_CHUNK_CHARS,
) -> DataFrame:
    """One row for a run: pages kept of valid URLs, chunks, words.

    Chunk words leave out the dropped tails, page words do not. Chunks are
    counted inside the page row, so the run needs no explode.
    """
    chunked = chunk_rows(pages_clean.select("content", "word_count"), "content", size, minimum_chars)
    per_page = chunked.select(
        "word_count",
        F.size("chunks").alias("n_chunks"),
        F.aggregate("chunks", F.lit(0).cast("bigint"), lambda a, c: a + c["word_count"]).alias("chunk_words"),
    )
    totals = per_page.agg(
        F.count("*").alias("pages"),
        F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"),
        F.coalesce(F.sum("chunk_words"), F.lit(0)).alias("chunk_words"),
        F.coalesce(F.sum("word_count"), F.lit(0)).alias("page_words"),
    )
    valid = urls.agg(F.count_if(T.has_web_scheme("url")).alias("n")).scalar()
    return totals.select(
        "pages",
        valid.alias("valid_urls"),
        F.round(F.col("pages") / F.nullif(valid, F.lit(0)), 6).alias("processed_ratio"),
        "chunks",
        "chunk_words",
        "page_words",
        T.floor_average("page_words", "pages").alias("avg_words_per_page"),
    )


def page_bullets(pages_clean: DataFrame) -> DataFrame:
    """List entry of every page; ``page_id`` keeps the order."""
    return pages_clean.select("page_id", R.page_bullet("title", "url", "word_count").alias("line"))


def content_summary(chunks: DataFrame, source: str = "source", summaries: DataFrame | None = None) -> DataFrame:
    """Chunks per source and the name of its summary file, if there is one.

    ``summaries(source, summary_file)`` may hold several names; the smallest is shown.
    """
    counts = chunks.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("chunks"))
    if summaries is None:
        return counts.withColumn("summary_file", F.lit(None).cast("string"))
    named = summaries.groupBy("source").agg(F.min("summary_file").alias("summary_file"))
    return counts.join(named, "source", "full")
