"""Streaming queries: a table is read as a stream to its end into the shared
folder, and the result table is read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import fresh_path
from corpusloom.streaming import append_threads, dedup_pages, read_latest, stream_table, thread_log, upsert_pages
from corpusloom.streaming.pages import append_stream

#: What tells the pages of the table apart: some share a URL.
_PAGE = ["page_id", "url"]
_FIRST, _SECOND = "2025-01-01 00:00:00", "2025-02-01 00:00:00"


def _finish(running):
    running.awaitTermination()
    if running.exception():
        raise running.exception()


@query("stream_dedup_pages", "SELECT DISTINCT page_id, url, html FROM pages")
def stream_dedup_pages(spark, folder):
    """Every page arrives twice and is stored once."""
    pages = stream_table(spark, folder, "pages.parquet")
    twice = pages.unionByName(stream_table(spark, folder, "pages.parquet"))
    path = fresh_path(spark, "stream-pages")
    _finish(append_stream(dedup_pages(twice, _PAGE), f"{path}/table", f"{path}/checkpoint"))
    return spark.read.parquet(f"{path}/table")


@query("stream_upsert_pages", f"SELECT page_id, url, '{_SECOND}' AS scraped_at, html FROM pages")
def stream_upsert_pages(spark, folder):
    """Two crawls of every page; the later one is what is read."""

    def crawl(at):
        return stream_table(spark, folder, "pages.parquet").withColumn("scraped_at", F.lit(at).cast("timestamp"))

    path = fresh_path(spark, "stream-versions")
    _finish(upsert_pages(crawl(_FIRST).unionByName(crawl(_SECOND)), f"{path}/table", f"{path}/checkpoint", _PAGE))
    return read_latest(spark, f"{path}/table").select(
        "page_id", "url", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss").alias("scraped_at"), "html"
    )


@query("stream_threads", "SELECT conv_id, turn, role, text FROM conversations")
def stream_threads(spark, folder):
    """Messages are appended to the thread log and read back."""
    path = fresh_path(spark, "stream-threads")
    messages = stream_table(spark, folder, "conversations.parquet")
    _finish(append_threads(messages, f"{path}/table", f"{path}/checkpoint"))
    return thread_log(spark, f"{path}/table").select("conv_id", "turn", "role", "text")
