"""Structured Streaming jobs: page dedup, page versions, thread logs."""

from corpusloom.streaming.pages import dedup_pages, read_latest, stream_table, upsert_pages
from corpusloom.streaming.threads import append_threads, thread_log, thread_sizes

__all__ = [
    "append_threads",
    "dedup_pages",
    "read_latest",
    "stream_table",
    "thread_log",
    "thread_sizes",
    "upsert_pages",
]
