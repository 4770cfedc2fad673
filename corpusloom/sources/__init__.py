"""Readers: chunk corpora, URL lists, page tables, artifacts, indexes."""

from corpusloom.sources.readers import (
    document_files,
    failed_tasks,
    inline_urls,
    layout_rows,
    load_chunk_corpus,
    load_pages_json,
    load_web_chunks_json,
    read_chunk_corpus,
    read_chunk_export,
    read_index,
    read_pages,
    read_pages_json,
    read_parse_tasks,
    read_table,
    read_urls,
    read_web_chunks_json,
    sources_without_chunks,
    summary_files,
    unreadable_chunks,
)

__all__ = [
    "document_files",
    "failed_tasks",
    "inline_urls",
    "layout_rows",
    "load_chunk_corpus",
    "load_pages_json",
    "load_web_chunks_json",
    "read_chunk_corpus",
    "read_chunk_export",
    "read_index",
    "read_pages",
    "read_pages_json",
    "read_parse_tasks",
    "read_table",
    "read_urls",
    "read_web_chunks_json",
    "sources_without_chunks",
    "summary_files",
    "unreadable_chunks",
]
