"""Writers: chunk files, artifacts, summaries, indexes, results."""

from corpusloom.sinks.writers import (
    write_chunk_files,
    write_chunk_json,
    write_content_summary,
    write_corpus_text,
    write_index,
    write_index_runs,
    write_lines,
    write_pages_json,
    write_report,
    write_results,
    write_scrape_summary,
    write_table,
)

__all__ = [
    "write_chunk_files",
    "write_chunk_json",
    "write_content_summary",
    "write_corpus_text",
    "write_index",
    "write_index_runs",
    "write_lines",
    "write_pages_json",
    "write_report",
    "write_results",
    "write_scrape_summary",
    "write_table",
]
