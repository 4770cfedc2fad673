"""Declared schemas; no reader infers types on the hot path."""

from __future__ import annotations

PAGES_CLEAN = (
    "url string, title string, content string, description string, scraped_at timestamp, "
    "word_count bigint, char_count bigint, url_hash string, domain string"
)

WEB_CHUNKS = (
    "source string, chunk_id bigint, content string, plain_content string, title string, "
    "source_url string, domain string, scraped_at timestamp, word_count bigint, char_count bigint, "
    "chunk_index bigint, total_chunks_for_page bigint, file_path string"
)

# ``scraped_at`` of an exported artifact is an ISO string without a zone.
PAGES_JSON = PAGES_CLEAN.replace("scraped_at timestamp", "scraped_at string")
WEB_CHUNKS_JSON = WEB_CHUNKS.replace("source string, ", "", 1).replace(
    "scraped_at timestamp", "scraped_at string"
)

SEGMENT = "struct<segment_type:string,content:string>"

LAYOUT_CHUNKS = (
    "source string, chunk_id bigint, content string, token_count bigint, segment_types array<string>, "
    "has_tables boolean, segment_count bigint, file_path string"
)

PARSE_TASK = (
    "task_id string, status string, message string, created_at string, started_at string, "
    "finished_at string, expires_at string, task_url string, include_chunks boolean, "
    "configuration struct<chunk_processing:struct<ignore_headers_and_footers:boolean,target_length:bigint>,"
    "ocr_strategy:string,high_resolution:boolean,error_handling:string>, "
    "output struct<chunks:array<struct<chunk_id:string,chunk_length:bigint,embed:string,"
    f"segments:array<{SEGMENT}>>>,file_name:string,page_count:bigint,pdf_url:string>, "
    "_corrupt_record string"
)

EMBEDDINGS = "vec_id bigint, embedding array<float>, label int"

RUNS = (
    "run_id bigint, embedding_model string, search_algorithm string, llm_model string, chunk_size int, "
    "query string, retrieval_time double, generation_time double, total_time double, "
    "chunks_retrieved bigint, response_length bigint, relevance_scores array<double>, "
    "response_preview string, success boolean, error string"
)

INDEX_RUNS = (
    "input_order int, index_name string, index_type string, success boolean, error string, "
    "creation_time double, train_time double, add_time double, memory_usage_mb double, "
    "avg_search_time_ms double, min_search_time_ms double, max_search_time_ms double, "
    "std_search_time_ms double, num_vectors bigint, vector_dimension int"
)

ROBOTS_RULES = "host string, agent string, rule_order int, path_prefix string, allow boolean"
