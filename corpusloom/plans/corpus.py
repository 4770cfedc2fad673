"""Queries over documents and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, conversations, evaluation, stats
from corpusloom.operators.embed import HashedTfIdf
from corpusloom.operators.embed import embed_documents as embed
from corpusloom.plans.registry import PAGES_CLEAN, chunks_of, query, squash, table, word_count
from corpusloom.plans.web import clean

_DOC_CHUNKS = chunks_of("documents", "doc_id, source", "text")


@query(
    "normalize_text",
    f"""SELECT doc_id, {squash("text")} AS normalized,
      CASE WHEN length({squash("text")}) > 20 THEN {squash("text")} ELSE '' END AS cleaned FROM documents""",
)
def normalize_text(spark, folder):
    flat = table(spark, folder, "documents").select("doc_id", T.squash("text").alias("normalized"))
    return flat.withColumn("cleaned", T.substantial("normalized"))


@query(
    "text_stats",
    f"SELECT doc_id, {word_count('text')} AS word_count, length(text)::BIGINT AS char_count FROM documents",
)
def text_stats(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", T.word_count("text").alias("word_count"), T.char_count("text").alias("char_count"))


@query(
    "previews",
    """SELECT doc_id, concat(replace(substr(text, 1, 200), chr(10), ' '), '...') AS hit_preview,
      CASE WHEN length(text) > 200 THEN concat(substr(text, 1, 200), '...') ELSE text END AS answer_preview,
      CASE WHEN length(text) > 150 THEN concat(substr(text, 1, 150), '...') ELSE text END AS short_preview
      FROM documents""",
)
def previews(spark, folder):
    return table(spark, folder, "documents").select(
        "doc_id",
        T.preview("text").alias("hit_preview"),
        T.short_preview("text", 200).alias("answer_preview"),
        T.short_preview("text", 150).alias("short_preview"),
    )


@query(
    "chunk_documents",
    f"""WITH {_DOC_CHUNKS} SELECT doc_id, source, chunk_index, plain_content, word_count, char_count,
      total_chunks_for_page FROM kept""",
)
def chunk_documents(spark, folder):
    return chunking.chunk_documents(table(spark, folder, "documents"))


@query(
    "pack_segments",
    f"""WITH RECURSIVE cut AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
    seg AS MATERIALIZED (
      SELECT doc_id, i, ls[i] AS line, {word_count("ls[i]")} AS n FROM cut, unnest(range(1, len(ls) + 1)) AS u(i)),
    packed AS (
      SELECT doc_id, i, 0 AS chunk_id, n AS used FROM seg WHERE i = 1
      UNION ALL
      SELECT s.doc_id, s.i, CASE WHEN used + s.n > 1024 THEN chunk_id + 1 ELSE chunk_id END,
             CASE WHEN used + s.n > 1024 THEN s.n ELSE used + s.n END
      FROM packed p JOIN seg s ON s.doc_id = p.doc_id AND s.i = p.i + 1)
    SELECT doc_id, chunk_id::BIGINT AS chunk_id, string_agg(line, chr(10) ORDER BY i) AS content,
           sum(n)::BIGINT AS token_count, count(*) AS segment_count
    FROM packed JOIN seg USING (doc_id, i) GROUP BY doc_id, chunk_id""",
)
def pack_segments(spark, folder):
    rows = table(spark, folder, "documents")
    return chunking.pack_segments(rows, ["doc_id"], F.split("text", "\n"))


_SEGMENTS = rf"""
    raw AS (
      SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
        generate_subscripts(string_split(text, chr(10)), 1) AS j FROM documents),
    lines AS (
      SELECT doc_id, source, line, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i
      FROM raw WHERE {squash("line")} <> ''),
    segments AS (
      SELECT doc_id, source, i, line,
        CASE WHEN contains(line, ' | ') THEN 'Table'
             WHEN regexp_matches(line, '\A#{{1,6}} ') THEN 'SectionHeader'
             WHEN regexp_matches(line, '\A(?:[-*•·] |\d+[.)] )') THEN 'ListItem'
             WHEN regexp_matches(line, '\APage \d+') THEN 'PageFooter'
             WHEN i = 1 AND length(line) <= 60 THEN 'Title' ELSE 'Text' END AS segment_type
      FROM lines)
"""


def _segmented(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", "source", "text", chunking.without_margins(chunking.line_segments("text")).alias("segments"))


@query(
    "segment_counts",
    f"""WITH {_SEGMENTS}
    SELECT source, count(*) FILTER (WHERE segment_type IN ('Text', 'Title', 'SectionHeader', 'ListItem')) AS text_segments,
      count(*) FILTER (WHERE segment_type = 'Table') AS table_segments
    FROM segments WHERE segment_type NOT IN ('PageHeader', 'PageFooter') GROUP BY source""",
)
def segment_counts(spark, folder):
    return chunking.segment_counts(_segmented(spark, folder), ["source"])


@query(
    "layout_chunks",
    f"""WITH {_SEGMENTS}, kept AS (SELECT * FROM segments WHERE segment_type NOT IN ('PageHeader', 'PageFooter')),
    folded AS (
      SELECT doc_id, string_agg(segment_type, ',' ORDER BY i) AS segment_types,
        bool_or(segment_type = 'Table') AS has_tables, count(*) AS segment_count FROM kept GROUP BY doc_id)
    SELECT d.source, d.doc_id AS chunk_id, d.text AS content, {word_count("d.text")} AS token_count,
      coalesce(f.segment_types, '') AS segment_types, coalesce(f.has_tables, false) AS has_tables,
      coalesce(f.segment_count, 0) AS segment_count, concat('chunks/chunk_', d.doc_id, '.md') AS file_path
    FROM documents d LEFT JOIN folded f ON d.doc_id = f.doc_id""",
)
def layout_chunks(spark, folder):
    rows = _segmented(spark, folder).select("source", F.col("doc_id").alias("chunk_id"), F.col("text").alias("embed"), "segments")
    return chunking.layout_chunks(rows).withColumn("segment_types", F.array_join("segment_types", ","))


@query(
    "source_stats",
    """SELECT coalesce(source, 'unknown') AS source, count(*) AS documents,
      round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (), 6) AS percentage FROM documents GROUP BY 1""",
)
def source_stats(spark, folder):
    return stats.source_stats(table(spark, folder, "documents"))


@query(
    "corpus_totals",
    f"""WITH m AS (SELECT {word_count("text")} AS w, length(text) AS c FROM documents)
    SELECT count(*) AS total_documents, sum(w)::BIGINT AS total_words, sum(c)::BIGINT AS total_chars,
      (sum(w) // count(*))::BIGINT AS avg_words FROM m""",
)
def corpus_totals(spark, folder):
    return stats.corpus_totals(table(spark, folder, "documents"))


@query(
    "file_stats",
    f"""WITH m AS (SELECT source, {word_count("text")} AS w, length(text) AS c FROM documents)
    SELECT source, count(*) AS documents, sum(w)::BIGINT AS total_words, sum(c)::BIGINT AS total_chars,
      round(avg(w), 6) AS avg_words, min(w) AS min_words, max(w) AS max_words FROM m GROUP BY source""",
)
def file_stats(spark, folder):
    return stats.file_stats(table(spark, folder, "documents"))


@query("file_list", "SELECT DISTINCT source FROM documents ORDER BY source")
def file_list(spark, folder):
    return stats.file_list(table(spark, folder, "documents"))


@query("content_summary", f"WITH {_DOC_CHUNKS} SELECT source, count(*) AS chunks FROM kept GROUP BY source")
def content_summary(spark, folder):
    chunks = chunking.chunk_documents(table(spark, folder, "documents"))
    return stats.content_summary(chunks).drop("summary_file")


@query("sample_first_n", "SELECT doc_id, source, text FROM documents ORDER BY doc_id LIMIT 50")
def sample_first_n(spark, folder):
    return evaluation.sample_first(table(spark, folder, "documents").select("doc_id", "source", "text"), "doc_id", 50)


@query(
    "unified_corpus",
    f"""WITH {PAGES_CLEAN}
    SELECT concat('document-', doc_id) AS chunk_key, text AS content, 'document' AS source_type,
      source AS content_source, '' AS title FROM documents
    UNION ALL
    SELECT concat('page-', page_id), content, 'web', domain, title FROM pages_clean""",
)
def unified_corpus(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.concat(F.lit("document-"), F.col("doc_id").cast("string")).alias("chunk_key"),
        F.col("text").alias("content"),
        F.lit("document").alias("source_type"),
        F.col("source").alias("content_source"),
    )
    web = clean(spark, folder).select(
        F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("chunk_key"),
        "content",
        F.lit("web").alias("source_type"),
        F.col("domain").alias("content_source"),
        "title",
    )
    return documents.unionByName(web, allowMissingColumns=True).fillna("", ["title"])


@query("embed_documents")
def embed_documents(spark, folder):
    rows = table(spark, folder, "documents").select("doc_id", "text")
    return embed(rows, HashedTfIdf.fit(rows, "text")).select("doc_id", "embedding")


@query(
    "conversation_tail",
    """WITH last AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back,
        count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id, turn, (least(n, 10) - back + 1)::INTEGER AS position, role,
      concat(CASE WHEN role IN ('human', 'user') THEN '🧑 ' ELSE '🤖 ' END,
             upper(substr(role, 1, 1)), lower(substr(role, 2)), ': ', substr(text, 1, 200), '...') AS line
    FROM last WHERE back <= 10""",
)
def conversation_tail(spark, folder):
    return conversations.tail(table(spark, folder, "conversations"))


@query(
    "conversation_pairs",
    f"""WITH kept AS (SELECT * FROM conversations WHERE role <> 'user' OR {squash("text")} <> ''),
    following AS (
      SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
      FROM kept WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
    SELECT conv_id, turn, text AS message, next_text AS response FROM following
    WHERE role = 'user' AND next_role = 'assistant'""",
)
def conversation_pairs(spark, folder):
    return conversations.pairs(table(spark, folder, "conversations"))
