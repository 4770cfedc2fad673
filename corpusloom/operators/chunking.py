"""Fixed-size word chunks, dense chunk ids and greedy packing of segments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import render as R
from corpusloom.functions import text as T
from corpusloom.operators.numbering import running_start
from corpusloom.session import spread, stage

# Words per chunk, shortest chunk kept, token budget of a packed
# chunk, and how segment types are counted.
CHUNK_WORDS = 1000
MIN_CHUNK_CHARS = 100
TOKEN_BUDGET = 1024
TABLE_TYPE = "Table"
TEXT_TYPES = ("Text", "Title", "SectionHeader", "ListItem")
MARGIN_TYPES = ("PageHeader", "PageFooter")


def word_chunks(text: Column | str, size: int = CHUNK_WORDS, minimum_chars: int = MIN_CHUNK_CHARS) -> Column:
    """Struct of ``chunks`` (``chunk_index, plain_content, word_count``) and ``total``.

    A chunk shorter than ``minimum_chars`` is dropped with its text; the index
    and the total still count it.
    """

    def cut(words: Column) -> Column:
        count = F.size(words)

        def piece(start: Column) -> Column:
            return F.struct(
                F.call_function("div", start, F.lit(size)).alias("chunk_index"),
                F.array_join(F.slice(words, start + 1, F.lit(size)), " ").alias("plain_content"),
                F.least(F.lit(size), count - start).cast("bigint").alias("word_count"),
            )

        starts = F.when(count > 0, F.sequence(F.lit(0), count - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
        kept = F.filter(F.transform(starts, piece), lambda c: F.length(c["plain_content"]) >= minimum_chars)
        total = F.call_function("div", count + (size - 1), F.lit(size))
        return F.struct(kept.alias("chunks"), total.alias("total"))

    return T.bind(T.bind(T.squash(text), T.words), cut)


def chunk_rows(
    df: DataFrame,
    text_col: str,
    size: int = CHUNK_WORDS,
    minimum_chars: int = MIN_CHUNK_CHARS,
) -> DataFrame:
    """Add ``chunks`` (kept ones only) and ``total_chunks`` to every row."""
    cut = df.withColumn("_cut", word_chunks(text_col, size, minimum_chars))
    return cut.withColumn("chunks", F.col("_cut.chunks")).withColumn("total_chunks", F.col("_cut.total")).drop("_cut")


def explode_chunks(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per kept chunk of :func:`chunk_rows` output."""
    chunk = F.col("chunk")
    return T.rows_of(df, [*keep, "total_chunks"], "chunks", "chunk").select(
        *keep,
        chunk["chunk_index"].alias("chunk_index"),
        chunk["plain_content"].alias("plain_content"),
        chunk["word_count"].alias("word_count"),
        F.length(chunk["plain_content"]).cast("bigint").alias("char_count"),
        F.col("total_chunks").alias("total_chunks_for_page"),
    )


def chunk_pages(
    pages_clean: DataFrame,
    source: Column | str = "domain",
    size: int = CHUNK_WORDS,
    minimum_chars: int = MIN_CHUNK_CHARS,
) -> DataFrame:
    """Web chunks with ids that are dense per source in page order.

    The chunked pages are staged once. Ids come from a narrow job over
    (source, page, number of chunks); the texts shuffle once, on a row key that
    the staged table fixes.
    """
    chunked = stage(
        chunk_rows(
            pages_clean.select(
                T.col(source).alias("source"), "page_id", "url", "title", "domain", "scraped_at", "content"
            ),
            "content",
            size,
            minimum_chars,
        )
        .drop("content")
        .withColumn("row_id", F.monotonically_increasing_id()),
        "chunked-pages",
    )
    counts = chunked.filter(F.size("chunks") > 0).select(
        "source", "page_id", "row_id", F.size("chunks").alias("kept")
    )
    starts = running_start(counts, ["page_id", "row_id"], ["source"], "kept", "start").select("row_id", "start")
    numbered = chunked.join(starts, "row_id").select(
        "source", "start", "url", "title", "domain", "scraped_at", "total_chunks",
        F.posexplode("chunks").alias("offset", "chunk"),
    )
    chunk_id = F.col("start") + F.col("offset")
    body = F.col("chunk")["plain_content"]
    return numbered.select(
        "source",
        chunk_id.alias("chunk_id"),
        R.chunk_markdown("title", "url", "domain", T.iso_timestamp("scraped_at"), body).alias("content"),
        body.alias("plain_content"),
        "title",
        F.col("url").alias("source_url"),
        "domain",
        "scraped_at",
        F.col("chunk")["word_count"].alias("word_count"),
        F.length(body).cast("bigint").alias("char_count"),
        F.col("chunk")["chunk_index"].alias("chunk_index"),
        F.col("total_chunks").alias("total_chunks_for_page"),
        R.chunk_path(chunk_id).alias("file_path"),
    )


def chunk_documents(documents: DataFrame, size: int = CHUNK_WORDS, minimum_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Word chunks of a document table; a projection and an explode, no shuffle."""
    rows = spread(documents.select("doc_id", "source", "text"), "doc_id")
    chunked = chunk_rows(rows, "text", size, minimum_chars)
    return explode_chunks(chunked, ["doc_id", "source"])


def whitespace_tokens(segment: Column) -> Column:
    """Default token count of a segment: its whitespace-separated words."""
    return T.word_count(segment).cast("int")


def tokenizer_counts(load: Callable[[], Callable[[list[str]], list[int]]]) -> Callable[[Column], Column]:
    """Token counts by a tokenizer: ``load()`` runs once a worker and returns a function from texts to their counts.

    The segments of a batch of rows, whatever row they are of, go to it together; a null segment counts as empty.
    """
    held: list = []

    @F.arrow_udf("array<int>")
    def count(rows: pa.Array) -> pa.Array:
        if not held:
            held.append(load())
        texts = rows.flatten().fill_null("").to_pylist()
        sizes = pa.array(held[0](texts) if texts else [], pa.int32())
        lengths = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), sizes, mask=rows.is_null())

    return count


def pack_segments(
    df: DataFrame,
    keys: list[str],
    segments: Column | str,
    budget: int = TOKEN_BUDGET,
    tokens: Callable[[Column], Column] = whitespace_tokens,
    separator: str = "\n",
    counts: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Pack consecutive segments greedily into chunks of at most ``budget`` tokens.

    ``tokens`` counts a segment by an expression; ``counts``, if given, an array
    of segments at once, as :func:`tokenizer_counts` does with a real tokenizer.
    A segment larger than the budget stands alone. Joining the chunks with the
    separator gives the text back. Only the token counts of a row leave the
    JVM; the chunk borders come back as offsets.
    """

    @F.pandas_udf("array<int>")
    def chunk_starts(counts: pd.Series) -> pd.Series:
        def borders(sizes):
            ends = np.cumsum(sizes)
            starts, at, used = [], 0, 0
            while at < len(ends):
                starts.append(at)
                stop = int(np.searchsorted(ends, used + budget, side="right"))
                at = max(stop, at + 1)
                used = int(ends[at - 1])
            return starts

        return pd.Series([borders(c) if c is not None else None for c in counts])
    held = spread(df, keys[0]).select(*keys, T.col(segments).alias("_segments")).filter(F.size("_segments") > 0)
    held = held.withColumn("_tokens", counts(F.col("_segments")) if counts else F.transform("_segments", tokens))
    held = held.withColumn("_starts", chunk_starts("_tokens"))
    held = held.withColumn("_stops", F.concat(F.slice("_starts", F.lit(2), F.size("_starts")), F.array(F.size("_segments"))))
    spans = F.arrays_zip("_starts", "_stops")
    held = T.rows_of(held, [*keys, "_segments", "_tokens"], spans, "_span", "chunk_id")
    start, length = F.col("_span._starts"), F.col("_span._stops") - F.col("_span._starts")
    total = F.aggregate(F.slice("_tokens", start + 1, length), F.lit(0), lambda a, x: a + x)
    return held.select(
        *keys,
        F.col("chunk_id").cast("bigint").alias("chunk_id"),
        F.array_join(F.slice("_segments", start + 1, length), separator).alias("content"),
        total.cast("bigint").alias("token_count"),
        length.cast("bigint").alias("segment_count"),
    )


def line_segments(text: Column | str) -> Column:
    """Typed segments of a plain-text document, one per line that is not blank."""
    lines = F.filter(F.split(T.col(text), "\n"), lambda line: ~T.is_blank(line))

    def typed(line: Column, position: Column) -> Column:
        kind = (
            F.when(line.contains(" | "), F.lit(TABLE_TYPE))
            .when(line.rlike(r"\A#{1,6} "), F.lit("SectionHeader"))
            .when(line.rlike(r"\A(?:[-*•·] |\d+[.)] )"), F.lit("ListItem"))
            .when(line.rlike(r"\APage \d+"), F.lit("PageFooter"))
            .when((position == 0) & (F.length(line) <= 60), F.lit("Title"))
            .otherwise(F.lit("Text"))
        )
        return F.struct(kind.alias("segment_type"), line.alias("content"))

    return F.transform(lines, typed)


def without_margins(segments: Column | str) -> Column:
    """Segments that are neither page headers nor page footers."""
    return F.filter(T.col(segments), lambda s: ~s["segment_type"].isin(*MARGIN_TYPES))


def layout_chunks(chunks: DataFrame) -> DataFrame:
    """Chunk records from ``source, chunk_id, embed, segments``."""
    return chunks.select(
        "source",
        "chunk_id",
        F.col("embed").alias("content"),
        T.word_count("embed").alias("token_count"),
        F.transform("segments", lambda s: s["segment_type"]).alias("segment_types"),
        F.exists("segments", lambda s: s["segment_type"] == TABLE_TYPE).alias("has_tables"),
        F.size("segments").cast("bigint").alias("segment_count"),
        R.chunk_path("chunk_id").alias("file_path"),
    )


def segment_counts(chunks: DataFrame, group: list[str], segments: str = "segments") -> DataFrame:
    """Text and table segments per group; other types count in neither."""
    rows = T.rows_of(chunks, group, segments, "segment")
    kind = F.col("segment.segment_type")
    return rows.groupBy(*group).agg(
        F.count_if(kind.isin(*TEXT_TYPES)).alias("text_segments"),
        F.count_if(kind == TABLE_TYPE).alias("table_segments"),
    )
