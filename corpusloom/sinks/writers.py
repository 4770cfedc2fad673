"""Distributed writers. Texts of any size are written as ordered lines in
range-sorted part files, so no task gathers a whole report or source."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import evaluation as E
from corpusloom.operators import stats


def write_table(chunks: DataFrame, path: str, partition: str = "source") -> None:
    """The canonical form of chunks: parquet by source.

    Rebalancing gathers a small source into few files and lets the adaptive
    planner split a big one over many tasks.
    """
    chunks.hint("rebalance", partition).write.mode("overwrite").partitionBy(partition).parquet(path)


def write_chunk_files(chunks: DataFrame, path: str) -> None:
    """Export of one text file per chunk under ``source=…/chunk_id=…``.

    Every file ends with one line break, which the text writer adds.
    """
    body = F.regexp_replace("content", r"\n\z", "")
    rows = chunks.select("source", "chunk_id", body.alias("content"))
    rows.write.mode("overwrite").partitionBy("source", "chunk_id").text(path)


def _plain_timestamps(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[T.iso_timestamp(c).alias(c) if kinds[c] == "timestamp" else F.col(c) for c in df.columns])


def write_chunk_json(chunks: DataFrame, path: str) -> None:
    """Chunk metadata as JSON lines by source; characters stay as they are."""
    _plain_timestamps(chunks).write.mode("overwrite").partitionBy("source").option(
        "ignoreNullFields", False
    ).json(path)


def write_pages_json(pages_clean: DataFrame, path: str) -> None:
    _plain_timestamps(pages_clean).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_lines(lines: DataFrame, order: list[str], path: str, line: str = "line") -> None:
    """Text lines in order: part files follow each other in name order."""
    lines.orderBy(*order).select(line).write.mode("overwrite").text(path)


def scrape_summary_lines(pages_clean: DataFrame, chunks: DataFrame, date: str) -> DataFrame:
    """``section, position, line`` of a scrape summary."""
    pages = pages_clean.agg(F.count("*").alias("n")).scalar()
    totals = chunks.agg(
        F.count("*").alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).alias("words")
    )
    head = totals.select(
        F.lit(0).alias("section"),
        F.posexplode(
            F.array(
                F.lit("# Web Scraping Summary"),
                F.lit(""),
                F.lit(f"**Scraping Date:** {date}"),
                F.concat(F.lit("**Total Pages Scraped:** "), pages.cast("string")),
                F.concat(F.lit("**Total Chunks Created:** "), F.col("chunks").cast("string")),
                F.concat(F.lit("**Total Word Count:** "), F.col("words").cast("string")),
                F.lit(""),
                F.lit("## Scraped URLs:"),
                F.lit(""),
            )
        ).alias("position", "line"),
    )
    body = stats.page_bullets(pages_clean).select(
        F.lit(1).alias("section"), F.col("page_id").alias("position"), "line"
    )
    return head.withColumn("position", F.col("position").cast("bigint")).unionByName(body)


def write_scrape_summary(pages_clean: DataFrame, chunks: DataFrame, path: str, date: str) -> None:
    write_lines(scrape_summary_lines(pages_clean, chunks, date), ["section", "position"], path)


def write_content_summary(summary: DataFrame, path: str, index_name: str, date: str) -> None:
    """Per source: heading, number of chunks, name of the summary file."""
    spark = summary.sparkSession
    head = spark.createDataFrame(
        [
            (0, "", at, line)
            for at, line in enumerate(
                [
                    "# RAG System Content Summary", "", f"**Generated:** {date}",
                    f"**Index Name:** {index_name}", "", "## Content Sources", "",
                ]
            )
        ],
        "section int, source string, position int, line string",
    )
    lines = F.array_compact(
        F.array(
            F.concat(F.lit("### "), F.col("source")),
            F.concat(F.lit("- **Chunks:** "), F.col("chunks").cast("string")),
            F.concat(F.lit("- **Summary:** "), F.col("summary_file")),
            F.lit(""),
        )
    )
    body = summary.select(F.lit(1).alias("section"), "source", F.posexplode(lines).alias("position", "line"))
    write_lines(head.unionByName(body), ["section", "source", "position"], path)


def write_index(vectors: DataFrame, documents: DataFrame, path: str) -> None:
    """Vectors and documents as parquet; a clustered index is laid out by cell."""
    writer = vectors.write.mode("overwrite")
    if "cell" in vectors.columns:
        writer = writer.partitionBy("cell")
    writer.parquet(f"{path}/vectors")
    documents.write.mode("overwrite").parquet(f"{path}/docs")


def write_results(runs: DataFrame, path: str, prefix: str | None = None) -> None:
    """Raw rows as JSON, successful rows as CSV, the analysis tables as JSON.

    Without a prefix the names carry the time of the call.
    """
    prefix = prefix or datetime.now().strftime("performance_test_%Y%m%d_%H%M%S")
    base = f"{path}/{prefix}"
    runs.write.mode("overwrite").option("ignoreNullFields", False).json(f"{base}_results.json")
    kinds = dict(runs.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c) for c in runs.columns]
    runs.filter("success").select(*flat).write.mode("overwrite").option("header", True).csv(f"{base}_results.csv")
    for name, table in {
        "summary": E.run_summary(runs),
        "best": E.best_configs(runs),
        "by_dimension": E.runs_by_dimension(runs),
    }.items():
        table.write.mode("overwrite").json(f"{base}_analysis/{name}")
    report = E.full_report_lines(runs, datetime.now().isoformat())
    write_lines(report, ["section", "line_no"], f"{base}_summary")


def write_index_runs(runs: DataFrame, path: str, prefix: str | None = None) -> None:
    """All runs of an index comparison, failures too, as JSON, and their ranking beside them.

    Without a prefix the name carries the time of the call.
    """
    prefix = prefix or datetime.now().strftime("vector_benchmark_%Y%m%d_%H%M%S")
    runs.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/{prefix}.json")
    E.index_ranking(runs.filter("success")).write.mode("overwrite").json(f"{path}/{prefix}_ranking")


def write_report(runs: DataFrame, path: str) -> None:
    write_lines(E.report_lines(runs), ["section", "line_no"], path)


def write_corpus_text(chunks: DataFrame, path: str) -> None:
    """All sources in one ordered text, and all chunks with their source.

    ``unified_documents`` has a heading per source; ``unified_chunks`` a
    heading per chunk.
    """
    order = ["source", "chunk_id", "position"]
    headings = chunks.select("source").distinct().select(
        "source", F.lit(-1).cast("bigint").alias("chunk_id"), F.lit(0).alias("position"),
        F.concat(F.lit("# "), F.col("source")).alias("line"),
    )
    bodies = chunks.select("source", "chunk_id", F.lit(0).alias("position"), F.col("content").alias("line"))
    write_lines(headings.unionByName(bodies), order, f"{path}/unified_documents")
    labelled = chunks.select(
        "source",
        "chunk_id",
        F.posexplode(
            F.array(
                F.concat(F.lit("[Source: "), F.col("source"), F.lit(", chunk "), F.col("chunk_id").cast("string"), F.lit("]")),
                F.col("content"),
            )
        ).alias("position", "line"),
    )
    write_lines(labelled, order, f"{path}/unified_chunks")
