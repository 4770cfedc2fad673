"""File and table readers with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import schemas as S
from corpusloom.functions import text as T
from corpusloom.session import stage

# The suffix of chunk files, of documents, and the folder of chunks.
CHUNK_SUFFIX = ".md"
DOCUMENT_SUFFIX = ".pdf"
CHUNK_FOLDER = "chunks"
SUCCEEDED = "Succeeded"
LOAD_FAILED = "Error loading from "
BAD_JSON = "unreadable JSON"
NO_CHUNKS = "No chunks directory found in "

CORPUS = "content string, path string, source string, source_type string, content_source string, metadata map<string,string>"


def decoded_path(path: Column | str) -> Column:
    """A percent-encoded file path as plain text; ``+`` is a plus sign here. A path that is not encoded stays as it is."""
    plain = F.try_url_decode(F.replace(T.col(path), F.lit("+"), F.lit("%2B")))
    return F.coalesce(plain, T.col(path))


def _local(path: Column) -> Column:
    """A path without the scheme of the local file system."""
    return F.regexp_replace(path, r"\Afile:/*", "/")


def _from_end(path: Column, position: int) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-position))


def _or_empty(spark: SparkSession, schema: str, read) -> DataFrame:
    """An absent root is an empty result, not an error."""
    try:
        return read()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_chunk_corpus(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``<root>/<source>/chunks/**/*.md`` file.

    Files that cannot be read, or are not UTF-8, are skipped and found by
    :func:`unreadable_chunks`; sources without a chunk folder give
    no rows (see :func:`sources_without_chunks`). :func:`load_chunk_corpus`
    gives the rows and the rejects of one read.
    """

    def read():
        files = (
            spark.read.option("recursiveFileLookup", True)
            .option("pathGlobFilter", f"*{CHUNK_SUFFIX}")
            .option("ignoreCorruptFiles", True)
            .text(root, wholetext=True)
        )
        files = files.filter(F.is_valid_utf8("value"))
        located = files.select(F.col("value").alias("content"), _local(decoded_path("_metadata.file_path")).alias("path"))
        parts = F.split(F.regexp_extract("path", _below(root), 1), "/")
        held = located.withColumn("_parts", parts).filter(F.get("_parts", F.lit(1)) == CHUNK_FOLDER)
        source = F.get("_parts", F.lit(0))
        folder = F.concat(F.lit(root.rstrip("/") + "/"), source)
        return held.select(
            "content",
            "path",
            F.col("path").alias("source"),
            source.alias("source_type"),
            folder.alias("content_source"),
            F.create_map(
                F.lit("source"), F.col("path"), F.lit("source_type"), source, F.lit("content_source"), folder
            ).alias("metadata"),
        )

    return _or_empty(spark, CORPUS, read)


def read_chunk_export(spark: SparkSession, path: str) -> DataFrame:
    """The chunk files that the writer exports (``source=…/chunk_id=…``) in the form of :func:`read_chunk_corpus`, with their
    ``chunk_id``; the line break at the end of a file is the writer's."""

    def read():
        files = spark.read.schema("value string, source string, chunk_id bigint").option("wholetext", True).option("basePath", path)
        rows = files.format("text").load(path).filter(F.is_valid_utf8("value"))
        folder = F.concat(F.lit(path.rstrip("/") + "/source="), F.col("source"))
        located = _local(decoded_path("_metadata.file_path"))
        return rows.select(
            F.regexp_replace("value", r"\n\z", "").alias("content"),
            located.alias("path"),
            located.alias("_path"),
            F.col("source").alias("source_type"),
            folder.alias("content_source"),
            "chunk_id",
        ).select(
            "content", "path", F.col("_path").alias("source"), "source_type", "content_source",
            F.create_map(
                F.lit("source"), F.col("_path"), F.lit("source_type"), F.col("source_type"), F.lit("content_source"), F.col("content_source")
            ).alias("metadata"),
            "chunk_id",
        )

    return _or_empty(spark, f"{CORPUS}, chunk_id bigint", read)


def _chunk_files(spark: SparkSession, root: str) -> DataFrame:
    """``path`` of every chunk file; contents stay unread. The listing gives paths as they are, not encoded."""
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", f"*{CHUNK_SUFFIX}")
        .load(root)
        .select(_local(F.col("path")).alias("path"))
    )
    parts = F.split(F.regexp_extract("path", _below(root), 1), "/")
    return listed.filter(F.get(parts, F.lit(1)) == CHUNK_FOLDER)


def _rejected(files: DataFrame, chunks: DataFrame) -> DataFrame:
    return files.join(chunks.select("path"), "path", "left_anti")


def unreadable_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Rejects of :func:`read_chunk_corpus`: ``path`` of every chunk file it returns no row for."""
    return _or_empty(spark, "path string", lambda: _rejected(_chunk_files(spark, root), read_chunk_corpus(spark, root)))


def load_chunk_corpus(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The chunks below ``root``, read once into the shared folder, and the failures: ``source, path, error``.

    A file that cannot be read and a source folder without chunks are one failure each, a source without any file none.
    """
    chunks = stage(read_chunk_corpus(spark, root), "chunks")

    def read():
        files = _rejected(_chunk_files(spark, root), chunks)
        source = F.get(F.split(F.regexp_extract("path", _below(root), 1), "/"), F.lit(0))
        unread = files.select(source.alias("source"), "path", F.concat(F.lit(LOAD_FAILED), source, F.lit(": unreadable or not UTF-8")).alias("error"))
        bare = sources_without_chunks(spark, root).select(
            "source", F.lit(None).cast("string").alias("path"), F.concat(F.lit(NO_CHUNKS), "source").alias("error")
        )
        return unread.unionByName(bare)

    return chunks, _or_empty(spark, "source string, path string, error string", read)


def _below(root: str) -> str:
    """Pattern that captures the part of a path below ``root``."""
    import re

    tail = re.sub(r"\A[a-z0-9]+:/*", "/", root.rstrip("/"))
    return re.escape(tail) + r"/(.*)\z"


def _listing(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` as source and relative parts; contents stay unread."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    path = _local(F.col("path"))
    return files.select(F.split(F.regexp_extract(path, _below(root), 1), "/").alias("parts")).filter(
        F.size("parts") > 1
    )


def sources_without_chunks(spark: SparkSession, root: str) -> DataFrame:
    """Source folders that hold files but no chunk folder."""

    def read():
        return (
            _listing(spark, root)
            .groupBy(F.get("parts", F.lit(0)).alias("source"))
            .agg(F.max(F.get("parts", F.lit(1)) == CHUNK_FOLDER).alias("_has"))
            .filter("not _has")
            .select("source")
        )

    return _or_empty(spark, "source string", read)


def summary_files(spark: SparkSession, root: str) -> DataFrame:
    """``source, summary_file`` for every ``*summary*`` file directly in a source folder."""

    def read():
        name = F.get("parts", F.lit(1))
        return (
            _listing(spark, root)
            .filter((F.size("parts") == 2) & name.contains("summary"))
            .select(F.get("parts", F.lit(0)).alias("source"), name.alias("summary_file"))
        )

    return _or_empty(spark, "source string, summary_file string", read)


def document_files(spark: SparkSession, path: str) -> DataFrame:
    """PDF files with name stem and size in MB.

    A single file matches its suffix in any case; a folder lists ``*.pdf`` in
    lower case and not below it. Nothing found is an error. Only the listing is
    read, never the content.
    """
    single = path.lower().endswith(DOCUMENT_SUFFIX)
    # The recursive listing also sees a folder next to name=value folders as it is.
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if not single:
        reader = reader.option("pathGlobFilter", f"*{DOCUMENT_SUFFIX}")
    files = reader.load(path).select("path", "length", "modificationTime")
    if not single:
        inside = F.regexp_extract(_local(F.col("path")), _below(path), 1)
        files = files.filter((inside != "") & ~inside.contains("/"))
    if files.isEmpty():
        raise ValueError(f"no PDF files found in {path}")
    return files.select(
        "path",
        T.file_stem("path").alias("stem"),
        "length",
        T.megabytes("length").alias("size_mb"),
        "modificationTime",
    )


def read_urls(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a list file with their line order; blanks and ``#`` lines dropped."""

    def read():
        lines = spark.read.text(path).select(
            T.strip("value").alias("url"), F.monotonically_increasing_id().alias("position")
        )
        return lines.filter((F.col("url") != "") & ~F.col("url").startswith("#"))

    return _or_empty(spark, "url string, position bigint", read)


def inline_urls(spark: SparkSession, urls: Sequence[str]) -> DataFrame:
    return spark.createDataFrame([(u, at) for at, u in enumerate(urls)], "url string, position bigint")


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Landed crawl output: ``page_id, url, html``."""
    return read_table(spark, folder, "pages").select("page_id", "url", "html")


def read_pages_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A page artifact: an object a line as the writer makes it, or, with ``lines=False``, an array of objects."""
    return _json(spark, path, S.PAGES_JSON, lines)


def read_web_chunks_json(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    return _json(spark, path, S.WEB_CHUNKS_JSON, lines)


def _json(spark: SparkSession, path: str, schema: str, lines: bool) -> DataFrame:
    """What is no object of the asked form is an error, so no record goes unseen; ``load_*`` make it a failure row instead."""
    reader = spark.read.schema(schema).option("multiLine", not lines).option("mode", "FAILFAST")
    return reader.json(path).withColumn("scraped_at", F.try_to_timestamp("scraped_at"))


def load_pages_json(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    """Page records that are readable, and a failure row (``path, record, error``) for each line, or file, that is not."""
    return _json_with_rejects(spark, path, S.PAGES_JSON, lines)


def load_web_chunks_json(spark: SparkSession, path: str, lines: bool = True) -> tuple[DataFrame, DataFrame]:
    return _json_with_rejects(spark, path, S.WEB_CHUNKS_JSON, lines)


def _json_with_rejects(spark: SparkSession, path: str, schema: str, lines: bool) -> tuple[DataFrame, DataFrame]:
    """Each line, or with ``lines=False`` each file with its array, is parsed once; what fails is a row beside the others."""
    held = f"{schema}, _corrupt_record string"
    kind = f"struct<{held}>" if lines else f"array<struct<{held}>>"
    texts = spark.read.text(path, wholetext=not lines)
    parsed = F.from_json("value", kind, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = texts.select(_local(decoded_path("_metadata.file_path")).alias("path"), F.col("value").alias("record"), parsed.alias("p"))
    rows = stage(rows.filter(~T.is_blank("record")), "json")
    if lines:
        good = F.col("p").isNotNull() & F.col("p._corrupt_record").isNull()
        # A line that is no object gives an object without any field.
        good &= F.ltrim("record").startswith("{")
        found = rows.filter(good).select("p.*")
    else:
        good = F.col("p").isNotNull() & ~F.exists("p", lambda one: one.isNull() | one["_corrupt_record"].isNotNull())
        good &= F.regexp_like("record", F.lit(r"\A\s*\["))
        found = rows.filter(good).select(F.inline("p"))
    rejects = rows.filter(~F.coalesce(good, F.lit(False))).select("path", "record", F.lit(BAD_JSON).alias("error"))
    return found.drop("_corrupt_record").withColumn("scraped_at", F.try_to_timestamp("scraped_at")), rejects


def read_parse_tasks(spark: SparkSession, path: str) -> DataFrame:
    """Parse-task envelopes; a broken file becomes a row with ``_corrupt_record``."""
    return (
        spark.read.schema(S.PARSE_TASK)
        .option("multiLine", True)
        .option("mode", "PERMISSIVE")
        .json(path)
        .withColumn("source", _from_end(decoded_path("_metadata.file_path"), 2))
    )


def failed_tasks(tasks: DataFrame) -> DataFrame:
    """Quarantine: envelopes that are broken or did not succeed."""
    failed = F.col("status").isNull() | (F.col("status") != SUCCEEDED)
    reason = F.coalesce("message", F.when(F.col("_corrupt_record").isNotNull(), F.lit(BAD_JSON)))
    return tasks.filter(failed).select("source", "task_id", "status", reason.alias("message"))


def layout_rows(tasks: DataFrame) -> DataFrame:
    """Chunks of succeeded envelopes: ``source, chunk_id, embed, segments``."""
    return (
        tasks.filter(F.col("status") == SUCCEEDED)
        .select("source", F.posexplode("output.chunks").alias("chunk_id", "chunk"))
        .select(
            "source",
            F.col("chunk_id").cast("bigint").alias("chunk_id"),
            F.col("chunk.embed").alias("embed"),
            F.col("chunk.segments").alias("segments"),
        )
    )


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Vectors and documents of a stored index."""
    return spark.read.parquet(f"{path}/vectors"), spark.read.parquet(f"{path}/docs")
