"""Incremental page ingest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.pages import latest_version
from corpusloom.session import discard, stage

SALTS = 32
BUCKETS = 64


def stream_table(spark: SparkSession, path: str, glob: str | None = None, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of parquet files as a stream; the schema comes from one file.

    ``glob`` names the files of the folder that are read, or tables in it that are folders of files themselves.
    """
    source = f"{path}/{glob}" if glob else path
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if not glob or _holds_folders(spark, source):
        return reader.parquet(source)
    # One file is no place a stream can start from: its folder is, with a filter by name.
    return reader.option("pathGlobFilter", glob).parquet(path)


def _holds_folders(spark: SparkSession, pattern: str) -> bool:
    """Whether ``pattern`` matches a folder, which a filter by name would look into for files of that name."""
    place = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return any(status.isDirectory() for status in found or [])


def _columns(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def dedup_pages(
    pages: DataFrame,
    key: str | Sequence[str] = "url",
    spread_by: str = "page_id",
    event_time: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Each page once over the life of the stream; failed fetches are not
    remembered, so a later success still gets through. ``key`` is a column or several.

    Two steps: copies of a hot page first meet on a salted key, so they do not
    all go to one task, then the few survivors meet on the key itself. With
    ``event_time`` the state is bounded by ``delay``; without it the state
    grows with the number of distinct keys.
    """
    good = pages.filter(F.col("html").isNotNull())
    salted = good.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(SALTS)))
    if event_time:
        salted = salted.withWatermark(event_time, delay)
        return salted.dropDuplicatesWithinWatermark([*_columns(key), "_salt"]).dropDuplicatesWithinWatermark(_columns(key)).drop("_salt")
    return salted.dropDuplicates([*_columns(key), "_salt"]).dropDuplicates(_columns(key)).drop("_salt")


def append_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream to a parquet table, working off what is there."""
    return (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, list[tuple[int, str]]]:
    """Folders of each bucket in finished batches, oldest first; ``before`` leaves out that batch and later ones."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def found(pattern: str) -> list[str]:
        listed = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{pattern}"))
        return [status.getPath().toString() for status in listed or []]

    finished = {folder.rsplit("/", 2)[1] for folder in found("batch=*/_SUCCESS")}
    out: dict[int, list[tuple[int, str]]] = {}
    for folder in found("batch=*/bucket=*"):
        batch, bucket = folder.rsplit("/", 2)[1:]
        number = int(batch.split("=")[1])
        if batch in finished and (before is None or number < before):
            out.setdefault(int(bucket.split("=")[1]), []).append((number, folder))
    return {bucket: sorted(folders) for bucket, folders in out.items()}


def _read_folders(spark: SparkSession, path: str, folders: list[str], like: DataFrame | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    if like is not None:
        reader = reader.schema(like.schema)
    return reader.parquet(*folders)


def upsert_pages(
    pages: DataFrame,
    path: str,
    checkpoint: str,
    key: str | Sequence[str] = "url",
    version: str = "scraped_at",
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Keep the newest row of each key, a column or several, in a snapshot cut into ``buckets`` by a hash of the key.

    A micro-batch writes anew the buckets it touches, merged with what they held, to a folder of its own, which counts once
    it is whole. A batch that is repeated after a failure merges with what stood before it and overwrites its folder, so it
    changes nothing. The version of a bucket that was current is kept for those who read it; older ones are removed.
    """

    keys = _columns(key)

    def land(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = latest_version(batch, keys, [version]).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
        newest = stage(newest, "batch")
        touched = [row["bucket"] for row in newest.select("bucket").distinct().collect()]
        if not touched:
            return
        held = _versions(spark, path, batch_id)
        folders = [held[bucket][-1][1] for bucket in touched if bucket in held]
        merged = newest.withColumn("_batch", F.lit(1))
        if folders:
            current = _read_folders(spark, path, folders).select(*newest.columns)
            merged = merged.unionByName(current.withColumn("_batch", F.lit(0)))
        # Of equal versions the later batch wins.
        merged = latest_version(merged, keys, [version, "_batch"]).drop("_batch")
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch_id}")
        for bucket in touched:
            for _, folder in held.get(bucket, [])[:-1]:
                discard(spark, folder)

    return (
        pages.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_latest(spark: SparkSession, path: str, key: str = "url", version: str = "scraped_at") -> DataFrame:
    """The current content of every page: one folder for each bucket, in which each key is one row."""
    folders = [versions[-1][1] for versions in _versions(spark, path).values()]
    if not folders:
        raise ValueError(f"no finished batch in {path}")
    return _read_folders(spark, path, folders).drop("batch", "bucket")
