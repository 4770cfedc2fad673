"""Thread state as an append-only log keyed by thread and turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.streaming.pages import append_stream


def append_threads(
    messages: DataFrame, path: str, checkpoint: str, event_time: str | None = None, keep: str = "1 day"
) -> StreamingQuery:
    """Append messages; one delivered twice is kept once.

    State and shuffle are keyed by (thread, turn), so a thread of any length is
    spread over all tasks. With ``event_time`` a message is remembered until
    the latest time seen is ``keep`` past its own, and its state goes then. A
    message that arrives later than that is not appended, as it could be one
    that was; the query reports how many there were
    (``numRowsDroppedByWatermark``). Without ``event_time`` every message is
    remembered for good and the state grows with the log.
    """
    key = ["conv_id", "turn"]
    if event_time is None:
        return append_stream(messages.dropDuplicates(key), path, checkpoint)
    once = messages.withWatermark(event_time, keep).dropDuplicatesWithinWatermark(key)
    return append_stream(once, path, checkpoint)


def thread_log(spark: SparkSession, path: str) -> DataFrame:
    """The stored log; order it by ``turn`` inside a thread."""
    return spark.read.parquet(path)


def thread_sizes(messages: DataFrame) -> DataFrame:
    """Running message count and last turn of every thread, for update mode."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("messages"), F.max("turn").alias("last_turn")
    )
