"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import discard, fresh_path, shared_dir, stage, write_once

__all__ = [
    "batches_of", "chance", "dealt", "discard", "fresh_path", "held_out", "memory", "mix64", "parts_for", "per_batch", "shared_dir", "ship",
    "stage", "table", "use_memory",
    "write_once",
]

_PACKAGE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, as Spark sends any Python file."""
    context = spark.sparkContext
    if getattr(context, "_corpusloom_shipped", False):
        return
    target = os.path.join(tempfile.mkdtemp(prefix="corpusloom-code-"), "corpusloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(_PACKAGE)))
    context.addPyFile(target)
    context._corpusloom_shipped = True


def parts_for(df: DataFrame, text: str = "text", megabytes: int = 64) -> int:
    """Partitions for a shuffle of ``df``: the session's number, more where the counted bytes of ``text`` ask for it."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(asked, size // (megabytes << 20))


def dealt(df: DataFrame, groups: int, *columns: str) -> DataFrame:
    """``df`` by ``columns`` for ``groups`` groups of bounded size: the session's number of partitions, more where the groups
    ask for it, so that the share of a task does not grow with the input."""
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(asked, groups // 4), *columns)


def batches_of(batch: pa.RecordBatch, rows: int = 256, text: str | None = None, megabytes: int = 4) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose ``text`` column holds about ``megabytes`` MB, one row at least."""
    if text is None or not batch.num_rows:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for at, size in enumerate(sizes.tolist()):
        if at > start and (at - start >= rows or held + size > megabytes << 20):
            yield batch.slice(start, at - start)
            start, held = at, 0
        held += size
    yield batch.slice(start)


def per_batch(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str,
    rows: int = 256, text: str | None = None,
) -> DataFrame:
    """``mapInArrow`` with a state made once a task and batches of bounded size."""
    ship(df.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in stream:
            for part in batches_of(batch, rows, text):
                out = step(part)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


_MEMORIES: dict[str, dict] = {}


def memory(name: str, held: dict) -> dict:
    """What an operator remembers from task to task in a worker, under its name."""
    _MEMORIES[name] = held
    return held


def use_memory(name: str) -> None:
    """Called where a task of an operator begins: a worker that served others before forgets what they remembered."""
    for other, held in _MEMORIES.items():
        if other != name:
            held.clear()


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shifts and odd multipliers), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def chance(seed: int, *columns: Column) -> Column:
    """A number in [0, 1) that depends on ``seed`` and the columns alone."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11) / F.lit(float(1 << 53))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
