"""Quartile bucket digests of documents.

The bytes of a text are read in windows of five; the last byte makes triplets
with two others of its window, and each triplet is hashed to a bucket and
counted. A digest holds two bits a bucket, the quartile of its count among all
buckets, and a byte for the logarithm of the length. The difference of two
digests adds the steps between quartiles, each bounded by 3, and the bounded
difference of lengths; likeness is one minus its share of the expected
difference of unrelated digests, held within 0 and 1.

Texts of any length are read whole. Null text counts as empty and has the digest of no triplets; equal texts have
equal digests. Repeated ids follow each other in the order of their texts'
hash, null ids come first. A single document is its own next one. An empty
table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, parts_for, per_batch, ship

BUCKETS = 256
#: Pairs of earlier bytes of the window that join its last byte.
PAIRS = ((1, 2), (1, 3), (2, 3), (2, 4), (1, 4), (3, 4))
LENGTH_STEPS = 12


def counts(data: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of hashed byte triplets; a text of under three bytes has none."""
    raw = np.frombuffer(data, np.uint8).astype(np.uint32)
    total = np.zeros(buckets, dtype=np.int64)
    shift = np.uint32(32 - int(math.log2(buckets)))
    for salt, (a, b) in enumerate(PAIRS):
        if len(raw) <= b:
            continue
        key = raw[b:] | raw[b - a : len(raw) - a] << np.uint32(8) | raw[: len(raw) - b] << np.uint32(16)
        key = (key + np.uint32(salt << 24)) * np.uint32(0x9E3779B1)
        key ^= key >> np.uint32(15)
        total += np.bincount((key * np.uint32(0x85EBCA6B)) >> shift, minlength=buckets)
    return total


def digest(text: str, buckets: int = BUCKETS) -> str:
    """Hex of the length byte and of the quartile of each bucket, two bits each."""
    data = text.encode("utf-8", "surrogatepass")
    found = counts(data, buckets)
    ranked = np.sort(found)
    bounds = ranked[[buckets // 4 - 1, buckets // 2 - 1, 3 * buckets // 4 - 1]]
    codes = (found[:, None] > bounds[None, :]).sum(axis=1).astype(np.uint8)
    packed = codes.reshape(-1, 4) << np.array([0, 2, 4, 6], dtype=np.uint8)
    size = min(255, round(8 * math.log2(len(data) + 1)))
    return bytes([size]).hex() + np.bitwise_or.reduce(packed, axis=1).tobytes().hex()


def difference(a: str, b: str) -> tuple[int, int]:
    """Steps between the quartiles of two digests, and bounded steps between their lengths."""
    left, right = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    shifts = np.array([0, 2, 4, 6], dtype=np.uint8)
    x, y = ((v[1:, None] >> shifts & 3).astype(int) for v in (left, right))
    return int(np.abs(x - y).sum()), min(LENGTH_STEPS, abs(int(left[0]) - int(right[0])))


def likeness(a: str, b: str) -> float:
    """1 for equal digests, near 0 for unrelated ones: quartiles drawn apart differ by 1.25 on average."""
    if a == b:
        return 1.0
    steps, length = difference(a, b)
    buckets = 2 * len(a) - 4
    return max(0.0, 1.0 - steps / (1.25 * buckets) - length / (8.0 * LENGTH_STEPS))


def edit(text: str, other: str) -> str:
    """``text`` with its last half replaced by the head of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


SCHEMA = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def fingerprint(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of ``docs`` (doc_id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [digest(text or "") for text in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "fingerprint"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, make, "doc_id bigint, fingerprint string", 256, "text")


def _ranges(ids: DataFrame, parts: int) -> list[float]:
    """Split points of the ids into ``parts`` ranges of about equal numbers; at most ``parts`` numbers."""
    shares = [k / parts for k in range(1, parts)]
    found = ids.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("double").alias("x")).approxQuantile(
        "x", shares, 0.25 / parts
    ) if shares else []
    return sorted(set(found))


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text, and likeness to that and to the next document.

    The text moves once, to ranges of doc_id. The first document of a range is
    also sent to the range before it, and the very first to the last, so each
    document meets its successor in its own task.
    """
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts_for(rows)
    points = _ranges(rows.select("doc_id"), parts)
    spans = len(points) + 2
    # Null ids are range 0, the others 1 and up.
    if points:
        cutter = Bucketizer(splits=[-math.inf, *points, math.inf], inputCol="_x", outputCol="_b")
        place = lambda df: cutter.transform(df.withColumn("_x", F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0))))
    else:
        place = lambda df: df.withColumn("_b", F.lit(0.0)).withColumn("_x", F.lit(0.0))
    span = F.when(F.col("doc_id").isNull(), 0).otherwise(F.col("_b").cast("int") + 1)
    keyed = place(rows).select("doc_id", "text", span.alias("span"))
    # The head of a range: its least id, and among equal ids the least hash of a text. At most ``spans`` rows.
    heads = (
        place(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")))
        .select(span.alias("span"), "doc_id", "h")
        .groupBy("span").agg(F.min_by("h", F.struct("doc_id", "h")).alias("h"), F.min("doc_id").alias("doc_id"))
        .orderBy("span").collect()
    )
    if not heads:
        return spark.createDataFrame([], SCHEMA)
    # (range before, order there) by head; the first head closes the last range.
    to = {}
    for at, row in enumerate(heads):
        to[(row["span"], row["doc_id"], row["h"])] = heads[at - 1]["span"]
    ghosts = spark.createDataFrame(
        [(s, d, h, t) for (s, d, h), t in to.items()], "g_span int, g_id bigint, g_h bigint, g_to int"
    )
    marked = keyed.withColumn("h", F.xxhash64("text")).join(
        F.broadcast(ghosts),
        (F.col("span") == F.col("g_span")) & F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("h") == F.col("g_h")),
        "left",
    )
    sent = marked.select(
        "doc_id", "text", "h",
        F.explode(
            F.when(F.col("g_to").isNull(), F.array(F.struct(F.col("span").alias("s"), F.lit(0).alias("ghost"))))
            .otherwise(F.array(F.struct(F.col("span").alias("s"), F.lit(0).alias("ghost")), F.struct(F.col("g_to").alias("s"), F.lit(1).alias("ghost"))))
        ).alias("e"),
    ).select("doc_id", "text", "h", F.col("e.s").alias("span"), F.col("e.ghost").alias("ghost"))
    ordered = sent.repartitionByRange(spans, "span").sortWithinPartitions(
        "span", "ghost", F.col("doc_id").asc_nulls_first(), "h"
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (range, doc_id, text, digest) that waits for its successor
        known = ("", digest(""))
        for batch in stream:
            for some in batches_of(batch, 256, "text"):
                out: list[list] = [[] for _ in range(7)]
                columns = [some.column(name).to_pylist() for name in ("span", "ghost", "doc_id", "text")]
                for place_, ghost, doc_id, text in zip(*columns, strict=True):
                    if ghost and held is None:
                        continue  # a further copy of the head
                    if text != known[0]:
                        known = (text, digest(text))
                    mine = known[1]
                    if held is not None and held[0] == place_:
                        edited = edit(held[2], text)
                        theirs = digest(edited)
                        row = (
                            held[1], len(held[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(),
                            held[3], theirs, likeness(held[3], theirs), likeness(held[3], mine),
                        )
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                    held = None if ghost else (place_, doc_id, text, mine)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
                names = [part.split()[0] for part in SCHEMA.split(", ")]
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    return ordered.mapInArrow(run, SCHEMA)
