"""Vector best-fit packing of tokenised documents into sequences.

Every document becomes token ids with an end id; one that is longer than a
sequence is cut, its first piece taking the remainder. A piece has a size in
three capacities of a sequence: tokens, documents and attention cost (the
square of its length). Pieces go, largest first, into the open sequence in
which every residual capacity holds them and which scores best: least weighted
norm of what stays free ("norm"), or largest weighted dot product of the size
with the residual ("dot"). Groups of a bounded number of pieces are packed in
parallel; a group leaves about one sequence half empty, so the loss shrinks
with the input.

Null text counts as empty and yields its end id. Repeated rows, null ids and
equal lengths are separate pieces. An empty table gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import per_batch, ship, stage
from corpusloom.llm.encode import encoder

LENGTH = 2048
GROUP = 20_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def cut(n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole ones, but for the first."""
    head = (n - 1) % length + 1
    return [(0, head)] + [(at, length) for at in range(head, n, length)]


def pieces(docs: DataFrame, path: str, end_id: int = 0, length: int = LENGTH) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text)."""

    def make():
        coder, end = encoder(path), int(end_id).to_bytes(4, "little")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], [], []]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), coder.encode(batch.column("text")), strict=True):
                ids += end
                for number, (start, size) in enumerate(cut(len(ids) // 4, length)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + size)])
                    for column, value in zip(out, (doc_id, number, start, size, crc), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(out, kinds, strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

        return step

    return per_batch(docs.select("doc_id", "text"), make, PIECES, 256, "text")


def best_fit(
    sizes: np.ndarray, capacities: np.ndarray, weights: np.ndarray, rule: str = "norm"
) -> tuple[np.ndarray, np.ndarray]:
    """Bin and place of each item (rows of ``sizes``: tokens first), largest first.

    No bin exceeds a capacity; an item that alone exceeds one gets a bin of its own.
    """
    n = len(sizes)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    share = sizes / capacities
    order = np.lexsort((np.arange(n), -(share * weights).sum(axis=1)))
    # Below the least item no bin can take anything: such bins leave the open set.
    least = np.minimum.accumulate(sizes[order][::-1], axis=0)[::-1] if n else sizes
    room = np.zeros((n, sizes.shape[1]))
    number = np.zeros(n, dtype=np.int64)
    used = np.zeros(n, dtype=np.int64)
    opened = active = 0
    for step, item in enumerate(order.tolist()):
        size = sizes[item]
        if step % 256 == 0 and active:
            keep = (room[:active] >= least[step]).all(axis=1)
            live = int(keep.sum())
            room[:live], number[:live] = room[:active][keep], number[:active][keep]
            active = live
        fits = np.flatnonzero((room[:active] >= size).all(axis=1))
        if len(fits):
            free = room[fits]
            if rule == "norm":
                at = fits[np.argmin((((free - size) / capacities) ** 2 * weights).sum(axis=1))]
            else:
                at = fits[np.argmax((free / capacities * share[item] * weights).sum(axis=1))]
        else:
            at, active = active, active + 1
            room[at], number[at] = capacities, opened
            opened += 1
        room[at] -= size
        bins[item], offsets[item] = number[at], used[number[at]]
        used[number[at]] += int(size[0])
    return bins, offsets


def pack(
    items: DataFrame,
    length: int = LENGTH,
    documents: int | None = None,
    cost: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01),
    rule: str = "norm",
    group: int = GROUP,
) -> DataFrame:
    """``items`` (with a ``length`` column) and sequence_id, offset.

    ``documents`` bounds the pieces of a sequence and ``cost`` the sum of their
    squared lengths; left out, only tokens bind. ``group`` is the number of
    pieces that one task packs together.
    """
    if rule not in ("norm", "dot"):
        raise ValueError(f"unknown rule {rule!r}")
    ship(items.sparkSession)
    capacities = np.array([length, documents or length, cost or float(length) ** 2], dtype=float)
    scale = np.array(weights, dtype=float)
    numbered = stage(items.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = max(1, -(-numbered.count() // group))
    dealt = numbered.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    names = items.columns

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_row")
        tokens = rows.column("length").to_numpy().astype(float)
        sizes = np.column_stack([tokens, np.ones(len(tokens)), tokens**2])
        bins, offsets = best_fit(sizes, capacities, scale, rule)
        rows = rows.select(names)
        rows = rows.append_column("sequence_id", pa.array((key[0].as_py() << 32) + bins))
        return rows.append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in items.schema)
    return dealt.groupBy("_group").applyInArrow(one, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """Tokens, pieces and attention cost of each sequence."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("tokens"), F.count(F.lit(1)).alias("pieces"), F.sum(F.col("length") ** 2).alias("cost")
    )


