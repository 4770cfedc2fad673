"""Positions and neighbours in an order, without one task holding a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.session import shared_dir

PARTITION_BITS = 33  # monotonically_increasing_id keeps the partition above bit 33


def running_start(
    rows: DataFrame,
    order: Sequence[str],
    group: Sequence[str] = (),
    weight: str | None = None,
    name: str = "start",
) -> DataFrame:
    """Sum of ``weight`` over the earlier rows of the same group, from 0.

    The rows are sorted over the cluster and checkpointed once, which fixes how
    they fall into sorted runs; that sort is the only shuffle. Positions are
    counted inside a run. Only the first group of a run can have begun before
    it, so a row per run says where that group stands. A group of any size is
    spread over as many runs as it needs. Pass narrow rows: keys, not texts.
    """
    shared_dir(rows.sparkSession)
    amount = F.col(weight) if weight else F.lit(1)
    placed = (
        rows.orderBy(*group, *order)
        .withColumn("_place", F.monotonically_increasing_id())
        .withColumn("_amount", F.coalesce(amount.cast("bigint"), F.lit(0)))
        .checkpoint()
    )
    group = list(group)
    kind = ", ".join(f"{key}: {placed.schema[key].dataType.simpleString()}" for key in group) or "_all: bigint"
    # One row a run: its first and last group, what each holds of it, and whether they are one.
    held = placed.select("_place", "_amount", *group).mapInArrow(
        _edges(group), f"run bigint, first struct<{kind}>, head bigint, last struct<{kind}>, tail bigint, one boolean"
    )
    shifts, open_, carried = {}, None, 0
    for run in sorted(held.collect(), key=lambda row: row["run"]):
        shift = carried if open_ == run["first"] else 0
        shifts[run["run"]] = shift
        open_, carried = run["last"], run["tail"] + (shift if run["one"] else 0)
    fields = [*rows.columns, name]
    schema = StructType([*(field for field in placed.schema if field.name in rows.columns), StructField(name, LongType())])
    return placed.mapInArrow(_positions(group, shifts, rows.columns, name), schema).select(*fields)


def _borders(batch: pa.RecordBatch, group: list[str], before: list | None) -> np.ndarray:
    """Whether each row begins a group, given the keys of the row before the batch."""
    fresh = np.zeros(batch.num_rows, dtype=bool)
    for key in group:
        codes = pc.dictionary_encode(batch.column(key), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        fresh[1:] |= codes[1:] != codes[:-1]
    fresh[0] = before is not None and before != _keys(batch, group, 0)
    return fresh


def _keys(batch: pa.RecordBatch, group: list[str], at: int) -> list:
    return [batch.column(key)[at].as_py() for key in group]


def _edges(group: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = first = last = ends = None
        head = tail = 0
        one = True
        for batch in batches:
            if not batch.num_rows:
                continue
            amount = batch.column("_amount").to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(_borders(batch, group, last))
            if number is None:
                number, first = batch.column("_place")[0].as_py() >> PARTITION_BITS, batch.slice(0, 1)
            if one:
                head += int(amount[: starts[0]].sum()) if len(starts) else int(amount.sum())
            tail = int(amount[starts[-1] :].sum()) if len(starts) else tail + int(amount.sum())
            one = one and not len(starts)
            last, ends = _keys(batch, group, batch.num_rows - 1), batch.slice(batch.num_rows - 1)
        if number is not None:

            def named(row: pa.RecordBatch) -> pa.StructArray:
                columns = [row.column(key) for key in group] or [pa.array([0], pa.int64())]
                return pa.StructArray.from_arrays(columns, names=group or ["_all"])

            columns = [pa.array([number]), named(first), pa.array([head]), named(ends), pa.array([tail]), pa.array([one])]
            yield pa.RecordBatch.from_arrays(columns, names=["run", "first", "head", "last", "tail", "one"])

    return run


def _positions(group: list[str], shifts: dict[int, int], columns: list[str], name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, ahead = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if last is None:
                ahead = shifts[batch.column("_place")[0].as_py() >> PARTITION_BITS]
            amount = batch.column("_amount").to_numpy(zero_copy_only=False)
            fresh = _borders(batch, group, last)
            sums = np.cumsum(amount) - amount
            # Each row counts from the start of its group; the rows before the first border go on from what is ahead.
            begin = np.flatnonzero(fresh)
            base = np.concatenate([[-ahead], sums[begin]])[np.cumsum(fresh)]
            start = sums - base
            ahead = int(start[-1] + amount[-1])
            last = _keys(batch, group, batch.num_rows - 1)
            arrays = [batch.column(column) for column in columns]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(start.astype(np.int64))], names=[*columns, name])

    return run


def with_next(
    rows: DataFrame,
    group: str,
    order: str,
    columns: Sequence[str],
    block: int = 4096,
) -> DataFrame:
    """Add ``next``, a struct of ``columns`` of the following row of the group.

    ``order`` is a number that counts up within the group. A long group is cut
    into blocks of it; only block boundaries are looked up across blocks.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    following = Window.partitionBy(group, "_block").orderBy(order)
    payload = F.struct(*columns)
    inside = blocked.withColumn("_next", F.lead(payload).over(following))
    # The first row of each block is all that another block needs; one row a block travels.
    heads = blocked.groupBy(group, "_block").agg(F.min_by(payload, order).alias("_head"))
    by_block = Window.partitionBy(group).orderBy("_block")
    crossing = heads.select(
        F.col(group).alias("_group"), F.col("_block").alias("_end"), F.lead("_head").over(by_block).alias("_carried")
    ).filter("_carried is not null")
    return (
        inside.join(crossing, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_end")), "left")
        .withColumn("next", F.coalesce("_next", "_carried"))
        .drop("_block", "_next", "_carried", "_group", "_end")
    )


def first_per_group(rows: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """Rows 1..n of every group by ``order``; cut per task before the shuffle."""
    ranked = rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(name) <= n)
