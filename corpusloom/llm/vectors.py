"""Near-duplicate vectors by spherical k-means cells and blocked cosine products.

Equal vectors are one node with a multiplicity. Cells come from k-means on the
unit sphere over all nodes: an assignment pass returns sums per cell and task,
and the centres are their directions. Their number grows with the nodes. Two
vectors of cosine >= c lie within a chord of sqrt(2 - 2c). With centres a and b,
the difference of their products with the two vectors can be no more than the
chord times the distance of the centres; so if the vectors' homes are a and b,
one of the two is within half of that of the border. Every vector is therefore
also compared with the residents of the cells whose border is that near, and no
link can be lost between cells. A link that two cells find is counted in one.

Blocks of residents of neighbouring numbers are written once, a row each, and
meet in a Cartesian product: a task reads two lists of blocks and writes links
only, so that the disk holds each vector a fixed number of times. Which cells a
vector visits is found where two blocks meet and kept nowhere. Products are
first in single precision, and those that may reach the cosine anew in double.
Two blocks return numbers of links per vector and a spanning forest of the links
they found.

Vectors have any number of dimensions; texts play no part.
Vectors that are null, empty, zero or hold null or non-finite numbers link with
nothing; vectors of different lengths do not link. A repeated id stays a row of
its own. A null id is larger than all others when the smallest is sought. Extra
columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, discard, fresh_path, mix64, per_batch, ship, stage, write_once
from corpusloom.llm.graph import components
from corpusloom.session import SHUFFLE_CLEANUP

CELLS, PASSES, BLOCK = 64, 4, 512
#: Numbers that all centres, a block of vectors and a table of products have at most, unless one row has more.
CENTRES, HELD, TILE = 1 << 21, 1 << 20, 1 << 20
#: Megabytes of blocks that a task of the product holds, about.
SHARE = 32


@contextmanager
def _set(spark: SparkSession, **settings: object) -> Iterator[None]:
    """Session settings for the actions within; ``__`` stands for dots."""
    names = {key.replace("__", "."): str(value) for key, value in settings.items()}
    before = {key: spark.conf.get(key, None) for key in names}
    for key, value in names.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _rounding(width: int) -> float:
    """Room for what single precision takes from a product of unit vectors, twice over."""
    return (width + 16) * 2.0**-22


def _matrix(column: pa.Array, width: int, exact: bool = True) -> np.ndarray:
    """Unit vectors as rows in double precision, or near it in single; short ones are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if exact or flat.dtype != np.float32:
        flat = flat.astype(np.float64)
    if (lengths == width).all():
        rows = flat.reshape(len(lengths), width)
    else:
        rows = np.zeros((len(lengths), width), dtype=flat.dtype)
        for at, (start, size) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
            rows[at, :size] = flat[start : start + size]
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    rows /= np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows if exact else rows.astype(np.float32, copy=False)


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, key, embedding, size, copies, least): each different usable vector once; ``key`` is a hash, which sorts faster."""
    most, last, bound = F.array_max("embedding"), F.array_min("embedding"), F.lit(float("inf"))
    # NaN is the largest of all; looking for what is not there gives null if there are nulls.
    usable = (most < bound) & (last > -bound) & ((most != 0) | (last != 0)) & ~F.array_contains("embedding", bound)
    least = F.min(F.struct(F.col("vec_id").isNull().alias("z"), "vec_id"))
    return stage(
        vectors.where(usable).groupBy(F.xxhash64("embedding").alias("key"), "embedding")
        .agg(F.count(F.lit(1)).alias("copies"), least.alias("least"))
        .select(
            F.monotonically_increasing_id().alias("node"), "key", "embedding", F.size("embedding").alias("size"), "copies",
            F.col("least.vec_id").alias("least"),
        ),
        "vectors",
    )


def _assigned(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, about: results hold for any choice."""
    home = np.empty(len(rows), dtype=np.int32)
    step = max(1, TILE // len(centre))
    for at in range(0, len(rows), step):
        home[at : at + step] = np.argmax(rows[at : at + step] @ centre.T, axis=1)
    return home


def _gathered(nodes: DataFrame, centre: np.ndarray, sums: bool) -> pa.Table:
    """(cell, n, x0, x1, ...) for each cell with nodes: their number and, if asked for, the sum of their directions."""
    width = centre.shape[1]
    names = [f"x{k}" for k in range(width if sums else 0)]
    now = centre.astype(np.float32)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((len(now), len(names))), np.zeros(len(now), dtype=np.int64)
        for held in stream:
            for batch in batches_of(held, max(256, HELD // width)):
                if not batch.num_rows:
                    continue
                rows = _matrix(batch.column("embedding"), width, exact=False)
                home = _assigned(rows, now)
                count += np.bincount(home, minlength=len(now))
                if sums:
                    order = np.argsort(home, kind="stable")
                    used, first = np.unique(home[order], return_index=True)
                    total[used] += np.add.reduceat(rows[order], first, axis=0, dtype=np.float64)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), pa.array(count[used]), *(pa.array(total[used, k]) for k in range(len(names)))],
            names=["cell", "n", *names],
        )

    spark = nodes.sparkSession
    # A task returns a row a cell, so there are a few a core, however large the table is.
    few = nodes.select("embedding").coalesce(2 * spark.sparkContext.defaultParallelism)
    schema = ", ".join(["cell int", "n bigint", *(f"{name} double" for name in names)])
    with _set(spark, **{SHUFFLE_CLEANUP: "true"}):
        return few.mapInArrow(run, schema).groupBy("cell").agg(F.sum("n").alias("n"), *(F.sum(x).alias(x) for x in names)).toArrow()


def centres(nodes: DataFrame, n: int, width: int, cells: int, passes: int) -> np.ndarray:
    """Directions of spherical k-means over all ``n`` nodes; ``cells`` x ``width`` numbers at most."""
    drawn = F.xxhash64(F.lit(11), F.col("embedding"))
    # The centres to begin with: enough pass for all that are wanted, so that a task does not sort as many for itself.
    share = (2 * cells + 100) / n
    first = nodes.where(drawn < F.lit(int(-(2**63) + share * 2**64))) if share < 1 else nodes
    column = first.orderBy(drawn).limit(cells).select("embedding").toArrow().column("embedding").combine_chunks()
    centre = _matrix(column, width) if len(column) else np.eye(1, width)
    for _ in range(passes):
        total = _gathered(nodes, centre, sums=True)
        used = total.column("cell").to_numpy()
        direction = np.stack([total.column(f"x{k}").to_numpy() for k in range(width)], axis=1)
        length = np.sqrt((direction**2).sum(axis=1))
        some = length > 0
        centre[used[some]] = direction[some] / length[some][:, None]
    return centre


def blocks_of(nodes: DataFrame, centre: np.ndarray, block: int) -> str:
    """Path of a table (blk, body): the nodes of neighbouring cells, about ``block`` in a row, by cell."""
    spark = nodes.sparkSession
    width = centre.shape[1]
    now = centre.astype(np.float32)
    census = _gathered(nodes, centre, sums=False)
    weight = np.zeros(len(now))
    # A cell counts for more than its nodes: so no block has very many small ones.
    weight[census.column("cell").to_numpy()] = census.column("n").to_numpy() + block // 1024
    start = np.cumsum(weight) - weight
    number = max(1, -(-int(weight.sum()) // block))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            home = _assigned(_matrix(batch.column("embedding"), width, exact=False), now)
            # The nodes of a cell that reaches into several blocks are spread by chance.
            place = (mix64(batch.column("node").to_numpy()) >> np.uint64(11)) / float(1 << 53)
            blk = np.minimum((start[home] + place * weight[home]) // block, number - 1)
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(home), pa.array(blk.astype(np.int32))], names=[*batch.schema.names, "home", "blk"]
            )

        return step

    def pack(table: pa.Table) -> pa.Table:
        rows = table.drop_columns(["blk"]).sort_by("home").combine_chunks()
        body = pa.BufferOutputStream()
        with pa.ipc.new_stream(body, rows.schema) as out:
            out.write_table(rows)
        return table.slice(0, 1).select(["blk"]).append_column("body", pa.array([body.getvalue().to_pybytes()], pa.binary()))

    kind = nodes.schema["embedding"].dataType.simpleString()
    schema = f"node bigint, embedding {kind}, size int, copies bigint, home int, blk int"
    placed = per_batch(nodes.select("node", "embedding", "size", "copies"), make, schema, max(256, HELD // width))
    asked = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_path(spark, "blocks")
    dealt = placed.repartition(max(asked, number), "blk")
    write_once(dealt.groupBy("blk").applyInArrow(pack, "blk int, body binary"), path)
    return path


class _Block:
    """The nodes of a block by home, and where the residents of each of its cells begin."""

    def __init__(self, body: pa.Buffer, centre: np.ndarray) -> None:
        batch = pa.ipc.open_stream(body).read_all().combine_chunks().to_batches()[0]
        self.node, self.size, self.copies, home = (batch.column(name).to_numpy() for name in ("node", "size", "copies", "home"))
        self.vectors, self.width = batch.column("embedding"), centre.shape[1]
        self.rough = _matrix(self.vectors, self.width, exact=False)
        self.cells, first, self.at = np.unique(home, return_index=True, return_inverse=True)
        self.first = np.append(first, len(home))
        self.centre = centre[self.cells]
        self.own = np.einsum("ij,ij->i", self.rough, self.centre[self.at])

    @cached_property
    def x(self) -> np.ndarray:
        """The vectors in double precision, made when a link is near."""
        return _matrix(self.vectors, self.width)

    def visits(self, cells: _Block, half: float, slack: float) -> np.ndarray:
        """For each cell of ``cells`` and node of this block whether it may have a link across the border."""
        near = np.empty((len(cells.cells), len(self.node)), dtype=bool)
        a, b = cells.centre.astype(np.float64), self.centre.astype(np.float64)
        gap = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T
        gap = (half * np.sqrt(np.maximum(0, gap)) + slack).astype(np.float32)
        step = max(1, TILE // len(self.node))
        for k in range(0, len(near), step):
            reach = cells.centre[k : k + step] @ self.rough.T
            reach += np.repeat(gap[k : k + step], np.diff(self.first), axis=1)
            np.greater_equal(reach, self.own, out=near[k : k + step])
        return near


def _tiles(own: _Block, other: _Block, near: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (place in ``own``, place in ``other``) of the residents of each cell with the nodes that visit it."""
    low = np.float32(cosine - _rounding(own.width))
    products, reached = np.empty(TILE + len(other.node), dtype=np.float32), np.empty(TILE + len(other.node), dtype=bool)
    for k in range(len(own.cells)):
        there = np.flatnonzero(near[k])
        if not len(there):
            continue
        step = max(1, TILE // len(there))
        rough = other.rough[there].T
        for at in range(own.first[k], own.first[k + 1], step):
            to = min(at + step, own.first[k + 1])
            shape, size = (to - at, len(there)), (to - at) * len(there)
            product = np.matmul(own.rough[at:to], rough, out=products[:size].reshape(shape))
            hit = np.greater_equal(product, low, out=reached[:size].reshape(shape))
            some = int(np.count_nonzero(hit))
            if not some:
                continue
            if some * 8 > hit.size:
                left, right = np.nonzero(own.x[at:to] @ other.x[there].T >= cosine)
                left, right = left + at, there[right]
            else:
                left, right = np.nonzero(hit)
                left, right = left + at, there[right]
                part = max(1, TILE // own.width)
                sure = [
                    np.einsum("ij,ij->i", own.x[left[p : p + part]], other.x[right[p : p + part]]) >= cosine
                    for p in range(0, some, part)
                ]
                left, right = left[np.concatenate(sure)], right[np.concatenate(sure)]
            ok = own.size[left] == other.size[right]
            yield left[ok], right[ok]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (of each node a smaller or equal one of its tree's root) after the trees of all pairs a, b are joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            root = label[label]
            if (root == label).all():
                break
            label = root


def _compare(own: _Block, other: _Block, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, a, b) of all links within a block or between two: see ``links``."""
    half, slack = np.sqrt(2 - 2 * cosine) / 2, _rounding(own.width)
    same = own is other
    n = len(own.node)
    node = own.node if same else np.concatenate([own.node, other.node])
    base = 0 if same else n
    others, label = np.zeros(len(node), dtype=np.int64), np.arange(len(node))
    near = other.visits(own, half, slack)
    if same:
        near[own.at, np.arange(n)] = True

    def take(left: np.ndarray, right: np.ndarray) -> None:
        nonlocal label
        if len(left):
            np.add.at(others, left, other.copies[right])
            np.add.at(others, base + right, own.copies[left])
            label = _joined(label, left, base + right)

    for left, right in _tiles(own, other, near, cosine):
        if same:
            # Residents meet each other twice, pairs of two cells once or twice: the lower cell counts, then the lower place.
            a, b = own.at[left], own.at[right]
            once = np.where(a == b, left < right, ~near[b, left] | (a < b))
            left, right = left[once], right[once]
        take(left, right)
    if not same:
        back = own.visits(other, half, slack)
        for right, left in _tiles(other, own, back, cosine):
            fresh = ~near[own.at[left], right]
            take(left[fresh], right[fresh])
    some, low = np.flatnonzero(others), np.flatnonzero(label != np.arange(len(label)))
    kind = np.repeat(np.array([0, 1], dtype=np.int32), [len(some), len(low)])
    return kind, np.concatenate([node[some], node[low]]), np.concatenate([others[some], node[label[low]]])


def links(blocks: DataFrame, centre: np.ndarray, cosine: float, megabytes: float) -> DataFrame:
    """(kind, a, b): numbers of links (0, node, n) and forest edges (1, node, node). ``blocks`` hold ``megabytes`` together."""
    spark = blocks.sparkSession
    ship(spark)
    now = centre.astype(np.float32)
    # So many that each core gets some of the pairs, or more for a task to hold its share.
    parts = max(round((8 * spark.sparkContext.defaultParallelism) ** 0.5), int(megabytes / SHARE))
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)  # in its partition
    left = blocks.coalesce(parts).select(F.col("blk").alias("i"), F.col("body").alias("one"), row.alias("u"))
    right = blocks.coalesce(parts).select(F.col("blk").alias("j"), F.col("body").alias("two"), row.alias("v"))
    # Of (i, j) and (j, i) one, so that of the tasks that read both all take a like share.
    i, j = F.col("i"), F.col("j")
    met = (i == j) | F.when((i + j) % 2 == 0, i < j).otherwise(i > j)
    # A task sees all rows of the right for one of the left after the other; a body comes with the first row that has it.
    pairs = left.join(right.hint("shuffle_replicate_nl"), met | (F.col("u") == 0) | (F.col("v") == 0)).select(
        i, j, met.alias("met"), F.when(F.col("v") == 0, F.col("one")).alias("one"), F.when(F.col("u") == 0, F.col("two")).alias("two")
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held = (None, None), {}
        for batch in stream:
            for at in range(batch.num_rows):
                i, j, compared, one, two = (column[at] for column in batch.columns)
                i, j = i.as_py(), j.as_py()
                if two.is_valid:
                    held[j] = _Block(two.as_buffer(), now)
                if one.is_valid:
                    own = i, _Block(one.as_buffer(), now)
                if compared.as_py():
                    if own[0] != i:
                        raise ValueError(f"block {i} did not come before its pairs")
                    found = _compare(own[1], own[1] if i == j else held[j], cosine)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["kind", "a", "b"])

    return pairs.mapInArrow(run, "kind int, a bigint, b bigint")


def groups(
    vectors: DataFrame, cosine: float = 0.95, cells: int | None = None, passes: int = PASSES, block: int | None = None
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors`` (vec_id, embedding).

    ``cells`` bounds the cells of the k-means and ``block`` is the number of nodes
    that are sent together; both grow with the table if they are not given, and
    results do not depend on them.
    """
    spark = vectors.sparkSession
    ship(spark)
    vectors = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    nodes = nodes_of(vectors)
    width, n = nodes.agg(F.max("size"), F.count(F.lit(1))).first()
    if width is None:
        return vectors.select(
            "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
        )
    cells = cells or max(CELLS, min(int(n**0.75) // 16, CENTRES // width))
    block = block or max(1, min(max(BLOCK, n // 16), HELD // width))
    centre = centres(nodes, n, width, cells, passes)
    path = blocks_of(nodes, centre, block)
    item = 4 if nodes.schema["embedding"].dataType.elementType.typeName() == "float" else 8
    with _set(spark, spark__sql__execution__arrow__maxRecordsPerBatch=1):  # a row holds two blocks
        blocks = spark.read.schema("blk int, body binary").parquet(path)
        found = stage(links(blocks, centre, cosine, n * (width * item + 24) / 1e6), "links")
    discard(spark, path)
    counted = found.where("kind = 0").groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("others"))
    parts = components(found.where("kind = 1").select("a", "b"))
    slim = nodes.select("node", "key", "embedding", "copies", "least")
    heads = parts.join(slim.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("head"))
    of = parts.join(heads, "component").select("node", "head")
    known = slim.join(counted, "node", "left").join(of, "node", "left").select(
        "key", "embedding",
        (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n"),
        F.coalesce("head", "least").alias("head"),
    )
    return (
        vectors.withColumn("key", F.xxhash64("embedding")).join(known, ["key", "embedding"], "left")
        .select(
            "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"),
            F.when(F.col("n").isNull(), F.col("vec_id")).otherwise(F.col("head")).alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
