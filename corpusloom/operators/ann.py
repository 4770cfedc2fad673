"""Approximate search: clustered cells, product-quantised codes, hash buckets.

An index is a DataFrame: the vectors plus a ``cell``, ``codes`` or ``buckets``
column. What is learned (centroids, code books) has a size set by parameters
only. Cells and all code books are trained together, each round in one pass over
a bounded sample. Queries travel to the executors under the bound of
:mod:`search`, so a cell or bucket holding a third of the corpus is still spread
over all tasks. :func:`save_index` stores an index by cell with all that was
learned, :func:`load_index` opens it in another session.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.search import (
    DEFAULT_K,
    HIT_SCHEMA,
    MAX_QUERY_ROWS,
    QuerySet,
    _pair_scanner,
    _prune,
    _ranked,
    _scanner,
    first_per_group,
    in_passes,
    nearest,
    small_queries,
    strategy,
)
from corpusloom.session import stage

# Most cells of a clustered index, rows per cell below which
# fewer are made, sub-vectors and bits of a code, cells probed by default.
MAX_CELLS = 100
ROWS_PER_CELL = 10
SUB_VECTORS = 8
CODE_BITS = 8
DEFAULT_PROBES = 1

SEED = 42
KMEANS_ITERATIONS = 10
START_ROWS = 16
#: Vectors an index is trained on at most; all are indexed.
TRAINING_ROWS = 1_000_000
RERANK = 50
HASH_TABLES = 8
#: Bits of a bucket, the share of buckets probed by default, and the mark of what they learn in a stored index.
BUCKET_BITS, BUCKET_PROBES, BUCKET_BOOK = 8, 0.6, -2
BUCKET_LENGTH = 0.1
#: The strategy the others are held against.
EXACT = "Flat L2"
#: Rows of a cell that one file of a stored index holds, about.
FILE_ROWS = 1_000_000


def cell_count(vectors: int) -> int:
    """``min(100, n // 10)`` cells, but at least one."""
    return max(1, min(MAX_CELLS, vectors // ROWS_PER_CELL))


@dataclass
class CellIndex:
    """Vectors with the cell of their nearest centroid, and the centroids.

    With several ``copies`` a vector is stored in as many of its nearest cells; ``nearer`` lists the cells of the copies
    before this one, under which a query meets it first.
    """

    rows: DataFrame
    centroids: object
    copies: int = 1


@dataclass
class CodeIndex:
    """Cells plus quantised codes, with one code book per sub-vector."""

    rows: DataFrame
    centroids: object
    books: list
    copies: int = 1

    def cells(self) -> CellIndex:
        return CellIndex(self.rows, self.centroids, self.copies)


@dataclass
class BucketIndex:
    """Vectors with the bucket of their bits: on which side of the middle they are along each of a few directions."""

    rows: DataFrame
    directions: object
    middles: object


def _gaps(rows, centers):
    """Squared distances up to a number that each row has for all centers."""
    return (centers * centers).sum(axis=1)[None, :] - 2.0 * rows @ centers.T


def _matrix(vectors: pa.Array) -> np.ndarray:
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).astype(np.float64)


def _spread_out(rows: np.ndarray, count: int) -> np.ndarray:
    """``count`` different rows at most, each drawn with a chance that grows with its squared distance from those before."""
    draw, chosen = np.random.default_rng(SEED), [0]
    far = ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and far.max() > 0:
        chosen.append(int(draw.choice(len(rows), p=far / far.sum())))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def _sample(corpus: DataFrame, most: int = TRAINING_ROWS) -> tuple[DataFrame, int]:
    """Vectors to learn from, and the number of all: all of them up to ``most``, beyond that a share that a hash picks."""
    known = corpus.filter(F.col("embedding").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    total = known.count()
    if total > most:
        share = int(most / total * (1 << 32))
        known = known.filter(F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(1 << 32)) < share)
    return stage(known, "training"), total


def train(
    corpus: DataFrame, cells: int | None = None, parts: int = 0, bits: int = CODE_BITS, sample_rows: int = TRAINING_ROWS
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Centroids of ``cells`` cells and, for ``parts`` > 0, a book of up to 2^``bits`` centers for each sub-vector.

    Lloyd's rounds for the cells and all sub-vectors go together: a round is one pass over the sample, whose tasks return a
    sum and a count for each center. The sample is all vectors up to ``sample_rows``, beyond that the share of them that a
    hash of vec_id picks.
    """
    sample, total = _sample(corpus, sample_rows)
    cells = cells or cell_count(total)
    # The first centers come from a few rows for each, picked by hash.
    size = START_ROWS * max(cells, 2**bits if parts else 0)
    first = sample.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id").limit(size).toArrow()
    if not first.num_rows:
        return np.zeros((1, 0)), [np.zeros((1, 0))] * parts
    start = _matrix(first["embedding"])
    width = start.shape[1]
    if parts and width % parts:
        raise ValueError(f"dimension {width} does not divide by {parts}")
    step = width // parts if parts else 0
    # Sets of centers and the columns they look at: the cells first, then the books.
    centers = [_spread_out(start, cells)] + [_spread_out(start[:, at * step : (at + 1) * step], 2**bits) for at in range(parts)]
    columns = [slice(0, width)] + [slice(at * step, (at + 1) * step) for at in range(parts)]

    def sums(batches):
        total = [np.zeros_like(own) for own in centers]
        count = [np.zeros(len(own), dtype=np.int64) for own in centers]
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _matrix(batch.column(0))
            for number, (own, place) in enumerate(zip(centers, columns, strict=True)):
                near = _gaps(rows[:, place], own).argmin(axis=1)
                np.add.at(total[number], near, rows[:, place])
                count[number] += np.bincount(near, minlength=len(own))
        for number, own in enumerate(count):
            held = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(held), number, dtype=np.int32)), pa.array(held.astype(np.int32)), pa.array(own[held]),
                    pa.array(list(total[number][held]), pa.list_(pa.float64())),
                ],
                names=["book", "center", "n", "total"],
            )

    for _ in range(KMEANS_ITERATIONS):
        partial = sample.select("embedding").mapInArrow(sums, "book int, center int, n bigint, total array<double>")
        merged = partial.groupBy("book", "center").agg(
            F.sum("n").alias("n"), vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("total")
        )
        # As many rows as there are centers.
        moved = [own.copy() for own in centers]
        for row in merged.collect():
            moved[row["book"]][row["center"]] = np.array(row["total"]) / row["n"]
        still = all(np.allclose(new, old, atol=1e-9) for new, old in zip(moved, centers, strict=True))
        centers[:] = moved
        if still:
            break
    return centers[0], centers[1:]


def _placed(corpus: DataFrame, centroids: np.ndarray, books: list[np.ndarray], copies: int) -> DataFrame:
    """Every vector with its cell, with several copies one row for each and the cells before it, and with its codes."""
    copies = min(copies, len(centroids))
    kind = "struct<cells: array<int>, codes: array<smallint>>"

    @F.arrow_udf(kind)
    def place(vectors: pa.Array) -> pa.Array:
        rows = _matrix(vectors)
        gaps = _gaps(rows, centroids) if centroids.shape[1] else np.zeros((len(rows), 1))
        near = gaps.argsort(axis=1, kind="stable")[:, :copies] if copies > 1 else gaps.argmin(axis=1)[:, None]
        step = rows.shape[1] // len(books) if books else 0
        codes = np.zeros((len(rows), len(books)), dtype=np.int16)
        for part, centers in enumerate(books):
            codes[:, part] = _gaps(rows[:, part * step : (part + 1) * step], centers).argmin(axis=1)

        def lists(values, dtype):
            offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
            return pa.ListArray.from_arrays(offsets, values.astype(dtype).reshape(-1))

        return pa.StructArray.from_arrays([lists(near, np.int32), lists(codes, np.int16)], names=["cells", "codes"])

    known = corpus.filter(F.col("embedding").isNotNull()).withColumn("_placed", place("embedding"))
    kept = list(corpus.columns)
    codes = [F.col("_placed.codes").alias("codes")] if books else []
    if copies == 1:
        return known.select(*kept, F.col("_placed.cells")[0].alias("cell"), *codes)
    spread = known.select(*kept, "_placed", F.posexplode("_placed.cells").alias("_at", "cell"))
    nearer = F.slice("_placed.cells", F.lit(1), F.col("_at")).alias("nearer")
    return spread.select(*kept, "cell", nearer, *codes)


def build_cells(corpus: DataFrame, cells: int | None = None, copies: int = 1) -> CellIndex:
    """Vectors by cell. Each is stored in its ``copies`` nearest cells, so fewer cells need to be probed."""
    centroids, _ = train(corpus, cells)
    return CellIndex(_placed(corpus, centroids, [], copies), centroids, copies)


def build_codes(
    corpus: DataFrame, cells: int | None = None, parts: int = SUB_VECTORS, bits: int = CODE_BITS, copies: int = 1
) -> CodeIndex:
    """Cell and product code of every vector; the dimension must divide by ``parts``."""
    centroids, books = train(corpus, cells, parts, bits)
    return CodeIndex(_placed(corpus, centroids, books, copies), centroids, books, copies)


def build_buckets(corpus: DataFrame, bits: int = BUCKET_BITS) -> BucketIndex:
    """Vectors by bucket: a bit for each of the ``bits`` directions along which a bounded sample varies most, parted at its
    median, so buckets are of like size."""
    sample, _ = _sample(corpus)
    features = sample.select(array_to_vector("embedding").alias("_features"))
    head = sample.select(F.size("embedding").alias("width")).first()
    if head is None:
        return BucketIndex(corpus.withColumn("bucket", F.lit(0)), np.zeros((0, 0)), np.zeros(0))
    model = PCA(k=min(bits, head["width"]), inputCol="_features", outputCol="_along").fit(features)
    along = model.transform(features).select(F.posexplode(vector_to_array("_along")).alias("bit", "at"))
    middles = along.groupBy("bit").agg(F.percentile_approx("at", 0.5, 10_000).alias("middle")).orderBy("bit").collect()
    directions = model.pc.toArray().T
    held = np.array([row["middle"] for row in middles])

    @F.arrow_udf("int")
    def place(vectors: pa.Array) -> pa.Array:
        return pa.array(((_matrix(vectors) @ directions.T > held) @ (1 << np.arange(len(held)))).astype(np.int32))

    known = corpus.filter(F.col("embedding").isNotNull())
    return BucketIndex(known.withColumn("bucket", place("embedding")), directions, held)


def with_buckets(queries: DataFrame, index: BucketIndex, probes: int | float, name: str = "asked") -> DataFrame:
    """Add the buckets to probe: the query's own first, then those for which it crosses the least squared distance to the
    middles. A number below 1 is a share of all buckets, at least one."""
    directions, middles = index.directions, index.middles
    count = 1 << len(middles)
    probes = max(1, int(probes * count)) if 0 < probes < 1 else probes

    @F.pandas_udf("array<int>")
    def buckets(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        gap = np.array(vectors.tolist(), dtype=np.float64) @ directions.T - middles
        bits = np.arange(count)[:, None] >> np.arange(len(middles)) & 1
        side, cost = gap > 0, gap * gap
        # Bits that differ: those set on the wrong side, each at the square of its gap.
        away = np.where(side, 0.0, cost) @ bits.T + np.where(side, cost, 0.0) @ (1 - bits.T)
        return pd.Series(np.argsort(away, axis=1, kind="stable")[:, :probes].tolist())

    known = queries.filter(F.col("query_vector").isNotNull())
    return known.withColumn(name, buckets(F.col("query_vector").cast("array<double>")))


def search_probed(
    index: BucketIndex, queries: DataFrame, k: int = DEFAULT_K, probes: int | float = 1, counter: Observation | None = None
) -> DataFrame:
    """Exact L2 over the probed buckets only; a stored index is pruned to their folders."""
    if not len(index.middles):
        return nearest(index.rows, queries, "l2", k, counter=counter)
    asked = with_buckets(queries, index, probes)
    return nearest(index.rows, asked, "l2", k, row_keys="bucket", query_keys="asked", counter=counter)


@strategy("lsh")
def lsh(corpus, queries, k=DEFAULT_K, bits=BUCKET_BITS, probes=BUCKET_PROBES, counter=None, index=None):
    return search_probed(index or build_buckets(corpus, bits), queries, k, probes, counter)


def save_index(index: CellIndex | CodeIndex | BucketIndex, path: str) -> None:
    """Vectors in a folder per cell or bucket, each file with a bounded part of it; what was learned as a table beside them."""
    spark = index.rows.sparkSession
    column = "bucket" if isinstance(index, BucketIndex) else "cell"
    rows = stage(index.rows, "index-rows")
    # One row a folder: how many files it takes.
    files = rows.groupBy(column).agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_files"))
    spread = rows.join(F.broadcast(files), column).withColumn("_file", F.pmod(F.xxhash64("vec_id"), F.col("_files")))
    dealt = spread.repartition(column, "_file").drop("_file", "_files")
    dealt.write.mode("overwrite").partitionBy(column).parquet(f"{path}/vectors")
    if isinstance(index, BucketIndex):
        sets = {BUCKET_BOOK: np.column_stack([index.directions, index.middles])}
    else:
        sets = dict(enumerate([index.centroids, *getattr(index, "books", [])], -1))
    centers = [(book, at, [float(x) for x in row]) for book, own in sets.items() for at, row in enumerate(own)]
    table = spark.createDataFrame(centers, "book int, center int, place array<double>")
    table.withColumn("copies", F.lit(getattr(index, "copies", 1))).coalesce(1).write.mode("overwrite").parquet(f"{path}/centers")


def load_index(spark: SparkSession, path: str) -> CellIndex | CodeIndex | BucketIndex:
    """An index that :func:`save_index` stored; its size in the driver is that of what was learned."""
    rows = spark.read.parquet(f"{path}/vectors")
    held: dict[int, list] = {}
    copies = 1
    for row in spark.read.parquet(f"{path}/centers").orderBy("book", "center").collect():
        held.setdefault(row["book"], []).append(row["place"])
        copies = row["copies"]
    centers = [np.array(held[book], dtype=np.float64) for book in sorted(held)]
    if BUCKET_BOOK in held:
        return BucketIndex(rows, centers[0][:, :-1], centers[0][:, -1])
    return CodeIndex(rows, centers[0], centers[1:], copies) if len(centers) > 1 else CellIndex(rows, centers[0], copies)


def with_probes(queries: DataFrame, centroids, probes: int | float, name: str = "cells") -> DataFrame:
    """Add the ``probes`` nearest cells of every query; a number below 1 is a share of all cells, at least one cell."""
    if 0 < probes < 1:
        probes = max(1, int(probes * len(centroids)))

    @F.pandas_udf("array<int>")
    def cells(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        rows = np.array(vectors.tolist(), dtype=np.float64)
        return pd.Series(np.argsort(_gaps(rows, centroids), axis=1, kind="stable")[:, :probes].tolist())

    known = queries.filter(F.col("query_vector").isNotNull())
    return known.withColumn(name, cells(F.col("query_vector").cast("array<double>")))


def search_cells(
    index: CellIndex, queries: DataFrame, k: int = DEFAULT_K, probes: int | float = DEFAULT_PROBES, counter: Observation | None = None
) -> DataFrame:
    """Exact L2 over the probed cells only.

    The probed cells also filter the scan: an index stored by cell (:func:`save_index`) is pruned to those folders.
    """
    asked = with_probes(queries, index.centroids, probes)
    nearer = {"nearer": "nearer"} if "nearer" in index.rows.columns else {}
    return nearest(index.rows, asked, "l2", k, row_keys="cell", query_keys="cells", counter=counter, **nearer)


@strategy("ivf_flat")
def ivf_flat(corpus, queries, k=DEFAULT_K, cells=None, probes=DEFAULT_PROBES, copies=1, counter=None, index=None):
    """``index`` is one built or loaded before."""
    return search_cells(index or build_cells(corpus, cells, copies), queries, k, probes, counter)


def search_codes(
    index: CodeIndex,
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    probes: int | float = DEFAULT_PROBES,
    rerank: int = RERANK,
    max_rows: int | None = None,
    counter: Observation | None = None,
) -> DataFrame:
    """Best ``rerank`` rows per query by their codes, then exact L2 among them.

    A query side beyond the bound goes in passes, each by the same steps, so its size never changes a result.
    """
    asked = with_probes(queries, index.centroids, probes)
    small = small_queries(asked, "cells", max_rows) if max_rows else small_queries(asked, "cells")
    if small is None:
        rows = max_rows or MAX_QUERY_ROWS
        return in_passes(queries, rows, lambda share: search_codes(index, corpus, share, k, probes, rerank, max_rows, counter))
    books, keep = index.books, max(k, rerank)
    by_position = QuerySet(list(range(len(small.ids))), small.matrix, small.keys, "int")
    scan = _scanner(by_position, "l2", keep, "cell")

    def shortlist(batches):
        """The distance to a code is the one to the vector it stands for."""

        def decoded():
            for batch in batches:
                codes = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(books))
                rows = np.concatenate([centers[codes[:, part]] for part, centers in enumerate(books)], axis=1)
                offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
                vectors = pa.ListArray.from_arrays(offsets, rows.reshape(-1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), vectors, *batch.columns[2:]], names=["vec_id", "embedding", *batch.schema.names[2:]]
                )

        return scan(decoded())

    columns = ["vec_id", "codes", "cell"] + (["nearer"] if "nearer" in index.rows.columns else [])
    coded = _prune(index.rows, "cell", small).select(*columns)
    found = coded.mapInArrow(shortlist, HIT_SCHEMA.format(qtype="int"))
    if counter is not None:
        found = found.observe(counter, F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    short = first_per_group(found, ["query_id"], [F.col("score"), F.col("vec_id")], keep)
    # At most rerank * queries rows: a row is compared with exactly the queries
    # that short-listed it.
    asked_for = short.select("vec_id", F.col("query_id").alias("position"))
    candidates = corpus.select("vec_id", "embedding").join(asked_for, "vec_id")
    exact = QuerySet(small.ids, small.matrix, None, small.id_type)
    hits = candidates.select("vec_id", "embedding", "position").mapInArrow(
        _pair_scanner(exact, k), HIT_SCHEMA.format(qtype=small.id_type)
    )
    return _ranked(hits, "l2", k)


@strategy("ivf_pq")
def ivf_pq(
    corpus, queries, k=DEFAULT_K, cells=None, probes=DEFAULT_PROBES, parts=SUB_VECTORS, bits=CODE_BITS, rerank=RERANK, copies=1,
    counter=None, index=None,
):
    index = index or build_codes(corpus, cells, parts, bits, copies)
    return search_codes(index, corpus, queries, k, probes, rerank, counter=counter)


def hash_rows(corpus: DataFrame, vector: str, tables: int, length: float) -> tuple[object, DataFrame]:
    """Random-projection model and the rows with their bucket of every table."""
    features = corpus.withColumn("_features", array_to_vector(F.col(vector).cast("array<double>")))
    model = BucketedRandomProjectionLSH(
        inputCol="_features", outputCol="_hashes", bucketLength=length, numHashTables=tables, seed=SEED
    ).fit(features)
    return model, _buckets(model, features)


def _buckets(model, features: DataFrame) -> DataFrame:
    hashed = model.transform(features)
    tables = model.getNumHashTables()
    # One bigint per table: the table number above the bucket number.
    keys = F.array(
        *[F.lit(t * 2**40) + vector_to_array(F.col("_hashes")[t])[0].cast("bigint") for t in range(tables)]
    )
    return hashed.withColumn("buckets", keys).drop("_features", "_hashes")


def search_buckets(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    tables: int = HASH_TABLES,
    length: float = BUCKET_LENGTH,
    counter: Observation | None = None,
) -> DataFrame:
    """Exact L2 among the rows that share a bucket with the query in any table."""
    model, rows = hash_rows(corpus.select("vec_id", "embedding"), "embedding", tables, length)
    asked = queries.withColumn("_features", array_to_vector(F.col("query_vector").cast("array<double>")))
    return nearest(rows, _buckets(model, asked), "l2", k, row_keys="buckets", query_keys="buckets", counter=counter)


@strategy("hnsw")
def hash_tables(corpus, queries, k=DEFAULT_K, tables=HASH_TABLES, length=BUCKET_LENGTH, counter=None):
    """Buckets of several hash tables take the place of a neighbour graph, which does not distribute."""
    return search_buckets(corpus, queries, k, tables, length, counter)


def recall(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search found, per query."""
    found = approximate.select("query_id", "vec_id").withColumn("_found", F.lit(1))
    return (
        exact.join(found, ["query_id", "vec_id"], "left")
        .groupBy("query_id")
        .agg((F.count("_found") / F.count("*")).alias("recall"))
    )


def compare_indexes(
    corpus: DataFrame,
    queries: DataFrame,
    k: int = DEFAULT_K,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """One row per strategy: name, size estimate, hits, recall against exact L2, and pairs compared.

    Cells and codes are trained once for all strategies that use them. Each search runs once; what it compared is counted
    while it runs.
    """
    from inspect import signature

    from corpusloom.operators.evaluation import INDEX_TYPES, index_footprint
    from corpusloom.operators.search import STRATEGIES, search

    options = options or {}
    queries = stage(queries, "queries")
    trained = {"cells", "parts", "bits", "copies"}
    shared: dict[tuple, CodeIndex] = {}

    def index_for(kind: str, own: dict) -> dict:
        if kind not in ("ivf_flat", "ivf_pq") or "index" in own:
            return own
        # Cells alone do without codes, so they take any that belong to the same cells.
        coded = {name: value for name, value in options.get("ivf_pq", {}).items() if name in ("parts", "bits")}
        known = {name: own[name] for name in ("cells", "copies") if name in own}
        key = tuple(sorted(known.items()))
        if key not in shared:
            index = build_codes(corpus, **known, **coded)
            shared[key] = replace(index, rows=stage(index.rows, "index-rows"))
        built = shared[key] if kind == "ivf_pq" else shared[key].cells()
        return {**{name: value for name, value in own.items() if name not in trained}, "index": built}

    found, scored = [], {}
    for name, kind in INDEX_TYPES.items():
        counter = Observation(f"{kind}-scored")
        counted = {"counter": counter} if "counter" in signature(STRATEGIES[kind]).parameters else {}
        hits = search(kind, corpus, queries, k, **index_for(kind, options.get(kind, {})), **counted)
        found.append(stage(hits.select(F.lit(name).alias("index_name"), "query_id", "vec_id"), "hits"))
        scored[name] = counter.get["scored"] if counted else None
    hits = reduce(DataFrame.unionByName, found).withColumn("_hit", F.lit(1))
    exact = hits.filter(F.col("index_name") == EXACT)
    labels = [(name, STRATEGIES[kind].__name__ if kind == "hnsw" else kind, scored[name]) for name, kind in INDEX_TYPES.items()]
    names = corpus.sparkSession.createDataFrame(labels, "index_name string, index_type string, scored bigint")
    wanted = exact.select("query_id", "vec_id", F.lit(1).alias("_wanted"), F.explode(F.lit([name for name, *_ in labels])).alias("index_name"))
    size = index_footprint(corpus).first()
    both = F.col("_hit") * F.col("_wanted")
    recalls = (
        wanted.join(hits, ["index_name", "query_id", "vec_id"], "full")
        .groupBy("index_name")
        .agg(
            F.count("_hit").alias("hits"),
            F.round(F.count(both) / F.nullif(F.count("_wanted"), F.lit(0)), 6).alias("recall_at_k"),
        )
    )
    return names.join(recalls, "index_name", "left").select(
        "index_name",
        "index_type",
        F.lit(size["num_vectors"]).alias("num_vectors"),
        F.lit(size["vector_dimension"]).alias("vector_dimension"),
        F.lit(size["memory_usage_mb"]).alias("memory_usage_mb"),
        F.coalesce("hits", F.lit(0).cast("bigint")).alias("hits"),
        "recall_at_k",
        "scored",
    )
