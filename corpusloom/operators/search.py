"""Nearest-neighbour search of query vectors over a corpus of vectors.

The corpus is scanned where it lies and never shuffled: the queries travel to
the tasks, and every task returns its k best rows per query, which are merged.
A pass carries queries up to a fixed number of bytes, tens of thousands of
them; a larger query set is staged and worked off in passes
(:func:`nearest_tiled`), each over the corpus with its own share, and the hits
of all passes are one table. Where rows and queries meet by keys (cells,
sources, buckets) they do so inside the scan, so a key that holds a third of
the rows is spread over all tasks, and the keys asked for prune the scan.

Scores are rounded to six decimals before ranking and ties go to the smaller
id: the same rows win whatever the batch borders or the order of summation.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from corpusloom.functions import render as R
from corpusloom.functions import text as X
from corpusloom.functions.vectors import normalized
from corpusloom.operators.numbering import first_per_group
from corpusloom.session import fresh_path, stage, write_once

# The usual result size and the sizes an experiment compares.
DEFAULT_K = 5
K_CHOICES = (3, 5, 7, 10)

MAX_QUERY_ROWS = 1 << 17
MAX_QUERY_BYTES = 64 * 1024 * 1024
TILE_ROWS = 4096
TILE_CELLS = 1_000_000
MAX_PRUNED_KEYS = 10_000
LOOKUP_IDS = 10_000
LOOKUP_ROWS = 1_000_000
DECIMALS = 6
#: More than rounding moves a cost by; pairs that wait at least before they are sorted.
TOLERANCE, SETTLE_ROWS = 1e-6, 1 << 18
ASCENDING = {"l2": True, "ip": False, "cosine": False}
HIT_SCHEMA = "query_id {qtype}, vec_id bigint, score double, scored bigint"


@dataclass
class QuerySet:
    """Query vectors on the driver, with the keys each query may look at."""

    ids: list
    matrix: object
    keys: list | None
    id_type: str


def arrow_type(kind: str):
    """The Arrow type of an id column."""
    import pyarrow as pa

    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def small_queries(
    queries: DataFrame,
    keys: str | None = None,
    max_rows: int | None = None,
    max_bytes: int = MAX_QUERY_BYTES,
) -> QuerySet | None:
    """The query side when it is within the bound of one pass, else None.

    Sizes are counted first, so nothing beyond the bound is ever read.
    """
    import numpy as np

    max_rows = max_rows or MAX_QUERY_ROWS
    columns = ["query_id", F.col("query_vector").cast("array<double>").alias("query_vector")]
    if keys:
        columns.append(F.col(keys).alias("keys"))
    asked = queries.select(*columns)
    width = F.size("query_vector") + (F.size("keys") if keys else F.lit(0))
    # One row more than the bound tells a larger set; the sum of its widths stands for the rest.
    head = asked.select(width.alias("width")).limit(max_rows + 1).agg(F.count("*").alias("n"), F.sum("width").alias("width")).first()
    if head["n"] > max_rows or 8 * (head["width"] or 0) > max_bytes:
        return None
    rows = asked.toArrow().sort_by("query_id")
    matrix = np.zeros((0, 0))
    if rows.num_rows:
        vectors = rows["query_vector"].combine_chunks()
        if len(set(np.diff(vectors.offsets.to_numpy()).tolist())) > 1:
            raise ValueError("queries differ in their number of dimensions")
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
    return QuerySet(
        rows["query_id"].to_pylist(),
        matrix,
        rows["keys"].to_pylist() if keys else None,
        queries.schema["query_id"].dataType.simpleString(),
    )


class Best:
    """The k best (cost, vec_id) of many queries, and how many rows each was compared with.

    What is offered waits until it is half as much as what is held; then both are sorted once. So the work grows with what
    is offered, not with the number of offers.
    """

    def __init__(self, count: int, k: int):
        import numpy as np

        self.k, self.limit = k, np.full(count, np.inf)
        self.query, self.cost, self.name = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.scored = np.zeros(count, dtype=np.int64)
        self.waiting: list[tuple] = []
        self.count = 0

    def offer(self, costs, names, who, met=None) -> None:
        """``costs`` of rows ``names`` (down) for the queries ``who`` (across); ``met`` leaves out pairs."""
        import numpy as np

        self.scored[who] += len(names) if met is None else met.sum(axis=0)
        close = costs <= (self.limit[who] + TOLERANCE)[None, :]
        if met is not None:
            close &= met
        if len(names) > 4 * self.k and np.count_nonzero(close) > 4 * self.k * len(who):
            # Many rows are still close: the k-th cost of each query cuts them first, its ties included.
            kth = np.partition(costs if met is None else np.where(met, costs, np.inf), self.k - 1, axis=0)[self.k - 1]
            close &= costs <= kth + TOLERANCE
        row, column = np.nonzero(close)
        self.add(who[column], costs[row, column], names[row])

    def add(self, query, cost, name) -> None:
        """Pairs of a query and a row, one by one."""
        import numpy as np

        cost = np.round(cost, DECIMALS) + 0.0
        kept = cost <= self.limit[query]
        self.waiting.append((query[kept], cost[kept], name[kept]))
        self.count += int(np.count_nonzero(kept))
        if self.count > max(len(self.query) // 2, SETTLE_ROWS):
            self.settle()

    def settle(self) -> None:
        """Only the k best stay; to be called before they are read."""
        import numpy as np

        if not self.count:
            return
        held = [(self.query, self.cost, self.name), *self.waiting]
        query, cost, name = (np.concatenate(column) for column in zip(*held, strict=True))
        self.waiting, self.count = [], 0
        order = np.lexsort((name, cost, query))
        query, cost, name = query[order], cost[order], name[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        self.query, self.cost, self.name = query[kept], cost[kept], name[kept]
        last = place == self.k - 1
        self.limit[query[last]] = cost[last]

    def batch(self, ids: list, id_type, lowest_first: bool):
        """The k best as a batch of hits."""
        import numpy as np
        import pyarrow as pa

        self.settle()
        first = np.ones(len(self.query), dtype=bool)
        first[1:] = self.query[1:] != self.query[:-1]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[at] for at in self.query.tolist()], id_type),
                pa.array(self.name),
                pa.array(self.cost if lowest_first else 0.0 - self.cost),
                pa.array(np.where(first, self.scored[self.query], 0)),
            ],
            names=["query_id", "vec_id", "score", "scored"],
        )


class Meetings:
    """Which queries ask for a key."""

    def __init__(self, keys: list):
        import numpy as np

        held: dict = {}
        for position, own in enumerate(keys):
            for key in own or ():
                held.setdefault(key, []).append(position)
        self.count = len(keys)
        self.lookers = {key: np.array(sorted(set(who))) for key, who in held.items()}

    def of(self, seen):
        """(key, queries, rows) for every key of ``seen``, the rows' keys, that some query asks for."""
        import numpy as np

        names, group = np.unique(seen, return_inverse=True)
        order = np.argsort(group, kind="stable")
        borders = np.searchsorted(group[order], np.arange(len(names) + 1))
        for at, key in enumerate(names.tolist()):
            if key in self.lookers:
                yield key, self.lookers[key], order[borders[at] : borders[at + 1]]

    def asked(self, keys: list, who):
        """Whether each row, given its list of keys, shares one with each of the queries ``who``."""
        import numpy as np

        out = np.zeros((len(keys), len(who)), dtype=bool)
        flat = np.array([key for own in keys for key in own])
        if not len(flat):
            return out
        row = np.repeat(np.arange(len(keys)), [len(own) for own in keys])
        asks = np.zeros(self.count, dtype=bool)
        # Rows share their keys, so each key is looked up once.
        names, group = np.unique(flat, return_inverse=True)
        order = np.argsort(group, kind="stable")
        borders = np.searchsorted(group[order], np.arange(len(names) + 1))
        for at, key in enumerate(names.tolist()):
            if key in self.lookers:
                asks[self.lookers[key]] = True
                out[row[order[borders[at] : borders[at + 1]]]] |= asks[who]
                asks[self.lookers[key]] = False
        return out


def _scanner(queries: QuerySet, metric: str, k: int, row_keys: str | None, tile_rows: int = TILE_ROWS):
    """Arrow kernel: batches of (vec_id, embedding[, keys[, nearer]]) to the k best per query.

    ``nearer`` lists the keys under which a copy of the row is met with precedence: a query that asks for one of them leaves
    this copy out.
    """
    ids, base, keys = queries.ids, queries.matrix, queries.keys
    id_type = arrow_type(queries.id_type)
    lowest_first = ASCENDING[metric]

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        count = len(ids)

        def unit(rows):
            norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
            return rows / np.where(norm == 0, 1.0, norm)

        wanted = unit(base) if metric == "cosine" and count else base
        wanted_sq = (wanted * wanted).sum(axis=1) if count else None
        meetings = Meetings(keys) if keys is not None else None
        best = Best(count, k)

        def costs(rows, who):
            products = rows @ wanted[who].T
            if metric != "l2":
                return -products
            squares = (rows * rows).sum(axis=1)[:, None] + wanted_sq[who][None, :]
            return np.maximum(squares - 2.0 * products, 0.0)

        def compare(rows, names, who, before=None):
            """Rows with queries in tiles of bounded size; ``before`` lists the keys of each row under which a pair was met."""
            wide = max(1, TILE_CELLS // max(1, min(tile_rows, len(rows))))
            for at in range(0, len(rows), tile_rows):
                part = slice(at, at + tile_rows)
                met = None if before is None else ~meetings.asked(before[part], who)
                for left in range(0, len(who), wide):
                    some = who[left : left + wide]
                    best.offer(costs(rows[part], some), names[part], some, None if met is None else met[:, left : left + wide])

        everyone = np.arange(count)
        for batch in batches:
            if not count or k <= 0 or not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            width = wanted.shape[1]
            if not (np.diff(batch.column(1).offsets.to_numpy()) == width).all():
                raise ValueError(f"a vector of the corpus does not have the {width} dimensions of the queries")
            rows = flat.reshape(batch.num_rows, width).astype(np.float64)
            if metric == "cosine":
                rows = unit(rows)
            if keys is None:
                compare(rows, names, everyone)
                continue
            held = batch.column(2)
            if pa.types.is_list(held.type):
                # Several keys per row: a pair is scored once, under the first key they share.
                tables = held.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                for table in range(tables.shape[1]):
                    for _, who, positions in meetings.of(tables[:, table]):
                        earlier = tables[positions, :table].tolist() if table else None
                        compare(rows[positions], names[positions], who, earlier)
                continue
            nearer = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            for _, who, positions in meetings.of(held.to_numpy(zero_copy_only=False)):
                compare(rows[positions], names[positions], who, nearer and [nearer[at] or () for at in positions.tolist()])
        yield best.batch(ids, id_type, lowest_first)

    return scan


def _pair_scanner(queries: QuerySet, k: int):
    """Arrow kernel: batches of (vec_id, embedding, position of a query) to the k nearest (L2) per query.

    A row is compared with the one query beside it, all rows of a batch at once.
    """
    ids, wanted, id_type = queries.ids, queries.matrix, arrow_type(queries.id_type)

    def scan(batches):
        import numpy as np

        best = Best(len(ids), k)
        wanted_sq = (wanted * wanted).sum(axis=1)
        for batch in batches:
            if k <= 0 or not batch.num_rows:
                continue
            names = batch.column(0).to_numpy(zero_copy_only=False)
            if not (np.diff(batch.column(1).offsets.to_numpy()) == wanted.shape[1]).all():
                raise ValueError(f"a vector of the corpus does not have the {wanted.shape[1]} dimensions of the queries")
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            who = batch.column(2).to_numpy(zero_copy_only=False)
            best.scored += np.bincount(who, minlength=len(ids))
            products = np.einsum("ij,ij->i", rows, wanted[who])
            best.add(who, np.maximum((rows * rows).sum(axis=1) + wanted_sq[who] - 2.0 * products, 0.0), names)
        yield best.batch(ids, id_type, True)

    return scan


def _ranked(hits: DataFrame, metric: str, k: int) -> DataFrame:
    score = F.col("score").asc() if ASCENDING[metric] else F.col("score").desc()
    ranked = first_per_group(hits, ["query_id"], [score, F.col("vec_id").asc()], k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _prune(corpus: DataFrame, row_keys: str, small: QuerySet) -> DataFrame:
    """Only rows under keys that are asked for: folders of cells, or row groups, of a stored table.

    Up to a bound the keys are a filter of the scan; more of them meet the rows in a semi join, which Spark broadcasts, and
    then uses to prune folders too, only where it finds their size small.
    """
    asked = {key for own in small.keys for key in own or ()}
    if len(asked) <= MAX_PRUNED_KEYS:
        return corpus.filter(F.col(row_keys).isin(list(asked)))
    kind = corpus.schema[row_keys].dataType.simpleString()
    table = corpus.sparkSession.createDataFrame([(key,) for key in asked], f"{row_keys} {kind}")
    return corpus.join(table, row_keys, "left_semi")


def nearest(
    corpus: DataFrame,
    queries: DataFrame,
    metric: str = "l2",
    k: int = DEFAULT_K,
    row_keys: str | None = None,
    query_keys: str | None = None,
    max_query_rows: int | None = None,
    nearer: str | None = None,
    counter: Observation | None = None,
) -> DataFrame:
    """The k nearest ``corpus(vec_id, embedding)`` rows of every query.

    ``l2`` scores are squared distances, ascending; ``ip`` and ``cosine``
    descend, cosine normalising both sides (a zero vector stays zero).
    With ``row_keys`` (a value, or an array of fixed length, never NULL) a row
    is compared only with the queries whose ``query_keys`` array holds a key
    of it. A row stored under several values names in ``nearer``, an array,
    those that go before this one. ``counter`` observes, while the search runs,
    how many pairs are compared (``scored``).
    """
    if metric not in ASCENDING:
        raise ValueError(f"unknown metric: {metric}")
    queries = queries.filter(F.col("query_vector").isNotNull())
    small = small_queries(queries, query_keys, max_query_rows)
    if small is None:
        rows = max_query_rows or MAX_QUERY_ROWS
        return nearest_tiled(corpus, queries, metric, k, row_keys, query_keys, rows, nearer=nearer, counter=counter)
    return _ranked(_hits(corpus, small, metric, k, row_keys, nearer, counter=counter), metric, k)


def _hits(
    corpus: DataFrame, small: QuerySet, metric: str, k: int, row_keys: str | None, nearer: str | None,
    tile_rows: int = TILE_ROWS, counter: Observation | None = None,
) -> DataFrame:
    """The k best rows of each task for each query of one pass."""
    columns = ["vec_id", "embedding"] + ([F.col(row_keys).alias("keys")] if row_keys else [])
    if nearer:
        columns.append(F.col(nearer).alias("nearer"))
    if row_keys and not isinstance(corpus.schema[row_keys].dataType, ArrayType):
        corpus = _prune(corpus, row_keys, small)
    hits = corpus.filter(F.col("embedding").isNotNull()).select(*columns).mapInArrow(
        _scanner(small, metric, k, row_keys, tile_rows), HIT_SCHEMA.format(qtype=small.id_type)
    )
    if counter is not None:
        hits = hits.observe(counter, F.coalesce(F.sum("scored"), F.lit(0)).alias("scored"))
    return hits


def in_passes(queries: DataFrame, rows: int, run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``run`` over shares of ``queries`` that one pass can carry, all results read back as one table.

    Shares are cut by a hash of the row's number, planned at half the bound, and cut anew where one is larger still.
    """
    spark = queries.sparkSession
    queries = stage(queries.withColumn("_row", F.monotonically_increasing_id()), "queries")
    size = queries.agg(F.count("*").alias("n"), F.sum(F.size("query_vector")).alias("values")).first()
    passes = 2 * max(-(-size["n"] // rows), -(-8 * (size["values"] or 0) // MAX_QUERY_BYTES), 1)
    path = fresh_path(spark, "passes")
    place = F.pmod(F.xxhash64("_row"), F.lit(passes))
    result = None
    for number in range(passes):
        result = run(queries.filter(place == number).drop("_row"))
        write_once(result, f"{path}/pass-{number}")
    return spark.read.schema(result.schema).option("recursiveFileLookup", True).parquet(path)


def nearest_tiled(
    corpus: DataFrame,
    queries: DataFrame,
    metric: str = "l2",
    k: int = DEFAULT_K,
    row_keys: str | None = None,
    query_keys: str | None = None,
    query_rows: int | None = None,
    corpus_rows: int = TILE_ROWS,
    nearer: str | None = None,
    counter: Observation | None = None,
) -> DataFrame:
    """:func:`nearest` for a query side beyond the bound of a pass.

    Each pass scans the corpus once for its share of at most ``query_rows`` queries; inside a task ``corpus_rows`` rows are
    compared at a time. Neither number changes a row of the result. A ``counter`` sees the last pass alone.
    """
    rows = query_rows or MAX_QUERY_ROWS

    def run(share: DataFrame) -> DataFrame:
        small = small_queries(share, query_keys, rows)
        if small is None:
            return nearest_tiled(corpus, share, metric, k, row_keys, query_keys, rows, corpus_rows, nearer)
        return _ranked(_hits(corpus, small, metric, k, row_keys, nearer, corpus_rows, counter), metric, k)

    return in_passes(queries, rows, run)


def search_by_source(
    corpus: DataFrame, queries: DataFrame, source: str, metric: str = "l2", k: int = DEFAULT_K
) -> DataFrame:
    """Search inside one source; the filter runs before scoring, so k rows
    come back whenever the source has that many."""
    return nearest(corpus.filter(F.col("source") == source), queries, metric, k)


def search_own_source(
    corpus: DataFrame, queries: DataFrame, metric: str = "l2", k: int = DEFAULT_K
) -> DataFrame:
    """Scoped search for a batch: every query names its source in ``scope``."""
    scoped = queries.withColumn("_scope", F.array("scope"))
    return nearest(corpus, scoped, metric, k, row_keys="source", query_keys="_scope")


def with_documents(hits: DataFrame, documents: DataFrame, columns: list[str], key: str = "vec_id", doc_id: str = "doc_id") -> DataFrame:
    """Look up the documents of ranked hits; runs after top-k, so k rows per query.

    The hits are made once and counted. Their ids become a filter of the documents' scan, and the hits travel to it, so
    texts are read where an id is asked for and never shuffled. Beyond ``LOOKUP_IDS`` ids the filter is their range; hits
    beyond ``LOOKUP_ROWS`` rows are more than a task should hold, and Spark joins the tables its own way.
    """
    held = stage(hits, "hits")
    docs = documents.select(F.col(doc_id).alias(key), *columns).filter(F.col(key).isNotNull())
    known = held.select(key).filter(F.col(key).isNotNull())
    size = known.agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).first()
    if size["n"] <= LOOKUP_ROWS:
        ids = [row[key] for row in known.distinct().limit(LOOKUP_IDS + 1).collect()]
        asked = F.col(key).isin(ids) if len(ids) <= LOOKUP_IDS else F.col(key).between(size["low"], size["high"])
        docs, held = docs.filter(asked), F.broadcast(held)
    return docs.join(held, key).select(*hits.columns, *columns)


def previews(hits: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Display line of every hit: rank, source and a one-line preview."""
    label = F.coalesce(F.col(source), F.lit("unknown"))
    line = F.concat(F.col("rank").cast("string"), F.lit(". ["), label, F.lit("] "), X.preview(text))
    return hits.select("query_id", "rank", "vec_id", label.alias("source"), line.alias("line"))


def assemble_context(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """One context per query from ``hits(query_id, rank, source, text)``.

    A query without hits gets the fixed message. Each query holds k hits.
    """
    blocks = hits.select("query_id", "rank", R.context_block("rank", "source", "text").alias("block"))
    return _joined(blocks, queries, R.NO_RESULTS)


def assemble_short_context(hits: DataFrame, queries: DataFrame, limit: int = 500) -> DataFrame:
    """Context of the first ``limit`` characters of every hit, without headers."""
    blocks = hits.select("query_id", "rank", F.substring("text", 1, limit).alias("block"))
    return _joined(blocks, queries, "")


def _joined(blocks: DataFrame, queries: DataFrame, empty: str) -> DataFrame:
    joined = blocks.groupBy("query_id").agg(
        F.expr("listagg(block, '\n\n') WITHIN GROUP (ORDER BY rank)").alias("context"),
        F.count("*").alias("hits"),
    )
    return queries.select("query_id").join(joined, "query_id", "left").select(
        "query_id",
        F.coalesce("hits", F.lit(0)).cast("bigint").alias("hits"),
        F.coalesce("context", F.lit(empty)).alias("context"),
    )


def build_prompts(contexts: DataFrame, question: Column | str, opening: str = R.PROMPT_GROUNDED) -> DataFrame:
    return contexts.withColumn("prompt", R.prompt("context", question, opening))


def group_directions(vectors: DataFrame, group: str, query_id: str = "query_id") -> DataFrame:
    """Unit-length mean vector of every group, as queries: ``query_id, query_vector``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    held = vectors.select(group, array_to_vector("embedding").alias("_v"))
    means = held.groupBy(F.col(group).alias(query_id)).agg(
        vector_to_array(Summarizer.mean(F.col("_v"))).alias("_mean")
    )
    return means.select(query_id, normalized("_mean").alias("query_vector"))


Strategy = Callable[..., DataFrame]
STRATEGIES: dict[str, Strategy] = {}


def strategy(name: str) -> Callable[[Strategy], Strategy]:
    """Register a search strategy ``(corpus, queries, k) -> hits`` under a key."""

    def register(fn: Strategy) -> Strategy:
        STRATEGIES[name] = fn
        return fn

    return register


def search(name: str, corpus: DataFrame, queries: DataFrame, k: int = DEFAULT_K, **options) -> DataFrame:
    """Run the strategy registered under ``name``; an unknown key is an error."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown index type: {name}")
    return STRATEGIES[name](corpus, queries, k=k, **options)


@strategy("flat_l2")
def flat_l2(corpus, queries, k=DEFAULT_K, counter=None):
    return nearest(corpus, queries, "l2", k, counter=counter)


@strategy("flat_ip")
def flat_ip(corpus, queries, k=DEFAULT_K, counter=None):
    return nearest(corpus, queries, "cosine", k, counter=counter)
