"""Near-duplicate documents by fast similarity sketching.

A document's set holds the 64-bit hashes of its word shingles. Its sketch has
``t`` coordinates, filled in rounds: in round i of the first t every shingle is
placed into one bin by the round's hash, in round t + i every shingle into bin
i; a bin keeps the least (round, hash). Rounds end when all bins are filled, so
a document of more than t log t shingles takes one or two, and after 2t rounds
no bin can be empty. Coordinates agree with a probability that is the
similarity, with concentration like independent ones.

Bands of coordinates make keys. Documents that share a key are joined to the
least of them, and connected parts of these stars are candidate families: each
pair that shares a band lies in one. Within a family all pairs are compared on
their full sets, in blocks whose pairs are tasks of their own; a block pair
returns a spanning forest of its confirmed links, never the links. Components
of the forests are the groups.

With 48 bands of 6 a pair at the least similarity of 0.8 shares no band with
probability 5e-7, and pairs below 0.2 share one with 0.3 %. Exact copies of a
set are one node from the start. Families cost the square of their number of
different sets, in parallel tasks.

Texts of any length are read whole, and their full sets compared.

Words are runs of characters other than space and the five control characters
that ASCII counts as white space, A-Z in lower case. A document of fewer words
than a shingle has one, all its words; one without words, or null, has an empty
set and is linked with nothing. Rows that repeat an id stay rows of their own;
a null id is larger than all others when the smallest is sought. Extra columns
are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, memory, mix64, parts_for, per_batch, ship, stage, use_memory
from corpusloom.llm.graph import components

BANDS, ROWS, BLOCK = 48, 6, 256
WORDS_KEPT = 200_000
_U = np.uint64
_FULL = _U(0xFFFFFFFFFFFFFFFF)


class Words(dict):
    """64-bit hashes of words met so far."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_WORDS = memory("minhash", Words())


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, dtype=_U)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), dtype=_U, count=len(words))
    n = len(hashes)
    span = min(width, n)
    total = np.full(n - span + 1, _U(span), dtype=_U)
    for at in range(span):
        total = total * _U(0x9E3779B97F4A7C15) + mix64(hashes[at : at + n - span + 1])
    return np.unique(mix64(total))


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of non-empty sets, one row each."""
    n = len(sets)
    values = np.full((n, t), _FULL, dtype=_U)
    open_ = np.arange(n)
    items = np.concatenate(sets) if n else np.empty(0, dtype=_U)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    flat = values.reshape(-1)
    for number in range(2 * t):
        if not len(open_):
            break
        hashed = mix64(items ^ _U((number + 1) * 0xD1342543DE82EF95 & 0xFFFFFFFFFFFFFFFF))
        low = (_U(number) << _U(40)) | (hashed & _U(0xFFFFFFFFFF))
        bins = (hashed >> _U(40)) % _U(t) if number < t else _U(number - t)
        np.minimum.at(flat, owner * t + bins.astype(np.int64), low)
        full = (values[open_] != _FULL).all(axis=1)
        if full.any():
            done = np.zeros(n, dtype=bool)
            done[open_[full]] = True
            keep = ~done[owner]
            items, owner, open_ = items[keep], owner[keep], open_[~full]
    return values


def band_keys(values: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band of each sketch; keys of different bands differ."""
    parts = values[:, : bands * rows].reshape(len(values), bands, rows)
    key = np.broadcast_to(np.arange(bands, dtype=_U) + _U(1), (len(values), bands)).copy()
    for at in range(rows):
        key = mix64(key * _U(0x9E3779B97F4A7C15) + parts[:, :, at])
    return key


def signatures(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, th, n_shingles, d1, d2, bands): digest of the set and band keys; nulls for an empty set."""

    def make():
        use_memory("minhash")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(text, width) for text in batch.column("text").to_pylist()]
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = np.flatnonzero(sizes)
            keys = band_keys(sketches([sets[at] for at in full], bands * rows), bands, rows)
            keys = np.ascontiguousarray(keys).view(np.int64)
            digests = np.zeros((len(sets), 2), dtype=np.int64)
            for at in full:
                raw = xxhash.xxh3_128_digest(sets[at].tobytes())
                digests[at] = np.frombuffer(raw, dtype=np.int64)
            empty = sizes == 0
            offsets = np.concatenate([[0], np.cumsum(np.where(empty, 0, bands))]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("th"), pa.array(sizes),
                    pa.array(digests[:, 0], mask=empty), pa.array(digests[:, 1], mask=empty),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.reshape(-1))),
                ],
                names=["doc_id", "th", "n_shingles", "d1", "d2", "bands"],
            )

        return step

    schema = "doc_id bigint, th bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>"
    return per_batch(_keyed(docs), make, schema, 256, "text")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("th"), "text")


def families(nodes: DataFrame) -> DataFrame:
    """(node, cluster): parts connected by shared bands; nodes that share none are left out."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    met = members.groupBy("key").agg(F.min("node").alias("lead"), F.max("node").alias("last")).where("lead < last")
    stars = members.join(met.select("key", "lead"), "key").where("node <> lead")
    return components(stars.select(F.col("node").alias("a"), F.col("lead").alias("b"))).withColumnRenamed("component", "cluster")


def shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of two lists of sets, by products of 0/1 matrices over slabs of shingles."""
    items = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, place, times = np.unique(items, return_inverse=True, return_counts=True)
    common = times > 1
    number = np.cumsum(common) - 1
    keep = common[place]
    place, owner = number[place[keep]], owner[keep]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=np.float64)
    total, slab = int(common.sum()), 4096
    for low in range(0, total, slab):
        a, b = np.searchsorted(place, [low, low + slab])
        dense = np.zeros((len(left) + len(right), min(slab, total - low)), dtype=np.float32)
        dense[owner[a:b], place[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def forest(linked: np.ndarray) -> np.ndarray:
    """Least index reachable from each, by a symmetric boolean matrix."""
    n = len(linked)
    label = np.arange(n)
    reach = linked | np.eye(n, dtype=bool)
    while True:
        least = np.where(reach, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            return label
        label = least


def block_links(nodes: list[int], sets: list[np.ndarray], blocks: list[int], percent: int) -> list[tuple[int, int]]:
    """Forest edges of the links within a block, or between two blocks."""
    left = [at for at, block in enumerate(blocks) if block == blocks[0]]
    right = [at for at, block in enumerate(blocks) if block != blocks[0]] or left
    both = shared([sets[at] for at in left], [sets[at] for at in right])
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    ok = 100 * both >= percent * union
    linked = np.zeros((len(nodes), len(nodes)), dtype=bool)
    linked[np.ix_(left, right)] = ok
    label = forest(linked | linked.T)
    return [(nodes[at], nodes[root]) for at, root in enumerate(label.tolist()) if at != root]


def confirmed(docs: DataFrame, nodes: DataFrame, clusters: DataFrame, width: int, percent: int, block: int) -> DataFrame:
    """Forest edges (a, b) of all links within the families, found on the full sets of their texts."""
    spark = docs.sparkSession
    ship(spark)
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb"))
    wanted = clusters.join(sizes, "cluster").join(nodes.select("node", "rep_id", "rep_th"), "node").select(
        "cluster", "node", "rep_id", "rep_th", "nb", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int").alias("blk")
    )
    texts = _keyed(docs)
    found = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("th") == F.col("rep_th")))

    def make():
        use_memory("minhash")

        seen: set[int] = set()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch | None:
            # Rows that repeat a document bring its set once a task.
            nodes_ = batch.column("node").to_pylist()
            fresh = [at for at, node in enumerate(nodes_) if not (node in seen or seen.add(node))]
            if not fresh:
                return None
            some = batch.take(pa.array(fresh))
            sets = [shingles(text, width).tobytes() for text in some.column("text").to_pylist()]
            names = ["cluster", "node", "nb", "blk"]
            return pa.RecordBatch.from_arrays([*(some.column(n) for n in names), pa.array(sets, pa.binary())], names=[*names, "s"])

        return step

    own = per_batch(
        found.select("cluster", "node", "nb", "blk", "text"), make, "cluster bigint, node bigint, nb int, blk int, s binary", 256, "text"
    )
    sent = own.select(
        "cluster", "node", "blk", "s", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    ).select("cluster", F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "blk", "node", "s")
    dealt = sent.repartition(parts_for(texts), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "blk", "node")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes_, sets, blocks = None, [], [], []
        out: list[tuple[int, int]] = []

        def batch_of(edges: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], names=["a", "b"]
            )

        for batch in stream:
            for some in batches_of(batch, 1024, "s"):
                columns = [some.column(name).to_pylist() for name in ("cluster", "i", "j", "blk", "node", "s")]
                for cluster, i, j, blk, node, raw in zip(*columns, strict=True):
                    if key != (cluster, i, j):
                        if len(nodes_) > 1:
                            out += block_links(nodes_, sets, blocks, percent)
                        key, nodes_, sets, blocks = (cluster, i, j), [], [], []
                    if not nodes_ or nodes_[-1] != node:
                        nodes_.append(node)
                        sets.append(np.frombuffer(raw, dtype=_U))
                        blocks.append(blk)
            if len(out) > 10_000:
                yield batch_of(out)
                out = []
        if len(nodes_) > 1:
            out += block_links(nodes_, sets, blocks, percent)
        if out:
            yield batch_of(out)

    return dealt.mapInArrow(run, "a bigint, b bigint")


def groups(
    docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK
) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, one) per row of ``docs`` (doc_id, text).

    Links are pairs of sets with 100 * intersection >= ``percent`` * union.
    ``th`` is the hash of the text, ``one`` marks the copy of a group to keep:
    the least (doc_id, th). Rows equal in both are marked alike.
    """
    drawn = stage(signatures(docs, width, bands, rows), "sketches")
    copy = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "th")
    nodes = stage(
        drawn.where("d1 IS NOT NULL").groupBy("d1", "d2")
        .agg(F.min(copy).alias("least"), F.first("bands").alias("bands"))
        .select(
            "d1", "d2", F.col("least.doc_id").alias("rep_id"), F.col("least.th").alias("rep_th"), "bands",
            F.monotonically_increasing_id().alias("node"),
        ),
        "sets",
    )
    clusters = stage(families(nodes), "families")
    parts = components(confirmed(docs, nodes, clusters, width, percent, block))
    least = F.min(F.struct(F.col("rep_id").isNull().alias("z"), F.col("rep_id").alias("doc_id"), F.col("rep_th").alias("th")))
    linked = parts.join(nodes.select("node", "rep_id", "rep_th"), "node")
    heads = linked.groupBy("component").agg(least.alias("head"))
    of = linked.select("node", "component").join(heads, "component").select("node", "head")
    known = nodes.select("node", "d1", "d2", "rep_id", "rep_th").join(of, "node", "left").select(
        "d1", "d2",
        F.coalesce("head.doc_id", "rep_id").alias("component_id"), F.coalesce("head.th", "rep_th").alias("one_th"),
    )
    return drawn.select("doc_id", "th", "n_shingles", "d1", "d2").join(known, ["d1", "d2"], "left").select(
        "doc_id", "th", "n_shingles",
        F.when(F.col("d1").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(F.col("d1").isNull(), True)
        .otherwise(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("one_th"))).alias("one"),
    )


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each group; rows equal in id and text are one document."""
    from pyspark.sql import Window

    kept = groups(docs, **settings).where("one").select(F.col("doc_id").alias("__one_id"), F.col("th").alias("__one_text")).distinct()
    marked = docs.withColumn("__text_hash", F.xxhash64("text"))
    met = marked.join(kept, F.col("doc_id").cast("bigint").eqNullSafe(F.col("__one_id")) & (F.col("__text_hash") == F.col("__one_text")))
    first = F.row_number().over(Window.partitionBy("__one_id", "__one_text").orderBy("__one_text"))
    return met.withColumn("__copy", first).where("__copy = 1").select(*(docs[name] for name in docs.columns))
