"""Ranked lexical search with Block-Max MaxScore over an inverted index in shards.

The index has a row per shard of texts: the shard's terms, its documents and,
for each term, the list of documents that hold it, cut into blocks of
``BLOCK`` postings. A block is compressed on its own (gaps and counts in one,
two or four bytes each); beside it stand its last document and, for each count
that occurs in it, the fewest terms of a document with that count. As a score
rises with the count and falls with the number of terms, these pairs give the
exact best score of the block under whatever statistics the corpus has later.

A search goes through the documents of a shard in windows. The lists of a
query, sorted by their best score, are parted by the score of the k-th document
so far: the weakest lists that cannot reach it together are not essential, and
only documents of essential lists are candidates. A candidate whose score so
far and the block maxima of the other lists stay below is rejected before any
block of those is unpacked; the others are looked up list by list, strongest
first, under the same test. Heaps are carried from shard to shard of a task and
those of the tasks are merged. Nothing is skipped that could be among the k
best, ties included: equal scores go to the smaller doc_id, null last.

Queries come from ``items``; those equal in item_id and text are one query, and
rows of one item_id with different texts are ranked apart. They are worked off
in blocks of bounded rows and bytes, each against the whole index. A null or
empty text has no terms: as a document it is counted nowhere and found never,
as an item it gives no rows. Repeated documents are documents of their own.
Texts of any length are read whole. Empty tables give no rows. Extra columns
are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import ship, stage

SHARD_BYTES, SHARD_ROWS = 24 << 20, 1 << 16
BLOCK, WINDOW = 64, 4096
QUERY_ROWS, QUERY_BYTES = 2048, 8 << 20
#: Fixed values of the score: weights in thousandths, and how counts and lengths enter it.
SCALE, GAIN, COUNT, LENGTH, SLOPE = 1000, 1_000_000_000, 1000, 12, 25
#: All ASCII characters but letters and digits part terms; A-Z become a-z.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
INDEX = (
    "shard bigint, docs bigint, total bigint, words binary, df binary, last binary, widths binary, n_pairs binary, "
    "pair_tf binary, pair_len binary, lists binary, ids binary, nulls binary, lengths binary"
)
HITS = "query int, doc_id bigint, score bigint"


def terms_of(body: bytes) -> list[bytes]:
    """Terms of a text in UTF-8."""
    return body.translate(PLAIN).split()


class Numbers(dict):
    """Numbers of terms in the order in which they are met."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


def _width(most: np.ndarray) -> np.ndarray:
    return np.where(most < 1 << 8, 1, np.where(most < 1 << 16, 2, 4)).astype(np.int64)


def _write(out: np.ndarray, at: np.ndarray, values: np.ndarray, width: np.ndarray) -> None:
    """Little-endian ``values`` of ``width`` bytes each, to byte ``at`` of ``out``."""
    for byte in range(4):
        some = np.flatnonzero(width > byte) if byte else slice(None)
        out[at[some] + byte] = values[some] >> (8 * byte) & 255


def shard_row(shard: int, known: Numbers, codes: list[np.ndarray], ids: list[int | None]) -> tuple:
    """The index of documents whose terms are ``codes``."""
    nulls = np.array([doc_id is None for doc_id in ids], dtype=bool)
    plain = np.array([doc_id or 0 for doc_id in ids], dtype=np.int64)
    order = np.lexsort((plain, nulls))
    lengths = np.array([len(own) for own in codes], dtype=np.int64)
    place = np.empty(len(order), dtype=np.int64)
    place[order] = np.arange(len(order))
    key = np.concatenate([np.zeros(0, dtype=np.uint32), *codes]).astype(np.int64) << 32
    key |= np.repeat(place, lengths)
    key.sort()
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    tf = np.diff(np.append(head, len(key)))
    key = key[head]
    term, doc = key >> 32, key & 0xFFFFFFFF
    df = np.bincount(term, minlength=len(known))
    lengths = lengths[order]
    begin = np.cumsum(df) - df
    inside = np.arange(len(doc)) - np.repeat(begin, df)
    fresh = inside % BLOCK == 0
    head = np.flatnonzero(fresh)
    block = np.cumsum(fresh) - 1
    size = np.diff(np.append(head, len(doc)))
    gap = doc.copy()
    gap[1:] -= np.where(inside[1:] > 0, doc[:-1], 0)
    wide, thick = _width(np.maximum.reduceat(gap, head)), _width(np.maximum.reduceat(tf, head))
    # Gaps of a block, then its counts.
    begins = np.cumsum(size * (wide + thick)) - size * (wide + thick)
    lists = np.zeros(int((size * (wide + thick)).sum()), dtype=np.uint8)
    step = np.arange(len(doc)) - head[block]
    _write(lists, begins[block] + step * wide[block], gap, wide[block])
    _write(lists, begins[block] + size[block] * wide[block] + step * thick[block], tf, thick[block])
    by = np.lexsort((lengths[doc], tf, block))
    first = np.ones(len(by), dtype=bool)
    first[1:] = (block[by][1:] != block[by][:-1]) | (tf[by][1:] != tf[by][:-1])
    pairs = by[first]
    return (
        shard, int((lengths > 0).sum()), int(lengths.sum()), b"\n".join(known), df.astype("<u4").tobytes(),
        doc[head + size - 1].astype("<u4").tobytes(), (wide * 8 + thick).astype("u1").tobytes(),
        np.bincount(block[pairs], minlength=len(head)).astype("u1").tobytes(), tf[pairs].astype("<u4").tobytes(),
        lengths[doc[pairs]].astype("<u4").tobytes(), lists.tobytes(), plain[order].astype("<i8").tobytes(),
        nulls[order].astype("u1").tobytes(), lengths.astype("<u4").tobytes(),
    )


def build(docs: DataFrame, shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index of ``docs`` (doc_id, text), written to the shared folder. Documents without terms are left out."""
    ship(docs.sparkSession)
    names = [part.split()[0] for part in INDEX.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.binary()] * 11

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        known, codes, ids, held = Numbers(), [], [], 0

        def flush() -> pa.RecordBatch:
            row = shard_row(shard, known, codes, ids)
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in stream:
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = body.as_py()
                found = terms_of(raw)
                if not found:
                    continue
                codes.append(np.fromiter(map(known.__getitem__, found), dtype=np.uint32, count=len(found)))
                ids.append(doc_id)
                held += len(raw)
                if held >= shard_bytes or len(ids) >= shard_rows:
                    yield flush()
                    shard, known, codes, ids, held = shard + 1, Numbers(), [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("body"))
    return stage(rows.where("body IS NOT NULL").mapInArrow(run, INDEX), "lexical-index")


class Stats:
    """What a score depends on besides the count and the document."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms

    def weight(self, df: int) -> int:
        return math.floor(SCALE * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def impact(self, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
        m = 100 - SLOPE + SLOPE * length * self.n_docs // self.n_terms
        return GAIN * tf // (COUNT * tf + LENGTH * m)


class Postings:
    """The list of one term in a shard."""

    def __init__(self, shard: Shard, number: int, weight: int):
        a, b = shard.first[number], shard.first[number + 1]
        self.shard, self.weight, self.begin = shard, weight, a
        self.last, self.size = shard.last[a:b], shard.size[a:b]
        self.best = shard.best[a:b] * weight
        self.most = int(self.best.max())
        #: The block unpacked last: windows and candidates come in order, so the next one often falls in it too.
        self.held: tuple[int, tuple[np.ndarray, np.ndarray]] | None = None

    def limits(self, docs: np.ndarray) -> np.ndarray:
        """The best score each document can have here, from the maxima of blocks alone."""
        block = np.searchsorted(self.last, docs)
        return np.where(block < len(self.best), self.best[np.minimum(block, len(self.best) - 1)], 0)

    def unpack(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        if self.held is not None and self.held[0] == block:
            return self.held[1]
        shard, at = self.shard, self.begin + block
        shard.unpacked += 1
        size, wide, thick, place = int(self.size[block]), int(shard.wide[at]), int(shard.thick[at]), int(shard.place[at])
        gap = np.frombuffer(shard.lists, f"<u{wide}", size, place)
        tf = np.frombuffer(shard.lists, f"<u{thick}", size, place + size * wide).astype(np.int64)
        before = int(self.last[block - 1]) if block else 0
        self.held = block, (np.cumsum(gap, dtype=np.int64) + before, tf)
        return self.held[1]

    def scores(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of ``blocks`` and their scores."""
        found = [self.unpack(block) for block in blocks.tolist()]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, tf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        return docs, self.weight * self.shard.stats.impact(tf, self.shard.lengths[docs])

    def inside(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` to before ``high`` and their scores."""
        a, b = np.searchsorted(self.last, [low, high])
        docs, scores = self.scores(np.arange(a, min(b + 1, len(self.last))))
        held = (docs >= low) & (docs < high)
        return docs[held], scores[held]

    def of(self, docs: np.ndarray) -> np.ndarray:
        """The scores of ``docs`` (ascending), 0 for those not in the list; unpacks only the blocks they fall in."""
        block = np.unique(np.searchsorted(self.last, docs))
        held, scores = self.scores(block[block < len(self.last)])
        if not len(held):
            return np.zeros(len(docs), dtype=np.int64)
        at = np.minimum(np.searchsorted(held, docs), len(held) - 1)
        return np.where(held[at] == docs, scores[at], 0)


class Shard:
    """A row of the index opened for search. ``unpacked`` counts the blocks that were."""

    def __init__(self, row: dict, stats: Stats):
        self.stats, self.lists, self.unpacked = stats, row["lists"], 0
        self.numbers = {term: number for number, term in enumerate(row["words"].split(b"\n"))}
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        blocks = -(-df // BLOCK)
        self.first = np.concatenate([[0], np.cumsum(blocks)])
        self.last = np.frombuffer(row["last"], "<u4").astype(np.int64)
        self.size = np.full(len(self.last), BLOCK)
        self.size[self.first[1:] - 1] = df - (blocks - 1) * BLOCK
        widths = np.frombuffer(row["widths"], "u1").astype(np.int64)
        self.wide, self.thick = widths // 8, widths % 8
        taken = self.size * (self.wide + self.thick)
        self.place = np.cumsum(taken) - taken
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.ids, self.nulls = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["nulls"], "u1").astype(bool)
        pairs = np.frombuffer(row["n_pairs"], "u1").astype(np.int64)
        tf, length = (np.frombuffer(row[name], "<u4").astype(np.int64) for name in ("pair_tf", "pair_len"))
        self.best = np.maximum.reduceat(stats.impact(tf, length), np.cumsum(pairs) - pairs)

    def search(self, query: dict[bytes, int], heap: Heap, window: int = WINDOW) -> None:
        """Offer the documents of this shard that may be among the best of ``query`` (weight of each term) to ``heap``."""
        lists = [Postings(self, self.numbers[t], w) for t, w in query.items() if w > 0 and t in self.numbers]
        lists.sort(key=lambda own: own.most)
        reach = np.cumsum([own.most for own in lists])
        for low in range(0, len(self.lengths), window):
            least = max(heap.least, 1)
            # The weakest lists that stay below the k-th score together.
            idle = int(np.searchsorted(reach, least))
            if idle == len(lists):
                return
            high = min(low + window, len(self.lengths))
            score, met = np.zeros(high - low, dtype=np.int64), np.zeros(high - low, dtype=bool)
            for own in lists[idle:]:
                docs, scores = own.inside(low, high)
                score[docs - low] += scores
                met[docs - low] = True
            docs = np.flatnonzero(met) + low
            score = score[docs - low]
            limits = [own.limits(docs) for own in lists[:idle]]
            rest = sum(limits, np.zeros(len(docs), dtype=np.int64))
            for at in range(idle - 1, -1, -1):
                kept = score + rest >= least
                docs, score, rest, limits = docs[kept], score[kept], rest[kept], [limit[kept] for limit in limits[: at + 1]]
                if not len(docs):
                    break
                # Only candidates whose block has something to give are looked up.
                rest = rest - limits[at]
                score = score + lists[at].of(docs)
            kept = score >= least
            heap.offer(score[kept], self.nulls[docs[kept]], self.ids[docs[kept]])


class Heap:
    """The k best (score, doc_id) so far; ``least`` is the score that a document must reach to be among them."""

    def __init__(self, k: int):
        self.k, self.least = k, 0
        self.score, self.nulls, self.ids = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def offer(self, score: np.ndarray, nulls: np.ndarray, ids: np.ndarray) -> None:
        if not len(score):
            return
        score, nulls, ids = (np.concatenate(pair) for pair in ((self.score, score), (self.nulls, nulls), (self.ids, ids)))
        order = np.lexsort((ids, nulls, -score))[: self.k]
        self.score, self.nulls, self.ids = score[order], nulls[order], ids[order]
        if len(order) == self.k:
            self.least = int(self.score[-1])


def _block_hits(index: DataFrame, texts: list[bytes], stats: Stats, k: int) -> DataFrame:
    """(query, doc_id, score): the k best documents of each task for each of ``texts``."""
    queries = [Counter(terms_of(text)) for text in texts]
    numbers = {term: number for number, term in enumerate(dict.fromkeys(t for own in queries for t in own))}

    def count(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(numbers), dtype=np.int64)
        for batch in stream:
            for words, df in zip(batch.column(0), batch.column(1), strict=True):
                held = np.frombuffer(df.as_py(), "<u4")
                for at, term in enumerate(words.as_py().split(b"\n")):
                    number = numbers.get(term)
                    if number is not None:
                        total[number] += held[at]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["number", "df"])

    counted = index.select("words", "df").mapInArrow(count, "number int, df bigint")
    df = {row["number"]: row["df"] for row in counted.groupBy("number").agg(F.sum("df").alias("df")).collect()}
    weighed = [
        {term: times * stats.weight(df[numbers[term]]) for term, times in own.items() if numbers[term] in df} for own in queries
    ]

    def find(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = [Heap(k) for _ in weighed]
        for batch in stream:
            for at in range(batch.num_rows):
                shard = Shard(batch.slice(at, 1).to_pylist()[0], stats)
                for query, heap in zip(weighed, heaps, strict=True):
                    shard.search(query, heap)
        sizes = [len(heap.ids) for heap in heaps]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat(np.arange(len(heaps), dtype=np.int32), sizes)),
                pa.array(np.concatenate([heap.ids for heap in heaps]), mask=np.concatenate([heap.nulls for heap in heaps])),
                pa.array(np.concatenate([heap.score for heap in heaps])),
            ],
            names=["query", "doc_id", "score"],
        )

    return index.mapInArrow(find, HITS)


def search(index: DataFrame, items: DataFrame, k: int = 20, query_rows: int = QUERY_ROWS, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of ``index`` for every item (item_id, text), score above 0."""
    spark = index.sparkSession
    totals = index.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    kind = items.schema["item_id"].dataType
    asked = items.select("item_id", F.col("text").cast("string").cast("binary").alias("body")).where("octet_length(body) > 0").distinct()
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0)).alias("bytes")).first()
    # Hashed blocks differ in size, so more than one are planned at half the bound.
    blocks = max(-(-size["n"] // query_rows), -(-size["bytes"] // query_bytes))
    blocks = 2 * blocks if blocks > 1 else blocks
    found = None
    for block in range(blocks if totals["docs"] else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)) == block).collect()
        if not rows:
            continue
        named = spark.createDataFrame([(at, row["item_id"]) for at, row in enumerate(rows)], f"query int, item_id {kind.simpleString()}")
        hits = _block_hits(index, [bytes(row["body"]) for row in rows], Stats(totals["docs"], totals["total"]), k)
        best = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
        ranked = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        # As many rows as the block has queries.
        part = ranked.join(F.broadcast(named), "query").select("item_id", "rank", "doc_id", "score")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return found
