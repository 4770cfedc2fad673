"""Quality of documents from random-indexing word vectors.

Every word has a sparse index vector of a few +1 and -1, drawn from its hash.
Adding up the index vectors of the neighbours a word has in all documents gives
its context vector. Words share a table of fixed size by hash, so a task holds
one table, sums are merged by row, and the merged table (``BUCKETS`` x ``DIM``
numbers) is sent to all tasks. A word counts in lower case without the marks
around it; the marks, a word that repeats the one before, and the case of a
word are words of their own. A document is the mean of the context vectors
and of the index vectors of its words. A two-layer network, trained on a
bounded sample of labelled rows, scores it; a temperature fitted on rows apart
from training makes scores probabilities.

Texts of any length are read whole; a document is a mean, whatever its length. The
table has ``BUCKETS`` rows at any size of the corpus, so words share rows the more
the larger the vocabulary is, and the statistics of rare words blur.

Documents without words, and null, pool to zeros and are scored like any other.
Rows that repeat an id stay rows of their own; a null id is never held out and
has no label. Without two labels to learn from, every score is the share of
label 1 (0.5 if there is none). An empty table gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, held_out, memory, mix64, per_batch, ship, stage, use_memory
from corpusloom.llm.learn import Network, sample

BUCKETS, DIM, ENTRIES, REACH = 1 << 14, 48, 4, 2
SAMPLE = 20_000
THRESHOLD = 0.3
WORDS_KEPT = 300_000
_SPLIT = re.compile(r"^(\W*)(.*?)(\W*)$", re.DOTALL)


def _bucket(word: str) -> int:
    # The first row of the table is for "no word".
    return 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


REPEATED = _bucket("\0again")


class Parts(dict):
    """Rows of a word: itself, then the marks around it and its case where they say something."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        # Most words have no marks, or one behind them; the pattern is slower.
        if word.isalnum():
            before, core, after = "", word, ""
        elif (last := word[-1]) != "_" and not last.isalnum() and word[:-1].isalnum():
            before, core, after = "", word[:-1], last
        else:
            before, core, after = _SPLIT.match(word).groups()
        rows = [_bucket(core.lower())] if core else []
        for mark, side in ((before, "\0<"), (after, "\0>")):
            if mark:
                rows.append(_bucket(side + mark[:4]))
        if len(core) > 1 and core.isupper():
            rows.append(_bucket("\0upper"))
        self[word] = found = tuple(rows)
        return found


_PARTS = memory("quality", Parts())


def rows_of(text: str | None) -> np.ndarray:
    """Table rows of the words of a text, in order."""
    words = (text or "").split()
    if not any(map(eq, words, islice(words, 1, None))):
        return np.array(list(chain.from_iterable(map(_PARTS.__getitem__, words))), dtype=np.int64)
    out: list[int] = []
    last = None
    for word in words:
        out += _PARTS[word]
        if word == last:
            out.append(REPEATED)
        last = word
    return np.array(out, dtype=np.int64)


def index_entries() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector, by hash; "no word" has none."""
    rows = np.arange(BUCKETS, dtype=np.uint64)
    hashed = np.stack([mix64(rows * np.uint64(ENTRIES) + np.uint64(entry + 1)) for entry in range(ENTRIES)], axis=1)
    sign = np.where(hashed >> np.uint64(63), 1.0, -1.0)
    sign[0] = 0
    return (hashed % np.uint64(DIM)).astype(np.int64), sign


def index_vectors() -> np.ndarray:
    place, sign = index_entries()
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    np.add.at(table, (np.arange(BUCKETS)[:, None], place), sign)
    return table


def context_table(docs: DataFrame) -> np.ndarray:
    """Context vectors of all rows of the table from all documents, as directions.

    A task counts neighbours in its own table; Spark adds the tables by row.
    """
    ship(docs.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sign = index_entries()
        sums = np.zeros(BUCKETS * DIM)
        for batch in stream:
            for some in batches_of(batch, 512, "text"):
                gap = np.zeros(REACH, dtype=np.int64)
                texts = [part for text in some.column("text").to_pylist() for part in (rows_of(text), gap)]
                rows = np.concatenate(texts) if texts else gap
                for reach in range(1, REACH + 1):
                    for a, b in ((rows[:-reach], rows[reach:]), (rows[reach:], rows[:-reach])):
                        for entry in range(ENTRIES):
                            sums += np.bincount(a * DIM + place[b, entry], weights=sign[b, entry], minlength=BUCKETS * DIM)
        sums = sums.reshape(BUCKETS, DIM)
        sums[0] = 0
        used = np.flatnonzero(np.abs(sums).sum(axis=1))
        names = ["row", *(f"x{k}" for k in range(DIM))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used.astype(np.int32)), *(pa.array(sums[used, k].astype(np.int64)) for k in range(DIM))], names=names
        )

    schema = "row int, " + ", ".join(f"x{k} bigint" for k in range(DIM))
    total = docs.select("text").mapInArrow(run, schema).groupBy("row").agg(*(F.sum(f"x{k}").alias(f"x{k}") for k in range(DIM)))
    table = np.zeros((BUCKETS, DIM), dtype=np.float32)
    found = total.toArrow()  # at most BUCKETS rows
    rows = found.column("row").to_numpy()
    for k in range(DIM):
        table[rows, k] = found.column(f"x{k}").to_numpy()
    length = np.sqrt((table.astype(np.float64) ** 2).sum(axis=1, keepdims=True))
    return (table / np.maximum(length, 1)).astype(np.float32)


def pooled(docs: DataFrame, context: np.ndarray) -> DataFrame:
    """(doc_id, vector): the pooled vectors of each document as bytes of 32-bit numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(context)  # BUCKETS x DIM numbers

    def make():
        use_memory("quality")

        table = np.concatenate([shared.value, index_vectors()], axis=1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                rows = rows_of(text)
                mean = table[rows].mean(axis=0) if len(rows) else np.zeros(table.shape[1], dtype=np.float32)
                out.append(mean.astype(np.float32).tobytes())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "vector"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, make, "doc_id bigint, vector binary", 256, "text")


def train(vectors: DataFrame, labels: DataFrame, column: str = "quality", bound: int = SAMPLE) -> Network:
    """A network from at most about ``bound`` labelled documents, none held out."""
    chosen = F.broadcast(sample(labels, column, bound))  # at most about ``bound`` rows of two numbers
    rows = vectors.join(chosen, "doc_id").groupBy("doc_id").agg(F.first("vector").alias("vector"), F.first("label").alias("label"))
    found = rows.orderBy("doc_id").toArrow()
    net = Network(2 * DIM)
    y = found.column("label").to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        raw = b"".join(found.column("vector").to_pylist())
        net.fit(np.frombuffer(raw, np.float32).reshape(len(y), -1).astype(np.float64), y)
    else:
        share = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        net.weights = [w * 0 for w in net.weights]
        net.weights[3] = net.weights[3] + np.log(share / (1 - share))
    return net


def score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text)."""
    vectors = stage(pooled(docs, context_table(docs)), "pooled")
    net = train(vectors, labels, bound=bound)

    def make():
        use_memory("quality")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = np.frombuffer(b"".join(batch.column("vector").to_pylist()), np.float32).reshape(batch.num_rows, -1)
            found = net.scores(rows.astype(np.float64))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

        return step

    scored = per_batch(vectors, make, "doc_id bigint, score double", 4096)
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, unchanged."""
    context = context_table(docs)
    net = train(pooled(_labelled(docs, labels, bound), context), labels, bound=bound)
    names = docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(context)

    def make():
        use_memory("quality")

        table = np.concatenate([shared.value, index_vectors()], axis=1)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = np.zeros((batch.num_rows, table.shape[1]))
            for at, text in enumerate(batch.column(names.index("text")).to_pylist()):
                rows = rows_of(text)
                if len(rows):
                    out[at] = table[rows].mean(axis=0)
            return batch.filter(pa.array(net.scores(out) >= threshold))

        return step

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return per_batch(docs, make, schema, 256, "text")


def _labelled(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """Documents of the labelled sample, met without moving texts."""
    chosen = sample(labels, "quality", bound).select(F.col("doc_id").alias("_chosen"))
    return docs.join(F.broadcast(chosen), F.col("doc_id").cast("bigint") == F.col("_chosen")).select("doc_id", "text")
