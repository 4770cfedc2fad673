"""Toxicity by multiple-instance learning.

A document is a bag of sentences, and only the bag has a label. A sentence is
scored by a logistic function of the word features it holds, and a document's
score is their noisy-or: the chance that at least one sentence is toxic. The
weights are trained through the noisy-or from document labels, so they also
say which sentences offend.

Features are lower-case words and their heads of three to five letters, hashed
to a table of fixed size. From the labelled sample, features are counted by label in
all tasks and merged by row; those that part the labels most become the inputs.
The sample of labelled rows is bounded, and so are the inputs that its sentences
hold together; its documents are met by a broadcast of its ids, no text moves.
Texts of any length are read whole, sentence by sentence.

Empty and null texts have one empty sentence. Rows that repeat an id stay rows
of their own; a null id is never held out and has no label. Without both labels
every score is the share of label 1 (0.5 if there is none). An empty table gives
no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, held_out, memory, per_batch, ship, stage, use_memory
from corpusloom.llm.learn import sample, sigmoid

FEATURES = 1 << 18
INPUTS = 1024
SAMPLE = 30_000
#: Inputs that the sentences of the sample hold together at most: what the driver fits is flat arrays of this length.
ENTRIES = 1 << 23
THRESHOLD = 0.5
WORDS_KEPT = 400_000
SENTENCE = re.compile(r"[^.!?\n]+[.!?]*\n?|[.!?\n]+")
WORD = re.compile(r"[^\W_]+")
HEADS = (3, 4, 5)


def sentences(text: str) -> list[tuple[int, int]]:
    """Ranges of the sentences; together they cover the text."""
    return [m.span() for m in SENTENCE.finditer(text)] or [(0, 0)]


def rows_of(word: str) -> tuple[int, ...]:
    """Table rows of a word in lower case: the word, and its heads."""
    names = [f"w{word}", *[f"{n}{word[:n]}" for n in HEADS if len(word) > n]]
    return tuple([zlib.crc32(name.encode("utf-8", "surrogatepass")) % FEATURES for name in names])


class Features(dict):
    """Table rows of the words met so far."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = rows_of(word)
        return found


_FEATURES = memory("toxicity", Features())


def features(sentence: str) -> set[int]:
    out: set[int] = set()
    for word in set(WORD.findall(sentence.lower())):
        out.update(_FEATURES[word])
    return out


def _sampled(docs: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, label, text) of the labelled sample; its ids, about ``bound`` at most, are broadcast."""
    chosen = sample(labels, column, bound).select(F.col("doc_id").alias("id"), "label")
    return docs.join(F.broadcast(chosen), F.col("doc_id").cast("bigint") == F.col("id")).select("id", "label", "text")


def informative(bags: DataFrame, inputs: int) -> tuple[np.ndarray, float]:
    """The features that part the labels most, and the share of label 1."""
    ship(bags.sparkSession)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((2, FEATURES), dtype=np.int32)
        rows = np.zeros(2, dtype=np.int64)
        for batch in stream:
            for some in batches_of(batch, 256, "text"):
                for label, text in zip(some.column("label").to_pylist(), some.column("text").to_pylist(), strict=True):
                    rows[label] += 1
                    held[label, list(features(text or ""))] += 1
        used = np.flatnonzero(held.sum(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.append(used, -1).astype(np.int32)),
                *(pa.array(np.append(held[k, used], rows[k]).astype(np.int64)) for k in (0, 1)),
            ],
            names=["row", "n0", "n1"],
        )

    found = bags.select("label", "text").mapInArrow(run, "row int, n0 bigint, n1 bigint").groupBy("row").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    ).toArrow()  # at most FEATURES + 1 rows
    row, n0, n1 = (found.column(name).to_numpy() for name in ("row", "n0", "n1"))
    all0, all1 = int(n0[row < 0].sum()), int(n1[row < 0].sum())
    keep = row >= 0
    row, n0, n1 = row[keep], n0[keep], n1[keep]
    if not all0 or not all1:
        return np.empty(0, dtype=np.int64), (all1 / (all0 + all1) if all0 + all1 else 0.5)
    # Log-likelihood ratio of the feature among the two labels.
    held, total = n0 + n1, all0 + all1
    def part(observed, expected):
        return np.where(observed > 0, observed * np.log(np.maximum(observed, 1e-9) / np.maximum(expected, 1e-9)), 0)
    gain = part(n1, held * all1 / total) + part(n0, held * all0 / total)
    gain += part(all1 - n1, (total - held) * all1 / total) + part(all0 - n0, (total - held) * all0 / total)
    order = np.lexsort((row, -gain))[:inputs]
    return np.sort(row[order]).astype(np.int64), all1 / total


class Weighed(dict):
    """Rows with a weight of a word in lower case; most words have none."""

    def __init__(self, weights: dict[int, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = found = tuple([row for row in rows_of(word) if row in self.weights])
        return found


class Model:
    """Weights of the inputs and a bias; ``scores`` of sentences, ``document`` by noisy-or."""

    def __init__(self, inputs: np.ndarray, weights: np.ndarray, bias: float, constant: float | None = None):
        self.weights = dict(zip(inputs.tolist(), weights.tolist(), strict=True))
        self.bias, self.constant = bias, constant
        self.words = Weighed(self.weights)

    def scores(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans = sentences(text)
        sums = []
        for a, b in spans:
            rows = {row for found in map(self.words.__getitem__, WORD.findall(text[a:b].lower())) if found for row in found}
            sums.append(sum(self.weights[row] for row in sorted(rows)))
        return spans, sigmoid(self.bias + np.array(sums))

    def document(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        return float(1 - np.exp(np.log1p(-np.minimum(self.scores(text)[1], 1 - 1e-12)).sum()))

    def __reduce__(self):
        inputs = np.array(list(self.weights), dtype=np.int64)
        return Model, (inputs, np.array(list(self.weights.values())), self.bias, self.constant)


def fit(
    entry: np.ndarray, sentence: np.ndarray, owner: np.ndarray, labels: np.ndarray, inputs: int, blank: np.ndarray,
    epochs: int = 150, rate: float = 0.1, decay: float = 1e-4,
) -> tuple[np.ndarray, float]:
    """Weights and bias that make the noisy-or of each bag's sentences likely, by full-batch Adam.

    ``entry`` are inputs, ``sentence`` numbers the sentence of each, ``owner`` the bag of each sentence; ``blank`` counts the
    sentences of each bag without any input.
    """
    count = len(owner)
    w, b = np.zeros(inputs), -6.0
    first, second = np.zeros(inputs + 1), np.zeros(inputs + 1)
    for step in range(1, epochs + 1):
        p = sigmoid(b + np.bincount(sentence, weights=w[entry], minlength=count))
        empty = float(sigmoid(np.array(b)))
        none = np.bincount(owner, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=len(labels))
        none += blank * np.log1p(-min(empty, 1 - 1e-9))
        whole = np.clip(1 - np.exp(none), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: p for clean bags, -p (1 - P) / P for toxic ones.
        pull = np.where(labels == 1, -(1 - whole) / whole, 1.0) / len(labels)
        slope = p * pull[owner]
        grad = np.append(
            np.bincount(entry, weights=slope[sentence], minlength=inputs) + decay * w, slope.sum() + empty * (blank * pull).sum()
        )
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def train(
    docs: DataFrame, labels: DataFrame, column: str = "toxic", bound: int = SAMPLE, inputs: int = INPUTS, entries: int = ENTRIES
) -> Model:
    """A model from at most about ``bound`` labelled documents, none held out, fewer if their sentences have more than
    ``entries`` inputs together: both are samples by a hash of the id."""
    bags = _sampled(docs, labels, column, bound)
    chosen, share_of_ones = informative(bags, inputs)
    if not len(chosen):
        return Model(chosen, np.empty(0), 0.0, share_of_ones)

    def make():
        use_memory("toxicity")

        number = {row: at for at, row in enumerate(chosen.tolist())}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                held = [sorted(number[row] for row in features(text[a:b]) if row in number) for a, b in sentences(text)]
                # Sentences without an input are alike: their number goes first.
                out.append([[sum(not h for h in held)], *(h for h in held if h)])
            return pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("label"), pa.array(out, pa.list_(pa.list_(pa.int32())))], names=["id", "label", "bag"]
            )

        return step

    held = stage(per_batch(bags, make, "id bigint, label int, bag array<array<int>>", 256, "text"), "bags")
    size = F.aggregate("bag", F.lit(0).cast("bigint"), lambda total, own: total + F.size(own))
    share = entries / max(1, held.agg(F.sum(size)).first()[0] or 0)
    if share < 1:
        held = held.where(F.pmod(F.xxhash64(F.lit(29), "id"), F.lit(1_000_000)) < math.floor(share * 1_000_000))
    found = held.orderBy("id").toArrow()
    if not found.num_rows:
        return Model(chosen[:0], np.empty(0), 0.0, share_of_ones)
    # Flat arrays: sentences of bags, inputs of sentences. The first of a bag has the number of those without inputs.
    lists = found.column("bag").combine_chunks()
    starts = lists.offsets.to_numpy()
    own = lists.flatten()
    edges = own.offsets.to_numpy()
    lengths = np.diff(edges)
    heads = np.zeros(len(lengths), dtype=bool)
    heads[starts[:-1] - starts[0]] = True
    flat = own.flatten().to_numpy()
    blank = flat[edges[:-1][heads] - edges[0]].astype(float)
    sentence = np.repeat((np.cumsum(~heads) - 1).astype(np.int32), np.where(heads, 0, lengths))
    entry = flat[np.repeat(~heads, lengths)]
    owner = np.repeat(np.arange(len(blank), dtype=np.int32), np.diff(starts) - 1)
    w, b = fit(entry, sentence, owner, found.column("label").to_numpy(), len(chosen), blank)
    return Model(chosen, w, b)


def score(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text)."""
    model = train(docs, labels, bound=bound)

    def make():
        use_memory("toxicity")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [model.document(text or "") for text in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, make, "doc_id bigint, score double", 256, "text").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def offending(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score) of every sentence that scores at least ``threshold``, in code points."""

    def make():
        use_memory("toxicity")

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[], [], [], []]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                spans, found = model.scores(text or "")
                for at in np.flatnonzero(found >= threshold).tolist():
                    for column, value in zip(out, (doc_id, *spans[at], float(found[at])), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "start", "end", "score"])

        return step

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return per_batch(rows, make, "doc_id bigint, start bigint, end bigint, score double", 256, "text")
