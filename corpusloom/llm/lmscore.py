"""Cross-entropy difference of documents under two n-gram models.

The target model is made from the benchmark's passages, the background model
from all documents. Both share one vocabulary, all words of all documents in
lower case, and one class for words of the target that no document has; both
have the same form and smoothing: bigrams over unigrams over the uniform
distribution. A text's first word has no bigram. A document's score is the mean
over its words of the target's loss less the background's, in nats: the lower,
the more it reads like the target. The background leaves out the counts of the
document it scores. Every word scored is a word of the vocabulary.

Counts are exact and cover every word of every text; their number grows with
the corpus, so no task and not the driver holds them all. Documents are written
in blocks of bounded size, a row each, as codes into the list of the block's own
words. Each block sends every word and bigram it holds once, as a 64-bit key with its
count, to the bucket where the key is summed; the sums come back to the blocks
that hold the key, by its place among the block's sorted keys, but for keys of
one block alone, which that block counts itself. A bucket is a range of keys, and the number of buckets follows the
words; a key, however frequent, meets as often as there are blocks. The driver
sees a few totals.

Empty and null texts have score 0 and no words. Rows that repeat are counted
and scored as rows of their own, null ids too. An empty target makes the target
model uniform. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, mix64, ship, stage

#: Words one block can tell apart; the vocabulary of all blocks has no bound.
VOCABULARY = 1 << 31
DISCOUNT, LEAN = 0.75, 8.0
BLOCK_WORDS, BLOCK_ROWS = 1 << 19, 1 << 16
BUCKETS, BUCKET_KEYS = 1 << 8, 1 << 20
CODED = "block bigint, ids array<bigint>, sizes binary, codes binary, keys binary"
COUNTED = "bucket bigint, block bigint, keys binary, n binary"
SUMMED = "block bigint, bucket bigint, shared binary, near binary, far binary, totals array<bigint>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_key(word: bytes) -> int:
    """64-bit hashes, even."""
    return int.from_bytes(blake2b(word, digest_size=8).digest(), "little") & ~1


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys of bigrams, odd."""
    return mix64(mix64(left + np.uint64(1)) + right) | np.uint64(1)


def names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(", ")]


def pack(numbers: np.ndarray, width: int = 8) -> bytes:
    """Numbers of ``width`` bytes, all first bytes before all second ones, which compresses better."""
    return numbers.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T.tobytes()


def unpack(packed: bytes, width: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(packed, np.uint8).reshape(width, -1).T).view(f"<u{width}").ravel()


def pack_codes(codes: np.ndarray) -> bytes:
    """Codes in as many bytes as the largest needs, two at least."""
    width = max(2, (int(codes.max(initial=0)).bit_length() + 7) // 8)
    return pack(codes, 4)[: width * len(codes)]


def unpack_codes(packed: bytes, size: int) -> np.ndarray:
    return unpack(packed + bytes(4 * size - len(packed)), 4).astype(np.int64)


def unpack_all(column: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([np.zeros(0, dtype=np.uint64), *map(unpack, column.to_pylist())])


class Codes(dict):
    """Codes of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def blocks(texts: DataFrame, size: int = BLOCK_WORDS, aim: bool = False) -> DataFrame:
    """A row a block of texts of about ``size`` words: ids, words and codes of its texts, and the keys of its words by code.

    Blocks of the target (``aim``) have negative numbers.
    """
    ship(texts.sparkSession)

    def out(block: int, ids: list[pa.Array], codes: list[np.ndarray], known: Codes) -> pa.RecordBatch:
        sizes = np.array(list(map(len, codes)), dtype=np.int64)
        keys = np.fromiter(map(word_key, known), dtype="<u8", count=len(known))
        row = (-1 - block if aim else block, pa.concat_arrays(ids), pack(sizes, 4), pack_codes(np.concatenate(codes)), pack(keys))
        held = pa.ListArray.from_arrays(pa.array([0, len(row[1])], pa.int32()), row[1])
        columns = [pa.array(row[:1], pa.int64()), held, *[pa.array([part], pa.binary()) for part in row[2:]]]
        return pa.RecordBatch.from_arrays(columns, names=names(CODED))

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, known, ids, codes = TaskContext.get().partitionId() << 32, 0, Codes(), [], []
        for batch in stream:
            for some in batches_of(batch, 256, "text", 1):
                found = [words_of(text) for text in some.column("text").to_pylist()]
                more = sum(map(len, found))
                if codes and (held + more > size or len(codes) + some.num_rows > BLOCK_ROWS):
                    yield out(block, ids, codes, known)
                    block, held, known, ids, codes = block + 1, 0, Codes(), [], []
                held += more
                ids.append(some.column("doc_id"))
                codes += [np.fromiter(map(known.__getitem__, words), dtype=np.uint32, count=len(words)) for words in found]
        if codes:
            yield out(block, ids, codes, known)

    rows = texts.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, CODED)


class Run:
    """The texts of a block one after the other: the codes of words, and the bigrams of all but the texts' first words."""

    def __init__(self, block: dict):
        self.keys = unpack(block["keys"])
        self.sizes = unpack(block["sizes"], 4).astype(np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.word = unpack_codes(block["codes"], len(self.owner))
        self.later = np.zeros(len(self.word), dtype=bool)
        self.later[1:] = self.owner[1:] == self.owner[:-1]
        self.before = np.concatenate([self.word[:1], self.word[:-1]])
        pairs, self.pair, times = np.unique(
            (self.before << 32 | self.word)[self.later], return_inverse=True, return_counts=True
        )
        self.singles = len(self.keys)
        #: Words, then bigrams: their keys and how often the block has them.
        self.all_keys = np.concatenate([self.keys, pair_keys(self.keys[pairs >> 32], self.keys[pairs & 0xFFFFFFFF])])
        self.counts = np.concatenate([np.bincount(self.word, minlength=self.singles), times]).astype(np.int64)


def by_bucket(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of sorted ``keys`` and where each begins; ``buckets`` is a power of two."""
    return np.unique(keys >> np.uint64(64 - (buckets.bit_length() - 1)), return_index=True)


def key_counts(coded: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, keys, n) of the words and bigrams of each block, sorted and counted before anything moves."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for at in range(batch.num_rows):
                block = batch.slice(at, 1).to_pylist()[0]
                found = Run(block)
                order = np.argsort(found.all_keys)
                keys, n = found.all_keys[order], found.counts[order]
                bucket, starts = by_bucket(keys, buckets)
                place = np.full(len(bucket), block["block"], dtype=np.int64)
                packed = [pa.array([pack(part) for part in np.split(some, starts)[1:]], pa.binary()) for some in (keys, n)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(place), *packed], names=names(COUNTED))

    return coded.select("block", "sizes", "codes", "keys").mapInArrow(run, COUNTED)


def summed_counts(counted: DataFrame) -> DataFrame:
    """(block, bucket, shared, near, far, totals): which keys a block of documents does not hold alone, one bit for each of its
    sorted keys in the bucket, and for those the counts in target and documents.

    A row without a block has the totals of its bucket: words of target and
    documents, different words of documents, of both, and of the target alone.
    """

    def run(pieces: pa.Table) -> pa.Table:
        bucket = pieces.column("bucket")[0].as_py()
        blocks = pieces.column("block").to_pylist()
        parts = [unpack(some) for some in pieces.column("keys").to_pylist()]
        keys, n = np.concatenate(parts), unpack_all(pieces.column("n")).astype(np.int64)
        ends = np.cumsum(list(map(len, parts)))
        aim = np.repeat(np.array(blocks) < 0, np.diff(ends, prepend=0))
        single, back = np.unique(keys, return_inverse=True)
        near, far = np.zeros((2, len(single)), dtype=np.int64)
        np.add.at(near, back[aim], n[aim])
        np.add.at(far, back[~aim], n[~aim])
        word = single & np.uint64(1) == 0  # keys of words are even
        a, b = near[word], far[word]
        totals = [a.sum(), b.sum(), (b > 0).sum(), ((a > 0) & (b > 0)).sum(), ((a > 0) & (b == 0)).sum()]
        out = [(None, bucket, None, None, None, list(map(int, totals)))]
        for block, start, end in zip(blocks, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            if block >= 0:
                at = back[start:end]
                kept = (near[at] > 0) | (far[at] > n[start:end])
                if kept.any():
                    at = at[kept]
                    out.append((block, bucket, np.packbits(kept).tobytes(), pack(near[at]), pack(far[at]), None))
        types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        columns = [pa.array(column, of) for column, of in zip(zip(*out, strict=True), types, strict=True)]
        return pa.Table.from_arrays(columns, names=names(SUMMED))

    return counted.groupBy("bucket").applyInArrow(run, SUMMED)


class Model:
    """Interpolated bigrams: the more often the word before was seen, the more its bigrams count.

    Unigrams are discounted and share the rest evenly with the vocabulary.
    """

    def __init__(self, total: int, seen: int, vocabulary: int):
        self.total = max(1, total)
        self.rest = (DISCOUNT * seen / self.total if total else 1.0) / vocabulary

    def losses(self, word: np.ndarray, pair: np.ndarray, held: np.ndarray, left_out: np.ndarray | int = 0) -> np.ndarray:
        """-log p of words by their counts, their bigrams' and those of the words before; ``left_out`` words are not counted."""
        base = np.maximum(word - DISCOUNT, 0) / np.maximum(self.total - left_out, 1) + self.rest
        return -np.log((np.minimum(pair, held) + LEAN * base) / (held + LEAN))


def _own(owner: np.ndarray, at: np.ndarray, where: np.ndarray | None = None) -> np.ndarray:
    """How often the value of each entry occurs in its own text, among the entries ``where`` holds; 0 elsewhere."""
    where = slice(None) if where is None else where
    _, back, times = np.unique(owner[where] << 32 | at[where], return_inverse=True, return_counts=True)
    out = np.zeros(len(at), dtype=np.int64)
    out[where] = times[back]
    return out


SCHEMA = "doc_id bigint, n_words bigint, target_loss double, background_loss double"


def score(docs: DataFrame, target: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, n_words, target_loss, background_loss, score) for each row of ``docs``; ``target`` has a ``text`` column."""
    passages = target.select(F.lit(None).alias("doc_id"), "text")
    both = stage(blocks(docs, block_words).unionByName(blocks(passages, block_words, aim=True)), "coded")
    # Two bytes a word at least; a text has at most twice as many keys as words.
    most = both.agg(F.sum(F.octet_length("codes"))).first()[0] or 0
    buckets = max(BUCKETS, 1 << (most // BUCKET_KEYS).bit_length())
    summed = stage(summed_counts(key_counts(both, buckets)), "summed")
    sums = summed.where("block IS NULL").agg(*(F.coalesce(F.sum(F.col("totals")[at]), F.lit(0)) for at in range(5))).first()
    near_words, far_words, words, common, alone = sums
    # One class more: the words that only the target has.
    near_model = Model(near_words, common + (alone > 0), words + 1)
    far_model = Model(far_words, words, words + 1)

    def run(texts: pa.Table, counts: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.Table.from_pylist([], pa.schema(list(zip(names(SCHEMA), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True))))
        block = texts.select(["sizes", "codes", "keys"]).to_pylist()[0]
        found = Run(block)
        word, before, later, singles = found.word, found.before, found.later, found.singles
        near, far = np.zeros(len(found.counts), dtype=np.int64), found.counts
        order = np.argsort(found.all_keys)
        place, starts = by_bucket(found.all_keys[order], buckets)
        edges = dict(zip(place.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(order)], strict=False), strict=False))
        for row in counts.select(["bucket", "shared", "near", "far"]).to_pylist():
            start, end = edges[row["bucket"]]
            shared = np.unpackbits(np.frombuffer(row["shared"], np.uint8), count=end - start).astype(bool)
            at = order[start:end][shared]
            near[at], far[at] = unpack(row["near"]), unpack(row["far"])
        near_pair, far_pair, numbers = np.zeros((3, len(word)), dtype=np.int64)
        numbers[later] = found.pair
        near_pair[later], far_pair[later] = near[singles:][found.pair], far[singles:][found.pair]
        # A text's first word has none before it.
        near_held, far_held = near[before] * later, far[before] * later
        losses = (
            near_model.losses(near[word], near_pair, near_held),
            far_model.losses(
                far[word] - _own(found.owner, word), far_pair - _own(found.owner, numbers, later),
                far_held - _own(found.owner, before, later), found.sizes[found.owner],
            ),
        )
        sums = [np.bincount(found.owner, weights=loss, minlength=len(found.sizes)) for loss in losses]
        means = [total / np.maximum(found.sizes, 1) for total in sums]
        columns = [texts.column("ids").combine_chunks().flatten(), pa.array(found.sizes), *map(pa.array, means)]
        return pa.Table.from_arrays(columns, names=names(SCHEMA))

    coded = both.where(F.col("block") >= 0)
    shared = summed.where("block IS NOT NULL").drop("totals")
    scored = coded.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, SCHEMA)
    return scored.withColumn("score", F.col("target_loss") - F.col("background_loss"))
