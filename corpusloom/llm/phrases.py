"""Collocations of each language by best-first branch-and-bound growth.

A phrase of two to five words is scored by its weakest cut: with ``a`` its
count, ``l`` and ``r`` the counts of the parts, ``n`` all words of its language,
``floor(1000 * a * n / (l * r))``. As ``a`` is at most ``l`` and at most ``r``,
no phrase that starts or ends with a word of count ``f`` scores above
``floor(1000 * n / f)``. So growth goes best first: the frontier is the words of
the highest bounds, the rare ones. A wave counts exactly every phrase that starts
or ends with a word of the frontier, which holds all its parts with such a word
at the outer end and all its extensions by one word, and so settles the scores
and the survival of the phrases with both ends in the frontier. The score of the
last one wanted, ties included, is the bound that a word must still reach; the
frontier grows until no word outside can (and by a factor while too few phrases
survive). Each phrase is counted in one wave.

Texts are held in blocks of about ``BLOCK_WORDS`` words, as numbers of words. A
block sends each of its different words, or phrases, once with its count to the
bucket of the key, and gets back which are frequent: words of ``least``
occurrences are numbered for the whole corpus, all others part phrases, and a
longer phrase is looked at only where its pairs are frequent. So a word or
phrase that a third of all rows hold meets as often as there are blocks, and no
task and not the driver holds the words or the phrases of the corpus. Counts are
exact and of all texts.

A phrase goes when a longer one with as many occurrences holds it; then one
longer by a single word does too, so it is met at its neighbours alone. A null
text is empty, a null language is ``und``, repeated rows count as often as they
occur, texts of any length are read whole, the ids of rows play no part. An
empty table, or one without frequent phrases, gives no rows. Extra columns are
not read.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, discard, fresh_path, mix64, ship, write_once

log = logging.getLogger(__name__)

LONGEST = 5
BLOCK_WORDS = 1 << 20
BUCKET_BYTES = 16 << 20
#: Share of a language's words that the first frontier may hold, and by what a frontier grows that has too few phrases.
FIRST_SHARE, GROWTH = 1 / 16, 16
#: A-Z become a-z, the marks and line breaks that end a piece become full stops.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else 46 if c in b".,;:!?\n\x0b\x0c\r" else c for c in range(256))
TOKENS = "block bigint, bucket bigint, lang string, n bigint, locals binary, words binary, counts binary"
WORDS = "block bigint, locals binary, ids binary, f binary, langs binary, id bigint, lang int, word binary, count bigint"
CODED = "block bigint, codes binary, ids binary, f binary, langs binary"
KEYS = "block bigint, bucket bigint, width int, keys binary, counts binary, langs binary"
PHRASES = "block bigint, keys binary, ids array<bigint>, f bigint, lang int"


def tokens_of(body: bytes) -> list[bytes]:
    """Words of a text in UTF-8, and a full stop for each end of a piece."""
    return body.translate(PLAIN).replace(b".", b" . ").split()


def _table(schema: str, columns: dict) -> pa.RecordBatch:
    """A batch of ``schema`` from some of its columns; the others are null."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    size = len(next(iter(columns.values())))
    names, arrays = [], []
    for part in schema.split(", "):
        name, kind = part.split()
        names.append(name)
        arrays.append(pa.array(columns[name], kinds[kind]) if name in columns else pa.nulls(size, kinds[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=names)


def _planes(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, all first bytes before all second ones, which compresses better."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Codes(dict):
    """Numbers of one language's words in a block; 0 is the end of a piece."""

    def __init__(self, lang: str, names: list[tuple[str, bytes]]):
        super().__init__({b".": 0})
        self.lang, self.names = lang, names

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.names)
        self.names.append((self.lang, word))
        return number


def _tokens(docs: DataFrame, buckets: int, block_words: int) -> DataFrame:
    """Blocks: a row of codes (bucket null), the words for each bucket, the number of words of each language."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        names: list[tuple[str, bytes]] = [("", b"")]
        by: dict[str, Codes] = {}
        codes: list[np.ndarray] = []
        held = 0
        stop = np.zeros(1, dtype=np.uint32)

        def flush() -> pa.RecordBatch:
            every = np.concatenate(codes)
            times = np.bincount(every, minlength=len(names))
            langs = [lang for lang, _ in names]
            words = [b"" if not at else lang.encode().hex().encode() + b"\t" + word for at, (lang, word) in enumerate(names)]
            # crc32 of the language and the word is the key's bucket, in every block.
            place = np.array([_bucket(word, buckets) for word in words], dtype=np.int64)
            order = np.argsort(place[1:], kind="stable") + 1
            heads = np.flatnonzero(np.diff(place[order], prepend=-1))
            parts = np.split(order, heads[1:]) if len(order) else []
            own = np.zeros(len(by), dtype=np.int64)
            which = {lang: at for at, lang in enumerate(by)}
            np.add.at(own, [which[lang] for lang in langs[1:]], times[1:])
            size = 1 + len(parts) + len(by)
            columns = {
                "block": [block] * size,
                "bucket": [None, *[int(place[part[0]]) for part in parts], *[None] * len(by)],
                "lang": [*[None] * (1 + len(parts)), *by],
                "n": [*[None] * (1 + len(parts)), *own.tolist()],
                "locals": [_planes(every), *[_planes(part) for part in parts], *[None] * len(by)],
                "words": [None, *[b"\n".join([words[at] for at in part.tolist()]) for part in parts], *[None] * len(by)],
                "counts": [None, *[_planes(times[part]) for part in parts], *[None] * len(by)],
            }
            return _table(TOKENS, columns)

        for batch in stream:
            for lang, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = by.get(lang)
                if own is None:
                    own = by[lang] = Codes(lang, names)
                found = tokens_of(body.as_py())
                codes += [np.fromiter(map(own.__getitem__, found), dtype=np.uint32, count=len(found)), stop]
                held += len(found)
                if held >= block_words:
                    yield flush()
                    block, names, by, codes, held = block + 1, [("", b"")], {}, [], 0
        if held:
            yield flush()

    return docs.mapInArrow(run, TOKENS)


def _bucket(word: bytes, buckets: int) -> int:
    import zlib

    return zlib.crc32(word) % buckets


def _frequent_words(rows: pa.Table, least: int, buckets: int, langs: dict[str, int]) -> pa.Table:
    """Numbers and counts of a bucket's frequent words, back to their blocks, and a row for each."""
    total: dict[bytes, int] = {}
    parts = list(zip(rows["block"].to_pylist(), rows["locals"].to_pylist(), rows["words"].to_pylist(), rows["counts"].to_pylist(), strict=True))
    for _, _, words, counts in parts:
        for word, count in zip(words.split(b"\n"), _numbers(counts).tolist(), strict=True):
            total[word] = total.get(word, 0) + count
    bucket = rows["bucket"][0].as_py()
    frequent = {word: at for at, word in enumerate(sorted(word for word, count in total.items() if count >= least))}
    if len(frequent) * buckets >= 1 << 32:
        raise ValueError("more frequent words than numbers")
    names, f = list(frequent), np.array([total[word] for word in frequent], dtype="<u8")
    lang = np.array([langs[bytes.fromhex(word[: word.index(b"\t")].decode()).decode()] for word in names], dtype="<u4")
    ids = np.arange(len(names), dtype=np.int64) * buckets + bucket + 1
    out = {name: [] for name in ("block", "locals", "ids", "f", "langs")}
    for block, own, words, _ in parts:
        at = np.array([frequent.get(word, -1) for word in words.split(b"\n")], dtype=np.int64)
        known = at >= 0
        if known.any():
            at = at[known]
            for name, value in zip(out, (block, _planes(_numbers(own)[known]), _planes(ids[at]), f[at].tobytes(), _planes(lang[at])), strict=True):
                out[name].append(value)
    listed = {"id": ids, "lang": lang.astype(np.int32), "word": [word[word.index(b"\t") + 1 :] for word in names], "count": f.astype(np.int64)}
    return pa.Table.from_batches([_table(WORDS, out), _table(WORDS, listed)])


def _recode(rows: pa.Table) -> pa.Table:
    """A block's codes as numbers of frequent words, 0 between phrases, and those numbers with count and language."""
    texts = [(block, own) for block, own, ids in zip(rows["block"].to_pylist(), rows["locals"].to_pylist(), rows["ids"].to_pylist(), strict=True) if ids is None]
    if not texts:
        return pa.Table.from_batches([_table(CODED, {"block": []})])
    back = rows.filter(pa.compute.is_valid(rows["ids"]))
    numbers, ids, langs = (
        np.concatenate([np.zeros(0, np.uint32), *map(_numbers, back[name].to_pylist())]) for name in ("locals", "ids", "langs")
    )
    f = np.frombuffer(b"".join(back["f"].to_pylist()), "<u8")
    codes = _numbers(texts[0][1])
    new = np.zeros(int(codes.max(initial=0)) + 1, dtype=np.uint32)
    new[numbers] = ids
    codes = np.concatenate([[0], new[codes], [0]]).astype(np.uint32)
    # A word between two others that are not frequent is in no phrase; one 0 is enough between phrases.
    alone = np.zeros(len(codes), dtype=bool)
    alone[1:-1] = (codes[:-2] == 0) & (codes[2:] == 0)
    codes[alone] = 0
    codes = codes[(codes > 0) | (np.concatenate([[1], codes[:-1]]) > 0)]
    order = np.argsort(ids)
    columns = {"block": [texts[0][0]], "codes": [_planes(codes)], "ids": [_planes(ids[order])], "f": [f[order].tobytes()], "langs": [_planes(langs[order])]}
    return pa.Table.from_batches([_table(CODED, columns)])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order that puts equal rows of ``keys`` (n x width) side by side, and where each run of them begins."""
    columns = []
    for at in range(0, keys.shape[1], 2):
        two = keys[:, at].astype(np.uint64)
        columns.append(two << np.uint64(32) | keys[:, at + 1] if at + 1 < keys.shape[1] else two)
    order = np.lexsort(columns[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = False
    for column in columns:
        fresh[1:] |= column[order[1:]] != column[order[:-1]]
    return order, np.flatnonzero(fresh)


class Block:
    """A block's words, whether each is in the frontier, and whether it was in the one before."""

    def __init__(self, row: dict, limits: np.ndarray, before: np.ndarray):
        self.block, self.codes, self.ids = row["block"], _numbers(row["codes"]), _numbers(row["ids"])
        self.langs = _numbers(row["langs"])
        f = np.frombuffer(row["f"], "<u8").astype(np.int64)
        place = np.searchsorted(self.ids, self.codes)
        self.place = np.minimum(place, max(0, len(self.ids) - 1))
        self.live, self.done = (
            (f <= some[self.langs])[self.place] & (self.codes > 0) if len(f) else np.zeros(len(self.codes), dtype=bool)
            for some in (limits, before)
        )

    def phrases(self, width: int, usable: np.ndarray, buckets: int) -> pa.RecordBatch | None:
        """The different phrases of ``width`` words at ``usable`` places with an end in the frontier, by bucket; those with an
        end in the frontier before are counted already."""
        last = len(self.codes) - width + 1
        if last <= 0:
            return None
        ends = (self.live[:last] | self.live[width - 1 :]) & ~(self.done[:last] | self.done[width - 1 :])
        start = np.flatnonzero(usable[:last] & ends)
        if not len(start):
            return None
        keys = np.stack([self.codes[start + at] for at in range(width)], axis=1)
        order, heads = _grouped(keys)
        times = np.diff(np.append(heads, len(order)))
        keys, lang = keys[order[heads]], self.langs[self.place[start[order[heads]]]]
        mixed = np.zeros(len(keys), dtype=np.uint64)
        for at in range(width):
            mixed = mix64(mixed + keys[:, at])
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[by], prepend=-1))
        parts = np.split(by, edges[1:])
        columns = {
            "block": [self.block] * len(parts), "bucket": bucket[by[edges]], "width": [width] * len(parts),
            "keys": [keys[part].astype("<u4").tobytes() for part in parts], "counts": [_planes(times[part]) for part in parts],
            "langs": [_planes(lang[part]) for part in parts],
        }
        return _table(KEYS, columns)


def _frequent_phrases(rows: pa.Table, least: int) -> pa.Table:
    """A row for each frequent phrase of a bucket; frequent pairs also go back to their blocks."""
    out = []
    widths = rows["width"].to_numpy()
    for width in np.unique(widths).tolist():
        some = rows.filter(pa.array(widths == width))
        blobs = some["keys"].to_pylist()
        keys = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, width)
        counts, langs = (np.concatenate(list(map(_numbers, some[name].to_pylist()))) for name in ("counts", "langs"))
        order, heads = _grouped(keys)
        total = np.add.reduceat(counts[order].astype(np.int64), heads)
        kept = total >= least
        first = order[heads[kept]]
        flat = keys[first].astype(np.int64).ravel()
        offsets = np.arange(0, len(flat) + 1, width, dtype=np.int32)
        found = {"ids": pa.ListArray.from_arrays(offsets, flat), "f": total[kept], "lang": langs[first].astype(np.int32)}
        out.append(_table(PHRASES, found))
        if width == 2:
            frequent = np.zeros(len(order), dtype=bool)
            frequent[order] = np.repeat(kept, np.diff(np.append(heads, len(order))))
            ends = np.cumsum([len(blob) // 8 for blob in blobs])
            parts = [(block, own[hit].tobytes()) for block, own, hit in zip(some["block"].to_pylist(), np.split(keys, ends[:-1]), np.split(frequent, ends[:-1]), strict=True) if hit.any()]
            out.append(_table(PHRASES, {"block": [block for block, _ in parts], "keys": [own for _, own in parts]}))
    return pa.Table.from_batches(out)


def _pairs_known(block: Block, blobs: list[bytes]) -> np.ndarray:
    """At which places a pair may be in a longer phrase: it is frequent, or it was not counted as no end is in the frontier."""
    codes = block.codes.astype(np.uint64)
    pair = codes[:-1] << np.uint64(32) | codes[1:]
    keys = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.uint64)
    known = np.sort(keys[:, 0] << np.uint64(32) | keys[:, 1])
    if len(known):
        at = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        hit = known[at] == pair
    else:
        hit = np.zeros(len(pair), dtype=bool)
    open_ = ~(block.live[:-1] | block.live[1:])
    return (hit | open_) & (block.codes[:-1] > 0) & (block.codes[1:] > 0)


def _by_lang(values: list) -> Column:
    """The value of a row's language; counts are long."""
    pairs = [F.lit(v) if isinstance(v, str) else F.lit(int(v)).cast("bigint") for v in values]
    return F.create_map(*[one for at, value in enumerate(pairs) for one in (F.lit(at), value)])[F.col("lang")]


class Corpus:
    """Blocks of a corpus in numbers of frequent words, in tables of the shared folder."""

    def __init__(self, docs: DataFrame, least: int, block_words: int = BLOCK_WORDS):
        self.spark, self.least = docs.sparkSession, least
        self.pairs: list[DataFrame] = []
        self.counted: list[DataFrame] = []
        ship(self.spark)
        self.paths: list[str] = []
        rows = docs.select(
            F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
            F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("body"),
        )
        total = rows.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
        self.buckets = buckets = 16 + total // BUCKET_BYTES
        tokens = self._write(_tokens(rows, buckets, block_words), "phrase-tokens")
        counted = tokens.where("lang IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")).orderBy("lang").collect()
        #: A row of the driver for each language.
        self.limits = np.zeros(len(counted), dtype=np.int64)
        self.langs, self.n = [row["lang"] for row in counted], np.array([row["n"] for row in counted], dtype=np.int64)
        number = {lang: at for at, lang in enumerate(self.langs)}
        judged = self._write(
            dealt(tokens.where("bucket IS NOT NULL"), buckets, "bucket").groupBy("bucket").applyInArrow(lambda rows: _frequent_words(rows, least, buckets, number), WORDS),
            "phrase-words",
        )
        self.words = judged.where("id IS NOT NULL").select("id", "lang", "word", "count")
        back = judged.where("block IS NOT NULL").select("block", "locals", "ids", "f", "langs")
        texts = tokens.where("bucket IS NULL AND lang IS NULL").select("block", "locals")
        texts = texts.select("block", "locals", *[F.lit(None).cast("binary").alias(name) for name in ("ids", "f", "langs")])
        self.coded = self._write(dealt(texts.unionByName(back), 2 * buckets, "block").groupBy("block").applyInArrow(_recode, CODED), "phrase-blocks")

    def _write(self, df: DataFrame, label: str) -> DataFrame:
        path = fresh_path(self.spark, label)
        self.paths.append(path)
        write_once(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def grow(self, limits: np.ndarray) -> None:
        """Count every phrase that starts or ends with a word of count ``limits[lang]`` or less and is not counted yet."""
        buckets, least, before = self.buckets, self.least, self.limits

        def pairs(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in stream:
                for at in range(batch.num_rows):
                    block = Block(batch.slice(at, 1).to_pylist()[0], limits, before)
                    both = (block.codes[:-1] > 0) & (block.codes[1:] > 0)
                    found = block.phrases(2, np.append(both, False), buckets)
                    if found is not None:
                        yield found

        def longer(rows: pa.Table) -> pa.Table:
            out = [_table(KEYS, {"block": []})]
            texts = rows.filter(pa.compute.is_valid(rows["codes"])).to_pylist()
            if texts:
                block = Block(texts[0], limits, before)
                usable = _pairs_known(block, [blob for blob in rows["keys"].to_pylist() if blob is not None])
                for width in range(3, LONGEST + 1):
                    ready = usable[: len(usable) - width + 2].copy()
                    for at in range(1, width - 1):
                        ready &= usable[at : at + len(ready)]
                    found = block.phrases(width, ready, buckets) if len(ready) else None
                    if found is not None:
                        out.append(found)
            return pa.Table.from_batches(out)

        def frequent(rows: pa.Table) -> pa.Table:
            return _frequent_phrases(rows, least)

        met = dealt(self.coded.mapInArrow(pairs, KEYS), buckets, "bucket")
        two = self._write(met.groupBy("bucket").applyInArrow(frequent, PHRASES), "phrase-pairs")
        self.pairs.append(two.where("block IS NOT NULL"))
        met = self.coded.withColumn("keys", F.lit(None).cast("binary"))
        nothing = [F.lit(None).cast("binary").alias(name) for name in ("codes", "ids", "f", "langs")]
        for known in self.pairs:
            met = met.unionByName(known.select("block", *nothing, "keys"))
        held = dealt(met, 2 * buckets, "block").groupBy("block").applyInArrow(longer, KEYS)
        more = dealt(held, buckets, "bucket").groupBy("bucket").applyInArrow(frequent, PHRASES)
        found = two.where("ids IS NOT NULL").unionByName(more).select("ids", "f", "lang")
        self.counted.append(self._write(found, "phrases"))
        self.limits = limits

    def scored(self) -> DataFrame:
        """(lang, ids, a, l, r, score) of the surviving phrases with both ends in the frontier."""
        phrases = reduce(DataFrame.unionAll, self.counted)
        single = self.words.select(F.array("id").alias("part"), F.col("count").alias("f"))
        parts = phrases.select(F.col("ids").alias("part"), "f").unionByName(single)
        ends = self.words.where(F.col("count") <= _by_lang(self.limits)).select(F.col("id").alias("end"))
        size = F.size("ids")
        candidates = (
            phrases.withColumn("end", F.col("ids")[0]).join(ends, "end").withColumn("end", F.col("ids")[size - 1]).join(ends, "end").drop("end")
        )
        shorter = phrases.where(size > 2).select(
            F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), "f"
        )
        surviving = candidates.join(shorter.distinct(), ["ids", "f"], "left_anti")
        cuts = surviving.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1))).select(
            "ids", "f", "lang", "k", F.slice("ids", F.lit(1), F.col("k")).alias("left"),
            F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("right"),
        )
        left = parts.select(F.col("part").alias("left"), F.col("f").alias("l"))
        right = parts.select(F.col("part").alias("right"), F.col("f").alias("r"))

        def exact(value: Column) -> Column:
            return value.cast("decimal(18,0)")

        over = (exact(F.col("f")) * exact(_by_lang(self.n) * 1000)).cast("decimal(38,0)")
        under = (exact(F.col("l")) * exact(F.col("r"))).cast("decimal(38,0)")
        # The quotient is made to fit a scale of 0 by its remainder, so it is a floor.
        score = ((over - over % under) / under).cast("decimal(38,0)").cast("bigint")
        weighed = cuts.join(left, "left").join(right, "right").select(
            "ids", "f", "lang", F.struct(score.alias("score"), "k", "l", "r").alias("cut")
        )
        return weighed.groupBy("lang", "ids", "f").agg(F.min("cut").alias("cut")).select(
            "lang", "ids", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score")
        )

    def first_limits(self) -> np.ndarray:
        """The largest powers of two up to which the words of each language are ``FIRST_SHARE`` of all, or one step."""
        step = F.ceil(F.log2(F.col("count").cast("double"))).cast("int")
        held = self.words.groupBy("lang", step.alias("step")).agg(F.sum("count").alias("held")).orderBy("lang", "step").collect()
        limits, sums = np.zeros(len(self.langs), dtype=np.int64), np.zeros(len(self.langs))
        for row in held:
            sums[row["lang"]] += row["held"]
            if not limits[row["lang"]] or sums[row["lang"]] <= self.n[row["lang"]] * FIRST_SHARE:
                limits[row["lang"]] = 2 ** row["step"]
        return limits

    def drop(self, paths: list[str] | None = None) -> None:
        for path in self.paths if paths is None else paths:
            discard(self.spark, path)


def best(docs: DataFrame, top: int = 2000, least: int = 100, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` collocations of each language of ``docs`` (lang, text)."""
    corpus = Corpus(docs, least, block_words)
    spark = corpus.spark
    schema = "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"
    if not len(corpus.langs):
        corpus.drop()
        return spark.createDataFrame([], schema)
    most = corpus.words.groupBy("lang").agg(F.max("count").alias("most")).collect()
    highest = np.zeros(len(corpus.langs), dtype=np.int64)
    for row in most:
        highest[row["lang"]] = row["most"]
    limits = np.minimum(corpus.first_limits(), highest)
    while True:
        corpus.grow(limits)
        scored = corpus._write(corpus.scored(), "phrase-scores")
        order = Window.partitionBy("lang").orderBy(F.col("score").desc())
        last = scored.select("lang", "score", F.row_number().over(order).alias("at")).where(F.col("at") == top).collect()
        bar = {row["lang"]: row["score"] for row in last}
        # Words outside have more than limits; those up to the next limit can still reach the last score.
        reach = np.array([1000 * n // max(bar[at], 1) if at in bar else GROWTH * limits[at] for at, n in enumerate(corpus.n.tolist())])
        reach = np.minimum(reach, highest)
        log.info("frontier up to %s, still to reach %s", limits, reach)
        if (reach <= limits).all():
            break
        limits = np.maximum(limits, reach)
    kept = scored.where(F.col("score") >= _by_lang([bar.get(at, 0) for at in range(len(corpus.langs))]))
    spelled = (
        kept.select("lang", "ids", "a", "l", "r", "score", F.posexplode("ids").alias("at", "id"))
        .join(corpus.words.select("id", F.col("word").cast("string").alias("word")), "id")
        .groupBy("lang", "ids", "a", "l", "r", "score")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda one: one["word"]), " ").alias("phrase"))
    )
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = spelled.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= top)
    out = ranked.select(_by_lang(corpus.langs).alias("lang"), "rank", "phrase", "a", "l", "r", _by_lang(corpus.n).alias("n"), "score")
    before = list(corpus.paths)
    result = corpus._write(out, "phrases-best")
    corpus.drop(before)
    return result
