"""Text queries against a document table by exact term weights.

The index is a table with a row per shard of documents: the shard's terms, for
each the documents that hold it and how often, and for every block of a list
the largest weight in it. Texts are read once and stay where they are; what
moves is each shard's list of different terms, once to the buckets that count
documents per term and once back, and the packed shards to meet it. A term that
every document holds is a row of each shard, so its list is spread like the
documents.

A search scans the index and sums weights list by list, the strongest first.
Once the lists still to come cannot lift a document that is not met yet to the
k-th score, only documents that can still reach it are looked up, and only in
blocks whose largest weight lets them. Nothing that could be a hit is left out.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import col, rows_of
from corpusloom.operators.numbering import first_per_group
from corpusloom.operators.search import arrow_type
from corpusloom.session import fresh_path, spread, stage, write_once

NOT_LETTERS = r"[^\p{L}\p{N}]+"
MAX_BROADCAST_TERMS = 200_000
SHARD_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
BLOCK = 64
#: Scores are rounded before ranking, so a bound this far below a score may still tie with it.
SLACK = 2e-6
SHARDS = "shard bigint, ids array<{kind}>, words binary, df binary, docs binary, tf binary"
INDEX = "shard bigint, ids array<{kind}>, words binary, df binary, docs binary, tf binary, idf binary, norm binary, best binary"
PARTS = "shard bigint, bucket bigint, numbers binary, words binary, df binary"
BACK = "shard bigint, numbers binary, idf binary, term string, weight double"


def tokens(text: Column | str) -> Column:
    """Lower-case runs of letters and digits; empty strings may stand at the ends."""
    return F.split(F.lower(col(text)), NOT_LETTERS)


def term_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``key, term, tf`` over lower-case runs of letters and digits. A text is one row, so its counts are complete before
    the shuffle and only distinct pairs travel."""
    exploded = rows_of(spread(rows.select(key, text), key), [key], tokens(text), "term").filter("term <> ''")
    return exploded.groupBy(key, "term").agg(F.count("*").alias("tf"))


def _unit(weight: str, text: str) -> Column:
    """Weight divided by the length of the weights of its text; NULL for length 0."""
    squares = F.sum(F.col(weight) * F.col(weight)).over(Window.partitionBy(text))
    return F.try_divide(F.col(weight), F.sqrt(squares))


class _Shard:
    """Documents gathered until they are enough for a row of the index."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.words: list[np.ndarray] = []
        self.lengths: list[np.ndarray] = []
        self.ids: list[pa.Array] = []
        self.size = 0

    def add(self, ids: pa.Array, texts: pa.ListArray) -> None:
        held = texts.flatten().dictionary_encode()
        numbers = np.array([self.known.setdefault(word, len(self.known)) if word else -1 for word in held.dictionary.to_pylist()] or [-1])
        word = numbers[held.indices.to_numpy(zero_copy_only=False)]
        owner = np.repeat(np.arange(len(texts)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(texts), 0)))
        self.words.append(word[word >= 0])
        self.lengths.append(np.bincount(owner[word >= 0], minlength=len(texts)))
        self.ids.append(ids)
        self.size += held.nbytes

    def row(self) -> tuple[pa.Array, bytes, bytes, bytes, bytes]:
        word, lengths = np.concatenate(self.words), np.concatenate(self.lengths)
        key, tf = np.unique(word.astype(np.int64) << 32 | np.repeat(np.arange(len(lengths)), lengths), return_counts=True)
        df = np.bincount(key >> 32, minlength=len(self.known))
        return (
            pa.concat_arrays(self.ids), "\n".join(self.known).encode(), df.astype("<u4").tobytes(),
            (key & 0xFFFFFFFF).astype("<u4").tobytes(), tf.astype("<u4").tobytes(),
        )


def _shards(documents: DataFrame, doc_id: str, text: str, shard_bytes: int) -> DataFrame:
    kind = documents.schema[doc_id].dataType.simpleString()
    schema = SHARDS.format(kind=kind)
    names = [part.split()[0] for part in schema.split(", ")]

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, _Shard()

        def flush() -> pa.RecordBatch:
            ids, *blobs = held.row()
            listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([number]), listed, *[pa.array([blob], pa.binary()) for blob in blobs]], names=names
            )

        for batch in stream:
            # A few hundred texts at a time keep a task's memory near that of a shard.
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                held.add(part.column(0), part.column(1))
                if held.size >= shard_bytes:
                    yield flush()
                    number, held = number + 1, _Shard()
        if held.ids:
            yield flush()

    rows = spread(documents.select(doc_id, text), doc_id).select(doc_id, tokens(text).alias("tokens"))
    return rows.mapInArrow(run, schema)


def build_index(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(index, idf per term) of ``documents``; every row is a document of its own. ``idf = ln((n + 1) / (df + 1))``."""
    kind = documents.schema[doc_id].dataType.simpleString()
    shards = stage(_shards(documents, doc_id, text, shard_bytes), "term-shards")
    size = shards.agg(
        F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("docs"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("words")
    ).first()
    n_docs, buckets = size["docs"], 16 + size["words"] // BUCKET_BYTES

    def by_bucket(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in stream:
            for row in batch.to_pylist():
                words = row["words"].split(b"\n") if row["words"] else []
                df = np.frombuffer(row["df"], "<u4")
                place = np.array([zlib.crc32(word) % buckets for word in words], dtype=np.int64)
                order = np.argsort(place, kind="stable")
                heads = np.flatnonzero(np.diff(place[order], prepend=-1))
                parts = np.split(order, heads[1:]) if len(order) else []
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["shard"]] * len(parts), pa.int64()), pa.array([int(place[part[0]]) for part in parts], pa.int64()),
                        pa.array([part.astype("<u4").tobytes() for part in parts], pa.binary()),
                        pa.array([b"\n".join([words[at] for at in part.tolist()]) for part in parts], pa.binary()),
                        pa.array([df[part].tobytes() for part in parts], pa.binary()),
                    ],
                    names=["shard", "bucket", "numbers", "words", "df"],
                )

    def count(rows: pa.Table) -> pa.Table:
        total: dict[bytes, int] = defaultdict(int)
        parts = [(row["shard"], row["numbers"], row["words"].split(b"\n"), np.frombuffer(row["df"], "<u4")) for row in rows.to_pylist()]
        for _, _, words, df in parts:
            for word, n in zip(words, df.tolist(), strict=True):
                total[word] += n
        idf = {word: float(np.log((n_docs + 1.0) / (n + 1.0))) for word, n in total.items()}
        back = pa.table(
            {
                "shard": pa.array([shard for shard, *_ in parts], pa.int64()),
                "numbers": pa.array([numbers for _, numbers, *_ in parts], pa.binary()),
                "idf": pa.array([np.array([idf[word] for word in words]).tobytes() for *_, words, _ in parts], pa.binary()),
                "term": pa.nulls(len(parts), pa.string()),
                "weight": pa.nulls(len(parts), pa.float64()),
            }
        )
        terms = pa.table(
            {
                "shard": pa.nulls(len(idf), pa.int64()), "numbers": pa.nulls(len(idf), pa.binary()), "idf": pa.nulls(len(idf), pa.binary()),
                "term": pa.array([word.decode() for word in idf], pa.string()), "weight": pa.array(list(idf.values()), pa.float64()),
            }
        )
        return pa.concat_tables([back, terms])

    counted = stage(
        shards.select("shard", "words", "df").mapInArrow(by_bucket, PARTS).groupBy("bucket").applyInArrow(count, BACK), "term-weights"
    )
    names = [part.split()[0] for part in INDEX.format(kind=kind).split(", ")]

    def weigh(rows: pa.Table) -> pa.Table:
        text_row = rows.filter(pa.compute.is_valid(rows["ids"]))
        words = text_row.select(["shard", "words", "df", "docs", "tf"]).to_pylist()[0]
        df = np.frombuffer(words["df"], "<u4").astype(np.int64)
        idf = np.zeros(len(df))
        for numbers, own in zip(rows["numbers"].to_pylist(), rows["idf"].to_pylist(), strict=True):
            if own is not None:
                idf[np.frombuffer(numbers, "<u4")] = np.frombuffer(own)
        docs, tf = np.frombuffer(words["docs"], "<u4").astype(np.int64), np.frombuffer(words["tf"], "<u4")
        ids = text_row["ids"].combine_chunks()
        weight = tf * np.repeat(idf, df)
        norm = np.sqrt(np.bincount(docs, weights=weight * weight, minlength=len(ids[0].values)))
        share = np.divide(weight, norm[docs], out=np.zeros(len(weight)), where=norm[docs] > 0)
        heads = _blocks(df)[0]
        best = np.maximum.reduceat(share, heads) if len(heads) else np.zeros(0)
        blobs = [words["words"], words["df"], words["docs"], words["tf"], idf.tobytes(), norm.tobytes(), best.tobytes()]
        return pa.Table.from_arrays([pa.array([words["shard"]]), ids, *[pa.array([blob], pa.binary()) for blob in blobs]], names=names)

    empty = [F.lit(None).cast("binary").alias(name) for name in ("numbers", "idf")]
    texts = shards.select(*shards.columns, *empty)
    back = counted.filter("shard IS NOT NULL").select(
        "shard", F.lit(None).cast(f"array<{kind}>").alias("ids"),
        *[F.lit(None).cast("binary").alias(name) for name in ("words", "df", "docs", "tf")], "numbers", "idf",
    )
    index = stage(texts.unionByName(back).groupBy("shard").applyInArrow(weigh, INDEX.format(kind=kind)), "term-index")
    return index, counted.filter("term IS NOT NULL").select("term", F.col("weight").alias("idf"))


def _blocks(df: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First postings of the blocks of all lists, and the first block of each list and one past the last."""
    blocks = -(-df // BLOCK)
    first = np.concatenate([[0], np.cumsum(blocks)])
    inside = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    return np.repeat(np.cumsum(df) - df, blocks) + inside * BLOCK, first


class _Searcher:
    """A row of the index opened for search. ``looked_up`` counts the blocks read for candidates."""

    def __init__(self, row: dict):
        self.number = {word: at for at, word in enumerate(row["words"].decode().split("\n"))} if row["words"] else {}
        df = np.frombuffer(row["df"], "<u4").astype(np.int64)
        self.first = np.concatenate([[0], np.cumsum(df)])
        self.docs, self.tf = np.frombuffer(row["docs"], "<u4"), np.frombuffer(row["tf"], "<u4")
        self.idf, self.norm, self.best = (np.frombuffer(row[name]) for name in ("idf", "norm", "best"))
        self.block = _blocks(df)[1]
        self.most = np.maximum.reduceat(self.best, self.block[:-1]) if len(df) else np.zeros(0)
        self.looked_up = 0

    def shares(self, term: int, at: slice | np.ndarray) -> np.ndarray:
        docs, tf = self.docs[at], self.tf[at]
        norm = self.norm[docs]
        return np.divide(tf * self.idf[term], norm, out=np.zeros(len(docs)), where=norm > 0)

    def search(self, query: list[tuple[str, float]], k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of documents that may be among the k best, given that a score below ``least`` is not."""
        lists = sorted(((self.most[self.number[t]] * w, self.number[t], w) for t, w in query if t in self.number), reverse=True)
        rest = np.append(np.cumsum([most for most, *_ in lists][::-1])[::-1], 0.0)
        score = np.zeros(len(self.norm))
        least = max(least, 0.0)
        met = 0
        for met, (_, term, w) in enumerate(lists):
            # Whatever is not met yet stays below the k-th score so far: from here on candidates alone count.
            if rest[met] < least - SLACK:
                break
            own = slice(self.first[term], self.first[term + 1])
            score[self.docs[own]] += w * self.shares(term, own)
            if len(score) > k > 0:
                least = max(least, float(np.partition(score, len(score) - k)[len(score) - k]))
        else:
            met = len(lists)
        found = np.flatnonzero((score > 0) & (score + rest[met] >= least - SLACK))
        total = score[found]
        for at in range(met, len(lists)):
            _, term, w = lists[at]
            held = self.docs[self.first[term] : self.first[term + 1]]
            place = np.searchsorted(held, found)
            inside = np.minimum(place, len(held) - 1)
            block = self.block[term] + inside // BLOCK
            kept = total + np.where(place < len(held), w * self.best[block], 0.0) + rest[at + 1] >= least - SLACK
            found, total, place, inside = found[kept], total[kept], place[kept], inside[kept]
            self.looked_up += len(np.unique(block[kept]))
            hit = held[inside] == found
            total[hit] += w * self.shares(term, self.first[term] + inside[hit])
        return found, total


def search_index(
    index: DataFrame,
    idf: DataFrame,
    queries: DataFrame,
    k: int = 3,
    doc_id: str = "doc_id",
    query_id: str = "item_id",
    text: str = "text",
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """The k documents with the highest cosine of weights per query; the query side goes in passes of bounded terms."""
    spark = index.sparkSession
    asked = stage(term_counts(queries, query_id, text), "query-terms")
    n_terms = asked.count()
    # Hashed passes differ in size, so they are planned at half the bound; a query is in one pass.
    passes = 1 if n_terms <= max_broadcast_terms else -(-2 * n_terms // max_broadcast_terms)
    kind, id_kind = asked.schema[query_id].dataType, index.schema["ids"].dataType.elementType
    hits_schema = f"{query_id} {kind.simpleString()}, {doc_id} {id_kind.simpleString()}, score double"
    path = fresh_path(spark, "term-hits")
    for number in range(passes):
        part = asked.filter(F.pmod(F.xxhash64(query_id), F.lit(passes)) == number)
        # The query side is bounded, so it is sent to the table of all terms.
        weighed = idf.join(F.broadcast(part), "term").select(query_id, "term", (F.col("tf") * F.col("idf")).alias("w"))
        rows = weighed.select(query_id, "term", _unit("w", query_id).alias("w")).filter("w > 0").collect()
        wanted: dict = defaultdict(list)
        for row in rows:
            wanted[row[query_id]].append((row["term"], row["w"]))
        finder = _finder(dict(wanted), k, query_id, doc_id, arrow_type(kind.simpleString()))
        write_once(index.mapInArrow(finder, hits_schema), f"{path}/pass-{number}")
    found = spark.read.schema(hits_schema).option("recursiveFileLookup", True).parquet(path)
    return first_per_group(found, [query_id], [F.col("score").desc(), F.col(doc_id)], k)


def _finder(wanted: dict, k: int, query_id: str, doc_id: str, query_type: pa.DataType):
    """Arrow kernel: rows of the index to the k best documents of a task for each query."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {query: [] for query in wanted}
        for batch in stream:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                ids = row.column("ids")[0].values
                searcher = _Searcher(row.drop_columns(["ids"]).to_pylist()[0])
                for query, terms in wanted.items():
                    held = best[query]
                    places, scores = searcher.search(terms, k, held[-1][0] if len(held) == k > 0 else 0.0)
                    if not len(places):
                        continue
                    scores = np.round(scores, 6)
                    if len(places) > k:
                        cut = np.partition(scores, len(scores) - k)[len(scores) - k] if k > 0 else np.inf
                        places, scores = places[scores >= cut], scores[scores >= cut]
                    names = ids.take(pa.array(places)).to_pylist()
                    more = [(score, name) for score, name in zip(scores.tolist(), names, strict=True) if score > 0]
                    # Ties go to the smaller id, null first, as Spark sorts.
                    best[query] = sorted(held + more, key=lambda hit: (-hit[0], hit[1] is not None, hit[1] if hit[1] is not None else 0))[:k]
        hits = [(query, name, score) for query, own in best.items() for score, name in own]
        if hits:
            columns = [pa.array(column, of) for column, of in zip(zip(*hits, strict=True), (query_type, ids.type, pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=[query_id, doc_id, "score"])

    return run


def tfidf_search(
    documents: DataFrame,
    queries: DataFrame,
    k: int = 3,
    doc_id: str = "doc_id",
    query_id: str = "item_id",
    text: str = "text",
    max_broadcast_terms: int = MAX_BROADCAST_TERMS,
) -> DataFrame:
    """The k documents with the highest cosine of tf-idf weights per query.

    ``idf = ln((n + 1) / (df + 1))``; scores are rounded to six decimals and
    ties go to the smaller document id; documents with score 0 are no hits.
    """
    index, idf = build_index(documents, doc_id, text)
    return search_index(index, idf, queries, k, doc_id, query_id, text, max_broadcast_terms)
