"""Repeated byte passages by longest-previous-factor arrays.

In the order of the suffixes, the previous and the next suffix that starts
earlier in the corpus share the longest prefixes with the one between them: the
longer of the two is its longest previous factor. A start whose factor has
``least`` bytes or more repeats an earlier passage; removing what it covers
removes later copies and keeps the first, and removing the sources too removes
every copy.

No task orders the suffixes of the whole corpus. Every start picks an anchor,
the smallest hash among the ``K``-byte strings inside its next ``least`` bytes,
so equal strings of ``least`` bytes pick equal anchors at the same distance. A
run of starts with one anchor is a segment, and only suffixes of segments with
equal anchors can share ``least`` bytes:

* segments of a chunk of texts that are equal as a whole are settled there, and
  one of them goes on to the bucket of its anchor;
* the bucket settles equal segments of different chunks; an anchor with one
  segment alone is done; where segments differ, one text of each is asked for;
* the texts asked for are cut out of their documents and ordered by anchor, and
  the factor arrays of each bucket are made in its task;
* an anchor with very many different segments (beside a passage that a third of
  all documents share) is settled start by start instead, by digests of its
  ``least`` bytes: starts that are equal within a batch of documents are settled
  there, run by run, and one of them goes on; these spread over all buckets.

Positions are UTF-8 byte offsets, the order of the corpus is doc_id (null
first), then the hash of the text, then the offset. Segments and starts are
taken as equal when two 64-bit hashes of their bytes agree.

A null text is empty, a text shorter than ``least`` bytes keeps everything. Rows
equal in doc_id and text are copies of each other: with ``keep="none"`` each
loses all that is ``least`` bytes long, with ``keep="first"`` they count as one
document and share one result. Texts of any length are worked off in pieces of
bounded size. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import dealt, mix64, ship, stage

K = 32
PIECE, CHUNK = 2 << 20, 24 << 20
#: Different segments of one anchor in a chunk, in a bucket, beyond which it is settled by starts.
HOT_CHUNK, HOT_BUCKET = 64, 4096
BUCKET_BYTES, TEXT_BYTES = 16 << 20, 2 << 20
#: What a chunk or a bucket knows of a segment: several rows hold it, it only tells that its anchor is hot, it was dealt by
#: its digest as part of a hot anchor, it is no segment but a passage already settled.
SEVERAL, MARK, SPREAD, SETTLED = 1, 2, 4, 8
ENTRY = np.dtype([("anchor", "<u8"), ("digest", "<u8"), ("null", "u1"), ("id", "<i8"), ("h", "<i8"), ("at", "<u4"), ("n", "<u4"), ("flag", "u1")])
#: A single start; ``known`` says that it is settled as a repeated one and only tells others.
START = np.dtype([("a", "<u8"), ("b", "<u8"), ("null", "u1"), ("id", "<i8"), ("h", "<i8"), ("at", "<u4"), ("known", "u1")])
RUN = np.dtype([("null", "u1"), ("id", "<i8"), ("h", "<i8"), ("at", "<i8"), ("n", "<i8"), ("later", "u1")])
DEALT = "bucket bigint, entries binary"
JUDGED = "wanted int, doc_id bigint, h bigint, at bigint, n bigint, anchor bigint, later boolean"
CUT = "bucket bigint, doc_id bigint, h bigint, at bigint, n bigint, body binary, starts binary, runs binary"
FOUND = "doc_id bigint, h bigint, at bigint, n bigint, later boolean"


def rolling(data: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of every string of ``k`` bytes (a power of two), by doubling."""
    turns = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)
    h, width = (data.astype(np.uint64) + np.uint64(1)) * turns[0], 1
    h ^= h >> np.uint64(29)
    while width < k:
        near = h[:-width] * turns[width.bit_length() % 4]
        near += h[width:]
        near ^= near >> np.uint64(31)
        near *= turns[(width.bit_length() + 1) % 4]
        near ^= near >> np.uint64(30)
        h, width = near, 2 * width
    return h


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least value of every window, by doubling."""
    place, least, held = np.arange(len(values), dtype=np.int32), values, 1
    while 2 * held <= width:
        nearer = least[held:] < least[:-held]
        least, place = np.where(nearer, least[held:], least[:-held]), np.where(nearer, place[held:], place[:-held])
        held *= 2
    rest = width - held
    if rest:
        place = np.where(least[rest:] < least[:-rest], place[rest:], place[:-rest])
    return place


def suffix_order(data: np.ndarray, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """``starts`` in the order of their suffixes, and their shared prefix with the one before, both up to ``depth`` bytes.

    Ranks of 8 bytes are doubled to ranks of ``depth`` bytes; equal prefixes are ordered by start. A shared prefix shorter than
    ``depth`` is given as 0. Every suffix of ``starts`` has ``depth`` bytes or more.
    """
    padded = np.concatenate([data, np.zeros(depth, dtype=np.uint8)])
    word = np.zeros(len(data), dtype=np.uint64)
    for at in range(min(8, depth)):
        word = word << np.uint64(8) | padded[at : at + len(data)]
    width, rank = min(8, depth), np.unique(word, return_inverse=True)[1].astype(np.uint64)
    while width < depth:
        step = min(width, depth - width)
        far = np.concatenate([rank[step:], np.zeros(step, dtype=np.uint64)])
        width += step
        key = rank << np.uint64(32) | far
        rank = key[starts] if width == depth else np.unique(key, return_inverse=True)[1].astype(np.uint64)
    rank = rank if len(rank) == len(starts) and width > 8 else rank[starts]
    order = np.lexsort((starts, rank))
    shared = np.zeros(len(starts), dtype=np.int64)
    shared[1:] = np.where(rank[order[1:]] == rank[order[:-1]], depth, 0)
    return starts[order], shared


def previous_factors(order: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(length, source) of the longest previous factor of each suffix in ``order``; length 0 and source -1 for none.

    ``shared[i]`` is the common prefix of ``order[i - 1]`` and ``order[i]``. The previous and the next suffix with a smaller
    start are reached by pointers that jump over larger ones, the least shared prefix on the way with them.
    """

    def nearest(start: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = len(start)
        to, low = np.arange(-1, size - 1), common.copy()
        low[:1] = 0
        open_ = np.flatnonzero((to >= 0) & (low > 0))
        while len(open_):
            open_ = open_[(to[open_] >= 0) & (low[open_] > 0)]
            open_ = open_[start[to[open_]] > start[open_]]
            via = to[open_]
            low[open_], to[open_] = np.minimum(low[open_], low[via]), to[via]
        low[to < 0] = 0
        return np.where(low > 0, to, -1), low

    size = len(order)
    before, near = nearest(order, shared)
    turned = np.concatenate([np.zeros(min(1, size), dtype=shared.dtype), shared[:0:-1]])
    after, far = nearest(order[::-1], turned)
    after, far = np.where(after >= 0, size - 1 - after, -1)[::-1], far[::-1]
    place = np.where(near >= far, before, after)
    length = np.maximum(near, far)
    return length, np.where((place >= 0) & (length > 0), order[np.maximum(place, 0)], -1)


def _runs(order: np.ndarray, *same: np.ndarray) -> np.ndarray:
    """Number of the run of rows equal in all of ``same``, which ``order`` puts side by side."""
    fresh = np.zeros(len(order), dtype=bool)
    for column in same:
        fresh[1:] |= column[order[1:]] != column[order[:-1]]
    return np.cumsum(fresh)


def _joined(start: np.ndarray, n: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First rows and summed ``n`` of rows, in order, whose starts follow one another within equal ``same``."""
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = start[1:].astype(np.int64) != start[:-1].astype(np.int64) + n[:-1]
    for column in same:
        fresh[1:] |= column[1:] != column[:-1]
    first = np.flatnonzero(fresh)
    return first, np.add.reduceat(n.astype(np.int64), first) if len(first) else np.zeros(0, dtype=np.int64)


class Chunk:
    """Segments of texts held together."""

    def __init__(self, least: int, piece: int = PIECE, hot: int = HOT_CHUNK):
        self.least, self.piece, self.hot = least, piece, hot
        self.pieces: list[tuple[int, int, int, int, memoryview]] = []
        self.size = self.held = 0
        self.parts: list[np.ndarray] = []

    def add(self, null: int, doc_id: int, h: int, body: memoryview) -> None:
        for at in range(0, len(body) - self.least + 1, self.piece):
            piece = body[at : at + self.piece + self.least - 1]
            self.pieces.append((null, doc_id, h, at, piece))
            self.held += len(piece)
            self.size += len(piece)
            if self.held >= self.piece:
                self.flush()

    def flush(self) -> None:
        if not self.pieces:
            return
        least, pieces = self.least, self.pieces
        joined = b"".join(piece[4] for piece in pieces)
        sizes = np.array([len(piece[4]) for piece in pieces])
        begin = np.cumsum(sizes) - sizes
        hashes = rolling(np.frombuffer(joined, np.uint8))
        place = sliding_least(hashes, least - K + 1)
        counts = sizes - least + 1
        owner = np.repeat(np.arange(len(pieces)), counts)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + begin[owner]
        picked = place[start]
        fresh = np.ones(len(start), dtype=bool)
        fresh[1:] = (picked[1:] != picked[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(fresh)
        found = np.zeros(len(first), dtype=ENTRY)
        found["n"] = np.diff(np.append(first, len(start)))
        found["anchor"] = hashes[picked[first]]
        own = owner[first]
        for at, name in enumerate(("null", "id", "h")):
            found[name] = np.array([piece[at] for piece in pieces])[own]
        found["at"] = np.array([piece[3] for piece in pieces])[own] + start[first] - begin[own]
        digest, view = xxhash.xxh3_64_intdigest, memoryview(joined)
        ends = start[first] + found["n"] + (least - 1)
        found["digest"] = [digest(view[a:b]) for a, b in zip(start[first].tolist(), ends.tolist(), strict=True)]
        self.parts.append(found)
        self.pieces, self.held = [], 0

    def entries(self) -> np.ndarray:
        """One entry of each different segment, the first; of all others what they settle; marks of hot anchors."""
        self.flush()
        every = np.concatenate([np.zeros(0, dtype=ENTRY), *self.parts])
        self.parts, self.size = [], 0
        first, several, rest = _firsts(every)
        first["flag"][several] |= SEVERAL
        rest = rest[np.lexsort((rest["at"], rest["h"], rest["id"], rest["null"]))]
        heads, n = _joined(rest["at"], rest["n"], rest["null"], rest["id"], rest["h"])
        rest = rest[heads]
        rest["n"], rest["flag"], rest["anchor"] = n, SETTLED, mix64(rest["h"].view(np.uint64))
        anchors, which, times = np.unique(first["anchor"], return_inverse=True, return_counts=True)
        hot = times > self.hot
        first["flag"][hot[which]] |= SPREAD
        marks = np.zeros(int(hot.sum()), dtype=ENTRY)
        marks["anchor"], marks["flag"] = anchors[hot], MARK
        return np.concatenate([first, rest, marks])


def _firsts(every: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first entry of each (anchor, digest), whether it is one of several, and the others."""
    order = np.lexsort((every["at"], every["h"], every["id"], 1 - every["null"], every["digest"], every["anchor"]))
    run = _runs(order, every["anchor"], every["digest"])
    head = np.ones(len(order), dtype=bool)
    head[1:] = run[1:] != run[:-1]
    return every[order[head]], np.bincount(run, minlength=int(head.sum())) > 1 if len(run) else np.zeros(0, bool), every[order[~head]]


def _rows(entries: np.ndarray, wanted: int, later: np.ndarray | bool) -> pa.RecordBatch:
    size = len(entries)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(size, wanted, dtype=np.int32)),
            pa.array(entries["id"], mask=entries["null"].astype(bool)),
            pa.array(entries["h"]),
            pa.array(entries["at"].astype(np.int64)),
            pa.array(entries["n"].astype(np.int64)),
            pa.array(entries["anchor"].view(np.int64) if size else np.zeros(0, np.int64)),
            pa.array(np.broadcast_to(later, size)),
        ],
        names=["wanted", "doc_id", "h", "at", "n", "anchor", "later"],
    )


def _later(first: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Whether entries are copies of an earlier document or place than the ``first`` of theirs."""
    return (rest["null"] != first["null"]) | (rest["id"] != first["id"]) | (rest["h"] != first["h"]) | (rest["at"] != first["at"])


def judge(entries: np.ndarray, all_known: bool, most: int = HOT_BUCKET) -> list[pa.RecordBatch]:
    """What a bucket settles (wanted 0), and the segments whose text (1) or starts (2) are asked for.

    With ``all_known`` an anchor whose segments are all held by several rows needs no text: every copy is found already.
    """
    settled = entries[(entries["flag"] & SETTLED) > 0]
    marked = np.unique(entries["anchor"][(entries["flag"] & MARK) > 0])
    segments = entries[(entries["flag"] & (SETTLED | MARK)) == 0]
    first, several, rest = _firsts(segments)
    known = several | ((first["flag"] & SEVERAL) > 0)
    place = np.searchsorted(_key(first), _key(rest)) if len(rest) else np.zeros(0, np.int64)
    # A segment of several rows that is not the first of all: its other rows are settled, its own is settled here.
    out = [_rows(settled, 0, True), _rows(first[known], 0, False), _rows(rest, 0, _later(first[place], rest))]
    anchors, which, times = np.unique(first["anchor"], return_inverse=True, return_counts=True)
    unsettled = np.bincount(which, weights=~known, minlength=len(anchors)) > 0 if all_known else np.ones(len(anchors), bool)
    hot = (times > most) | np.isin(anchors, marked) if len(anchors) else np.zeros(0, bool)
    hot = hot[which] | ((first["flag"] & SPREAD) > 0)
    asked = ((times > 1) & unsettled)[which] & ~hot
    return [*out, _rows(first[asked], 1, known[asked]), _rows(first[hot], 2, known[hot])]


def _key(entries: np.ndarray) -> np.ndarray:
    """(anchor, digest) as one sortable value."""
    out = np.zeros(len(entries), dtype=[("a", "<u8"), ("d", "<u8")])
    out["a"], out["d"] = entries["anchor"], entries["digest"]
    return out


def _together(found: np.ndarray, all_known: bool) -> tuple[np.ndarray, np.ndarray]:
    """What the starts of a batch settle among themselves, as runs, and one start of each digest, the first.

    With ``all_known`` it is not asked whether a start that is known is a later one.
    """
    order = np.lexsort((found["at"], found["h"], found["id"], 1 - found["null"], found["b"], found["a"]))
    found = found[order]
    head = np.ones(len(found), dtype=bool)
    head[1:] = (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])
    several = ~(head & np.append(head[1:], True))
    fresh = found["known"] == 0
    told = several & (fresh | ~(head | all_known))
    runs = _runs_of(found[told], ~head[told])
    found["known"] |= several
    return runs, found[head]


def _cut(
    bodies: pa.Array, asked: pa.ListArray, ids: pa.Array, h: np.ndarray, least: int, buckets: int, all_known: bool
) -> Iterator[pa.RecordBatch]:
    """Texts and starts that were asked for, by the bucket of their anchor or digest, and the runs that the starts settle."""
    names = ["bucket", "doc_id", "h", "at", "n", "body", "starts", "runs"]
    fields = asked.flatten()
    owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
    wanted, at, n, anchor, known = (
        fields.field(name).to_numpy(zero_copy_only=False) for name in ("wanted", "at", "n", "anchor", "later")
    )
    views = [memoryview(body.as_buffer()) for body in bodies]
    plain = np.flatnonzero(wanted == 1)
    if len(plain):
        cuts = [bytes(views[o][a : a + w + least - 1]) for o, a, w in zip(owner[plain].tolist(), at[plain].tolist(), n[plain].tolist(), strict=True)]
        place = (mix64(anchor[plain].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        columns = [
            pa.array(place), ids.take(pa.array(owner[plain])), pa.array(h[owner[plain]]), pa.array(at[plain]), pa.array(n[plain]),
            pa.array(cuts, pa.binary()), *[pa.nulls(len(cuts), pa.binary())] * 2,
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    spread = np.flatnonzero(wanted == 2)
    if len(spread):
        starts = np.repeat(at[spread], n[spread]) + np.arange(n[spread].sum()) - np.repeat(np.cumsum(n[spread]) - n[spread], n[spread])
        own = np.repeat(owner[spread], n[spread])
        found = np.zeros(len(own), dtype=START)
        digest = xxhash.xxh3_128_digest
        raw = b"".join([digest(views[o][a : a + least]) for o, a in zip(own.tolist(), starts.tolist(), strict=True)])
        pair = np.frombuffer(raw, "<u8").reshape(-1, 2)
        found["a"], found["b"], found["at"], found["h"] = pair[:, 0], pair[:, 1], starts, h[own]
        found["null"] = np.asarray(ids.is_null())[own]
        found["id"] = ids.fill_null(0).to_numpy(zero_copy_only=False)[own]
        found["known"] = np.repeat(known[spread], n[spread])
        runs, found = _together(found, all_known)
        place = (found["a"] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        places, heads = np.unique(place[order], return_index=True)
        blobs = [part.tobytes() for part in np.split(found[order], heads[1:])]
        told: list[bytes | None] = [None] * len(blobs)
        told[0] = runs.tobytes()
        size = len(places)
        columns = [
            pa.array(places), *[pa.nulls(size, pa.int64())] * 4, pa.nulls(size, pa.binary()), pa.array(blobs, pa.binary()),
            pa.array(told, pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _runs_of(starts: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Starts side by side as runs; ``later`` is told of each."""
    order = np.lexsort((starts["at"], starts["h"], starts["id"], starts["null"], later))
    starts, later = starts[order], later[order]
    heads, n = _joined(starts["at"], np.ones(len(starts), dtype=np.int64), starts["null"], starts["id"], starts["h"], later)
    out = np.zeros(len(heads), dtype=RUN)
    for name in ("null", "id", "h", "at"):
        out[name] = starts[name][heads]
    out["n"], out["later"] = n, later[heads]
    return out


def _found(runs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array(runs["id"], mask=runs["null"].astype(bool)), pa.array(runs["h"]), pa.array(runs["at"]), pa.array(runs["n"]),
            pa.array(runs["later"].astype(bool)),
        ],
        names=["doc_id", "h", "at", "n", "later"],
    )


def factors_of(rows: pa.Table, least: int, all_known: bool) -> list[pa.RecordBatch]:
    """Repeated starts among the texts of a bucket by their factor arrays, and among its single starts by their digests.

    With ``all_known`` it is not asked whether a start that is known is a later one.
    """
    out = []
    texts = rows.filter(pa.compute.is_valid(rows["body"])).combine_chunks()
    if texts.num_rows > 1:
        null = np.asarray(texts["doc_id"].is_null())
        ids = pa.compute.fill_null(texts["doc_id"], 0).to_numpy()
        h, at, n = (texts[name].to_numpy() for name in ("h", "at", "n"))
        order = np.lexsort((at, h, ids, ~null))
        null, ids, h, at, n = null[order], ids[order], h[order], at[order], n[order]
        bodies = texts["body"].to_pylist()
        bodies = [bodies[place] for place in order.tolist()]
        data = np.frombuffer(b"".join(bodies), np.uint8)
        sizes = n + least - 1
        begin = np.cumsum(sizes) - sizes
        owner = np.repeat(np.arange(len(n)), n)
        starts = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        suffixes, shared = suffix_order(data, starts, least)
        length, source = previous_factors(suffixes, shared)
        hit = length >= least
        for places, later in ((suffixes[hit], True), (np.unique(source[hit]), False)):
            own = owner[np.searchsorted(starts, places)]
            single = np.zeros(len(own), dtype=START)
            single["null"], single["id"], single["h"], single["at"] = null[own], ids[own], h[own], at[own] + places - begin[own]
            out.append(_found(_runs_of(single, np.full(len(own), later))))
    blobs = [blob for blob in rows["starts"].to_pylist() if blob is not None]
    if blobs:
        found = np.frombuffer(b"".join(blobs), START)
        order = np.lexsort((found["at"], found["h"], found["id"], 1 - found["null"], found["b"], found["a"]))
        found = found[order]
        same = np.zeros(len(found) + 1, dtype=bool)
        same[1:-1] = (found["a"][1:] == found["a"][:-1]) & (found["b"][1:] == found["b"][:-1])
        later = same[:-1]
        told = (same[1:] | later) & ((found["known"] == 0) | (later & (not all_known)))
        out.append(_found(_runs_of(found[told], later[told])))
    out += [_found(np.frombuffer(blob, RUN)) for blob in rows["runs"].to_pylist() if blob]
    return out


def _bodies(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("body"))


def passages(
    docs: DataFrame, least: int = 200, keep: str = "none", piece: int = PIECE, chunk_bytes: int = CHUNK,
    hot_chunk: int = HOT_CHUNK, hot_bucket: int = HOT_BUCKET,
) -> DataFrame:
    """(doc_id, h, at, n, later): runs of ``n`` starts from byte ``at`` of the documents with this id and text hash.

    The ``least`` bytes from each of these starts occur elsewhere too; ``later`` says that they do so earlier in the corpus.
    A start may be in several rows. With ``keep="none"`` ``later`` is not told of all that are. The other parameters bound
    what is held at once and say from how many different segments on an anchor is hot; they never change the rows' starts.
    """
    if least < 2 * K:
        raise ValueError(f"passages have {2 * K} bytes or more")
    if keep not in ("none", "first"):
        raise ValueError(f"unknown way to keep copies: {keep}")
    ship(docs.sparkSession)
    bodies = _bodies(docs)
    long = bodies.where(F.octet_length("body") >= least)
    total = long.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    buckets = 16 + total // BUCKET_BYTES

    def deal(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = Chunk(least, piece, hot_chunk)

        def by_bucket() -> pa.RecordBatch:
            entries = chunk.entries()
            key = np.where(entries["flag"] & SPREAD, entries["anchor"] ^ entries["digest"], entries["anchor"])
            place = (mix64(key) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            names, heads = np.unique(place[order], return_index=True)
            parts = np.split(entries[order], heads[1:]) if len(names) else []
            return pa.RecordBatch.from_arrays([pa.array(names), pa.array([part.tobytes() for part in parts], pa.binary())], names=["bucket", "entries"])

        for batch in stream:
            nulls = np.asarray(batch.column(0).is_null()).tolist()
            ids = batch.column(0).fill_null(0).to_pylist()
            for null, doc_id, h, body in zip(nulls, ids, batch.column(1).to_pylist(), batch.column(2), strict=True):
                chunk.add(int(null), doc_id, h, memoryview(body.as_buffer()))
                if chunk.size >= chunk_bytes:
                    yield by_bucket()
            # What is held refers to the batch's memory.
            chunk.flush()
        yield by_bucket()

    def judged(rows: pa.Table) -> pa.Table:
        entries = np.concatenate([np.frombuffer(blob, ENTRY) for blob in rows["entries"].to_pylist()])
        return pa.Table.from_batches(judge(entries, keep == "none", hot_bucket))

    judged_rows = stage(dealt(long.mapInArrow(deal, DEALT), buckets, "bucket").groupBy("bucket").applyInArrow(judged, JUDGED), "segments")
    wanted = judged_rows.where("wanted > 0")
    asked_bytes = wanted.agg(
        F.coalesce(F.sum(F.when(F.col("wanted") == 1, F.col("n") + least).otherwise(F.col("n") * START.itemsize)), F.lit(0))
    ).first()[0]
    parts = 16 + asked_bytes // TEXT_BYTES

    def cut(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            yield from _cut(batch.column(2), batch.column(3), batch.column(0), batch.column(1).to_numpy(), least, parts, keep == "none")

    def factors(rows: pa.Table) -> pa.Table:
        empty = pa.RecordBatch.from_arrays(
            [pa.array([], pa.int64())] * 4 + [pa.array([], pa.bool_())], names=["doc_id", "h", "at", "n", "later"]
        )
        return pa.Table.from_batches([empty, *factors_of(rows, least, keep == "none")])

    per_text = wanted.groupBy("doc_id", "h").agg(F.collect_list(F.struct("wanted", "at", "n", "anchor", "later")).alias("asked"))
    cuts = with_text(bodies, per_text, "asked", "inner").mapInArrow(cut, CUT)
    compared = dealt(cuts, parts, "bucket").groupBy("bucket").applyInArrow(factors, FOUND)
    return judged_rows.where("wanted = 0").select("doc_id", "h", "at", "n", "later").unionByName(compared)


def with_text(bodies: DataFrame, found: DataFrame, column: str, how: str) -> DataFrame:
    """``bodies`` with the ``column`` of ``found`` for the same id and text hash."""
    other = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), column)
    return bodies.join(other, F.col("h").eqNullSafe(F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id")), how).select(
        "doc_id", "h", "body", column
    )


def removed(docs: DataFrame, least: int = 200, keep: str = "none", **held) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the removed runs [start, end) and the bytes that remain.

    ``keep="first"`` removes what a factor of ``least`` bytes repeats, and so keeps the first copy; ``keep="none"`` removes
    the first copy too. ``held`` are the bounds of :func:`passages`.
    """
    found = passages(docs, least, keep, **held)
    if keep == "first":
        found = found.where("later")
    per_text = found.select("doc_id", "h", "at", "n").distinct().groupBy("doc_id", "h").agg(
        F.collect_list(F.struct("at", "n")).alias("runs")
    )

    def apply(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            sizes, spans, kept = [], [], []
            runs = batch.column(3)
            for place, body in enumerate(batch.column(2)):
                raw = memoryview(body.as_buffer())
                own = runs[place].values
                merged: list[tuple[int, int]] = []
                rest: bytes = bytes(raw)
                if own is not None and len(own):
                    at = own.field("at").to_numpy()
                    end = at + own.field("n").to_numpy() + least - 1
                    order = np.argsort(at, kind="stable")
                    at, end = at[order], np.maximum.accumulate(end[order])
                    fresh = np.ones(len(at), dtype=bool)
                    fresh[1:] = at[1:] > end[:-1]
                    heads = np.flatnonzero(fresh)
                    merged = list(zip(at[heads].tolist(), end[np.append(heads[1:], len(at)) - 1].tolist(), strict=True))
                    edges = [0, *[edge for span in merged for edge in span], len(raw)]
                    rest = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in merged])
                kept.append(rest)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    schema = "doc_id bigint, n_bytes bigint, spans array<struct<start: bigint, end: bigint>>, kept binary"
    return with_text(_bodies(docs), per_text, "runs", "left").mapInArrow(apply, schema)


def digest_columns(found: DataFrame) -> list[Column]:
    """Counts and the digest of what :func:`removed` keeps."""
    size = F.aggregate("spans", F.lit(0).cast("bigint"), lambda held, span: held + span["end"] - span["start"])
    return [
        F.col("doc_id"), F.col("n_bytes"), size.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    ]
