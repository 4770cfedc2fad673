"""Token ids in binary shards with a minimal perfect hash index.

Documents are sorted by doc_id over the cluster and encoded where they are
written. A shard is two files: the raw ids (little-endian, 16 bits where the
vocabulary allows it, else 32) and an index. The index maps a key, a doc_id and
its occurrence among equal ids, to a slot by cascaded bit arrays: a key takes
the first array in which no other key of the shard meets it, and its slot is
the number of bits set before, which is kept for every ``RANKED`` bits. Slots
store a 32-bit fingerprint of the key, the place and the number of ids. So one
look-up reads the head of the index, one block of bits and its rank for each
array it tries, two or three as a rule, one slot and one range of raw ids, all by
position and whatever the size of the shard; an absent key is refused but for
one in 2^32.

Files are named by task attempt and only a committed attempt's shards get into
the manifest, so a lost executor leaves at most files that nothing refers to.
``gather`` reads shards back over the cluster, ``fetch`` one document.

Texts of any length are encoded whole, a shard holds one document at least. Null
text is empty and yields the end id; null ids sort first; repeated ids are
told apart by their occurrence, ties in the order of their texts' hash. An
empty table gives an empty manifest. Extra columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import batches_of, fresh_path, mix64, parts_for, ship, stage
from corpusloom.llm.encode import encoder

MAGIC = b"CLIDS002"
SHARD_BYTES = 32 << 20
GAMMA = 2.0
#: Bits of an array for which the number of bits set before them is kept.
RANKED = 512
MANIFEST = "part int, seq int, name string, docs bigint, ids bigint, first_id bigint, last_id bigint"
STEP = np.uint64(0x9E3779B97F4A7C15)


def _position(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of (doc_id, occurrence) per level; different keys part at some level."""
    a, b = keys[:, 0].astype(np.uint64), keys[:, 1].astype(np.uint64)
    turn = np.uint64((level + 1) * int(STEP) & 0xFFFFFFFFFFFFFFFF)
    return mix64(mix64(a ^ turn) + mix64(b ^ mix64(np.array([turn]))[0]))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_position(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def build(keys: np.ndarray) -> list[np.ndarray]:
    """The bit arrays (bools) of distinct ``keys`` (n x 2)."""
    levels, rest = [], keys
    while len(rest):
        size = max(64, int(GAMMA * len(rest)) + 1)
        place = (_position(rest, len(levels)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(place, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[place]]
    return levels


def slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no bit is set for it at any level."""
    out = np.full(len(keys), -1, dtype=np.int64)
    before, open_ = 0, np.arange(len(keys))
    for number, bits in enumerate(levels):
        if not len(open_):
            break
        ranks = np.cumsum(bits)
        place = (_position(keys[open_], number) % np.uint64(len(bits))).astype(np.int64)
        hit = bits[place]
        out[open_[hit]] = before + ranks[place[hit]] - 1
        before += int(ranks[-1])
        open_ = open_[~hit]
    return out


def index_bytes(keys: np.ndarray, starts: np.ndarray, lengths: np.ndarray, nulls: np.ndarray, width: int) -> bytes:
    """The index file: head, bit arrays with their ranks, slots by hash, then the keys in order."""
    levels = build(keys)
    slot = slots(levels, keys)
    mark, start, length = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    mark[slot], start[slot], length[slot] = fingerprints(keys), starts, lengths
    head = MAGIC + struct.pack("<QII", len(keys), width, len(levels))
    head += np.array([(len(bits), int(bits.sum())) for bits in levels], "<u8").tobytes()
    parts = []
    for bits in levels:
        whole = np.zeros(-(-len(bits) // RANKED) * RANKED, dtype=bool)
        whole[: len(bits)] = bits
        counts = whole.reshape(-1, RANKED).sum(axis=1)
        parts += [np.packbits(whole, bitorder="little").tobytes(), (np.cumsum(counts) - counts).astype("<u8").tobytes()]
    parts += [mark.tobytes(), start.tobytes(), length.tobytes()]
    parts += [keys.astype("<i8").tobytes(), nulls.astype("u1").tobytes()]
    return head + b"".join(parts)


HEAD = 24


def _places(head: bytes, sizes: bytes) -> tuple[int, int, list[tuple[int, int, int, int]], int]:
    """(keys, width, levels, first byte of the slots) of an index; a level is its bits, bits set before it, and where its bits
    and ranks begin."""
    n, width, _ = struct.unpack_from("<QII", head, 8)
    at, before, levels = HEAD + len(sizes), 0, []
    for size, ones in np.frombuffer(sizes, "<u8").reshape(-1, 2).tolist():
        blocks = -(-size // RANKED)
        levels.append((size, before, at, at + blocks * RANKED // 8))
        at += blocks * (RANKED // 8 + 8)
        before += ones
    return n, width, levels, at


class Lookup:
    """Keyed access to a shard by position; ``taken`` counts the bytes read."""

    def __init__(self, folder: str, name: str):
        self.files, self.root = opened(folder)
        self.name, self.taken = name, 0
        self.index = self.files.open_input_file(f"{self.root}/{name}.idx")
        head = self._read(self.index, HEAD, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{name} is no shard index")
        sizes = self._read(self.index, 16 * struct.unpack_from("<I", head, 20)[0], HEAD)
        self.n, self.width, self.levels, self.slots = _places(head, sizes)

    def _read(self, source, size: int, at: int) -> bytes:
        self.taken += size
        return source.read_at(size, at)

    def find(self, doc_id: int, number: int) -> int:
        """The slot of a key, -1 if it is absent."""
        key = np.array([[doc_id, number]], dtype=np.int64)
        for level, (size, before, bits, ranks) in enumerate(self.levels):
            place = int(_position(key, level)[0] % np.uint64(size))
            block, inside = divmod(place, RANKED)
            held = np.unpackbits(np.frombuffer(self._read(self.index, RANKED // 8, bits + block * RANKED // 8), np.uint8), bitorder="little")
            if held[inside]:
                rank = struct.unpack("<Q", self._read(self.index, 8, ranks + 8 * block))[0]
                slot = before + rank + int(held[:inside].sum())
                mark = struct.unpack("<I", self._read(self.index, 4, self.slots + 4 * slot))[0]
                return slot if mark == int(fingerprints(key)[0]) else -1
        return -1

    def ids(self, slot: int) -> np.ndarray:
        start = struct.unpack("<Q", self._read(self.index, 8, self.slots + 4 * self.n + 8 * slot))[0]
        length = struct.unpack("<Q", self._read(self.index, 8, self.slots + 12 * self.n + 8 * slot))[0]
        with self.files.open_input_file(f"{self.root}/{self.name}.ids") as raw:
            data = self._read(raw, length * self.width, start * self.width)
        return np.frombuffer(data, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def close(self) -> None:
        self.index.close()


class Shard:
    """A shard with its whole index, for reading all its documents."""

    def __init__(self, folder: str, name: str):
        self.files, root = opened(folder)
        self.raw = self.files.open_input_file(f"{root}/{name}.ids")
        with self.files.open_input_stream(f"{root}/{name}.idx") as stream:
            data = stream.read()
        if data[:8] != MAGIC:
            raise ValueError(f"{name} is no shard index")
        count = struct.unpack_from("<I", data, 20)[0]
        n, self.width, levels, at = _places(data, data[HEAD : HEAD + 16 * count])
        self.levels = []
        for size, _, bits, ranks in levels:
            held = np.frombuffer(data, np.uint8, ranks - bits, bits)
            self.levels.append(np.unpackbits(held, count=size, bitorder="little").astype(bool))
        self.marks = np.frombuffer(data, "<u4", n, at)
        self.starts = np.frombuffer(data, "<u8", n, at + 4 * n)
        self.lengths = np.frombuffer(data, "<u8", n, at + 12 * n)
        self.keys = np.frombuffer(data, "<i8", 2 * n, at + 20 * n).reshape(n, 2)
        self.nulls = np.frombuffer(data, "u1", n, at + 36 * n).astype(bool)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys (doc_id, occurrence), -1 for absent ones."""
        found = slots(self.levels, keys)
        known = found >= 0
        known[known] = self.marks[found[known]] == fingerprints(keys)[known]
        return np.where(known, found, -1)

    def ids(self, slot: int) -> np.ndarray:
        start, length = int(self.starts[slot]), int(self.lengths[slot])
        raw = self.raw.read_at(length * self.width, start * self.width)
        return np.frombuffer(raw, "<u2" if self.width == 2 else "<u4").astype("<u4")

    def close(self) -> None:
        self.raw.close()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(path)
    return store.makeQualified(path).toString()


def write(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, vocabulary: int = 1 << 16, shard_bytes: int = SHARD_BYTES
) -> tuple[str, DataFrame]:
    """Write ``docs`` (doc_id, text) as shards; (folder, manifest in doc_id order).

    ``path`` is a tokenizer file, ``vocabulary`` bounds its ids, ``shard_bytes``
    the raw ids held by a task. The manifest has a row per shard, with ``base``,
    the number of ids of all shards before it.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = _qualified(spark, folder or fresh_path(spark, "token-ids"))
    width = 2 if vocabulary <= 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ordered = rows.repartitionByRange(parts_for(rows), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), F.xxhash64("text")
    )

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:12]
        files, root = opened(folder)
        coder, end = encoder(path), int(end_id).to_bytes(4, "little")
        held: list[tuple[int | None, int, bytes]] = []
        size = seq = 0
        last: tuple | None = None
        times = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, seq
            name = f"shard-{part:06d}-{seq:05d}-{attempt}"
            lengths = np.array([len(raw) // width for _, _, raw in held], dtype=np.uint64)
            starts = np.cumsum(lengths) - lengths
            nulls = np.array([doc_id is None for doc_id, _, _ in held])
            keys = np.array([(doc_id or 0, 2 * number + (doc_id is None)) for doc_id, number, _ in held], dtype=np.int64)
            with files.open_output_stream(f"{root}/{name}.ids") as out:
                for _, _, raw in held:
                    out.write(raw)
            with files.open_output_stream(f"{root}/{name}.idx") as out:
                out.write(index_bytes(keys, starts, lengths, nulls, width))
            row = (part, seq, name, len(held), int(lengths.sum()), held[0][0], held[-1][0])
            held, size, seq = [], 0, seq + 1
            kinds = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            names = ["part", "seq", "name", "docs", "ids", "first_id", "last_id"]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

        for batch in stream:
            for some in batches_of(batch, 256, "text"):
                for doc_id, ids in zip(some.column("doc_id").to_pylist(), coder.encode(some.column("text")), strict=True):
                    times = times + 1 if last == (doc_id,) else 0
                    last = (doc_id,)
                    ids += end
                    if width == 2:
                        wide = np.frombuffer(ids, "<u4")
                        if wide.max() > 0xFFFF:
                            raise ValueError("an id does not fit 16 bits; give the vocabulary's size")
                        ids = wide.astype("<u2").tobytes()
                    held.append((doc_id, times, ids))
                    size += len(ids)
                    if size >= shard_bytes:
                        yield flush()
        if held:
            yield flush()

    manifest = stage(ordered.mapInArrow(run, MANIFEST), "manifest")
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))


def gather(folder: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, each by its key through the index."""
    ship(manifest.sparkSession)
    shards = stage(manifest.select("name", "base"), "shards")

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            for row in batch.to_pylist():
                shard = Shard(folder, row["name"])
                found = shard.find(shard.keys)
                if (found < 0).any():
                    raise ValueError(f"{row['name']}: a stored key is not in its index")
                crc = [zlib.crc32(shard.ids(slot).tobytes()) for slot in found.tolist()]
                shard.close()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(shard.keys[:, 0], pa.int64(), mask=shard.nulls),
                        pa.array(shard.starts[found].astype(np.int64) + row["base"]),
                        pa.array(shard.lengths[found].astype(np.int64)),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    dealt = shards.repartition(max(1, shards.count()))
    return dealt.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def fetch(folder: str, manifest: DataFrame, doc_id: int, occurrence: int = 0) -> np.ndarray | None:
    """Ids of one document, or None, by look-ups in the shards whose range holds the id: one, but for an id that repeats."""
    names = manifest.where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).orderBy("part", "seq")
    for row in names.select("name").collect():
        shard = Lookup(folder, row["name"])
        slot = shard.find(doc_id, 2 * occurrence)
        ids = shard.ids(slot) if slot >= 0 else None
        shard.close()
        if ids is not None:
            return ids
    return None
