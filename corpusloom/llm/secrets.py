"""Secrets in texts, also under layers of encoding.

The patterns are run over the text itself and over every layer that decoding
uncovers: percent escapes and Unicode escapes rewrite a whole layer, a base64
run, also one wrapped over lines, or compressed data (gzip, zlib, bzip2, xz, all
members) opens a layer of its own. A run that is not plain text as a whole is
decoded from each of its first four characters, so that what is glued to it does
not hide it; compressed data is looked for after each line break and each of the
characters ``+/_-`` too. Bytes that are no text hide nothing else. A worklist holds the layers still to be read; a layer seen before at the same
place (a cycle) is not read again, and the list runs until it is empty. Each
character of a layer knows the range of the original text it came from, so
every span is given in code points of the original.

Texts of any length are read whole, and so is every layer. Null text is empty and
has no secrets. Equal spans found in several layers
count once. Rows are independent: repeated rows, null or equal ids give rows of
their own, an empty table none. Extra columns are kept by ``redact`` and not
read otherwise.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import itertools
import lzma
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import per_batch

# Kinds in order and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|((?:\\u[0-9A-Fa-f]{4})+)|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:[ \t]*+\r?\n[ \t]*+[A-Za-z0-9+/_-]++)+={0,2}")
PIECE = re.compile(r"[A-Za-z0-9+/_-]+")
GLUE = re.compile(r"[+/_-]")
UNCLEAN = re.compile("[\x00-\x08\x0e-\x1f\x7f\udc80-\udcff]")
LEAST = 16
STEP_BYTES = 1 << 20
#: Bytes of compressed data that are scanned at a time.
LAYER_BYTES = 1 << 20
#: No pattern has one of these characters, nor a single blank between words; no encoded run either.
CUT = re.compile(rb"[!#$&()*,;<>?@\[\]^`|~]|[A-Za-z0-9+/_-] (?=[A-Za-z0-9+/_-])")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost spans per kind, failing matches dropped."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def _unpacker(head: bytes):
    """What unpacks data that begins like this; None if it is not compressed."""
    if head[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if head[:1] == b"\x78" and len(head) > 1 and (head[0] << 8 | head[1]) % 31 == 0:
        return zlib.decompressobj(15)
    if head[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    if head[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor()
    return None


def _members(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """The plain data of all compressed members, piece by piece, as far as it can be unpacked."""
    held, unpacker = b"", None
    for chunk in itertools.chain(chunks, [None]):
        held += chunk or b""
        while held:
            if unpacker is None:
                # xz pads with zeros between members.
                held = held.lstrip(b"\0")
                if len(held) < 6 and chunk is not None:
                    break
                unpacker = _unpacker(held)
                if unpacker is None:
                    return
            try:
                while not unpacker.eof:
                    out = unpacker.decompress(held, STEP_BYTES)
                    held = getattr(unpacker, "unconsumed_tail", b"")
                    if out:
                        yield out
                    elif not held:
                        break
            except (zlib.error, OSError, EOFError, lzma.LZMAError):
                return
            if not unpacker.eof:
                break
            held, unpacker = unpacker.unused_data, None


def _plain(data: Iterator[bytes]) -> Iterator[bytes]:
    """Plain data of compressed data; nested compression has no text in between."""
    chunks, seen = _members(data), set()
    while (first := next(chunks, None)) is not None:
        chunks = itertools.chain([first], chunks)
        if first in seen or next(_members(iter([first])), None) is None:
            yield from chunks
            return
        seen.add(first)
        chunks = _members(chunks)


def _text(data: bytes) -> str:
    """Bytes that are not UTF-8 become lone surrogates, which no pattern has."""
    return data.decode("utf-8", "surrogateescape")


def _texts(chunks: Iterator[bytes], size: int) -> Iterator[str]:
    """Plain data as texts of ``size`` bytes and more, cut only where no pattern and no encoded run goes on."""
    held, searched = bytearray(), 0
    for chunk in chunks:
        held += chunk
        if len(held) < size:
            continue
        cut = 0
        for back in (1 << 12, 1 << 16, len(held)):
            for found in CUT.finditer(held, max(searched, len(held) - back)):
                cut = found.end()
            if cut:
                yield _text(held[:cut])
                del held[:cut]
                break
        # A cut needs up to three bytes.
        searched = 0 if cut else max(0, len(held) - 2)
    if held:
        yield _text(held)


class Layer:
    """A text whose characters map to ranges of the original; no map means it is the original."""

    def __init__(self, text: str, starts: list[int] | None = None, ends: list[int] | None = None):
        self.text, self.starts, self.ends = text, starts, ends

    def original(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return min(self.starts[start:end]), max(self.ends[start:end])


def _rewritten(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match replaced by what ``decode`` makes of it: pieces (text, from, to) of the match."""
    parts, starts, ends, at, changed = [], [], [], 0, False

    def keep(start: int, end: int) -> None:
        parts.append(layer.text[start:end])
        if layer.starts is None:
            starts.extend(range(start, end))
            ends.extend(range(start + 1, end + 1))
        else:
            starts.extend(layer.starts[start:end])
            ends.extend(layer.ends[start:end])

    for match in pattern.finditer(layer.text):
        pieces = decode(match)
        if pieces is None:
            continue
        keep(at, match.start())
        for text, low, high in pieces:
            start, end = layer.original(match.start() + low, match.start() + high)
            parts.append(text)
            starts.extend([start] * len(text))
            ends.extend([end] * len(text))
        at, changed = match.end(), True
    if not changed:
        return None
    keep(at, len(layer.text))
    return Layer("".join(parts), starts, ends)


def _percent(match: re.Match):
    pieces, at = [], 0
    for char in _text(bytes.fromhex(match.group().replace("%", ""))):
        size = 3 * len(char.encode("utf-8", "surrogateescape"))
        pieces.append((char, at, at + size))
        at += size
    return pieces


def _escape(match: re.Match):
    braced, run, long, byte = match.groups()
    if run:
        pieces, at = [], 0
        for char in bytes.fromhex(run.replace("\\u", "")).decode("utf-16-be", "surrogatepass"):
            size = 6 * (len(char.encode("utf-16-be", "surrogatepass")) // 2)
            pieces.append((char, at, at + size))
            at += size
        return pieces
    code = int(braced or long or byte, 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, match.end() - match.start())]


def _runs(text: str) -> Iterator[tuple[str, list[range], int, bool]]:
    """Base64 runs of ``text``: characters, their places by piece, the end with its padding, whether it was wrapped."""
    for match in WRAPPED.finditer(text):
        pieces = [range(*found.span()) for found in PIECE.finditer(text, *match.span())]
        if sum(map(len, pieces)) >= LEAST:
            yield "".join(text[piece.start : piece.stop] for piece in pieces), pieces, match.end(), True
    for match in BASE64.finditer(text):
        body = match.group().rstrip("=")
        yield body, [range(match.start(), match.start() + len(body))], match.end(), False


def _decoded(body: str) -> bytes:
    if len(body) % 4 == 1:
        body = body[:-1]
    return binascii.a2b_base64(body + "=" * (-len(body) % 4))


def _decoded_pieces(body: str, at: int) -> Iterator[bytes]:
    """``body`` from ``at`` on, so that what proves not to be compressed is not decoded to its end."""
    for start in range(at, len(body), STEP_BYTES >> 4):
        yield _decoded(body[start : start + (STEP_BYTES >> 4)])


def _worth(text: str) -> bool:
    """Whether a pattern or a further encoding could be in ``text``."""
    patterns = (ASSIGN, ACCESS, HEX, PERCENT, ESCAPE, BASE64, WRAPPED)
    return any(pattern.search(text) for pattern in patterns)


def _opened(layer: Layer, limit: int) -> Iterator[Layer]:
    """Layers inside the base64 runs of ``layer``."""
    whole: list[tuple[int, int]] = []
    for run, pieces, stop, wrapped in _runs(layer.text):
        if not wrapped:
            # Lines of a wrapped run that was read as a whole are not read again.
            while whole and whole[0][1] <= pieces[0].start:
                whole.pop(0)
            if whole and whole[0][0] <= pieces[0].start:
                continue
        body = run.replace("-", "+").replace("_", "/")
        places = pieces[0] if len(pieces) == 1 else list(itertools.chain(*pieces))
        breaks = itertools.accumulate(map(len, pieces[:-1]))
        unpacked = None
        for at in sorted({0, 1, 2, 3, *breaks, *(found.end() for found in GLUE.finditer(run))}):
            if len(body) - at < 4 or _unpacker(_decoded(body[at : at + 12])) is None:
                continue
            start, end = layer.original(places[at], stop)
            for text in _texts(_plain(_decoded_pieces(body, at)), limit):
                unpacked = at if unpacked is None else unpacked
                yield Layer(text, [start] * len(text), [end] * len(text))
        if unpacked == 0:
            if wrapped:
                whole.append((places[0], stop))
            continue
        for phase in range(4):
            text = _text(_decoded(body[phase:]))
            if _worth(text):
                starts, ends, at = [], [], 0
                for char in text:
                    size = len(char.encode("utf-8", "surrogateescape"))
                    low, high = phase + at * 4 // 3, phase - (-(at + size) * 4 // 3)
                    start, end = layer.original(places[low], places[min(len(places), high) - 1] + 1)
                    starts.append(start)
                    ends.append(end)
                    at += size
                yield Layer(text, starts, ends)
            if phase == 0 and not UNCLEAN.search(text):
                if wrapped:
                    whole.append((places[0], stop))
                break


def all_spans(text: str, limit: int = LAYER_BYTES) -> list[Span]:
    """Base spans and those of every decoded layer, sorted by start, kind and end.

    Compressed layers are unpacked and scanned to their end, about ``limit``
    bytes at a time.
    """
    rank = {kind: at for at, kind in enumerate(KINDS)}
    found: set[Span] = set()
    work, seen = [iter([Layer(text)])], set()
    while work:
        if (layer := next(work[-1], None)) is None:
            work.pop()
            continue
        if layer.starts is not None:
            place = (layer.starts[0], layer.ends[-1]) if layer.starts else (0, 0)
            mark = (hashlib.blake2b(layer.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), place)
            if mark in seen:
                continue
            seen.add(mark)
        for kind, start, end in base_spans(layer.text):
            found.add((kind, *layer.original(start, end)))
        if "%" in layer.text and (plain := _rewritten(layer, PERCENT, _percent)):
            work.append(iter([plain]))
        if "\\" in layer.text and (plain := _rewritten(layer, ESCAPE, _escape)):
            work.append(iter([plain]))
        work.append(_opened(layer, limit))
    return sorted(found, key=lambda span: (span[1], rank[span[0]], span[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def base_sorted(text: str) -> list[Span]:
    rank = {kind: at for at, kind in enumerate(KINDS)}
    return sorted(base_spans(text), key=lambda span: (span[1], rank[span[0]], span[2]))


def blank(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with the union of the spans replaced by ``mark``."""
    parts, at = [], 0
    merged: list[list[int]] = []
    for _, start, end in sorted(spans, key=lambda span: span[1]):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    for start, end in merged:
        parts += [text[at:start], mark]
        at = end
    return "".join(parts) + text[at:]


SCHEMA = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans and the list of all spans of each document (doc_id, text)."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[list] = [[] for _ in range(5)]
            for text in batch.column("text").to_pylist():
                base, every = base_sorted(text or ""), all_spans(text or "")
                kinds = [kind for kind, _, _ in base]
                row = (*(kinds.count(kind) for kind in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types, strict=True))],
                names=[part.split()[0] for part in SCHEMA.split(", ")],
            )

        return step

    return per_batch(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), make, SCHEMA, 256, "text")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; other columns and clean texts are as before."""
    names = docs.columns

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = []
            for text in batch.column("text").to_pylist():
                spans = all_spans(text) if text else []
                texts.append(blank(text, spans, mark) if spans else text)
            at = names.index("text")
            return batch.set_column(at, pa.field("text", pa.string()), pa.array(texts, pa.string()))

        return step

    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in docs.schema)
    return per_batch(docs, make, schema, 256, "text")
