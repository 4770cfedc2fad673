"""Token ids of whole texts from a public tokenizer file, with a memory of words.

A cut before a space that stands between two visible characters never changes
the pieces a tokenizer sees, nor does one around a line break between such
characters, or one between a letter or digit, that the tokenizer's normaliser
leaves one, and a full stop or comma. So a text is encoded word by word, a word
part by part, and the ids of what was met before are reused: the words of a
batch are found in the memory together, by their own bytes, and their ids put
in place with NumPy. New words of Latin letters are encoded many in a row by the
same model without its pattern for cutting, and told apart by the ids that only
begin or only end a word; other words of letters alone by the tokenizer's own
count of words. A text with other runs of white space is encoded as a whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from corpusloom.llm.common import memory, mix64, use_memory

ROW_WORDS = 500
#: Words of the memory beyond which those that were not met of late are forgotten, half of all.
WORDS_KEPT = 1_500_000
#: Words that are looked up together.
BLOCK = 1 << 18
MARKS = (".", ",")
SPACE, LINE = 32, 10
_ENCODERS: dict = memory("encode", {})

#: Letters that no normaliser joins with their neighbours and that stay one letter in lower case.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+").fullmatch
_PROBE = ["a", "Zebra", "TheAnd", "étÉ", "straße", "Łódź"]
#: The character that stands for each byte in byte-level vocabularies; the space is kept.
_SHOWN = np.arange(256, dtype="<u2")
_SHOWN[[*range(33), *range(127, 161), 173]] = np.arange(256, 324)
LEAD = chr(_SHOWN[SPACE])
_SHOWN[SPACE] = SPACE

#: 64-bit numbers of a key: the bytes of a word, filled up with zeros, and its length in the last byte.
KEY = 3
LONGEST = 8 * KEY - 1
_BYTES = np.array([(1 << 8 * size) - 1 for size in range(9)], dtype=np.uint64)
_TURNS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


def _padded(data: bytes | np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 8 * KEY, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def _keys(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """The key of each word ``data[begin : begin + size]`` of at most ``LONGEST`` bytes; ``data`` is padded."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    out = [eight[begin] & _BYTES[np.minimum(size, 8)]]
    for at in range(8, 8 * KEY, 8):
        column = np.zeros(len(begin), dtype=np.uint64)
        more = np.flatnonzero(size > at)
        column[more] = eight[begin[more] + at] & _BYTES[np.minimum(size[more] - at, 8)]
        out.append(column)
    out[-1] |= size.astype(np.uint64) << np.uint64(56)
    return out


def _longer(values: np.ndarray, filled: int, room: int) -> np.ndarray:
    """The first ``filled`` of ``values`` with room for more; what is not used yet takes no memory."""
    out = np.zeros((room, *values.shape[1:]), dtype=values.dtype)
    out[:filled] = values[:filled]
    return out


class Words:
    """Ids of words; a word that stands for its whole text has the length -1. The words of a call are found together, each by
    all its bytes, in an open table; those longer than a key are in a dict."""

    def __init__(self, room: int = 1 << 14):
        self.count = self.turn = self.filled = 0
        self.long: dict[bytes, int] = {}
        self.keys = np.zeros((room, KEY), dtype=np.uint64)
        self.begin, self.length = np.zeros(room, dtype=np.int64), np.zeros(room, dtype=np.int32)
        self.met = np.zeros(room, dtype=np.int32)
        self.ids = np.zeros(4 * room, dtype="<u4")
        self._spread()

    def _slots(self, keys: list[np.ndarray]) -> np.ndarray:
        mixed = keys[0] * _TURNS[0]
        for column, turn in zip(keys[1:], _TURNS[1:], strict=True):
            mixed = mixed ^ (column * turn)
        return (mix64(mixed) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _spread(self) -> None:
        """A table twice as long as there is room for words, filled anew."""
        self.table = np.full(1 << (2 * len(self.begin) - 1).bit_length(), -1, dtype=np.int32)
        self._enter(np.flatnonzero(self.keys[: self.count, -1]))

    def _enter(self, words: np.ndarray) -> None:
        slot = self._slots([self.keys[words, at] for at in range(KEY)])
        last = len(self.table) - 1
        while len(words):
            free = self.table[slot] < 0
            self.table[slot[free]] = words[free]
            rest = self.table[slot] != words
            words, slot = words[rest], (slot[rest] + 1) & last

    def find(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Number of each word, -1 for one that is not known."""
        out = np.full(len(begin), -1, dtype=np.int64)
        left = np.arange(len(begin))
        if (long := np.flatnonzero(size > LONGEST)).size:
            raw = [data[a : a + n].tobytes() for a, n in zip(begin[long].tolist(), size[long].tolist(), strict=True)]
            out[long] = [self.long.get(word, -1) for word in raw]
            left = np.flatnonzero(size <= LONGEST)
            begin, size = begin[left], size[left]
        keys = _keys(data, begin, size)
        slot, last = self._slots(keys), len(self.table) - 1
        while len(left):
            held = self.table[slot]
            there = self.keys.take(np.maximum(held, 0), axis=0)
            same = held >= 0
            for at, column in enumerate(keys):
                same &= there[:, at] == column
            out[left[same]] = held[same]
            on = np.flatnonzero((held >= 0) & ~same)
            left, slot, keys = left[on], (slot[on] + 1) & last, [column[on] for column in keys]
        self.turn += 1
        self.met[out[out >= 0]] = self.turn
        return out

    def add(self, words: list[bytes], ids: list[bytes | None]) -> None:
        """Different ``words`` that are not known."""
        n = self.count + len(words)
        raw = np.frombuffer(b"".join([one or b"" for one in ids]), dtype="<u4")
        if n > len(self.begin):
            for name in ("keys", "begin", "length", "met"):
                setattr(self, name, _longer(getattr(self, name), self.count, 2 * n))
            self._spread()
        if self.filled + len(raw) > len(self.ids):
            self.ids = _longer(self.ids, self.filled, 2 * (self.filled + len(raw)))
        new = np.arange(self.count, n)
        self.length[new] = [-1 if one is None else len(one) // 4 for one in ids]
        held = np.maximum(self.length[new], 0)
        self.begin[new] = self.filled + np.cumsum(held) - held
        self.met[new] = self.turn
        self.ids[self.filled : self.filled + len(raw)] = raw
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        short = np.flatnonzero(size <= LONGEST)
        for at in np.flatnonzero(size > LONGEST).tolist():
            self.long[words[at]] = self.count + at
        keys = _keys(_padded(b"".join(words)), (np.cumsum(size) - size)[short], size[short])
        self.keys[new] = 0
        self.keys[new[short]] = np.column_stack(keys)
        self.count, self.filled = n, self.filled + len(raw)
        self._enter(new[short])

    def taken(self, words: np.ndarray) -> np.ndarray:
        """The ids of known words, one after the other."""
        size = np.maximum(self.length[words], 0).astype(np.int64)
        return self.ids[np.repeat(self.begin[words] - np.cumsum(size) + size, size) + np.arange(size.sum())]

    def forget(self) -> None:
        """Keep the half that was met last."""
        keep = np.sort(np.argsort(self.met[: self.count], kind="stable")[self.count // 2 :])
        place = np.full(self.count, -1, dtype=np.int64)
        place[keep] = np.arange(len(keep))
        self.long = {word: int(place[at]) for word, at in self.long.items() if place[at] >= 0}
        self.ids = self.taken(keep)
        self.keys, self.length, self.met = self.keys[keep], self.length[keep], self.met[keep]
        size = np.maximum(self.length, 0).astype(np.int64)
        self.begin, self.count, self.filled = np.cumsum(size) - size, len(keep), len(self.ids)
        self._spread()


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. Special strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words = Words()
        self.plain: dict[str, bool] = {}
        self.marks = dict(zip(MARKS, self._ids(list(MARKS)), strict=True))
        self.line = self._ids(["\n"])[0]
        self.mark, self.before = (np.zeros(256, dtype=bool) for _ in range(2))
        self.mark[list(map(ord, MARKS))] = True
        self.before[:128] = [self._stays(chr(code)) for code in range(128)]
        self.bare = Tokenizer.from_file(path)
        self.bare.encode_special_tokens = True
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.lower = self.tokenizer.normalizer is not None
        if self.lower:
            from tokenizers import normalizers

            self.bare.normalizer = normalizers.Sequence([])
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab()
        self.lead = "" if suffix else LEAD
        self.edge = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.edge[[at for word, at in vocabulary.items() if (word.endswith(suffix) if suffix else word.startswith(self.lead))]] = True
        if self._latin(_PROBE) != self._ids([" " + word for word in _PROBE]):
            self.bare = None

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in found]

    def _stays(self, char: str) -> bool:
        """Whether ``char`` is a letter or digit and ends as one when it is normalised, so that a mark after it stands apart."""
        known = self.plain.get(char)
        if known is None:
            normal = self.tokenizer.normalizer.normalize_str(char) if self.tokenizer.normalizer else char
            known = self.plain[char] = char.isalnum() and normal[-1:].isalnum()
        return known

    def _latin(self, words: list[str]) -> list[bytes] | None:
        """Ids of words of Latin letters, each after a space; None if the model's words are not told apart by ids."""
        out: list[bytes] = []
        for at in range(0, len(words), ROW_WORDS * 64):
            rows = [words[a : a + ROW_WORDS] for a in range(at, min(at + ROW_WORDS * 64, len(words)), ROW_WORDS)]
            texts = [" ".join(row) for row in rows]
            texts = [np.frombuffer((text.lower() if self.lower else text).encode(), dtype=np.uint8) for text in texts]
            texts = [_SHOWN[text].tobytes().decode("utf-16-le") for text in texts]
            texts = [self.lead + text.replace(" ", " " + self.lead) for text in texts]
            for row, found in zip(rows, self.bare.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                edges = np.flatnonzero(self.edge[ids])
                edges = [*(4 * edges).tolist(), 4 * len(ids)] if self.lead else [0, *(4 * edges + 4).tolist()]
                if len(edges) != len(row) + 1 or edges[0] or edges[-1] != 4 * len(ids):
                    return None
                raw = ids.tobytes()
                out += [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters alone, each after a space."""
        out: list[bytes] = []
        rows = [words[at : at + ROW_WORDS] for at in range(0, len(words), ROW_WORDS)]
        texts = [" " + " ".join(row) for row in rows]
        for row, found in zip(rows, self.tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            own = np.array(found.word_ids, dtype=np.int64)
            begin = np.flatnonzero(np.diff(own, prepend=-1))
            if len(begin) != len(row):  # some word is not one for the tokenizer
                out += self._ids([" " + word for word in row])
                continue
            ids = array("I", found.ids).tobytes()
            edges = [*(4 * begin).tolist(), len(ids)]
            out += [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        return out

    def _learn(self, fresh: set[str]) -> None:
        """Add words, each with the space before it if there is one."""
        stays = self._stays
        ended = [word for word in fresh if word[-1] in MARKS and stays(word[-2:-1])]
        new = fresh.difference(ended)
        if ended:
            bare = list({word[:-1] for word in ended}.difference(new))
            new.update([word for word, at in zip(bare, self._find(bare).tolist(), strict=True) if at < 0])
        latin, letters, others = [], [], []
        for word in new:
            kind = others if word[0] != " " else latin if _LATIN(word, 1) else letters if word[1:].isalpha() else others
            kind.append(word)
        found = self._latin([word[1:] for word in latin]) if latin and self.bare else None
        if found is None:
            letters, latin, found = letters + latin, [], []
        found += self._letters([word[1:] for word in letters])
        for word, ids in zip(others, self._ids(others), strict=True):
            core = word[1:] if word[0] == " " else word
            found.append(self.line if word == "\n" else None if core[0].isspace() or core[-1].isspace() else ids)
        self.words.add([word.encode() for word in latin + letters + others], found)
        if ended:
            at = self._find([word[:-1] for word in ended])
            size = self.words.length[at].tolist()
            raw = self.words.taken(at).tobytes()
            ids, here = [], 0
            for word, n in zip(ended, size, strict=True):
                ids.append(None if n < 0 else raw[here : here + 4 * n] + self.marks[word[-1]])
                here += 4 * max(n, 0)
            self.words.add([word.encode() for word in ended], ids)

    def _find(self, words: list[str]) -> np.ndarray:
        raw = [word.encode() for word in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        return self.words.find(_padded(b"".join(raw)), np.cumsum(size) - size, size)

    def _known(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of all words, new ones learned."""
        found = self.words.find(data, begin, size)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            first = int(begin[missing[0]])
            raw = data[first : int(begin[missing[-1]] + size[missing[-1]])].tobytes()
            edges = zip((begin[missing] - first).tolist(), (begin[missing] + size[missing] - first).tolist(), strict=True)
            self._learn({word.decode() for word in {raw[a:b] for a, b in edges}})
            found[missing] = self.words.find(data, begin[missing], size[missing])
        return found

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of each text. A word next to white space other than one space or line break stands for the whole text."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else pc.fill_null(texts.cast(pa.large_string()), "")
        n = len(column)
        if not n:
            return []
        edges = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
        held = column.buffers()[2]
        data = _padded(np.frombuffer(held, dtype=np.uint8)[edges[0] : edges[-1]] if held else b"")
        edges = edges - edges[0]
        size = int(edges[-1])
        blank = np.flatnonzero((data[:size] == SPACE) | (data[:size] == LINE))
        line = data[blank] == LINE
        after = data[blank + 1]
        own = np.repeat(np.arange(n), np.diff(np.searchsorted(blank, edges)))
        whole = np.zeros(n, dtype=bool)
        odd = (after == LINE) | np.where(line, blank == edges[own], after == SPACE) | (blank + 1 == edges[own + 1])
        whole[own[odd]] = True
        starts = np.zeros(size + 2, dtype=bool)
        starts[blank] = starts[blank[line] + 1] = starts[edges] = True
        # A mark at the end of a word, after an ASCII letter or digit, is a word of its own.
        ends = np.concatenate([blank, edges[1:]])
        ends = ends[ends > 1]
        ends = ends[self.mark[data[ends - 1]] & self.before[data[ends - 2]] & ~starts[ends - 1]]
        starts[ends - 1] = True
        begin = np.flatnonzero(starts[:size])
        own = np.repeat(np.arange(n), np.diff(np.searchsorted(begin, edges)))
        length = np.diff(begin, append=size)
        kept = np.flatnonzero(~whole[own])
        begin, length, own = begin[kept], length[kept], own[kept]
        parts, sizes = [], np.zeros(len(begin), dtype=np.int64)
        for at in range(0, len(begin), BLOCK):
            if self.words.count > WORDS_KEPT:
                self.words.forget()
            some = slice(at, at + BLOCK)
            found = self._known(data, begin[some], length[some])
            counts = self.words.length[found]
            whole[own[some][counts < 0]] = True
            sizes[some] = np.maximum(counts, 0)
            parts.append(self.words.taken(found).tobytes())
        raw = b"".join(parts)
        last = 4 * np.cumsum(np.bincount(own, weights=sizes, minlength=n).astype(np.int64))
        out = [raw[a:b] for a, b in zip([0, *last.tolist()], last.tolist(), strict=False)]
        again = np.flatnonzero(whole).tolist()
        for at, ids in zip(again, self._ids([column[at].as_py() for at in again]), strict=True):
            out[at] = ids
        return out


def encoder(path: str) -> Encoder:
    """One encoder a worker and file."""
    use_memory("encode")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
