"""Texts cut into segments whose ids don't depend on what stands around them, and remembered ids of segments."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

from .common import eights, low_bytes

GAP, LETTER, DIGIT, MARK, ODD = range(5)
#: Classes of bytes. Odd are an apostrophe (it begins a match of its own in both patterns), control character 1 (it stands
#: between words given to the tokenizer), and all bytes beyond ASCII but for those of the letters from U+00C0 to U+00FF.
CLASS = np.full(256, ODD, np.uint8)
CLASS[:128] = MARK
CLASS[[0x20, *range(0x09, 0x0E)]] = GAP
CLASS[[*range(65, 91), *range(97, 123)]] = LETTER
CLASS[48:58] = DIGIT
CLASS[[39, 1]] = ODD
#: Second bytes after 0xC3 that make a letter; the other two are signs.
_SECOND = np.zeros(256, bool)
_SECOND[0x80:0xC0] = True
_SECOND[[0x97, 0xB7]] = False


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts together, and offsets into them. Nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, kind, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    part = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return part, offsets - offsets[0]


def classes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Class of each byte; all bytes of a run between gaps are odd if one is."""
    found = CLASS[data]
    if len(data):
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[_SECOND[data[lead + 1]]]
        found[lead], found[lead + 1] = LETTER, LETTER
        odd = found == ODD
        if odd.any():
            begins = found != GAP
            run_start = np.empty(len(data), bool)
            run_start[0], run_start[1:] = True, begins[1:] != begins[:-1]
            run_start[offsets[:-1][offsets[:-1] < len(data)]] = True
            run = np.cumsum(run_start) - 1
            bad = np.zeros(run[-1] + 1, bool)
            bad[run[odd]] = True
            found[bad[run]] = ODD
    return found


def runs(found: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places where the class changes or a text begins."""
    if not len(found):
        return np.zeros(0, np.int64)
    new = np.empty(len(found), bool)
    new[0], new[1:] = True, found[1:] != found[:-1]
    new[offsets[:-1][offsets[:-1] < len(found)]] = True
    return np.flatnonzero(new)


class Memory:
    """Ids of segments, found by their 64-bit hash and then compared byte by byte. learn() gives ids of new segments; beyond most
    entries the memory starts anew. A segment whose hash another one has is learnt each time."""

    BITS = 20

    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], most: int = 800_000, most_bytes: int = 32 << 20) -> None:
        self.learn, self.most, self.most_bytes = learn, most, most_bytes
        self._restart()

    def _restart(self) -> None:
        self.slot = [np.zeros(1 << self.BITS, np.int32) for _ in range(2)]
        self.keys, self.at, self.size = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)
        self.pool, self.used, self.count = np.zeros(1 << 18, np.uint32), 0, 1  # entry 0 is none
        self.text, self.text_at, self.text_size, self.text_used = np.zeros(1 << 20, np.uint8), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0
        self.rest: dict[int, int] = {}

    def _room(self, entries: int, ids: int, raw: int) -> None:
        while self.count + entries > len(self.keys):
            self.keys, self.at, self.size, self.text_at, self.text_size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.keys, self.at, self.size, self.text_at, self.text_size))
        while self.text_used + raw + 8 > len(self.text):
            self.text = np.concatenate([self.text, np.zeros_like(self.text)])
        while self.used + ids > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])

    def _slots(self, h: np.ndarray) -> list[np.ndarray]:
        mask = np.uint64((1 << self.BITS) - 1)
        return [(h & mask).astype(np.int64), (h >> np.uint64(40) & mask).astype(np.int64)]

    def _find(self, h: np.ndarray) -> np.ndarray:
        first, second = self._slots(h)
        entry = self.slot[0][first]
        miss = np.flatnonzero(self.keys[entry] != h)
        other = self.slot[1][second[miss]]
        other[self.keys[other] != h[miss]] = 0
        entry[miss] = other
        return entry

    def _add(self, h: np.ndarray, raw: list[bytes]) -> np.ndarray:
        """Entries of segments that are new."""
        ids = self.learn(raw)
        lengths, sizes = np.array([len(x) for x in ids], np.int32), np.array([len(x) for x in raw], np.int64)
        self._room(len(raw), int(lengths.sum()), int(sizes.sum()))
        k = np.arange(self.count, self.count + len(raw), dtype=np.int32)
        flat, text = np.concatenate(ids) if ids else np.zeros(0, np.uint32), np.frombuffer(b"".join(raw), np.uint8)
        self.pool[self.used : self.used + len(flat)] = flat
        self.text[self.text_used : self.text_used + len(text)] = text
        self.keys[k], self.size[k], self.text_size[k] = h, lengths, sizes
        self.at[k] = self.used + np.cumsum(lengths) - lengths
        self.text_at[k] = self.text_used + np.cumsum(sizes) - sizes
        self.used, self.text_used, self.count = self.used + len(flat), self.text_used + len(text), self.count + len(raw)
        return k

    def _other(self, entry: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places of segments that aren't what their entries hold."""
        n = end - start
        bad = self.text_size[entry] != n
        at, j = np.flatnonzero(~bad), 0
        here, there = eights(data), np.ndarray((len(self.text) - 7,), "<u8", self.text, 0, (1,))
        while len(at) and j <= 256:
            same = ((here[start[at] + j] ^ there[self.text_at[entry[at]] + j]) & low_bytes(n[at] - j)) == 0
            bad[at[~same]] = True
            j += 8
            at = at[same]
            at = at[n[at] > j]
        for i in at.tolist():
            a = int(self.text_at[entry[i]])
            bad[i] = not np.array_equal(data[start[i] : end[i]], self.text[a : a + int(n[i])])
        return np.flatnonzero(bad)

    def lookup(self, h: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments one after another, and how many each has."""
        if self.count > self.most or self.text_used > self.most_bytes:
            self._restart()
        raw = lambda at: [data[a:b].tobytes() for a, b in zip(start[at].tolist(), end[at].tolist())]
        entry = self._find(h)
        miss = np.flatnonzero(entry == 0)
        if len(miss):
            own, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            found = np.array([self.rest.get(x, 0) for x in own.tolist()], np.int32) if self.rest else np.zeros(len(own), np.int32)
            new = np.flatnonzero(found == 0)
            if len(new):
                k = left = found[new] = self._add(own[new], raw(miss[first[new]]))
                for slot, place in zip(self.slot, self._slots(own[new])):
                    p = place[left - k[0]]
                    free = slot[p] == 0
                    slot[p[free]] = left[free]
                    left = left[slot[p] != left]
                self.rest.update(zip(self.keys[left].tolist(), left.tolist()))
            entry[miss] = found[back]
        if len(other := self._other(entry, data, start, end)):
            entry[other] = self._add(h[other], raw(other))
        size = self.size[entry].astype(np.int64)
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.pool[np.repeat(self.at[entry] - (ends - size), size) + np.arange(total)], size


def per_text(size: np.ndarray, start: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Bounds of the texts' ids."""
    ends = np.concatenate([[0], np.cumsum(size)])
    return ends[np.searchsorted(start, offsets, "left")]


def binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Little-endian bytes of ranges of an array, without a copy for each."""
    width = flat.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(flat))])
