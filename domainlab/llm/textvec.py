"""Vectorised views of Arrow string columns: words, lines and their 64-bit hashes.

A word is a run of bytes other than space and tab to carriage return; those bytes never
occur inside a multi-byte UTF-8 character, so everything works on the raw bytes. Memory is
a small multiple of one chunk, and a chunk is at least one whole text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_STEP, _LENGTH = np.random.RandomState(20240).randint(0, 2**63 - 1, 2).astype(U64) * U64(2) + U64(1)
#: the mask of the first 0 .. 8 bytes of a little-endian number
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply); bijective."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


class Chunk:
    """Consecutive texts of one batch. buf: their bytes; offsets: n + 1 positions in buf;
    first: the index of the first text in the batch."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, first: int):
        self.buf, self.offsets, self.first = buf, offsets, first
        self.n = len(offsets) - 1
        self._runs = None

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each word, in order."""
        solid = ~_SPACE[self.buf]
        bounds = self.offsets[(self.offsets > 0) & (self.offsets < len(self.buf))]
        start, end = solid.copy(), solid.copy()
        start[1:] &= ~solid[:-1]
        end[:-1] &= ~solid[1:]
        start[bounds] = solid[bounds]
        end[bounds - 1] = solid[bounds - 1]
        s = np.flatnonzero(start)
        e = np.flatnonzero(end) + 1
        return s, e, np.searchsorted(self.offsets, s, "right") - 1

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text index of each \\n-separated line (an empty text has one)."""
        nl = np.flatnonzero(self.buf == 10)
        s = np.sort(np.concatenate([self.offsets[:-1], nl + 1]), kind="stable")
        e = np.sort(np.concatenate([self.offsets[1:], nl]), kind="stable")
        doc = np.repeat(np.arange(self.n), np.bincount(
            np.searchsorted(self.offsets, nl, "right") - 1, minlength=self.n) + 1)
        return s, e, doc

    def hashes(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range: each run of 8 bytes is scrambled together with
        its place in the range, and the sum of them with the length."""
        if not len(s):
            return np.zeros(0, U64)
        if self._runs is None:
            padded = np.concatenate([self.buf, np.zeros(8, np.uint8)])
            self._runs = np.ndarray(len(self.buf) + 1, "<u8", padded, strides=(1,))
        size = e - s
        blocks = np.maximum((size + 7) >> 3, 1)
        first = np.cumsum(blocks) - blocks
        place = np.arange(int(blocks.sum())) - np.repeat(first, blocks)
        at = np.repeat(s, blocks) + 8 * place
        left = np.minimum(np.repeat(e, blocks) - at, 8)
        h = mix((self._runs[at] & _LOW[left]) + (place + 1).astype(U64) * _STEP)
        if len(h) > len(s):
            h = np.add.reduceat(h, first)
        return mix(h + size.astype(U64) * _LENGTH)

    def distinct(self, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of one of each set of equal ranges, and for each range the number of its
        set. Ranges of equal hash are compared byte by byte."""
        first, which = distinct(self.hashes(s, e))
        like = first[which]
        size = e - s
        same = bool((size == size[like]).all())
        if same:
            other = np.flatnonzero((like != np.arange(len(s))) & (size > 0))
            for lo in range(0, len(other), 1 << 16):
                k = other[lo:lo + (1 << 16)]
                n = size[k]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                if not np.array_equal(self.buf[np.repeat(s[k], n) + step], self.buf[np.repeat(s[like[k]], n) + step]):
                    same = False
                    break
        if same:
            return first, which
        raw = self.buf.tobytes()
        seen: dict[bytes, int] = {}
        which = np.array([seen.setdefault(raw[a:z], len(seen)) for a, z in zip(s.tolist(), e.tolist())], np.int64)
        return np.unique(which, return_index=True)[1], which


def chunks(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[Chunk]:
    """The whole column in runs of texts of about ``most_bytes``; nulls are empty texts."""
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[
        column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most_bytes, "right")) - 1)
        yield Chunk(raw[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i], i)
        i = j


def shingles(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of each run of ``width`` words; a text of fewer words but at
    least one is a single run."""
    n = len(words)
    if not n:
        return words, doc
    h = words.copy()
    full = np.ones(n, bool)
    for k in range(1, width):
        nxt = np.zeros(n, U64)
        same = np.zeros(n, bool)
        if k < n:
            nxt[:n - k] = words[k:]
            same[:n - k] = doc[k:] == doc[:n - k]
        h = np.where(same, mix(h * U64(0xD6E8FEB86659FD93) + nxt), h)
        full &= same
    first = np.ones(n, bool)
    first[1:] = doc[1:] != doc[:-1]
    short = first & (np.bincount(doc, minlength=doc[-1] + 1)[doc] < width)
    keep = full | short
    return h[keep], doc[keep]


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of one range of each hash, and for each range the number of its hash."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    return first, inverse


def expand(values: list[bytes], which: np.ndarray, dtype: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """values[which[0]], values[which[1]], ... one after the other as one array, and the
    length of each. values: the bytes of arrays of the given type."""
    flat = np.frombuffer(b"".join(values), dtype)
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // np.dtype(dtype).itemsize
    return gather(flat, sizes, which)


def gather(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for values that stand one after the other in an array."""
    begin = np.cumsum(sizes) - sizes
    n = sizes[which]
    shift = begin[which] - (np.cumsum(n) - n)
    return flat[np.repeat(shift, n) + np.arange(int(n.sum()))], n
