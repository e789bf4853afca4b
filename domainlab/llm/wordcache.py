"""Whole texts through the tokenizers library, one library call per distinct piece.

Words are runs of characters other than space and tab to carriage return. For a tokenizer
whose normaliser and pre-tokeniser never look across such a character and drop it, the ids
of a text are the ids of its words one after the other. Texts of plain characters are cut
further, into the pieces that the pre-tokeniser makes, and the library's model is asked
once per distinct piece; a bounded cache in each worker keeps the answers."""

from __future__ import annotations

import json
import os
import struct

import numpy as np

from domainlab.llm import textvec as TV

#: The cache is emptied at this many pieces; longer pieces are not kept.
CACHE_ROWS = 1_000_000
CACHED_BYTES = 64
#: Bytes of text encoded at a time.
CHUNK = 1 << 21


# fixed values: the steps and the pattern of the tokenizer that is cut here
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISED = [("NFC", None), ("Replace", r"\s+"), ("Lowercase", None)]
CUT = [("Split", PATTERN), ("ByteLevel", None)]

# plain characters: visible ASCII without the apostrophe, white space that cuts words, and
# composed Latin-1 letters (0xC3 and one byte); on them PATTERN cuts where the kind of
# character changes and around digits
_KIND = np.full(256, 3, np.uint8)
_KIND[[32, 9, 10, 11, 12, 13]] = 0
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_KIND[48:58] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BAD = np.zeros(256, bool)
_BAD[[*range(9), *range(14, 32), 39, 127, *range(128, 256)]] = True
_BAD[0xC3] = False
_BAD_LATIN = np.zeros(256, bool)
_BAD_LATIN[[0x97, 0xB7]] = True  # signs, not letters


def _byte_chars() -> dict[int, str]:
    """How the byte level writes such letters: bytes that are no visible Latin-1 character
    stand for 256, 257, ... in their order, the others for themselves."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in seen]
    of = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(other)}
    return {x: "".join(of[b] for b in chr(x).encode()) for x in range(0xC0, 0x100)}


_BYTE_CHARS = _byte_chars()


def _steps(config: dict | None, parts: str) -> list[tuple[str, str | None]]:
    steps = (config or {}).get(parts, [])
    return [(x["type"], (x.get("pattern") or {}).get("Regex")) for x in steps]


class WordEncoder:
    """specials_as_text: the special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, specials_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = specials_as_text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        #: the narrowest type that holds every id
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces: dict[bytes, bytes] = {}
        self.marks = [] if specials_as_text else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # words of ASCII and Latin-1 letters can be cut into pieces here, if the tokenizer cuts as this one does
        config = json.loads(self.tokenizer.to_str())
        self.model = self.tokenizer.model if (
            _steps(config["normalizer"], "normalizers") == NORMALISED
            and _steps(config["pre_tokenizer"], "pretokenizers") == CUT) else None

    def _ids(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.dtype.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: bytes) -> bytes:
        """Ids of a lower-case piece."""
        got = self.pieces.get(piece)
        if got is None:
            got = self._ids([t.id for t in self.model.tokenize(piece.decode().translate(_BYTE_CHARS))])
            if len(piece) <= CACHED_BYTES:
                if len(self.pieces) >= CACHE_ROWS:
                    self.pieces.clear()
                self.pieces[piece] = got
        return got

    def _plain(self, c: TV.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Texts of plain characters only: cut into pieces at once, in lower case."""
        kind = _KIND[c.buf]
        lower = _LOWER[c.buf]
        high = np.flatnonzero(c.buf == 0xC3) + 1
        lower[high] = np.where(c.buf[high] < 0x9F, c.buf[high] + 0x20, c.buf[high])
        cut = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        edge = np.zeros(len(kind) + 1, bool)
        edge[1:-1] = cut
        edge[c.offsets] = True
        s = np.flatnonzero(edge[:-1] & (kind > 0))
        e = np.flatnonzero(edge[1:] & (kind > 0)) + 1
        first, which = TV.Chunk(lower, c.offsets, 0).distinct(s, e)
        raw = lower.tobytes()
        ids = [self._piece(raw[a:b]) for a, b in zip(s[first].tolist(), e[first].tolist())]
        flat, n = TV.expand(ids, which, self.dtype)
        return flat, np.bincount(np.searchsorted(c.offsets, s, "right") - 1, weights=n, minlength=c.n).astype(np.int64)

    def _words(self, c: TV.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Any texts: the library is asked once for each distinct word."""
        s, e, doc = c.words()
        first, which = c.distinct(s, e)
        raw = c.buf.tobytes()
        got = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(s[first].tolist(), e[first].tolist())],
                                               add_special_tokens=False)
        flat, n = TV.expand([self._ids(g.ids) for g in got], which, self.dtype)
        return flat, np.bincount(doc, weights=n, minlength=c.n).astype(np.int64)

    def encode(self, c: TV.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk one after the other, and how many each has.
        Equal words are found by a hash and compared by their bytes."""
        odd = np.ones(c.n, bool)
        if self.model is not None and len(c.buf):
            after = np.zeros(len(c.buf), bool)
            after[1:] = c.buf[:-1] == 0xC3
            bad = np.where(after, _BAD_LATIN[c.buf], _BAD[c.buf])
            upto = np.concatenate([[0], np.cumsum(bad)])
            odd = upto[c.offsets[1:]] > upto[c.offsets[:-1]]
            raw = c.buf.tobytes()
            if any(m in raw for m in self.marks):
                odd |= np.array([any(m in raw[a:b] for m in self.marks) for a, b in zip(c.offsets, c.offsets[1:])])
        if odd.all():
            return self._words(c)
        if not odd.any():
            return self._plain(c)
        parts, counts = [None] * c.n, np.zeros(c.n, np.int64)
        for rows, way in ((np.flatnonzero(odd), self._words), (np.flatnonzero(~odd), self._plain)):
            texts = [c.buf[c.offsets[k]:c.offsets[k + 1]] for k in rows]
            own = TV.Chunk(np.concatenate(texts), np.cumsum([0] + [len(t) for t in texts]), 0)
            flat, n = way(own)
            counts[rows] = n
            for k, ids in zip(rows, np.split(flat, np.cumsum(n)[:-1])):
                parts[k] = ids
        return np.concatenate(parts), counts


_LOADED: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, specials_as_text: bool = False) -> WordEncoder:
    """One encoder per Python worker, vocabulary file and treatment of special tokens."""
    key = path, specials_as_text
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(*key)
    return _LOADED[key]
