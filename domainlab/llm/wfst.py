"""SentencePiece encoding and decoding as a weighted finite-state transducer.

Three machines are compiled once per vocabulary:

* the normaliser writes a space as U+2581 and puts one in front of a text;
* the lexicon reads a piece's characters and writes its id; a character that begins no
  one-character piece is written as the byte pieces of its UTF-8 form (byte fallback);
* the chooser weighs sequences of pieces. For a unigram vocabulary the weight of a piece
  is minus its score. For a byte-pair vocabulary it is an acceptor over neighbouring pieces:
  weight 0 where merging the two pieces' characters by rank gives exactly these two pieces,
  infinite elsewhere. A sequence is what byte-pair merging makes of its text if and only if
  all neighbours pass, because a merge across a boundary would be the best merge within
  the two pieces beside it as well.

An input is composed with the three lazily, one character after the other, and the
shortest path in the tropical semiring is taken in that topological order. With the
neighbour acceptor, every prefix of a text has exactly one path of finite weight.

Composition is independent on both sides of two neighbouring characters that no piece
joins (a letter and U+2581, say), so texts are cut there, and the paths of short cuts are
kept in a bounded cache per worker. The last chain of unknown characters of a vocabulary
without byte fallback is one unknown id within a cut.

Null texts count as empty; an empty text has no ids and decodes to an empty text. Repeated
rows each get a row; an empty table gives an empty result; only the two named columns are
read, so extra columns do no harm."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from domainlab.llm import textvec as TV

SPACE = "▁"
#: Longer cuts are not cached; the caches are emptied at these sizes.
CACHED_BYTES = 64
CACHE_ROWS = 600_000
PAIR_ROWS = 600_000


class PieceTransducer:
    """The three machines of one vocabulary. kind: "bpe" or "unigram"."""

    def __init__(self, pieces: list[str], scores: list[float], kind: str,
                 byte_ids: list[int] | None, unknown: int, plain: list[bool],
                 dummy_prefix: bool = True):
        self.pieces, self.kind, self.unknown, self.dummy = pieces, kind, unknown, dummy_prefix
        self.byte_ids = byte_ids
        self.lexicon = {p: i for i, p in enumerate(pieces) if plain[i]}
        self.scores = scores
        self.longest = max(map(len, self.lexicon), default=1)
        self.floor = min((scores[i] for i in self.lexicon.values()), default=0.0)
        # neighbouring bytes between which no cut may be: a piece joins them, all characters
        # beyond ASCII being taken as one
        self._join = np.zeros((256, 256), bool)
        self._join[128:, 128:] = True
        for p in self.lexicon:
            p = p.replace(SPACE, " ")
            for a, b in zip(p, p[1:]):
                self._join[ord(a) if a < "\x80" else slice(128, 256), ord(b) if b < "\x80" else slice(128, 256)] = True
        self._join = self._join.ravel()
        self._known: dict[bytes, bytes] = {}
        self._pairs: dict[str, dict[str, bool]] = {}
        self._n_pairs = 0
        # the lexicon's states: the next state by character, and the piece that ends here
        self._trie: dict = {}
        for p in self.lexicon:
            state = self._trie
            for c in p:
                state = state.setdefault(c, {})
            state[""] = p
        self._of_byte = {b: k for k, b in enumerate(byte_ids)} if byte_ids else {}
        self._bytes = [bytes([self._of_byte[i]]) if i in self._of_byte else p.encode()
                       for i, p in enumerate(pieces)]

    @staticmethod
    def load(path: str) -> PieceTransducer:
        """Reads a SentencePiece model file's pieces, scores and normaliser settings. Only
        the identity normaliser (without a character map) is compiled."""
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        n = proto.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.escape_whitespaces:
            raise ValueError("only the identity normaliser is supported")
        kinds = pb.ModelProto.SentencePiece
        pieces = [p.piece for p in proto.pieces]
        ids = {p: i for i, p in enumerate(pieces)}
        fallback = [ids[f"<0x{b:02X}>"] for b in range(256)] if proto.trainer_spec.byte_fallback else None
        plain = [p.type in (kinds.NORMAL, kinds.USER_DEFINED) for p in proto.pieces]
        return PieceTransducer(
            pieces, [p.score for p in proto.pieces],
            "bpe" if proto.trainer_spec.model_type == pb.TrainerSpec.BPE else "unigram",
            fallback, proto.trainer_spec.unk_id, plain, n.add_dummy_prefix)

    # ------------------------------------------------------------------ chooser
    def merge(self, text: str) -> list[str]:
        """Byte-pair merging of a short text: the best-scored neighbours first, the
        leftmost of equals."""
        parts = list(text)
        lexicon, scores = self.lexicon, self.scores
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = lexicon.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, a: str, b: str) -> bool:
        """Does the chooser let piece b follow piece a (an empty a: begin a text)?"""
        ok = self.merge(a + b) == ([a, b] if a else [b])
        if self._n_pairs >= PAIR_ROWS:
            self._pairs.clear()
            self._n_pairs = 0
        self._pairs.setdefault(a, {})[b] = ok
        self._n_pairs += 1
        return ok

    # ------------------------------------------------------------------ paths
    def _write(self, parts: list[str]) -> list[int]:
        out: list[int] = []
        for p in parts:
            i = self.lexicon.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in p.encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def _pieces_at(self, s: str, i: int) -> list[str]:
        """The pieces that begin at a position, short ones first; one character always does."""
        out = [s[i]]
        state = self._trie.get(s[i])
        if state:
            for c in s[i + 1:i + self.longest]:
                state = state.get(c)
                if state is None:
                    break
                p = state.get("")
                if p is not None:
                    out.append(p)
        return out

    def _path_bpe(self, s: str) -> list[str]:
        """All finite paths weigh the same and there is one, so the first complete one is
        the shortest: the lattice is walked depth first, long pieces first. A position is
        reached by one path of finite weight only, so one that leads nowhere is dead."""
        n, i, before = len(s), 0, ""
        out: list[str] = []
        left, dead, open_ = [], set(), self._pieces_at(s, 0)
        while i < n:
            allowed = self._pairs.get(before) or {}
            while open_:
                p = open_.pop()
                if i + len(p) not in dead:
                    ok = allowed.get(p)
                    if self.follows(before, p) if ok is None else ok:
                        break
            else:
                dead.add(i)
                i, before, open_ = left.pop()
                out.pop()
                continue
            left.append((i, before, open_))
            out.append(p)
            i, before = i + len(p), p
            if i < n:
                open_ = self._pieces_at(s, i)
        return out

    def _path_unigram(self, s: str) -> list[str]:
        n = len(s)
        cost = [0.0] + [float("inf")] * n
        last = [""] * (n + 1)
        missing = -(self.floor - 10.0)
        for i in range(n):
            for p in self._pieces_at(s, i):
                k = self.lexicon.get(p)
                c = cost[i] + (missing if k is None else -self.scores[k])
                if c < cost[i + len(p)]:
                    cost[i + len(p)], last[i + len(p)] = c, p
        out, j = [], n
        while j:
            out.append(last[j])
            j -= len(last[j])
        return out[::-1]

    def path(self, s: str) -> bytes:
        """Ids (little-endian int32) of one cut, by the shortest path."""
        parts = self._path_bpe(s) if self.kind == "bpe" else self._path_unigram(s)
        ids = self._write(parts)
        return struct.pack(f"<{len(ids)}i", *ids)

    # ------------------------------------------------------------------ texts
    def encode_chunk(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of several texts one after the other, and how many each has. Texts are
        cut between characters that no piece joins (a space stands for U+2581), and
        the path of each distinct cut is looked up once."""
        front = b" " if self.dummy else b""
        # to the machines, U+2581 in a text is a space
        raw = [front + t.replace(SPACE, " ").encode() if t else b"" for t in texts]
        c = TV.Chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + list(map(len, raw))), 0)
        if not len(c.buf):
            return np.zeros(0, "<i4"), np.zeros(len(texts), np.int64)
        start = np.ones(len(c.buf), bool)
        start[1:] = ~self._join[c.buf[:-1].astype(np.int32) * 256 + c.buf[1:]]
        start[c.offsets[:-1][np.diff(c.offsets) > 0]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(c.buf))
        first, which = c.distinct(s, e)
        data = c.buf.tobytes()
        cuts = [data[a:b] for a, b in zip(s[first].tolist(), e[first].tolist())]
        ids = list(map(self._known.get, cuts))
        for k, x in enumerate(ids):
            if x is None:
                ids[k] = x = self.path(cuts[k].decode().replace(" ", SPACE))
                if len(cuts[k]) <= CACHED_BYTES:
                    if len(self._known) >= CACHE_ROWS:
                        self._known.clear()
                    self._known[cuts[k]] = x
        flat, n = TV.expand(ids, which, np.dtype("<i4"))
        return flat, np.bincount(np.searchsorted(c.offsets, s, "right") - 1, weights=n,
                                 minlength=len(texts)).astype(np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_chunk([text])[0].tolist()

    def decode(self, ids: np.ndarray | list[int]) -> str:
        """The text: pieces are joined, bytes put together (bad sequences become U+FFFD),
        U+2581 becomes a space, and the space put in front goes."""
        if isinstance(ids, np.ndarray):
            ids = ids.tolist()
        text = b"".join(map(self._bytes.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.dummy and text.startswith(" ") else text


_LOADED: dict[str, PieceTransducer] = {}


def transducer(path: str) -> PieceTransducer:
    """The compiled machines of a model file, one per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = PieceTransducer.load(path)
    return _LOADED[path]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
           decode: bool = True) -> DataFrame:
    """(id, n_tokens long, ids array<int>[, decoded string]) per document: the ids of the
    whole text, and the text that they decode to. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(model_path)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                flat, n = m.encode_chunk(part.column(1).to_pylist())
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(n, out=offsets[1:])
                cols = [part.column(0), pa.array(n),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))]
                if decode:
                    cols.append(pa.array([m.decode(flat[a:z]) for a, z in zip(offsets, offsets[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(
                    cols, names=[id_col, "n_tokens", "ids", "decoded"][:len(cols)])

    kind = docs.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_tokens long, ids array<int>" + (", decoded string" if decode else "")
    return docs.select(id_col, text_col).mapInArrow(run, out)


def decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) from arrays of ids; null arrays are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = transducer(model_path)
        for b in batches:
            texts = [m.decode([] if x is None else x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())],
                                             names=[id_col, "text"])

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")
