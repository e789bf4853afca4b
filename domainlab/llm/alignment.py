"""Alignment of two tokenizers over a corpus, with pair counts by external spilling.

Every text, a space in front, is encoded by a byte-level vocabulary (A) and a piece
vocabulary (B). Where tokens of both end, the text is cut into groups; an A and a B token
whose bytes overlap are linked. A pair of ids counts as often as its links in the corpus.

1. Spill: every task turns its documents into records (pair, document, links), sorts a
   bounded number of them by (radix of the B id, B id, A id, document) and writes them as one
   run: zstd frames of pairs with their sums, each followed by a frame of the documents.
2. Count: a task per radix and group of runs merges the frames of pairs with a k-way heap,
   block by block; levels of merging follow until one file per radix is left. All pairs of a
   B id stand together there (B-major order), so that its highest count is found in passing.
3. Contribute: a task per radix and group of runs streams the counts once more against the
   runs and adds to each document what its links count.

A frequent token is one pair per run in step 2, and in step 3 its documents are spread over
the groups of runs, so no task gets more than its share. Runs are named anew by every attempt
of a task and only names that reached the result of step 1 are read, so lost executors and
repeated attempts do no harm.

Texts that are null, empty, or that the tokens of A or B don't spell have no tokens: zeros and
an empty digest. Strings of special tokens inside texts are plain text. Repeated rows are
documents of their own and each counts; null ids stay. An empty table gives an empty result.
Only the id and text columns are read, so other columns may have any name."""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.llm import files
from domainlab.llm import textvec as TV
from domainlab.session import scratch_path

#: Runs are split by the B id modulo this.
RADIX = 16
#: Records of a run; pairs and records of a frame; runs merged by a task, on average.
RUN_RECORDS = 2_000_000
FRAME_PAIRS = 1 << 14
FRAME_RECORDS = 1 << 17
FAN_IN = 32
#: A worker's memory of encoded stretches is emptied at this many; longer ones aren't kept.
CACHE_ROWS = 300_000
CACHED_BYTES = 48
CHUNK = 1 << 20
_FRAME = np.dtype([(c, "<i8") for c in ("radix", "pairs", "records", "at", "size", "docs_at", "docs_size")])


# ---------------------------------------------------------------- aligning
# white space, and bytes that can begin a white-space character outside ASCII
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_DOUBT = _WHITE.copy()
_DOUBT[[*range(28, 32), 0xC2, 0xE1, 0xE2, 0xE3]] = True


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1
    characters stand for themselves, 256, 257, ... for the other bytes in order."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class Spelling:
    """Byte strings by id, in one array."""

    def __init__(self, values: list[bytes]):
        self.sizes = np.array([len(v) for v in values], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(values) + b"\0", np.uint8)

    def write(self, ids: np.ndarray, more: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The strings one after the other, ``more`` bytes left after each; their ends."""
        n = self.sizes[ids] + more
        end = np.cumsum(n)
        at = np.repeat(self.begin[ids] - end + n, n) + np.arange(int(n.sum()))
        return self.flat[at], end


class Aligner:
    """Both vocabularies, and a bounded memory of encoded stretches.

    A stretch begins at a space that follows a character other than white space and stands
    before one: both vocabularies begin a token there whatever surrounds it, so stretches
    are aligned on their own, each distinct one once."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        size_a, size_b = self.a.get_vocab_size(with_added_tokens=True), self.b.vocab_size()
        self.bits_a, self.bits_b = (size_a - 1).bit_length(), (size_b - 1).bit_length()
        byte = _byte_of_char()
        bytes_a = [b""] * size_a
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            bytes_a[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else b""
        self.a_bytes = Spelling(bytes_a)
        self.b_bytes = Spelling([bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i)
                                 else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(size_b)])
        self.decimal = Spelling([str(i).encode() for i in range(max(size_a, size_b))])
        # texts are cut only if both vocabularies can be
        config = json.loads(self.a.to_str())
        cut_a = config["normalizer"] is None and (config["pre_tokenizer"] or {}).get("type") == "ByteLevel" and \
            config["pre_tokenizer"].get("use_regex", True) and not config["pre_tokenizer"]["add_prefix_space"]
        cut_b = not any("\u2581" in p.lstrip("\u2581") for p in map(self.b.id_to_piece, range(size_b))) and \
            self.b.encode("  a b") == self.b.encode("  a") + self.b.encode("b")
        self.cuts = bool(cut_a and cut_b)
        #: the ids of A and of B, as the bytes of uint32
        self.known: dict[bytes, tuple[bytes, bytes]] = {}

    def encode(self, raws: list[bytes]) -> list[tuple[bytes, bytes]]:
        """The ids of stretches."""
        out = list(map(self.known.get, raws))
        todo = [k for k, x in enumerate(out) if x is None]
        if todo:
            texts = [raws[k].decode() for k in todo]
            ids_a = [x.ids for x in self.a.encode_batch_fast(texts, add_special_tokens=False)]
            # B puts the first space in front itself
            ids_b = self.b.encode([t[1:] for t in texts], num_threads=1)
            if len(self.known) + len(todo) > CACHE_ROWS:
                self.known.clear()
            flat = [np.fromiter(chain.from_iterable(ids), "<u4").tobytes() for ids in (ids_a, ids_b)]
            ends = [np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * 4).tolist() for ids in (ids_a, ids_b)]
            x0 = y0 = 0
            for k, x, y in zip(todo, *ends):
                out[k] = flat[0][x0:x], flat[1][y0:y]
                x0, y0 = x, y
                if len(raws[k]) <= CACHED_BYTES:
                    self.known[raws[k]] = out[k]
        return out

    def stretches(self, raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of stretches: a row (spelt by both, tokens of A, tokens of B, groups, links, bytes
        of text) each, all their pairs, and all their groups written out, a ; after each."""
        ids = self.encode(raws)
        every = np.arange(len(raws))
        (a, n_a), (b, n_b) = (TV.expand([x[side] for x in ids], every, np.dtype("<u4")) for side in (0, 1))
        a, b = a.astype(np.int64), b.astype(np.int64)
        sizes = np.fromiter(map(len, raws), np.int64, len(raws))
        of_a, of_b = np.repeat(every, n_a), np.repeat(every, n_b)
        spelt = np.ones(len(raws), bool)
        for ids_, of, spelling in ((a, of_a, self.a_bytes), (b, of_b, self.b_bytes)):
            spelt &= np.bincount(of, weights=spelling.sizes[ids_], minlength=len(raws)) == sizes
        for ids_, of, spelling in ((a, of_a, self.a_bytes), (b, of_b, self.b_bytes)):
            keep = spelt[of]
            text = np.frombuffer(b"".join(r for r, ok in zip(raws, spelt) if ok), np.uint8)
            wrong = np.flatnonzero(spelling.write(ids_[keep])[0] != text)
            if len(wrong):
                spelt[np.flatnonzero(spelt)[np.searchsorted(np.cumsum(sizes[spelt]), wrong, "right")]] = False
        keep_a, keep_b = spelt[of_a], spelt[of_b]
        a, of_a, b, of_b = a[keep_a], of_a[keep_a], b[keep_b], of_b[keep_b]
        # a byte per place: does a token of A, of B, of both end after it
        last_a, last_b = np.cumsum(self.a_bytes.sizes[a]) - 1, np.cumsum(self.b_bytes.sizes[b]) - 1
        ends_a, ends_b = np.zeros((2, int(sizes[spelt].sum())), bool)
        ends_a[last_a] = ends_b[last_b] = True
        both = ends_a & ends_b
        # every stretch between two ends lies in one token of A and one of B: a link
        link = np.flatnonzero(ends_a | ends_b)
        at_a, at_b, groups = (np.cumsum(x) - x for x in (ends_a, ends_b, both))
        pairs = b[at_b[link]] << self.bits_a | a[at_a[link]]
        # tokens in the order of groups, those of A first
        group_a, group_b = groups[last_a], groups[last_b]
        n_groups = int(both.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        place_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        place_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        order, after, of = np.zeros((3, len(a) + len(b)), np.int64)
        order[place_a], order[place_b] = a, b
        after[place_a] = np.where(both[last_a], ord("|"), ord(","))
        after[place_b] = np.where(both[last_b], ord(";"), ord(","))
        of[place_a], of[place_b] = of_a, of_b
        text, end = self.decimal.write(order, 1)
        text[end - 1] = after
        n = len(raws)
        rows = np.stack([spelt, np.bincount(of_a, minlength=n), np.bincount(of_b, minlength=n),
                         np.bincount(of_a[at_a[np.flatnonzero(both)]], minlength=n), np.bincount(of_a[at_a[link]], minlength=n),
                         np.bincount(of, weights=self.decimal.sizes[order] + 1, minlength=n).astype(np.int64)], 1)
        return rows, pairs, text

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
        """Of several texts: (tokens of A, tokens of B, groups, links) each, the pairs of all
        links one after the other, the text of each link, and each text's digest."""
        raw = [b" " + t.encode() if t else b"" for t in texts]
        c = TV.Chunk(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + list(map(len, raw))), 0)
        numbers = np.zeros((len(texts), 4), np.int64)
        digests = [""] * len(texts)
        if not len(c.buf):
            return numbers, np.zeros(0, np.int64), np.zeros(0, np.int64), digests
        start = np.zeros(len(c.buf), bool)
        if self.cuts:
            start[1:-1] = (c.buf[1:-1] == 32) & ~_WHITE[c.buf[:-2]] & ~_DOUBT[c.buf[2:]]
        start[c.offsets[:-1][np.diff(c.offsets) > 0]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(c.buf))
        first, which = c.distinct(s, e)
        data = c.buf.tobytes()
        each, pairs, text = self.stretches([data[x:y] for x, y in zip(s[first].tolist(), e[first].tolist())])
        doc = np.searchsorted(c.offsets, s, "right") - 1
        spelt = np.ones(len(texts), bool)
        spelt[doc[each[which, 0] == 0]] = False
        keep = spelt[doc]
        doc, which = doc[keep], which[keep]
        pairs, n_links = TV.gather(pairs, each[:, 4], which)
        text, n_chars = TV.gather(text, each[:, 5], which)
        for k in range(4):
            numbers[:, k] = np.bincount(doc, weights=each[which, k + 1], minlength=len(texts))
        ends = np.cumsum(np.bincount(doc, weights=n_chars, minlength=len(texts)).astype(np.int64))
        view = memoryview(text.tobytes())
        lo = 0
        for k, hi in enumerate(ends.tolist()):
            if hi > lo:
                digests[k] = hashlib.sha256(view[lo:hi - 1]).hexdigest()
            lo = hi
        return numbers, pairs, np.repeat(doc, n_links), digests


_LOADED: dict[tuple[str, str], Aligner] = {}


def aligner(path_a: str, path_b: str) -> Aligner:
    """One per Python worker and pair of vocabularies."""
    key = path_a, path_b
    if key not in _LOADED:
        _LOADED[key] = Aligner(*key)
    return _LOADED[key]


# ---------------------------------------------------------------- runs
class RunWriter:
    """Frames, then their table, its length and the number of documents."""

    def __init__(self, out, docs: int = 0):
        self.out, self.docs, self.at, self.table = out, docs, 0, []
        self.zstd = zstandard.ZstdCompressor(level=1)

    def _put(self, arrays: list[np.ndarray]) -> tuple[int, int]:
        raw = self.zstd.compress(b"".join(a.tobytes() for a in arrays))
        self.out.write(raw)
        self.at += len(raw)
        return self.at - len(raw), len(raw)

    def add(self, radix: int, keys: np.ndarray, totals: np.ndarray, more: np.ndarray,
            docs: np.ndarray | None = None, links: np.ndarray | None = None) -> None:
        """A frame of pairs; ``more``: documents of each, or whether it is its B id's best."""
        at, size = self._put([np.diff(keys, prepend=0).astype("<u8"), totals.astype("<u8"), more.astype("<u4")])
        docs_at, docs_size = (0, 0) if docs is None else self._put([docs.astype("<u4"), links.astype("<u4")])
        self.table.append((radix, len(keys), 0 if docs is None else len(docs), at, size, docs_at, docs_size))

    def close(self) -> None:
        self.out.write(np.array(self.table, _FRAME).tobytes())
        self.out.write(np.array([len(self.table), self.docs], "<i8").tobytes())


class RunReader:
    """The frames of one radix of a run, in order."""

    def __init__(self, path: str, radix: int):
        self.f = files.open_file(path)
        size = self.f.size()
        n, self.docs = np.frombuffer(self.f.read_at(16, size - 16), "<i8").tolist()
        table = np.frombuffer(self.f.read_at(n * _FRAME.itemsize, size - 16 - n * _FRAME.itemsize), _FRAME)
        self.frames = table[table["radix"] == radix].tolist()
        self.zstd = zstandard.ZstdDecompressor()

    def pairs(self, frame: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys, totals and the third number of each pair of a frame."""
        n = frame[1]
        raw = self.zstd.decompress(self.f.read_at(frame[4], frame[3]), max_output_size=20 * n)
        return (np.cumsum(np.frombuffer(raw, "<u8", n)).astype(np.int64),
                np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64), np.frombuffer(raw, "<u4", n, 16 * n))

    def records(self, frame: tuple) -> tuple[np.ndarray, np.ndarray]:
        """Documents and links of a frame's pairs."""
        n = frame[2]
        raw = self.zstd.decompress(self.f.read_at(frame[6], frame[5]), max_output_size=8 * n)
        return np.frombuffer(raw, "<u4", n), np.frombuffer(raw, "<u4", n, 4 * n).astype(np.int64)

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for frame in self.frames:
            yield self.pairs(frame)[:2]
        self.f.close()


def write_run(out, codes: np.ndarray, links: np.ndarray, doc_bits: int, key_bits: int, docs: int) -> None:
    """One run of distinct codes radix | B id | A id | document, with their links."""
    order = np.argsort(codes)
    codes, links = codes[order], links[order]
    key = codes >> doc_bits
    doc = codes & ((1 << doc_bits) - 1)
    head = np.flatnonzero(np.diff(key, prepend=-1))
    n_docs = np.diff(head, append=len(key))
    keys, totals = key[head], np.add.reduceat(links, head)
    w = RunWriter(out, docs)
    bounds = np.searchsorted(keys >> key_bits, np.arange(RADIX + 1))
    for radix, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        while lo < hi:
            to = lo + min(FRAME_PAIRS, int(np.searchsorted(head[lo:hi], head[lo] + FRAME_RECORDS)))
            a, z = head[lo], head[to] if to < len(head) else len(key)
            w.add(radix, keys[lo:to], totals[lo:to], n_docs[lo:to], doc[a:z], links[a:z])
            lo = to
    w.close()


def merge(runs: list[Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """k-way merge of sorted (keys, totals) blocks; totals of equal keys are added. A heap
    holds the last key of each run's block: everything up to the smallest of them is
    complete and leaves."""
    heap, held = [], {}

    def load(i: int) -> None:
        block = next(runs[i], None)
        if block is None:
            held.pop(i, None)
        else:
            held[i] = block
            heapq.heappush(heap, (int(block[0][-1]), i))

    for i in range(len(runs)):
        load(i)
    while heap:
        upto, parts = heap[0][0], []
        for i, (keys, totals) in list(held.items()):
            n = int(np.searchsorted(keys, upto, "right"))
            if n:
                parts.append((keys[:n], totals[:n]))
                held[i] = keys[n:], totals[n:]
        while heap and heap[0][0] == upto:
            load(heapq.heappop(heap)[1])
        keys = np.concatenate([k for k, _ in parts])
        totals = np.concatenate([t for _, t in parts])
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        head = np.flatnonzero(np.diff(keys, prepend=-1))
        yield keys[head], np.add.reduceat(totals[order], head)


def with_best(blocks: Iterator[tuple[np.ndarray, np.ndarray]], bits_a: int
              ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, totals, is the total its B id's highest); the pairs of the last B id of a block
    wait for the next block, so that at most one B id's pairs are held."""

    def mark(keys, totals):
        head = np.flatnonzero(np.diff(keys >> bits_a, prepend=-1))
        top = np.maximum.reduceat(totals, head)
        return keys, totals, totals == np.repeat(top, np.diff(head, append=len(keys)))

    wait_k, wait_t = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for keys, totals in blocks:
        keys, totals = np.concatenate([wait_k, keys]), np.concatenate([wait_t, totals])
        done = int(np.searchsorted(keys >> bits_a, keys[-1] >> bits_a))
        if done:
            yield mark(keys[:done], totals[:done])
        wait_k, wait_t = keys[done:], totals[done:]
    if len(wait_k):
        yield mark(wait_k, wait_t)


def contribute(runs: list[RunReader], counts: RunReader) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every run, of each of its documents: links whose pair is its B id's best, and the
    sum of the counts over links, of one radix. The counts are streamed once."""
    out = [(np.zeros(r.docs, np.int64), np.zeros(r.docs, np.int64)) for r in runs]
    waiting = [iter(r.frames) for r in runs]
    held: list = [None] * len(runs)

    def load(i: int) -> None:
        frame = next(waiting[i], None)
        held[i] = None
        if frame is not None:
            keys, _, n_docs = runs[i].pairs(frame)
            held[i] = [0, keys, np.concatenate([[0], np.cumsum(n_docs, dtype=np.int64)]), *runs[i].records(frame)]

    for i in range(len(runs)):
        load(i)
    for frame in counts.frames:
        pairs, totals, best = counts.pairs(frame)
        for i, (n_best, total) in enumerate(out):
            while held[i] is not None:
                lo, keys, begin, docs, links = held[i]
                hi = int(np.searchsorted(keys, pairs[-1], "right"))
                if hi > lo:
                    place = np.searchsorted(pairs, keys[lo:hi])
                    n = np.diff(begin[lo:hi + 1])
                    a, z = begin[lo], begin[hi]
                    np.add.at(total, docs[a:z], links[a:z] * np.repeat(totals[place], n))
                    np.add.at(n_best, docs[a:z], links[a:z] * np.repeat(best[place].astype(np.int64), n))
                held[i][0] = hi
                if hi < len(keys):
                    break
                load(i)
    return out


# ---------------------------------------------------------------- jobs
def spill(docs: DataFrame, folder: str, path_a: str, path_b: str) -> DataFrame:
    """Writes the runs; returns a row per document: run and place in it, id and own numbers.
    ``n_run`` is set on the first row of each run with records."""
    schema = "run long, place int, n_run int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = aligner(path_a, path_b)
        key_bits = m.bits_a + m.bits_b
        doc_bits = min(24, 62 - key_bits - RADIX.bit_length())
        rows: list[tuple] = []
        codes: list[np.ndarray] = []
        links: list[np.ndarray] = []
        n_records = 0

        def flush():
            nonlocal rows, codes, links, n_records
            name = uuid.uuid4().int >> 65
            if n_records:
                with files.create(f"{folder}/runs/{name:016x}") as out:
                    write_run(out, np.concatenate(codes), np.concatenate(links), doc_bits, key_bits, len(rows))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int32()),
                 pa.array([len(rows) if not k and n_records else None for k in range(len(rows))], pa.int32()),
                 *[pa.array([r[k] for r in rows], pa.int64()) for k in range(5)],
                 pa.array([r[5] for r in rows], pa.string())],
                names=["run", "place", "n_run", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
            rows, codes, links, n_records = [], [], [], 0
            return batch

        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for c in TV.chunks(texts, CHUNK):
                part = texts.slice(c.first, c.n).to_pylist()
                if n_records >= RUN_RECORDS or len(rows) + len(part) > 1 << doc_bits:
                    yield flush()
                numbers, pairs, doc, digests = m.align(part)
                if len(pairs):
                    radix = (pairs >> m.bits_a) % RADIX
                    code, n = np.unique((radix << key_bits | pairs) << doc_bits | (doc + len(rows)), return_counts=True)
                    codes.append(code)
                    links.append(n)
                    n_records += len(code)
                rows += zip(ids[c.first:c.first + c.n], *numbers.T.tolist(), digests)
        if rows:
            yield flush()

    table = f"{folder}/documents"
    docs.mapInArrow(run, schema).write.parquet(table)
    return docs.sparkSession.read.parquet(table)


def count_pairs(items: DataFrame, groups: int, folder: str, bits_a: int) -> DataFrame:
    """Merges the files of ``items`` (radix int, grp int, path string), level by level, until
    each radix has one; returns (radix, counts). ``groups``: groups of a radix."""
    spark = items.sparkSession
    level = 0
    while True:
        last = groups == 1

        def run(batches: Iterator[pa.RecordBatch], last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for radix, paths in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    path = f"{folder}/counts/{uuid.uuid4().hex}"
                    with files.create(path) as out:
                        w = RunWriter(out)
                        merged = merge([RunReader(p, radix).blocks() for p in paths])
                        for keys, totals, more in (with_best(merged, bits_a) if last else
                                                   ((k, t, np.zeros(len(k))) for k, t in merged)):
                            for lo in range(0, len(keys), FRAME_PAIRS):
                                hi = lo + FRAME_PAIRS
                                w.add(radix, keys[lo:hi], totals[lo:hi], more[lo:hi])
                        w.close()
                    yield pa.RecordBatch.from_arrays([pa.array([radix], pa.int32()), pa.array([path])],
                                                     names=["radix", "path"])

        table = f"{folder}/level-{level}"
        (items.groupBy("radix", "grp").agg(F.sort_array(F.collect_list("path")).alias("paths"))
         .select("radix", "paths").repartition(RADIX * groups)
         .mapInArrow(run, "radix int, path string").write.parquet(table))
        merged = spark.read.parquet(table)
        if last:
            return merged.select("radix", F.col("path").alias("counts"))
        groups = -(-groups // FAN_IN)
        level += 1
        items = merged.withColumn("grp", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per document."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "align")
    rows = spill(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")),
                 folder, path_a, path_b)
    runs = rows.where("n_run is not null").select("run")
    groups = max(1, -(-runs.count() // FAN_IN))
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    items = (runs.withColumn("grp", F.pmod(F.xxhash64("run"), F.lit(groups)).cast("int"))
             .withColumn("path", F.concat(F.lit(f"{folder}/runs/"), F.lower(F.lpad(F.hex("run"), 16, "0"))))
             .withColumn("radix", F.explode(F.sequence(F.lit(0), F.lit(RADIX - 1)))))
    counts = count_pairs(items, groups, folder, aligner(path_a, path_b).bits_a)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for radix, names, paths, counted in zip(*[b.column(k).to_pylist() for k in range(4)]):
                got = contribute([RunReader(p, radix) for p in paths], RunReader(counted, radix))
                for name, (n_best, total) in zip(names, got):
                    place = np.flatnonzero(total)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(place), name, np.int64)), pa.array(place.astype(np.int32)),
                         pa.array(n_best[place]), pa.array(total[place])], names=["run", "place", "n_best", "count_sum"])

    work = (items.groupBy("radix", "grp").agg(F.sort_array(F.collect_list(F.struct("path", "run"))).alias("r"))
            .join(counts, "radix").select("radix", "r.run", "r.path", "counts").repartition(RADIX * groups))
    sums = (work.mapInArrow(run, "run long, place int, n_best long, count_sum long")
            .groupBy("run", "place").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")))
    return rows.join(sums, ["run", "place"], "left").select(
        *own, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")], "groups_sha256")
