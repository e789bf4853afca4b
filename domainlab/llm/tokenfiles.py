"""Token files of fixed-width packed ids.

A file holds the ids of whole documents one after the other, each id in the fewest bits
that hold every id of the vocabulary:

    magic "FWT1", uint32 bits, uint64 tokens, uint64 documents, uint32 ids per block
    the blocks; each holds the same number of ids (the last fewer), packed from the lowest
        bit up and filled to a whole number of bytes
    uint64 offset in the file of each block, and of the end of the last
    uint64 start in tokens of each document, and the number of tokens
    int64 id of each document, then a byte each: is the id null
    uint64 offset of the first table, magic "FWT1"

Block offsets make any run of ids readable on its own; a block unpacks in a few numpy
operations. Files and the documents in them ascend by id, null first; documents of equal
id stand next to each other, in the order of the rows read.

Null texts count as empty, and hold the end id alone. An empty table writes no files and
reads back as no rows. Repeated rows are documents of their own. Only the id and text
columns are read."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainlab.llm import files
from domainlab.llm import textvec as TV
from domainlab.llm.wordcache import CHUNK, encoder
from domainlab.session import scratch_path

MAGIC = b"FWT1"
BLOCK = 1 << 15
_HEAD = struct.Struct("<4sIQQI")


def bits_for(vocabulary: int) -> int:
    """The fewest bits that hold the ids 0 .. vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids packed from the lowest bit up."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    planes = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(planes.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed bytes, as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    first = np.arange(n, dtype=np.int64) * bits
    padded = np.frombuffer(raw + bytes(8), np.uint8)
    word = np.zeros(n, np.uint64)
    for k in range((bits + 14) // 8):
        word |= padded[(first >> 3) + k].astype(np.uint64) << np.uint64(8 * k)
    return ((word >> (first & 7).astype(np.uint64)) & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Writer:
    """Writes one file to a binary stream, block by block."""

    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.starts, self.ids, self.offsets = [0], [], [_HEAD.size]
        self.waiting, self.n_waiting = [], 0
        # the counts are not known yet and stand in the tables as well
        out.write(_HEAD.pack(MAGIC, bits, 0, 0, block))

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Whole documents: their ids one after the other, and how many each has."""
        self.ids += doc_ids
        self.starts += (self.starts[-1] + np.cumsum(sizes)).tolist()
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= 64 * self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        upto = len(ids) if last else len(ids) // self.block * self.block
        for lo in range(0, upto, self.block):
            raw = pack(ids[lo:min(lo + self.block, upto)], self.bits)
            self.out.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.waiting, self.n_waiting = [ids[upto:]], len(ids) - upto

    def close(self) -> None:
        self._flush(True)
        for table in (np.array(self.offsets, "<u8"), np.array(self.starts, "<u8"),
                      np.array([0 if i is None else i for i in self.ids], "<i8"),
                      np.array([i is None for i in self.ids], np.uint8)):
            self.out.write(table.tobytes())
        self.out.write(struct.pack("<QQQ4s", self.starts[-1], len(self.ids), self.offsets[-1], MAGIC))


class Reader:
    """Random access to one file."""

    def __init__(self, f):
        self.f = f
        magic, self.bits, _, _, self.block = _HEAD.unpack(f.read_at(_HEAD.size, 0))
        size = f.size()
        self.tokens, docs, tables, end = struct.unpack("<QQQ4s", f.read_at(28, size - 28))
        if magic != MAGIC or end != MAGIC:
            raise ValueError("not a token file")
        raw = f.read_at(size - 28 - tables, tables)
        blocks = -(-self.tokens // self.block)
        self.offsets = np.frombuffer(raw, "<u8", blocks + 1)
        self.starts = np.frombuffer(raw, "<u8", docs + 1, 8 * (blocks + 1)).astype(np.int64)
        at = 8 * (blocks + 1) + 8 * (docs + 1)
        ids = np.frombuffer(raw, "<i8", docs, at).tolist()
        null = np.frombuffer(raw, np.uint8, docs, at + 8 * docs)
        self.ids = [None if z else i for i, z in zip(ids, null)]

    def read(self, start: int, stop: int) -> np.ndarray:
        """The ids start .. stop - 1 of the file; only their blocks are read."""
        if start >= stop:
            return np.zeros(0, np.uint32)
        a, b = start // self.block, -(-stop // self.block)
        raw = self.f.read_at(int(self.offsets[b] - self.offsets[a]), int(self.offsets[a]))
        width = int(self.offsets[1] - self.offsets[0])
        parts = [unpack(raw[k * width:(k + 1) * width], min(self.block, self.tokens - (a + k) * self.block), self.bits)
                 for k in range(b - a)]
        ids = np.concatenate(parts)
        return ids[start - a * self.block:stop - a * self.block]

    def documents(self, most: int = 1 << 20) -> Iterator[tuple[int, int | None, np.ndarray]]:
        """(start, id, ids) of each document; about ``most`` ids are held at a time."""
        i, n = 0, len(self.ids)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + most, "right")) - 1)
            ids = self.read(int(self.starts[i]), int(self.starts[j]))
            for k in range(i, j):
                lo, hi = self.starts[k] - self.starts[i], self.starts[k + 1] - self.starts[i]
                yield int(self.starts[k]), self.ids[k], ids[lo:hi]
            i = j


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
          text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Encodes every whole text, appends ``end_id`` and writes the files; returns
    (part, path, n_docs, n_tokens), one row per file. The folder also gets this table, so
    that nothing is encoded again when it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, enc = TaskContext.get().partitionId(), None, encoder(tokenizer)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/tokens-{part:06d}.fwt"
        with files.create(path) as stream:
            out = Writer(stream, bits_for(enc.size), block)
            b = first
            while b is not None:
                doc_ids = b.column(0).to_pylist()
                for c in TV.chunks(b.column(1), CHUNK):
                    flat, n = enc.encode(c)
                    stop = np.cumsum(n)
                    closed = np.insert(flat.astype(np.uint32), stop, end_id)
                    out.add(doc_ids[c.first:c.first + c.n], closed, n + 1)
                b = next(batches, None)
            out.close()
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([part], pa.int32()), "path": [path],
            "n_docs": [len(out.ids)], "n_tokens": [out.starts[-1]]})

    table = f"{folder}/files"
    # a row number tells rows of equal id apart, so that a common id spreads over many files
    ordered = (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
               .withColumn("_row", F.monotonically_increasing_id())
               .repartitionByRange(F.col("_id").asc_nulls_first(), "_row")
               .sortWithinPartitions(F.col("_id").asc_nulls_first(), "_row"))
    (ordered.select("_id", "_text").mapInArrow(run, "part int, path string, n_docs long, n_tokens long")
     .write.parquet(table))
    return docs.sparkSession.read.parquet(table)


def read(written: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files alone; start
    counts the ids of all documents before it, over all files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, before in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with files.open_file(path) as f:
                    rows = [(i, before + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                            for start, i, ids in Reader(f).documents()]
                for lo in range(0, len(rows), 10_000):
                    cols = zip(*rows[lo:lo + 10_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in cols], names=[id_col, "start", "n_tokens", "ids_crc32"])

    # one row per file
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    listed = written.withColumn("_before", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)))
    spread = listed.select("path", "_before", "part").repartitionByRange(
        max(1, written.count()), "part").select("path", "_before")
    return spread.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> DataFrame:
    """Writes the files to a fresh shared folder and reads them back."""
    folder = scratch_path(docs.sparkSession, "tokens")
    return read(write(docs, folder, tokenizer, end_id, id_col, text_col), id_col)
