"""WARC archives of records compressed one by one with a shared Zstandard dictionary.

The dictionary is built from a bounded sample of the payloads to be archived and stands at
the head of every file in a skippable frame (magic 0x184D2A5D), compressed itself, so that
each file can be read on its own. Each record is a frame of its own, hence readable from
its offset alone.

Of records with equal payloads (by SHA-1) of at least ``least`` bytes, the one with the
smallest id is a response and the others are revisits that carry no payload, only the
digest, the full length and what they refer to; smaller payloads are always responses.
Rows that share payload and the smallest id are all responses.

Null payloads are empty. A null id sorts last; a payload that occurs with null ids only is
kept in responses. Null URLs give records without a target. An empty table writes no files
and reads back as no rows. Only the id, url and payload columns are read."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.llm import files
from domainlab.session import scratch_path

#: The dictionary is built from at most this many payloads, taken in the order of a hash of
#: the id, and from the first bytes of each (the sample only; payloads are stored whole).
SAMPLE_RECORDS = 800
SAMPLE_BYTES = 16_384
DICTIONARY_BYTES = 65_536
#: A file is closed and the next begun at this size.
FILE_BYTES = 128 << 20
DATE = "2000-01-01T00:00:00Z"

# fixed value: the frame that holds a dictionary
DICTIONARY_MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary, or the samples' own bytes where there are too few to train on."""
    samples = [s for s in samples if s]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def record(page_id: int | None, url: str | None, payload: bytes | None, length: int, sha1: str,
           refers_to: int | None) -> bytes:
    """One record; a revisit has no payload. Its id is made from its fields, so that a
    task that runs again writes the same bytes."""
    kind = "response" if payload is not None else "revisit"
    rid = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{sha1}|{kind}")
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{rid}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if payload is None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("WARC-Payload-Digest", f"sha1:{sha1}"), ("X-Payload-Length", str(length)),
             ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload or b"")))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n").encode() + (payload or b"") + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    return fields, rest[:n]


class Archive:
    """Writes files of at most about FILE_BYTES below a name, one after the other."""

    def __init__(self, name: str, dictionary: bytes, level: int = 3):
        self.name, self.dictionary, self.done, self.out = name, dictionary, [], None
        self.packer = zstandard.ZstdCompressor(
            level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None,
            write_content_size=True)

    def _open(self) -> None:
        self.path = f"{self.name}-{len(self.done):04d}.warc.zst"
        self.ending = files.create(self.path)
        self.out = self.ending.__enter__()
        head = zstandard.ZstdCompressor(level=19).compress(self.dictionary)
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(head)) + head)
        self.n, self.size = 0, 8 + len(head)

    def add(self, raw: bytes) -> None:
        if self.out is None:
            self._open()
        frame = self.packer.compress(raw)
        self.out.write(frame)
        self.n, self.size = self.n + 1, self.size + len(frame)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.ending.__exit__(None, None, None)
            self.done.append((self.path, self.n, self.size))
            self.out = None


def records(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The records of one file, each decompressed on its own; a piece of the file and one
    record are held at a time."""
    magic, n = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    raw = stream.read(n)
    dictionary = zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
    reader = zstandard.ZstdDecompressor(
        dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = b""
    while True:
        if not rest:
            rest = stream.read(piece)
            if not rest:
                return
        one, parts = reader.decompressobj(), []
        while not one.eof:
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else stream.read(piece)
            if not one.eof and not rest:
                raise ValueError("the file ends within a record")
        yield b"".join(parts)


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url",
          payload_col: str = "html", least: int = 0) -> DataFrame:
    """Archives every row; returns (path, n_records, bytes), one row per file, also kept in
    the folder. Rows meet the first row of their payload by a join on the digest; a payload
    shared by many rows is split by the planner's skew handling, and only its first row's
    payload is stored."""
    spark = pages.sparkSession
    p = pages.select(F.col(id_col).cast("long").alias("_id"), F.col(url_col).alias("_url"),
                     F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8").alias("_body"))
    # ids first, so that no more than the sample's payloads ever move
    picked = p.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_RECORDS)
    sample = [bytes(r["_body"]) for r in
              p.select("_id", F.substring("_body", 1, SAMPLE_BYTES).alias("_body"))
              .join(F.broadcast(picked), "_id")  # SAMPLE_RECORDS rows at most
              .groupBy("_id").agg(F.min("_body").alias("_body")).orderBy("_id").collect()]
    packed = spark.sparkContext.broadcast(build_dictionary(sample))  # DICTIONARY_BYTES at most

    hashed = p.withColumn("_sha1", F.sha1("_body"))
    firsts = (hashed.where(F.octet_length("_body") >= least).groupBy("_sha1")
              .agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
              .where("_n > 1 and _first is not null").drop("_n"))
    joined = hashed.join(firsts, "_sha1", "left").select(
        "_id", "_url", F.octet_length("_body").alias("_size"), "_sha1",
        F.when(F.col("_first").isNotNull() & ~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_ref"),
        "_body").withColumn("_body", F.when(F.col("_ref").isNull(), F.col("_body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Archive(f"{folder}/pages-{TaskContext.get().partitionId():06d}", packed.value)
        for b in batches:
            ids, urls, sizes, shas, refs = (b.column(k).to_pylist() for k in range(5))
            for k in range(b.num_rows):
                name = base64.b32encode(bytes.fromhex(shas[k])).decode()
                out.add(record(ids[k], urls[k], b.column(5)[k].as_py(), sizes[k], name, refs[k]))
        out.close()
        if out.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out.done)], names=["path", "n_records", "bytes"])

    table = f"{folder}/files"
    joined.mapInArrow(run, "path string, n_records long, bytes long").write.parquet(table)
    return spark.read.parquet(table)


def read(written: DataFrame, id_col: str = "page_id", payload: bool = False) -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every
    record in the files. A response's digest is taken from its payload and must equal the
    one in its header."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = files.place(path)
                with system.open_input_stream(at, compression=None) as f:
                    rows, held = [], 0
                    for raw in records(f):
                        h, body = parse(raw)
                        said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = h["WARC-Type"] == "response"
                        if response and (digest(body) != said or len(body) != int(h["X-Payload-Length"])):
                            raise ValueError(f"damaged payload in {path}")
                        page, ref = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        rows.append((None if page is None else int(page), int(h["X-Payload-Length"]), said,
                                     h["WARC-Type"], None if response else int(ref))
                                    + ((body if response else None,) if payload else ()))
                        held += len(body) if payload else 0
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payload

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return written.select("path").repartition(max(1, written.count()), "path").mapInArrow(
        run, f"`{id_col}` long, payload_bytes long, payload_digest string, record_type string, refers_to long"
        + (", payload binary" if payload else ""))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html") -> DataFrame:
    """Archives the pages in a fresh shared folder and reads the archives back."""
    return read(write(pages, scratch_path(pages.sparkSession, "warc"), id_col, url_col, payload_col), id_col)
