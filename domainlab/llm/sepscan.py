"""Token counts of flat token files without an index, by scanning for separators.

A flat file is nothing but ids of a fixed width, each document closed by an end id. Files
are cut into blocks of equal size that are scanned on their own: one vectorised comparison
finds the separators in a block. A document may begin in one block and end in a later one,
so the blocks are stitched by a prefix scan: the number of separators before a block gives
the ordinal of its first document, and the place of the last separator before it (a running
maximum) gives where that document began.

Ids after the last separator of a file are a document that was not closed
(``closed`` false); a file that ends with a separator has none. Empty files have no
documents. A file whose size is not a whole number of ids raises an error.

``write_flat`` makes such files from documents; strings of special tokens in a text are
encoded as ordinary text, so that only real ends are end ids. Null texts count as empty (their end id
stands alone), repeated rows are documents of their own, an empty table gives no files,
and only the id and text columns are read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domainlab.llm import files
from domainlab.llm import textvec as TV
from domainlab.llm.wordcache import CHUNK, encoder
from domainlab.session import scratch_path

#: Ids in a block.
BLOCK = 1 << 20


def scan_block(ids: np.ndarray, end_id: int) -> np.ndarray:
    """Positions of the separators in a block."""
    return np.flatnonzero(ids == ids.dtype.type(end_id))


def blocks(spark: SparkSession, sizes: DataFrame, width: int, block: int = BLOCK) -> DataFrame:
    """(path, bytes) per file -> (path, block, first, n): runs of n ids from id ``first``."""
    n = F.col("bytes") / width
    cut = F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / block).cast("long"))
    whole = F.when(F.col("bytes") % width == 0, n.cast("long")).otherwise(
        F.raise_error(F.concat(F.lit("not a whole number of ids: "), F.col("path"))))
    return (sizes.where("bytes > 0").select("path", whole.alias("_n"), F.explode(cut).alias("block"))
            .select("path", "block", (F.col("block") * block).alias("first"),
                    F.least(F.lit(block).cast("long"), F.col("_n") - F.col("block") * block).alias("n")))


def count_tokens(spark: SparkSession, sizes: DataFrame, end_id: int, width: int,
                 block: int = BLOCK) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of every document of the files in
    ``sizes`` (path, bytes); n_tokens counts the end id if there is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                with files.open_file(row["path"]) as f:
                    raw = f.read_at(row["n"] * width, row["first"] * width)
                found = scan_block(np.frombuffer(raw, f"<u{width}"), end_id) + row["first"]
                yield pa.RecordBatch.from_pydict({
                    "path": [row["path"]], "block": [row["block"]], "first": [row["first"]],
                    "n": [row["n"]], "ends": pa.array([found], pa.list_(pa.int64()))})

    cut = blocks(spark, sizes, width, block)
    spread = cut.repartition(F.col("path"), F.col("block"))
    found = spread.mapInArrow(run, "path string, block long, first long, n long, ends array<long>")
    # read and scanned once; the scan over a file's blocks sees a few numbers of each
    kept = scratch_path(spark, "sepscan")
    found.write.parquet(kept)
    found = spark.read.parquet(kept).withColumn("_last", F.when(F.size("ends") > 0, F.element_at("ends", -1)))
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("path").orderBy(F.col("block").desc())
    carried = (
        found.select("path", "block", "first", "n", "_last", F.size("ends").alias("_found"))
        .select("path", "block", F.coalesce(F.sum("_found").over(earlier), F.lit(0)).alias("_docs"),
                F.coalesce(F.max("_last").over(earlier) + 1, F.lit(0)).alias("_start"),
                F.when(F.row_number().over(last) == 1, F.col("first") + F.col("n")).alias("_stop")))
    stitched = found.join(carried, ["path", "block"])
    # an open document begins after the last separator of the file and goes to its end
    opened = F.coalesce(F.col("_last") + 1, F.col("_start"))
    all_ends = F.when(F.col("_stop") > opened, F.concat("ends", F.array(F.col("_stop") - 1))).otherwise(F.col("ends"))
    each = stitched.select("path", "_docs", "_start", "ends", F.size("ends").alias("_closed"),
                           F.posexplode(all_ends).alias("_k", "_end"))
    start = F.when(F.col("_k") == 0, F.col("_start")).otherwise(F.try_element_at("ends", F.col("_k")) + 1)
    return (each.select("path", (F.col("_docs") + F.col("_k")).alias("ordinal"), start.alias("start"),
                        (F.col("_end") + 1 - start).alias("n_tokens"),
                        (F.col("_k") < F.col("_closed")).alias("closed")))


def write_flat(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id",
               text_col: str = "text") -> tuple[DataFrame, int]:
    """Writes one flat file per partition, in the order of its rows; returns (path,
    bytes, ids array of the documents in the file's order by slices) and the width of an
    id in bytes."""
    width = encoder(tokenizer, True).dtype.itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, True), TaskContext.get().partitionId()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        path = f"{folder}/flat-{part:06d}.bin"
        done, n, b = [], 0, first
        with files.create(path) as out:
            while b is not None:
                for c in TV.chunks(b.column(1), CHUNK):
                    ids, sizes = enc.encode(c)
                    raw = np.insert(ids, np.cumsum(sizes), end_id).tobytes()
                    out.write(raw)
                    n += len(raw)
                done.append(b.column(0))
                b = next(batches, None)
        at = 0
        for ids in done:
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array([path] * len(ids)), pa.array(range(at, at + len(ids)), pa.int64()),
                 pa.array([n] * len(ids), pa.int64())], names=["_id", "path", "ordinal", "bytes"])
            at += len(ids)

    table = f"{folder}/documents"
    (docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
     .mapInArrow(run, "_id long, path string, ordinal long, bytes long").write.parquet(table))
    return docs.sparkSession.read.parquet(table), width


def count_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id",
                    text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Writes documents to flat files and counts them back from the files alone: (id,
    file, ordinal, start, n_tokens). The written order only names the documents."""
    spark = docs.sparkSession
    order, width = write_flat(docs, scratch_path(spark, "flat"), tokenizer, end_id, id_col, text_col)
    sizes = order.groupBy("path").agg(F.max("bytes").alias("bytes"))
    counted = count_tokens(spark, sizes, end_id, width, block)
    return (counted.join(order, ["path", "ordinal"], "full_outer")
            .select(F.col("_id").alias(id_col), F.regexp_extract("path", r"[^/]+$", 0).alias("file"),
                    "ordinal", "start", "n_tokens"))
