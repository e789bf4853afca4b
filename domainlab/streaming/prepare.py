"""ST1: streaming preparation and encoding.

Lower-casing, the underscore filter, suffix wrapping (stream-static broadcast
joins against the bounded rules lookup) and character encoding are stateless,
so the *same* DataFrame functions used in batch run on ``readStream``. The file
source/sink with a checkpoint location gives exactly-once output and restarts
from the last committed batch after a failure; ``availableNow`` processes what is
there and stops.

De-duplication keeps state: one row per key and window of event time, held in the state store
until the watermark passes the window's end. Rows are reduced before they reach the state, the
kept row is the smallest by the given order and not the first to arrive, and so the output is
that of the batch ``dedup`` with the window as part of the key, however the rows are cut into
batches, as long as none is later than ``delay``. State is bounded by the distinct keys of the
open windows. :func:`first_seen` passes a row on at once instead, and which copy that is depends
on arrival."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlab.functions import suffix as S
from domainlab.operators import encode as EN
from domainlab.operators import prep


def prepare_stream(df: DataFrame, index: S.SuffixIndex, vocab: EN.Vocab, L: int = 82,
                   col: str = "domain") -> DataFrame:
    """Works on a batch or a streaming DataFrame alike."""
    w = S.wrap_tld(prep.drop_underscore(df, col), col, index)
    return w.withColumn("x_char", EN.pack_finetune(EN.encode_char(col, vocab), L))


def run_stream(spark: SparkSession, source_dir: str, schema: T.StructType | str, sink_dir: str,
               checkpoint: str, index: S.SuffixIndex, vocab: EN.Vocab, L: int = 82,
               max_files_per_trigger: int | None = None,
               then: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process every file present in ``source_dir`` into parquet at ``sink_dir``; a later
    run with the same ``checkpoint`` takes up the files that came since. ``then`` is a
    stateless step on the prepared rows, such as features and scoring (D3, D1)."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    out = prepare_stream(src, index, vocab, L)
    out = then(out) if then else out
    q = (out.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def dedup_stream(df: DataFrame, key: list[str], event_time: str, every: str, delay: str,
                 order: list[str] | None = None) -> DataFrame:
    """A2 on a stream: per window of length ``every`` and ``key``, the row with the smallest
    ``order`` columns (then the others); emitted once the window is closed. Adds
    ``window_start``. Rows without event time are dropped, as they belong to no window; a
    NULL key is a key."""
    rest = [c for c in df.columns if c not in key]
    order = [c for c in (order or []) if c in rest]
    fields = order + [c for c in rest if c not in order]
    g = df.withWatermark(event_time, delay).groupBy(F.window(event_time, every).alias("_window"), *key)
    kept = g.agg(F.min(F.struct(*fields)).alias("_keep"))
    return kept.select(F.col("_window.start").alias("window_start"), *key, *[F.col("_keep")[c].alias(c) for c in fields])


def dedup_batch(df: DataFrame, key: list[str], event_time: str, every: str, order: list[str] | None = None) -> DataFrame:
    """What :func:`dedup_stream` comes to once every window is closed."""
    w = df.where(F.col(event_time).isNotNull()).withColumn("window_start", F.window(event_time, every)["start"])
    return prep.dedup(w, ["window_start", *key], order).select("window_start", *key, *[c for c in df.columns if c not in key])


def first_seen(df: DataFrame, key: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose key is not in the state, at once; a key stays there until the watermark is
    ``delay`` past the event time of the row that put it there, or a little longer."""
    return df.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(key)


def run_dedup(src: DataFrame, sink_dir: str, checkpoint: str, key: list[str], event_time: str, every: str,
              delay: str, order: list[str] | None = None) -> None:
    """Process what the streaming frame ``src`` has to offer into parquet at ``sink_dir``; a
    later run with the same ``checkpoint`` goes on with the state."""
    q = (dedup_stream(src, key, event_time, every, delay, order).writeStream.format("parquet")
         .option("path", sink_dir).option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()


def batch_equivalent(spark: SparkSession, source_dir: str, index: S.SuffixIndex, vocab: EN.Vocab,
                     L: int = 82) -> DataFrame:
    return prepare_stream(spark.read.parquet(source_dir), index, vocab, L)


def ids_as_text(df: DataFrame, col: str = "x_char") -> DataFrame:
    return df.withColumn(col, F.array_join(F.transform(col, lambda x: x.cast("string")), " "))
