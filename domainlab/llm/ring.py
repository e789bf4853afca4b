"""Sharding by a consistent-hash ring with virtual nodes and bounded loads, in DataFrame
operations only.

Every shard owns ``nodes`` points on a ring of hashes. A document stands at the hash of its
id and goes clockwise to the first shard that is not full; a shard is full when it holds
its share of the rows: the n rows are divided among the shards as evenly as whole numbers
allow, so counts differ by one at most. Documents are served in the order of a priority
hash, so that the outcome is that of one queue, whatever the partitioning.

One queue need not be run row by row. A shard takes rows until some priority, the one at
which it is full, and none after. These cut priorities decide every row: it goes to the
first shard on its clockwise walk whose cut is above its priority. They are found from
counts of rows by (walk, priority bucket), at most ``nodes * shards * BUCKETS`` numbers,
however many rows there are: buckets are served whole while no shard can fill within them,
and a bucket in which one may fill is looked at again in finer buckets, and row by row once
it holds no more than ``ROW_BY_ROW`` rows.

Null ids stand at one point of the ring and null texts count as no bytes; their rows
overflow like any others. Priorities hash the id, the text's size and checksum and, among rows
that agree in these, the row's number; as such rows are alike, it does not matter which has
which number, so repeated rows spread evenly and any partitioning of the input gives the same
result. An empty table gives an
empty result. Only the id and text columns are read."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domainlab.session import scratch_path

#: Points of each shard on the ring.
NODES = 16
#: Priorities are 62-bit numbers, divided into this many buckets at each look.
BUCKET_BITS = 10
PRIORITY_BITS = 62
#: A bucket of at most this many rows is served row by row.
ROW_BY_ROW = 4096
#: Slot numbers are counted in this many hash slices of each shard.
SLICES = 512


def points(spark: SparkSession, shards: int, nodes: int = NODES) -> list[tuple[int, int]]:
    """(place, shard) of every point, in ring order."""
    rows = (spark.range(shards * nodes)
            .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).alias("k"))
            .select(F.pmod(F.xxhash64(F.lit("point"), "shard", "k"), F.lit(1 << 32)).alias("place"), "shard"))
    return sorted((r["place"], r["shard"]) for r in rows.collect())


def walks(ring: list[tuple[int, int]]) -> list[tuple[int, ...]]:
    """For each point, the distinct shards met from it clockwise."""
    order = [s for _, s in ring]
    return [tuple(dict.fromkeys(order[k:] + order[:k])) for k in range(len(order))]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _arc(place: Column, ring: list[tuple[int, int]]) -> Column:
    """Index of the first point at or after a place, clockwise (a bounded literal array)."""
    n = F.size(F.filter(F.array(*[F.lit(p) for p, _ in ring]), lambda p: p < place))
    return F.when(n == len(ring), 0).otherwise(n)


def cuts(keys: DataFrame, ring: list[tuple[int, int]], rows: int, shards: int) -> list[int]:
    """For each shard the priority at which it stops taking rows. keys: (arc, priority)."""
    walk = walks(ring)
    room = capacities(rows, shards)
    cut = [1 << PRIORITY_BITS if c else 0 for c in room]

    def took(s: int, n: int, upto: int) -> None:
        room[s] -= n
        if room[s] <= 0:
            cut[s] = upto

    def serve(lo: int, bits: int) -> None:
        """Serves the rows whose priorities lie in [lo, lo + 2**bits)."""
        step = max(0, bits - BUCKET_BITS)
        part = keys.where((F.col("priority") >= lo) & (F.col("priority") < lo + (1 << bits)))
        part = part.select("arc", "priority", F.shiftright(F.col("priority") - F.lit(lo), step).alias("bucket"))
        table: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for r in part.groupBy("bucket", "arc").count().collect():
            table[r["bucket"]].append((r["arc"], r["count"]))
        for bucket in sorted(table):
            want = defaultdict(int)
            start = lo + (bucket << step)
            for arc, n in table[bucket]:
                want[next(s for s in walk[arc] if cut[s] > start)] += n
            if step and any(n >= room[s] for s, n in want.items()):
                if sum(n for _, n in table[bucket]) > ROW_BY_ROW:
                    serve(start, step)
                    continue
                inside = part.where(F.col("bucket") == bucket)
                for r in sorted(inside.select("priority", "arc").collect(), key=lambda r: r["priority"]):
                    took(next(s for s in walk[r["arc"]] if cut[s] > r["priority"]), 1, r["priority"] + 1)
                continue
            # no shard fills before the bucket's last row, or the bucket is a single priority
            for s, n in want.items():
                took(s, n, start + (1 << step))

    serve(0, PRIORITY_BITS)
    return cut


def _shard(arc: Column, priority: Column, ring: list[tuple[int, int]], cut: list[int]) -> Column:
    """The first shard on the walk from an arc whose cut is above the priority."""
    walk = walks(ring)
    per_arc = F.array(*[F.array(*[F.lit(s) for s in w]) for w in walk])
    at = F.array(*[F.lit(c) for c in cut])
    own = F.element_at(per_arc, (arc + 1).cast("int"))
    return F.element_at(F.filter(own, lambda s: F.element_at(at, s + 1) > priority), 1)


def _numbered(rows: DataFrame) -> DataFrame:
    """Numbers rows that agree in id, size and checksum from 0 on, in ``_number``. They are
    numbered within each input partition and shifted by the counts of the partitions before,
    so a group of any size is never in one task."""
    same = ["_id", "size", "text_crc32"]
    inside = Window.partitionBy(*same, "_part").orderBy("_row")
    earlier = Window.partitionBy(*same).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = (rows.groupBy(*same, "_part").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_shift", F.sum("_n").over(earlier)).where("_shift > 0")
              .select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate([*same, "_part"])], "_shift"))
    on = [F.col(c).eqNullSafe(F.col(f"_s{k}")) for k, c in enumerate([*same, "_part"])]
    return (rows.withColumn("_k", F.row_number().over(inside) - 1).join(shifts, on, "left")
            .select(*same, (F.col("_k") + F.coalesce("_shift", F.lit(0))).alias("_number")))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
           nodes: int = NODES) -> DataFrame:
    """(id, size, text_crc32, shard, slot) per row. Texts are read once; the narrow keys
    are written to the shared folder, because several passes must see the same rows."""
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    ring = points(spark, shards, nodes)
    place = F.pmod(F.xxhash64(F.lit("key"), F.col("_id")), F.lit(1 << 32))
    h = F.xxhash64("_id", "size", "text_crc32", "_number")
    path = scratch_path(spark, "ring")
    base.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}).write.parquet(f"{path}/rows")
    numbered = _numbered(spark.read.parquet(f"{path}/rows"))
    (numbered.withColumn("arc", _arc(place, ring)).withColumn("priority", h.bitwiseAND(F.lit((1 << PRIORITY_BITS) - 1)))
     .drop("_number").write.parquet(f"{path}/keys"))
    keys = spark.read.parquet(f"{path}/keys")
    n = keys.count()
    if not n:
        return _named(keys.withColumn("shard", F.lit(0)).withColumn("slot", F.lit(0).cast("long")), id_col)
    cut = cuts(keys, ring, n, shards)
    placed = keys.withColumn("shard", _shard(F.col("arc"), F.col("priority"), ring, cut)).withColumn(
        "_slice", F.shiftright("priority", PRIORITY_BITS - SLICES.bit_length() + 1).cast("int"))
    inside = Window.partitionBy("shard", "_slice").orderBy("priority", "_id")
    before = Window.partitionBy("shard").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    # at most shards * SLICES rows
    starts = (placed.groupBy("shard", "_slice").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"))
    return _named(placed.withColumn("_k", F.row_number().over(inside) - 1)
                  .join(F.broadcast(starts), ["shard", "_slice"])
                  .withColumn("slot", (F.col("_start") + F.col("_k")).cast("long")), id_col)


def _named(d: DataFrame, id_col: str) -> DataFrame:
    return d.select(F.col("_id").alias(id_col), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), "slot")
