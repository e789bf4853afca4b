"""Running (prefix) aggregates without a single-task window.

A window ``PARTITION BY run ORDER BY step`` sends a whole run to one task; a run
holding a third of all rows would then be sorted and scanned by one core. Here
the rows are range-partitioned on ``(partition_by, order_by)`` into balanced
blocks; each block computes its local running value, a tiny per-block totals
table gives the carry-in from earlier blocks of the same group, and the two are
combined. The block-tagged rows are checkpointed to the shared checkpoint folder
before they feed both the per-block totals and the local scan: two separately
planned range exchanges may draw different boundaries, and a reliable checkpoint
both pins the block ids and cuts the lineage for executor loss. Order keys must be
unique within a group; a NULL in ``partition_by`` is a group of its own."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlab.session import checkpoint_dir

_AGG = {"min": F.min, "max": F.max, "sum": F.sum}


def running_all(df: DataFrame, partition_by: list[str], order_by: list[str],
                values: dict[str, tuple[str, Column | None]], inclusive: bool = True,
                blocks: int | None = None) -> DataFrame:
    """Add, for each ``out: (how, value)``, the running ``how`` (min | max | sum | count)
    of ``value`` over the rows of the same group up to this row (``inclusive``) or before
    it; one scan and one set of blocks serve all of them."""
    spark = df.sparkSession
    n = blocks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [*partition_by, *order_by]
    checkpoint_dir(spark)
    outs = list(values)
    hows = {o: "sum" if how == "count" else how for o, (how, _) in values.items()}
    s = df.select("*", *[(F.lit(1).cast("long") if how == "count" else value).alias(f"_v_{o}")
                         for o, (how, value) in values.items()])
    s = s.repartitionByRange(n, *keys).withColumn("_blk", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy("_blk", *partition_by).orderBy(*order_by)
    w = w.rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    totals = s.groupBy("_blk", *partition_by).agg(*[_AGG[hows[o]](f"_v_{o}").alias(f"_t_{o}") for o in outs])
    wb = (Window.partitionBy(*partition_by) if partition_by else Window).orderBy("_blk") \
        .rowsBetween(Window.unboundedPreceding, -1)
    keyed = ["_blk", *partition_by]
    carry = totals.select(*[F.col(c).alias(f"_k_{c}") for c in keyed], *[_AGG[hows[o]](f"_t_{o}").over(wb).alias(f"_c_{o}") for o in outs])
    s = s.select("*", *[_AGG[hows[o]](f"_v_{o}").over(w).alias(f"_local_{o}") for o in outs])
    j = s.join(carry, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in keyed]), "left")

    def both(o: str) -> Column:
        here, before = F.col(f"_local_{o}"), F.col(f"_c_{o}")
        if hows[o] == "sum":
            return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
        return (F.least if hows[o] == "min" else F.greatest)(here, before)
    return j.select(*df.columns, *[both(o).alias(o) for o in outs])


def running(df: DataFrame, partition_by: list[str], order_by: list[str], value: Column | None,
            how: str, out: str, inclusive: bool = True, blocks: int | None = None) -> DataFrame:
    """:func:`running_all` for a single value."""
    return running_all(df, partition_by, order_by, {out: (how, value)}, inclusive, blocks)


def positions(df: DataFrame, partition_by: list[str], order_by: list[str], out: str = "pos") -> DataFrame:
    """1-based row number per group on a unique order, computed blockwise."""
    return running(df, partition_by, order_by, None, "count", out)
