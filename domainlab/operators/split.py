"""Exact-size reproducible splits (O3, A17, S6, S10, S11) without a global sort.

Each row gets ``h = md5(seed ':' key)``; the split order is ``(h, key)``. Per
group, the first ``train_size`` rows are train, the next ``val_size`` val, the
rest test (a short group clips). Rows are counted by group and by the first hex digits of
``h``; running sums of these counts tell in which block of equal digits each cut falls and
at which rank there. Every other block lies on one side of a cut as a whole, so only the
rows of the cut blocks are sorted. No row or key reaches the driver, and the number of
groups is not limited."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlab.session import checkpoint_dir

TRAIN_SIZE = 1_500_000
VAL_SIZE = 150_000
DIGITS = 3   # a block holds about one row in 16 ** DIGITS of its group


def split_hash(key: str, seed: int | str) -> Column:
    """A NULL key hashes like an empty one."""
    return F.md5(F.concat(F.lit(str(seed)), F.lit(":"), F.coalesce(F.col(key), F.lit(""))))


def exact_split(df: DataFrame, key: str = "domain", by: list[str] | None = None,
                train_size: int = TRAIN_SIZE, val_size: int = VAL_SIZE, seed: int = 42,
                digits: int = DIGITS, out: str = "split", written: bool = False) -> DataFrame:
    """O3: add ``out`` in {train, val, test}. ``key`` must be unique per group; a NULL key
    is ordered before an empty one, and a NULL in ``by`` is a group of its own. ``written``:
    ``df`` is a scan of a written table, which is cheap to read again."""
    d = df.withColumn("_h", split_hash(key, seed))
    if not written:
        # counting and labelling both read the hashed input: materialise it once in the shared
        # checkpoint folder (also a lineage cut if executors are lost later)
        checkpoint_dir(df.sparkSession)
        d = d.checkpoint(eager=True)
    d = d.withColumn("_p", F.substring("_h", 1, digits))
    groups = by or ["_all"]
    if not by:
        d = d.withColumn("_all", F.lit(0))
    w = Window.partitionBy(*groups).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = (d.groupBy(*groups, "_p").agg(F.count(F.lit(1)).alias("_n"))
              .withColumn("_upto", F.sum("_n").over(w)).withColumn("_before", F.col("_upto") - F.col("_n")))
    wanted = {1: train_size, 2: train_size + val_size}

    def inside(rank: int) -> Column:
        return (F.col("_before") < rank) & (F.col("_upto") >= rank)
    cuts = blocks.groupBy(*[F.col(c).alias(f"_g_{c}") for c in groups]).agg(
        *[F.max(F.when(inside(r), F.col("_p"))).alias(f"_p{i}") for i, r in wanted.items()],
        *[F.max(F.when(inside(r), F.lit(r) - F.col("_before"))).alias(f"_r{i}") for i, r in wanted.items()])
    same = [F.col(c).eqNullSafe(F.col(f"_g_{c}")) for c in groups]
    j = d.join(cuts, reduce(lambda x, y: x & y, same), "left")
    cut = F.coalesce(F.col("_p") == F.col("_p1"), F.lit(False)) | F.coalesce(F.col("_p") == F.col("_p2"), F.lit(False))
    rank = F.row_number().over(Window.partitionBy(*groups, "_p").orderBy("_h", key))
    j = (j.where(~cut).withColumn("_rank", F.lit(None).cast("int"))
         .unionByName(j.where(cut).withColumn("_rank", rank)))

    def upto(i: int) -> Column:
        """Is the row among its group's first ``wanted[i]``?"""
        if wanted[i] < 1:
            return F.lit(False)
        block, p = F.col(f"_p{i}"), F.col("_p")   # no such block: the group is shorter
        return block.isNull() | (p < block) | ((p == block) & (F.col("_rank") <= F.col(f"_r{i}")))
    lab = F.when(upto(1), F.lit("train")).when(upto(2), F.lit("val")).otherwise(F.lit("test"))
    return j.select(*df.columns, lab.alias(out))


def check_split(df: DataFrame, by: list[str] | None = None, split: str = "split") -> DataFrame:
    """Per group, train + val + test = total."""
    by = by or []
    g = df.groupBy(*by).agg(
        F.count_if(F.col(split) == "train").alias("n_train"),
        F.count_if(F.col(split) == "val").alias("n_val"),
        F.count_if(F.col(split) == "test").alias("n_test"),
        F.count(F.lit(1)).alias("n_total"))
    return g.withColumn("conserved", F.col("n_train") + F.col("n_val") + F.col("n_test") == F.col("n_total"))


def write_splits(df: DataFrame, path: str, partition_by=("year", "label", "split"), mode: str = "overwrite") -> None:
    """One parquet dataset partitioned by year, class and split."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def split_report(df: DataFrame, split: str = "split", key: str = "domain") -> DataFrame:
    """Rows per named split plus how many of its keys also occur in another split."""
    per = df.groupBy(key, split).agg(F.count(F.lit(1)).alias("_c"))
    # as many entries per key as there are splits; no second pass over the rows
    keys = per.groupBy(key).agg(F.collect_list(F.struct(split, "_c")).alias("_in"))
    each = keys.select(F.size("_in").alias("_ns"), F.explode("_in").alias("_s"))
    return each.groupBy(F.col(f"_s.{split}").alias(split)).agg(
        F.sum("_s._c").alias("rows"),
        F.coalesce(F.sum(F.when(F.col("_ns") > 1, F.col("_s._c"))), F.lit(0)).alias("overlap_rows"))


def ingest_report(df: DataFrame, file_col: str = "source_file") -> DataFrame:
    """Rows kept per file with a running total in file order (duplicates
    included). The per-file table has one row per input file, so its running
    total is a small single-frame window."""
    from pyspark.sql import Window
    per = df.groupBy(file_col).agg(F.count(F.lit(1)).alias("rows"))
    w = Window.orderBy(file_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per.withColumn("running_total", F.sum("rows").over(w))
