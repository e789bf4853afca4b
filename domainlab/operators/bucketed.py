"""Named splits on bucketed storage.

The labelled rows lie in one table, partitioned by year, class and split and bucketed by
domain. A named split is a set of these partitions, and its rows are made distinct where they
lie: all copies of a domain are in one bucket, so neither the union of the partitions nor the
distinct needs an exchange. The one shuffle is paid when the table is written, and every
named split that is read later saves its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTITION_BY = ("year", "label", "split")

#: Name -> years, splits. Rows of the early years train, each later year tests.
NAMED_SPLITS: dict[str, tuple[tuple[int, ...], tuple[str, ...]]] = {
    "pretrain": ((2017, 2018, 2019), ("train", "val", "test")),
    "train": ((2017, 2018, 2019), ("train", "test")),
    "val": ((2017, 2018, 2019), ("val",)),
    **{f"test_{y}": ((y,), ("train", "val", "test")) for y in range(2020, 2026)},
}


def write_bucketed(df: DataFrame, name: str, path: str, key: str = "domain", buckets: int | None = None) -> None:
    """Save ``df`` as table ``name`` at ``path``. Rows are dealt by the buckets' own hash
    first, so each bucket of a partition is one file."""
    n = buckets or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (df.repartition(n, key).write.mode("overwrite").partitionBy(*PARTITION_BY).bucketBy(n, key)
     .option("path", path).saveAsTable(name))


def belongs(name: str) -> Column:
    """Is a row of the table part of the named split? (On partition columns only: pruned.)"""
    years, splits = NAMED_SPLITS[name]
    return F.col("year").isin(*years) & F.col("split").isin(*splits)


def named_split(spark: SparkSession, table: str, name: str) -> DataFrame:
    """``(domain, label)``, distinct. A domain with both labels keeps both; NULL is a domain."""
    return spark.table(table).where(belongs(name)).select("domain", "label").distinct()


def all_named_splits(spark: SparkSession, table: str) -> DataFrame:
    """``(name, domain, label)`` of every named split in one pass over the table."""
    names = F.array_compact(F.array(*[F.when(belongs(n), F.lit(n)) for n in NAMED_SPLITS]))
    rows = spark.table(table).select(F.explode(names).alias("name"), "domain", "label")
    return rows.distinct()
