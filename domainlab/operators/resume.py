"""S6 for long runs: a partitioned sink that can be taken up again.

A partition is finished when the manifest lists it and as many rows lie there as the
manifest says. A run writes the partitions that are wanted and not finished, by dynamic
overwrite, and enters them in the manifest once they lie there; a run that dies in between
leaves partitions without an entry, which the next one writes again. Finished partitions are
neither computed (the input is filtered by the open ones first) nor touched. The input is
taken to be that of the earlier runs: another input belongs in another folder.

NULL partition values are values of their own. A wanted partition without any row is entered
with 0 rows. No wanted partition, or none open: nothing is written."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PARTITION_BY = ("year", "label", "split")
MANIFEST = "_finished"   # Spark leaves names with a leading underscore out when it reads the folder


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``; no rows if nothing lies there yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _same(left: DataFrame, right: DataFrame, keys: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[k]) for k in keys])


def _manifest_schema(schema: T.StructType, keys: tuple[str, ...]) -> T.StructType:
    return T.StructType([schema[k] for k in keys] + [T.StructField("rows", T.LongType()),
                                                     T.StructField("run", T.StringType())])


def manifest(spark: SparkSession, path: str, schema: T.StructType,
             partition_by: tuple[str, ...] = PARTITION_BY) -> DataFrame:
    """``(partition columns, rows, run)``: one row per time that a partition was finished.
    ``schema``: that of the written rows."""
    return _read(spark, f"{path}/{MANIFEST}", _manifest_schema(schema, tuple(partition_by)))


def lying(spark: SparkSession, path: str, schema: T.StructType,
          partition_by: tuple[str, ...] = PARTITION_BY) -> DataFrame:
    """``(partition columns, rows)`` as they lie in the folder; no column is read."""
    return _read(spark, path, schema).groupBy(*partition_by).agg(F.count(F.lit(1)).alias("rows"))


def open_partitions(spark: SparkSession, wanted: DataFrame, path: str, schema: T.StructType,
                    partition_by: tuple[str, ...] = PARTITION_BY) -> DataFrame:
    """The wanted partitions that are not finished."""
    keys = tuple(partition_by)
    w = wanted.select(*keys).distinct()
    entries = manifest(spark, path, schema, keys).select(*keys, "rows").distinct()
    here = lying(spark, path, schema, keys)
    empty = entries.where(F.col("rows") == 0)
    kept = here.join(entries, _same(here, entries, keys) & (here["rows"] == entries["rows"]), "left_semi")
    # entered as empty and nothing lies there
    bare = empty.join(here, _same(empty, here, keys), "left_anti")
    done = kept.select(*keys).unionByName(bare.select(*keys))
    return w.join(done, _same(w, done, keys), "left_anti")


def write_resumable(df: DataFrame, path: str, run: str, partition_by: tuple[str, ...] = PARTITION_BY,
                    wanted: DataFrame | None = None) -> int:
    """Write the wanted partitions of ``df`` (default: all it has) that are not finished;
    returns how many were open. The table of partitions is as small as the folder's listing,
    which the driver holds anyway."""
    spark, keys, schema = df.sparkSession, tuple(partition_by), df.schema
    names = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    todo = open_partitions(spark, df if wanted is None else wanted, path, names, keys).collect()
    if not todo:
        return 0
    # a plain table from here on: what is open must not change while it is written
    todo = spark.createDataFrame(todo, T.StructType([names[k] for k in keys]))
    n = todo.count()
    rows = df.join(F.broadcast(todo), _same(df, todo, keys), "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)
    here = lying(spark, path, names, keys)
    entered = todo.join(here, _same(todo, here, keys), "left").select(
        *[todo[k] for k in keys], F.coalesce(here["rows"], F.lit(0)).cast("long").alias("rows"),
        F.lit(run).alias("run"))
    entered.coalesce(1).write.mode("append").parquet(f"{path}/{MANIFEST}")
    return n
