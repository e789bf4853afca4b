"""Sources and sinks.

CSV schemas are declared, never inferred; every CSV reader takes several paths/globs in
one scan, tags rows with their file (``_metadata.file_name``) and tolerates bad
input: malformed CSV lines land in ``_corrupt_record`` (kept out of the data and
available as a side table). An unreadable file fails the job unless ``skip_bad`` is
asked for; ``files_without_rows`` then reports which files gave nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANKED_SCHEMA = T.StructType([
    T.StructField("rank", T.LongType()),
    T.StructField("domain", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

CORRUPT = "_corrupt_record"


def _csv(spark: SparkSession, skip_bad: bool):
    r = spark.read.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if skip_bad:
        r = r.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    return r


def read_ranked_list(spark: SparkSession, paths: list[str], skip_bad: bool = False,
                     with_bad: bool = False) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Header-less ``rank,domain`` CSVs from several globs (domain = column 1)."""
    df = (_csv(spark, skip_bad).schema(RANKED_SCHEMA).csv(paths, header=False)
          .withColumn("source_file", F.col("_metadata.file_name")))
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT)
    if with_bad:
        # parsed columns are selected too: Spark refuses a query over the corrupt
        # record column alone
        return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, "rank", "domain", "source_file")
    return good


def read_feed(spark: SparkSession, paths: list[str], columns: tuple[str, ...] = ("domain", "valid_from"),
              skip_bad: bool = False, check_header: bool = True, with_bad: bool = False
              ) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Headered feed CSVs whose ``columns`` are declared in file order, the domain
    first; ``valid_from`` is parsed to a timestamp (unparseable -> NULL), other columns are
    kept as text. With ``check_header`` a file whose header names other columns, or these
    in another order, fails the read; without it, columns go by position whatever the
    header says. Malformed lines are left out (``with_bad``: returned as a second table)."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in (*columns, CORRUPT)])
    df = (_csv(spark, skip_bad).schema(schema).option("header", True).option("enforceSchema", not check_header)
          .csv(paths).withColumn("source_file", F.col("_metadata.file_name")))
    good = df.where(F.col(CORRUPT).isNull()).drop(CORRUPT).withColumnRenamed(columns[0], "domain")
    if "valid_from" in columns:
        good = good.withColumn("valid_from", F.try_to_timestamp(F.col("valid_from")))
    if with_bad:
        return good, df.where(F.col(CORRUPT).isNotNull()).select(CORRUPT, *columns, "source_file")
    return good


def read_split(spark: SparkSession, base: str, years=None, labels=None, splits=None) -> DataFrame:
    """S3: one scan of a ``partitionBy(year, label, split)`` dataset; the filters
    become partition pruning (only matching folders are listed and read)."""
    df = spark.read.parquet(base)
    if years is not None:
        df = df.where(F.col("year").isin(list(years)))
    if labels is not None:
        df = df.where(F.col("label").isin(list(labels)))
    if splits is not None:
        df = df.where(F.col("split").isin(list(splits)))
    return df


def files_without_rows(spark: SparkSession, paths: list[str], read: DataFrame,
                       file_col: str = "_metadata.file_path") -> DataFrame:
    """S8 side table: (path, length) of the files under ``paths`` that no row of ``read``
    comes from - empty, skipped as unreadable, or all of whose lines were bad. Contents are
    not read: only the listing of the ``binaryFile`` source is used."""
    listed = spark.read.format("binaryFile").load(paths).select("path", "length")
    seen = read.select(F.col(file_col).alias("path")).distinct()
    # both sides spell local files alike
    name = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    return (listed.withColumn("path", name(F.col("path")))
            .join(seen.withColumn("path", name(F.col("path"))), "path", "left_anti"))


def read_families(spark: SparkSession, path: str, skip_bad: bool = False) -> DataFrame:
    """One table per family. A ``family=<name>`` partitioned dataset gives the
    family from the folder; plain ``<name>.parquet`` files give it from the file
    stem."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_bad).lower()).parquet(path)
    if "family" not in df.columns:
        df = df.withColumn("family", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)*$", 1))
    return df


def write_families(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy("family").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header (metrics, vocabularies, audits)."""
    df.write.mode(mode).option("header", True).csv(path)


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    r = spark.read.option("header", True)
    if schema is not None:
        r = r.schema(schema)
    return r.csv(path)
