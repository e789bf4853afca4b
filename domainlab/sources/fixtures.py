"""Views that bring the driver's tables into the shapes the operators expect.

Every view reads whole tables, so its work grows with the data:
``raw_domains`` (documents x labels -> one domain per word), ``predictions``
(orders), ``train_log`` (events), ``audit_names`` (documents) and ``logits`` (embeddings)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-partition ``df`` on ``key`` only when its scan yields fewer partitions
    than the cluster's task slots (a few large row groups feeding a row-multiplying
    step). Large inputs already arrive in many splits and are left alone, so no
    shuffle is added at scale."""
    try:
        slots = df.sparkSession.sparkContext.defaultParallelism
        parts = df.rdd.getNumPartitions()
    except Exception:  # sessions without RDD access: leave the plan as it is
        return df
    return df.repartition(slots, key) if parts < slots else df


# Suffix chosen by doc_id % 8, in order 0..7.
FIXTURE_SUFFIXES = ["com", "net", "org", "co.kr", "co.uk", "io", "github.io", "zzz.qqq"]

# Suffix chosen by doc_id % 12, in order 0..11; internationalised labels in
# either form.
IDN_SUFFIXES = ["рф", "xn--p1ai", "公司.cn", "xn--55qx5d.cn", "個人.香港", "個人.xn--j6w193g", "xn--gmqw5a.香港", "укр",
                "xn--j1amh", "центр.xn--fiqs8s", "com.中国", "xn--zzzz"]


def idn_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(domain)``: each distinct word.number.suffix of the documents, with suffixes that
    hold internationalised labels."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1)).alias("w"))
    sfx = F.element_at(F.array(*[F.lit(x) for x in IDN_SUFFIXES]), (F.col("doc_id") % len(IDN_SUFFIXES) + 1).cast("int"))
    number = F.lpad((F.col("doc_id") % 100).cast("string"), 2, "0")
    return words.select(F.concat_ws(".", "w", number, sfx).alias("domain")).distinct()


def raw_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(domain, doc_id, year, family, label)``: one row per word of every document,
    word + optional ``_x`` + one of eight suffixes; label from ``labels.toxic``."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    j = docs.join(labels, "doc_id", "left")
    sfx = F.lit(None).cast("string")
    for i in range(len(FIXTURE_SUFFIXES) - 1, -1, -1):
        sfx = F.when(F.col("doc_id") % 8 == i, F.lit(f".{FIXTURE_SUFFIXES[i]}")).otherwise(sfx)
    # what depends on the document alone is made once per document, not per word
    words = j.select(
        "doc_id",
        (F.lit(2017) + F.col("doc_id") % 9).cast("int").alias("year"),
        F.col("source").alias("family"),
        F.coalesce(F.col("toxic"), F.lit(0)).cast("int").alias("label"),
        sfx.alias("sfx"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("_x"), sfx)).otherwise(sfx).alias("sfx3"),
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1)).alias("w"))
    ending = F.when(F.length("w") == 3, F.col("sfx3")).otherwise(F.col("sfx"))
    return words.select(F.concat("w", ending).alias("domain"), "doc_id", "year", "family", "label")


#: The training tasks, in order.
TASKS = ["mtp", "tpp", "tov"]


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, year, family, y_true, y_pred)`` from orders; 2001 has no positives."""
    o = table(spark, sf_dir, "orders")
    yr = F.year("o_orderdate")
    return o.select(
        F.col("o_orderkey").alias("id"),
        yr.cast("int").alias("year"),
        F.col("o_orderpriority").alias("family"),
        F.when(yr == 2001, 0).when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("y_true"),
        F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).cast("int").alias("y_pred"),
    )


def train_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(run, step, task, loss)`` from events: the tasks mtp, tpp and tov in each step."""
    e = table(spark, sf_dir, "events")
    task = F.element_at(F.array(*[F.lit(t) for t in TASKS]), (F.col("event_id") % 3 + 1).cast("int"))
    return e.select(F.lit("r0").alias("run"), (F.floor(F.col("event_id") / 3) + 1).cast("long").alias("step"),
                    task.alias("task"), F.col("value").alias("loss"))


#: Shape of an audited name by (doc_id + length of the word) % 9, in order
#: 0..8; {w} is the word. Bare and deep names reach every arm of the suffix rules.
AUDIT_SHAPES = ["{w}.com", "github.io", "{w}.github.io", "s3.amazonaws.com", "{w}.kawasaki.jp",
                "city.kawasaki.jp", "{w}.city.kawasaki.jp", "x.{w}.kawasaki.jp", "co.uk"]


def audit_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(domain, source_file)``: one name per word of every document."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), "doc_id")
    words = docs.select("doc_id", "source", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z0-9]+)"), 1)).alias("w"))
    shape = F.element_at(F.array(*[F.lit(s) for s in AUDIT_SHAPES]),
                         ((F.col("doc_id") + F.length("w")) % len(AUDIT_SHAPES) + 1).cast("int"))
    return words.select(F.replace(shape, F.lit("{w}"), F.col("w")).alias("domain"), F.col("source").alias("source_file"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, logits, label)`` from embeddings."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"),
                    F.col("embedding").cast("array<double>").alias("logits"), "label")
