"""A corpus from raw documents: quality rules, near-duplicate removal, mixing, encoding.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents, extra ones included, whatever their names.

Null and empty texts have no words: the base rules of ``quality`` reject them, and where a
stage meets them all the same they are no near duplicates, count as size 0 in ``mix`` and encode
to no ids. Rows with a null id stay rows of their own; a class of near duplicates keeps one row
of its smallest id, repeated rows included. Ties in ``mix`` go by hash and id. An empty table
gives an empty result of the same columns. A text is handled whole, however long."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from domainlab.llm import dartminhash, linecrf, mixing, wfst
from domainlab.llm.queries import table, vocabulary
from domainlab.session import scratch_path, ship_package

#: SQL can state neither the decoded labels nor the classes nor the ids.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules or the line labels reject."""
    ship_package(spark)
    return linecrf.drop_low_quality(docs, linecrf.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    ship_package(spark)
    return dartminhash.deduplicate(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    ship_package(spark)
    return mixing.emit(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each document's whole text, and the text they decode to."""
    ship_package(spark)
    return wfst.encode(docs, vocabulary("piece_bpe_32k.model"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_path(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
