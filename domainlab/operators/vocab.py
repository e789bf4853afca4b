"""Vocabulary tables.

Frequency tables are distributed ``explode -> groupBy -> count`` aggregates with
map-side combine. Id assignment ranks only the thresholded TLD table (a few
thousand rows), never the data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from domainlab.functions import tokens as TK

# Special tokens and their ids, in id order.
SPECIAL_TOKENS = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[TRUNC]", "[SPARSE_TLD]"]
PAD, UNK, CLS, SEP, MASK, TRUNC, SPARSE_TLD = range(7)
# Fixed value: the character alphabet, in id order after the specials and TLDs.
CHAR_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-."


def tld_counts(df: DataFrame, col: str = "domain", freq_th: int = 10) -> DataFrame:
    """V1 (+P5, P6, O1): every bracket token of every row, nulls dropped, counted,
    kept when ``count >= freq_th``, ordered by count desc then token."""
    toks = df.select(F.explode(F.regexp_extract_all(F.col(col), F.lit(TK.TLD_TOKEN_PATTERN), 1)).alias("tld"))
    counts = toks.where(F.col("tld").isNotNull()).groupBy("tld").agg(F.count(F.lit(1)).alias("count"))
    return counts.where(F.col("count") >= freq_th).orderBy(F.desc("count"), F.asc("tld"))


def tld_vocab(tld_table: DataFrame) -> DataFrame:
    """``(token, id, kind)`` for the specials (0-6) and the kept TLDs (7..) in
    descending count. The input is the thresholded TLD table (bounded by the
    number of distinct suffixes), so a single ordered frame is fine here."""
    spark = tld_table.sparkSession
    w = Window.orderBy(F.desc("count"), F.asc("tld"))
    tl = tld_table.select(F.col("tld").alias("token"),
                          (F.row_number().over(w) + (len(SPECIAL_TOKENS) - 1)).cast("int").alias("id"),
                          F.lit("tld").alias("kind"))
    return _specials(spark).unionByName(tl)


def _specials(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t, i, "special") for i, t in enumerate(SPECIAL_TOKENS)],
                                 "token string, id int, kind string")


def char_vocab(tld_table: DataFrame) -> DataFrame:
    """V4: specials + TLDs (W3) + the 38 characters."""
    base = tld_vocab(tld_table)
    spark = tld_table.sparkSession
    chars = spark.createDataFrame([(c, i) for i, c in enumerate(CHAR_ALPHABET)], "token string, pos int")
    n_added = base.select(F.count(F.lit(1))).scalar()   # scalar subquery: specials + TLDs
    ch = chars.select("token", (F.col("pos") + n_added).cast("int").alias("id"), F.lit("char").alias("kind"))
    return base.unionByName(ch)


def max_special_id(vocab: DataFrame) -> DataFrame:
    """V5: one row, ``max(id)`` over specials and TLDs."""
    return vocab.where(F.col("kind").isin("special", "tld")).agg(F.max("id").cast("int").alias("max_special_id"))


def save_vocab(vocab: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Vocabulary as a parquet table."""
    vocab.write.mode(mode).parquet(path)


def load_vocab(spark: SparkSession, path: str, expect_size: int | None = None) -> DataFrame:
    """Load and (optionally) assert the vocabulary size."""
    v = spark.read.parquet(path)
    if expect_size is not None:
        n = v.count()
        if n != expect_size:
            raise ValueError(f"vocabulary has {n} entries, expected {expect_size}")
    return v


def word_counts(df: DataFrame, col: str = "domain", split: bool = True) -> DataFrame:
    """V2: the distinct non-null corpus, normalised (T7) and pre-tokenised (T8);
    each distinct string counts once per word occurrence in it."""
    from domainlab.functions.normalize import normalize_frame
    corpus = df.select(F.col(col).alias("text")).where(F.col("text").isNotNull()).distinct()
    norm = normalize_frame(corpus, "text", "norm")
    words = norm.select(F.explode(TK.pretokenize(F.col("norm"), split)).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
