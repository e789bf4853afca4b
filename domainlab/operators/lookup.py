"""Lookups of any size (J2, K1, D3): the same results as the lookups shipped to every worker,
by joins, for vocabularies and vector tables beyond their row bounds.

J2: rows share few different token lists, so the ids are found once per distinct list and
joined back to the rows. D3: rows are cut into blocks and written; a block asks once for each
of its ids, so what is shuffled is the ids and vectors per block, not per position. In both
joins the looked-up side is copied to a fixed number of salts, since one list or one id (such
as the pad) may belong to most rows."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.functions import tokens as TK
from domainlab.operators import encode as EN
from domainlab.operators import features as FE
from domainlab.operators.vocab import SPARSE_TLD
from domainlab.session import scratch_path

SALTS = 16
BLOCK_ROWS = 8192


def fits(table: DataFrame, bound: int) -> bool:
    """Has the table at most ``bound`` rows? Counts no more than one row beyond it."""
    return table.limit(bound + 1).count() <= bound


def tld_ids(df: DataFrame, domain: str, vocab: DataFrame, out: str = "tld_ids",
            bound: int = EN.MAX_VOCAB_ROWS, salts: int = SALTS) -> DataFrame:
    """Add ``out`` = the id of each bracket token, unknown -> SPARSE_TLD. Up to ``bound``
    rows the vocabulary is shipped as literals; beyond, it is joined."""
    if fits(vocab, bound):
        return df.withColumn(out, EN.tld_ids(domain, EN.Vocab.from_table(vocab)))
    known = vocab.where("kind = 'tld'").select(F.col("token").alias("_token"), F.col("id").alias("_id"))
    rows = df.select(F.struct(*df.columns).alias("_row"), TK.tld_tokens(domain).alias("_list"))
    lists = rows.where(F.size("_list") > 0).select("_list").distinct()
    each = lists.select("_list", F.posexplode("_list").alias("_pos", "_token")).join(known, "_token", "left")
    one = F.struct("_pos", F.coalesce("_id", F.lit(SPARSE_TLD)).cast("int").alias("_id"))
    found = (each.groupBy("_list").agg(F.array_sort(F.collect_list(one))["_id"].alias("_ids"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    # the partition's number, not a row's: a task that runs again deals its rows alike
    salt = F.pmod(F.xxhash64(F.spark_partition_id(), F.col("_row")[domain]), F.lit(salts)).cast("int")
    none = F.when(F.col("_list").isNotNull(), F.array().cast("array<int>"))
    return (rows.withColumn("_salt", salt).join(found, ["_list", "_salt"], "left")
            .select("_row.*", F.coalesce("_ids", none).alias(out)))


def encode_char(df: DataFrame, domain: str, vocab: DataFrame, out: str = "ids",
                bound: int = EN.MAX_VOCAB_ROWS) -> DataFrame:
    """K1 with a vocabulary of any size: character ids, then TLD ids."""
    top = vocab.where("kind in ('special', 'tld')").agg(F.max("id")).first()[0]
    sld = EN.char_ids(TK.strip_tlds(domain), EN.Vocab({}, int(top), {}))
    return tld_ids(df, domain, vocab, out, bound).withColumn(out, F.concat(sld, F.col(out)))


def _pool_block(dim: int, mode: str, rows: pa.Table, vectors: pa.Table) -> pa.Table:
    known = np.array(vectors["id"].to_pylist(), dtype=np.int64)
    order = np.argsort(known, kind="stable")
    matrix = np.zeros((len(known) + 1, dim))   # the last row stands for unknown ids
    if len(known):
        matrix[:-1] = np.array(vectors["vector"].to_pylist(), dtype=np.float64)[order]
    known = known[order]
    flat, size = FE.flat_lists(rows["_seen"])
    at = np.full(len(flat), len(known))
    if len(known):
        near = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        at = np.where(known[near] == flat, near, len(known))
    return pa.table([rows["_row"], FE.pool_flat(at, size, matrix, mode)], names=["_row", "_pooled"])


def pool_positions(df: DataFrame, ids: str, vectors: DataFrame, dim: int, out: str, mode: str = "pool",
                   mask: str | None = None, bound: int = FE.MAX_TOKEN_VECTORS, salts: int = SALTS,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """D3 with a table ``(id, vector)`` of any size: up to ``bound`` vectors as
    :func:`features.pool_positions`, beyond by blocks of at most ``block_rows`` rows. A block's
    task holds its rows and the vectors of the ids that occur in it."""
    spark = df.sparkSession
    if fits(vectors, bound):
        table = {int(r["id"]): list(r["vector"]) for r in vectors.collect()}
        return FE.pool_positions(df, ids, table, dim, out, mode, mask=mask)
    seen = F.col(ids)
    if mask is not None:
        seen = F.filter(seen, lambda x, i: F.get(F.col(mask), i) == 1)
    # written, so that every pass sees the same blocks
    path = scratch_path(spark, "blocks")
    number = F.monotonically_increasing_id()
    block = F.shiftleft(F.shiftright(number, 33), 33) + F.floor(F.pmod(number, F.lit(1 << 33)) / block_rows)
    (df.select(F.struct(*df.columns).alias("_row"), seen.cast("array<int>").alias("_seen"),
               block.cast("long").alias("_block")).write.parquet(path))
    rows = spark.read.parquet(path)
    asked = (rows.select("_block", F.explode(F.array_distinct("_seen")).alias("id")).distinct()
             .withColumn("_salt", F.pmod(F.xxhash64("_block"), F.lit(salts)).cast("int")))
    given = (vectors.select(F.col("id").cast("int").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))))
    have = asked.join(given, ["id", "_salt"]).select(F.col("_block").alias("_asker"), "id", "vector")
    row_type = rows.schema["_row"].dataType.simpleString()
    done = (rows.groupBy("_block").cogroup(have.groupBy("_asker"))
            .applyInArrow(partial(_pool_block, dim, mode), f"_row {row_type}, _pooled array<double>"))
    return done.select("_row.*", F.col("_pooled").alias(out))
