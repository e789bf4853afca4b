"""Training-log and logits analytics.

Log tables are ``(run, step, task, loss)`` with ``(run, step, task)`` unique, several
tasks per step; :func:`with_total` adds their sum as one more task. Values that run over
steps are kept apart by task.
running values use the blockwise scan in :mod:`domainlab.operators.scan`, so a
single long run is still spread over all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlab.functions.util import to_col
from domainlab.operators.scan import positions, running, running_all

IGNORE_INDEX = -100
BATCH_SIZE = 128


def batch_ids(df: DataFrame, order_by: list[str], batch_size: int = BATCH_SIZE,
              partition_by: list[str] | None = None, out: str = "batch_id") -> DataFrame:
    """Consecutive blocks of ``batch_size`` rows on an explicit (unique) order;
    the last block may be short."""
    p = positions(df, partition_by or [], order_by, "_pos")
    return p.withColumn(out, F.floor((F.col("_pos") - 1) / batch_size).cast("long")).drop("_pos")


def batch_mean_loss(df: DataFrame, order_by: list[str], loss: str = "loss",
                    batch_size: int = BATCH_SIZE, partition_by: list[str] | None = None) -> DataFrame:
    """Mean of per-batch means (a short last batch weighs as much as a full one)."""
    keys = partition_by or []
    b = batch_ids(df, order_by, batch_size, keys)
    per = b.groupBy(*keys, "batch_id").agg(F.avg(loss).alias("_m"), F.count(F.lit(1)).alias("_n"))
    return per.groupBy(*keys).agg(F.avg("_m").alias("batch_mean_loss"),
                                  F.count(F.lit(1)).alias("n_batches"), F.sum("_n").alias("n_rows"))


def total_loss(log: DataFrame) -> DataFrame:
    """Per step, the sum over tasks (mtp + tpp + tov)."""
    return log.groupBy("run", "step").agg(F.sum("loss").alias("total_loss"),
                                          F.count(F.lit(1)).alias("n_tasks"))


def with_total(log: DataFrame, total: str = "total") -> DataFrame:
    """The log's rows ``(run, step, task, loss)`` and, per step, their sum as task ``total``."""
    rows = log.select("run", "step", "task", "loss")
    return rows.unionByName(total_loss(log).select("run", "step", F.lit(total).alias("task"),
                                                   F.col("total_loss").alias("loss")))


def interval_loss(log: DataFrame, n: int = 1000, value: str = "loss",
                  partition_by: tuple[str, ...] = ("run", "task")) -> DataFrame:
    """Per run and task, the mean over each block of ``n`` steps (steps 1..n,
    n+1..2n, ...); a block that is not complete is not emitted."""
    iv = F.floor((F.col("step") - 1) / n).cast("long")
    g = log.groupBy(*partition_by, iv.alias("interval")).agg(
        F.avg(value).alias("mean_loss"), F.countDistinct("step").alias("_steps"),
        F.max("step").alias("end_step"))
    return g.where(F.col("_steps") == n).drop("_steps")


def best_checkpoints(val_log: DataFrame, loss: str = "loss") -> DataFrame:
    """Steps whose validation loss is strictly below every earlier one of the run.
    One row per (run, step): several tasks go through :func:`total_loss` first."""
    r = running(val_log, ["run"], ["step"], F.col(loss), "min", "_prev_min", inclusive=False)
    return r.where(F.col("_prev_min").isNull() | (F.col(loss) < F.col("_prev_min"))).drop("_prev_min")


def running_loss(log: DataFrame, loss: str = "loss", partition_by: list[str] | None = None) -> DataFrame:
    """Per run and task, the running mean since the start (divides by n; the
    reference's progress display divides by n + 1)."""
    keys = partition_by or ["run", "task"]
    s = running_all(log, keys, ["step"], {"_sum": ("sum", F.col(loss)), "_cnt": ("count", None)})
    return s.withColumn("running_mean", F.col("_sum") / F.col("_cnt")).drop("_sum", "_cnt")


def cross_entropy(logits, label) -> Column:
    """A10 per row: ``logsumexp(logits) - logits[label]`` with a max shift."""
    lg, lb = to_col(logits), to_col(label)
    m = F.array_max(lg)
    lse = m + F.log(F.aggregate(lg, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))
    return lse - F.element_at(lg, lb + 1)


def masked_ce(df: DataFrame, logits: str = "logits", label: str = "label",
              ignore: int = IGNORE_INDEX, by: list[str] | None = None) -> DataFrame:
    """A10: mean cross-entropy over rows whose label is not ``ignore``."""
    kept = df.where(F.col(label) != ignore).withColumn("_ce", cross_entropy(logits, label))
    return kept.groupBy(*(by or [])).agg(F.avg("_ce").alias("mean_ce"), F.count(F.lit(1)).alias("n"))


def argmax(logits) -> Column:
    """Index of the first maximum (0-based)."""
    lg = to_col(logits)
    return (F.array_position(lg, F.array_max(lg)) - 1).cast("int")
