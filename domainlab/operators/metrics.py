"""Classification metrics (A4-A8) as one aggregate expression list.

Counts are plain conditional sums (mergeable, map-side combined); rates are
derived from the four counts after the aggregate, so by-year, by-family and
overall results come from the same expressions. Undefined FPR/FNR are NULL;
undefined precision/recall/F1 are 0 (the reference's zero-division choice)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRIC_COLS = ["n", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1", "fpr", "fnr"]


def count_exprs(y_true: str = "y_true", y_pred: str = "y_pred") -> list[Column]:
    """A4: confusion counts over labels {0, 1}."""
    t, p = F.col(y_true), F.col(y_pred)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if((t == 0) & (p == 0)).alias("tn"),
        F.count_if((t == 0) & (p == 1)).alias("fp"),
        F.count_if((t == 1) & (p == 0)).alias("fn"),
        F.count_if((t == 1) & (p == 1)).alias("tp"),
        F.count_if(t == p).alias("n_eq"),
    ]


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def rate_exprs(digits: int | None = 6) -> list[Column]:
    """A5/A6 from the count columns."""
    tn, fp, fn, tp, n = (F.col(c) for c in ("tn", "fp", "fn", "tp", "n"))
    out = {
        "accuracy": _ratio(F.col("n_eq"), n),
        "precision": F.coalesce(_ratio(tp, tp + fp), F.lit(0.0)),
        "recall": F.coalesce(_ratio(tp, tp + fn), F.lit(0.0)),
        "f1": F.coalesce(_ratio(2 * tp, 2 * tp + fp + fn), F.lit(0.0)),
        "fpr": _ratio(fp, fp + tn),
        "fnr": _ratio(fn, fn + tp),
    }
    if digits is not None:
        out = {k: F.round(v, digits) for k, v in out.items()}
    return [v.alias(k) for k, v in out.items()]


def confusion(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred") -> DataFrame:
    return df.agg(*count_exprs(y_true, y_pred)).drop("n_eq")


def metrics_overall(df: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred",
                    digits: int | None = 6) -> DataFrame:
    c = df.agg(*count_exprs(y_true, y_pred))
    return c.select("n", "tn", "fp", "fn", "tp", *rate_exprs(digits))


def metrics_by(df: DataFrame, key: str, overall: bool = False, y_true: str = "y_true",
               y_pred: str = "y_pred", digits: int | None = 6, overall_label: str = "overall"
               ) -> DataFrame:
    """Metrics per ``key`` value (as text); with ``overall`` one more row over
    the pooled rows (grouping sets ``((key), ())``), not a mean of the groups."""
    if overall:
        g = df.rollup(key).agg(*count_exprs(y_true, y_pred), F.grouping(key).alias("_g"))
        k = F.when(F.col("_g") == 1, F.lit(overall_label)).otherwise(F.col(key).cast("string"))
    else:
        g = df.groupBy(key).agg(*count_exprs(y_true, y_pred))
        k = F.col(key).cast("string")
    return g.select(k.alias(key), "n", "tn", "fp", "fn", "tp", *rate_exprs(digits)).orderBy(key)
