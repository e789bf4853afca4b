"""The two-layer head on fused features, fitted in Spark.

The head is ``dense -> ReLU -> dense`` with two class scores and cross-entropy loss, twice as
many hidden units as ``width``. Every step is one pass over the rows: each task sums loss,
gradient and counts of its rows with numpy, the sums meet in ``GROUPS`` partial sums inside
Spark, and only these reach the driver, whatever the number of rows and tasks. The driver
takes an Adam step and broadcasts the new weights (a few thousand numbers). Rows marked as
validation give the validation loss in the same pass. The weights with the lowest validation loss
are kept, and every step is logged as ``(run, step, task, loss)``, the shape that the log
operators (A11, A12, W1, W2) read. A lost executor costs the tasks it ran; the sums are the
same up to rounding.

Rows whose features or label are NULL, and features of another length, take no part. Without
training rows fitting raises."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlab.operators import trainlog as TL

GROUPS = 32
TRAIN, VAL = "train", "val"
CLASSES = 2


@dataclass
class Head:
    """The weights as one flat array: W1 (dim x hidden), b1, W2 (hidden x 2), b2."""
    dim: int
    hidden: int
    weights: np.ndarray
    step: int = 0

    @classmethod
    def initial(cls, dim: int, width: int, seed: int = 42) -> "Head":
        rng, hidden = np.random.default_rng(seed), 2 * width
        parts = [rng.uniform(-1, 1, (dim, hidden)) / np.sqrt(dim), rng.uniform(-1, 1, hidden) / np.sqrt(dim),
                 rng.uniform(-1, 1, (hidden, CLASSES)) / np.sqrt(hidden), rng.uniform(-1, 1, CLASSES) / np.sqrt(hidden)]
        return cls(dim, hidden, np.concatenate([p.ravel() for p in parts]))

    def layers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        cut = np.cumsum([self.dim * self.hidden, self.hidden, self.hidden * CLASSES])
        w1, b1, w2, b2 = np.split(self.weights, cut)
        return w1.reshape(self.dim, self.hidden), b1, w2.reshape(self.hidden, CLASSES), b2

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers()
        return np.maximum(x @ w1 + b1, 0) @ w2 + b2

    def save(self, spark: SparkSession, path: str) -> None:
        row = (self.dim, self.hidden, self.step, [float(w) for w in self.weights])
        spark.createDataFrame([row], "dim int, hidden int, step int, weights array<double>").write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Head":
        r = spark.read.parquet(path).first()
        return cls(r["dim"], r["hidden"], np.array(r["weights"]), r["step"])


def loss_and_gradient(head: Head, x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """Sums over the rows (not means): cross-entropy, and its gradient by the flat weights.
    ``n``: how many rows each one stands for."""
    w1, b1, w2, b2 = head.layers()
    a = x @ w1 + b1
    h = np.maximum(a, 0)
    z = h @ w2 + b2
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    total = e.sum(axis=1, keepdims=True)
    each = np.log(total[:, 0]) - z[np.arange(len(y)), y]
    loss = float((each if n is None else each * n).sum())
    dz = e / total
    dz[np.arange(len(y)), y] -= 1
    if n is not None:
        dz *= n[:, None]
    da = (dz @ w2.T) * (a > 0)
    return loss, np.concatenate([(x.T @ da).ravel(), da.sum(axis=0), (h.T @ dz).ravel(), dz.sum(axis=0)])


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def step_sums(rows: DataFrame, head: Head) -> np.ndarray:
    """One pass over ``(fold, label, features[, n])``: validation loss, validation rows, validation
    rows classified right, training loss, training rows, then the training gradient."""
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        got = np.zeros(5 + len(h.weights))
        for b in batches:
            if not b.num_rows:
                continue
            fold = b.column(0).to_numpy(zero_copy_only=False).astype(bool)
            y, x = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64), _matrix(b.column(2), h.dim)
            n = b.column(3).to_numpy(zero_copy_only=False).astype(np.int64)
            if fold.any():
                right = int(n[fold][h.logits(x[fold]).argmax(axis=1) == y[fold]].sum())
                got[:3] += loss_and_gradient(h, x[fold], y[fold], n[fold])[0], int(n[fold].sum()), right
            if not fold.all():
                loss, gradient = loss_and_gradient(h, x[~fold], y[~fold], n[~fold])
                got[3:5] += loss, int(n[~fold].sum())
                got[5:] += gradient
        part = TaskContext.get().partitionId() % GROUPS
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([got], pa.list_(pa.float64()))],
                                         names=["part", "sums"])
    n = F.col("n") if "n" in rows.columns else F.lit(1).cast("long")
    per_task = rows.select(F.col("fold") == VAL, "label", "features", n).mapInArrow(run, "part int, sums array<double>")
    summed = Summarizer.metrics("sum").summary(array_to_vector("sums"))
    per_group = per_task.groupBy("part").agg(vector_to_array(summed["sum"]).alias("sums"))
    return np.sum([r["sums"] for r in sorted(per_group.collect(), key=lambda r: r["part"])], axis=0)


@dataclass
class Fit:
    best: Head
    log: list[tuple[str, int, str, float]] = field(default_factory=list)
    val_accuracy: list[float] = field(default_factory=list)

    def log_frame(self, spark: SparkSession) -> DataFrame:
        """``(run, step, task, loss)``; two rows a step."""
        return spark.createDataFrame(self.log, "run string, step long, task string, loss double")


def fit_head(rows: DataFrame, width: int = 16, steps: int = 30, rate: float = 0.05, seed: int = 42,
             run: str = "head", features: str = "features", label: str = "label", fold: str = "fold",
             weight: str | None = None) -> Fit:
    """Fit on the rows whose ``fold`` is ``train`` and keep the step with the lowest mean
    validation loss (without validation rows: the lowest training loss). ``rows`` is read
    ``steps`` times: pass a written table. ``weight``: a column with how many rows each one
    stands for."""
    good = F.col(features).isNotNull() & F.col(label).isin(0, 1) & F.col(fold).isin(TRAIN, VAL)
    rows = rows.where(good).select(F.col(fold).alias("fold"), F.col(label).alias("label"),
                                   F.col(features).alias("features"),
                                   (F.lit(1) if weight is None else F.col(weight)).cast("long").alias("n"))
    first = rows.where(F.col("fold") == TRAIN).select(F.size("features")).first()
    if first is None:
        raise ValueError("no training rows")
    dim = int(first[0])
    rows = rows.where((F.size("features") == dim) & ~F.exists("features", lambda e: e.isNull() | F.isnan(e)))
    head = Head.initial(dim, width, seed)
    m = v = np.zeros(len(head.weights))
    fit, least = Fit(head), np.inf
    for t in range(1, steps + 1):
        sums = step_sums(rows, head)
        val_loss, n_val, right, loss, n = sums[:5]
        means = {TRAIN: loss / n, **({VAL: val_loss / n_val} if n_val else {})}
        fit.log += [(run, t, task, float(x)) for task, x in means.items()]
        fit.val_accuracy.append(float(right / n_val) if n_val else float("nan"))
        now = means.get(VAL, means[TRAIN])
        if now < least:
            least, fit.best = now, Head(dim, head.hidden, head.weights, t)
        g = sums[5:] / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
        head = Head(dim, head.hidden, head.weights - step, t)
    return fit


def score(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], features: str = "features",
          label: str = "label") -> DataFrame:
    """D1 with any model: ``fn`` turns a matrix of features (rows x dim) into class scores
    (rows x classes), a batch of rows at a time. Adds ``logits``, ``y_pred`` (the first of the
    highest scores) and, where the rows have a label, ``y_true``. Rows without features: NULL."""
    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            some = s[s.notna()]
            if len(some):
                scores = fn(np.stack(some.to_numpy()).astype(np.float64))
                out[some.index] = pd.Series([list(map(float, z)) for z in scores], index=some.index, dtype=object)
            yield out
    scored = df.withColumn("logits", logits(features))
    scored = scored.withColumn("y_pred", TL.argmax("logits"))
    return scored.withColumn("y_true", F.col(label).cast("int")) if label in df.columns else scored
