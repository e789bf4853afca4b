"""Model stages re-aimed as Spark jobs.

The reference trains transformer encoders without labels and then a two-branch
classifier; here token vectors are learned without labels by Spark ML
``Word2Vec`` on the encoded sequences (D2), pooled per domain into features (D3),
fused and fed to a Spark ML pipeline (D4), which scores test splits in bulk (D1).
Ablations (D5) and forward chaining by year (D6) are parameters of the same
jobs. Every step is distributed; predictions never reach the driver."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import Word2Vec
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.operators import features as FE
from domainlab.operators import metrics as MX


TRAIN_PARTS = 8


def token_vectors(seqs: DataFrame, ids: str, dim: int = 16, seed: int = 42, max_iter: int = 1,
                  window: int = 5, parts: int = TRAIN_PARTS) -> DataFrame:
    """``(id, vector)`` learned from id sequences (pads removed) without labels.
    ``parts`` shards are trained side by side and averaged in each iteration; it is a
    parameter of the model, since the vectors depend on it, and not of the cluster."""
    toks = seqs.select(F.transform(F.filter(ids, lambda i: i != 0), lambda i: i.cast("string")).alias("_t"))
    w2v = Word2Vec(vectorSize=dim, minCount=1, seed=seed, maxIter=max_iter, windowSize=window,
                   inputCol="_t", outputCol="_o", numPartitions=parts)
    model = w2v.fit(toks)
    from pyspark.ml.functions import vector_to_array
    return model.getVectors().select(F.col("word").cast("int").alias("id"),
                                     vector_to_array("vector").alias("vector"))


def vector_table(vectors: DataFrame) -> dict[int, list[float]]:
    """Bounded (vocabulary-sized) driver copy of the token vectors for lookups."""
    rows = vectors.limit(FE.MAX_TOKEN_VECTORS + 1).collect()
    if len(rows) > FE.MAX_TOKEN_VECTORS:
        raise ValueError("token-vector table larger than the lookup bound")
    return {int(r["id"]): list(r["vector"]) for r in rows}


def domain_features(df: DataFrame, branches: dict[str, tuple], mode: str = "pool",
                    out: str = "features") -> DataFrame:
    """D3 + A16: per branch (ids column, vector table, dim[, mask column]) pool or take the
    first position, under the mask where there is one, then fuse the branches in the given
    order."""
    names = []
    for name, (c, tbl, dim, *mask) in branches.items():
        df = FE.pool_positions(df, c, tbl, dim, f"_f_{name}", mode, mask=mask[0] if mask else None)
        names.append(f"_f_{name}")
    return df.withColumn(out, FE.fuse(*names)).drop(*names)


def fit_classifier(train: DataFrame, features: str = "features", label: str = "label",
                   max_iter: int = 20, reg: float = 0.0) -> PipelineModel:
    """Head on fused features (a Spark ML pipeline)."""
    prep = train.withColumn("_fv", array_to_vector(F.col(features)))
    lr = LogisticRegression(featuresCol="_fv", labelCol=label, maxIter=max_iter, regParam=reg,
                            predictionCol="_pred")
    return Pipeline(stages=[lr]).fit(prep.withColumn(label, F.col(label).cast("double")))


def score(model: PipelineModel, df: DataFrame, features: str = "features", label: str = "label"
          ) -> DataFrame:
    """Bulk scoring, of a batch or a stream -> ``y_pred`` (argmax of the class scores)
    and, where the rows have a label, ``y_true``."""
    scored = model.transform(df.withColumn("_fv", array_to_vector(F.col(features))))
    if label in df.columns:
        scored = scored.withColumn("y_true", F.col(label).cast("int"))
    return scored.withColumn("y_pred", F.col("_pred").cast("int")).drop("_fv", "_pred", "rawPrediction", "probability")


def forward_chain(df: DataFrame, year: str = "year", train_years=(2017, 2018, 2019),
                  features: str = "features", label: str = "label", train: DataFrame | None = None) -> DataFrame:
    """Train on the early years (or on ``train``, where only a part of their rows may
    be used), metrics for every later year plus overall."""
    train = df.where(F.col(year).isin(list(train_years))) if train is None else train
    test = df.where(~F.col(year).isin(list(train_years)))
    model = fit_classifier(train, features, label)
    return MX.metrics_by(score(model, test, features, label), year, overall=True)
