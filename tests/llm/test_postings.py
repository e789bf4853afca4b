"""The index against brute force: recall, exact scores, and every row within its reach."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from domainlab.llm import postings as P

SF = "/root/testdata/sf0.1"


def brute(rows, asked, k):
    """All rows of (id, vector) scored for each distinct asked row."""
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v)
          and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = []
    for q, w in {(i, tuple(v)) for i, v in ok if asked(i)}:
        near = sorted((-float((np.array(w) * v).sum()), i) for i, v in ok if i != q and len(v) == len(w))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(near[:k])]
    return sorted(out)


def found(docs, asked="vec_id % 20 = 0", k=P.K):
    return sorted(map(tuple, P.nearest(docs, docs.where(asked), k).collect()))


def recall(got, want):
    want = {(q, i) for q, _, i, _ in want}
    return len(want & {(q, i) for q, _, i, _ in got}) / len(want)


def test_recall_on_given_vectors(spark):
    docs = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in docs.select("vec_id", "embedding").collect()]
    got, want = found(docs), brute(rows, lambda i: i % 20 == 0, 20)
    assert len(got) == len(want) and recall(got, want) >= 0.9
    of = {i: np.array(v, float) for i, v in rows}
    for q, r, i, s in got:
        assert s == pytest.approx(float(of[q] @ of[i]), abs=1e-12)
    assert got == sorted(got, key=lambda x: (x[0], -x[3], x[2]))


def test_uneven_lengths_and_groups(spark):
    """Vectors of very different lengths, and groups close together."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.6, (3000, 1))
    x[500:900] = x[500] + 0.05 * rng.normal(size=(400, 24))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert recall(found(docs), brute(rows, lambda i: i % 20 == 0, 20)) >= 0.9


def test_small_shards_and_blocks(spark, monkeypatch):
    """Lists split into segments, queries into blocks: every list searched gives the exact
    result."""
    for name, value in (("SHARD_ROWS", 40), ("BLOCK_ROWS", 3), ("LIST_ROWS", 60)):
        monkeypatch.setattr(P, name, value)
    rng = np.random.default_rng(3)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(400, 3)))]
    rows += [(1000 + k, rows[7][1]) for k in range(150)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got, want = found(docs, "vec_id % 5 = 0", 6), brute(rows, lambda i: i % 5 == 0, 6)
    assert [x[:3] for x in got] == [x[:3] for x in want]


ODD = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]),
       (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, []), (160, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]),
       (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (7, [-1.0, 0.0]), (8, [1e200, 1e200]), (9, [1e-200, 0.0])]


def test_odd_rows(spark):
    docs = spark.createDataFrame(ODD, "vec_id long, embedding array<double>").withColumns(
        {"list": F.lit(1), "key": F.lit("x"), "id": F.lit(2), "v": F.lit(0), "rank": F.lit(1)})
    want = brute(ODD, lambda i: i % 20 == 0, 20)
    assert found(docs) == want


@pytest.mark.parametrize("rows", [[], [(1, [1.0])], [(0, [1.0])], [(0, None)]])
def test_few_rows(spark, rows):
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(docs) == []


def test_hot_vector(spark):
    """A third of all rows are one vector: the smallest ids answer."""
    rng = np.random.default_rng(4)
    rows = [(k, [1.0, 1.0, 1.0] if k % 3 == 0 else rng.normal(size=3).tolist()) for k in range(900)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got, want = found(docs), brute(rows, lambda i: i % 20 == 0, 20)
    assert recall(got, want) >= 0.99 and [g for g in got if g[0] == 0] == [w for w in want if w[0] == 0]
