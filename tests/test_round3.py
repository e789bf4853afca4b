"""Bucketed splits, lookups of any size, the fitted head, de-duplication on a stream."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from domainlab.operators import bucketed as BK
from domainlab.operators import encode as EN
from domainlab.operators import features as FE
from domainlab.operators import lookup as LK
from domainlab.operators import trainlog as TL
from domainlab.plans import head as HD
from domainlab.plans import model as MD
from domainlab.streaming import prepare as ST


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_named_splits_need_no_exchange(spark):
    rows = [(f"d{i % 40}[.com]" if i % 11 else None, i % 2, 2017 + i % 9, ("train", "val", "test")[i % 3])
            for i in range(2000)]
    df = spark.createDataFrame(rows, "domain string, label int, year int, split string")
    path = os.path.join(tempfile.mkdtemp(), "bucketed")
    BK.write_bucketed(df, "named_rows", path, buckets=4)
    got = {}
    for name, (years, splits) in BK.NAMED_SPLITS.items():
        s = BK.named_split(spark, "named_rows", name)
        assert "Exchange" not in _plan(s)
        out = [tuple(r) for r in s.collect()]
        assert len(out) == len(set(out))
        assert set(out) == {(d, l) for d, l, y, x in rows if y in years and x in splits}
        got[name] = set(out)
    every = BK.all_named_splits(spark, "named_rows")
    assert "Exchange" not in _plan(every)
    assert sorted(map(repr, every.collect())) == sorted(
        repr(r) for r in spark.createDataFrame([(n, *r) for n, s in got.items() for r in s],
                                               "name string, domain string, label int").collect())


def _vocab(spark, tlds):
    rows = [(t, i, "special") for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]", "[TRUNC]", "[SPARSE_TLD]"])]
    rows += [(t, 7 + i, "tld") for i, t in enumerate(tlds)] + [("a", 7 + len(tlds), "char")]
    return spark.createDataFrame(rows, "token string, id int, kind string")


def test_ids_are_the_same_on_both_sides_of_the_bound(spark):
    names = ["ab[.com]", "x[.co][.uk]", "x[.uk][.co][.uk]", "z[.none]", "plain", "", None, "ab[.com]"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names * 30)], "domain string, _pos int").repartition(5)
    v = _vocab(spark, ["[.com]", "[.co]", "[.uk]"])
    for bound in (0, v.count() - 1, v.count()):
        got = LK.encode_char(df, "domain", v, "ids", bound=bound)
        want = df.withColumn("ids", EN.encode_char("domain", EN.Vocab.from_table(v)))
        assert got.columns == want.columns
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert LK.tld_ids(df.where("false"), "domain", v, bound=0).count() == 0


@pytest.mark.parametrize("mode", ["pool", "cls"])
def test_vectors_are_the_same_on_both_sides_of_the_bound(spark, mode):
    rng = np.random.default_rng(1)
    rows = [(i, None if i % 17 == 0 else [int(x) for x in rng.integers(-1, 60, i % 9)], [int(x) for x in rng.integers(0, 2, 9)])
            for i in range(500)]
    df = spark.createDataFrame(rows, "id int, ids array<int>, mask array<int>").repartition(3)
    table = {int(i): [float(x) for x in rng.normal(size=3)] for i in range(50)}
    vectors = spark.createDataFrame(list(table.items()), "id int, vector array<double>")
    for mask in (None, "mask"):
        want = {r.id: r.f for r in FE.pool_positions(df, "ids", table, 3, "f", mode, mask=mask).collect()}
        for bound in (0, 50):
            got = LK.pool_positions(df, "ids", vectors, 3, "f", mode, mask=mask, bound=bound, block_rows=20)
            got = {r.id: r.f for r in got.collect()}
            assert got.keys() == want.keys()
            for k, f in want.items():
                assert (f is None) == (got[k] is None) and (f is None or np.allclose(f, got[k], atol=1e-12))
    none = LK.pool_positions(df, "ids", vectors.where("false"), 3, "f", mode, bound=-1)
    assert {tuple(r.f) for r in none.collect() if r.f is not None} == {(0.0,) * (6 if mode == "pool" else 3)}


def test_gradient_equals_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(20, 5)), rng.integers(0, 2, 20)
    head = HD.Head.initial(5, 4, seed=9)
    _, g = HD.loss_and_gradient(head, x, y)
    for i in range(len(g)):
        sides = []
        for d in (1e-6, -1e-6):
            w = head.weights.copy()
            w[i] += d
            sides.append(HD.loss_and_gradient(HD.Head(5, head.hidden, w), x, y)[0])
        assert abs((sides[0] - sides[1]) / 2e-6 - g[i]) < 1e-5


def _rings(spark, n=1500):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(n, 2))
    y = (np.hypot(*x.T) > 1.2).astype(int)   # no line parts these classes
    rows = [(int(b), [float(e) for e in a], ("train", "val", "test")[k % 3]) for k, (a, b) in enumerate(zip(x, y))]
    odd = [(None, [1.0, 1.0], "train"), (1, None, "train"), (0, [1.0], "val"), (1, [float("nan"), 0.0], "train"), (7, [0.0, 0.0], "val")]
    return spark.createDataFrame(rows + odd, "label int, features array<double>, fold string").repartition(7).cache()


def test_head_learns_logs_and_keeps_the_best_step(spark):
    rows = _rings(spark)
    head = HD.Head.initial(2, 8)
    good = rows.where("label in (0, 1) and size(features) = 2 and not isnan(features[0])")
    sums = HD.step_sums(good, head)
    for fold, at in ((HD.VAL, 0), (HD.TRAIN, 3)):
        mine = good.where(F.col("fold") == fold).collect() if fold == HD.VAL else good.where("fold <> 'val'").collect()
        loss, g = HD.loss_and_gradient(head, np.array([r.features for r in mine]), np.array([r.label for r in mine]))
        assert abs(sums[at] - loss) < 1e-8 and sums[at + 1] == len(mine)
    assert np.allclose(sums[5:], g)

    fit = HD.fit_head(rows, width=8, steps=60, rate=0.2)
    log = fit.log_frame(spark)
    val = {r.step: r.loss for r in log.where("task = 'val'").collect()}
    assert fit.best.step == min(val, key=lambda s: (val[s], s)) and log.count() == 120
    bests = sorted(r.step for r in TL.best_checkpoints(log.where("task = 'val'")).collect())
    assert bests[-1] == fit.best.step
    parts = {(r.task, r.interval): r.mean_loss for r in TL.interval_loss(log, 20).collect()}
    assert len(parts) == 6 and abs(parts["val", 1] - np.mean([val[s] for s in range(21, 41)])) < 1e-9
    path = os.path.join(tempfile.mkdtemp(), "head")
    fit.best.save(spark, path)
    again = HD.Head.load(spark, path)
    assert np.array_equal(again.weights, fit.best.weights) and again.step == fit.best.step
    test = HD.score(rows.where("fold = 'test' and size(features) = 2"), again.logits)
    right = test.where("y_true = y_pred").count() / test.count()
    assert right > 0.9, right
    with pytest.raises(ValueError):
        HD.fit_head(rows.where("fold = 'val'"))


def test_score_with_any_function_equals_the_ml_path(spark):
    rows = _rings(spark).where("label in (0, 1) and size(features) = 2 and not isnan(features[0])")
    rows = rows.withColumn("k", F.xxhash64("features"))
    model = MD.fit_classifier(rows)
    w, b = model.stages[-1].coefficients.toArray(), model.stages[-1].intercept
    got = HD.score(rows, lambda x: np.column_stack([0 * (x @ w), x @ w + b]))
    assert ({(r.k, r.y_true, r.y_pred) for r in got.collect()}
            == {(r.k, r.y_true, r.y_pred) for r in MD.score(model, rows).collect()})
    odd = spark.createDataFrame([(1, None), (2, [1.0, 2.0])], "k int, features array<double>")
    out = {r.k: (r.logits, r.y_pred) for r in HD.score(odd, lambda x: x).collect()}
    assert out == {1: (None, None), 2: ([1.0, 2.0], 1)}


def test_stream_dedup_equals_batch_and_restarts(spark):
    base = tempfile.mkdtemp(prefix="domainlab-dedup-")
    src, sink, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    t0 = dt.datetime(2024, 1, 1)
    schema = "domain string, doc_id long, ts timestamp"
    rng = np.random.default_rng(2)
    rows = [(None if i % 19 == 0 else f"d{rng.integers(6)}", int(rng.integers(1000)), t0 + dt.timedelta(minutes=10 * i))
            for i in range(300)] + [("x", 1, None)]
    # within an hour the rows come in any order, and across two files
    late = sorted(rows[:300], key=lambda r: r[2] + dt.timedelta(minutes=int(rng.integers(50)))) + rows[300:]
    sent = [late[:120], late[120:200], late[200:]]

    def run():
        ST.run_dedup(spark.readStream.schema(schema).parquet(src), sink, ck, ["domain"], "ts", "6 hours", "1 hour", ["doc_id"])
    seen = []
    for part in sent:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        run()
        seen.append(spark.read.parquet(sink).count())
    run()                                          # nothing new: no row comes twice
    assert 0 < seen[0] < seen[1] < seen[2] == spark.read.parquet(sink).count()
    batch = ST.dedup_batch(spark.read.parquet(src), ["domain"], "ts", "6 hours", ["doc_id"])
    closed = F.col("window_start") + F.expr("interval 6 hours") <= F.lit(rows[299][2] - dt.timedelta(hours=1))
    want = sorted(map(repr, batch.where(closed).collect()))
    assert sorted(map(repr, spark.read.parquet(sink).select(*batch.columns).collect())) == want and want


def test_first_seen_keeps_one_row_a_key(spark):
    base = tempfile.mkdtemp(prefix="domainlab-first-")
    src, sink, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    schema, t0 = "domain string, ts timestamp", dt.datetime(2024, 1, 1)
    for day, names in ((0, "aab"), (0, "ab"), (3, "c"), (4, "ab")):   # the watermark has passed day 1 when day 4 comes
        at = t0 + dt.timedelta(days=day)
        spark.createDataFrame([(n, at) for n in names], schema).coalesce(1).write.mode("append").parquet(src)
        q = (ST.first_seen(spark.readStream.schema(schema).parquet(src), ["domain"], "ts", "1 day").writeStream
             .option("path", sink).option("checkpointLocation", ck).format("parquet").trigger(availableNow=True).start())
        q.awaitTermination()
    assert sorted((r.domain, r.ts.day) for r in spark.read.parquet(sink).collect()) == [
        ("a", 1), ("a", 5), ("b", 1), ("b", 5), ("c", 4)]
