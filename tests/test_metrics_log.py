from pyspark.sql import functions as F

from domainlab.operators import metrics as MX
from domainlab.operators import trainlog as TL


def _m(spark, t, p):
    df = spark.createDataFrame(list(zip(t, p)), "y_true int, y_pred int")
    return MX.metrics_overall(df).first()


def test_metric_cases(spark):
    r = _m(spark, [0, 0, 1, 1], [0, 1, 0, 1])
    assert (r.tn, r.fp, r.fn, r.tp) == (1, 1, 1, 1)
    assert r.accuracy == r.fpr == r.fnr == r.precision == r.recall == r.f1 == 0.5
    r = _m(spark, [0, 0, 0], [0, 0, 1])
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 1, 0, 0)
    assert abs(r.accuracy - 0.666667) < 1e-6 and abs(r.fpr - 0.333333) < 1e-6
    assert r.fnr is None and r.precision == r.recall == r.f1 == 0
    r = _m(spark, [1, 1], [1, 1])
    assert r.fpr is None and r.fnr == 0 and r.accuracy == r.precision == r.recall == r.f1 == 1


def test_overall_pools_rows(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 1), (2, 1, 1)], "year int, y_true int, y_pred int")
    rows = {r["year"]: r for r in MX.metrics_by(df, "year", overall=True).collect()}
    assert rows["overall"].n == 3 and abs(rows["overall"].accuracy - 0.666667) < 1e-6


def _log(spark, losses):
    return spark.createDataFrame([("r0", i + 1, "t", float(v)) for i, v in enumerate(losses)],
                                 "run string, step long, task string, loss double")


def test_best_checkpoint(spark):
    steps = [r.step for r in TL.best_checkpoints(_log(spark, [5, 4, 4, 3, 6, 2])).orderBy("step").collect()]
    assert steps == [1, 2, 4, 6]


def test_interval_mean(spark):
    r = TL.interval_loss(_log(spark, [1, 3, 5, 7, 9]), 2).orderBy("interval").collect()
    assert [x.mean_loss for x in r] == [2.0, 6.0]


def test_batch_mean(spark):
    r = TL.batch_mean_loss(_log(spark, [1, 3, 8]), ["step"], "loss", 2, ["run"]).first()
    assert r.batch_mean_loss == 5.0 and r.n_batches == 2


def test_running_mean_spans_blocks(spark):
    n = 5000
    df = _log(spark, list(range(n)))
    r = TL.running_loss(df).orderBy("step").select("running_mean").collect()
    assert [x[0] for x in r[:3]] == [0.0, 0.5, 1.0] and r[-1][0] == (n - 1) / 2


def test_tasks_of_a_step_stay_apart(spark):
    rows = [("r0", step, task, float(step * w)) for step in range(1, 5) for w, task in ((1, "mtp"), (10, "tpp"), (100, "tov"))]
    log = TL.with_total(spark.createDataFrame(rows, "run string, step long, task string, loss double"))
    assert log.count() == 16
    got = {(r.task, r.interval): r.mean_loss for r in TL.interval_loss(log, 2).collect()}
    assert got == {(t, i): w * (1.5 + 2 * i) for w, t in ((1, "mtp"), (10, "tpp"), (100, "tov"), (111, "total")) for i in (0, 1)}
    run = {(r.task, r.step): r.running_mean for r in TL.running_loss(log).collect()}
    assert run == {(t, s): w * (s + 1) / 2 for w, t in ((1, "mtp"), (10, "tpp"), (100, "tov"), (111, "total")) for s in range(1, 5)}


def test_masked_ce_and_argmax(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0], 0), (2, [1.0, 3.0], -100), (3, [2.0, 2.0], 1)],
                               "id int, logits array<double>, label int")
    r = TL.masked_ce(df).first()
    assert r.n == 2 and abs(r.mean_ce - 0.693147) < 1e-5
    assert [x.p for x in df.select(TL.argmax("logits").alias("p")).orderBy("id").collect()] == [0, 1, 0]


def test_running_windows_are_blockwise(spark):
    from domainlab.operators.scan import running
    df = _log(spark, list(range(100)))
    plan = running(df, ["run"], ["step"], F.col("loss"), "min", "m")._jdf.queryExecution().executedPlan().toString()
    # the data window is partitioned by block id, never by the run alone
    windows = [l for l in plan.split("\n") if "Window [" in l and "_local" in l]
    assert windows and all("_blk" in l for l in windows)
