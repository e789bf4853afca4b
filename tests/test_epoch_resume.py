import os
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from domainlab.operators import permute as PM
from domainlab.operators import resume as RS


# ---------------------------------------------------------------- epoch orders
@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 10, 101, 1000, 1021, 4097])
def test_every_place_is_taken_once(spark, n):
    for epoch in (0, 1):
        d = PM.permuted(spark.range(n), "id", n, 5, epoch)
        assert sorted(r.place for r in d.collect()) == list(range(n))


def test_columns_equal_numpy_and_walks_are_exact(spark):
    # sizes whose halves leave numbers over; the walk found equals the longest one taken
    for n in (5, 11, 19, 131, 1300):
        keys = PM.round_keys(1, 0)
        x, longest = PM.permute_numbers(np.arange(n), n, keys), 0
        while (x >= n).any():
            x = np.where(x >= n, PM.permute_numbers(np.where(x >= n, x, 0), n, keys), x)
            longest += 1
        assert longest == PM.walk_length(n, keys)
        got = PM.permuted(spark.range(n), "id", n, 1, 0).orderBy("id").collect()
        assert [r.place for r in got] == x.tolist()


def test_epochs_mix(spark):
    n = 100_000
    d = PM.permuted(PM.permuted(spark.range(n), "id", n, 3, 0, "p0"), "id", n, 3, 1, "p1").toPandas()
    for a, b in (("id", "p0"), ("id", "p1"), ("p0", "p1")):
        assert abs(np.corrcoef(d[a], d[b])[0, 1]) < 0.02
    # neighbours end up apart, and a batch draws evenly from all tenths of the table
    assert (np.abs(np.diff(d.sort_values("id").p0)) < n / 100).mean() < 0.04
    tenths = d.groupby([d.p0 // 10_000, d.id // 10_000]).size()
    assert tenths.min() > 800 and tenths.max() < 1200 and len(tenths) == 100


def test_large_tables_stay_in_range():
    n = PM.MAX_ROWS - 12_345
    a, b = PM.halves(n)
    assert a * b >= n > (a - 1) * b and max(a, b) < PM.PRIME
    x = PM.permute_numbers(np.array([0, 1, n // 2, n - 1], dtype=np.int64), n, PM.round_keys(0, 0))
    assert ((x >= 0) & (x < a * b)).all() and len(set(x.tolist())) == 4
    with pytest.raises(ValueError):
        PM.halves(PM.MAX_ROWS + 1)


def test_numbers_are_dense_and_the_same_for_any_partitioning(spark):
    rows = [(None if i % 11 == 0 else f"n{i}", i % 3, i) for i in range(700)]
    df = spark.createDataFrame(rows, "domain string, _h int, _first long")   # clashing names
    want = None
    for parts in (1, 2, 5):
        got = sorted(map(tuple, PM.number_rows(df.repartition(parts), ["domain", "_h", "_first"]).collect()), key=repr)
        assert sorted(r[3] for r in got) == list(range(700)) and sorted((r[:3] for r in got), key=repr) == sorted(rows, key=repr)
        want = want or got
        assert got == want
    assert PM.number_rows(df.limit(0), ["domain"]).count() == 0
    twice = PM.number_rows(df.select(F.lit("x").alias("domain")), ["domain"])
    assert sorted(r.row_no for r in twice.collect()) == list(range(700))


def test_an_epoch_is_narrow(spark):
    base = tempfile.mkdtemp(prefix="domainlab-epoch-")
    PM.number_rows(spark.range(1000).withColumn("k", F.col("id") % 7), ["id"]).write.parquet(f"{base}/rows")
    d = PM.epoch_batches(spark.read.parquet(f"{base}/rows"), "row_no", 1000, 9, 4, 128)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan and "Python" not in plan
    sizes = {r.batch_id: r["count"] for r in d.groupBy("batch_id").count().collect()}
    assert sizes == {b: 128 if b < 7 else 1000 - 7 * 128 for b in range(8)}
    numbering = PM.number_rows(spark.read.parquet(f"{base}/rows").drop("row_no"), ["id"], written=True)
    assert "rangepartitioning" not in numbering._jdf.queryExecution().executedPlan().toString()


# ---------------------------------------------------------------- the sink that can be taken up again
def _files(path):
    return {os.path.join(f, n): os.stat(os.path.join(f, n)).st_mtime_ns
            for f, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def _rows(spark, path):
    return sorted(map(tuple, spark.read.parquet(path).select("domain", "year", "label", "split").collect()), key=repr)


@pytest.fixture
def splits(spark):
    rows = [(f"d{i}", 2017 + i % 3, i % 2, ("train", "val", None)[i % 5 % 3]) for i in range(200)]
    return spark.createDataFrame(rows, "domain string, year int, label int, split string")


def test_second_run_writes_nothing(spark, splits):
    path = tempfile.mkdtemp(prefix="domainlab-resume-") + "/out"
    parts = splits.select(*RS.PARTITION_BY).distinct().count()
    assert RS.write_resumable(splits, path, "a") == parts
    before = _files(path)
    assert RS.write_resumable(splits, path, "b") == 0
    assert _files(path) == before and _rows(spark, path) == sorted(map(tuple, splits.collect()), key=repr)


def test_a_lost_partition_is_written_alone(spark, splits):
    path = tempfile.mkdtemp(prefix="domainlab-resume-") + "/out"
    RS.write_resumable(splits, path, "a")
    before = _files(path)
    shutil.rmtree(f"{path}/year=2018/label=1/split=val")
    assert RS.write_resumable(splits, path, "b") == 1
    after = _files(path)
    new = {f for f in after if f not in before and RS.MANIFEST not in f}
    assert new and all("/year=2018/label=1/split=val/" in f for f in new)
    assert all(after[f] == t for f, t in before.items() if f in after)
    assert _rows(spark, path) == sorted(map(tuple, splits.collect()), key=repr)


def test_rows_without_an_entry_are_written_anew(spark, splits):
    path = tempfile.mkdtemp(prefix="domainlab-resume-") + "/out"
    half = splits.where("year = 2017").limit(3)
    half.write.partitionBy(*RS.PARTITION_BY).parquet(path)       # a run that died before its entry
    RS.write_resumable(splits, path, "a")
    assert _rows(spark, path) == sorted(map(tuple, splits.collect()), key=repr)


def test_wanted_partitions_decide(spark, splits):
    path = tempfile.mkdtemp(prefix="domainlab-resume-") + "/out"
    none = spark.createDataFrame([(2030, 0, "train")], "year int, label int, split string")
    early = splits.where("year = 2017").select(*RS.PARTITION_BY).unionByName(none)
    n = early.distinct().count()
    assert RS.write_resumable(splits, path, "a", wanted=early) == n
    assert RS.write_resumable(splits, path, "b", wanted=early) == 0      # the empty one is entered too
    assert {r.year for r in spark.read.parquet(path).select("year").collect()} == {2017}
    RS.write_resumable(splits, path, "c")
    runs = RS.manifest(spark, path, splits.schema).collect()
    assert {r.year for r in runs if r.run == "c"} == {2018, 2019}
    assert [r.rows for r in runs if r.year == 2030] == [0]
    assert _rows(spark, path) == sorted(map(tuple, splits.collect()), key=repr)


def test_empty_input(spark, splits):
    path = tempfile.mkdtemp(prefix="domainlab-resume-") + "/out"
    assert RS.write_resumable(splits.limit(0), path, "a") == 0
