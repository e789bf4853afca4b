"""NULL keys, package shipping, skipped files, reports without joins."""
import pytest
from pyspark.sql import functions as F

from domainlab import session
from domainlab.operators import split as SP
from domainlab.sources import readers as RD


def test_null_key_in_exact_split(spark):
    rows = [(f"d{i}", 0) for i in range(40)] + [(None, 0)]
    df = spark.createDataFrame(rows, "domain string, label int")
    out = SP.exact_split(df, "domain", ["label"], 20, 10, 1)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 20, "val": 10, "test": 11}


def test_split_of_null_groups_short_groups_and_one_group(spark):
    rows = [(f"d{i}", g) for g in (None, 1) for i in range(500)] + [(f"d{i}", 2) for i in range(7)]
    df = spark.createDataFrame(rows, "domain string, label int")
    for digits in (1, 3):
        out = SP.exact_split(df, "domain", ["label"], 200, 50, 1, digits=digits)
        got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
        assert got == {(g, s): n for g in (None, 1) for s, n in (("train", 200), ("val", 50), ("test", 250))} | {(2, "train"): 7}
    one = SP.exact_split(df.where("label = 1"), "domain", None, 0, 50, 1)
    assert one.columns == ["domain", "label", "split"]
    assert {r["split"]: r["count"] for r in one.groupBy("split").count().collect()} == {"val": 50, "test": 450}
    assert SP.exact_split(df.where("label = 9"), "domain", ["label"], 1, 1, 1).count() == 0


def test_running_value_of_a_null_group(spark):
    from domainlab.operators.scan import running
    rows = [(g, i) for g in (None, "a") for i in range(200)]
    df = spark.createDataFrame(rows, "run string, step int")
    got = {(r["run"], r["step"]): r["m"] for r in running(df, ["run"], ["step"], None, "count", "m", blocks=5).collect()}
    assert got == {(g, i): i + 1 for g, i in rows}


def test_normalize_in_one_pass(spark):
    from domainlab.functions import normalize as NZ
    want = {None: None, "": "", "ABC": "abc", "\u00c9T\u00c9": "ete", "a\u0301\u0301": "a", "\ud55c": "\u1112\u1161\u11ab"}
    df = spark.createDataFrame([(t,) for t in want], "t string")
    out = NZ.normalize_frame(df, "t", "n")
    assert {r["t"]: r["n"] for r in out.collect()} == want
    assert NZ.normalize_frame(df.where("t is null"), "t", "n").first()["n"] is None
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("ArrowEvalPython") == 1


def test_split_report(spark):
    rows = [("a", "train"), ("a", "train"), ("a", "val"), ("b", "val"), (None, "test")]
    df = spark.createDataFrame(rows, "domain string, split string")
    got = {tuple(r) for r in SP.split_report(df).select("split", "rows", "overlap_rows").collect()}
    assert got == {("train", 2, 2), ("val", 2, 1), ("test", 1, 0)}


def test_bad_files_are_reported(spark, tmp_path):
    df = spark.createDataFrame([("a.com", 1)], "domain string, label int")
    df.coalesce(1).write.parquet(str(tmp_path / "x"))
    good = next(p for p in (tmp_path / "x").iterdir() if p.suffix == ".parquet")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "fine.parquet").write_bytes(good.read_bytes())
    bad = tmp_path / "in" / "torn.parquet"
    bad.write_bytes(b"PAR1 nothing of use PAR1")
    with pytest.raises(Exception):
        spark.read.schema(df.schema).parquet(str(tmp_path / "in")).collect()
    read = spark.read.schema(df.schema).option("ignoreCorruptFiles", "true").parquet(str(tmp_path / "in"))
    out = RD.files_without_rows(spark, [str(tmp_path / "in")], read).collect()
    assert [(r["path"].rsplit("/", 1)[-1], r["length"]) for r in out] == [("torn.parquet", bad.stat().st_size)]


def test_checkpoint_folder_is_required_off_local(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(ValueError):
        session.checkpoint_dir(Session())


def test_workers_can_import_the_package(spark):
    session.ship_package(spark)

    def where(batches):
        import domainlab.functions.normalize  # noqa: F401
        yield from batches

    assert spark.range(3).mapInArrow(where, "id long").agg(F.count("*")).first()[0] == 3
