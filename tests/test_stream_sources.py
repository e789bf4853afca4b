import os
import tempfile

import pytest

from domainlab.functions import suffix as S
from domainlab.operators import encode as EN
from domainlab.sources import readers as RD
from domainlab.streaming import prepare as ST


def test_stream_equals_batch(spark):
    base = tempfile.mkdtemp(prefix="domainlab-stream-")
    src, sink, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    rows = [("Naver.co.kr", 1), ("a_b.com", 2), ("x.github.io", 3), ("foo.kawasaki.jp", 4), ("zz.org", 5)]
    spark.createDataFrame(rows, "domain string, doc_id long").repartition(2).write.parquet(src)
    idx = S.SuffixIndex.mini(spark)
    voc = EN.Vocab({"[.com]": 7, "[.co]": 8, "[.kr]": 9}, 9, {})
    ST.run_stream(spark, src, "domain string, doc_id long", sink, ck, idx, voc, L=20)
    got = sorted(tuple(r) for r in ST.ids_as_text(spark.read.parquet(sink)).collect())
    want = sorted(tuple(r) for r in ST.ids_as_text(ST.batch_equivalent(spark, src, idx, voc, 20)).collect())
    assert got == want and len(got) == 4


def test_stream_is_scored_and_restarts(spark):
    from domainlab.plans import model as MD
    base = tempfile.mkdtemp(prefix="domainlab-stream-")
    src, sink, ck = (os.path.join(base, x) for x in ("src", "sink", "ck"))
    idx = S.SuffixIndex.mini(spark)
    voc = EN.Vocab({"[.com]": 7, "[.co]": 8, "[.kr]": 9}, 9, {})
    table = {i: [float(i % 3), float(i)] for i in range(50)}

    def features(d):
        return MD.domain_features(d, {"char": ("x_char", table, 2)})
    rows = [(f"{'z' * n}.com" if n % 2 else f"{'a' * n}.co.kr", n, n % 2) for n in range(1, 9)]
    new = lambda part: spark.createDataFrame(part, "domain string, doc_id long, label int")
    new(rows[:4]).coalesce(1).write.parquet(src)
    train = features(ST.prepare_stream(new(rows), idx, voc, 20))
    model = MD.fit_classifier(train)
    run = lambda: ST.run_stream(spark, src, "domain string, doc_id long", sink, ck, idx, voc, 20,
                                then=lambda d: MD.score(model, features(d)).select("doc_id", "y_pred"))
    run()
    assert spark.read.parquet(sink).count() == 4
    new(rows[4:]).coalesce(1).write.mode("append").parquet(src)
    run()
    run()                                         # nothing new: no row comes twice
    got = sorted(tuple(r) for r in spark.read.parquet(sink).collect())
    assert got == [(n, n % 2) for n in range(1, 9)]
    assert got == sorted((r.doc_id, r.y_pred) for r in MD.score(model, train).collect())


def test_feed_columns_are_declared(spark):
    base = tempfile.mkdtemp(prefix="domainlab-feed-")
    files = {"a.csv": "domain,valid_from,x\nq.com,2019-01-02 03:04:05,1\nw.com,never,2\ne.com,2019-01-01,3,4\n",
             "b.csv": "domain,x,valid_from\nr.com,5,2020-01-01 00:00:00\n"}
    for name, text in files.items():
        with open(os.path.join(base, name), "w") as f:
            f.write(text)
    names = ("domain", "valid_from", "x")
    good, bad = RD.read_feed(spark, [os.path.join(base, "a.csv")], names, with_bad=True)
    assert sorted((r.domain, str(r.valid_from), r.x) for r in good.collect()) == [
        ("q.com", "2019-01-02 03:04:05", "1"), ("w.com", "None", "2")]
    assert [r.domain for r in bad.collect()] == ["e.com"]
    both = [os.path.join(base, "*.csv")]
    with pytest.raises(Exception, match="CSV header does not conform"):
        RD.read_feed(spark, both, names).collect()
    by_place = RD.read_feed(spark, both, ("domain", "x", "valid_from"), check_header=False)
    assert {r.x for r in by_place.where("domain = 'r.com'").collect()} == {"5"}


def test_bad_csv_rows_are_isolated(spark):
    base = tempfile.mkdtemp(prefix="domainlab-csv-")
    with open(os.path.join(base, "a.csv"), "w") as f:
        f.write("1,google.com\n2,naver.com\nnot-a-number,bad.com,extra\n")
    with open(os.path.join(base, "b.csv"), "w") as f:
        f.write("3,example.org\n")
    good, bad = RD.read_ranked_list(spark, [os.path.join(base, "*.csv")], with_bad=True)
    assert sorted(r.domain for r in good.collect()) == ["example.org", "google.com", "naver.com"]
    assert len(bad.collect()) == 1   # a bare count() would prune to the corrupt column, which Spark refuses
    assert {r.source_file for r in good.collect()} == {"a.csv", "b.csv"}
