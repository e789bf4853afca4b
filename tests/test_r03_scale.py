"""Steps of round 3 that grew too dear: training rounds on numbered symbols (F12, F18), pooling of
padded rows (F2, F3, F6), the text of features (F6), raw rows and names (all of them)."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from domainlab.operators import features as FE
from domainlab.operators import prep
from domainlab.operators import wordpiece as WP


def test_batch_merges_equal_merging_word_by_word():
    rnd = random.Random(5)
    for _ in range(60):
        words = [[rnd.randint(0, 3) for _ in range(rnd.randint(2, 12))] for _ in range(20)]
        pairs = rnd.sample([(a, b) for a in range(6) for b in range(6)], rnd.randint(1, 12))
        merges = [(a, b, 4 + k) for k, (a, b) in enumerate(pairs)]
        rank = {(a, b): k for k, (a, b, _) in enumerate(merges)}
        want = []
        for w in words:
            while len(w) > 1:
                p = min(zip(w, w[1:]), key=lambda x: rank.get(x, len(rank)))
                if p not in rank:
                    break
                w = WP._merge(w, *p, merges[rank[p]][2])
            want.append(w)
        order = {(a << 32) | b: k for k, (a, b, _) in enumerate(merges)}
        table = np.array(sorted(order), np.int64)
        flat, size = WP._merge_ranked(np.array([x for w in words for x in w], np.int64),
                                      np.array([len(w) for w in words]), table,
                                      np.array([order[c] for c in table.tolist()]),
                                      np.array([m for *_, m in merges], np.int64))
        ends = np.cumsum(size)
        assert [flat[e - n:e].tolist() for e, n in zip(ends, size)] == want


def test_rounds_pass_over_numbers_and_keep_signs_of_the_prefix(spark):
    """A word of the prefix's own characters, one with an accent and one beyond the BMP."""
    wc = spark.createDataFrame([("####", 3), ("#a#", 2), ("éé", 4), ("😀😀a", 2), ("a", 9)], "word string, count long")
    numbered = WP._numbered(wc.withColumnRenamed("count", "n"), {c: i for i, c in enumerate(
        ["#", "###", "##a", "é", "##é", "😀", "##😀"])} | {"a": 9})
    assert dict(numbered.dtypes)["symbols"] == "array<int>"
    assert sorted(r["symbols"] for r in numbered.collect()) == [[0, 1, 1, 1], [0, 2, 1], [3, 4], [5, 6, 2]]
    got = [r.token for r in WP.train_wordpiece(wc, 100, 2, specials=[]).where("kind = 'merge'").orderBy("id").collect()]
    assert {"éé", "😀😀a"} <= set(got)


def test_zero_vectors_are_counted_not_read():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(9, 4))
    m[0] = m[7] = 0.0
    rows = [[0, 0, 0], [1, 2, 0, 0, 0], [3], [0, 4, 7, 5], [], [8, 8, 6]] * 120
    size = np.array([len(r) for r in rows])
    size[4] = -1
    got = FE.pool_flat(np.array([i for r in rows for i in r]), size, m, "pool").to_pylist()
    for r, g in zip(rows, got):
        if not r:
            assert g is None
            continue
        np.testing.assert_allclose(g, np.concatenate([m[r].max(axis=0), m[r].mean(axis=0)]), rtol=1e-12, atol=0)


def test_pooling_reads_no_pads(monkeypatch):
    """Work follows the positions that hold a vector, not the padded length."""
    seen = []
    kept = FE.np.maximum

    class Counting:
        def __call__(self, *a, **k):
            return kept(*a, **k)

        def reduceat(self, v, s):
            seen.append(len(v))
            return kept.reduceat(v, s)
    monkeypatch.setattr(FE.np, "maximum", Counting())
    m = np.ones((3, 2))
    m[0] = 0.0
    FE.pool_flat(np.array(([1, 2] + [0] * 80) * 50), np.full(50, 82), m, "pool")
    assert sum(seen) == 100


def test_text_in_arrow_equals_the_jvm_one(spark):
    rnd = random.Random(2)
    odd = [0.0, -0.0, 1e-7, -1e-7, 5e-7, -5e-7, 0.0078125, -0.0078125, 0.1234565, 1.0000005, float("nan"),
           float("inf"), -float("inf"), 1e15 + 0.5, 1e22, 1e305, 123456789012345678901.0]
    values = odd + [round(rnd.uniform(-2, 2), 7) for _ in range(4000)] + [k / 2 ** 9 for k in range(-999, 999)]
    rows = [(values[i:i + 5],) for i in range(0, len(values), 5)] + [([],), (None,)]
    df = spark.createDataFrame(rows, "v array<double>")
    both = df.select("v", FE.vec_text("v").alias("jvm"), FE.vec_text_arrow("v").alias("arrow"))
    assert both.where(~F.col("jvm").eqNullSafe(F.col("arrow"))).collect() == []


def test_words_are_cached_not_whole_names():
    vocab, cache = {"[UNK]": 1, "a": 2, ".": 3, "co": 4, "b": 5}, {}
    assert WP.encode_text("a.co", vocab, 1, cache) == [2, 3, 4]
    assert WP.encode_text("b.co", vocab, 1, cache) == [5, 3, 4]
    assert set(cache) == {"a", "b", ".", "co"}


@pytest.mark.parametrize("name, kept", [("A_b.Com", None), ("Ab.Com", "ab.com"), (None, None), ("İ_x", None)])
def test_underscore_is_tested_on_the_name_as_it_comes(spark, name, kept):
    got = prep.drop_underscore(spark.createDataFrame([(name,)], "domain string")).collect()
    assert [r["domain"] for r in got] == ([kept] if kept or name is None else [])
