import numpy as np
from pyspark.sql import functions as F

from domainlab.operators import encode as EN
from domainlab.operators import features as FE
from domainlab.plans import model as MD


def test_hashed_lookup_and_token_array(spark):
    ids = {f"[.t{k}]": 7 + k for k in range(1900)} | {"[.\u00e9\"\\]": 5000}
    v = EN.Vocab(ids, 5000, {i: t for t, i in ids.items()})
    df = spark.createDataFrame([(t,) for t in [*ids, "[.none]", ""]], "t string")
    find = EN.hashed_lookup(ids)
    got = df.select("t", F.transform(F.array("t"), find)[0].alias("i")).collect()
    assert {r.t: r.i for r in got} == {**ids, "[.none]": None, "": None}
    assert all(r.i is None for r in df.select(EN.hashed_lookup({})(F.col("t")).alias("i")).collect())
    ask = spark.createDataFrame([([7, 1906, 1907, 5000, 9999, -1],), ([],), (None,)], "x array<int>")
    assert [r[0] for r in ask.select(EN.decode("x", v)).collect()] == [
        "[.t0] [.t1899] [UNK] [.\u00e9\"\\] [UNK] [UNK]", "", None]


def test_pool_positions(spark):
    table = {1: [1.0, -2.0], 3: [5.0, 4.0]}
    rows = [(0, [1, 3, 0]), (1, []), (2, None), (3, [0, 0]), (4, [99, 3])]
    df = spark.createDataFrame(rows, "k int, ids array<int>")

    def run(**kw):
        return {r.k: r.f for r in FE.pool_positions(df, "ids", table, 2, "f", **kw).collect()}
    assert run() == {0: [5.0, 4.0, 2.0, 2 / 3], 1: None, 2: None, 3: [0.0] * 4, 4: [5.0, 4.0, 2.5, 2.0]}
    assert run(mask_pads=True) == {0: [5.0, 4.0, 3.0, 1.0], 1: None, 2: None, 3: None, 4: [5.0, 4.0, 2.5, 2.0]}
    assert run(mode="cls") == {0: [1.0, -2.0], 1: None, 2: None, 3: [0.0, 0.0], 4: [0.0, 0.0]}


def test_full_size_vector_table(spark):
    n, dim = 32_393, 256
    m = np.random.default_rng(0).normal(size=(n, dim))
    df = spark.range(2000).select("id", F.transform(F.sequence(F.lit(1), F.lit(82)),
                                                    lambda j: ((F.col("id") * 7919 + j * 104729) % n).cast("int")).alias("ids"))
    got = FE.pool_positions(df, "ids", dict(enumerate(m)), dim, "f").where("id % 500 = 1").collect()
    assert len(got) == 4
    for r in got:
        v = m[r.ids]
        np.testing.assert_allclose(r.f, np.concatenate([v.max(axis=0), v.mean(axis=0)]))


def test_two_branches_tell_classes_apart(spark):
    rows = [(y, k % 2, [2, 5 + k % 2, 3], [2, 10 + k % 7, 3]) for y in (2017, 2020, 2021) for k in range(60)]
    df = spark.createDataFrame(rows, "year int, label int, token array<int>, char array<int>")
    vectors = {b: MD.vector_table(MD.token_vectors(df, b, 4)) for b in ("token", "char")}
    assert set(vectors["token"]) == {2, 3, 5, 6} and set(vectors["char"]) == {2, 3, *range(10, 17)}
    f = MD.domain_features(df, {b: (b, vectors[b], 4) for b in ("token", "char")})
    assert {len(r.features) for r in f.select("features").collect()} == {16}
    r = {x.year: x for x in MD.forward_chain(f, train_years=(2017,)).collect()}
    assert set(r) == {"2020", "2021", "overall"}
    assert r["2020"].n == 60 and r["overall"].n == 120 and r["overall"].accuracy == 1.0


def test_masked_pooling(spark):
    """Positions outside the mask are not read; a row without any has no features."""
    from domainlab.operators import features as FE
    from domainlab.plans import model as MD
    df = spark.createDataFrame([(0, [2, 7, 3, 0], [1, 1, 1, 0]), (1, [2, 7, 9, 9], [0, 1, 0, 1]), (2, [2, 3], [0, 0]),
                                (3, None, None)], "i int, ids array<int>, m array<int>")
    table = {0: [9.0, 9.0], 2: [1.0, 0.0], 7: [0.0, 4.0], 3: [2.0, -1.0]}
    got = {r.i: (r.f, r.c) for r in FE.pool_positions(
        FE.pool_positions(df, "ids", table, 2, "f", mask="m"), "ids", table, 2, "c", "cls", mask="m").collect()}
    assert got == {0: ([2.0, 4.0, 1.0, 1.0], [1.0, 0.0]), 1: ([0.0, 4.0, 0.0, 2.0], [0.0, 4.0]), 2: (None, None), 3: (None, None)}
    fused = MD.domain_features(df, {"a": ("ids", table, 2), "external": ("ids", table, 2, "m")}).orderBy("i").first()
    assert fused.features == [9.0, 9.0, 3.0, 3.0, 2.0, 4.0, 1.0, 1.0]
