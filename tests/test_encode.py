from pyspark.sql import functions as F

from domainlab.operators import encode as EN
from domainlab.operators import samples as SM


def _vocab():
    return EN.Vocab({"[.com]": 7, "[.co]": 8, "[.kr]": 9}, 9, {})


def _one(spark, col):
    return spark.createDataFrame([("google2ec[.co][.kww]",)], "d string").select(col.alias("v")).first()["v"]


def test_char_encode(spark):
    assert _one(spark, EN.encode_char("d", _vocab())) == [16, 24, 24, 16, 21, 14, 38, 14, 12, 8, 6]


def test_packs(spark):
    ids = EN.encode_char("d", _vocab())
    base = [16, 24, 24, 16, 21, 14, 38, 14, 12, 8, 6]
    assert _one(spark, EN.pack_pretrain(ids, 20)) == base + [3] + [0] * 8
    assert _one(spark, EN.pack_finetune(ids, 20)) == [2] + base + [3] + [0] * 7
    assert _one(spark, EN.pack_pretrain(ids, 13)) == base + [3, 0]
    assert _one(spark, EN.pack_finetune(ids, 13)) == [2, 5, 24, 24, 16, 21, 14, 38, 14, 12, 8, 6, 3]
    assert _one(spark, EN.pack_pretrain(ids, 12)) == [5, 24, 24, 16, 21, 14, 38, 14, 12, 8, 6, 3]
    assert _one(spark, EN.pack_finetune(ids, 12)) == [2, 5, 24, 16, 21, 14, 38, 14, 12, 8, 6, 3]
    assert _one(spark, EN.pack_pretrain(ids, 10)) == [5, 16, 21, 14, 38, 14, 12, 8, 6, 3]
    assert _one(spark, EN.pack_finetune(ids, 10)) == [2, 5, 21, 14, 38, 14, 12, 8, 6, 3]


def test_template_and_mask(spark):
    df = spark.createDataFrame([([7, 0, 9],)], "ids array<int>")
    r = df.select(EN.template("ids").alias("t"), EN.pad_mask("ids").alias("m")).first()
    assert r["t"] == [2, 7, 0, 9, 3] and r["m"] == [False, True, False]


def test_tov_unshuffled_from_short_pack(spark):
    df = spark.createDataFrame([([5, 16, 21, 14, 38, 14, 12, 8, 6, 3], "k")], "ids array<int>, k string")
    # force the "no shuffle" branch with p = 0
    r = SM.add_tov(df, "ids", "k", 9, 10, seed=1, p=0.0).first()
    assert r["x_tov"] == [2, 5, 21, 14, 38, 14, 12, 8, 6, 3] and r["y_tov"] == 0


def test_mtp_counts(spark):
    ids = [16, 24, 24, 16, 21, 14, 38, 14, 12, 8, 6, 3] + [0] * 8
    df = spark.createDataFrame([(ids, "google2ec[.co][.kww]")], "ids array<int>, k string")
    r = SM.add_mtp(df, "ids", "k", 9).first()
    masked = [i for i, v in enumerate(r["x_mtp"]) if v == 4]
    assert len(masked) == 1 and masked[0] < 9
    assert sum(1 for v in r["y_mtp"] if v == -100) == 19
    assert r["y_mtp"][masked[0]] == ids[masked[0]]
    assert [v for i, v in enumerate(r["x_mtp"]) if i != masked[0]] == [v for i, v in enumerate(ids) if i != masked[0]]


def test_single_eligible_unchanged(spark):
    v = EN.Vocab({"[.com]": 7}, 7, {})
    df = spark.createDataFrame([("a[.com]",)], "d string").select(EN.pack_pretrain(EN.encode_char("d", v), 6).alias("ids"), F.col("d"))
    r = SM.pretrain_samples(df, "ids", "d", 7, 6).first()
    assert r["x_mtp"] == r["ids"] and set(r["y_mtp"]) == {-100}
    assert r["x_tpp"] == r["ids"] and r["y_tov"] == 0


def test_tpp_preserves_multiset(spark):
    ids = [16, 24, 1, 16, 21, 14, 38, 8, 6, 3, 0, 0]
    df = spark.createDataFrame([(ids, f"k{i}") for i in range(50)], "ids array<int>, k string")
    for r in SM.add_tpp(df, "ids", "k", 9).collect():
        assert sorted(r["x_tpp"]) == sorted(ids)
        assert r["x_tpp"][7:] == ids[7:]
        assert r["y_tpp"] == [v if v != 0 else -100 for v in ids]
