from pyspark.sql import functions as F

from domainlab.operators import split as SP
from domainlab.operators import vocab as V
from domainlab.operators import wordpiece as WP


def test_exact_split_sizes_and_order(spark):
    rows = [(g, f"d{g}_{i}") for g in (1, 2) for i in range(3000)] + [(3, f"s{i}") for i in range(10)]
    df = spark.createDataFrame(rows, "g int, domain string")
    out = SP.exact_split(df, "domain", ["g"], train_size=1000, val_size=100, seed=7)
    c = {(r.g, r.split): r["count"] for r in out.groupBy("g", "split").count().collect()}
    assert c[(1, "train")] == 1000 and c[(1, "val")] == 100 and c[(1, "test")] == 1900
    assert c[(3, "train")] == 10 and (3, "val") not in c
    # same result as a full sort on (md5(seed:domain), domain)
    import hashlib
    keys = sorted((hashlib.md5(f"7:{d}".encode()).hexdigest(), d) for g, d in rows if g == 2)
    want_train = {d for _, d in keys[:1000]}
    got_train = {r.domain for r in out.where("g = 2 and split = 'train'").collect()}
    assert got_train == want_train


def test_tld_vocab_ids(spark):
    df = spark.createDataFrame([("a[.com]",)] * 12 + [("b[.co][.kr]",)] * 10 + [("c[.x]",)] * 3, "domain string")
    t = V.tld_counts(df, "domain", 10)
    v = {r.token: r.id for r in V.char_vocab(t).collect()}
    assert v["[.com]"] == 7 and v["[.co]"] in (8, 9) and "[.x]" not in v
    assert v["a"] == 10 and v["."] == 10 + 37


def test_wordpiece_toy_corpus(spark):
    wc = spark.createDataFrame([("aab", 2), ("aac", 1)], "word string, count long")
    def learn(m):
        v = WP.train_wordpiece(wc, 100, m, specials=["[PAD]", "[UNK]"])
        return [r.token for r in v.where("kind = 'merge'").orderBy("id").collect()], \
               {r.token for r in v.where("kind = 'alphabet'").collect()}
    merges, alpha = learn(2)
    assert alpha == {"a", "b", "c", "##a", "##b", "##c"} and merges == ["aa", "aab"]
    assert learn(3)[0] == ["aa"]
    assert set(learn(1)[0]) == {"aa", "aab", "aac"}


def test_wordpiece_encode_greedy(spark):
    vocab = {"[UNK]": 1, "goo": 10, "g": 11, "##gle": 12, "##o": 13, "-": 14}
    df = spark.createDataFrame([("google-x",), ("GOOGLE",)], "t string")
    got = {r.t: r.wp for r in WP.wordpiece_encode(df, "t", vocab, "wp").collect()}
    assert got["GOOGLE"] == [10, 12] and got["google-x"] == [10, 12, 14, 1]
