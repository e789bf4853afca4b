import pytest

from domainlab.functions import suffix as S
from domainlab.operators import audit

CASES = [
    ("Naver.co.kr", "naver[.co][.kr]"), ("sub.example.com", "sub.example[.com]"),
    ("googleapis.com", "googleapis[.com]"), (" Foo.COM ", "foo[.com]"), ("co.uk", "co[.uk]"),
    ("github.io", "github[.io]"), ("x.github.io", "x[.github][.io]"),
    ("s3.amazonaws.com", "s3.amazonaws[.com]"), ("foo.kawasaki.jp", "foo[.kawasaki][.jp]"),
    ("city.kawasaki.jp", "city[.kawasaki][.jp]"), ("com", "com"), ("localhost", "localhost"),
    ("example.zzz.qqq", "example.zzz.qqq"), ("1.2.3.4", "1.2.3.4"), ("foo.", "foo[.]"), ("", ""),
    (None, None),
]


@pytest.fixture(scope="module")
def index(spark):
    return S.SuffixIndex.mini(spark)


def test_wrap_tld_fixture_cases(spark, index):
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(CASES)], "i int, d string")
    got = {r["i"]: r["w"] for r in S.wrap_tld(df, "d", index, out="w").collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


def test_wrap_is_narrow(spark, index):
    df = spark.createDataFrame([("a.b.com",)], "d string")
    plan = S.wrap_tld(df, "d", index, out="w")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_previous_wrapper_audit(spark, index):
    df = spark.createDataFrame([("s3.amazonaws.com", "f2"), ("s3.amazonaws.com", "f1"),
                                ("github.io", "f1"), ("naver.co.kr", "f1")], "d string, src string")
    bad, three = audit.audit_wrap(df, "d", "src", index)
    rows = {r["original_domain"]: r for r in bad.collect()}
    assert set(rows) == {"s3.amazonaws.com", "github.io"}
    assert rows["s3.amazonaws.com"]["processed_domain"] == "[.s3][.amazonaws][.com]"
    assert rows["s3.amazonaws.com"]["processed_domain2"] == "s3.amazonaws[.com]"
    assert rows["s3.amazonaws.com"]["source_file"] == "f1"
    assert [r["original_domain"] for r in three.collect()] == ["s3.amazonaws.com"]


def test_full_public_list_if_present(spark):
    import os
    path = "/usr/share/publicsuffix/public_suffix_list.dat"
    if not os.path.exists(path):
        pytest.skip("no public suffix list on this machine")
    rules = S.read_psl(spark, path)
    assert rules.where("is_private").count() > 100
    idx = S.SuffixIndex(rules)
    df = spark.createDataFrame([("www.bbc.co.uk",), ("foo.blogspot.com",), ("a.b.city.kawasaki.jp",)], "d string")
    got = [r["w"] for r in S.wrap_tld(df, "d", idx, out="w").orderBy("d").collect()]
    assert got == ["a.b.city[.kawasaki][.jp]", "foo[.blogspot][.com]", "www.bbc[.co][.uk]"]


def test_punycode_labels(spark):
    """Native scripts from their ACE forms, against the standard library's codec; labels that
    do not decode stay."""
    from domainlab.functions import punycode as PC
    words = ["рф", "香港", "個人", "中国", "公司", "bücher", "münchen-ost", "ελλάς", "ไทย", "भारत", "السعودية", "한국", "ößñ",
             "ゝゞ", "a中b国c", "😀", "中" * 30, "zażółć-gęślą-jaźń", "\U00010400\U0010ffff"]
    ace = ["xn--" + w.encode("punycode").decode() for w in words]
    odd = ["xn--", "xn--abc-", "xn---", "xn--p1a!", "xn--99999999", "xn--zzzzzzzzzzzzzzzzzzzz", "xn--ф", "com", "", "xn-p1ai",
           "xn--p1ai\x1cx-1[\n", "xn--a-!!!b", "xn--" + "\ud800".encode("punycode").decode(), "xn--ab-99999b"]
    df = spark.createDataFrame(list(enumerate(ace + odd)), "i int, l string")
    got = [r[0] for r in df.select("i", PC.decode_label("l").alias("d")).orderBy("i").select("d").collect()]
    assert got == words + odd


def test_labels_are_decoded_only_for_native_rules(spark):
    """No step decodes where no rule has a native label, and names are wrapped alike; with such
    rules decoding is one Arrow step, not a fold over characters."""
    df = spark.createDataFrame([("a.b.xn--p1ai",), ("a.xn--p1ai.co.uk",), ("a.b.xn--zz--",)], "d string")
    plain = S.wrap_tld(df, "d", S.SuffixIndex.mini(spark), out="w")
    idn = S.wrap_tld(df, "d", S.SuffixIndex(S.rules_frame(spark, [*S.MINI_RULES_ICANN, "рф", "xn--zz--"])), out="w")
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (plain, idn)]
    assert "xn--" not in plans[0] and "ArrowEvalPython" in plans[1] and "aggregate(" not in plans[1]
    assert sorted(r.w for r in plain.collect()) == ["a.b.xn--p1ai", "a.b.xn--zz--", "a.xn--p1ai[.co][.uk]"]
    assert sorted(r.w for r in idn.collect()) == ["a.b[.xn--p1ai]", "a.b[.xn--zz--]", "a.xn--p1ai[.co][.uk]"]


def test_internationalised_suffixes(spark):
    """Rules and names match in either form; results keep the name's own labels."""
    idx = S.SuffixIndex(S.rules_frame(spark, S.MINI_RULES_ICANN + S.IDN_RULES))
    cases = [("x.y.xn--p1ai", "x.y[.xn--p1ai]"), ("x.y.рф", "x.y[.рф]"), ("a.b.公司.cn", "a.b[.公司][.cn]"),
             ("a.b.XN--55QX5D.cn", "a.b[.xn--55qx5d][.cn]"), ("a.b.個人.xn--j6w193g", "a.b[.個人][.xn--j6w193g]"),
             ("a.b.xn--gmqw5a.香港", "a.b[.xn--gmqw5a][.香港]"), ("a.b.укр", "a.b[.укр]"), ("a.b.xn--j1amh", "a.b[.xn--j1amh]"),
             ("a.b.foo.中国", "a.b[.foo][.中国]"), ("a.центр.xn--fiqs8s", "a.центр[.xn--fiqs8s]"),
             ("a.xn--e1aqjhr.中国", "a.xn--e1aqjhr[.中国]"), ("a.b.xn--zz--", "a.b.xn--zz--"), ("a.b.РФ", "a.b[.рф]")]
    df = spark.createDataFrame([(i, d) for i, (d, _) in enumerate(cases)], "i int, d string")
    got = [r["w"] for r in S.wrap_tld(df, "d", idx, out="w").orderBy("i").collect()]
    assert got == [w for _, w in cases]
