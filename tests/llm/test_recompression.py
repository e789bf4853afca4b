"""Runs, extensions and digests against plain loops over words."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from domainlab.llm import recompression as R
from domainlab.llm import textvec as TV

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """Every maximal stretch of period p, for every p; its smallest period must be p."""
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and (i, j + p) not in out:
                out[i, j + p] = p
            i = j
    return sorted((s, e - s, p) for (s, e), p in out.items())


def brute(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join("%d,%d,%d\n" % r for r in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def describe(rows):
    out = []
    for c in TV.chunks(pa.array([t for _, t in rows], pa.string())):
        ids = [i for i, _ in rows[c.first:c.first + c.n]]
        out += [(i, *r) for i, r in zip(ids, R.describe(c, ids))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=90))
def test_extensions(word):
    s = np.array([100, *word, 101])
    g = R.Grammar(s)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(s)), np.arange(len(s))))
    a, b = a[a != b], b[a != b]
    for way in (1, -1):
        want = []
        for x, y in zip(a.tolist(), b.tolist()):
            k = 0
            while 0 <= x < len(s) and 0 <= y < len(s) and s[x] == s[y]:
                x, y, k = x + way, y + way, k + 1
            want.append(k)
        assert g.extension(a, b, way).tolist() == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text("ab ", max_size=120), st.builds(lambda t, k, u: (t + " ") * k + u,
       st.text("ab ", max_size=12), st.integers(0, 12), st.text("ab ", max_size=30))), max_size=6))
def test_texts_of_few_words(texts):
    rows = [(k * 7, t) for k, t in enumerate(texts)]
    assert describe(rows) == [brute(*r) for r in rows]


def fibonacci(n):
    a, b = "a", "a b"
    while len(b) < n:
        a, b = b, b + " " + a
    return b


SHAPES = [None, "", " \t\n", "one", "a " * 5, "a " * 6, "a " * 5000, "a b " * 12 + "a", "x " + "a b c " * 4 + "d",
          fibonacci(3000), "a a b " * 300 + "a a a " * 300, " ".join("the " + str(k % 7) for k in range(900)),
          ("a " * 9 + "b ") * 40, "　 wide　space " * 9, "dot. " * 7, "x\x0by\x0cz\r\n" * 8,
          " ".join("ab"[bin(k).count("1") % 2] for k in range(4096)),
          ((" ".join(map(str, range(50))) + " ") * 5 + "q ") * 5]


def test_shapes():
    rows = [(k, t) for k, t in enumerate(SHAPES)] + [(None, "a b " * 9), (5, "a b " * 9), (5, "a b " * 9)]
    assert describe(rows) == [brute(*r) for r in rows]


def test_one_long_text():
    t = " ".join(str(k * k % 1009) for k in range(30_000)) + " end" * 20_000
    got = describe([(3, t)])[0]
    assert got[1] >= 2 and got[2:5] in {(0, 30_000, 1009), (30_000, 20_000, 1)}


def test_table(spark):
    rows = [(k, t) for k, t in enumerate(SHAPES)] + [(None, "a b " * 9), (5, "z"), (5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"start": F.lit(1), "n_runs": F.lit("x"), "period": F.lit(None).cast("int")}).repartition(3)
    assert sorted(map(tuple, R.runs(docs).collect()), key=repr) == sorted((brute(*r) for r in rows), key=repr)


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = [brute(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sorted(map(tuple, R.runs(docs).collect()), key=repr)
    assert got == sorted(want, key=repr) and any(r[1] for r in got)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None)]])
def test_nothing(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert list(map(tuple, R.runs(docs).collect())) == [brute(*r) for r in rows]
