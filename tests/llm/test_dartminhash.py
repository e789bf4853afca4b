"""DartMinHash: estimates, classes against all pairs, awkward rows."""
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from domainlab.llm import dartminhash as D
from domainlab.llm import textvec as TV
from domainlab.session import ship_package


def weighted(text):
    w = (text or "").split()
    if not w:
        return Counter()
    return Counter(zip(*[w[i:] for i in range(5)])) if len(w) >= 5 else Counter([tuple(w)])


def similarity(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def brute(rows):
    """doc_id -> smallest id of its component under links of 0.8."""
    sets = [weighted(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and similarity(sets[i], sets[j]) >= 0.8:
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def corpus(seed=1, families=12, extra=60):
    """Families of near copies around a text, with edits on both sides of the threshold."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for f in range(families):
        base = [r.choice(words) for _ in range(r.choice([6, 12, 60, 150, 300]))]
        texts.append(base)
        for _ in range(r.choice([1, 3, 30])):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 18))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append(copy)
    texts += [[r.choice(words) for _ in range(r.randint(1, 80))] for _ in range(extra)]
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_estimate_is_unbiased():
    r = random.Random(3)
    base = [str(r.randrange(10**6)) for _ in range(400)] + ["the same five words again"] * 40
    texts = []
    for e in (0, 4, 10, 20, 40):
        t = list(base)
        for _ in range(e):
            t[r.randrange(400)] = str(r.randrange(10**6))
        texts.append(" ".join(t))
    (c,) = TV.chunks(pa.array(texts), 1 << 30)
    unit, doc = D.elements(c)
    big = D.signatures(unit, doc, c.n, 4000)
    for t in range(1, len(texts)):
        true = similarity(weighted(texts[0]), weighted(texts[t]))
        assert abs((big[0] == big[t]).mean() - true) < 0.04


def test_signature_does_not_depend_on_neighbours():
    rows = [t for _, t in corpus(5, 3, 5)]
    together = np.concatenate([D.signatures(*D.elements(c), c.n) for c in TV.chunks(pa.array(rows), 1 << 30)])
    alone = np.concatenate([D.signatures(*D.elements(c), c.n) for c in TV.chunks(pa.array(rows), 1)])
    assert (together == alone).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    ship_package(spark)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["class_id"] for r in D.classes(df).collect()}
    assert got == brute(rows)


def test_small_blocks_give_the_same(spark, monkeypatch):
    ship_package(spark)
    rows = corpus(7, 6, 10)
    monkeypatch.setattr(D, "BLOCK", 4)
    monkeypatch.setattr(D, "RESIDUAL", 2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in D.classes(df).collect()} == brute(rows)


def test_awkward_rows(spark):
    ship_package(spark)
    long = " ".join(str(i * 7919 % 100_003) for i in range(60_000))
    rows = [(1, None, "x"), (2, "", "x"), (3, " \n\t", "y"), (4, "a b", None), (5, "a b", "z"), (5, "a b", "z"),
            (None, "a b", "z"), (6, long, "q"), (7, long + " end", "q"), (8, "a  b\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id string")
    got = sorted(D.classes(df).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))
    assert [(r["doc_id"], r["class_id"]) for r in got] == [
        (1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4), (6, 6), (7, 6), (8, 4), (None, 4)]
    kept = D.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 3, 4, 6]


def test_deduplicate_keeps_any_columns(spark):
    ship_package(spark)
    names = ["_key", "_root", "_class", "_n", "key", "c1"]
    df = spark.createDataFrame([(1, "a b c", *"pqrstu"), (2, "a b c", *"vwxyza"), (3, "d", *"bcdefg")],
                               "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = D.deduplicate(df)
    assert out.columns == df.columns
    assert sorted(map(tuple, out.collect())) == [(1, "a b c", *"pqrstu"), (3, "d", *"bcdefg")]


def test_empty_table(spark):
    ship_package(spark)
    df = spark.createDataFrame([], "doc_id long, text string")
    assert D.classes(df).collect() == [] and D.deduplicate(df).collect() == []


def test_components(spark):
    run = D._Run(spark)
    r = random.Random(0)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(20)]
    up = {x: x for e in edges for x in e}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    df = spark.createDataFrame(edges, "a long, b long")
    got = {x["a"]: x["root"] for x in D.components(run, df, "t").collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
