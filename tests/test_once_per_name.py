"""Work that depends on the name alone is done once per name, however many rows share it."""

import numpy as np

from domainlab.functions import suffix as S
from domainlab.operators import prep
from domainlab.plans import head as HD
from domainlab.session import ship_package


def test_rows_of_a_name_come_back(spark):
    rows = [(2017, 0, "a.com"), (2018, 0, "a.com"), (2018, 1, "a.com"), (2017, 0, None), (None, 0, "b.com")]
    df = spark.createDataFrame(rows, "year int, label int, domain string")
    names = prep.by_name(df)
    assert names.count() == 3
    back = prep.each_row(names, "domain").select("year", "label", "domain").collect()
    assert sorted(map(str, map(tuple, back))) == sorted(map(str, rows))


def test_names_are_prepared_alike(spark):
    rows = [("A.co.uk", 3, 2017, "f", 0), ("a.co.uk", 1, 2017, "g", 0), ("a.co.uk", 2, 2018, "g", 1), ("x_y.com", 4, 2017, "f", 0),
            (None, 5, 2017, "f", 0), ("b.github.io", 6, None, "f", 0), (" b.github.io", 7, None, "f", 0)]
    raw = spark.createDataFrame(rows, "domain string, doc_id long, year int, family string, label int")
    index = S.SuffixIndex.mini(spark)
    want = prep.prepared_domains(raw, index).select("year", "label", "domain").collect()
    got = prep.prepared_names(raw, index).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(got) == 4


def test_head_counts_alike_rows(spark):
    """A row with its number weighs as much as the row repeated."""
    ship_package(spark)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 3))
    rows = [("val" if i % 5 == 0 else "train", int(v[0] > 0), [float(e) for e in v], 1 + i % 4) for i, v in enumerate(x)]
    once = spark.createDataFrame(rows, "fold string, label int, features array<double>, n int")
    many = spark.createDataFrame([r[:3] for r in rows for _ in range(r[3])], "fold string, label int, features array<double>")
    a, b = HD.fit_head(once, width=4, steps=4, weight="n"), HD.fit_head(many, width=4, steps=4)
    assert [r[:3] for r in a.log] == [r[:3] for r in b.log]
    assert np.allclose([r[3] for r in a.log], [r[3] for r in b.log])
    assert np.allclose(a.val_accuracy, b.val_accuracy) and np.allclose(a.best.weights, b.best.weights)
