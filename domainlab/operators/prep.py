"""Row preparation: positional labelling, filters, de-duplication, assembly
(P1-P6, A1-A3). All plain DataFrame operations; the only shuffles are the
de-duplication aggregates, which combine map-side first (hot keys collapse
before the exchange)."""

from __future__ import annotations

import datetime as _dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlab.functions import suffix as S
from domainlab.functions.util import to_col

# The class labels.
BENIGN, DGA = 0, 1


def label_rows(df: DataFrame, klass: str) -> DataFrame:
    """Ranked lists carry the domain in column 1 (label 0), feeds in column 0
    (label 1); keep ``domain, label``."""
    if klass == "benign":
        src, lab = df.columns[1], BENIGN
    elif klass == "dga":
        src, lab = df.columns[0], DGA
    else:
        raise ValueError(f"unknown class {klass!r}")
    return df.select(F.col(src).cast("string").alias("domain"), F.lit(lab).cast("int").alias("label"))


def not_underscore(domain) -> Column:
    """P3 predicate: no ``_`` in the domain; NULL passes."""
    return ~F.coalesce(F.contains(to_col(domain), F.lit("_")), F.lit(False))


def drop_underscore(df: DataFrame, col: str = "domain") -> DataFrame:
    """P2 + P3: lower-case, and drop names with ``_`` (plain substring test). Lower-casing makes and
    loses no ``_``, so names are tested as they come and each is lower-cased once."""
    return df.where(not_underscore(col)).withColumn(col, F.lower(col))


def in_year(df: DataFrame, col: str, year: int) -> DataFrame:
    """Half-open ``[Y-01-01, Y+1-01-01)`` as two comparisons (pushes down)."""
    lo, hi = _dt.datetime(year, 1, 1), _dt.datetime(year + 1, 1, 1)
    return df.where((F.col(col) >= F.lit(lo)) & (F.col(col) < F.lit(hi)))


def prepare(df: DataFrame, index: "S.SuffixIndex", col: str = "domain") -> DataFrame:
    """P2 -> P3 -> T3: the per-file preparation of the ingest step."""
    return S.wrap_tld(drop_underscore(df, col), col, index)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """A1: union all by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def dedup(df: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """A2: one row per ``key``; among duplicates keep the one with the smallest
    ``order`` columns (then the remaining columns), so the result is deterministic.

    A ``min`` over a struct is a mergeable aggregate: each partition reduces its
    own duplicates before the shuffle, so a key holding a third of all rows costs
    one row per map task in the exchange."""
    rest = [c for c in df.columns if c not in key]
    order = [c for c in (order or []) if c in rest]
    fields = order + [c for c in rest if c not in order]
    if not fields:
        return df.select(*key).distinct()
    agg = df.groupBy(*key).agg(F.min(F.struct(*fields)).alias("_keep"))
    return agg.select(*key, *[F.col("_keep")[c].alias(c) for c in fields]).select(*df.columns)


def assemble(df: DataFrame) -> DataFrame:
    """A3: full-row distinct after a union (a domain with labels 0 and 1 keeps both)."""
    return df.distinct()


def prepared_domains(raw: DataFrame, index: "S.SuffixIndex") -> DataFrame:
    """The per-(year, class) ingest result: lower, underscore filter, wrap, then
    one row per (year, label, domain) keeping the smallest doc_id.

    Ranked lists repeat the same names day after day, so rows are first reduced
    per lower-cased name (map-side combined) and only the survivors are wrapped;
    a second reduction merges names that wrap to the same string. Taking the
    minimum in two steps equals taking it once."""
    keys = ["year", "label", "domain"]
    pre = dedup(drop_underscore(raw, "domain"), keys, ["doc_id"])
    return dedup(S.wrap_tld(pre, "domain", index), keys, ["doc_id"])


def prepared_names(raw: DataFrame, index: "S.SuffixIndex") -> DataFrame:
    """The same rows without doc_id and family: each lower-cased name is wrapped once, however
    many years and classes it occurs in."""
    seen = drop_underscore(raw, "domain").select("year", "label", "domain").distinct()
    wrapped = S.wrap_tld(by_name(seen), "domain", index)
    return each_row(wrapped, "domain").select("year", "label", "domain").distinct()


def by_name(rows: DataFrame, name: str = "domain", out: str = "_in") -> DataFrame:
    """One row per name; the other columns as ``out``, a list with one entry per row of the name.
    For what depends on the name alone and is dear. The rows of a name are few: as many as the
    years and classes it is prepared for."""
    rest = [c for c in rows.columns if c != name]
    return rows.groupBy(name).agg(F.collect_list(F.struct(*rest)).alias(out))


def each_row(names: DataFrame, *keep: str, listed: str = "_in") -> DataFrame:
    """The rows of :func:`by_name` again, with the columns ``keep`` of their names."""
    return names.select(*keep, F.inline(listed))
