"""Self-supervised samples (M1-M4) and fine-tuning samples (M5).

Randomness is a seeded hash, ``md5(seed ':' task ':' key ':' position)``: the same
row gives the same sample on any partitioning and on recomputation after an
executor loss, and the draws can be stated in SQL. "Eligible" positions hold UNK
or an id above ``max_special_id``; specials and TLD ids are never touched; with at
most one eligible position a sample is left unchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlab.functions.util import to_col
from domainlab.operators.vocab import CLS, MASK, PAD, SEP, SPARSE_TLD, TRUNC, UNK

IGNORE = -100
MASK_RATIO = 0.15
SHUFFLE_PROB = 0.5


def _key(seed, task: str, key: Column, pos: Column | None = None) -> Column:
    parts = [F.lit(str(seed)), F.lit(f":{task}:"), key]
    if pos is not None:
        parts += [F.lit(":"), pos.cast("string")]
    return F.md5(F.concat(*parts))


def eligible(ids: Column, max_special_id: int) -> Column:
    """0-based eligible positions in order."""
    return F.filter(F.sequence(F.lit(0), F.size(ids) - 1),
                    lambda i: (F.get(ids, i) == UNK) | (F.get(ids, i) > max_special_id))


def _ranked(elig: Column, seed, task: str, key: Column) -> Column:
    """Eligible positions ordered by their hash (a seeded random permutation)."""
    s = F.array_sort(F.transform(elig, lambda i: F.struct(_key(seed, task, key, i).alias("h"), i.alias("i"))))
    return F.transform(s, lambda x: x["i"])


def _stage(df: DataFrame, ids: str, key: str, max_special_id: int, seed, task: str) -> DataFrame:
    """Per-row arrays computed once as columns: eligible positions and their hash
    order for ``task``. Consumers reference every staged array at least twice, so
    the optimizer keeps it as a column instead of inlining it into a per-element
    lambda (where it would be recomputed for every position)."""
    if "_e" not in df.columns:   # shared by the three generators when chained
        df = df.withColumn("_e", eligible(F.col(ids), max_special_id))
    return df.withColumn(f"_perm_{task}", _ranked(F.col("_e"), seed, task, F.col(key)))


def _new_values(ids: str, perm: str) -> Column:
    """Values after moving the value at ``_e[r]`` to ``perm[r]``, aligned with the
    ascending ``_e`` (perm is a permutation of ``_e``)."""
    a = F.col(ids)
    pairs = F.arrays_zip(F.col(perm).alias("pos"), F.transform("_e", lambda i: F.get(a, i)).alias("val"))
    return F.transform(F.array_sort(pairs), lambda x: x["val"])


def _apply(ids: str, nv: str, max_special_id: int) -> Column:
    """Write the new eligible values back; the eligibility test is O(1) per
    position and only eligible positions look up their rank in ``_e``."""
    a = F.col(ids)
    moved = F.transform(a, lambda v, p: F.when(
        (v == UNK) | (v > max_special_id), F.element_at(nv, F.array_position("_e", p).cast("int"))).otherwise(v))
    return F.when((F.size(nv) > 1) & (F.size("_e") > 1), moved).otherwise(a)


def _tmp(df0: DataFrame, *names: str) -> list[str]:
    """Temporaries to drop; ``_e`` stays when the caller staged it."""
    return list(names) + ([] if "_e" in df0.columns else ["_e"])


def add_mtp(df: DataFrame, ids: str, key: str, max_special_id: int, seed=42,
            ratio: float = MASK_RATIO, x_out: str = "x_mtp", y_out: str = "y_mtp") -> DataFrame:
    """M1: ``max(1, int(n * ratio))`` eligible positions -> MASK; labels are the
    original ids there and IGNORE elsewhere (n <= 1: unchanged, all IGNORE)."""
    df0 = df
    df = _stage(df, ids, key, max_special_id, seed, "mtp")
    ne = F.size("_e")
    nmask = F.greatest(F.lit(1), F.floor(ne * F.lit(ratio)).cast("int"))
    df = df.withColumn("_chosen", F.when(ne > 1, F.slice("_perm_mtp", 1, nmask))
                       .otherwise(F.array().cast("array<int>")))
    a, ch = F.col(ids), F.col("_chosen")
    x = F.when(F.size(ch) > 0, F.transform(a, lambda v, i: F.when(F.array_contains(ch, i), F.lit(MASK))
                                           .otherwise(v))).otherwise(a)
    y = F.transform(a, lambda v, i: F.when((F.size(ch) > 0) & F.array_contains(ch, i), v)
                    .otherwise(F.lit(IGNORE)))
    return df.withColumn(x_out, x).withColumn(y_out, y).drop(*_tmp(df0, "_perm_mtp", "_chosen"))


def add_tpp(df: DataFrame, ids: str, key: str, max_special_id: int, seed=42,
            x_out: str = "x_tpp", y_out: str = "y_tpp") -> DataFrame:
    """M2: eligible values permuted; labels = original id at every non-pad position."""
    df0 = df
    df = _stage(df, ids, key, max_special_id, seed, "tpp")
    df = df.withColumn("_nv", _new_values(ids, "_perm_tpp"))
    y = F.transform(ids, lambda v: F.when(v == PAD, F.lit(IGNORE)).otherwise(v))
    return df.withColumn(x_out, _apply(ids, "_nv", max_special_id)).withColumn(y_out, y).drop(*_tmp(df0, "_perm_tpp", "_nv"))


def add_tov(df: DataFrame, ids: str, key: str, max_special_id: int, L: int, seed=42,
            p: float = SHUFFLE_PROB, x_out: str = "x_tov", y_out: str = "y_tov") -> DataFrame:
    """M3: with >1 eligible positions, label 1 with probability ``p`` and the
    eligible values shuffled. Then keep eligible + TLD ids in order; if the input
    had TRUNC or more than L-3 remain -> [TRUNC] + last L-3; wrap in CLS ... SEP
    and pad to L."""
    df0 = df
    df = _stage(df, ids, key, max_special_id, seed, "tov")
    a, k = F.col(ids), F.col(key)
    coin = F.conv(F.substring(_key(seed, "tov", k), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    df = df.withColumn(y_out, ((F.size("_e") > 1) & (coin < F.lit(p))).cast("int"))
    df = df.withColumn("_nv", F.when(F.col(y_out) == 1, _new_values(ids, "_perm_tov"))
                       .otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_pure", F.filter(_apply(ids, "_nv", max_special_id), lambda v: (v == UNK) | (v >= SPARSE_TLD)))
    pure = F.col("_pure")
    keep = max(0, L - 3)
    tail = (F.slice(pure, F.greatest(F.size(pure) - keep + 1, F.lit(1)), keep) if keep > 0
            else F.array().cast("array<int>"))
    pure = F.when(F.array_contains(a, TRUNC) | (F.size(pure) > L - 3),
                  F.concat(F.array(F.lit(TRUNC)), tail)).otherwise(pure)
    df = df.withColumn("_body", F.concat(F.array(F.lit(CLS)), pure, F.array(F.lit(SEP))))
    body = F.col("_body")
    x = F.concat(body, F.array_repeat(F.lit(PAD), F.greatest(F.lit(L) - F.size(body), F.lit(0))))
    return df.withColumn(x_out, x).drop(*_tmp(df0, "_perm_tov", "_nv", "_pure", "_body"))


def pretrain_samples(df: DataFrame, ids: str, key: str, max_special_id: int, L: int,
                     seed=42) -> DataFrame:
    """M4: the six sample columns per row (eligible positions staged once)."""
    df = df.withColumn("_e", eligible(F.col(ids), max_special_id))
    df = add_mtp(df, ids, key, max_special_id, seed)
    df = add_tpp(df, ids, key, max_special_id, seed)
    return add_tov(df, ids, key, max_special_id, L, seed).drop("_e")
