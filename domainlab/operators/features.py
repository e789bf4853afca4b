"""Vector pooling and fusion.

Pooling over rows of a group uses ``Summarizer`` (one mergeable JVM aggregate per
group: map-side partial max/mean, no explode of rows x dims). Pooling over the
positions of one row (token vectors of a domain) is a narrow Arrow-batched step over
the bounded token-vector matrix, so no shuffle of rows x L vectors happens."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Context, Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlab.functions.util import to_col

MAX_TOKEN_VECTORS = 200_000
POOL_ROWS = 256
_WIDE = Context(prec=400)   # digits of the largest double before its point, and some after it


def pool_rows(df: DataFrame, key: str, vec: str, out: str = "pooled") -> DataFrame:
    """A14 over rows: per ``key``, element-wise max ‖ element-wise mean."""
    v = df.select(key, array_to_vector(F.col(vec).cast("array<double>")).alias("_v"))
    s = v.groupBy(key).agg(Summarizer.metrics("max", "mean").summary(F.col("_v")).alias("_s"))
    return s.select(key, F.concat(vector_to_array(F.col("_s.max")),
                                  vector_to_array(F.col("_s.mean"))).alias(out))


def first_vector(df: DataFrame, key: str, vec: str, order: str, out: str = "cls") -> DataFrame:
    """A15 over rows: the vector of the first row (smallest ``order``) per key."""
    return df.groupBy(key).agg(F.min_by(F.col(vec).cast("array<double>"), F.col(order)).alias(out))


def fuse(*cols) -> Column:
    """Concatenation of feature arrays (subword ‖ char ‖ external)."""
    return F.concat(*[to_col(c) for c in cols])


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A list array's values end to end, and each row's number of them (-1: NULL row)."""
    if not isinstance(lists, pa.Array):
        lists = lists.combine_chunks()
    size = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().fill_null(-1)   # flatten() leaves NULL rows out
    return flat.to_numpy(zero_copy_only=False).astype(np.int64), size


def pool_flat(flat: np.ndarray, size: np.ndarray, matrix: np.ndarray, mode: str) -> pa.Array:
    """Pools rows of indexes into ``matrix``, ``POOL_ROWS`` rows at a time; NULL where a row
    has no position (``size`` below 1). Positions of a zero vector (most of a padded row) add
    nothing to a sum: they are counted, and in a maximum stand for one zero."""
    dim = matrix.shape[1] * (1 if mode == "cls" else 2)
    some = np.flatnonzero(size > 0)
    n = size[some]
    start = np.cumsum(n) - n
    out = np.empty((len(some), dim))
    if mode == "cls":
        out[:] = matrix[flat[start]]
    else:
        zero = ~matrix.any(axis=1)
        shown = ~zero[flat]
        upto = np.concatenate([[0], np.cumsum(shown)])
        first, m = upto[start], upto[start + n] - upto[start]
        flat, with_zero = flat[shown], m < n
        out[m == 0] = 0.0
        rows = np.flatnonzero(m > 0)
        for k in range(0, len(rows), POOL_ROWS):
            r = rows[k:k + POOL_ROWS]
            s = first[r] - first[r[0]]
            v = matrix[flat[first[r[0]]:first[r[-1]] + m[r[-1]]]]
            top = np.maximum.reduceat(v, s)
            top = np.where(with_zero[r, None], np.maximum(top, 0.0), top)
            out[r] = np.hstack([top, np.add.reduceat(v, s) / n[r, None]])
    ends = np.concatenate([[0], np.cumsum(np.where(size > 0, dim, 0))]).astype(np.int32)
    null = pa.array(size < 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()), mask=null)


def pool_positions(df: DataFrame, ids: str, table: dict[int, list[float]], dim: int, out: str,
                   mode: str = "pool", mask_pads: bool = False, mask: str | None = None) -> DataFrame:
    """D3/A14/A15 over positions: look up each id's vector (unknown -> zeros) and
    add ``out`` = max ‖ mean (``pool``; pads included unless ``mask_pads``) or the
    first position's vector (``cls``); NULL where there is no position. ``mask``: a column of
    0 and 1 by position; only positions of 1 are read. The vectors go
    to each worker once, as one matrix indexed by id, and ``POOL_ROWS`` rows are
    pooled at a time, so a worker's memory does not depend on the batch size."""
    if len(table) > MAX_TOKEN_VECTORS:
        raise ValueError("token-vector table too large to ship as a lookup")
    matrix = np.zeros((max(table, default=-1) + 2, dim))
    for i, v in table.items():
        matrix[i] = v
    shared = df.sparkSession.sparkContext.broadcast(matrix)

    @F.arrow_udf("array<double>")
    def pooled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        unknown = len(m) - 1
        for b in batches:
            flat, size = flat_lists(b)
            if mask_pads:
                keep = flat != 0
                row = np.repeat(np.arange(len(size)), np.maximum(size, 0))
                flat, size = flat[keep], np.where(size < 0, -1, np.bincount(row[keep], minlength=len(size)))
            yield pool_flat(np.where((flat >= 0) & (flat < unknown), flat, unknown), size, m, mode)
    seen = F.col(ids)
    if mask is not None:
        seen = F.filter(seen, lambda x, i: F.get(F.col(mask), i) == 1)
    return df.withColumn(out, pooled(seen))


def _half_up(x: float, digits: int) -> str:
    """As Java writes it: the shortest text of the number, rounded half up."""
    return f"{Decimal(repr(x)).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP, _WIDE):f}"


def _text(values: list[float], odd: list[bool], digits: int) -> list[str]:
    return [_half_up(x, digits) if o else f"{x:.{digits}f}" for x, o in zip(values, odd)]


def vec_text_flat(flat: np.ndarray, size: np.ndarray, digits: int = 6) -> pa.Array:
    """:func:`vec_text` of rows of numbers without NULLs that lie end to end; NULL where ``size``
    is -1. Numbers near the middle between two texts are rounded one by one, since a C library and
    Java round them differently."""
    finite = np.isfinite(flat)
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.abs(np.where(finite, flat, 0.0)) * 10.0 ** digits
        odd = finite & ~(np.abs(near - np.floor(near) - 0.5) > 1e-6 + near * 1e-14)
    plain = finite & ~odd
    out, ends = [], np.cumsum(np.maximum(size, 0))
    shapes: dict[int, str] = {}
    easy = np.concatenate([[0], np.cumsum(plain)])
    for e, n in zip(ends.tolist(), size.tolist()):
        if n < 0:
            out.append(None)
            continue
        part = flat[e - n:e].tolist()
        if easy[e] - easy[e - n] == n:
            out.append(shapes.setdefault(n, " ".join([f"%.{digits}f"] * n)) % tuple(part))
        else:
            words = _text(part, odd[e - n:e].tolist(), digits)
            out.append(" ".join({"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}.get(w, w) for w in words))
    return pa.array(out, pa.string())


def vec_text_arrow(c, digits: int = 6) -> Column:
    """:func:`vec_text` in an Arrow step, for many numbers of which none is NULL."""
    @F.arrow_udf("string")
    def text(x: pa.Array) -> pa.Array:
        x = x if isinstance(x, pa.Array) else x.combine_chunks()
        size = x.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        return vec_text_flat(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64), size, digits)
    return text(to_col(c))


def vec_text(c, digits: int = 6) -> Column:
    """Fixed-precision text form of a double array (stable across engines)."""
    return F.array_join(F.transform(to_col(c), lambda x: F.format_string(f"%.{digits}f", x)), " ")
