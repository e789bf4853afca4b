"""Internationalised labels: bootstring decoding.

A label written ``xn--...`` stands for the native-script label it decodes to. Decoding is a
small Arrow function; a name without such a label reaches the Python worker as a NULL, and a
worker decodes each distinct label once, up to a bounded number. A label that does not decode
(a character that is no digit, an unfinished number, a code point out of range, nothing
decoded) is returned as it is."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlab.functions.util import to_col

ACE = "xn--"
# The parameters of bootstring for domain names.
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_POINT = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
#: Numbers beyond this are out of range.
MOST = 1 << 40
CACHE_LABELS = 1 << 16


def _adapt(delta: int, size: int, first: bool) -> int:
    """The next bias after a delta."""
    d = delta // DAMP if first else delta // 2
    d, k = d + d // size, 0
    while d > (BASE - T_MIN) * T_MAX // 2:
        d, k = d // (BASE - T_MIN), k + BASE
    return k + (BASE - T_MIN + 1) * d // (d + SKEW)


def _decode(label: str) -> str:
    if not (label.startswith(ACE) and label.isascii()):
        return label
    plain, _, rest = label[len(ACE):].rpartition("-")
    if not rest:
        return label
    points = [ord(c) for c in plain]
    i, n, bias, w, k, start = 0, FIRST_POINT, FIRST_BIAS, 1, BASE, 0
    for c in rest:
        d, t = DIGITS.find(c), min(max(k - bias, T_MIN), T_MAX)
        at = i + d * w
        if d < 0:
            return label
        if d < t:
            size = len(points) + 1
            bias = _adapt(at - start, size, start == 0)
            n, i = n + at // size, at % size
            if n > 0x10FFFF or 0xD800 <= n <= 0xDFFF:
                return label
            points.insert(i, n)
            w, k, i = 1, BASE, i + 1
            start = i
        else:
            if at >= MOST or w >= MOST:
                return label
            i, w, k = at, w * (BASE - t), k + BASE
    return "".join(map(chr, points)) if k == BASE else label


_known = lru_cache(CACHE_LABELS)(_decode)


def _native(name: str) -> str:
    return ".".join(_known(x) if len(x) < 64 else _decode(x) for x in name.split("."))


@F.arrow_udf(T.StringType())
def _label_udf(labels: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _decode(x) for x in labels.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _name_udf(names: pa.Array) -> pa.Array:
    return pa.array([None if x is None else _native(x) for x in names.to_pylist()], pa.string())


def decode_label(label) -> Column:
    """The native form of a lower-case ``xn--`` label; other labels as they are."""
    return _label_udf(to_col(label))


def native_name(name) -> Column:
    """A lower-case name with each of its labels in native form."""
    c = to_col(name)
    some = c.contains(ACE)
    return F.when(some, _name_udf(F.when(some, c))).otherwise(c)


def native_labels(labels) -> Column:
    """Lower-case labels of a name, each in its native form."""
    return F.split(native_name(F.array_join(to_col(labels), ".")), r"\.", -1)
