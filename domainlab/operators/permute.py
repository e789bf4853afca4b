"""Epoch orders without a sort (O4): a keyed permutation of row numbers.

Rows are numbered 0..n-1 once (:func:`number_rows`) and written. An epoch is then a narrow
pass: each row computes its own place from its number by a keyed permutation of ``[0, n)``
and from the place its batch. The permutation is a Feistel network over pairs ``(l, r)``
with ``number = l * b + r``, where ``a = ceil(sqrt(n))`` and ``b = ceil(n / a)``; rounds add
a keyed value of one half to the other, modulo ``a`` and ``b`` in turn, so each round can be
undone. The ``a * b - n < a`` numbers beyond the rows are stepped over (cycle walking): a
place of ``n`` or more is permuted again until it is below ``n``. How often that can happen
is found exactly beforehand, by following those few numbers (fewer than the root of n).

The round value is a square modulo the prime 2^31 - 1, then a linear map: integer arithmetic
inside code generation. Good enough to mix a training set; no cipher. Nulls in the keys are
values of their own; rows equal in all keys get numbers next to one another in no fixed
order. No rows: nothing to number."""

from __future__ import annotations

import hashlib
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from domainlab.session import checkpoint_dir

PRIME = 2 ** 31 - 1
ROUNDS = 6
MAX_ROWS = 2 ** 60   # a and b stay below PRIME
DIGITS = 3


def row_hash(keys: list[str]) -> Column:
    return F.md5(F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys]))


def number_rows(df: DataFrame, keys: list[str], out: str = "row_no", digits: int = DIGITS,
                written: bool = False) -> DataFrame:
    """Add ``out`` = 0..n-1 in the order of (md5 of ``keys``, ``keys``). Rows are counted by
    the first ``digits`` hex digits of the hash; running sums over these at most
    ``16 ** digits`` counts give each block its first number, and a block is sorted by
    itself: one hash exchange, no range exchange. ``written``: ``df`` is a scan of a written
    table; anything else is checkpointed first, as counting and numbering both read it."""
    taken = set(df.columns)

    def unused(name: str) -> str:
        while name in taken:
            name += "_"
        taken.add(name)
        return name
    h, p, first = (unused(x) for x in ("_h", "_p", "_first"))
    d = df
    if not written:
        checkpoint_dir(df.sparkSession)
        d = d.checkpoint(eager=True)
    d = d.withColumn(h, row_hash(keys)).withColumn(p, F.substring(h, 1, digits))
    before = Window.orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    starts = d.groupBy(p).agg(F.count(F.lit(1)).alias("_n")).select(
        p, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(first))
    here = F.row_number().over(Window.partitionBy(p).orderBy(h, *keys))
    ranked = d.withColumn(out, here.cast("long"))
    # at most 16 ** digits rows of two columns
    return ranked.join(F.broadcast(starts), p).select(
        *df.columns, (F.col(out) - 1 + F.col(first)).alias(out))


def halves(n: int) -> tuple[int, int]:
    """``(a, b)``: the ranges of the two halves of a number below ``n``."""
    if not 0 <= n <= MAX_ROWS:
        raise ValueError(f"cannot permute {n} rows")
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, max(-(-n // a), 1)


def round_keys(seed: int | str, epoch: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three keys for each round, the second never 0."""
    def key(i: int, j: int, least: int) -> int:
        word = hashlib.md5(f"{seed}:{epoch}:{i}:{j}".encode()).hexdigest()[:12]
        return least + int(word, 16) % (PRIME - least)
    return [(key(i, 0, 0), key(i, 1, 1), key(i, 2, 0)) for i in range(rounds)]


def _shift(half, key):
    return (half + key) % PRIME


def _mixed(t, mul, add):
    return (t * t % PRIME * mul + add) % PRIME


def permute_numbers(x: np.ndarray, n: int, keys: list[tuple[int, int, int]]) -> np.ndarray:
    """One pass of the network over numbers below ``a * b``, not yet walked."""
    a, b = halves(n)
    l, r = x // b, x % b
    for i, (k, mul, add) in enumerate(keys):
        if i % 2 == 0:
            l = (l + _mixed(_shift(r, k), mul, add)) % a
        else:
            r = (r + _mixed(_shift(l, k), mul, add)) % b
    return l * b + r


def walk_length(n: int, keys: list[tuple[int, int, int]]) -> int:
    """The most further passes that any row's number needs."""
    a, b = halves(n)
    beyond = np.arange(n, a * b, dtype=np.int64)
    to = permute_numbers(beyond, n, keys)
    at = np.setdiff1d(beyond, to)   # reached from a row's number; the others follow these or are on rings of their own
    steps = 0
    while len(at):
        at = permute_numbers(at, n, keys)
        at = at[at >= n]
        steps += 1
    return steps


def permuted(df: DataFrame, number: str, n: int, seed: int | str, epoch: int, out: str = "place",
             rounds: int = ROUNDS) -> DataFrame:
    """Add ``out``: the place in ``[0, n)`` of the row numbered ``number``, for this epoch.
    A narrow step; a NULL number has no place."""
    a, b = halves(n)
    keys = round_keys(seed, epoch, rounds)
    l, r, t, x = (f"_{c}_{out}" for c in "lrtx")
    d = df.withColumn(out, F.col(number).cast("long"))
    for again in range(walk_length(n, keys) + 1):
        d = d.withColumns({l: F.expr(f"`{out}` div {b}L"), r: F.col(out) % F.lit(b)})
        for i, (k, mul, add) in enumerate(keys):
            one, other, size = (l, r, a) if i % 2 == 0 else (r, l, b)
            d = d.withColumn(t, _shift(F.col(other), F.lit(k)))
            d = d.withColumn(one, (F.col(one) + _mixed(F.col(t), F.lit(mul), F.lit(add))) % F.lit(size))
        got = F.col(l) * F.lit(b) + F.col(r)
        d = d.withColumn(x, got if not again else F.when(F.col(out) >= n, got).otherwise(F.col(out)))
        d = d.withColumn(out, F.col(x))
    return d.drop(l, r, t, x)


def epoch_batches(df: DataFrame, number: str, n: int, seed: int | str, epoch: int, batch_size: int = 128,
                  out: str = "batch_id") -> DataFrame:
    """O4 + W4: the numbered rows with ``epoch`` and the batch of this epoch's order."""
    d = permuted(df, number, n, seed, epoch, "_place")
    return d.withColumns({"epoch": F.lit(epoch), out: F.expr(f"_place div {batch_size}L")}).drop("_place")
