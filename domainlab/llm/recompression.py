"""Runs of repeating words by recompression.

The words of a batch of texts, a unique mark after each text, are one string. Recompression
turns it into a run-length grammar: blocks of equal symbols become one symbol each, then pairs
of a left and a right symbol become one each (every symbol is left or right by a hash of its
number and the level), and so on until all symbols differ. Equal stretches are parsed alike
but for their ends, so a longest common extension climbs and descends the levels once, with
at most one step to the side on each.

A run of period q and at least 4 q words covers four points of the grid of step q with equal
words. Those points are the candidates; exact extensions from two neighbouring points on
give the run, whatever its length. Periods are taken in doubling ranges: a period that a
smaller one divides finds the smaller one's run and is dropped.

Null and empty texts have no words and no runs. Repeated rows are texts of their own; rows
with a null id are not altered by their id. An empty table gives an empty result. A text is
handled whole, so memory grows with the longest one. Only the id and text columns are read,
so other columns may have any name."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.llm import textvec as TV

#: Runs have at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
CHUNK = 1 << 20
WORDS_AT_ONCE = 1 << 17


class Level:
    """A string of symbols, the words under each, and its cut into units, the next level's
    symbols: the unit of each position, first position and end of each unit."""

    __slots__ = ("symbols", "words", "unit", "start", "stop", "blocks")

    def __init__(self, symbols: np.ndarray, words: np.ndarray):
        self.symbols, self.words, self.unit = symbols, words, None

    def cut(self, begins: np.ndarray, blocks: bool) -> None:
        self.unit = np.cumsum(begins) - 1
        self.start = np.flatnonzero(begins)
        self.stop = np.append(self.start[1:], len(begins))
        self.blocks = blocks


def _names(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense numbers of equal keys, and how many there are."""
    distinct, names = np.unique(keys, return_inverse=True)
    return names, len(distinct)


class Grammar:
    """The run-length grammar of a string whose first and last symbols occur nowhere else."""

    def __init__(self, symbols: np.ndarray):
        names, n = _names(symbols)
        level = Level(names, np.ones(len(names), np.int64))
        self.levels = [level]
        depth = 0
        while n < len(level.symbols):
            s = level.symbols
            begins = np.ones(len(s), bool)
            begins[1:] = s[1:] != s[:-1]
            if not begins.all():
                level.cut(begins, True)
                size = level.stop - level.start
                names, n = _names(s[level.start] * (int(size.max()) + 1) + size)
                level = Level(names, level.words[level.start] * size)
                self.levels.append(level)
                continue
            depth += 1
            right = (TV.mix(s.astype(TV.U64) + TV.U64(depth << 40)) & TV.U64(1)).astype(bool)
            second = np.zeros(len(s), bool)
            second[1:] = right[1:] & ~right[:-1]
            if not second.any():
                continue
            level.cut(~second, False)
            a = level.start
            paired = level.stop - a > 1
            b = np.where(paired, s[level.stop - 1] + 1, 0)
            names, n = _names(s[a] * (n + 1) + b)
            level = Level(names, np.add.reduceat(level.words, a))
            self.levels.append(level)

    def extension(self, a: np.ndarray, b: np.ndarray, way: int) -> np.ndarray:
        """How many words from a on equal those from b on, to the right (way 1) or left
        (-1); a and b differ."""
        a, b = a.copy(), b.copy()
        out = np.zeros(len(a), np.int64)
        top = np.zeros(len(a), np.int64)
        rows = np.arange(len(a))
        for depth, level in enumerate(self.levels):
            if not len(rows):
                break
            x, y = a[rows], b[rows]
            differ = level.symbols[x] != level.symbols[y]
            top[rows[differ]] = depth
            rows, x, y = rows[~differ], x[~differ], y[~differ]
            if not len(rows):
                break
            u, v = level.unit[x], level.unit[y]
            if way > 0:
                left_a, left_b = level.stop[u] - x, level.stop[v] - y
                edge = (level.start[u] == x) & (level.start[v] == y)
            else:
                left_a, left_b = x - level.start[u] + 1, y - level.start[v] + 1
                edge = (level.stop[u] - 1 == x) & (level.stop[v] - 1 == y)
            # both at the edge of a unit: climb; else finish the units, and climb if both end
            step = np.where(edge, 0, np.minimum(left_a, left_b))
            out[rows] += step * level.words[x]
            ends = edge | (left_a == left_b)
            side = np.where(edge, 0, way)
            a[rows] = np.where(ends, u + side, x + way * step)
            b[rows] = np.where(ends, v + side, y + way * step)
            top[rows[~ends]] = depth
            rows = rows[ends]
        for depth in range(int(top.max(initial=0)), 0, -1):
            rows = np.flatnonzero(top >= depth)
            level = self.levels[depth - 1]
            u, v = a[rows], b[rows]
            x, y = (level.start[u], level.start[v]) if way > 0 else (level.stop[u] - 1, level.stop[v] - 1)
            same = level.symbols[x] == level.symbols[y]
            size = np.minimum(level.stop[u] - level.start[u], level.stop[v] - level.start[v]) if level.blocks else 1
            step = np.where(same, size, 0)
            out[rows] += step * level.words[x]
            a[rows], b[rows] = x + way * step, y + way * step
        return out


def _candidates(s: np.ndarray, ends: np.ndarray, sizes: np.ndarray, periods: range
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(point, period, streak): grid points in the middle of four with equal words. Texts
    stand longest first; ends: their ends in s."""
    points, of, streaks, n = [], [], [], 0
    for p in periods:
        fit = int(np.searchsorted(-sizes, -max(LEAST_WORDS, LEAST_PERIODS * p), "right"))
        grid = s[1:ends[fit - 1]:p]
        same = grid[1:] == grid[:-1]
        k = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(k):
            streak = n + np.cumsum(np.diff(k, prepend=k[0]) > 1)
            n = int(streak[-1]) + 1
            points.append(1 + (k + 1) * p)
            of.append(np.full(len(k), p))
            streaks.append(streak)
    if not points:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(points), np.concatenate(of), np.concatenate(streaks)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, end, period) of every run of texts given one after the other as word
    numbers, longest text first; runs count words over all texts."""
    nothing = (np.zeros(0, np.int64),) * 3
    sizes = sizes[sizes >= LEAST_WORDS]
    if not len(sizes):
        return nothing
    words = words[:int(sizes.sum())]
    marks = np.cumsum(sizes)
    most = int(words.max()) + 1
    # a unique mark in front and after each text
    s = np.insert(words, np.append(0, marks), most + np.arange(len(sizes) + 1))
    ends = marks + 1 + np.arange(len(sizes))
    grammar = None
    known = np.zeros(0, np.int64)
    cover_end, cover_period = np.zeros(len(s), np.int64), np.ones(len(s), np.int64)
    found = []
    low = 1
    while low * LEAST_PERIODS <= sizes[0]:
        x, p, streak = _candidates(s, ends, sizes, range(low, min(2 * low, int(sizes[0]) // LEAST_PERIODS + 1)))
        low *= 2
        # a period that divides p already explains these
        open_ = (cover_end[x] < x + p) | (p % cover_period[x] != 0)
        x, p, streak = x[open_], p[open_], streak[open_]
        if not len(x):
            continue
        grammar = grammar or Grammar(s)
        each, here = 1, []
        while len(x):
            # the first few of every streak; those that their extensions reach are done
            head = np.flatnonzero(np.diff(streak, prepend=-1))
            group = np.cumsum(np.diff(streak, prepend=-1) != 0) - 1
            asked = np.arange(len(x)) - head[group] < each
            qx, qp = x[asked], p[asked]
            end = qx + qp + grammar.extension(qx, qx + qp, 1)
            begin = qx - grammar.extension(qx - 1, qx + qp - 1, -1)
            is_run = end - begin >= np.maximum(LEAST_WORDS, LEAST_PERIODS * qp)
            here.append((begin[is_run], end[is_run], qp[is_run]))
            reach = np.zeros(len(head), np.int64)
            np.maximum.at(reach, group[asked], end)
            rest = ~asked & (x + p > reach[group])
            x, p, streak = x[rest], p[rest], streak[rest]
            each *= 2
        b, e, q = (np.concatenate(c) for c in zip(*here))
        place = b * (len(s) + 1) + e
        _, one = np.unique(place, return_index=True)
        one = one[~np.isin(place[one], known)]
        b, e, q = b[one], e[one], q[one]
        known = np.concatenate([known, place[one]])
        found.append((b, e, q))
        for k in np.argsort(e - b, kind="stable").tolist():
            cover_end[b[k]:e[k]], cover_period[b[k]:e[k]] = e[k], q[k]
    if not found:
        return nothing
    b, e, q = (np.concatenate(c) for c in zip(*found))
    shift = np.searchsorted(ends, b, "right") + 1
    order = np.lexsort((q, b))
    return (b - shift)[order], (e - shift)[order], q[order]


def altered(doc_id: int | None, n: int) -> tuple[int, int]:
    """From which word on, and with which period, an id has its text of n words repeat."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is None or h % 10 or not n:
        return n, 1
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def describe(c: TV.Chunk, ids: list[int | None]) -> list[tuple]:
    """Of every text: n_runs, start, length, period, exponent_milli, and two digests."""
    ws, we, doc = c.words()
    sizes = np.bincount(doc, minlength=c.n)
    first = np.cumsum(sizes) - sizes
    # the word that stands at each place, after the change by id
    source = np.arange(len(ws))
    for k in np.flatnonzero(sizes).tolist():
        n = int(sizes[k])
        a, p = altered(ids[k], n)
        if a < n:
            source[first[k] + a:first[k] + n] = first[k] + a + np.arange(n - a) % p
    order = np.argsort(-sizes, kind="stable")
    place = np.concatenate([np.arange(first[k], first[k] + sizes[k]) for k in order]) if len(ws) else source
    numbers = c.distinct(ws, we)[1][source]
    b, e, q = find_runs(numbers[place], sizes[order])
    e = place[e - 1] + 1 if len(b) else e
    b = place[b] if len(b) else b
    of = doc[b] if len(b) else b
    drop = np.zeros(len(ws) + 1, np.int64)
    np.add.at(drop, b + q, 1)
    np.add.at(drop, e, -1)
    kept = np.flatnonzero(np.cumsum(drop[:-1]) == 0)
    hashes = [hashlib.sha256() for _ in range(c.n)]
    size = (we - ws)[source]
    for lo in range(0, len(kept), WORDS_AT_ONCE):
        k = kept[lo:lo + WORDS_AT_ONCE]
        n = size[k] + 1
        end = np.cumsum(n)
        step = np.arange(int(end[-1])) - np.repeat(end - n, n)
        flat = c.buf[np.maximum(np.repeat(ws[source[k]] - 1, n) + step, 0)]
        flat[end - n] = 32
        raw = memoryview(flat.tobytes())
        at = doc[k]
        cut = np.flatnonzero(np.diff(at, prepend=-1))
        for i, z in zip(cut.tolist(), np.append(cut[1:], len(k)).tolist()):
            # no space before a text's first word, which every run keeps
            lead = int(end[i] - n[i]) + (k[i] == first[at[i]])
            hashes[at[i]].update(raw[lead:int(end[z - 1])])
    rows = [(0, None, None, None, None, "")] * c.n
    cut = np.flatnonzero(np.diff(of[np.argsort(of, kind="stable")], prepend=-1)) if len(of) else []
    order = np.lexsort((q, b))
    b, e, q, of = b[order], e[order], q[order], of[order]
    for lo, hi in zip(cut, [*cut[1:], len(of)]):
        k = int(of[lo])
        lines = list(zip((b[lo:hi] - first[k]).tolist(), (e - b)[lo:hi].tolist(), q[lo:hi].tolist()))
        best = min(lines, key=lambda r: (-r[1], r[0], r[2]))
        text = "".join("%d,%d,%d\n" % r for r in lines)
        rows[k] = (hi - lo, *best, 1000 * best[1] // best[2], text)
    return [(int(r[0]), *r[1:5], hashlib.sha256(r[5].encode()).hexdigest(), h.hexdigest()) for r, h in zip(rows, hashes)]


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256,
    collapsed_sha256) per document. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for c in TV.chunks(batch.column(1), CHUNK):
                part = ids.slice(c.first, c.n)
                cols = zip(*describe(c, part.to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [part, *[pa.array(next(cols), pa.int64()) for _ in range(5)],
                     *[pa.array(next(cols), pa.string()) for _ in range(2)]], names=names)

    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names[1:6]) + ", runs_sha256 string, collapsed_sha256 string"
    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)
