"""Approximate nearest neighbours by inner product, with balanced posting lists.

Vectors gain one coordinate that brings them all to the length of the longest, and queries are
brought to that length, so that the largest inner product is the smallest distance. Centres
come from halving a sample again and again into equal parts along its widest direction; their
number grows with the table, up to MAX_LISTS. Each vector goes to its nearest centre's list
and, where it lies near a boundary, to further ones: those not much farther than the nearest,
unless a centre already taken is nearer to that centre than the vector is. Centres are found
through a graph in memory (near neighbours, thinned where one is reached over another, and a
chain through all of them). A query searches the lists found whose distance is within a ratio
of the nearest one's, and scores their vectors in double precision.

Equal vectors are one entry of a list that holds the k + 1 smallest ids, since no others can be
among the k nearest. Lists lie in shards of bounded size, lists that are too long in several;
shards that many queries search are searched in several blocks of queries. The lists are
written to the shared folder.

Null vectors, zero vectors and vectors with null, NaN or infinite components take no part, nor
do rows with a null id. Vectors of each length are an index of their own: vectors of other
lengths than the query's are no candidates. Rows with the query's own id are no candidates.
Repeated rows each count as candidates and are one query; an id with several vectors is
several queries. An empty table gives an empty result. Only the id and vector columns are
read, so other columns may have any name."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainlab.session import scratch_path

K = 20
#: Vectors for each centre, and the most centres (they are held in memory).
LIST_ROWS = 128
MAX_LISTS = 1 << 16
#: The centres are fitted on so many vectors at most, and so many numbers.
SAMPLE_ROWS = 1 << 17
SAMPLE_NUMBERS = 1 << 24
#: A vector goes to so many lists at most, within this ratio of the nearest centre's distance.
COPIES = 8
COPY_RATIO = 1.15
#: A query gets so many lists from the graph, and keeps those within this ratio.
PROBES = 256
PROBE_RATIO = 1.25
#: Neighbours of a centre in the graph, and those looked at to choose them.
LINKS, NEAR = 16, 48
#: List entries in a shard and queries in a block, on average.
SHARD_ROWS = 1 << 14
BLOCK_ROWS = 1 << 13
_ROWS = 512


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x to all of y."""
    d = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2.0 * (x @ y.T)
    return np.maximum(d, 0.0)


def centres(x: np.ndarray, lists: int) -> np.ndarray:
    """Means of equal parts of a sample of vectors of one length, brought to that length;
    neighbouring parts stand next to each other."""
    out = np.zeros((lists, x.shape[1]))
    todo = [(np.arange(len(x)), 0, lists)]
    while todo:
        rows, lo, hi = todo.pop()
        part = x[rows]
        if hi - lo == 1:
            out[lo] = part.mean(0)
            continue
        mid = (lo + hi) // 2
        cut = max(1, len(rows) * (mid - lo) // (hi - lo))
        # the widest direction by a few power steps, then two rounds towards the halves' means
        c = part - part.mean(0)
        way = c[np.argmax((c * c).sum(1))]
        for _ in range(5):
            way = c.T @ (c @ way)
            way = way / (np.linalg.norm(way) or 1.0)
        for _ in range(3):
            order = np.argsort(c @ way, kind="stable")
            way = c[order[cut:]].mean(0) - c[order[:cut]].mean(0)
        todo += [(rows[order[:cut]], lo, mid), (rows[order[cut:]], mid, hi)]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return np.where(size > 0, out * (np.linalg.norm(x[:1]) / np.where(size > 0, size, 1.0)), x[:1])


class CentreGraph:
    """The centres, and links between them for a search that walks to ever nearer ones."""

    def __init__(self, c: np.ndarray):
        self.c = c = c.astype(np.float32)
        self.norms = (c * c).sum(1)
        n = len(c)
        near = min(NEAR, n - 1)
        links = np.full((n, LINKS + 2), -1, np.int32)
        for lo in range(0, n, _ROWS) if near else ():
            d = _distances(c[lo:lo + _ROWS], c)
            d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
            ids = np.argpartition(d, near - 1, axis=1)[:, :near]
            own = np.take_along_axis(d, ids, 1)
            order = np.argsort(own, axis=1, kind="stable")
            ids, own = np.take_along_axis(ids, order, 1), np.take_along_axis(own, order, 1)
            taken = np.zeros(len(d), np.int64)
            for k in range(near):
                # not linked if a linked centre is nearer to it than this one is
                held = links[lo:lo + len(d), :LINKS]
                apart = ((c[held] - c[ids[:, k]][:, None, :]) ** 2).sum(2)
                ok = ~((held >= 0) & (apart < own[:, k, None])).any(1) & (taken < LINKS)
                rows = np.flatnonzero(ok)
                links[lo + rows, taken[rows]] = ids[rows, k]
                taken[rows] += 1
        # the chain makes every centre reachable
        links[1:, LINKS] = np.arange(n - 1)
        links[:-1, LINKS + 1] = np.arange(1, n)
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def search(self, q: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Centres near each query, nearest first, and their squared distances; -1 and
        infinity where there are fewer than ``most``."""
        n, width = len(q), 4
        q = q.astype(np.float32)
        norms = (q * q).sum(1)

        def far(ids):
            got = np.matmul(self.c[ids], q[:, :, None])[:, :, 0]
            return np.maximum(norms[:, None] + self.norms[ids] - 2.0 * got, 0.0)

        ids = np.tile(self.entries, (n, 1))
        d = far(ids)
        done = np.zeros(ids.shape, bool)
        while True:
            order = np.argsort(d, axis=1, kind="stable")[:, :most]
            ids, d, done = (np.take_along_axis(x, order, 1) for x in (ids, d, done))
            open_ = ~done & (ids >= 0) & np.isfinite(d)
            if not open_.any():
                break
            # the nearest centres not yet left
            turn = open_ & (np.cumsum(open_, axis=1) <= width)
            pick = np.argsort(~turn, axis=1, kind="stable")[:, :width]
            use = np.take_along_axis(turn, pick, 1)
            done |= turn
            new = self.links[np.where(use, np.take_along_axis(ids, pick, 1), 0)]
            new = np.where(use[:, :, None], new, -1).reshape(n, -1).astype(np.int64)
            dist = np.where(new >= 0, far(np.maximum(new, 0)), np.inf)
            ids = np.concatenate([ids, new], 1)
            d = np.concatenate([d, dist], 1)
            done = np.concatenate([done, np.zeros(new.shape, bool)], 1)
            # a centre met again counts once, the earlier place stays
            order = np.argsort(ids, axis=1, kind="stable")
            s = np.take_along_axis(ids, order, 1)
            again = np.zeros(s.shape, bool)
            again[:, 1:] = s[:, 1:] == s[:, :-1]
            mask = np.zeros(s.shape, bool)
            np.put_along_axis(mask, order, again, 1)
            d = np.where(mask, np.inf, d)
            ids = np.where(mask, -1, ids)
        return np.where(np.isfinite(d), ids, -1), d

    def copies(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centre) of every list that a vector goes to."""
        ids, d = self.search(x, 2 * COPIES)
        keep = np.zeros((len(x), ids.shape[1]), bool)
        keep[:, 0] = True
        taken = np.ones(len(x), np.int64)
        for k in range(1, ids.shape[1]):
            ok = (ids[:, k] >= 0) & (d[:, k] <= COPY_RATIO ** 2 * d[:, 0]) & (taken < COPIES)
            if not ok.any():
                break
            rows = np.flatnonzero(ok)
            apart = ((self.c[ids[rows, :k]] - self.c[ids[rows, k]][:, None, :]) ** 2).sum(2)
            rows = rows[~(keep[rows, :k] & (apart < d[rows, k, None])).any(1)]
            keep[rows, k] = True
            taken[rows] += 1
        row, k = np.nonzero(keep)
        return row, ids[row, k]

    def probes(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, centre) of every list that a query searches."""
        ids, d = self.search(q, PROBES)
        row, k = np.nonzero((ids >= 0) & (d <= PROBE_RATIO ** 2 * d[:, :1]))
        return row, ids[row, k]


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate that brings every vector to the same length."""
    rest = np.sqrt(np.maximum(longest ** 2 - (x * x).sum(1), 0.0))
    return np.concatenate([x, rest[:, None]], 1)


def turned(q: np.ndarray, longest: float) -> np.ndarray:
    """Queries at that length; the further coordinate is 0."""
    q = q / np.abs(q).max(1, keepdims=True)
    q = q * (longest / np.sqrt((q * q).sum(1)))[:, None]
    return np.concatenate([q, np.zeros((len(q), 1))], 1)


class Deal:
    """Which tasks a list and a query's lists go to. Consecutive lists share a shard up to
    about SHARD_ROWS entries; a longer list is split into segments by the entries' keys. A
    shard that many queries search has several blocks of queries. A task is a segment and a
    block; its number is ``first`` of the shard + segment * blocks + block."""

    def __init__(self, entries: np.ndarray):
        shard = np.zeros(len(entries), np.int64)
        held = entries[0]
        for k in range(1, len(entries)):
            if held and held + entries[k] > SHARD_ROWS:
                shard[k], held = 1, entries[k]
            else:
                held += entries[k]
        self.shard = np.cumsum(shard)
        rows = np.bincount(self.shard, weights=entries)
        self.segments = np.maximum(1, -(-rows // SHARD_ROWS)).astype(np.int64)

    def block(self, queries: np.ndarray) -> None:
        """``queries``: how many search each shard."""
        self.blocks = np.maximum(1, -(-queries // BLOCK_ROWS)).astype(np.int64)
        tasks = self.segments * self.blocks
        self.first = np.cumsum(tasks) - tasks

    def entry(self, lists: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) for entries: each is in one segment and in all blocks."""
        s = self.shard[lists]
        n = self.blocks[s]
        row = np.repeat(np.arange(len(s)), n)
        block = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return row, np.repeat(self.first[s] + keys % self.segments[s] * n, n) + block

    def query(self, shards: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, task) for (query, shard): each is in one block and in all segments."""
        n = self.segments[shards]
        row = np.repeat(np.arange(len(shards)), n)
        segment = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        blocks = self.blocks[shards]
        return row, np.repeat(self.first[shards] + keys % blocks, n) + segment * np.repeat(blocks, n)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _vectors(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def best_of_lists(lists: np.ndarray, keys: np.ndarray, x: np.ndarray, ids: list, q_ids: np.ndarray, q: np.ndarray,
                  q_lists: list[np.ndarray], k: int) -> list[tuple[int, int, int, int, float]]:
    """(query, key, id, repeats, score) of each query's k best rows in its lists. ids: the
    (id, repeats) of every entry, smallest id first."""
    order = np.argsort(lists, kind="stable")
    lists, keys, x = lists[order], keys[order], x[order]
    ids = [ids[i] for i in order.tolist()]
    # an entry whose rows all have one id is no candidate of that id's queries
    only = np.array([e[0]["id"] if len(e) == 1 else -1 for e in ids], np.int64)
    single = np.array([len(e) == 1 for e in ids], bool)
    of = np.concatenate(q_lists) if q_lists else np.zeros(0, np.int64)
    who = np.repeat(np.arange(len(q)), [len(e) for e in q_lists])
    by = np.argsort(of, kind="stable")
    of, who = of[by], who[by]
    size = np.abs(x).max(initial=0.0) * np.abs(q).max(initial=0.0) * x.shape[1]
    got: list[tuple[np.ndarray, np.ndarray]] = []
    # the best k-th score of any one list so far: nothing below it is needed
    floor = np.full(len(q), -np.inf)
    cut = np.flatnonzero(np.diff(of, prepend=-1))
    for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(of)]):
        a, z = np.searchsorted(lists, [of[lo], of[lo] + 1]).tolist()
        if a == z:
            continue
        rows = who[lo:hi]
        for some in np.array_split(rows, -(-len(rows) // _ROWS)):
            score = q[some] @ x[a:z].T
            own = (q_ids[some, None] == only[a:z]) & single[a:z]
            score[own] = -np.inf
            if z - a > k:
                floor[some] = np.maximum(floor[some], np.partition(score, z - a - k, axis=1)[:, z - a - k])
            # what rounding might put behind the k-th place stays
            r, c = np.nonzero(~(score < floor[some, None] - 1e-12 * size) & ~own)
            got.append((some[r], a + c))
    out = []
    if any(len(r) for r, _ in got):
        row, entry = (np.concatenate(c) for c in zip(*got))
        score = np.concatenate([(q[row[lo:lo + 4096]] * x[entry[lo:lo + 4096]]).sum(1) for lo in range(0, len(row), 4096)])
        by = np.lexsort((keys[entry], -score, row))
        row, entry, score = row[by], entry[by], score[by]
        cut = np.flatnonzero(np.diff(row, prepend=-1))
        for lo, hi in zip(cut.tolist(), [*cut[1:].tolist(), len(row)]):
            own, seen, rows = int(q_ids[row[lo]]), set(), []
            for e, s in zip(entry[lo:hi].tolist(), score[lo:hi].tolist()):
                key = int(keys[e])
                if key not in seen:
                    # copies in several lists are one
                    seen.add(key)
                    rows += [(-s, m["id"], key, m["n"]) for m in ids[e] if m["id"] != own]
                    if len(seen) >= 4 * k and len(rows) >= 4 * k:
                        rows = _first(rows, k)
            out += [(int(row[lo]), key, i, n, -s) for s, i, key, n in _first(rows, k)]
    return out


def _first(rows: list[tuple], k: int) -> list[tuple]:
    """The first rows that make k, repeats counted."""
    rows, n = sorted(rows), 0
    for j, r in enumerate(rows):
        if n >= k:
            return rows[:j]
        n += r[3]
    return rows


def _clean(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part."""
    d = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v")).where("id is not null and v is not null")
    d = d.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return d.where(F.exists("v", lambda x: x != 0))


class Index:
    """Posting lists of one length of vectors, in a folder."""

    def __init__(self, table: DataFrame, dim: int, k: int):
        """``table``: (id, v), vectors of length ``dim``."""
        spark = table.sparkSession
        self.folder, self.dim, self.k = scratch_path(spark, "postings"), dim, k
        folder = self.folder
        # equal vectors: one entry with the k + 1 smallest ids
        rank = Window.partitionBy("v").orderBy("id")
        entries = (table.groupBy("v", "id").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("n"))
                   .withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k + 1)
                   .groupBy("v").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids")))
        (entries.select(F.monotonically_increasing_id().alias("key"), F.col("v").cast("array<double>").alias("v"), "ids")
         .write.parquet(f"{folder}/entries"))
        entries = spark.read.parquet(f"{folder}/entries")
        # lengths are taken of vectors whose largest component is brought to 1
        n, scale = entries.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("v", F.abs)))).first()
        norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale))
        longest = entries.agg(F.sqrt(F.max(norm))).first()[0]
        self.longest = longest
        most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // dim))
        share = int(min(1.0, most / n) * 2**30)
        sample = (entries.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < share).select("v")
                  .orderBy(F.xxhash64("v")).limit(most).toArrow()["v"].combine_chunks())
        sample = sample if len(sample) else entries.select("v").limit(1).toArrow()["v"].combine_chunks()
        lists = max(1, min(MAX_LISTS, -(-n // LIST_ROWS), len(sample)))
        self.graph = CentreGraph(centres(lengthened(_matrix(sample, dim) / scale, longest), lists))
        graph, shared = self.graph, spark.sparkContext.broadcast(self.graph)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, _ROWS):
                    part = b.slice(lo, _ROWS)
                    row, centre = shared.value.copies(lengthened(_matrix(part.column(1), dim) / scale, longest))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(centre.astype(np.int32)), *[c.take(pa.array(row)) for c in part.columns]],
                        names=["list", *part.schema.names])

        kind = entries.schema["ids"].dataType.simpleString()
        self.kind = kind
        (entries.mapInArrow(assign, f"list int, key long, v array<double>, ids {kind}")
         .write.parquet(f"{folder}/lists"))
        self.lists = spark.read.parquet(f"{folder}/lists")
        # at most MAX_LISTS numbers
        self.sizes = np.zeros(len(graph.c), np.int64)
        for r in self.lists.groupBy("list").count().collect():
            self.sizes[r[0]] = r[1]
        self.shared = shared

    def search(self, queries: DataFrame) -> DataFrame:
        """``queries``: (id, v). (query_id, rank, vec_id, score) of each query's k nearest."""
        spark, folder, dim, k, longest, shared = (
            queries.sparkSession, scratch_path(queries.sparkSession, "searches"), self.dim, self.k, self.longest, self.shared)

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, _ROWS):
                    part = b.slice(lo, _ROWS)
                    row, centre = shared.value.probes(turned(_matrix(part.column(2), dim), longest))
                    order = np.lexsort((centre, row))
                    begin = np.searchsorted(row[order], np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [*part.columns, pa.ListArray.from_arrays(pa.array(begin), pa.array(centre[order].astype(np.int32)))],
                        names=["q", "id", "v", "lists"])

        (queries.distinct().select(F.monotonically_increasing_id().alias("q"), "id", F.col("v").cast("array<double>").alias("v"))
         .mapInArrow(probe, "q long, id long, v array<double>, lists array<int>").write.parquet(f"{folder}/queries"))
        asked = spark.read.parquet(f"{folder}/queries")
        deal = Deal(self.sizes)

        def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                hit = np.zeros(int(deal.shard[-1]) + 1, np.int64)
                for lists in b.column(0).to_pylist():
                    hit[np.unique(deal.shard[lists])] += 1
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(hit).astype(np.int32)), pa.array(hit[hit > 0])],
                                                 names=["shard", "n"])

        searches = np.zeros(int(deal.shard[-1]) + 1, np.int64)
        for r in asked.select("lists").mapInArrow(shards, "shard int, n long").groupBy("shard").agg(F.sum("n")).collect():
            searches[r[0]] = r[1]
        deal.block(searches)

        def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, _ROWS):
                    part = b.slice(lo, _ROWS)
                    lists = part.column(3).flatten().to_numpy()
                    row = np.repeat(np.arange(part.num_rows), part.column(3).value_lengths().to_numpy())
                    shard = deal.shard[lists]
                    # lists of a query ascend, so those of a shard stand together
                    head = np.flatnonzero((np.diff(row, prepend=-1) != 0) | (np.diff(shard, prepend=-1) != 0))
                    some = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(lists))
                    which, task = deal.query(shard[head], part.column(0).to_numpy()[row[head]])
                    from_ = pa.array(row[head][which])
                    n = len(which)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(task.astype(np.int32)), pa.nulls(n, pa.int32()), part.column(0).take(from_),
                         part.column(2).take(from_), pa.nulls(n, kinds), part.column(1).take(from_), some.take(pa.array(which))],
                        names=names)

        def deal_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                which, task = deal.entry(b.column(0).to_numpy(), b.column(1).to_numpy())
                which = pa.array(which)
                n = len(which)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(task.astype(np.int32)), *[b.column(j).take(which).cast(t) for j, t in
                     enumerate((pa.int32(), pa.int64(), vectors, kinds))], pa.nulls(n, pa.int64()),
                     pa.nulls(n, pa.list_(pa.int32()))], names=names)

        def best(group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            query = group["list"].is_null()
            e, q = group.filter(pa.compute.invert(query)), group.filter(query)
            rows = []
            if e.num_rows and q.num_rows:
                one = lambda t, c: t[c].combine_chunks()
                q_lists = one(q, "lists")
                ends = np.cumsum(q_lists.value_lengths().to_numpy())[:-1]
                rows = best_of_lists(one(e, "list").to_numpy(), one(e, "key").to_numpy(), _matrix(one(e, "v"), dim),
                                     one(e, "ids").to_pylist(), one(q, "id").to_numpy(), _matrix(one(q, "v"), dim),
                                     np.split(q_lists.flatten().to_numpy(), ends), k)
            numbers, q_ids = (one(q, "key").to_numpy(), one(q, "id").to_numpy()) if rows else (None, None)
            return pa.table({
                "q": pa.array([int(numbers[r[0]]) for r in rows], pa.int64()),
                "query_id": pa.array([int(q_ids[r[0]]) for r in rows], pa.int64()),
                "key": pa.array([r[1] for r in rows], pa.int64()), "vec_id": pa.array([r[2] for r in rows], pa.int64()),
                "n": pa.array([r[3] for r in rows], pa.int32()), "score": pa.array([r[4] for r in rows], pa.float64())})

        names = ["task", "list", "key", "v", "ids", "id", "lists"]
        vectors, kinds = pa.list_(pa.float64()), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int32())]))
        schema = f"task int, list int, key long, v array<double>, ids {self.kind}, id long, lists array<int>"
        work = self.lists.mapInArrow(deal_entries, schema).unionByName(asked.mapInArrow(deal_queries, schema))
        found = work.groupBy("task").applyInArrow(best, "q long, query_id long, key long, vec_id long, n int, score double")
        # an entry found in several shards is one
        found = found.groupBy("q", "query_id", "key", "vec_id").agg(F.max("n").alias("n"), F.max("score").alias("score"))
        found = found.withColumn("n", F.explode(F.sequence(F.lit(1), "n")))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "key", "n")
        return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", "rank", "vec_id", "score"))


def nearest(table: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score double): the k nearest rows of ``table``
    that the lists give for every row of ``queries``."""
    spark = table.sparkSession
    base, asked = _clean(table, id_col, vec_col), _clean(queries, id_col, vec_col)
    # the lengths of vectors that queries have, few in any table of embeddings
    dims = sorted(r[0] for r in asked.select(F.size("v")).distinct().collect())
    have = {r[0] for r in base.select(F.size("v")).distinct().collect()}
    parts = [Index(base.where(F.size("v") == d), d, k).search(asked.where(F.size("v") == d)) for d in dims if d in have]
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
