"""Exact top-k inner-product search by ball trees.

Vectors are turned to whole numbers, floor(scale * x) with x as double, so that scores are
exact. They are dealt into shards by a hash; each shard's ball tree (centre and radius per
node) is built once and written, in chunks, to the shared folder. A query takes the nodes of a
shard in the order of the upper bound of their inner products, q.c + |q| r, and stops when the
best bound left is below the k-th best score so far. That score is shared: shards are searched
in waves of 1, 1, 2, 4, 8, ... shards, and after each wave the k-th score that a query has
reached over all of them is where it starts in the next.

Queries meet the shards in large blocks. A task is given the chunks of its tree and then the
queries of the block in batches, so it holds one tree and one batch however many queries there
are, and a tree is copied once per block. No pair of rows becomes a Spark row unless it is
among a shard's best k.

Null vectors and vectors with null, NaN or infinite components take no part, nor do rows
with a null id. Empty vectors score 0. Vectors of other lengths than the query's are no
candidates. Rows with the query's own id are no candidates; repeated rows each count as
candidates and are one query; an id with several vectors is several queries. An empty table gives an
empty result. Only the id and vector columns are read."""

from __future__ import annotations

import heapq
import io
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from domainlab.session import scratch_path

SCALE = 1024
K = 10
#: Vectors in a shard and queries in a block, on average.
SHARD_ROWS = 8192
BLOCK_ROWS = 65_536
LEAF_ROWS = 64
CHUNK_BYTES = 1 << 20
_OUT = "query_id long, query_key long, vec_id long, score long"


class BallTree:
    """centre, radius, children (-1: a leaf) and row range of every node, root first."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        centre, radius, self.left, self.right, self.rows = [], [], [], [], []
        todo = [(0, len(x), -1, False)]
        f = x.astype(np.float64)
        while todo:
            lo, hi, parent, is_right = todo.pop()
            own = f[self.order[lo:hi]]
            c = own.mean(axis=0)
            gap = ((own - c) ** 2).sum(axis=1)
            r = float(np.sqrt(gap.max()))
            node = len(centre)
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = node
            centre.append(c)
            radius.append(r)
            self.left.append(-1)
            self.right.append(-1)
            self.rows.append((lo, hi))
            if hi - lo > leaf and r > 0:
                # along the line from one far point to the point farthest from it
                a = own[gap.argmax()]
                b = own[((own - a) ** 2).sum(axis=1).argmax()]
                self.order[lo:hi] = self.order[lo:hi][np.argsort(own @ (b - a), kind="stable")]
                mid = (lo + hi) // 2
                todo += [(lo, mid, node, False), (mid, hi, node, True)]
        self.centre, self.radius = np.array(centre), np.array(radius)
        self.length = np.sqrt((self.centre ** 2).sum(axis=1))
        self.x = x[self.order]
        self.visited = 0   # leaves that searches have scored

    def to_bytes(self, ids: np.ndarray) -> bytes:
        """The tree and the ids of its rows; ids in the order the tree was given its rows."""
        out = io.BytesIO()
        np.savez(out, ids=ids[self.order], x=self.x, centre=self.centre, radius=self.radius,
                 left=self.left, right=self.right, rows=self.rows)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> tuple["BallTree", np.ndarray]:
        """The tree and the ids in tree order."""
        with np.load(io.BytesIO(data)) as z:
            tree = cls.__new__(cls)
            tree.x, tree.centre, tree.radius = z["x"], z["centre"], z["radius"]
            tree.left, tree.right, tree.rows = z["left"].tolist(), z["right"].tolist(), z["rows"].tolist()
            ids = z["ids"]
        tree.order = np.arange(len(ids))
        tree.length = np.sqrt((tree.centre ** 2).sum(axis=1))
        tree.visited = 0
        return tree, ids

    def search(self, q: np.ndarray, ids: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The best k (score, id) with scores of at least ``floor``; ids in tree order."""
        qf = q.astype(np.float64)
        size = float(np.sqrt(qf @ qf))
        # room for rounding: a bound must not fall below a score it bounds
        bound = self.centre @ qf + size * self.radius
        bound += 1e-9 * size * (self.length + self.radius) + 1e-6
        best_s, best_i = np.zeros(0, self.x.dtype), np.zeros(0, np.int64)
        least = -np.inf if floor is None else floor
        heap = [(-bound[0], 0)]
        while heap:
            b, node = heapq.heappop(heap)
            if -b < least:
                break
            if self.left[node] >= 0:
                for child in (self.left[node], self.right[node]):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
                continue
            lo, hi = self.rows[node]
            self.visited += 1
            s = self.x[lo:hi] @ q
            keep = (s >= least) & (ids[lo:hi] != own)
            if not keep.any():
                continue
            best_s = np.concatenate([best_s, s[keep]])
            best_i = np.concatenate([best_i, ids[lo:hi][keep]])
            top = np.lexsort((best_i, -best_s))[:k]
            best_s, best_i = best_s[top], best_i[top]
            if len(top) == k:
                least = max(least, best_s[-1])
        return [(int(s), int(i)) for s, i in zip(best_s, best_i)]


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.int64())
    return flat.to_numpy(zero_copy_only=False).reshape(rows, -1)


def _build(key: tuple, vectors: pa.Table) -> pa.Table:
    """The shard's tree in chunks, numbered up to -1: before the queries."""
    x, ids = _matrix(vectors["v"], vectors.num_rows), vectors["vec_id"].to_numpy()
    times = vectors["copies"].to_numpy()
    x, ids = np.repeat(x, times, axis=0), np.repeat(ids, times)
    # an order that does not depend on how the rows came
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    data = BallTree(x).to_bytes(ids)
    chunks = [data[i:i + CHUNK_BYTES] for i in range(0, len(data), CHUNK_BYTES)]
    dim, shard = (k.as_py() for k in key)
    return pa.table({"dim": pa.array([dim] * len(chunks), pa.int32()), "shard": pa.array([shard] * len(chunks), pa.int32()),
                     "part": pa.array(range(-len(chunks), 0), pa.int64()), "chunk": pa.array(chunks, pa.binary())})


def _runs(batch: pa.RecordBatch) -> list[tuple[int, int]]:
    """Ranges of rows of the same task and kind: a tree's chunks or queries."""
    task = np.stack([batch[c].to_numpy() for c in ("dim", "shard", "block")]
                    + [(batch["part"].to_numpy() < 0).astype(np.int64)])
    cut = np.flatnonzero((task[:, 1:] != task[:, :-1]).any(axis=0)) + 1
    return list(zip([0, *cut], [*cut, batch.num_rows]))


def _search(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by task; within a task the tree's chunks, numbered below zero, come before
    the queries."""
    owner, chunks, tree, exact = None, [], None, None
    for batch in batches:
        out = []
        for lo, hi in _runs(batch) if batch.num_rows else []:
            rows = batch.slice(lo, hi - lo)
            task = tuple(rows[c][0].as_py() for c in ("dim", "shard", "block"))
            if task != owner:
                owner, chunks, tree = task, [], None
            if rows["part"][0].as_py() < 0:
                chunks += rows["chunk"].to_pylist()
                continue
            if tree is None and chunks:
                tree, ids = BallTree.from_bytes(b"".join(chunks))
                exact, chunks = tree.x, []
                top, real = max(float(np.abs(exact).max(initial=0)), 1.0), exact.astype(np.float64)
            if tree is None:
                continue   # no vectors of this length in the shard
            q = _matrix(pa.chunked_array([rows["v"]]), rows.num_rows)
            most = top * max(float(np.abs(q).max(initial=0)), 1.0)
            # doubles are exact up to 2**53 and use the fast matrix product
            tree.x = real if most * max(1, q.shape[1]) < 2 ** 53 else exact
            for i, key, floor, row in zip(rows["query_id"].to_pylist(), rows["query_key"].to_pylist(),
                                          rows["floor"].to_pylist(), q.astype(tree.x.dtype)):
                out += [(i, key, j, s) for s, j in tree.search(row, ids, i, k, floor)]
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                         names=["query_id", "query_key", "vec_id", "score"])


def whole_numbers(df: DataFrame, id_col: str, vec_col: str, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>, dim) of the rows that take part."""
    d = F.transform(vec_col, lambda x: x.cast("double"))
    ok = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x.cast("double"))
                  & (F.abs(x.cast("double")) != F.lit(float("inf"))))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & F.coalesce(ok, F.lit(False)))
            .select(F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(d, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")).alias("v"))
            .withColumn("dim", F.size("v")))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: int = SCALE, shard_rows: int = SHARD_ROWS,
          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k candidates of the highest inner product with
    each query, ties to the smaller id."""
    spark = vectors.sparkSession
    v = whole_numbers(vectors, id_col, vec_col, scale)
    q = (whole_numbers(queries, id_col, vec_col, scale).dropDuplicates(["vec_id", "v"])
         .select(F.col("vec_id").alias("query_id"), F.xxhash64("v").alias("query_key"), "v", "dim"))
    # rows that are equal in everything are one row and its copies, of which at most k can be
    # among the best k; so no shard grows by repeated rows
    v = v.groupBy("vec_id", "v", "dim").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("copies"))
    path = scratch_path(spark, "topk-vectors")
    v.write.parquet(path)
    v = spark.read.parquet(path)
    shards = max(1, -(-v.count() // shard_rows))
    n_blocks = max(1, -(-q.count() // block_rows))
    v = v.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int"))
    q = q.withColumn("block", F.pmod(F.xxhash64("query_id", "query_key"), F.lit(n_blocks)).cast("int"))
    trees_at = scratch_path(spark, "topk-trees")
    v.groupBy("dim", "shard").applyInArrow(_build, "dim int, shard int, part long, chunk binary").write.parquet(trees_at)
    trees = spark.read.parquet(trees_at)

    def search(asked: DataFrame, first: int, last: int) -> DataFrame:
        keys = ["dim", "shard", "block"]
        a = (trees.where(F.col("shard").between(first, last))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))))
        b = (asked.withColumn("shard", F.explode(F.sequence(F.lit(first), F.lit(last))))
             .withColumn("part", F.lit(0).cast("long")))
        rows = a.unionByName(b, allowMissingColumns=True)
        tasks = (last - first + 1) * n_blocks
        return rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "part").mapInArrow(partial(_search, k), _OUT)

    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    found, first, width = None, 0, 1
    while first < shards:
        last = min(first + width, shards) - 1
        asked = q.withColumn("floor", F.lit(None).cast("long"))
        if found is not None:
            floors = (found.groupBy("query_id", "query_key")
                      .agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")))
            asked = q.join(floors, ["query_id", "query_key"], "left")
        wave = search(asked, first, last)
        found = wave if found is None else found.unionByName(wave)
        path = scratch_path(spark, "topk")
        found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank").write.parquet(path)
        found = spark.read.parquet(path)
        first, width = last + 1, max(1, last + 1)
    return found.select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score")
