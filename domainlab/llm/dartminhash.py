"""Near-duplicate classes by DartMinHash signatures and banded joins.

A text is the weighted set of its runs of five words; the weight is the number of times a
run occurs, and similarity is weighted Jaccard (sum of minima over sum of maxima). Texts
of at least 0.8 are linked, and a class is a connected component of links.

**Signature.** Each element owns a region of width equal to its weight, and each unit of
it is a strip along the rank axis. Strips are cut into cells; a hash of (element, unit,
cell) throws a Poisson number of darts into a cell, each with a rank within the cell and a
coordinate. A text throws the darts of its first few cells, as many as k coordinates need
with its total weight, and keeps the earliest dart of each coordinate; if a coordinate got
none, it goes on with the next cells. Texts share a coordinate's dart with a probability
equal to their similarity, and the work is of the order of weight + k log k.

**Candidates.** Equal texts are one text from the start. Signatures are cut into bands, and
texts that share a band share a bucket. No bucket is expanded into its pairs. Each bucket
has a centre, the member with the most company over all its buckets; every text is checked
exactly against the best-looking of its centres, which gives most of the components. Then,
in buckets that still hold several components, the members outside the largest one are
compared with all the others by their units, in blocks of bounded size; only links come out
of a block, at most one between a text and another component, and are checked exactly as
well. So every two texts that share a bucket are in one class already or have been
compared; nothing is capped.

Null texts and texts without words have no elements; each is a class of its own. A text of
one to four words is a single element. Repeated rows and equal texts share a class. An
empty table gives an empty result. Null ids are passed through; a class's id is its
smallest non-null document id. Only the id and text columns are read; ``deduplicate``
passes all columns through and keeps one row per class."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.llm import textvec as TV
from domainlab.session import scratch_path

WIDTH = 5
#: Similarity of a link, as a fraction.
LINK = (4, 5)
BANDS, ROWS = 32, 5
K = BANDS * ROWS
#: Pairs whose signatures agree in a smaller share are taken as dissimilar without a closer
#: look; at a similarity of 0.8 that is five and a half standard deviations down.
LOOK = 0.62
#: Rows of a bucket compared at a time: members, members outside the largest component.
BLOCK, RESIDUAL = 1024, 256

_U = np.uint64
# Poisson(1) distribution function on the scale of 64-bit hashes
_POISSON = np.array([min(2 ** 64 - 1, int(2 ** 64 * sum(math.exp(-1) / math.factorial(i) for i in range(n + 1))))
                     for n in range(18)], np.uint64)
_EMPTY = np.iinfo(np.uint64).max


def elements(c: TV.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text index of every unit of weight: the n-th occurrence of a run of words
    in its text is unit n of its region."""
    s, e, doc = c.words()
    h, doc = TV.shingles(c.hashes(s, e), doc, WIDTH)
    if not len(h):
        return h, doc
    order = np.argsort(TV.mix(h ^ TV.mix(doc.astype(_U) + _U(1))), kind="stable")
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(new)
    unit = np.arange(len(h)) - np.repeat(at, np.diff(np.append(at, len(h))))
    return TV.mix(h + unit.astype(_U) * _U(0xA24BAED4963EE407)), doc


def signatures(unit: np.ndarray, doc: np.ndarray, n: int, k: int = K) -> np.ndarray:
    """The earliest dart of each coordinate, (n, k); _EMPTY for texts without elements."""
    out = np.full(n * k, _EMPTY, _U)
    weight = np.bincount(doc, minlength=n)
    cells = np.maximum(1, np.ceil(k * (math.log(k) + 2) / np.maximum(weight, 1))).astype(np.int64)
    begin = np.zeros(n, np.int64)
    active = weight > 0
    while active.any():
        own = active[doc]
        u, d = unit[own], doc[own]
        each = cells[d]
        for lo, hi in _slices(each):
            reps = each[lo:hi]
            strip, text = np.repeat(u[lo:hi], reps), np.repeat(d[lo:hi], reps)
            first = np.cumsum(reps) - reps
            cell = (np.arange(len(strip)) - np.repeat(first, reps) + begin[text]).astype(_U)
            seed = TV.mix(strip + (cell + _U(1)) * _U(0x9FB21C651E98DF25))
            darts = np.searchsorted(_POISSON, seed, "right")
            some = np.flatnonzero(darts)
            many = darts[some]
            which = np.repeat(some, many)
            nth = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
            dart = TV.mix(seed[which] ^ ((nth.astype(_U) + _U(1)) * _U(0xD1B54A32D192ED03)))
            rank = (cell[which] << _U(44)) | (dart >> _U(20))
            place = (TV.mix(dart) >> _U(32)) * _U(k) >> _U(32)
            np.minimum.at(out, text[which] * k + place.astype(np.int64), rank)
        begin[active] += cells[active]
        active &= (out.reshape(n, k) == _EMPTY).any(axis=1)
    return out.reshape(n, k)


def _slices(each: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Runs of strips with about ``most`` cells together."""
    upto = np.cumsum(each)
    lo = 0
    while lo < len(each):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def bands(sig: np.ndarray) -> np.ndarray:
    """A hash per band, (n, BANDS)."""
    s = sig.reshape(len(sig), BANDS, -1)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_U) * _U(0x632BE59BD9B4E019), s.shape[:2])
    for r in range(s.shape[2]):
        h = TV.mix(h ^ s[:, :, r])
    return h


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Do two sorted arrays of units reach the link similarity?"""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * LINK[1] >= LINK[0] * (len(a) + len(b) - both)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in TV.chunks(b.column(2)):
            unit, doc = elements(c)
            sig = signatures(unit, doc, c.n)
            empty = np.bincount(doc, minlength=c.n) == 0
            h = bands(sig).view(np.int64)
            small = TV.mix(sig).astype("<u2")
            yield pa.RecordBatch.from_arrays([
                b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n), pa.array(~empty),
                pa.ListArray.from_arrays(pa.array(np.arange(0, c.n * BANDS + 1, BANDS, np.int32)), pa.array(h.ravel())),
                pa.array([r.tobytes() for r in small], pa.binary())],
                names=["doc_id", "key", "has_words", "bands", "sig"])


def _with_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) -> (key, text, small): its units, cut to 32 bits."""
    for b in batches:
        for c in TV.chunks(b.column(1)):
            unit, doc = elements(c)
            order = np.argsort(doc, kind="stable")
            raw = TV.mix(unit[order]).astype("<u4")
            cut = np.searchsorted(doc[order], np.arange(c.n + 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0).slice(c.first, c.n), b.column(1).slice(c.first, c.n),
                 pa.array([raw[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())],
                names=["key", "text", "small"])


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, sig_a, sig_b) -> (a, b, share) of pairs worth a closer look."""
    for t in batches:
        if t.num_rows:
            x, y = (np.frombuffer(b"".join(t.column(k).to_pylist()), "<u2").reshape(-1, K) for k in (2, 3))
            share = (x == y).mean(axis=1)
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1), pa.array(share)],
                                             names=["a", "b", "share"]).filter(pa.array(share >= LOOK))


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) -> (a, b) of links."""
    for t in batches:
        for lo in range(0, t.num_rows, 256):
            part = t.slice(lo, 256)
            sets = []
            for k in (2, 3):
                own = []
                for c in TV.chunks(part.column(k)):
                    unit, doc = elements(c)
                    order = np.lexsort((unit, doc))
                    own += np.split(unit[order], np.searchsorted(doc[order], np.arange(1, c.n)))
                sets.append(own)
            ok = pa.array([similar(x, y) for x, y in zip(*sets)], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(ok)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, i, j, outside, key, part, small) sorted by (bucket, i, j) -> pairs
    (a, b) of different components that reach the link similarity. Every row outside the
    largest component is compared with all members of its block at once: their units are
    looked up in a table of its own, and the hits are summed per member."""

    def found(rows: pa.Table) -> tuple[pa.Array, pa.Array]:
        side = rows["outside"].to_numpy()
        units = [np.frombuffer(u, "<u4") for u in rows["small"].to_pylist()]
        part = np.unique(np.array(rows["part"].to_pylist(), object), return_inverse=True)[1]
        r, m = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        left, right = [], []
        if len(r) and len(m):
            known = np.unique(np.concatenate([units[x] for x in r]))
            theirs = np.concatenate([units[y] for y in m])
            size = np.array([len(units[y]) for y in m])
            at = np.searchsorted(known, theirs)
            at[at == len(known)] = 0
            at = np.where(known[at] == theirs, at, len(known))
            begin = np.cumsum(size) - size
            flag = np.zeros(len(known) + 1, np.int32)
            for x in r:
                own = np.searchsorted(known, units[x])
                flag[own] = 1
                both = np.add.reduceat(flag[at], begin)
                flag[own] = 0
                hit = np.flatnonzero((part[m] != part[x])
                                     & (both * LINK[1] >= LINK[0] * (size + len(units[x]) - both)))
                # one link joins two components: the best of each
                hit = hit[np.argsort(-both[hit], kind="stable")]
                hit = hit[np.unique(part[m[hit]], return_index=True)[1]]
                left.append(np.full(len(hit), x))
                right.append(m[hit])
        left, right = np.concatenate(left or [[]]).astype(int), np.concatenate(right or [[]]).astype(int)
        key = rows["key"].combine_chunks()
        return key.take(pa.array(left)), key.take(pa.array(right))

    def groups() -> Iterator[pa.Table]:
        held = None
        for b in batches:
            t = pa.Table.from_batches([b])
            held = t if held is None else pa.concat_tables([held, t])
            ids = np.column_stack([held[c].to_numpy() for c in ("bucket", "i", "j")])
            cut = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cut[:-1]], cut):
                yield held.slice(lo, hi - lo)
            held = held.slice(int(cut[-1])) if len(cut) else held
        if held is not None and held.num_rows:
            yield held

    a, b, n = [], [], 0
    for g in groups():
        x, y = found(g)
        a.append(x)
        b.append(y)
        n += len(x)
        if n >= 20_000 or len(a) >= 5_000:
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])
            a, b, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.concat_arrays(a), pa.concat_arrays(b)], names=["a", "b"])


class _Run:
    """Tables of one run, written to a fresh shared folder, so that no stage is repeated
    by the ones after it or after the loss of an executor."""

    def __init__(self, spark):
        self.spark, self.folder = spark, scratch_path(spark, "near")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.parquet(f"{self.folder}/{name}")


def _key(text):
    return F.unhex(F.md5(F.encode(text, "UTF-8")))


def _links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    a = texts.select(F.col("key").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("key").alias("b"), F.col("text").alias("text_b"))
    return (pairs.select("a", "b").join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b")
            .mapInArrow(_check, "a binary, b binary"))


def _roots(run: _Run, parent: DataFrame, name: str) -> DataFrame:
    """(a, b) of a forest -> (a, root): pointers are doubled until they rest."""
    p = parent.select("a", F.col("b").alias("root"))
    step = 0
    while True:
        up = p.select(F.col("a").alias("root"), F.col("root").alias("_next"))
        p = run.keep(p.join(up, "root", "left").select(
            "a", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), f"{name}{step}")
        if p.where("_moved").isEmpty():
            return p.select("a", "root")
        p, step = p.select("a", "root"), step + 1


def components(run: _Run, edges: DataFrame, name: str) -> DataFrame:
    """(a, b) undirected -> (a, root): the smallest node reachable. Each round every node
    takes the smallest label around it, and labels their own labels' label."""
    both = run.keep(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                    .where("a <> b").distinct(), f"{name}-edges")
    label = run.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")), f"{name}-0")
    step = 1
    while True:
        near = (both.join(label.select(F.col("a").alias("b"), F.col("root").alias("_r")), "b")
                .groupBy("a").agg(F.min("_r").alias("_near")))
        low = label.join(near, "a").select("a", F.col("root").alias("_old"), F.least("root", "_near").alias("_low"))
        up = label.select(F.col("a").alias("_low"), F.col("root").alias("_up"))
        new = run.keep(low.join(up, "_low", "left").select(
            "a", F.least("_low", F.coalesce("_up", "_low")).alias("root"), "_old"), f"{name}-{step}")
        if new.where("root <> _old").isEmpty():
            return new.select("a", "root")
        label, step = new.select("a", "root"), step + 1


def _mixed_pairs(members: DataFrame, part: DataFrame, whole: DataFrame) -> DataFrame:
    """Pairs (a, b) that share a bucket, lie in different components and are similar by
    32-bit units, which can only overstate a similarity."""
    m = (members.join(part.select(F.col("a").alias("key"), F.col("root")), "key", "left")
         .select("bucket", "key", F.coalesce("root", "key").alias("part")))
    per = m.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("c"))
    mixed = (per.groupBy("bucket").agg(F.sum("c").alias("n"), F.max(F.struct("c", "part")).alias("top"))
             .where(F.col("n") > F.col("top.c"))
             .select("bucket", F.col("top.part").alias("largest"),
                     F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"),
                     F.ceil((F.col("n") - F.col("top.c")) / RESIDUAL).cast("int").alias("ni")))
    m = m.join(mixed, "bucket")
    h = F.xxhash64("key")
    all_rows = m.withColumn("j", F.pmod(h, F.col("nj")).cast("int")).withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.col("ni") - 1))).withColumn("outside", F.lit(0))
    outside = (m.where("part <> largest").withColumn("i", F.pmod(h, F.col("ni")).cast("int"))
               .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nj") - 1))).withColumn("outside", F.lit(1)))
    cols = ["bucket", "i", "j", "outside", "key", "part"]
    rows = all_rows.select(*cols).unionByName(outside.select(*cols)).join(whole.select("key", "small"), "key")
    pairs = (rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
             .select(*cols, "small").mapInArrow(_compare, "a binary, b binary"))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _classified(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row (doc_id, key, has_words), and per text with words the class:
    (key, class_id, class_size)."""
    run = _Run(docs.sparkSession)
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = named.select("doc_id", _key(F.coalesce("text", F.lit(""))).alias("key"), "text")
    rows = run.keep(keyed.mapInArrow(
        _sketch, "doc_id long, key binary, has_words boolean, bands array<long>, sig binary"), "rows")
    texts = run.keep(rows.where("has_words").groupBy("key").agg(
        F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"),
        F.first("bands").alias("bands"), F.first("sig").alias("sig")), "texts")

    banded = texts.select("key", F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = run.keep(banded.join(sizes, "bucket").select("bucket", "key", "n"), "members")

    # centres: the member with the most company; pointers lead to a higher rank, hence no cycles
    ranks = members.groupBy("key").agg(F.struct(F.sum("n").alias("c"), F.col("key").alias("key")).alias("rank"))
    ranked = members.select("bucket", "key").join(ranks, "key")
    centres = ranked.groupBy("bucket").agg(F.max("rank").alias("top")).select("bucket", F.col("top.key").alias("b"))
    stars = (members.select("bucket", F.col("key").alias("a")).join(centres, "bucket")
             .where("a <> b").select("a", "b").distinct())
    s = texts.select("key", "sig")
    looked = (stars.join(s.select(F.col("key").alias("a"), F.col("sig").alias("sig_a")), "a")
              .join(s.select(F.col("key").alias("b"), F.col("sig").alias("sig_b")), "b")
              .select("a", "b", "sig_a", "sig_b").mapInArrow(_agree, "a binary, b binary, share double"))
    best = (looked.groupBy("a").agg(F.max(F.struct("share", "b")).alias("best"))
            .select("a", F.col("best.b").alias("b")))

    wanted = members.select("key").distinct()
    # a text of each key, chosen before anything moves: copies of a text don't meet in a task
    whole = run.keep(keyed.groupBy("key").agg(F.first("text").alias("text")).join(wanted, "key")
                     .mapInArrow(_with_units, "key binary, text string, small binary"), "whole")
    forest = run.keep(_links(best, whole), "stars")
    part = _roots(run, forest, "roots")
    more = run.keep(_links(_mixed_pairs(members, part, whole), whole), "more")
    if not more.isEmpty():
        # links between components join them; a text without a pointer is its own root
        at = lambda c: part.select(F.col("a").alias(c), F.col("root").alias(f"_{c}"))
        tops = more.join(at("a"), "a", "left").join(at("b"), "b", "left").select(
            F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = components(run, tops, "joined")
        over = joined.select(F.col("a").alias("root"), F.col("root").alias("_over"))
        lifted = part.join(over, "root", "left").select("a", F.coalesce("_over", "root").alias("root"))
        part = lifted.unionByName(joined.join(part.select("a"), "a", "left_anti"))
    owned = (texts.select("key", "first_id", "n").join(part.select(F.col("a").alias("key"), "root"), "key", "left")
             .withColumn("root", F.coalesce("root", "key")))
    classes_ = owned.groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
    return rows, run.keep(owned.join(classes_, "root").select("key", "root", "class_id", "class_size"), "classes")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, class_size) per row: the smallest id in its class, the rows in it."""
    rows, of = _classified(docs, id_col, text_col)
    return (rows.select("doc_id", "key", "has_words").join(of, "key", "left")
            .select(F.col("doc_id").alias(id_col),
                    F.when(F.col("has_words"), F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                    F.when(F.col("has_words"), F.col("class_size")).otherwise(1).cast("long").alias("class_size")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each class, with all columns, whatever their names: a row of the smallest
    id. Rows without words all stay."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    own = [F.col(p).alias(name) for p, name in zip(plain, docs.columns)]
    id_col, text_col = (plain[docs.columns.index(c)] for c in (id_col, text_col))
    docs = docs.toDF(*plain)
    rows, of = _classified(docs, id_col, text_col)
    # rows that stand for their class; only where they are several need any be dropped, so
    # that most texts are not dealt out again
    firsts = (rows.where("has_words").select("doc_id", "key").join(of, "key")
              .where(F.col("doc_id").eqNullSafe(F.col("class_id")))
              .groupBy("root").agg(F.count(F.lit(1)).alias("_n")))
    of = of.join(firsts, "root").select(F.col("key").alias("_key"), F.col("root").alias("_root"),
                                        F.col("class_id").alias("_class"), "_n")
    d = docs.withColumn("_key", _key(F.coalesce(F.col(text_col), F.lit(""))))
    j = d.join(of, "_key", "left")
    kept = j.where(F.col("_root").isNull() | (F.col(id_col).cast("long").eqNullSafe(F.col("_class")) & (F.col("_n") == 1)))
    chosen = (j.where(F.col(id_col).cast("long").eqNullSafe(F.col("_class")) & (F.col("_n") > 1))
              .dropDuplicates(["_root"]))
    return kept.unionByName(chosen).select(*own)
