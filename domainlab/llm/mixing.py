"""Mixing sources to target weights by systematic sampling.

Sources are ranked by code point, null last, and weigh 3, 1, 2, 3, ... in that order. They
share ``share`` times the size of everything by weight, but no target exceeds ``most``
times its source's size; what is over goes to the others by weight until none is above.
Each document of a source expects target / size copies. Documents are put in the order of
size, then of a hash of their id; the expected copies are summed along that order, one
random offset (a hash of seed and source) is added, and a document is taken once for each
whole number that its step crosses. In size order the words taken differ from the target
by about the largest document at most.

Null texts have size 0; documents of size 0 are sampled like others and take no words. A
source whose documents are all empty has target 0 and takes nothing. Repeated rows are
sampled as rows of their own (they stand next to each other in the order). An empty table
gives an empty result. ``mix`` keeps all columns of its input; its own columns live in
names beginning with an underscore that must not clash and in a struct column ``mix``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 20240
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, size) -> (source, size, target), one row per source.

    Water filling in closed form: in the order of cap / weight, the sources up to some
    place stop at their caps, and those after it get weight * level, where the level is
    what is left over the weights that are left."""
    # one row per source: a summary, not the data
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)),
                          ((F.row_number().over(everything) - 1) % len(WEIGHTS) + 1).cast("int"))
    up = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy()
    return (
        sizes.withColumn("_w", weight).withColumn("_cap", (F.col("size") * MOST).cast("double"))
        .withColumn("_ratio", F.col("_cap") / F.col("_w"))
        .withColumn("_left", F.lit(SHARE) * F.sum("size").over(whole)
                    - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("_w").over(after))
        # saturated: even all that is left would, by weight, give this source its cap
        .withColumn("_full", F.col("_left") * F.col("_w") >= F.col("_cap") * F.col("_weights"))
        .withColumn("_left", F.min(F.when(~F.col("_full"), F.struct("_ratio", "_left", "_weights")))
                    .over(whole))
        .select("source", "size",
                F.when(F.col("_full"), F.col("_cap"))
                .otherwise(F.col("_left._left") * F.col("_w") / F.col("_left._weights")).alias("target")))


def offset(source: Column, seed: int) -> Column:
    """A multiple of 2**-16 in [0, 1), from a hash of seed and source."""
    h = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(source, F.lit("")))), 1, 4)
    return F.conv(h, 16, 10).cast("double") / 65536.0


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The documents with a struct ``mix`` of size, source_size, target, copies, taken; a
    column of that name in the documents is replaced."""
    d, own = _mixed(docs, id_col, text_col, source_col, seed)
    return d.select(*[c for c, name in zip(own, docs.columns) if name != "mix"], "mix")


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> tuple[DataFrame, list[Column]]:
    """The documents under plain names, so that no column's name matters, with ``mix``; and
    the documents' own columns.

    The place of a document in its source's order is the sum of three counts: documents
    of smaller size; of equal size in lower hash buckets; before it in its bucket. Only
    the last needs documents together, and a bucket is a small slice of one size of one
    source, however large the source or a group of copies is."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    own = [F.col(p).alias(name) for p, name in zip(plain, docs.columns)]
    id_col, text_col, source_col = (plain[docs.columns.index(c)] for c in (id_col, text_col, source_col))
    d = docs.toDF(*plain).withColumn("_size", words(F.col(text_col))).withColumn("_hash", F.md5(F.concat(
        F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))))
    # one plain key for null and named sources: the join and the window then share a shuffle
    d = d.withColumn("_source", F.concat(F.when(F.col(source_col).isNull(), "1").otherwise("0"),
                                         F.coalesce(F.col(source_col), F.lit(""))))
    d = d.withColumn("_bucket", F.substring("_hash", 1, 3))
    return _take(d.join(_places(d.select("_source", "_size", "_bucket")),
                        ["_source", "_size", "_bucket"]), id_col, source_col, seed), own


def _places(keys: DataFrame) -> DataFrame:
    """(source, size, bucket) with the number of documents before it in its source, and
    its source's size and target."""
    buckets = keys.groupBy("_source", "_size", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_size = buckets.groupBy("_source", "_size").agg(F.sum("_n").alias("_n_size"))
    up = Window.partitionBy("_source").orderBy("_size").rowsBetween(Window.unboundedPreceding, -1)
    below = per_size.select("_source", "_size", F.coalesce(F.sum("_n_size").over(up), F.lit(0)).alias("_below"))
    goal = targets(per_size.groupBy(F.col("_source").alias("source"))
                   .agg(F.sum(F.col("_size") * F.col("_n_size")).alias("size")))
    below = below.join(goal.select(F.col("source").alias("_source"), F.col("size").alias("_source_size"),
                                   F.col("target").alias("_target")), "_source")
    inside = Window.partitionBy("_source", "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    return (buckets.withColumn("_earlier", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
            .join(below, ["_source", "_size"])
            .select("_source", "_size", "_bucket", (F.col("_below") + F.col("_earlier")).alias("_before"),
                    "_source_size", "_target"))


def _take(d: DataFrame, id_col: str, source_col: str, seed: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("_source", "_size", "_bucket").orderBy("_hash", id_col))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    u = offset(F.col(source_col), seed)
    upto = F.floor(F.col("_place") * F.col("_rate") + u) - F.floor((F.col("_place") - 1) * F.col("_rate") + u)
    d = (d.withColumn("_place", F.col("_before") + place).withColumn("_rate", rate)
         .withColumn("_copies", F.least(upto, F.lit(MOST)).cast("int")))
    d = d.withColumn("mix", F.struct(
        F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"), F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("_size")).cast("long").alias("taken")))
    return d.drop("_size", "_hash", "_bucket", "_source", "_before", "_source_size",
                  "_target", "_place", "_rate", "_copies")


def emit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         source_col: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its own columns, whatever
    their names."""
    d, own = _mixed(docs, id_col, text_col, source_col, seed)
    return (d.where("mix.copies > 0")
            .withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix.copies"))))
            .select(*own))
