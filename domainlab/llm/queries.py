"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlab.llm import (alignment, balltree, dartminhash, htmltree, linecrf, mixing, postings, recompression, ring,
                           sepscan, tokenfiles, warc, wfst)
from domainlab.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Where the vocabulary files of public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"


#: The end-of-document id of word_bpe_49k.json; no text encodes to it.
END_OF_TEXT = 49407


def vocabulary(name: str) -> str:
    """A vocabulary file: below DOMAINLAB_TOKENIZERS if that is set, else beside the
    installed files' module, else below TOKENIZERS."""
    folder = os.environ.get("DOMAINLAB_TOKENIZERS")
    if folder is None:
        try:
            import public_tokenizers
            return public_tokenizers.path(name)
        except ImportError:
            folder = TOKENIZERS
    return os.path.join(folder, name)


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query("op1_warc", """
with p as (select page_id, coalesce(html, '') as body from pages),
h as (select page_id, octet_length(encode(body)) as n, sha1(body) as x from p),
f as (select *, min(page_id) over (partition by x) as first_id, count(*) over (partition by x) as k from h)
select page_id, cast(n as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((cast('0x' || substr(x, cast(1 + 5 * (i // 4) as int), 5) as int) >> cast(15 - 5 * (i % 4) as int)) & 31), 1)), '')
           as payload_digest,
       case when k > 1 and page_id is distinct from first_id and first_id is not null then 'revisit' else 'response' end
           as record_type,
       case when k > 1 and page_id is distinct from first_id then first_id end as refers_to
from f""")
def op1(spark, sf):
    return warc.round_trip(table(spark, sf, "pages"))


@query("op2_htmltree")
def op2(spark, sf):
    return htmltree.extract(table(spark, sf, "pages"), htmltree.trained())


@query("op3_linecrf")
def op3(spark, sf):
    docs = table(spark, sf, "documents")
    return linecrf.judge(docs, linecrf.train(docs, table(spark, sf, "labels")))


@query("op4_balltree", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as e
           from embeddings where vec_id is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as score
      from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, cast(score as bigint) as score from r where rank <= 10""")
def op4(spark, sf):
    v = table(spark, sf, "embeddings")
    return balltree.top_k(v, v.where("vec_id % 100 = 0"))


@query("op5_wfst")
def op5(spark, sf):
    return wfst.encode(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


_WORDS = r"[^\x20\x09-\x0D]+"


@query("op6_mix", rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{_WORDS}')) as bigint) as size,
                  md5('{mixing.SEED}|' || coalesce(cast(doc_id as varchar), '')) as h from documents),
src as (select source, sum(size) as source_size from d group by source),
w as (select *, [3, 1, 2][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] as wt,
             cast(source_size * 2 as double) as cap from src),
r as (select *, cap / wt as ratio from w),
l as (select *, 1.5::double * sum(source_size) over ()
             - coalesce(sum(cap) over (order by ratio, encode(source) nulls last
                                       rows between unbounded preceding and 1 preceding), 0.0) as rest,
             sum(wt) over (order by ratio, encode(source) nulls last
                           rows between current row and unbounded following) as wts from r),
g as (select *, rest * wt >= cap * wts as is_full from l),
one as (select min(struct_pack(ratio := ratio, rest := rest, wts := wts)) filter (not is_full) as a from g),
t as (select source, source_size, case when is_full then cap else a.rest * wt / a.wts end as target from g, one),
n as (select d.*, source_size, target,
             case when source_size > 0 then target / source_size else 0.0 end as rate,
             cast(cast('0x' || substr(md5('{mixing.SEED}|' || coalesce(d.source, '')), 1, 4) as int) as double) / 65536.0 as u,
             row_number() over (partition by d.source order by size, h, doc_id) as p
      from d join t on d.source is not distinct from t.source)
select doc_id, size, cast(source_size as bigint) as source_size, target,
       cast(size * least(floor(p * rate + u) - floor((p - 1) * rate + u), 2) as bigint) as taken from n""")
def op6(spark, sf):
    d = mixing.mix(table(spark, sf, "documents"))
    return d.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken")


@query("op7_dartminhash")
def op7(spark, sf):
    return dartminhash.classes(table(spark, sf, "documents"))


@query("op8_tokenfiles")
def op8(spark, sf):
    return tokenfiles.round_trip(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), end_id=1)


@query("op9_sepscan")
def op9(spark, sf):
    return sepscan.count_documents(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"), END_OF_TEXT)


@query("op10_ring")
def op10(spark, sf):
    d = ring.assign(table(spark, sf, "documents"), shards=8)
    return d.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard"))


@query("op11_postings")
def op11(spark, sf):
    v = table(spark, sf, "embeddings")
    return postings.nearest(v, v.where("vec_id % 20 = 0"))


@query("op12_recompression")
def op12(spark, sf):
    return recompression.runs(table(spark, sf, "documents"))


@query("op13_spillcount")
def op13(spark, sf):
    return alignment.align(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.json"),
                           vocabulary("piece_bpe_32k.model"))
