"""Registered queries: each takes ``(spark, sf_dir)`` and returns a DataFrame built
from the driver's whole tables. ``ORACLE`` holds the DuckDB statement for each
query that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlab.functions import suffix as S
from domainlab.functions import tokens as TK
from domainlab.operators import prep, vocab
from domainlab.plans import oracle_sql as O
from domainlab.session import ship_package
from domainlab.sources import fixtures as FX

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


_INDEX: dict[str, S.SuffixIndex] = {}


def mini_index(spark: SparkSession) -> S.SuffixIndex:
    key = spark.sparkContext.applicationId
    if key not in _INDEX:
        _INDEX[key] = S.SuffixIndex.mini(spark)
    return _INDEX[key]


def domains(spark: SparkSession, sf: str) -> DataFrame:
    """Prepared per-(year, label) domains from the ``raw_domains`` view."""
    return prep.prepared_domains(FX.raw_domains(spark, sf), mini_index(spark))


# ---------------------------------------------------------------- flagship / V1
@query("tld_counts", O.with_(O.PREPARED) + """
select tld, count(*) as count
from (select unnest(regexp_extract_all(domain, '\\[\\.[a-zA-Z0-9-]+\\]')) as tld from domains) t
where tld is not null group by tld having count(*) >= 10""")
def q_tld_counts(spark, sf):
    return vocab.tld_counts(domains(spark, sf), "domain", 10)


# ---------------------------------------------------------------- T3 / A2
@query("wrap_tld", O.with_(O.PREPARED) + """
select domain, doc_id, year, family, label from domains""")
def q_wrap_tld(spark, sf):
    return domains(spark, sf).select("domain", "doc_id", "year", "family", "label")


@query("dedup_domain", O.with_(O.PREPARED) + """
select domain, min(doc_id) as doc_id, count(*) as n_rows from wrapped group by domain""")
def q_dedup_domain(spark, sf):
    """A2 over all years: one row per wrapped domain, smallest doc_id kept, with
    the number of rows it stood for."""
    raw = prep.drop_underscore(FX.raw_domains(spark, sf))
    # counted by lower-cased name first: a name is wrapped once, however many rows have it
    once = raw.groupBy("domain").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_rows"))
    w = S.wrap_tld(once, "domain", mini_index(spark))
    return w.groupBy("domain").agg(F.min("doc_id").alias("doc_id"), F.sum("n_rows").alias("n_rows"))


@query("split_suffix", O.with_(O.RAW_DOMAINS, """
names as (select distinct lower(domain) as d0 from raw_domains)""", O.suffix_ctes("names", "d0")) + """
select s.d as domain,
       case when len(s.labels) - s.s_all - 1 >= 1 then array_to_string(s.labels[1:len(s.labels) - s.s_all - 1], '.') else '' end as subdomain,
       case when len(s.labels) - s.s_all >= 1 then s.labels[len(s.labels) - s.s_all] else '' end as registered,
       array_to_string(case when s.s_all > 0 then s.labels[len(s.labels) - s.s_all + 1:] else []::varchar[] end, '.') as suffix
from sfx_s s""")
def q_split_suffix(spark, sf):
    names = FX.raw_domains(spark, sf).select(F.lower("domain").alias("domain")).distinct()
    out = S.split_suffix(names, "domain", mini_index(spark), private=True, out="sp")
    return out.select("domain", F.col("sp.subdomain").alias("subdomain"),
                      F.col("sp.domain").alias("registered"), F.col("sp.suffix").alias("suffix"))


_IDN_SQL = O.with_(O.IDN_NAMES, """
idn_lower as (select distinct lower(domain) as d0 from idn_names)""", O.suffix_ctes("idn_lower", "d0", idn=True))


def _idn_index(spark):
    return S.SuffixIndex(S.rules_frame(spark, S.MINI_RULES_ICANN + S.IDN_RULES))


@query("split_suffix_idn", _IDN_SQL + """
select s.d as domain,
       case when len(s.labels) - s.s_all - 1 >= 1 then array_to_string(s.labels[1:len(s.labels) - s.s_all - 1], '.') else '' end as subdomain,
       case when len(s.labels) - s.s_all >= 1 then s.labels[len(s.labels) - s.s_all] else '' end as registered,
       array_to_string(case when s.s_all > 0 then s.labels[len(s.labels) - s.s_all + 1:] else []::varchar[] end, '.') as suffix
from sfx_s s""")
def q_split_suffix_idn(spark, sf):
    """T1 on names whose suffixes hold internationalised labels, native or ``xn--``."""
    names = FX.idn_names(spark, sf).select(F.lower("domain").alias("domain")).distinct()
    out = S.split_suffix(names, "domain", _idn_index(spark), private=True, out="sp")
    return out.select("domain", F.col("sp.subdomain").alias("subdomain"),
                      F.col("sp.domain").alias("registered"), F.col("sp.suffix").alias("suffix"))


@query("wrap_tld_idn", _IDN_SQL + f"""
select n.domain, {O.wrap_expr('s.d', 's.labels')} as wrapped from idn_names n join sfx_s s on s.d = lower(n.domain)""")
def q_wrap_tld_idn(spark, sf):
    """T3 on the same names."""
    return S.wrap_tld(FX.idn_names(spark, sf), "domain", _idn_index(spark), out="wrapped")


# ---------------------------------------------------------------- P1-P4
@query("label_rows", O.with_(O.RAW_DOMAINS) + """
select domain, cast(0 as int) as label from (select doc_id as rank, domain from raw_domains) t
union all
select domain, cast(1 as int) as label from (select domain, doc_id from raw_domains) u""")
def q_label_rows(spark, sf):
    raw = FX.raw_domains(spark, sf)
    ranked = raw.select(F.col("doc_id").alias("rank"), "domain")    # domain is column 1
    feed = raw.select("domain", "doc_id")                           # domain is column 0
    return prep.label_rows(ranked, "benign").unionByName(prep.label_rows(feed, "dga"))


@query("drop_underscore", O.with_(O.RAW_DOMAINS) + """
select lower(domain) as domain, doc_id, year, family, label from raw_domains
where not coalesce(contains(lower(domain), '_'), false)""")
def q_drop_underscore(spark, sf):
    return prep.drop_underscore(FX.raw_domains(spark, sf), "domain")


@query("in_year", """
select o_orderkey, o_orderdate, o_totalprice from orders
where o_orderdate >= timestamp '1996-01-01' and o_orderdate < timestamp '1997-01-01'""")
def q_in_year(spark, sf):
    o = FX.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return prep.in_year(o, "o_orderdate", 1996)


# ---------------------------------------------------------------- A1 / A3
@query("union_sources", O.with_(O.PREPARED) + """
select domain, label, year from domains where label = 0
union all select domain, label, year from domains where label = 1""")
def q_union_sources(spark, sf):
    d = domains(spark, sf).select("domain", "label", "year")
    return prep.union_sources([d.where("label = 0"), d.where("label = 1")])


@query("assemble_train", O.with_(O.PREPARED) + """
select distinct domain, label from domains where year between 2017 and 2019""")
def q_assemble_train(spark, sf):
    d = domains(spark, sf).where(F.col("year").between(2017, 2019)).select("domain", "label")
    return prep.assemble(d)


# ---------------------------------------------------------------- T5, T6, T8, T9
@query("extract_tlds", O.with_(O.PREPARED) + """
select domain, year, label,
       array_to_string(regexp_extract_all(lower(domain), '\\[\\.[a-zA-Z0-9-]+\\]'), ' ') as tlds
from domains""")
def q_extract_tlds(spark, sf):
    d = domains(spark, sf)
    return d.select("domain", "year", "label", F.array_join(TK.tld_tokens("domain"), " ").alias("tlds"))


@query("strip_tlds", O.with_(O.PREPARED) + """
select domain, year, label,
       list_reduce(list_prepend(lower(domain), regexp_extract_all(lower(domain), '\\[\\.[a-zA-Z0-9-]+\\]')),
                   lambda acc, t: replace(acc, t, '')) as sld
from domains""")
def q_strip_tlds(spark, sf):
    d = domains(spark, sf)
    return d.select("domain", "year", "label", TK.strip_tlds("domain").alias("sld"))


@query("unwrap", O.with_(O.PREPARED) + """
select domain, year, label, translate(lower(domain), '[]', '') as unwrapped from domains""")
def q_unwrap(spark, sf):
    d = domains(spark, sf)
    return d.select("domain", "year", "label", TK.unwrap("domain").alias("unwrapped"))


@query("pretokenize", O.with_(O.PREPARED) + f"""
select domain, year, label,
       array_to_string(regexp_extract_all(lower(domain), '{TK.WORD_PATTERN.replace("(?U)", "")}', 1), ' ') as words
from domains""")
def q_pretokenize(spark, sf):
    d = domains(spark, sf)
    return d.select("domain", "year", "label",
                    F.array_join(TK.pretokenize(F.lower("domain")), " ").alias("words"))


# ---------------------------------------------------------------- U1 / U2 (+P7-P9, J4, T4)
_AUDIT = O.with_(O.AUDIT_NAMES, """
orig as (select lower(domain) as original_domain, min(source_file) as source_file from audit_names
         group by lower(domain))""",
                 O.suffix_ctes("orig", "original_domain"), f"""
audit as (
  select o.original_domain, {O.v1_expr('o.original_domain', 's.labels')} as processed_domain,
         {O.wrap_expr('o.original_domain', 's.labels')} as processed_domain2, o.source_file
  from orig o left join sfx_s s on s.d = o.original_domain
),
bad as (select * from audit where starts_with(processed_domain, '['))""")


def _audit(spark, sf):
    from domainlab.operators import audit
    return audit.audit_wrap(FX.audit_names(spark, sf), "domain", "source_file", mini_index(spark))


@query("wrap_rules", _AUDIT + """
select original_domain, processed_domain2 as wrapped from audit""")
def q_wrap_rules(spark, sf):
    """T3 on names that reach the private, ICANN-only, promoted, wildcard and exception arms."""
    names = FX.audit_names(spark, sf).select(F.lower("domain").alias("original_domain")).distinct()
    return S.wrap_tld(names, "original_domain", mini_index(spark), "wrapped")


@query("audit_wrap", _AUDIT + """
select original_domain, processed_domain, processed_domain2, source_file from bad""")
def q_audit_wrap(spark, sf):
    return _audit(spark, sf)[0]


@query("audit_three_part", _AUDIT + """
select original_domain, processed_domain, processed_domain2, source_file from bad
where len(string_split(original_domain, '.')) = 3""")
def q_audit_three_part(spark, sf):
    return _audit(spark, sf)[1]


# ---------------------------------------------------------------- A4-A8 metrics
from domainlab.operators import metrics as MX  # noqa: E402

_COUNTS_SQL = """count(*) as n,
       count_if(y_true = 0 and y_pred = 0) as tn, count_if(y_true = 0 and y_pred = 1) as fp,
       count_if(y_true = 1 and y_pred = 0) as fn, count_if(y_true = 1 and y_pred = 1) as tp,
       count_if(y_true = y_pred) as n_eq"""


def _rates_sql(src: str) -> str:
    def r(a, b):
        return f"round(case when ({b}) = 0 then null else cast({a} as double) / ({b}) end, 6)"
    return f"""n, tn, fp, fn, tp, {r('n_eq', 'n')} as accuracy,
       coalesce({r('tp', 'tp + fp')}, 0.0) as precision, coalesce({r('tp', 'tp + fn')}, 0.0) as recall,
       coalesce({r('2 * tp', '2 * tp + fp + fn')}, 0.0) as f1,
       {r('fp', 'fp + tn')} as fpr, {r('fn', 'fn + tp')} as fnr from {src}"""


@query("confusion", O.with_(O.PREDICTIONS) + f"""
select n, tn, fp, fn, tp from (select {_COUNTS_SQL} from predictions) c""")
def q_confusion(spark, sf):
    return MX.confusion(FX.predictions(spark, sf))


@query("metrics_overall", O.with_(O.PREDICTIONS, f"""
c as (select {_COUNTS_SQL} from predictions)""") + "select " + _rates_sql("c"))
def q_metrics_overall(spark, sf):
    return MX.metrics_overall(FX.predictions(spark, sf))


@query("metrics_by_year", O.with_(O.PREDICTIONS, f"""
c as (select case when grouping(year) = 1 then 'overall' else cast(year as varchar) end as year, {_COUNTS_SQL}
      from predictions group by grouping sets ((year), ()))""") + "select year, " + _rates_sql("c"))
def q_metrics_by_year(spark, sf):
    return MX.metrics_by(FX.predictions(spark, sf), "year", overall=True)


@query("metrics_by_family", O.with_(O.PREDICTIONS, f"""
c as (select family, {_COUNTS_SQL} from predictions group by family)""") + "select family, " + _rates_sql("c"))
def q_metrics_by_family(spark, sf):
    return MX.metrics_by(FX.predictions(spark, sf), "family")


# ---------------------------------------------------------------- A9-A13, W1, W2, W4
from domainlab.operators import trainlog as TL  # noqa: E402


@query("batch_ids", O.with_(O.TRAIN_LOG) + """
select run, step, task, loss,
       cast(floor((row_number() over (partition by run order by step, task) - 1) / 128) as bigint) as batch_id
from train_log""")
def q_batch_ids(spark, sf):
    return TL.batch_ids(FX.train_log(spark, sf), ["step", "task"], 128, ["run"])


@query("batch_mean_loss", O.with_(O.TRAIN_LOG, """
b as (select run, task, loss, floor((row_number() over (partition by run, task order by step) - 1) / 128) as batch_id
      from train_log),
per as (select run, task, batch_id, avg(loss) as m, count(*) as c from b group by run, task, batch_id)""") + """
select run, task, round(avg(m), 6) as batch_mean_loss, count(*) as n_batches, sum(c) as n_rows
from per group by run, task""")
def q_batch_mean_loss(spark, sf):
    r = TL.batch_mean_loss(FX.train_log(spark, sf), ["step"], "loss", 128, ["run", "task"])
    return r.withColumn("batch_mean_loss", F.round("batch_mean_loss", 6))


@query("total_loss", O.with_(O.TRAIN_LOG) + """
select run, step, round(sum(loss), 6) as total_loss, count(*) as n_tasks from train_log group by run, step""")
def q_total_loss(spark, sf):
    return TL.total_loss(FX.train_log(spark, sf)).withColumn("total_loss", F.round("total_loss", 6))


@query("interval_loss", O.with_(O.TRAIN_LOG, O.TOTALS) + """
select run, task, cast(floor((step - 1) / 100) as bigint) as interval, round(avg(loss), 6) as mean_loss,
       max(step) as end_step
from tasklog group by run, task, cast(floor((step - 1) / 100) as bigint) having count(distinct step) = 100""")
def q_interval_loss(spark, sf):
    """Each task's mean, and the mean total, over blocks of 100 steps."""
    log = TL.with_total(FX.train_log(spark, sf))
    return TL.interval_loss(log, 100).withColumn("mean_loss", F.round("mean_loss", 6))


@query("best_checkpoint", O.with_(O.TRAIN_LOG, O.TOTALS) + """
select run, step, loss from (
  select *, min(loss) over (partition by run order by step rows between unbounded preceding and 1 preceding) as pm
  from (select run, step, round(loss, 6) as loss from steps) r) t
where pm is null or loss < pm""")
def q_best_checkpoint(spark, sf):
    """The steps whose total loss is below every earlier one."""
    total = TL.total_loss(FX.train_log(spark, sf))
    return TL.best_checkpoints(total.select("run", "step", F.round("total_loss", 6).alias("loss")))


@query("running_loss", O.with_(O.TRAIN_LOG, O.TOTALS) + """
select run, step, task, round(loss, 6) as loss,
       round(1e-9 + avg(loss) over (partition by run, task order by step
                                    rows between unbounded preceding and current row), 6) as running_mean
from tasklog""")
def q_running_loss(spark, sf):
    """Means that end in an exact half of the last digit are rounded up, whatever the
    order of the additions (hence 1e-9)."""
    log = TL.with_total(FX.train_log(spark, sf))
    return TL.running_loss(log).withColumns({"loss": F.round("loss", 6), "running_mean": F.round(F.col("running_mean") + 1e-9, 6)})


@query("masked_ce", O.with_(O.LOGITS, """
ce as (select label, list_max(logits) + ln(list_sum(list_transform(logits, lambda x: exp(x - list_max(logits)))))
                     - logits[label + 1] as ce
       from logits where label <> -100)""") + """
select label, round(avg(ce), 6) as mean_ce, count(*) as n from ce group by label""")
def q_masked_ce(spark, sf):
    r = TL.masked_ce(FX.logits(spark, sf), "logits", "label", -100, by=["label"])
    return r.withColumn("mean_ce", F.round("mean_ce", 6))


@query("argmax", O.with_(O.LOGITS) + """
select id, label, cast(list_position(logits, list_max(logits)) - 1 as int) as pred from logits""")
def q_argmax(spark, sf):
    lg = FX.logits(spark, sf)
    return lg.select("id", "label", TL.argmax("logits").alias("pred"))


# ---------------------------------------------------------------- O3, A17, S10, S11
from domainlab.operators import split as SP  # noqa: E402

SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED = O.SPLIT_TRAIN, O.SPLIT_VAL, O.SPLIT_SEED

_SPLIT_SQL = O.with_(O.PREPARED, f"""
ranked as (
  select year, label, domain,
         row_number() over (partition by year, label order by md5('{SPLIT_SEED}' || ':' || domain), domain) as rn
  from domains),
splits as (
  select year, label, domain,
         case when rn <= {SPLIT_TRAIN} then 'train' when rn <= {SPLIT_TRAIN + SPLIT_VAL} then 'val' else 'test' end
           as split
  from ranked)""")


def _prepared(spark, sf):
    """The prepared domains, written once for all passes that a query makes over them."""
    return _written(prep.prepared_names(FX.raw_domains(spark, sf), mini_index(spark)), "domains")


def _written(df, tag):
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _labelled(rows):
    return SP.exact_split(rows, "domain", ["year", "label"], SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED, written=True)


def _splits(spark, sf):
    return _labelled(_prepared(spark, sf))


@query("split_exact", _SPLIT_SQL + "select year, label, domain, split from splits")
def q_split_exact(spark, sf):
    return _splits(spark, sf)


@query("check_split", _SPLIT_SQL + """
select year, label, count_if(split = 'train') as n_train, count_if(split = 'val') as n_val,
       count_if(split = 'test') as n_test, count(*) as n_total,
       count_if(split = 'train') + count_if(split = 'val') + count_if(split = 'test') = count(*) as conserved
from splits group by year, label""")
def q_check_split(spark, sf):
    return SP.check_split(_splits(spark, sf), ["year", "label"])


@query("split_report", _SPLIT_SQL + """,
per as (select domain, count(distinct split) as ns from splits group by domain)
select split, count(*) as rows, count_if(ns > 1) as overlap_rows from splits join per using (domain)
group by split""")
def q_split_report(spark, sf):
    return SP.split_report(_splits(spark, sf))


@query("ingest_report", O.with_(O.RAW_DOMAINS) + """
select family as source_file, count(*) as rows,
       sum(count(*)) over (order by family rows between unbounded preceding and current row) as running_total
from raw_domains where not coalesce(contains(lower(domain), '_'), false) group by family""")
def q_ingest_report(spark, sf):
    raw = prep.drop_underscore(FX.raw_domains(spark, sf)).withColumnRenamed("family", "source_file")
    return SP.ingest_report(raw, "source_file")


# ---------------------------------------------------------------- V1-V5, W3, S9
from domainlab.functions.util import ids_text  # noqa: E402
from domainlab.operators import encode as EN  # noqa: E402
from domainlab.operators import samples as SM  # noqa: E402

CHAR_L = 82
_SPECIALS_SQL = ", ".join(f"('{t}', {i}, 'special')" for i, t in enumerate(vocab.SPECIAL_TOKENS))
_CHARS_SQL = ", ".join(f"('{c}', {i})" for i, c in enumerate(vocab.CHAR_ALPHABET))


def _train_rows(splits):
    """The training set: train and test rows of 2017-2019; validation rows stay apart."""
    return splits.where(F.col("year").between(2017, 2019) & F.col("split").isin("train", "test")).drop("split")


def _train_tlds(splits):
    """The thresholded TLD table, written: it is read several times."""
    return _written(vocab.tld_counts(_train_rows(splits), "domain", 10), "tlds")


def _char_vocab(splits):
    return vocab.char_vocab(_train_tlds(splits))


_VOCAB_SQL = O.with_(O.PREPARED, O.vocab_ctes(), f"""
specials(token, id, kind) as (values {_SPECIALS_SQL}),
chars(token, pos) as (values {_CHARS_SQL}),
tldvocab as (select token, id, 'special' as kind from specials union all select token, id, 'tld' from tldv),
charvocab as (select * from tldvocab union all
              select token, cast(pos + (select count(*) from tldvocab) as int) as id, 'char' from chars)""")


@query("tld_vocab", _VOCAB_SQL + " select token, id, kind from tldvocab")
def q_tld_vocab(spark, sf):
    return vocab.tld_vocab(_train_tlds(_splits(spark, sf)))


@query("char_vocab", _VOCAB_SQL + " select token, id, kind from charvocab")
def q_char_vocab(spark, sf):
    return _char_vocab(_splits(spark, sf))


@query("max_special_id", _VOCAB_SQL + """
select cast(max(id) as int) as max_special_id from charvocab where kind in ('special', 'tld')""")
def q_max_special_id(spark, sf):
    return vocab.max_special_id(_char_vocab(_splits(spark, sf)))


@query("vocab_roundtrip", _VOCAB_SQL + " select token, id, kind from charvocab")
def q_vocab_roundtrip(spark, sf):
    from domainlab.session import scratch_path
    path = scratch_path(spark, "vocab")
    v = _char_vocab(_splits(spark, sf))
    vocab.save_vocab(v, path)
    n = v.count()
    return vocab.load_vocab(spark, path, expect_size=n)


@query("word_counts", O.with_(O.PREPARED, O.TRAIN, """
corpus as (select distinct domain from traindom where domain is not null)""") + f"""
select word, count(*) as count
from (select unnest(regexp_extract_all(lower(domain), '{TK.WORD_PATTERN.replace("(?U)", "")}', 1)) as word from corpus) t
group by word""")
def q_word_counts(spark, sf):
    return vocab.word_counts(_train_rows(_splits(spark, sf)), "domain")


# ---------------------------------------------------------------- J1-J3, K1, K3, K4, K6, K8
_ENC_SQL = O.with_(O.PREPARED, O.vocab_ctes(), O.encoded_cte())


def _encoded(spark, sf):
    """The prepared domains and the character vocabulary, from one preparation."""
    d = _prepared(spark, sf)
    return d, EN.Vocab.from_table(_char_vocab(_labelled(d)))


def _per_name(rows, **columns):
    """``rows`` with these columns, which depend on the name alone and are made once per name."""
    return _dealt(prep.by_name(rows), **columns)


def _dealt(names, **columns):
    made = names.select("domain", "_in", *[c.alias(k) for k, c in columns.items()])
    return prep.each_row(made, "domain", *columns).select("year", "label", "domain", *columns)


@query("encode_char", _ENC_SQL + f" select year, label, domain, {O.txt('ids')} as ids from enc")
def q_encode_char(spark, sf):
    d, v = _encoded(spark, sf)
    return _per_name(d, ids=ids_text(EN.encode_char("domain", v)))


@query("encode_tld", O.with_(O.PREPARED, O.vocab_ctes(), O.CUT) + """
select year, label, domain, array_to_string(coalesce(tids, []::int[]), ' ') as tld_ids
from domains left join tlids using (domain)""")
def q_encode_tld(spark, sf):
    d, v = _encoded(spark, sf)
    return d.select("year", "label", "domain", ids_text(EN.tld_ids("domain", v)).alias("tld_ids"))


@query("decode", O.with_(O.PREPARED, O.vocab_ctes(), O.CUT, f"""
tltoks as (
  select t.domain, list(coalesce(v.token, '[SPARSE_TLD]') order by t.pos) as toks
  from (select domain, unnest(tl) as token, unnest(range(1, len(tl) + 1)) as pos from cut) t
  left join tldv v on v.token = t.token group by t.domain)""") + f"""
select year, label, domain, array_to_string(list_concat(
  list_transform(regexp_extract_all(sld, '(?s).', 0),
                 lambda x: case when strpos('{vocab.CHAR_ALPHABET}', x) > 0 then x else '[UNK]' end),
  coalesce(toks, []::varchar[])), ' ') as tokens
from domains join cut using (domain) left join tltoks using (domain)""")
def q_decode(spark, sf):
    d, v = _encoded(spark, sf)
    return d.select("year", "label", "domain", EN.decode(EN.encode_char("domain", v), v).alias("tokens"))


@query("pack_pretrain", _ENC_SQL + f"""
select year, label, domain, {O.txt(O.pack_pretrain_sql('ids', CHAR_L))} as ids from enc""")
def q_pack_pretrain(spark, sf):
    d, v = _encoded(spark, sf)
    return _per_name(d, ids=ids_text(EN.pack_pretrain(EN.encode_char("domain", v), CHAR_L)))


@query("pack_finetune", _ENC_SQL + f"""
select year, label, domain, {O.txt(O.pack_finetune_sql('ids', CHAR_L))} as ids from enc""")
def q_pack_finetune(spark, sf):
    d, v = _encoded(spark, sf)
    return _per_name(d, ids=ids_text(EN.pack_finetune(EN.encode_char("domain", v), CHAR_L)))


@query("template", _ENC_SQL + f"""
select year, label, domain, {O.txt('list_concat([2], ids, [3])')} as ids from enc""")
def q_template(spark, sf):
    d, v = _encoded(spark, sf)
    return d.select("year", "label", "domain", ids_text(EN.template(EN.encode_char("domain", v))).alias("ids"))


@query("pad_mask", _ENC_SQL + f"""
select year, label, domain,
       {O.txt(f"list_transform({O.pack_finetune_sql('ids', CHAR_L)}, lambda x: cast(x = 0 as int))")} as mask
from enc""")
def q_pad_mask(spark, sf):
    d, v = _encoded(spark, sf)
    m = F.transform(EN.pad_mask(EN.pack_finetune(EN.encode_char("domain", v), CHAR_L)), lambda b: b.cast("int"))
    return _per_name(d, mask=ids_text(m))


# ---------------------------------------------------------------- M1-M4
_SAMPLES_SQL = O.with_(O.PREPARED, O.vocab_ctes(), O.encoded_cte(), O.samples_ctes(CHAR_L))


def _packed(spark, sf):
    d, v = _encoded(spark, sf)
    d = prep.by_name(d).withColumn("_ids", EN.encode_char("domain", v))   # samples depend on the name alone
    return d.withColumn("p", EN.pack_pretrain("_ids", CHAR_L)).drop("_ids"), v


@query("make_mtp", _SAMPLES_SQL + f"""
select year, label, domain, {O.txt('x_mtp')} as x_mtp, {O.txt('y_mtp')} as y_mtp from samples""")
def q_make_mtp(spark, sf):
    p, v = _packed(spark, sf)
    s = SM.add_mtp(p, "p", "domain", v.max_special_id)
    return _dealt(s, x_mtp=ids_text("x_mtp"), y_mtp=ids_text("y_mtp"))


@query("make_tpp", _SAMPLES_SQL + f"""
select year, label, domain, {O.txt('x_tpp')} as x_tpp, {O.txt('y_tpp')} as y_tpp from samples""")
def q_make_tpp(spark, sf):
    p, v = _packed(spark, sf)
    s = SM.add_tpp(p, "p", "domain", v.max_special_id)
    return _dealt(s, x_tpp=ids_text("x_tpp"), y_tpp=ids_text("y_tpp"))


@query("make_tov", _SAMPLES_SQL + f"""
select year, label, domain, {O.txt('x_tov')} as x_tov, y_tov from samples""")
def q_make_tov(spark, sf):
    p, v = _packed(spark, sf)
    s = SM.add_tov(p, "p", "domain", v.max_special_id, CHAR_L)
    return _dealt(s, x_tov=ids_text("x_tov"), y_tov=F.col("y_tov"))


@query("pretrain_samples", _SAMPLES_SQL + f"""
select year, label, domain, {O.txt('x_mtp')} as x_mtp, {O.txt('y_mtp')} as y_mtp, {O.txt('x_tpp')} as x_tpp,
       {O.txt('y_tpp')} as y_tpp, {O.txt('x_tov')} as x_tov, y_tov from samples""")
def q_pretrain_samples(spark, sf):
    p, v = _packed(spark, sf)
    s = SM.pretrain_samples(p, "p", "domain", v.max_special_id, CHAR_L)
    return _dealt(s, **{c: ids_text(c) for c in ("x_mtp", "y_mtp", "x_tpp", "y_tpp", "x_tov")}, y_tov=F.col("y_tov"))


# ---------------------------------------------------------------- S1-S3, S5-S7
from domainlab.session import scratch_path  # noqa: E402
from domainlab.sources import readers as RD  # noqa: E402


@query("scan_ranked", O.with_(O.RAW_DOMAINS) + """
select doc_id as rank, domain, family || '.csv' as list_name from raw_domains where label = 0""")
def q_scan_ranked(spark, sf):
    """Write the benign rows as header-less ``rank,domain`` CSV, one folder per
    source, then read them back through two globs in one scan."""
    base = scratch_path(spark, "ranked")
    raw = FX.raw_domains(spark, sf).where("label = 0")
    (raw.select(F.col("doc_id").alias("rank"), "domain", F.col("family").alias("list"))
        .write.partitionBy("list").option("header", False).csv(base))
    df = RD.read_ranked_list(spark, [f"{base}/list=*1/*.csv", f"{base}/list=*[!1]/*.csv"])
    name = F.concat(F.regexp_extract(F.col("_metadata.file_path"), r"list=([^/]+)/", 1), F.lit(".csv"))
    return df.select("rank", "domain", name.alias("list_name"))


@query("scan_feed", O.with_(O.RAW_DOMAINS) + """
select domain, make_timestamp(year, 1 + doc_id % 12, 1 + doc_id % 28, 0, 0, 0) as valid_from, family
from raw_domains where label = 1""")
def q_scan_feed(spark, sf):
    """Write the DGA rows as a headered feed (domain first, ``valid_from`` as
    text), read it back with the timestamp parsed."""
    base = scratch_path(spark, "feed")
    raw = FX.raw_domains(spark, sf).where("label = 1")
    ts = F.make_timestamp(F.col("year"), 1 + F.col("doc_id") % 12, 1 + F.col("doc_id") % 28,
                          F.lit(0), F.lit(0), F.lit(0))
    (raw.select("domain", F.date_format(ts, "yyyy-MM-dd HH:mm:ss").alias("valid_from"), "family")
        .write.option("header", True).csv(base))
    return RD.read_feed(spark, [f"{base}/*.csv"], ("domain", "valid_from", "family")).select("domain", "valid_from", "family")


@query("in_year_feed", O.with_(O.RAW_DOMAINS) + """
select domain, valid_from from (
  select domain, make_timestamp(year, 1 + doc_id % 12, 1 + doc_id % 28, 0, 0, 0) as valid_from
  from raw_domains where label = 1) t
where valid_from >= timestamp '2019-01-01' and valid_from < timestamp '2020-01-01'""")
def q_in_year_feed(spark, sf):
    """P4 on a feed: the half-open year filter after the CSV read."""
    return prep.in_year(q_scan_feed(spark, sf), "valid_from", 2019).select("domain", "valid_from")


@query("scan_split", _SPLIT_SQL + """
select distinct domain, label from splits where year between 2017 and 2019 and split in ('train', 'test')""")
def q_scan_split(spark, sf):
    """S6 then S3: write the split dataset partitioned by year/label/split, read the
    reference's training set (train + test files of 2017-2019) with partition
    pruning, full-row distinct."""
    base = scratch_path(spark, "splits")
    SP.write_splits(_splits(spark, sf), base)
    df = RD.read_split(spark, base, years=[2017, 2018, 2019], splits=["train", "test"])
    return prep.assemble(df.select("domain", "label"))


@query("scan_family", O.with_(O.PREPARED) + "select family, domain, label from domains")
def q_scan_family(spark, sf):
    base = scratch_path(spark, "families")
    RD.write_families(domains(spark, sf).select("domain", "label", "family"), base)
    return RD.read_families(spark, base).select("family", "domain", "label")


def _through_csv(spark, df, tag):
    """Written as CSV with a header, read back with the columns' types."""
    base = scratch_path(spark, tag)
    RD.write_csv(df, base)
    return RD.read_csv_table(spark, base, df.schema)


@query("write_csv", ORACLE["metrics_by_year"])
def q_write_csv(spark, sf):
    """The by-year metrics table."""
    return _through_csv(spark, MX.metrics_by(FX.predictions(spark, sf), "year", overall=True), "metrics_csv")


@query("write_csv_tlds", ORACLE["tld_counts"])
def q_write_csv_tlds(spark, sf):
    """The suffix frequency table."""
    return _through_csv(spark, vocab.tld_counts(domains(spark, sf), "domain", 10), "tlds_csv")


@query("write_csv_audit", ORACLE["audit_wrap"])
def q_write_csv_audit(spark, sf):
    """The audit table."""
    return _through_csv(spark, _audit(spark, sf)[0], "audit_csv")


# ---------------------------------------------------------------- A14-A16 (embeddings as vectors)
from domainlab.operators import features as FE  # noqa: E402


def _vt_sql(expr: str) -> str:
    return f"array_to_string(list_transform({expr}, lambda x: printf('%.6f', x)), ' ')"


_POOL_SQL = O.with_("""
ex as (select label, vec_id, unnest(cast(embedding as double[])) as v,
              unnest(generate_series(1, len(embedding))) as pos from embeddings)""", """
agg as (select label, pos, max(v) as mx, avg(v) as mn from ex group by label, pos)""", """
pooled as (select label, list(mx order by pos) || list(mn order by pos) as pooled from agg group by label)""", """
cls as (select label, arg_min(cast(embedding as double[]), vec_id) as cls from embeddings group by label)""")


@query("pool_vectors", _POOL_SQL + f" select label, {_vt_sql('pooled')} as pooled from pooled")
def q_pool_vectors(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    return FE.pool_rows(e, "label", "embedding").select("label", FE.vec_text("pooled").alias("pooled"))


@query("cls_vector", _POOL_SQL + f" select label, {_vt_sql('cls')} as cls from cls")
def q_cls_vector(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    return FE.first_vector(e, "label", "embedding", "vec_id").select("label", FE.vec_text("cls").alias("cls"))


@query("fuse", _POOL_SQL + f" select label, {_vt_sql('pooled || cls')} as fused from pooled join cls using (label)")
def q_fuse(spark, sf):
    e = FX.table(spark, sf, "embeddings")
    p = FE.pool_rows(e, "label", "embedding")
    c = FE.first_vector(e, "label", "embedding", "vec_id")
    return p.join(c, "label").select("label", FE.vec_text(FE.fuse("pooled", "cls")).alias("fused"))


# ---------------------------------------------------------------- V3, K5, K2, K7, M5
from domainlab.operators import wordpiece as WP  # noqa: E402

WP_VOCAB_SIZE, WP_MIN_FREQ, SUBWORD_L = 32_393, 2, 35


def _word_counts(splits):
    return vocab.word_counts(_train_rows(splits), "domain")


@query("wordpiece_pairs", O.with_(O.PREPARED, O.TRAIN, """
corpus as (select distinct domain from traindom where domain is not null)""", f"""
wc as (select word, count(*) as n
       from (select unnest(regexp_extract_all(lower(domain), '{TK.WORD_PATTERN.replace("(?U)", "")}', 1)) as word
             from corpus) t group by word)""", """
sym as (select n, list_transform(regexp_extract_all(word, '(?s).', 0),
                                 lambda c, i: case when i = 1 then c else '##' || c end) as s from wc)""", """
pairs as (select n, unnest(list_transform(range(1, len(s)), lambda i: struct_pack(a := s[i], b := s[i + 1]))) as p
          from sym where len(s) > 1)""") + """
select p.a as l_sym, p.b as r_sym, sum(n) as count from pairs group by p.a, p.b""")
def q_wordpiece_pairs(spark, sf):
    """First-round pair counts of the WordPiece trainer (V3 input)."""
    wc = _word_counts(_splits(spark, sf))
    words = wc.select(F.col("count").cast("long").alias("n"), WP.initial_symbols("word").alias("symbols"))
    return WP.pair_counts(words).select(F.col("left").alias("l_sym"), F.col("right").alias("r_sym"), "count")


def _kept_splits(spark, sf):
    """The labelled rows, written: subword training and encoding pass over them several times."""
    return _written(_splits(spark, sf), "splits")


def _subword_vocab(splits):
    tl = [r["tld"] for r in _train_tlds(splits).limit(WP.MAX_VOCAB).collect()]
    return WP.train_wordpiece(_word_counts(splits), WP_VOCAB_SIZE, WP_MIN_FREQ,   # TLDs count in the size
                              specials=vocab.SPECIAL_TOKENS + tl)


@query("wordpiece_vocab")
def q_wordpiece_vocab(spark, sf):
    return _subword_vocab(_kept_splits(spark, sf))


def _subword_frame(splits):
    """All names (:func:`prep.by_name`) with their subword ids followed by the TLD ids, and the
    subword vocabulary."""
    wv = _subword_vocab(splits)
    vd = WP.vocab_dict(wv)
    cv = EN.Vocab.from_table(wv.where("kind = 'special'").withColumn(
        "kind", F.when(F.col("id") >= len(vocab.SPECIAL_TOKENS), F.lit("tld")).otherwise(F.col("kind"))))
    d = prep.by_name(splits).withColumn("_sld", TK.strip_tlds("domain"))
    d = WP.wordpiece_encode(d, "_sld", vd, "_wp")
    return d.withColumn("x_token_raw", F.concat("_wp", EN.tld_ids("domain", cv))).drop("_sld", "_wp"), vd


@query("encode_subword")
def q_encode_subword(spark, sf):
    d, _ = _subword_frame(_kept_splits(spark, sf))
    return _dealt(d, ids=ids_text("x_token_raw"))


@query("encode_external")
def q_encode_external(spark, sf):
    """K7. The subword vocabulary trained here stands in for the one a user would bring."""
    s = _kept_splits(spark, sf)
    e = WP.encode_external(prep.by_name(s.drop("split")), "domain", WP.vocab_dict(_subword_vocab(s)), SUBWORD_L)
    return _dealt(e, ext_ids=ids_text("ext_ids"), ext_mask=ids_text("ext_mask"))


def _branch_columns(splits):
    """All names with token ids (K2 + K4, L=35), char ids (K1 + K4, L=82), and external ids and
    their mask (K7, L=35), as ``token``, ``char``, ``external``, ``external_mask``."""
    d, vd = _subword_frame(splits)
    v = EN.Vocab.from_table(_char_vocab(splits))
    d = WP.encode_external(d.withColumn("_c", EN.encode_char("domain", v)), "domain", vd, SUBWORD_L,
                           "external", "external_mask")
    return (d.withColumn("token", EN.pack_finetune("x_token_raw", SUBWORD_L))
            .withColumn("char", EN.pack_finetune("_c", CHAR_L)).drop("x_token_raw", "_c"))


@query("finetune_samples")
def q_finetune_samples(spark, sf):
    """M5: token, char and external ids with their mask, and the label."""
    d = _branch_columns(_kept_splits(spark, sf))
    d = _dealt(d, x_token=ids_text("token"), x_char=ids_text("char"), ext_ids=ids_text("external"),
               ext_mask=ids_text("external_mask"))
    return d.select("year", "domain", "label", "x_token", "x_char", "ext_ids", "ext_mask")


# ---------------------------------------------------------------- D1-D6 (rows checks)
from domainlab.plans import model as MD  # noqa: E402

W2V_DIM = 16
BRANCHES = ("token", "char")
#: The third branch; its positions are pooled under its attention mask.
EXTERNAL = "external"
TRAIN_YEARS = (2017, 2018, 2019)
#: Which branches a variant reads, and how each one's positions become one vector.
VARIANTS = {f"{name}_{mode}": (branches, mode) for mode in ("pool", "cls")
            for name, branches in (("token", ("token",)), ("char", ("char",)), ("both", BRANCHES),
                                   ("external", (EXTERNAL,)), ("all", (*BRANCHES, EXTERNAL)))}


def _sequences(spark, sf):
    """Fine-tune packs, which begin with CLS, of all branches: what the classifier reads, one
    row per name. ``learn`` holds the labels that the name has in the training set (train and
    test rows of 2017-2019). Written once, since vectors, fit and scoring each pass over it."""
    d = _branch_columns(_kept_splits(spark, sf))
    train = F.filter("_in", lambda r: r["year"].isin(*TRAIN_YEARS) & r["split"].isin("train", "test"))
    return _written(d.select(
        "domain", F.transform("_in", lambda r: F.struct(r["year"], r["label"])).alias("_in"),
        F.array_distinct(F.transform(train, lambda r: r["label"])).alias("learn"),
        *BRANCHES, EXTERNAL, f"{EXTERNAL}_mask"), "sequences")


def _rows(names):
    """The rows of all names, with the names' features."""
    return prep.each_row(names, "domain", "features")


def _training(names):
    """The training set: one row per (domain, label)."""
    return names.select(*[c for c in names.columns if c not in ("_in", "learn")], F.explode("learn").alias("label"))


def _test(names):
    """The rows of the years after the training set."""
    return _rows(names).where(~F.col("year").isin(*TRAIN_YEARS))


def _vectors(seq, branches=BRANCHES):
    return {b: MD.vector_table(_branch_vectors(seq, b)) for b in branches}


def _branch_vectors(seq, branch):
    """The learner passes over its rows twice: each branch's training rows are shuffled once by
    (domain, label) and read in that order."""
    return MD.token_vectors(_training(seq).dropDuplicates(["domain", "label"]), branch, W2V_DIM)


def _features(seq, vectors, branches=BRANCHES, mode="pool", out="features", drop=True):
    masks = {EXTERNAL: f"{EXTERNAL}_mask"}
    f = MD.domain_features(seq, {b: (b, vectors[b], W2V_DIM, masks.get(b)) for b in branches}, mode, out)
    return f.drop(*BRANCHES, EXTERNAL, *masks.values()) if drop else f


def _both_features(spark, sf):
    """Features of all names, written: the fit passes over them more than once."""
    seq = _sequences(spark, sf)
    return _written(_features(seq, _vectors(seq)), "features")


@query("token_vectors")
def q_token_vectors(spark, sf):
    seq = _sequences(spark, sf)
    out = None
    for b in BRANCHES:
        v = _branch_vectors(seq, b).select(F.lit(b).alias("branch"), "id", FE.vec_text("vector").alias("vector"))
        out = v if out is None else out.unionByName(v)
    return out


@query("domain_features")
def q_domain_features(spark, sf):
    seq = _sequences(spark, sf)
    # names without a position have no features, the others no NULL among them
    return _dealt(_features(seq, _vectors(seq)), dim=F.size("features"), features=FE.vec_text_arrow("features"))


@query("feature_lookup", _ENC_SQL + "," + f"""
looked as (select year, label, domain, {O.pack_finetune_sql('ids', CHAR_L)} as p from enc),
dims as (select *, list_transform(p, lambda i: cast(least(i, 40) as double) / 8) as a,
                list_transform(p, lambda i: cast(i % 5 as double)) as b from looked)
select year, label, domain, {_vt_sql("[list_max(a), list_max(b), list_avg(a), list_avg(b)]")} as features from dims""")
def q_feature_lookup(spark, sf):
    """D3 with fixed vectors (least(id, 40) / 8, id mod 5), so that pooling has an oracle."""
    d, v = _encoded(spark, sf)
    table = {i: [min(i, 40) / 8, float(i % 5)] for i in v.id_to_token}
    d = prep.by_name(d).withColumn("p", EN.pack_finetune(EN.encode_char("domain", v), CHAR_L))
    f = FE.pool_positions(d, "p", table, 2, "features")
    return _dealt(f, features=FE.vec_text("features"))


@query("feature_lookup_masked", _ENC_SQL + "," + f"""
looked as (select year, label, domain, {O.pack_finetune_sql('ids', CHAR_L)} as p from enc),
shown as (select year, label, domain, list_filter(p, lambda i: i <> 0 and i % 3 <> 1) as p from looked),
dims as (select *, list_transform(p, lambda i: cast(least(i, 40) as double) / 7) as a,
                list_transform(p, lambda i: cast(i % 5 as double)) as b from shown)
select year, label, domain, {_vt_sql("[list_max(a), list_max(b), list_avg(a), list_avg(b)]")} as features,
       {_vt_sql("[a[1], b[1]]")} as first from dims""")
def q_feature_lookup_masked(spark, sf):
    """D3 under an attention mask, as for the external branch, with fixed vectors;
    the mask also hides every id of remainder 1 by 3."""
    d, v = _encoded(spark, sf)
    table = {i: [min(i, 40) / 7, float(i % 5)] for i in v.id_to_token}
    d = d.withColumn("p", EN.pack_finetune(EN.encode_char("domain", v), CHAR_L))
    d = d.withColumn("m", F.transform("p", lambda x: ((x != 0) & (x % 3 != 1)).cast("int")))
    for out, mode in (("features", "pool"), ("first", "cls")):
        d = FE.pool_positions(d, "p", table, 2, out, mode, mask="m")
    return d.select("year", "label", "domain", FE.vec_text("features").alias("features"), FE.vec_text("first").alias("first"))


@query("fit_classifier")
def q_fit_classifier(spark, sf):
    m = MD.fit_classifier(_training(_both_features(spark, sf)))
    lr = m.stages[-1]
    coef = [float(x) for x in lr.coefficients.toArray()]
    return spark.createDataFrame([(float(lr.intercept), len(coef), coef)],
                                 "intercept double, n_features int, coefficients array<double>")


@query("score_domains")
def q_score_domains(spark, sf):
    f = _both_features(spark, sf)
    m = MD.fit_classifier(_training(f))
    return MD.score(m, _test(f)).select("year", "domain", "y_true", "y_pred")


@query("forward_chain")
def q_forward_chain(spark, sf):
    f = _both_features(spark, sf)
    return MD.forward_chain(_rows(f), train_years=TRAIN_YEARS, train=_training(f))


@query("ablation")
def q_ablation(spark, sf):
    """One metrics row per variant: token, char, both or external branch, or all three,
    pooled or first position. The vectors are learned once, and every branch pooled once in each
    way, for all variants; a variant's features are its branches' columns side by side."""
    seq = _sequences(spark, sf)
    every = (*BRANCHES, EXTERNAL)
    vectors = _vectors(seq, every)
    made = seq
    for mode in ("pool", "cls"):
        for b in every:
            made = _features(made, vectors, (b,), mode, f"{b}_{mode}", drop=False)
    made = _written(made.select("domain", "_in", "learn", *[f"{b}_{mode}" for mode in ("pool", "cls") for b in every]),
                    "features")
    out = None
    for name, (branches, mode) in VARIANTS.items():
        f = made.select("domain", "_in", "learn", FE.fuse(*[f"{b}_{mode}" for b in branches]).alias("features"))
        m = MD.fit_classifier(_training(f))
        r = MX.metrics_overall(MD.score(m, _test(f))).withColumn("variant", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- T7, O4, V6
from domainlab.functions import normalize as NZ  # noqa: E402


@query("normalize_words", """
select w as word, strip_accents(lower(w)) as normalized
from (select distinct unnest(regexp_extract_all(text, '[^\\s]+')) as w from documents) t""")
def q_normalize_words(spark, sf):
    """T7 on every distinct whitespace-separated token of the documents (four
    languages): ASCII tokens stay in the JVM, the rest go through the UDF."""
    docs = FX.table(spark, sf, "documents").select("text")
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), 1)).alias("word")).distinct()
    return NZ.normalize_frame(words, "word", "normalized")


EPOCH_SEED = 42


@query("epoch_batches", O.with_(O.PREPARED) + f"""
select domain, year, label, e.epoch,
       cast(floor((row_number() over (partition by e.epoch
                                      order by md5('{EPOCH_SEED}:' || cast(e.epoch as varchar) || ':' || domain),
                                               domain, year, label) - 1) / 128) as bigint) as batch_id
from (select distinct domain, year, label from domains where year between 2017 and 2019) d,
     (select unnest([0, 1]) as epoch) e""")
def q_epoch_batches(spark, sf):
    """O4 + W4: a fresh seeded shuffle per epoch, cut into batches of 128."""
    d = domains(spark, sf).where(F.col("year").between(2017, 2019)).select("domain", "year", "label").distinct()
    x = d.withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))   # one copy per epoch
    x = x.withColumn("_o", F.md5(F.concat(F.lit(f"{EPOCH_SEED}:"), F.col("epoch").cast("string"),
                                          F.lit(":"), F.col("domain"))))
    return TL.batch_ids(x, ["_o", "domain", "year", "label"], 128, ["epoch"]).drop("_o")


from domainlab.operators import permute as PM  # noqa: E402

EPOCHS = (0, 1)


def _permuted_sql() -> str:
    """The permutation in SQL: numbers by one sort, then the rounds as columns that build on one
    another; numbers beyond the rows go round again."""
    p = PM.PRIME
    keys = {e: PM.round_keys(EPOCH_SEED, e) for e in EPOCHS}
    names = [f"k{i}, m{i}, c{i}" for i in range(PM.ROUNDS)]
    values = ", ".join(f"({e}, {', '.join(str(x) for k in ks for x in k)})" for e, ks in keys.items())
    steps = ["x // b as l0", "x % b as r0"]
    for i in range(PM.ROUNDS):
        here, other, size = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        steps += [f"({other}{i} + k{i}) % {p} as t{i}",
                  f"({here}{i} + (t{i} * t{i} % {p} * m{i} + c{i}) % {p}) % {size} as {here}{i + 1}",
                  f"{other}{i} as {other}{i + 1}"]

    def once(source: str) -> str:
        return (f"select epoch, x0, l{PM.ROUNDS} * b + r{PM.ROUNDS} as x from (select epoch, x0, b, {', '.join(steps)} "
                f"from {source} join keys using (epoch), dims) t")
    return O.with_(O.PREPARED, """
kept as (select distinct domain, year, label from domains where year between 2017 and 2019)""", """
numbered as (
  select *, row_number() over (order by md5(concat_ws(chr(31), domain, cast(year as varchar), cast(label as varchar))),
                                        domain, year, label) - 1 as x0 from kept)""", """
dims as (select n, a, greatest(cast(ceil(n / a) as bigint), 1) as b
         from (select n, greatest(cast(ceil(sqrt(n)) as bigint), 1) as a from (select count(*) as n from kept)))""", f"""
keys(epoch, {', '.join(names)}) as (values {values})""", f"""
walk as ({once("(select epoch, x0, x0 as x from numbered, (select epoch from keys))")}
  union all
  {once("(select walk.* from walk, dims where x >= n)")})""").replace("with ", "with recursive ", 1) + """
select domain, year, label, epoch, x as place, x // 128 as batch_id
from walk join numbered using (x0) where x < (select n from dims)"""


@query("epoch_permuted", _permuted_sql())
def q_epoch_permuted(spark, sf):
    """O4 + W4 without a sort per epoch: the training rows are numbered and written once; each
    epoch is a narrow pass in which a row computes its place and batch."""
    d = domains(spark, sf).where(F.col("year").between(2017, 2019)).select("domain", "year", "label").distinct()
    rows = _written(PM.number_rows(d, ["domain", "year", "label"]), "numbered")
    n, out = rows.count(), None
    for e in EPOCHS:
        x = PM.permuted(PM.epoch_batches(rows, "row_no", n, EPOCH_SEED, e), "row_no", n, EPOCH_SEED, e)
        x = x.select("domain", "year", "label", "epoch", "place", "batch_id")
        out = x if out is None else out.unionByName(x)
    return out


from domainlab.operators import resume as RS  # noqa: E402


@query("split_resumed", _SPLIT_SQL + """
select year, label, split, count(*) as rows, case when year <= 2020 then 'first' else 'second' end as run
from splits group by year, label, split""")
def q_split_resumed(spark, sf):
    """S6 taken up again: a run over the years to 2020, a run over all years that writes the
    others alone, and a third that finds nothing to do; rows as they lie, and who wrote them."""
    rows = _splits(spark, sf)
    path = scratch_path(spark, "resumed")
    parts = _written(rows.select(*RS.PARTITION_BY).distinct(), "partitions")
    RS.write_resumable(rows, path, "first", wanted=parts.where("year <= 2020"))
    for run in ("second", "third"):
        RS.write_resumable(rows, path, run, wanted=parts)
    here = RS.lying(spark, path, rows.schema)
    return here.join(RS.manifest(spark, path, rows.schema), [*RS.PARTITION_BY, "rows"], "left")


@query("wordpiece_vocab_basic")
def q_wordpiece_vocab_basic(spark, sf):
    """V6: the older variant, five specials and no TLD tokens."""
    return WP.train_wordpiece(_word_counts(_splits(spark, sf)), WP_VOCAB_SIZE, WP_MIN_FREQ,
                              specials=["[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]"])


# ---------------------------------------------------------------- A2/A3 on buckets, J2/D3 of any size, D4/W1, ST1
from domainlab.operators import bucketed as BK  # noqa: E402
from domainlab.operators import lookup as LK  # noqa: E402
from domainlab.plans import head as HD  # noqa: E402
from domainlab.streaming import prepare as ST  # noqa: E402


def _named_sql() -> str:
    each = [f"select distinct '{name}' as name, domain, label from splits where year in ({', '.join(map(str, years))}) "
            f"and split in ({', '.join(repr(x) for x in kinds)})" for name, (years, kinds) in BK.NAMED_SPLITS.items()]
    return _SPLIT_SQL + " union all ".join(each)


@query("assemble_named", _named_sql())
def q_assemble_named(spark, sf):
    """A2/A3: all nine named splits, distinct, from one pass over the table bucketed by domain."""
    path = scratch_path(spark, "bucketed")
    table = path.rsplit("/", 1)[1].replace("-", "_")
    BK.write_bucketed(_splits(spark, sf), table, path)
    return BK.all_named_splits(spark, table)


@query("encode_char_joined", ORACLE["encode_char"])
def q_encode_char_joined(spark, sf):
    """K1 the way it goes for vocabularies beyond the lookup's bound."""
    d = _prepared(spark, sf)
    e = LK.encode_char(d, "domain", _char_vocab(_labelled(d)), "ids", bound=0)
    return e.select("year", "label", "domain", ids_text("ids").alias("ids"))


@query("feature_lookup_joined", ORACLE["feature_lookup"])
def q_feature_lookup_joined(spark, sf):
    """D3 the way it goes for vector tables beyond the lookup's bound, with the fixed vectors
    of ``feature_lookup``."""
    d, v = _encoded(spark, sf)
    ids = spark.range(max(v.id_to_token) + 1).select(F.col("id").cast("int").alias("id"))
    vectors = ids.select("id", F.array(F.least("id", F.lit(40)) / 8, (F.col("id") % 5).cast("double")).alias("vector"))
    d = prep.by_name(d).withColumn("p", EN.pack_finetune(EN.encode_char("domain", v), CHAR_L))
    f = LK.pool_positions(d, "p", vectors, 2, "features", bound=0)
    return _dealt(f, features=FE.vec_text("features"))


HEAD_STEPS, HEAD_INTERVAL = 30, 10


def _head_rows(spark, sf):
    """All prepared names with their pooled character features, made once per name and written:
    ``fold`` is train or val within the training years, test after them. Two tables: the rows
    to fit on, alike rows once with their number ``n``, and the test rows."""
    p = _written(domains(spark, sf).select("year", "label", "domain", "family"), "domains")
    s = _labelled(p)
    v = EN.Vocab.from_table(_char_vocab(s))
    early = F.col("year").isin(*TRAIN_YEARS)
    fold = F.when(~early, F.lit("test")).when(F.col("split") == "val", F.lit(HD.VAL)).otherwise(F.lit(HD.TRAIN))
    names = prep.by_name(s.select("year", "label", "domain", "family", fold.alias("fold")))
    seq = _written(names.withColumn("char", EN.pack_finetune(EN.encode_char("domain", v), CHAR_L)), "sequences")
    train = prep.each_row(seq, "char").where(F.col("fold") == HD.TRAIN)
    vectors = MD.vector_table(MD.token_vectors(train, "char", W2V_DIM))
    f = MD.domain_features(seq, {"char": ("char", vectors, W2V_DIM)})
    f = _written(f.select("_in", F.col("features").cast("array<float>").alias("features")), "features")
    kinds = F.array_distinct(F.transform("_in", lambda r: F.struct(r["label"], r["fold"])))
    counted = F.transform(kinds, lambda k: F.struct(
        k["label"], k["fold"],
        F.size(F.filter("_in", lambda r: r["label"].eqNullSafe(k["label"]) & (r["fold"] == k["fold"]))).alias("n")))
    fit = prep.each_row(f.select("features", counted.alias("_in")), "features").where(F.col("fold") != "test")
    return _written(fit, "fit"), prep.each_row(f, "features").where(F.col("fold") == "test")


@query("head_log")
def q_head_log(spark, sf):
    """The log of a fit of the two-layer head: each step's training and
    validation loss, the mean of its interval, and whether it became the best checkpoint."""
    log = HD.fit_head(_head_rows(spark, sf)[0], steps=HEAD_STEPS, weight="n").log_frame(spark)
    best = TL.best_checkpoints(log.where(F.col("task") == HD.VAL)).select("run", "step", "task", F.lit(True).alias("best"))
    mean = TL.interval_loss(log, HEAD_INTERVAL).select("run", "task", "interval", "mean_loss")
    at = F.floor((F.col("step") - 1) / HEAD_INTERVAL).cast("long")
    return (log.withColumn("interval", at).join(mean, ["run", "task", "interval"], "left")
            .join(best, ["run", "step", "task"], "left")
            .select("run", "step", "task", F.round("loss", 6).alias("loss"), "interval",
                    F.round("mean_loss", 6).alias("mean_loss"), F.coalesce("best", F.lit(False)).alias("best")))


@query("head_by_family")
def q_head_by_family(spark, sf):
    """Names of the later years scored by the best step of the fit, metrics by
    family and over all."""
    rows, test = _head_rows(spark, sf)
    best = HD.fit_head(rows, steps=HEAD_STEPS, weight="n").best
    scored = HD.score(test, best.logits)
    return MX.metrics_by(scored, "family", overall=True)


STREAM_EVERY, STREAM_DELAY = "1 day", "1 hour"


@query("stream_dedup", """
with w as (select *, time_bucket(interval '1 day', ts, timestamp '1970-01-01') as window_start from events where ts is not null),
r as (select *, row_number() over (partition by window_start, user_id, event_type order by event_id) as rn from w)
select window_start, user_id, event_type, event_id, value from r
where rn = 1 and window_start + interval '1 day' <= (select max(ts) from events) - interval '1 hour'""")
def q_stream_dedup(spark, sf):
    """ST1 with state: the smallest event of each day, user and type, from a stream over the
    events; days that the watermark has not closed are still open and not in it."""
    path = f"{sf.rstrip('/')}/events.parquet"
    # a pattern, since the table may be one file and a stream by plain path wants a folder
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path[:-1] + "[t]")
    zero = "timestamp_ntz'1970-01-01'"   # event times have no zone: read as UTC, whatever the session's
    src = events.select("user_id", "event_type", "event_id", "value",
                        F.timestamp_micros(F.expr(f"timestampdiff(microsecond, {zero}, ts)")).alias("ts"))
    sink, ck = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    ST.run_dedup(src, sink, ck, ["user_id", "event_type"], "ts", STREAM_EVERY, STREAM_DELAY, ["event_id"])
    start = F.expr(f"timestampadd(microsecond, unix_micros(window_start), {zero})").alias("window_start")
    return spark.read.parquet(sink).select(start, "user_id", "event_type", "event_id", "value")
