"""DuckDB statements that state each registered query independently.

The suffix lookup here follows the public-suffix *matching rules* (candidate
suffixes joined to the rule list, exception > longest match) rather than the
trie walk the Spark side uses, so the two sides are separate formulations that
must agree on the fixture data."""

from __future__ import annotations

from domainlab.functions.suffix import IDN_RULES, MINI_RULES_ICANN, MINI_RULES_PRIVATE
from domainlab.functions.tokens import TLD_TOKEN_PATTERN as TLD_RE
from domainlab.operators.vocab import CHAR_ALPHABET
from domainlab.sources.fixtures import AUDIT_SHAPES, FIXTURE_SUFFIXES, IDN_SUFFIXES


# Internationalised labels of the rules and names, ACE and native.
IDN_LABELS = {"xn--p1ai": "рф", "xn--55qx5d": "公司", "xn--gmqw5a": "個人", "xn--j6w193g": "香港", "xn--j1amh": "укр",
              "xn--fiqs8s": "中国", "xn--e1aqjhr": "центр"}


def _rules_values(idn: bool = False) -> str:
    rows = [f"('{r}', false)" for r in MINI_RULES_ICANN + (IDN_RULES if idn else [])] + [
        f"('{r}', true)" for r in MINI_RULES_PRIVATE]
    return ", ".join(rows)


def _native(labels: str) -> str:
    """The labels of a list, those of IDN_LABELS in native form."""
    cases = " ".join(f"when '{a}' then '{n}'" for a, n in IDN_LABELS.items())
    return f"list_transform({labels}, lambda x: case x {cases} else x end)"


IDN_NAMES = f"""
idn_names as (
  select distinct w || '.' || lpad(cast(doc_id % 100 as varchar), 2, '0') || '.' ||
         case doc_id % {len(IDN_SUFFIXES)} {" ".join(f"when {i} then '{x}'" for i, x in enumerate(IDN_SUFFIXES))} end as domain
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from documents) t)"""


_SFX_CASE = " ".join(f"when {i} then '{s}'" for i, s in enumerate(FIXTURE_SUFFIXES))

RAW_DOMAINS = f"""
raw_domains as (
  select w || case when doc_id % 7 = 0 and length(w) = 3 then '_x' else '' end || '.' ||
         case doc_id % 8 {_SFX_CASE} end as domain,
         doc_id, cast(2017 + doc_id % 9 as int) as year, source as family,
         cast(coalesce(toxic, 0) as int) as label
  from (select d.doc_id, d.source, l.toxic, unnest(regexp_extract_all(d.text, '[A-Za-z0-9]+')) as w
        from documents d left join labels l using (doc_id)) t
)"""

PREDICTIONS = """
predictions as (
  select o_orderkey as id, cast(year(o_orderdate) as int) as year, o_orderpriority as family,
         cast(case when year(o_orderdate) = 2001 then 0 when o_orderstatus = 'F' then 1 else 0 end as int) as y_true,
         cast(case when o_totalprice > 250000 then 1 else 0 end as int) as y_pred
  from orders
)"""

TRAIN_LOG = """
train_log as (select 'r0' as run, cast(floor(event_id / 3) + 1 as bigint) as step,
                     case event_id % 3 when 0 then 'mtp' when 1 then 'tpp' else 'tov' end as task, value as loss
              from events)"""

#: steps: one row per step; tasklog: the log's rows and each step's sum as one more task.
TOTALS = """
steps as (select run, step, sum(loss) as loss from train_log group by run, step),
tasklog as (select run, step, task, loss from train_log union all select run, step, 'total', loss from steps)"""

AUDIT_NAMES = f"""
audit_names as (
  select replace(case (doc_id + length(w)) % {len(AUDIT_SHAPES)} {" ".join(f"when {i} then '{s}'" for i, s in enumerate(AUDIT_SHAPES))} end,
                 '{{w}}', w) as domain, source as source_file
  from (select doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) as w from documents) t)"""

LOGITS = """
logits as (select vec_id as id, cast(embedding as double[]) as logits, label from embeddings)"""


def _proc(labels: str, s: str, keep_empty: bool = False) -> str:
    """prefix + wrapped suffix for a suffix of ``s`` labels."""
    n = f"len({labels})"
    sub = f"(case when {n} - {s} - 1 >= 1 then array_to_string({labels}[1:{n} - {s} - 1], '.') else '' end)"
    dom = f"(case when {n} - {s} >= 1 then {labels}[{n} - {s}] else '' end)"
    suf = f"(case when {s} > 0 then {labels}[{n} - {s} + 1:] else []::varchar[] end)"
    if not keep_empty:
        suf = f"list_filter({suf}, lambda p: p <> '')"
    wrapped = f"array_to_string(list_transform({suf}, lambda p: '[.' || p || ']'), '')"
    return f"(concat_ws('.', nullif({sub}, ''), nullif({dom}, '')) || {wrapped})"


def suffix_ctes(src: str, col: str, idn: bool = False) -> str:
    """CTEs ``sfx_rules``, ``sfx_lab``, ``sfx_s`` (d, labels, s_all, s_icann) for the
    distinct values of ``src.col`` (already lower-case)."""
    base = "case when starts_with(rule, '!') then substr(rule, 2) when starts_with(rule, '*.') then substr(rule, 3) else rule end"
    written = "labels"
    if idn:
        base = f"array_to_string({_native(f"string_split({base}, '.')")}, '.')"
        written = _native(written)
    return f"""
sfx_rules0(rule, is_private) as (values {_rules_values(idn)}),
sfx_rules as (
  select rule, is_private,
         case when starts_with(rule, '!') then 'exc' when starts_with(rule, '*.') then 'wild' else 'normal' end as kind,
         {base} as base
  from sfx_rules0
),
sfx_names as (select distinct {col} as d from {src} where {col} is not null),
sfx_lab as (select d, string_split(rtrim(trim(d), '.'), '.') as labels from sfx_names),
sfx_cand as (
  select d, labels, k,
         array_to_string(written[len(labels) - k + 1:], '.') as c,
         case when k >= 2 then array_to_string(written[len(labels) - k + 2:], '.') end as p
  from (select d, labels, {written} as written, unnest(generate_series(1, len(labels))) as k from sfx_lab) t
),
sfx_m as (
  select c.d, c.k, r.kind, r.is_private
  from sfx_cand c join sfx_rules r
    on (r.kind in ('normal', 'exc') and r.base = c.c) or (r.kind = 'wild' and r.base = c.p)
),
sfx_s as (
  select l.d, l.labels,
         coalesce(max(case when m.kind = 'exc' then m.k - 1 end),
                  max(case when m.kind <> 'exc' then m.k end), 0) as s_all,
         coalesce(max(case when m.kind = 'exc' and not m.is_private then m.k - 1 end),
                  max(case when m.kind <> 'exc' and not m.is_private then m.k end), 0) as s_icann
  from sfx_lab l left join sfx_m m using (d)
  group by l.d, l.labels
)"""


def wrap_expr(d: str, labels: str = "labels") -> str:
    """wrap_tld on lower-case ``d`` given the joined ``sfx_s`` columns."""
    parts = f"string_split(trim({d}), '.')"
    r_all = _proc(labels, "s_all")
    r_icann = _proc(labels, "s_icann")
    promoted = (f"({parts}[1] || array_to_string(list_transform(list_filter({parts}[2:], lambda p: p <> ''), "
                f"lambda p: '[.' || p || ']'), ''))")
    return f"""(case when {d} is null or {d} = '' then {d}
      when len({parts}) = 2 then {parts}[1] || '[.' || {parts}[2] || ']'
      when not starts_with({r_all}, '[') then {r_all}
      when not starts_with({r_icann}, '[') then {r_icann}
      else {promoted} end)"""


def v1_expr(d: str, labels: str = "labels") -> str:
    return f"(case when {d} is null or {d} = '' then {d} else {_proc(labels, 's_all', keep_empty=True)} end)"


# prepared per-(year, label) table: lower, underscore filter, wrap, dedup keeping min doc_id
PREPARED = RAW_DOMAINS + """,
prepped as (
  select lower(domain) as d0, doc_id, year, family, label from raw_domains
  where not coalesce(contains(lower(domain), '_'), false)
),""" + suffix_ctes("prepped", "d0") + f""",
wrapped as (
  select p.doc_id, p.year, p.family, p.label, {wrap_expr('p.d0', 's.labels')} as domain
  from prepped p left join sfx_s s on s.d = p.d0
),
domains as (
  select year, label, domain, min(doc_id) as doc_id, arg_min(family, doc_id) as family
  from wrapped group by year, label, domain
)"""


def with_(*ctes: str) -> str:
    return "with " + ",".join(c.strip().rstrip(",") for c in ctes)




#: Exact-size split of each (year, label): rows for training, for validation; seed.
SPLIT_TRAIN, SPLIT_VAL, SPLIT_SEED = 8000, 800, 42

#: traindom: the training set, that is the train and test rows of 2017-2019. The validation
#: rows of those years are kept apart.
TRAIN = f"""
trainranked as (
  select year, label, domain,
         row_number() over (partition by year, label order by md5('{SPLIT_SEED}' || ':' || domain), domain) as rn
  from domains where year between 2017 and 2019),
traindom as (select year, label, domain from trainranked
             where rn <= {SPLIT_TRAIN} or rn > {SPLIT_TRAIN + SPLIT_VAL})"""


def vocab_ctes(th: int = 10) -> str:
    """tldc (tld, c), tldv (token, id), vinfo (off) from the training set."""
    return TRAIN + f""",
tldc as (
  select tld, count(*) as c
  from (select unnest(regexp_extract_all(domain, '{TLD_RE}')) as tld from traindom) t
  where tld is not null group by tld having count(*) >= {th}
),
tldv as (select tld as token, cast(6 + row_number() over (order by c desc, tld) as int) as id from tldc),
vinfo as (select cast(7 + count(*) as int) as off from tldv)"""


#: cut: each domain's bracket tokens (tl) and what is left without them (sld); tlids: the
#: ids of its bracket tokens in order, by a join of the exploded tokens.
CUT = f"""
cut as (
  select domain, tl, list_reduce(list_prepend(low, tl), lambda a, t: replace(a, t, '')) as sld
  from (select domain, lower(domain) as low, regexp_extract_all(lower(domain), '{TLD_RE}') as tl
        from (select distinct domain from domains) u) w
),
tlids as (
  select t.domain, list(coalesce(v.id, 6) order by t.pos) as tids
  from (select domain, unnest(tl) as token, unnest(range(1, len(tl) + 1)) as pos from cut) t
  left join tldv v on v.token = t.token group by t.domain
)"""


def encoded_cte() -> str:
    chars = ", ".join(f"('{c}', {i})" for i, c in enumerate(CHAR_ALPHABET))
    return CUT + f""",
charv as (select c as token, cast(pos + off as int) as id from (values {chars}) t(c, pos), vinfo),
charids as (
  select t.domain, list(coalesce(v.id, 1) order by t.pos) as cids
  from (select domain, unnest(cs) as token, unnest(range(1, len(cs) + 1)) as pos
        from (select domain, regexp_extract_all(sld, '(?s).', 0) as cs from cut) w) t
  left join charv v on v.token = t.token group by t.domain
),
enc as (
  select d.year, d.label, d.domain, vinfo.off,
         list_concat(coalesce(c.cids, []::int[]), coalesce(i.tids, []::int[])) as ids
  from domains d left join charids c using (domain) left join tlids i using (domain), vinfo
)"""


def pads(n: str) -> str:
    return f"list_transform(range(greatest({n}, 0)), lambda z: 0)"


def pack_pretrain_sql(ids: str, L: int) -> str:
    return (f"(case when len({ids}) > {L - 2} then list_concat([5], {ids}[len({ids}) - {L - 2} + 1:], [3]) "
            f"else list_concat({ids}, [3], {pads(f'{L} - len({ids}) - 1')}) end)")


def pack_finetune_sql(ids: str, L: int) -> str:
    return (f"(case when len({ids}) > {L - 3} then list_concat([2, 5], {ids}[len({ids}) - {L - 3} + 1:], [3]) "
            f"else list_concat([2], {ids}, [3], {pads(f'{L} - len({ids}) - 2')}) end)")


def txt(lst: str) -> str:
    return f"array_to_string({lst}, ' ')"


def samples_ctes(L: int, seed: int = 42) -> str:
    """packed (p), eligibility (e, maxsp) and the three permutations."""
    def perm(task):
        return (f"list_transform(list_sort(list_transform(e, lambda i: struct_pack(h := md5('{seed}' || ':{task}:' "
                f"|| domain || ':' || cast(i as varchar)), i := i))), lambda s: s.i)")
    return f"""
packed as (select year, label, domain, off - 1 as maxsp, {pack_pretrain_sql('ids', L)} as p from enc),
elig as (select *, list_filter(range(len(p)), lambda i: p[i + 1] = 1 or p[i + 1] > maxsp) as e from packed),
perms as (select *, {perm('mtp')} as pm, {perm('tpp')} as pt, {perm('tov')} as pv,
                 cast(len(e) > 1 and substr(md5('{seed}' || ':tov:' || domain), 1, 1) < '8' as int) as y_tov
          from elig),
s1 as (
  select *,
    list_transform(p, lambda v, j: case when len(e) > 1 and list_contains(pm[1:greatest(1, len(e) * 15 // 100)], j - 1)
                                       then 4 else v end) as x_mtp,
    list_transform(p, lambda v, j: case when len(e) > 1 and list_contains(pm[1:greatest(1, len(e) * 15 // 100)], j - 1)
                                       then v else -100 end) as y_mtp,
    list_transform(p, lambda v, j: case when len(e) > 1 and list_contains(e, j - 1)
                                       then p[e[list_position(pt, j - 1)] + 1] else v end) as x_tpp,
    list_transform(p, lambda v: case when v = 0 then -100 else v end) as y_tpp,
    list_filter(case when y_tov = 1
                     then list_transform(p, lambda v, j: case when list_contains(e, j - 1)
                                                             then p[e[list_position(pv, j - 1)] + 1] else v end)
                     else p end, lambda v: v = 1 or v >= 6) as pure
  from perms
),
s2 as (
  select *, list_concat([2],
      case when list_contains(p, 5) or len(pure) > {L - 3}
           then list_concat([5], pure[greatest(len(pure) - {L - 3} + 1, 1):]) else pure end, [3]) as body
  from s1
),
samples as (select *, list_concat(body, {pads(f'{L} - len(body)')}) as x_tov from s2)"""
