"""Public-suffix engine (T1-T4) as broadcast lookups on a rules table.

A rules table ``(rule, n_labels, kind, is_private)`` is folded into a small lookup
``(key, flags)`` with one row per suffix-trie node. Each domain is probed with its
last k labels for k = 1..K (K = deepest rule), one broadcast hash join per k, so the
whole suffix split is a narrow, shuffle-free pipeline over the data. Flags carry
both modes (ICANN-only and ICANN+private) so one pass serves every wrapper.

Walk semantics (same as a suffix-trie walk from the right): keep consuming labels
while the candidate is a trie node, remembering the longest candidate that is a
rule; at the first candidate that is not a node, a wildcard rule on its parent
covers it unless an exception names it. No matching rule leaves an empty suffix
(no implicit ``*`` rule). A dotted IPv4 address has no suffix. Rules and names match
whichever way an internationalised label is written, native or ``xn--``; results keep the
name's own labels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlab.functions import punycode as PC
from domainlab.functions.util import to_col

# The small rules set used by the fixtures (public-suffix syntax).
MINI_RULES_ICANN = [
    "com", "net", "org", "uk", "co.uk", "kr", "co.kr", "au", "com.au", "io", "co", "ru",
    "jp", "*.kawasaki.jp", "!city.kawasaki.jp",
]
MINI_RULES_PRIVATE = ["github.io", "s3.amazonaws.com"]
#: Further rules with internationalised labels, written in either form.
IDN_RULES = ["cn", "公司.cn", "рф", "香港", "個人.香港", "xn--j1amh", "*.xn--fiqs8s", "!центр.中国"]

RULES_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType(), False),
    T.StructField("n_labels", T.IntegerType(), False),
    T.StructField("kind", T.StringType(), False),
    T.StructField("is_private", T.BooleanType(), False),
])

# Flag bits per lookup key; the "all" mode (ICANN + private) sits 4 bits higher.
NODE, END, WILD, EXC = 1, 2, 4, 8
PRIVATE_SHIFT = 4
ICANN_MODE, ALL_MODE = 0, PRIVATE_SHIFT

_IPV4 = r"^((25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})\.){3}(25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"


def _classify(rule: Column) -> tuple[Column, Column]:
    kind = (F.when(rule.startswith("!"), F.lit("exception"))
            .when(rule.startswith("*."), F.lit("wildcard"))
            .otherwise(F.lit("normal")))
    return kind, F.size(F.split(rule, r"\.", -1)).cast("int")


def rules_frame(spark: SparkSession, icann=MINI_RULES_ICANN,
                private=MINI_RULES_PRIVATE) -> DataFrame:
    """Rules table from literal rule strings (public-suffix syntax)."""
    rows = [(r, False) for r in icann] + [(r, True) for r in private]
    df = spark.createDataFrame(rows, "rule string, is_private boolean")
    kind, n = _classify(F.col("rule"))
    return df.select("rule", n.alias("n_labels"), kind.alias("kind"), "is_private")


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Rules table from a public-suffix list file (``//`` comments, one rule per
    line, private rules between the BEGIN/END PRIVATE DOMAINS markers).

    The file is a bounded configuration input (~10k rules); it is read as one text
    value so that the private section can be located by line number."""
    lines = (spark.read.text(path, wholetext=True)
             .select(F.posexplode(F.split("value", "\n")).alias("line_no", "line")))
    begin = F.min(F.when(F.col("line").contains("===BEGIN PRIVATE DOMAINS==="),
                         F.col("line_no"))).over(_whole())
    end = F.min(F.when(F.col("line").contains("===END PRIVATE DOMAINS==="),
                       F.col("line_no"))).over(_whole())
    lines = lines.select(
        F.trim(F.split(F.trim("line"), r"\s", 2)[0]).alias("rule"),
        ((F.col("line_no") > F.coalesce(begin, F.lit(1 << 30)))
         & (F.col("line_no") < F.coalesce(end, F.lit(1 << 30)))).alias("is_private"))
    lines = lines.where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
    kind, n = _classify(F.col("rule"))
    return lines.select(F.lower("rule").alias("rule"), n.alias("n_labels"), kind.alias("kind"),
                        "is_private")


def _whole():
    from pyspark.sql import Window
    # the rules file is one bounded text value; a global frame over its lines is fine
    return Window.partitionBy(F.lit(0))


def lookup_table(rules: DataFrame) -> DataFrame:
    """Fold rules into ``(key, flags)``, one row per trie node (bounded by the rules)."""
    base = (F.when(F.col("kind") == "exception", F.expr("substring(rule, 2)"))
            .when(F.col("kind") == "wildcard", F.expr("substring(rule, 3)"))
            .otherwise(F.col("rule")))
    r = rules.select(F.lower(base).alias("base"), "kind", "is_private")
    labels = F.split("base", r"\.", -1)
    coded = bool(r.where(F.col("base").contains(PC.ACE)).limit(1).count())
    r = r.withColumn("labels", PC.native_labels(labels) if coded else labels).withColumn("n", F.size("labels"))
    r = r.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("k"))
    key = F.array_join(F.slice("labels", F.col("n") - F.col("k") + 1, F.col("k")), ".")
    full = F.col("k") == F.col("n")
    kind = F.col("kind")
    bits = (F.when(full & (kind == "normal"), F.lit(NODE | END))
            .when(full & (kind == "wildcard"), F.lit(NODE | WILD))
            .when(full & (kind == "exception"), F.lit(EXC))
            .otherwise(F.lit(NODE)))
    # private rules only enter the "all" mode; ICANN rules enter both
    flags = F.when(F.col("is_private"), F.shiftleft(bits, PRIVATE_SHIFT)).otherwise(
        bits.bitwiseOR(F.shiftleft(bits, PRIVATE_SHIFT)))
    return r.select(key.alias("key"), flags.alias("flags")).groupBy("key").agg(
        F.bit_or("flags").alias("flags"))


def max_depth(lookup: DataFrame) -> int:
    v = lookup.agg(F.max(F.size(F.split("key", r"\.", -1)))).first()[0]
    return int(v or 1)


class SuffixIndex:
    """A lookup table prepared once (cached, size-checked) for repeated probes."""

    MAX_KEYS = 2_000_000  # a broadcast beyond this would be a configuration error

    def __init__(self, rules: DataFrame):
        lk = lookup_table(rules).cache()
        n = lk.count()
        if n > self.MAX_KEYS:
            raise ValueError(f"suffix lookup has {n} keys; more than {self.MAX_KEYS}")
        self.lookup = lk
        self.depth = max_depth(lk)
        self.native = bool(lk.where(~F.col("key").rlike(r"^[\x00-\x7F]*$")).limit(1).count())

    @classmethod
    def mini(cls, spark: SparkSession) -> "SuffixIndex":
        return cls(rules_frame(spark))


_HOST = r"^(?:(?:[A-Za-z0-9+.\-]*:)?//)?(?:[^/?#]*@)?([^/?#:]*)"
#: Names that are their own host: these characters alone, no dot at the end.
_BARE = r"^[A-Za-z0-9._-]*+(?<!\.)\z"


def lookup_host(domain) -> Column:
    """Host part used for the lookup: scheme, path, query, fragment, user-info and
    port removed, ideographic full stops mapped to '.', whitespace and trailing root
    dots stripped. Bare names (the common case) only pay for one short pattern."""
    raw = to_col(domain)
    d = F.translate(raw, "\u3002\uff0e\uff61", "...")
    d = F.regexp_extract(d, _HOST, 1)
    return F.when(raw.rlike(_BARE), raw).otherwise(
        F.regexp_replace(d, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f.]+$", ""))


def _labels(host, count) -> Column:
    """The first ``count`` labels of a host as text, or the last ones if it is negative."""
    return F.call_function("substring_index", to_col(host), F.lit("."), count if isinstance(count, Column) else F.lit(count))


def probe(df: DataFrame, host: Column, index: SuffixIndex, tag: str = "_sx",
          active: Column | None = None) -> DataFrame:
    """Add ``{tag}_host`` and ``{tag}_n`` (its labels) plus suffix label counts for both modes,
    ``{tag}_s_all`` and ``{tag}_s_icann``, with one broadcast join per depth. What several
    steps need is a column of its own, so that it is computed once per row; labels are cut
    out of the text, no array is built.

    ``active`` (optional) marks rows that need a lookup; others probe with NULL."""
    h, n, keys = f"{tag}_host", f"{tag}_n", f"{tag}_keys"
    df = df.withColumn(h, host).withColumn(n, F.size(F.split(h, r"\.", -1)))
    low = F.lower(h)
    # a decoded label is never ASCII alone: without native keys there is nothing to decode for
    df = df.withColumn(keys, PC.native_name(low) if index.native else low)
    K = index.depth
    flags_cols = []
    for k in range(1, K + 1):
        ck = f"{tag}_c{k}"
        wanted = F.col(n) >= k
        df = df.withColumn(ck, F.when(wanted if active is None else wanted & active, _labels(keys, -k)))
        right = F.broadcast(index.lookup.select(F.col("key").alias(f"{tag}_k{k}"),
                                                F.col("flags").alias(f"{tag}_f{k}")))
        df = df.join(right, F.col(ck) == F.col(f"{tag}_k{k}"), "left").drop(ck, f"{tag}_k{k}")
        flags_cols.append(F.coalesce(F.col(f"{tag}_f{k}"), F.lit(0)))
    ip = (F.col(n) == 4) & F.col(h).rlike(_IPV4)
    for name, shift in (("all", ALL_MODE), ("icann", ICANN_MODE)):
        m = f"{tag}_m_{name}"
        df = df.withColumn(m, _first_outside(flags_cols, shift))
        df = df.withColumn(f"{tag}_s_{name}", F.when(ip, F.lit(0)).otherwise(
            _walk(flags_cols, F.col(m), F.col(n), shift))).drop(m)
    return df.drop(keys, *[f"{tag}_f{k}" for k in range(1, K + 1)])


def _has(flags: list[Column], k: int, bit: int, shift: int) -> Column:   # k is 1-based
    return flags[k - 1].bitwiseAND(bit << shift) != 0


def _first_outside(flags: list[Column], shift: int) -> Column:
    """The first depth whose candidate is not a trie node (K + 1 when all are)."""
    m = F.lit(len(flags) + 1)
    for k in range(len(flags), 0, -1):
        m = F.when(~_has(flags, k, NODE, shift), F.lit(k)).otherwise(m)
    return m


def _walk(flags: list[Column], m: Column, n: Column, shift: int) -> Column:
    K = len(flags)

    def has(k: int, bit: int) -> Column:
        return _has(flags, k, bit, shift)

    # longest rule end strictly above m
    best = F.lit(0)
    for k in range(1, K + 1):
        best = F.when((F.lit(k) < m) & has(k, END), F.lit(k)).otherwise(best)
    # wildcard on the parent of m (never at the root), exception on m itself
    wild = F.lit(False)
    exc = F.lit(False)
    for k in range(1, K + 1):
        if k >= 2:
            wild = F.when(m == k, has(k - 1, WILD)).otherwise(wild)
        exc = F.when(m == k, has(k, EXC)).otherwise(exc)
    return (F.when((m <= n) & wild, F.when(exc, m - 1).otherwise(m))
            .otherwise(best)).cast("int")


def _parts(host: Column, n: Column, s: Column):
    """(subdomain, domain, suffix) for a suffix of ``s`` labels."""
    sub = _labels(host, F.greatest(n - s - 1, F.lit(0)))
    dom = F.when(n - s >= 1, _labels(_labels(host, F.greatest(n - s, F.lit(1))), -1)).otherwise(F.lit(""))
    return sub, dom, _labels(host, -s)


def _prefix(sub: Column, dom: Column) -> Column:
    return F.concat_ws(".", F.nullif(sub, F.lit("")), F.nullif(dom, F.lit("")))


def bracket(prefix: Column, suffix_labels: Column, keep_empty: bool = False) -> Column:
    """``prefix`` + ``[.part]`` for each (non-empty) suffix label."""
    parts = suffix_labels if keep_empty else F.filter(suffix_labels, lambda p: p != "")
    return F.concat(prefix, F.array_join(F.transform(parts, lambda p: F.concat(F.lit("[."), p, F.lit("]"))), ""))


def bracket_text(prefix: Column, suffix: Column, any_label: Column, keep_empty: bool = False) -> Column:
    """:func:`bracket` of a suffix given as text, of no label unless ``any_label``."""
    whole = F.concat(prefix, F.lit("[."), F.replace(suffix, F.lit("."), F.lit("][.")), F.lit("]"))
    if not keep_empty:
        gaps = F.concat(F.lit("."), suffix, F.lit(".")).contains("..")
        whole = F.when(gaps, bracket(prefix, F.split(suffix, r"\.", -1))).otherwise(whole)
    return F.when(any_label, whole).otherwise(prefix)


def processed(tag: str, mode: str, keep_empty: bool = False) -> Column:
    host, n, s = F.col(f"{tag}_host"), F.col(f"{tag}_n"), F.col(f"{tag}_s_{mode}")
    sub, dom, suf = _parts(host, n, s)
    return bracket_text(_prefix(sub, dom), suf, s > 0, keep_empty)


def split_suffix(df: DataFrame, domain: str, index: SuffixIndex, private: bool = True,
                 out: str = "split") -> DataFrame:
    """struct<subdomain, domain, suffix> column ``out``."""
    tag = "_sx"
    df = probe(df, lookup_host(F.col(domain)), index, tag)
    s = F.col(f"{tag}_s_{'all' if private else 'icann'}")
    sub, dom, suf = _parts(F.col(f"{tag}_host"), F.col(f"{tag}_n"), s)
    res = F.when(F.col(domain).isNull(), F.lit(None)).otherwise(
        F.struct(sub.alias("subdomain"), dom.alias("domain"), suf.alias("suffix")))
    return df.withColumn(out, res).drop(*[c for c in df.columns if c.startswith(tag)])


def _normalized(domain) -> Column:
    d = F.lower(to_col(domain))
    return F.when(d.rlike(_BARE), d).otherwise(F.regexp_replace(d, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def _wrapped(df: DataFrame, raw: Column, tag: str, out: str) -> DataFrame:
    """T3 from a probe's columns and ``{tag}_d``, the normalised name."""
    d, r_all, r_icann = (F.col(f"{tag}_{c}") for c in ("d", "r_all", "r_icann"))
    first, dotted = _labels(d, 1), d.contains(".")
    rest = F.call_function("substring", d, F.length(first) + 2)
    two = F.col(f"{tag}_two")
    df = df.withColumns({f"{tag}_r_all": F.when(~two, processed(tag, "all")),
                         f"{tag}_r_icann": F.when(~two, processed(tag, "icann"))})
    res = (F.when(raw.isNull() | (raw == ""), raw)
           .when(two, F.concat(first, F.lit("[."), rest, F.lit("]")))
           .when(~r_all.startswith("["), r_all)
           .when(~r_icann.startswith("["), r_icann)
           .otherwise(bracket_text(first, rest, dotted)))
    return df.withColumn(out, res)


def _with_normalized(df: DataFrame, raw: Column, tag: str) -> DataFrame:
    """Add ``{tag}_d`` and whether it has two parts, ``{tag}_two``."""
    df = df.withColumn(f"{tag}_d", _normalized(raw))
    return df.withColumn(f"{tag}_two", F.size(F.split(f"{tag}_d", r"\.", -1)) == 2)


def wrap_tld(df: DataFrame, domain: str, index: SuffixIndex, out: str | None = None) -> DataFrame:
    """lower+strip; two dot parts -> ``a[.b]`` without lookup; else the
    private-rules split; when that loses the prefix (starts with ``[``) the
    ICANN-only split; when that still does, the first label becomes the prefix
    and all later non-empty labels are wrapped. NULL and '' pass unchanged."""
    out = out or domain
    tag = "_wt"
    df = _with_normalized(df, F.col(domain), tag)
    df = probe(df, lookup_host(F.col(f"{tag}_d")), index, tag, active=~F.col(f"{tag}_two"))
    df = _wrapped(df, F.col(domain), tag, out)
    return df.drop(*[c for c in df.columns if c.startswith(tag)])


def wrap_pair(df: DataFrame, domain: str, index: SuffixIndex, v1_out: str, v2_out: str) -> DataFrame:
    """T4 and T3 side by side from one probe (J4): ``v1_out`` = previous wrapper
    (private lookup only, no lower/strip, no two-part rule, no fallback; every
    suffix label wrapped), ``v2_out`` = :func:`wrap_tld`."""
    tag = "_wp"
    raw = F.col(domain)
    df = probe(_with_normalized(df, raw, tag), lookup_host(raw), index, tag)
    v1 = F.when(raw.isNull() | (raw == ""), raw).otherwise(processed(tag, "all", keep_empty=True))
    df = _wrapped(df.withColumn(f"{tag}_v1", v1), raw, tag, f"{tag}_v2")
    df = df.withColumn(v1_out, F.col(f"{tag}_v1")).withColumn(v2_out, F.col(f"{tag}_v2"))
    return df.drop(*[c for c in df.columns if c.startswith(tag)])
