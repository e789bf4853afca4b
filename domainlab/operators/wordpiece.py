"""WordPiece vocabulary training (V3, V6) and encoding (K5, K2, K7).

Training state is a distributed table ``(symbols, n)`` built from the word counts (V2).
Merging one pair at a time would take a pass over it per merge; a round makes as many
merges as a bounded part of the table decides exactly. The pairs counted above ``stop``
(the top of the ranking) are *hot*. Words are cut at every other neighbourhood, equal
pieces are summed, and these segments go to the driver, where pairs are merged one at a
time, with counts kept up to date from the segments that held the merged pair, down to
``stop``. Why this equals merging over whole words: a merged symbol's neighbourhoods are
neighbourhoods of its first and last part, so a pair made later counts at most as often
as the pair at the same place does now. What lies across a cut thus never counts above
``stop``, and a pair above it is counted in full. Only a merge whose result is a token
already could add up two pairs; a round ends after it. The round's merges are then
applied to the table in order of rank, and the table is checkpointed. If more than
``max_segments`` segments come out, fewer pairs are taken (at the least one merge).
In the table symbols are numbers; tasks cut and merge a batch of words at a time with numpy.

Encoding is greedy longest-match-first per word with ``##`` continuations (a word
with an unmatched piece, or longer than 100 characters, becomes ``[UNK]``). It is
an Arrow-batched function of the text alone, with the bounded vocabulary shipped once per worker; a
word is matched in one pass over a trie with failure links, and the ids of recent words are
kept in a bounded cache per task."""

from __future__ import annotations

import heapq
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from domainlab.functions.util import to_col
from domainlab.operators.features import flat_lists
from domainlab.operators.vocab import SPECIAL_TOKENS
from domainlab.session import checkpoint_dir

PREFIX = "##"
MAX_WORD_CHARS = 100
MAX_VOCAB = 200_000
CACHE_WORDS = 200_000
MAX_SEGMENTS = 100_000
MAX_PAIRS = 60_000   # what one round ranks on the driver; more rounds, the same merges
MAX_GROWTH = 8       # times as many pairs as the round before, while segments are few


def initial_symbols(word) -> Column:
    """First character as is, later characters with the continuation prefix."""
    chars = F.regexp_extract_all(to_col(word), F.lit("(?s)(.)"), 1)
    return F.transform(chars, lambda c, i: F.when(i == 0, c).otherwise(F.concat(F.lit(PREFIX), c)))


def merged_symbol(left: str, right: str) -> str:
    return left + (right[len(PREFIX):] if right.startswith(PREFIX) else right)


def pair_counts(words: DataFrame) -> DataFrame:
    """``(left, right, count)``: adjacent symbol pairs weighted by word count."""
    s = F.col("symbols")
    pairs = F.arrays_zip(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))).alias("l"),
                         F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))).alias("r"))
    ex = words.where(F.size(s) > 1).select("n", F.explode(pairs).alias("p"))
    return ex.groupBy(F.col("p.l").alias("left"), F.col("p.r").alias("right")).agg(F.sum("n").alias("count"))


def _numbered(words: DataFrame, ids: dict[str, int]) -> DataFrame:
    """``(symbols, n)`` of ``(word, n)``: the initial symbols as numbers; words of one symbol have
    no pair and are left out."""
    bc = words.sparkSession.sparkContext.broadcast(ids)

    def run(batches):
        first = {s: i for s, i in bc.value.items() if len(s) == 1}
        later = {s.removeprefix(PREFIX): i for s, i in bc.value.items() if len(s) > 1}
        for b in batches:
            out = [[first[w[0]], *(later[c] for c in w[1:])] if w else [] for w in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32())), b.column(1)], names=["symbols", "n"])
    done = words.select("word", "n").mapInArrow(run, "symbols array<int>, n long")
    return done.where(F.size("symbols") > 1)


def _codes(flat: np.ndarray) -> np.ndarray:
    """One number for each pair of neighbours."""
    return (flat[:-1] << 32) | flat[1:]


def _found(codes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each code's place in the sorted ``table``, and whether it is there."""
    at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
    return at, table[at] == codes


def _rows_of(size: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(size)), size)


def _lists(flat: np.ndarray, size: np.ndarray, n: pa.Array) -> pa.RecordBatch:
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(np.int32)))
    return pa.RecordBatch.from_arrays([lists, n], names=["symbols", "n"])


def _segments(words: DataFrame, hot: set[tuple[int, int]]) -> DataFrame:
    """``(symbols, n)``: the words cut at every pair that is not hot, equal pieces summed."""
    bc = words.sparkSession.sparkContext.broadcast(np.array(sorted((l << 32) | r for l, r in hot), np.int64))

    def run(batches):
        table = bc.value
        for b in batches:
            flat, size = flat_lists(b.column(0))
            if not len(flat):
                continue
            row = _rows_of(size)
            joined = _found(_codes(flat), table)[1] & (row[:-1] == row[1:])
            start = np.flatnonzero(np.concatenate([[True], ~joined]))
            length = np.diff(np.append(start, len(flat)))
            some = length > 1
            yield _lists(flat[np.repeat(some, length)], length[some], b.column(1).take(pa.array(row[start[some]])))
    parts = words.select("symbols", "n").mapInArrow(run, "symbols array<int>, n long")
    return parts.groupBy("symbols").agg(F.sum("n").alias("n"))


def _merge(s: list[str], l: str, r: str, m: str) -> list[str]:
    out, i = [], 0
    while i < len(s):
        if i + 1 < len(s) and s[i] == l and s[i + 1] == r:
            out.append(m)
            i += 2
        else:
            out.append(s[i])
            i += 1
    return out


def _merge_serially(segments: list[tuple[list[str], int]], stop: int, room: int,
                    known: set[str]) -> list[tuple[str, str]]:
    """One merge at a time (count desc, left, right) while the best pair counts above ``stop``."""
    segs, ns = [s for s, _ in segments], [n for _, n in segments]
    count: Counter = Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for k, s in enumerate(segs):
        for p in zip(s, s[1:]):
            count[p] += ns[k]
            where[p].add(k)
    heap = [(-c, *p) for p, c in count.items() if c > stop]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    made: set[str] = set()
    while heap and len(merges) < room:
        c, l, r = heapq.heappop(heap)
        now = count[l, r]
        if now != -c:   # counted anew since it was put here
            if stop < now < -c:
                heapq.heappush(heap, (-now, l, r))
            continue
        m = merged_symbol(l, r)
        merges.append((l, r))
        if m in known or m in made:
            break
        made.add(m)
        grown = set()
        for k in where.pop((l, r)):
            old = segs[k]
            new = _merge(old, l, r, m)
            if len(new) == len(old):
                continue
            for p in zip(old, old[1:]):
                count[p] -= ns[k]
            for p in zip(new, new[1:]):
                count[p] += ns[k]
                if m in p:
                    where[p].add(k)
                    grown.add(p)
            segs[k] = new
        for p in grown:
            if count[p] > stop:
                heapq.heappush(heap, (-count[p], *p))
    return merges


def _merge_ranked(flat: np.ndarray, size: np.ndarray, table: np.ndarray, rank: np.ndarray,
                  made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words of a batch side by side: each one's pair of the lowest rank is merged, from the
    left, until none of its pairs has a rank. ``table``: the sorted codes of the pairs, ``rank``
    theirs, ``made``: the symbol that each rank makes. Every word has a symbol at least."""
    flat, none = flat.copy(), len(made)
    row = _rows_of(size)
    start = np.cumsum(size) - size
    while len(flat):
        at, known = _found(_codes(flat), table)
        r = np.append(np.where(known & (row[:-1] == row[1:]), rank[at], none), none)
        best = np.minimum.reduceat(r, start)
        hit = (r == best[row]) & (r < none)
        if not hit.any():
            break
        # of a run of equal symbols every other pair
        place = np.arange(len(r))
        begins = hit & ~np.concatenate([[False], hit[:-1]])
        hit &= (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at = np.flatnonzero(hit)
        flat[at] = made[r[at]]
        left = np.ones(len(flat), bool)
        left[at + 1] = False
        flat, row = flat[left], row[left]
        size = np.bincount(row, minlength=len(size))
        start = np.cumsum(size) - size
    return flat, size


def _apply(words: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    """The words after these merges ``(left, right, made)`` in turn; words of one symbol are done
    and left out."""
    order = {(l << 32) | r: k for k, (l, r, _) in enumerate(merges)}
    table = np.array(sorted(order), np.int64)
    rank = np.array([order[c] for c in table.tolist()], np.int64)
    bc = words.sparkSession.sparkContext.broadcast((table, rank, np.array([m for *_, m in merges], np.int64)))

    def run(batches):
        for b in batches:
            flat, size = flat_lists(b.column(0))
            if len(flat):
                yield _lists(*_merge_ranked(flat, size, *bc.value), b.column(1))
    done = words.select("symbols", "n").mapInArrow(run, "symbols array<int>, n long")
    return done.where(F.size("symbols") > 1)


def _ranking(words: DataFrame, floor: int, k: int) -> list[tuple[tuple[int, int], int]]:
    """The ``k`` pairs of the highest counts; which of several equal ones come last is open."""
    top = pair_counts(words).where(F.col("count") >= floor).orderBy(F.desc("count")).limit(k)
    return [((r["left"], r["right"]), int(r["count"])) for r in top.collect()]


def _first_pair(words: DataFrame, count: int, text: list[str]) -> tuple[str, str]:
    """Of the pairs of this count the first one by its symbols."""
    names = words.sparkSession.createDataFrame(list(enumerate(text)), "id int, name string")
    pairs = pair_counts(words).where(F.col("count") == count)
    for side in ("left", "right"):
        pairs = pairs.join(names.select(F.col("id").alias(side), F.col("name").alias(f"{side}_name")), side)
    first = pairs.orderBy("left_name", "right_name").first()
    return first["left_name"], first["right_name"]


def train_wordpiece(word_counts: DataFrame, vocab_size: int, min_frequency: int = 2,
                    specials: list[str] | None = None, top_k: int = 20_000, max_rounds: int | None = None,
                    max_segments: int = MAX_SEGMENTS) -> DataFrame:
    """V3 (V6 = a different ``specials`` list): ``(token, id, kind)`` with specials
    first, then the alphabet (sorted), then merges in order."""
    spark = word_counts.sparkSession
    checkpoint_dir(spark)
    specials = list(SPECIAL_TOKENS if specials is None else specials)
    words = word_counts.select("word", F.col("count").cast("long").alias("n")).checkpoint(eager=True)
    # alphabet: every character, plus the continuation forms that occur
    syms = words.select(F.explode(initial_symbols("word")).alias("t")).distinct()
    alphabet = sorted({t for r in syms.collect() for t in (r[0], r[0].removeprefix(PREFIX))})
    tokens = specials + [a for a in alphabet if a not in specials]
    known = set(tokens)
    text = list(alphabet)   # the symbols by number
    ids = {t: i for i, t in enumerate(text)}
    words = _numbered(words, ids).checkpoint(eager=True)
    floor = max(min_frequency, 1)
    rounds = 0
    while len(tokens) < vocab_size and (max_rounds is None or rounds < max_rounds):
        ranked = _ranking(words, floor, top_k + 1)
        if not ranked:
            break
        while True:   # the longest top of the ranking whose segments are few enough
            stop = ranked[top_k][1] if len(ranked) > top_k else floor - 1
            hot = {p for p, c in ranked if c > stop}
            segments = [([text[i] for i in r["symbols"]], int(r["n"])) for r in
                        _segments(words, hot).limit(max_segments + 1).collect()] if hot else []
            if len(segments) <= max_segments:
                break
            top_k = min(top_k, len(hot)) // 4
        merges = (_merge_serially(segments, stop, vocab_size - len(tokens), known) if hot
                  else [_first_pair(words, ranked[0][1], text)])
        made = []
        for l, r in merges:
            m = merged_symbol(l, r)
            tokens.append(m)
            known.add(m)
            if m not in ids:
                ids[m] = len(text)
                text.append(m)
            made.append((ids[l], ids[r], ids[m]))
        rounds += 1
        if len(segments) <= max_segments // 4:
            room = max_segments // (4 * max(len(segments), 1))
            top_k = min(max(min(max(room, 2), MAX_GROWTH) * top_k, 1), MAX_PAIRS)
        if len(tokens) < vocab_size:
            words = _apply(words, made).checkpoint(eager=True)
    kinds = ["special" if i < len(specials) else "alphabet" if i < len(specials) + len(alphabet) else "merge"
             for i in range(len(tokens))]
    return spark.createDataFrame([(t, i, k) for i, (t, k) in enumerate(zip(tokens, kinds))],
                                 "token string, id int, kind string")


# ---------------------------------------------------------------- encoding (K5, K2, K7)
#: A punctuation mark, or a run of anything but punctuation and white space.
_PUNCT = r"!-/:-@\[-`{-~\p{P}"
_WORD = regex.compile(rf"[{_PUNCT}]|[^\s\x1c-\x1f{_PUNCT}]+")


def _normalize(s: str) -> str:
    d = unicodedata.normalize("NFD", s).lower()
    return "".join(ch for ch in d if unicodedata.category(ch) != "Mn")


def _words(s: str) -> list[str]:
    return _WORD.findall(s)


class Pieces:
    """Greedy longest match in one pass over a word: two tries, of the pieces that begin a word
    and of those that go on in it, with failure links. Where the word leaves the trie at a
    node, ``pops`` are the pieces that greedy matching has settled by then, and ``fail`` is the
    node for what is left of the match; without one the word cannot be matched."""

    def __init__(self, vocab: dict[str, int]):
        self.child: list[dict[str, int]] = [{}, {}]   # the roots: 0 begins, 1 goes on
        ends: dict[int, int] = {}
        for token, i in vocab.items():
            for root, piece in ((0, token), (1, token[len(PREFIX):] if token.startswith(PREFIX) else "")):
                at = root
                for c in piece:
                    at = self.child[at].setdefault(c, len(self.child))
                    if at == len(self.child):
                        self.child.append({})
                if piece:
                    ends[at] = i
        n = len(self.child)
        self.fail: list[int | None] = [None] * n
        self.pops: list[tuple[int, ...]] = [()] * n
        level = [0, 1]
        while level:
            below = []
            for u in level:
                for c, v in self.child[u].items():
                    below.append(v)
                    if v in ends:
                        self.fail[v], self.pops[v] = 1, (ends[v],)
                        continue
                    z, settled = self.fail[u], self.pops[u]
                    while z is not None and c not in self.child[z]:
                        settled, z = settled + self.pops[z], self.fail[z]
                    if z is not None:
                        self.fail[v], self.pops[v] = self.child[z][c], settled
            level = below

    def encode(self, w: str, unk: int) -> list[int]:
        if len(w) > MAX_WORD_CHARS:
            return [unk]
        ids: list[int] = []
        at = 0
        for c in w:
            while c not in self.child[at]:
                if self.fail[at] is None:
                    return [unk]
                ids += self.pops[at]
                at = self.fail[at]
            at = self.child[at][c]
        while at > 1:
            if self.fail[at] is None:
                return [unk]
            ids += self.pops[at]
            at = self.fail[at]
        return ids


def encode_text(s: str | None, vocab: dict[str, int] | Pieces, unk: int,
                cache: dict[str, list[int]] | None = None) -> list[int]:
    """Ids of one text (NULL: none). White space never joins words, so each part between
    white space is encoded by itself. Each word (a part without punctuation is one) is looked up
    in ``cache`` first: names seldom recur, their words do."""
    pieces = vocab if isinstance(vocab, Pieces) else Pieces(vocab)
    cache = {} if cache is None else cache
    out: list[int] = []
    for part in (s or "").split():
        plain = part.lower() if part.isascii() else _normalize(part)
        whole = plain.isascii() and plain.isalnum()   # without punctuation: one word
        for w in ([plain] if whole else _words(plain)):
            ids = cache.get(w)
            if ids is None:
                ids = pieces.encode(w, unk)
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                if len(w) <= MAX_WORD_CHARS:
                    cache[w] = ids
            out.extend(ids)
    return out


def vocab_dict(vocab: DataFrame) -> dict[str, int]:
    rows = vocab.select("token", "id").limit(MAX_VOCAB + 1).collect()
    if len(rows) > MAX_VOCAB:
        raise ValueError(f"vocabulary larger than {MAX_VOCAB}")
    return {r["token"]: int(r["id"]) for r in rows}


def wordpiece_encode(df: DataFrame, text: str, vocab: dict[str, int], out: str = "wp_ids",
                     unk_token: str = "[UNK]") -> DataFrame:
    """K5: add ``out`` = WordPiece ids of ``text`` (normalised, pre-tokenised)."""
    spark: SparkSession = df.sparkSession
    bc = spark.sparkContext.broadcast(vocab)
    unk = vocab.get(unk_token, 1)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pieces, cache = Pieces(bc.value), {}
        for b in batches:
            yield pa.array([encode_text(x, pieces, unk, cache) for x in b.to_pylist()], pa.list_(pa.int32()))
    return df.withColumn(out, run(text))


def encode_external(df: DataFrame, domain: str, vocab: dict[str, int], L: int,
                    ids_out: str = "ext_ids", mask_out: str = "ext_mask") -> DataFrame:
    """K7: brackets removed (T9), WordPiece with ``[CLS] ... [SEP]``, right
    truncation to L, padding, attention mask."""
    from domainlab.functions.tokens import unwrap
    cls, sep, pad = vocab.get("[CLS]", 2), vocab.get("[SEP]", 3), vocab.get("[PAD]", 0)
    d = df.withColumn("_ext_text", unwrap(domain))
    d = wordpiece_encode(d, "_ext_text", vocab, "_ext_raw")
    body = F.concat(F.array(F.lit(cls)), F.slice("_ext_raw", 1, L - 2), F.array(F.lit(sep)))
    d = d.withColumn(ids_out, F.concat(body, F.array_repeat(F.lit(pad), F.greatest(F.lit(L) - F.size(body), F.lit(0)))))
    d = d.withColumn(mask_out, F.transform(ids_out, lambda x: (x != pad).cast("int")))
    return d.drop("_ext_text", "_ext_raw")
