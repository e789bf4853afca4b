"""Quality rules by line sequence labelling: a linear-chain conditional random field marks
each line of a text as content or boilerplate (Viterbi decoding), and the share of words
in content lines decides whether the document stays.

Null and empty texts count as texts without words: every count is 0 and the document
fails the base rules. Repeated rows each get their own result row. An empty table gives an
empty result. Only the id and text columns are read, so other columns, whatever their
names, do no harm; ``drop_low_quality`` passes them all through unchanged. Without
labelled documents of both kinds the model marks nothing as boilerplate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.llm import textvec as TV

#: Base rules: least words; most repeated words of a hundred.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Least share of a document's words that must lie in content lines.
CONTENT_SHARE = 0.5
#: The model is fitted on at most this many labelled documents of each quality, taken in
#: the order of a hash of doc_id, of at most this many characters each.
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000

# fixed values: the characters counted as symbols
SYMBOLS = b"#*$%&|<>"


def _table(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_SYMBOL = _table(SYMBOLS)
_UPPER = _table(bytes(range(65, 91)))
_LETTER = _table(bytes(range(65, 91)) + bytes(range(97, 123)))
_DIGIT = _table(b"0123456789")
_BANG = _table(b"!?")
_MARKUP = _table(b"{}[]()=;/\\_@~^")
_END = _table(b".!?\"')")
_LEAD = np.ones(256, bool)
_LEAD[128:192] = False  # UTF-8 continuation bytes

#: Upper edges of the bins of each line feature.
BINS = {
    "words": [1.5, 3.5, 7.5, 15.5, 31.5, 63.5],
    "upper": [0.0, 0.1, 0.3, 0.6],
    "symbols_per_word": [0.0, 0.05, 0.3],
    "bangs_per_word": [0.0, 0.1, 0.4],
    "digits": [0.0, 0.1, 0.3],
    "markup": [0.0, 0.03, 0.1],
    "repeated": [0.0, 0.2, 0.5, 0.8],
    "stutter": [0.0, 0.05, 0.3],
    "word_chars": [3.0, 4.0, 6.0, 8.0, 12.0],
    "ends": [0.5],
    "duplicate": [0.5],
}
_WIDTHS = [len(v) + 1 for v in BINS.values()]
_START = np.concatenate([[0], np.cumsum(_WIDTHS)[:-1]])
N_FEATURES = int(sum(_WIDTHS))


def _same_in_text(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does an equal one stand earlier in its text; does one stand anywhere
    else in it."""
    key = TV.mix(h ^ TV.mix(doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    run = key[order]
    like_last = np.zeros(len(h), bool)
    like_last[1:] = run[1:] == run[:-1]
    like_next = np.zeros(len(h), bool)
    like_next[:-1] = like_last[1:]
    earlier, anywhere = np.zeros(len(h), bool), np.zeros(len(h), bool)
    earlier[order] = like_last
    anywhere[order] = like_last | like_next
    return earlier, anywhere


def _running(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def measure(c: TV.Chunk) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The base counts of each text, and bins, word count and text index of each line
    that has a word."""
    n = c.n
    s, e, doc = c.words()
    wh = c.hashes(s, e)
    chars = _running(_LEAD[c.buf])
    word_chars = chars[e] - chars[s]
    symbols = _running(_SYMBOL[c.buf])

    # words covered by three-word windows that occur at least twice in the text
    repeated = np.zeros(len(s), bool)
    if len(s) > 2:
        inside = doc[2:] == doc[:-2]
        window = TV.mix(TV.mix(wh[:-2] + np.uint64(7)) * np.uint64(3) + wh[1:-1]) * np.uint64(5) + wh[2:]
        at = np.flatnonzero(inside)
        at = at[_same_in_text(window[at], doc[at])[1]]
        for k in range(3):
            repeated[at + k] = True

    ls, le, ldoc = c.lines()
    per_line = np.bincount(np.searchsorted(ls, s, "right") - 1, minlength=len(ls))
    solid = per_line > 0
    ls, le, ldoc, per_line = ls[solid], le[solid], ldoc[solid], per_line[solid]
    again, twin = _same_in_text(c.hashes(ls, le), ldoc)

    def per(w: np.ndarray) -> np.ndarray:
        return np.bincount(doc, weights=w, minlength=n).astype(np.int64)

    base = {
        "n_words": np.bincount(doc, minlength=n).astype(np.int64),
        "word_chars": per(word_chars),
        "n_symbols": symbols[c.offsets[1:]] - symbols[c.offsets[:-1]],
        "n_dup_lines": np.bincount(ldoc[again], minlength=n).astype(np.int64),
        "n_repeat_words": per(repeated),
    }
    first = np.cumsum(per_line) - per_line  # index of each line's first word
    stop = first + per_line

    def share(table: np.ndarray, of: np.ndarray) -> np.ndarray:
        r = _running(table[c.buf])
        return (r[le] - r[ls]) / np.maximum(of, 1)

    letters = _running(_LETTER[c.buf])
    line_chars = chars[le] - chars[ls]
    stutter = np.zeros(len(s), bool)
    if len(s) > 1:
        stutter[1:] = (wh[1:] == wh[:-1]) & (doc[1:] == doc[:-1])
    rep, stut, wc = _running(repeated), _running(stutter), _running(word_chars)
    values = {
        "words": per_line,
        "upper": share(_UPPER, letters[le] - letters[ls]),
        "symbols_per_word": share(_SYMBOL, per_line),
        "bangs_per_word": share(_BANG, per_line),
        "digits": share(_DIGIT, line_chars),
        "markup": share(_MARKUP, line_chars),
        "repeated": (rep[stop] - rep[first]) / np.maximum(per_line, 1),
        "stutter": (stut[stop] - stut[first]) / np.maximum(per_line, 1),
        "word_chars": (wc[stop] - wc[first]) / np.maximum(per_line, 1),
        "ends": _END[c.buf[e[stop - 1] - 1]] if len(ls) else np.zeros(0),
        "duplicate": twin,
    }
    bins = np.empty((len(ls), len(BINS)), np.int32)
    for k, (name, edges) in enumerate(BINS.items()):
        bins[:, k] = _START[k] + np.searchsorted(edges, values[name], "left")
    return base, {"bins": bins, "doc": ldoc, "words": per_line}


class Model:
    """weights: evidence for content of each bin; moves[a, b]: score of state b after a;
    start: evidence for content of the first line. State 1 is content."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray, start: float):
        self.weights, self.moves, self.start = weights, moves, start

    @staticmethod
    def permissive() -> Model:
        return Model(np.full(N_FEATURES, 0.1), np.zeros((2, 2)), 0.0)

    def evidence(self, bins: np.ndarray) -> np.ndarray:
        return self.weights[bins].sum(axis=1)

    def viterbi(self, evidence: list[float]) -> list[bool]:
        """The best state sequence. Only the difference d between the best scores that
        end in content and in boilerplate matters; a tie goes to content."""
        (stay0, to1), (to0, stay1) = self.moves.tolist()
        d, back = self.start, []
        for k, x in enumerate(evidence):
            if k:
                a, b = d + stay1, d + to0
                back.append((b >= stay0, a >= to1))  # is content the best predecessor of 0, of 1
                d = (a if a >= to1 else to1) - (b if b >= stay0 else stay0)
            d += x
        states = [d >= 0]
        for pointers in reversed(back):
            states.append(pointers[states[-1]])
        return states[::-1]

    def content_words(self, n: int, lines: dict[str, np.ndarray]) -> np.ndarray:
        """Words in content lines, for each of the n texts of a chunk."""
        out = np.zeros(n, np.int64)
        evidence = self.evidence(lines["bins"]).tolist()
        words = lines["words"].tolist()
        cut = np.searchsorted(lines["doc"], np.arange(n + 1)).tolist()
        for i in range(n):
            a, b = cut[i], cut[i + 1]
            if a < b:
                out[i] = sum(w for w, keep in zip(words[a:b], self.viterbi(evidence[a:b])) if keep)
        return out


def fit(sequences: list[np.ndarray], labels: list[np.ndarray], steps: int = 80,
        rate: float = 0.15, ridge: float = 1e-3) -> Model:
    """Maximum likelihood by gradient ascent (Adam); forward-backward sums run over all
    sequences at once, one line position at a time. sequences: bins of each line; labels:
    1 for content."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
    length = np.array([len(x) for x in sequences])
    top, d = int(length[0]), len(sequences)
    mask = np.arange(top)[None, :] < length[:, None]
    bins = np.concatenate(sequences)
    y = np.zeros((d, top), int)
    y[mask] = np.concatenate(labels)
    live = mask.sum(axis=0)  # sequences are longest first
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & mask[:, 1:]).sum()
    seen = np.bincount(bins.ravel(), weights=np.repeat(y[mask], bins.shape[1]), minlength=N_FEATURES)
    firsts = float(y[:, 0].sum())
    total = float(mask.sum())
    theta = np.zeros(N_FEATURES + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, moves, start = theta[:N_FEATURES], theta[N_FEATURES:-1].reshape(2, 2), theta[-1]
        u = np.zeros((d, top, 2))
        u[..., 1][mask] = w[bins].sum(axis=1)
        alpha, beta = np.zeros((d, top, 2)), np.zeros((d, top, 2))
        alpha[:, 0] = u[:, 0] + np.array([0, start])
        for t in range(1, top):
            k = live[t]
            step_in = alpha[:k, t - 1, :, None] + moves
            alpha[:k, t] = np.logaddexp(step_in[:, 0], step_in[:, 1]) + u[:k, t]
        for t in range(top - 2, -1, -1):
            k = live[t + 1]
            out = moves[None] + (u[:k, t + 1] + beta[:k, t + 1])[:, None, :]
            beta[:k, t] = np.logaddexp(out[..., 0], out[..., 1])
        last = alpha[np.arange(d), length - 1]
        z = np.logaddexp(last[:, 0], last[:, 1])
        p1 = np.exp(alpha[..., 1] + beta[..., 1] - z[:, None])
        expected = np.bincount(bins.ravel(), weights=np.repeat(p1[mask], bins.shape[1]), minlength=N_FEATURES)
        joint = alpha[:, :-1, :, None] + moves + (u + beta)[:, 1:, None, :] - z[:, None, None, None]
        joint = np.exp(np.where(mask[:, 1:, None, None], joint, -np.inf)).sum(axis=(0, 1))
        g = np.concatenate([seen - expected, (pairs - joint).ravel(), [firsts - p1[:, 0].sum()]]) / total
        g -= ridge * theta
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
    return Model(theta[:N_FEATURES].copy(), theta[N_FEATURES:-1].reshape(2, 2).copy(), float(theta[-1]))


def fit_documents(texts: list[str], quality: list[int]) -> Model:
    """Fits on whole labelled documents. The labels are of documents, so lines start out
    with their document's label; a first fit that sees single lines then returns those
    lines of poor documents to content that look like lines of good ones."""
    sequences, labels = [], []
    at = 0
    for c in TV.chunks(pa.array(texts, pa.string())):
        _, lines = measure(c)
        cut = np.searchsorted(lines["doc"], np.arange(c.n + 1))
        for i in range(c.n):
            b = lines["bins"][cut[i]:cut[i + 1]]
            if len(b):
                sequences.append(b)
                labels.append(np.full(len(b), int(quality[at + i]), int))
        at += c.n
    if len({int(y[0]) for y in labels}) < 2:
        return Model.permissive()
    singles = [x[k:k + 1] for x in sequences for k in range(len(x))]
    alone = fit(singles, [y[k:k + 1] for y in labels for k in range(len(y))])
    bias = alone.start
    labels = [np.where(alone.evidence(x) + bias >= 0, 1, y) for x, y in zip(sequences, labels)]
    return fit(sequences, labels)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Fits on at most ``sample_docs`` labelled documents of each quality, none longer
    than ``sample_chars``. Labels other than 0 and 1 are left out; of several labels of a
    document the lowest counts."""
    known = (labels.where("quality in (0, 1)").groupBy(F.col(id_col).alias("_id"))
             .agg(F.min("quality").alias("_q")))
    picked = None
    for q in (0, 1):
        part = known.where(F.col("_q") == q).orderBy(F.xxhash64("_id"), "_id").limit(sample_docs)
        picked = part if picked is None else picked.unionByName(part)
    found = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
             .where(F.length("_t") <= sample_chars)
             # at most 2 * sample_docs ids
             .join(F.broadcast(picked), "_id")
             .groupBy("_id").agg(F.min("_t").alias("_t"), F.min("_q").alias("_q")).collect())
    found = sorted(found, key=lambda r: r["_id"])
    return fit_documents([r["_t"] for r in found], [r["_q"] for r in found])


def _judge(c: TV.Chunk, model: Model) -> dict[str, np.ndarray]:
    base, lines = measure(c)
    n = base["n_words"]
    failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED * n)
    content = model.content_words(c.n, lines)
    return base | {"base_failed": failed, "content_words": content,
                   "kept": ~failed & (content >= CONTENT_SHARE * n)}


_SCHEMA = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, "
           "n_repeat_words long, base_failed boolean, content_words long, kept boolean")


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, the base counts, the words in content lines, the
    verdict. One narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in TV.chunks(b.column(1)):
                got = _judge(c, model)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(c.first, c.n), *map(pa.array, got.values())],
                    names=[id_col, *got])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {_SCHEMA}")


def drop_low_quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that the verdict keeps, all columns unchanged."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [_judge(c, model)["kept"] for c in TV.chunks(b.column(at))]
            if kept:
                yield b.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
