"""The aligned corpus against whole texts through both libraries and counts in a dictionary."""

import hashlib
import io
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domainlab.llm import alignment
from domainlab.llm.queries import vocabulary

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def brute(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte = alignment._byte_of_char()
    tokens_of = {i: t for t, i in a.get_vocab().items()}
    parsed, counts = [], Counter()
    for _, text in rows:
        raw = (" " + text).encode() if text else b""
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [bytes(byte[c] for c in tokens_of[i]) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i)
                   else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
            ids_a = ids_b = bytes_a = bytes_b = []
        ends_a = [sum(map(len, bytes_a[:k + 1])) for k in range(len(bytes_a))] if len(bytes_a) < 500 else None
        if ends_a is None:
            ends_a, n = [], 0
            for x in bytes_a:
                n += len(x)
                ends_a.append(n)
        ends_b, n = [], 0
        for x in bytes_b:
            n += len(x)
            ends_b.append(n)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, links, lo = [], [], 0
        i = j = 0
        for cut in cuts:
            i0, j0 = i, j
            while i < len(ends_a) and ends_a[i] <= cut:
                i += 1
            while j < len(ends_b) and ends_b[j] <= cut:
                j += 1
            for p in range(i0, i):
                for q in range(j0, j):
                    sa, sb = ends_a[p] - len(bytes_a[p]), ends_b[q] - len(bytes_b[q])
                    if max(sa, sb) < min(ends_a[p], ends_b[q]):
                        links.append((ids_a[p], ids_b[q]))
            groups.append(",".join(map(str, ids_a[i0:i])) + "|" + ",".join(map(str, ids_b[j0:j])))
            lo = cut
        assert lo == (len(raw) if ids_a else 0)
        counts.update(links)
        parsed.append((len(ids_a), len(ids_b), len(groups), links, ";".join(groups)))
    top = {}
    for (x, y), n in counts.items():
        top[y] = max(top.get(y, 0), n)
    return [(i, na, nb, ng, len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if na else "")
            for (i, _), (na, nb, ng, links, g) in zip(rows, parsed)]


ODD = [None, "", " ", "  ", "a", "a b", " a", "a ", "two  spaces", "tab\tand\nlines \n\n x", "x  y 　 z w",
       "▁ piece mark", "a ▁b", "<s> </s> <unk> <|endoftext|> <0x41>", "don't we'll 'S", "日本語 テキスト です",
       "naïve café – “quoted” …", "Привет мир, как дела", "emoji 👩‍👩‍👧 🇩🇪 x", "\x00 nul \x1c sep \x85 nel", "a" * 3000,
       "word " * 2000, "1 22 333 4444 55555", "same text", "same text", "é combining", "﻿bom", "\r\n crlf \r\n",
       "a   b", "  ogham   line", "..... !!!! ----- ====="]


def got(docs, **settings):
    return sorted((tuple(r) for r in alignment.align(docs, A, B).collect()), key=repr)


def test_odd_texts(spark):
    rows = list(enumerate(ODD)) + [(None, "null id"), (3, "repeated id"), (3, "repeated id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {"run": F.lit("x"), "place": F.lit(1), "n_a": F.lit(2.0)}).repartition(3)
    assert got(docs) == sorted(brute(rows), key=repr)


def test_many_runs_and_levels(spark, monkeypatch):
    """Nine runs, merged two at a time over several levels."""
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    rows = [(k, ODD[k % len(ODD)] and ODD[k % len(ODD)][:200]) for k in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    assert got(docs) == sorted(brute(rows), key=repr)


def test_runs_merge_in_blocks(monkeypatch):
    """The heap merge, the best marks and the contributions, on runs of small frames."""
    monkeypatch.setattr(alignment, "FRAME_PAIRS", 7)
    monkeypatch.setattr(alignment, "FRAME_RECORDS", 10)
    rng = np.random.default_rng(5)
    key_bits, doc_bits, bits_a = 12, 8, 6
    class File(io.BytesIO):
        size = lambda self: len(self.getbuffer())
        read_at = lambda self, n, at: bytes(self.getbuffer()[at:at + n])
        close = lambda self: None

    kept = {}
    total = Counter()
    for r in range(9):
        pair = rng.integers(0, 1 << key_bits, 400)
        code = np.unique(((pair >> bits_a) % alignment.RADIX << key_bits | pair) << doc_bits | rng.integers(0, 30, 400))
        links = rng.integers(1, 9, len(code))
        for c, n in zip(code.tolist(), links.tolist()):
            total[c >> doc_bits] += n
        kept[r] = File()
        alignment.write_run(kept[r], code, links, doc_bits, key_bits, 30)
        kept[r].rows = code, links
    open_file = alignment.files.open_file
    alignment.files.open_file = kept.__getitem__
    try:
        for radix in range(alignment.RADIX):
            merged = alignment.merge([alignment.RunReader(r, radix).blocks() for r in range(9)])
            out = File()
            w = alignment.RunWriter(out)
            for part in alignment.with_best(merged, bits_a):
                for lo in range(0, len(part[0]), 5):
                    w.add(radix, *[x[lo:lo + 5] for x in part])
            w.close()
            kept["c"] = out
            keys, sums, best = (np.concatenate(x) if x else [] for x in zip(
                *[alignment.RunReader("c", radix).pairs(f) for f in alignment.RunReader("c", radix).frames])) \
                if w.table else ([], [], [])
            mine = {k: n for k, n in total.items() if k >> key_bits == radix}
            assert dict(zip(map(int, keys), map(int, sums))) == mine
            top = {}
            for k, n in mine.items():
                top[k >> bits_a] = max(top.get(k >> bits_a, 0), n)
            assert [bool(x) for x in best] == [mine[int(k)] == top[int(k) >> bits_a] for k in keys]
            got = alignment.contribute([alignment.RunReader(r, radix) for r in range(9)], alignment.RunReader("c", radix))
            for r in range(9):
                want = np.zeros((2, 30), np.int64)
                for c, n in zip(*map(np.ndarray.tolist, kept[r].rows)):
                    k = c >> doc_bits
                    if k >> key_bits == radix:
                        want[:, c & 255] += [n * (total[k] == top[k >> bits_a]), n * total[k]]
                assert np.array_equal(np.array(got[r]), want)
    finally:
        alignment.files.open_file = open_file


def test_given_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert got(docs.repartition(5)) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, "")]])
def test_nothing_to_align(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == sorted(brute(rows), key=repr)


def test_stretches_do_not_outgrow_their_memory(monkeypatch):
    monkeypatch.setattr(alignment, "CACHE_ROWS", 5)
    m = alignment.Aligner(A, B)
    texts = [f"word{k} other{k}" for k in range(20)]
    one = [m.align([t])[3][0] for t in texts]
    assert m.cuts and len(m.known) <= 7
    assert m.align(texts)[3] == one
