"""Line labels, mixing, sharding, token files, separator scan: brute force and awkward rows."""
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from domainlab.llm import linecrf, mixing, ring, sepscan, tokenfiles
from domainlab.llm import textvec as TV
from domainlab.llm.queries import END_OF_TEXT, vocabulary
from domainlab.llm.wordcache import WordEncoder
from domainlab.session import ship_package

WORDS = vocabulary("word_bpe_49k.json")
AWKWARD = [(1, None, "a", 9), (2, "", None, 9), (2, "", None, 9), (3, " \n\t", "b", 9), (None, "x y", "", 9),
           (4, "p q r p q r\np q r p q r\nend", "b", 9), (5, "w " * 30_000, "a", 9), (6, "é|ü #한 it's\x1cok\n\n", "c", 9)]
SCHEMA = "doc_id long, text string, source string, size int"


def base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = Counter(zip(w, w[1:], w[2:]))
    cover = {i + k for i in range(len(w) - 2) if runs[tuple(w[i:i + 3])] >= 2 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover)


def test_base_counts():
    r = random.Random(0)
    texts = [t for _, t, *_ in AWKWARD] + ["".join(r.choice("ab \n#|é") for _ in range(r.randint(0, 60))) for _ in range(800)]
    for size in (1, 500, 1 << 20):
        got = []
        for c in TV.chunks(pa.array(texts, pa.string()), size):
            b, _ = linecrf.measure(c)
            got += list(zip(*[v.tolist() for v in b.values()]))
        assert got == [base(t) for t in texts]


def test_viterbi_is_the_best_sequence():
    r = np.random.RandomState(1)
    for _ in range(60):
        m = linecrf.Model(np.zeros(linecrf.N_FEATURES), r.randn(2, 2), float(r.randn()))
        x = r.randn(r.randint(1, 8)).tolist()

        def score(y):
            s = m.start * y[0] + sum(v for v, k in zip(x, y) if k)
            return s + sum(m.moves[a, b] for a, b in zip(y, y[1:]))

        every = [[i >> k & 1 for k in range(len(x))] for i in range(1 << len(x))]
        assert score([int(k) for k in m.viterbi(x)]) == pytest.approx(max(map(score, every)))


def test_held_out_quality(spark):
    ship_package(spark)
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = linecrf.train(docs.where("doc_id % 2 = 0"), labels, sample_docs=300)
    out = linecrf.judge(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").where("not base_failed")
    n = {(r["quality"], r["kept"]): r["count"] for r in out.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.05 * n.get((0, False), 1)


def test_quality_awkward(spark):
    ship_package(spark)
    df = spark.createDataFrame(AWKWARD, SCHEMA)
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = linecrf.train(df, none)
    assert linecrf.judge(df, model).count() == len(AWKWARD)
    assert linecrf.drop_low_quality(df, model).columns == df.columns
    assert linecrf.judge(df.limit(0), model).collect() == []


def brute_mix(rows, seed=mixing.SEED):
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    d = [(i, s, base(t)[0], md5(f"{seed}|{'' if i is None else i}")) for i, t, s, *_ in rows]
    sources = sorted({s for _, s, *_ in d}, key=lambda s: (s is None, (s or "").encode()))
    size = {s: sum(x[2] for x in d if x[1] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * size[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.remove(s)
    out = []
    for s in sources:
        own = sorted((x for x in d if x[1] == s), key=lambda x: (x[2], x[3], x[0] or 0))
        rate = target[s] / size[s] if size[s] else 0.0
        u = int(md5(f"{seed}|{s or ''}")[:4], 16) / 65536
        for p, x in enumerate(own, 1):
            n = min(2, int(np.floor(p * rate + u) - np.floor((p - 1) * rate + u)))
            out.append((x[0] or 0, x[2], size[s], round(target[s], 6), n * x[2]))
    return sorted(out)


def test_mix(spark):
    r = random.Random(4)
    rows = AWKWARD + [(100 + i, "w " * r.choice([0, 1, 5, 5, 40]), r.choice(["a", "a", "b", "ü", "z", None]), 0)
                      for i in range(400)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = mixing.mix(df)
    got = sorted((x["doc_id"] or 0, x["mix"]["size"], x["mix"]["source_size"], round(x["mix"]["target"], 6),
                  x["mix"]["taken"]) for x in out.collect())
    assert got == brute_mix(rows)
    mixed = mixing.emit(df)
    assert mixed.columns == df.columns
    assert mixed.count() == out.agg(F.sum("mix.copies")).first()[0]
    assert mixing.emit(df.limit(0)).collect() == []


@pytest.mark.parametrize("direct", [1, 4096])
def test_ring_is_one_queue(spark, monkeypatch, direct):
    monkeypatch.setattr(ring, "ROW_BY_ROW", direct)
    rows = AWKWARD + [(7, "same", "a", 0)] * 150 + [(1000 + i, f"t{i}", "a", 0) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2).cache()
    out = ring.assign(df, 8).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(counts[s]))
    points = ring.points(spark, 8)
    walk, room = ring.walks(points), ring.capacities(len(rows), 8)
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    keys = df.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"),
                     ring._arc(F.pmod(F.xxhash64(F.lit("key"), F.col("doc_id")), F.lit(1 << 32)), points).alias("arc"),
                     F.monotonically_increasing_id().alias("m"))
    like = Window.partitionBy("doc_id", "size", "crc").orderBy("m")
    keys = keys.withColumn("u", F.row_number().over(like).cast("long") - 1)
    keys = keys.withColumn("p", F.xxhash64("doc_id", "size", "crc", "u").bitwiseAND(F.lit((1 << 62) - 1)))
    want = Counter()
    for r in sorted(keys.collect(), key=lambda r: r["p"]):
        s = next(x for x in walk[r["arc"]] if room[x] > 0)
        room[s] -= 1
        want[r["doc_id"], r["crc"], s] += 1
    assert Counter((r["doc_id"], r["text_crc32"], r["shard"]) for r in out) == want
    assert ring.assign(df.limit(0), 8).collect() == []


def test_ring_moves_little_when_a_shard_is_added(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text")).coalesce(1)
    a = {r["doc_id"]: r["shard"] for r in ring.assign(df, 8).collect()}
    b = {r["doc_id"]: r["shard"] for r in ring.assign(df, 9).collect()}
    # a ninth must move; plain modulo hashing would move eight ninths
    assert sum(a[k] != b[k] for k in a) < 0.2 * len(a)


def test_ring_does_not_depend_on_partitions(spark):
    rows = AWKWARD + [(7, "same", "a", 0)] * 400 + [(None, None, None, None)] * 300 + [(1000 + i, f"t{i}", "a", 0) for i in range(900)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [Counter((r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in ring.assign(d, 8).collect())
           for d in (df.coalesce(1), df.repartition(2), df.repartition(5, "text"))]
    assert got[0] == got[1] == got[2]


def thue_morse(n, a="a", b="b"):
    return "".join((a, b)[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096, 65_536])
def test_regular_words_are_told_apart(n):
    """A word of a regular two-letter pattern and its complement, which polynomial hashes mix up."""
    from domainlab.llm.wfst import PieceTransducer

    one, two = thue_morse(n), thue_morse(n, "b", "a")
    c = next(TV.chunks(pa.array([f"{one}\n{two}\n{one}"])))
    s, e, _ = c.words()
    h = c.hashes(s, e)
    assert h[0] != h[1] and h[0] == h[2] and c.distinct(s, e)[1].tolist() in ([0, 1, 0], [1, 0, 1])
    for text in (f"{one}\n{two}", f"{one}\n{one}"):
        found, _ = linecrf.measure(next(TV.chunks(pa.array([text]))))
        assert [v.tolist() for v in found.values()] == [[x] for x in base(text)]
    if n <= 4096:
        enc = WordEncoder(WORDS)
        text = f"{one} {two}"
        ids = enc.encode(next(TV.chunks(pa.array([text]))))[0]
        assert ids.tolist() == Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids
        import sentencepiece
        model = vocabulary("piece_bpe_32k.model")
        assert PieceTransducer.load(model).encode(text) == sentencepiece.SentencePieceProcessor(model_file=model).encode(text)


def test_hashes_that_agree_are_compared(monkeypatch):
    """Ranges of one hash are still told apart by their bytes."""
    monkeypatch.setattr(TV.Chunk, "hashes", lambda self, s, e: np.zeros(len(s), np.uint64))
    c = next(TV.chunks(pa.array(["ab cd ab", "cd ef ab"])))
    s, e, _ = c.words()
    first, which = c.distinct(s, e)
    words = [bytes(c.buf[a:z]) for a, z in zip(s, e)]
    assert [words[first[k]] for k in which] == words and len(first) == 3


def test_mix_keeps_any_columns(spark):
    names = ["mix", "_size", "_rate", "_source", "_copy", "_place", "c0", "_hash"]
    df = spark.createDataFrame([(1, "a b c", "x", *range(8)), (2, "d", "x", *range(8)), (3, None, None, *range(8))],
                               "doc_id long, text string, source string, " + ", ".join(f"{n} int" for n in names))
    out = mixing.emit(df)
    assert out.columns == df.columns and {tuple(r) for r in out.collect()} <= {tuple(r) for r in df.collect()}
    assert out.count() == mixing.mix(df).agg(F.sum("mix.copies")).first()[0]


def test_words_are_the_library_s():
    r = random.Random(2)
    lib, enc = Tokenizer.from_file(WORDS), WordEncoder(WORDS)
    texts = [t or "" for _, t, *_ in AWKWARD] + ["<|endoftext|>", "a<|endoftext|>b", "ΑΣ", "é ́a", "it's ÀÉ×÷"] + [
        "".join(r.choice("abÉßñ 'stre \n\té́Σ한.,!#0 19İ\xa0<|") for _ in range(r.randint(0, 40))) for _ in range(1500)]
    got = []
    for c in TV.chunks(pa.array(texts, pa.string()), 5000):
        flat, n = enc.encode(c)
        got += [x.tolist() for x in np.split(flat, np.cumsum(n)[:-1])]
    assert got == [lib.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 20, 32])
def test_packing(bits, tmp_path):
    from domainlab.llm import files

    r = np.random.RandomState(bits)
    docs = [r.randint(0, 1 << bits, n, dtype=np.int64).astype(np.uint32) for n in (0, 1, 7, 500, 0, 64, 3)]
    for ids in docs:
        assert (tokenfiles.unpack(tokenfiles.pack(ids, bits), len(ids), bits) == ids).all()
    path = str(tmp_path / "x.fwt")
    with files.create(path) as out:
        w = tokenfiles.Writer(out, bits, block=16)
        w.add([5, None, 7], np.concatenate(docs[:3]), np.array([0, 1, 7]))
        w.add([8, 9, 10, 11], np.concatenate(docs[3:]), np.array([500, 0, 64, 3]))
        w.close()
    with files.open_file(path) as f:
        reader = tokenfiles.Reader(f)
        flat = np.concatenate(docs)
        assert [(s, i, x.tolist()) for s, i, x in reader.documents(most=100)] == [
            (int(s), i, d.tolist()) for s, i, d in zip(np.cumsum([0] + [len(d) for d in docs]), [5, None, 7, 8, 9, 10, 11], docs)]
        for a, b in ((0, 0), (3, 40), (100, 575), (15, 17)):
            assert (reader.read(a, b) == flat[a:b]).all()


def test_token_files(spark):
    ship_package(spark)
    df = spark.createDataFrame(AWKWARD, SCHEMA).repartition(3)
    lib = Tokenizer.from_file(WORDS)
    ids = {(d or -1, zlib.crc32(np.array(lib.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
           for d, t, *_ in AWKWARD}
    got = tokenfiles.round_trip(df, WORDS, 1).collect()
    assert {(r["doc_id"] or -1, r["ids_crc32"]) for r in got} == ids and len(got) == len(AWKWARD)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] or 0 for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order)
    assert tokenfiles.round_trip(df.limit(0), WORDS, 1).collect() == []


@pytest.mark.parametrize("block", [1, 3, 8, 1000])
def test_separator_scan(spark, tmp_path, block):
    ship_package(spark)
    r = np.random.RandomState(block)
    rows, want = [], set()
    for k, n in enumerate((0, 1, 5, 40, 40)):
        ids = r.randint(0, 4 if k < 4 else 1000, n).astype("<u2")
        path = str(tmp_path / f"{k}.bin")
        ids.tofile(path)
        rows.append((path, 2 * n))
        start = ordinal = 0
        for i, x in enumerate(ids.tolist()):
            if x == 3:
                want.add((path, ordinal, start, i + 1 - start, True))
                start, ordinal = i + 1, ordinal + 1
        if start < n:
            want.add((path, ordinal, start, n - start, False))
    sizes = spark.createDataFrame(rows, "path string, bytes long")
    got = sepscan.count_tokens(spark, sizes, 3, 2, block)
    assert {tuple(r) for r in got.select("path", "ordinal", "start", "n_tokens", "closed").collect()} == want


def test_separator_scan_of_documents(spark):
    ship_package(spark)
    df = spark.createDataFrame(AWKWARD + [(9, "a<|endoftext|>b", "a", 0)], SCHEMA).repartition(2)
    lib = Tokenizer.from_file(WORDS)
    lib.encode_special_tokens = True
    want = sorted((d or 0, len(lib.encode(t or "", add_special_tokens=False).ids) + 1)
                  for d, t in df.select("doc_id", "text").collect())
    got = sepscan.count_documents(df, WORDS, END_OF_TEXT, block=64)
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in got.collect()) == want
    assert sepscan.count_documents(df.limit(0), WORDS, END_OF_TEXT).collect() == []


def test_prefix_scan_leaves_the_ends_behind(spark, tmp_path):
    """The window over a file's blocks must not carry each block's array of ends."""
    np.array([1, 3, 2, 2, 3, 1], "<u2").tofile(tmp_path / "a.bin")
    sizes = spark.createDataFrame([(str(tmp_path / "a.bin"), 12)], "path string, bytes long")
    got = sepscan.count_tokens(spark, sizes, 3, 2, 2)
    assert sorted(r["n_tokens"] for r in got.collect()) == [1, 2, 3]
    todo, windows = [got._jdf.queryExecution().optimizedPlan()], 0
    while todo:
        node = todo.pop()
        todo += [node.children().apply(k) for k in range(node.children().size())]
        if node.nodeName() == "Window":
            windows += 1
            assert "ends" not in [node.output().apply(k).name() for k in range(node.output().size())]
    assert windows
