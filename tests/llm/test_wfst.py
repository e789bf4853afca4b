"""The piece transducer against the library, for both kinds of vocabulary."""
import random

import pytest
import sentencepiece as sp
from sentencepiece import sentencepiece_model_pb2 as pb

from domainlab.llm import wfst
from domainlab.llm.queries import vocabulary
from domainlab.session import ship_package

PATH = vocabulary("piece_bpe_32k.model")
TEXTS = ["", " ", "  a", "a  b", "   ", "\n", "a\n b", "▁a▁", "▁<▁,", "한국어 日本語", "a\tb", " x", "x" * 300, "😀😀a",
         "the   the\n\n\nthe ", "<0x41> <s> </s>", "ﬁ 1²", "é, à. ß!", "a" * 30 + "," * 30]


def noise(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice("ab tehion \n▁é한.,!#0 19") for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_bpe_ids_are_the_library_s():
    m, lib = wfst.PieceTransducer.load(PATH), sp.SentencePieceProcessor(model_file=PATH)
    texts = TEXTS + noise(1500, 1)
    flat, n = m.encode_chunk(texts)
    assert n.tolist() == [len(lib.encode(t)) for t in texts]
    for t in texts:
        assert m.encode(t) == lib.encode(t), t
        assert m.decode(m.encode(t)) == lib.decode(lib.encode(t)), t
        if "▁" not in t:
            assert m.decode(m.encode(t)) == t


def test_unigram_paths_are_the_library_s(tmp_path):
    q = pb.ModelProto()
    with open(PATH, "rb") as f:
        q.ParseFromString(f.read())
    q.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p in q.pieces:
        p.score = max(p.score, -40_000.0)
    path = tmp_path / "unigram.model"
    path.write_bytes(q.SerializeToString())
    m, lib = wfst.PieceTransducer.load(str(path)), sp.SentencePieceProcessor(model_file=str(path))
    assert m.kind == "unigram"
    cost = lambda ids: sum(-m.scores[i] for i in ids)
    for t in noise(400, 2):
        a, b = m.encode(t), lib.encode(t)
        assert a == b or cost(a) == pytest.approx(cost(b)), t


def test_query_rows(spark):
    ship_package(spark)
    rows = [(1, None, 5), (2, "", 6), (3, "Ab c", 7), (3, "Ab c", 7), (None, "ö\n\nz", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = sorted((r["doc_id"] or 0, r["n_tokens"], r["decoded"]) for r in wfst.encode(df, PATH).collect())
    lib = sp.SentencePieceProcessor(model_file=PATH)
    assert got == sorted((d or 0, len(lib.encode(t or "")), t or "") for d, t, _ in rows)
    back = wfst.decode(wfst.encode(df, PATH, decode=False), PATH)
    assert sorted(r["text"] for r in back.collect()) == sorted(t or "" for _, t, _ in rows)
    assert wfst.encode(df.limit(0), PATH).collect() == []
