"""The batched distributed trainer equals one-at-a-time merging; the encoder
agrees with the public ``tokenizers`` WordPiece model on the same vocabulary."""
import random

import pytest

from domainlab.operators import wordpiece as WP


def _serial(counts: dict[str, int], vocab_size: int, min_freq: int, specials: list[str]) -> list[str]:
    words = {w: [w[0]] + ["##" + c for c in w[1:]] for w in counts}
    alphabet = sorted({s for syms in words.values() for s in syms} | {c for w in counts for c in w})
    tokens = specials + [a for a in alphabet if a not in specials]
    while len(tokens) < vocab_size:
        pairs: dict[tuple[str, str], int] = {}
        for w, syms in words.items():
            for a, b in zip(syms, syms[1:]):
                pairs[(a, b)] = pairs.get((a, b), 0) + counts[w]
        cand = sorted(((-c, a, b) for (a, b), c in pairs.items() if c >= max(min_freq, 1)))
        if not cand:
            break
        _, a, b = cand[0]
        m = WP.merged_symbol(a, b)
        tokens.append(m)
        for w, syms in words.items():
            out, i = [], 0
            while i < len(syms):
                if i + 1 < len(syms) and syms[i] == a and syms[i + 1] == b:
                    out.append(m)
                    i += 2
                else:
                    out.append(syms[i])
                    i += 1
            words[w] = out
    return tokens


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batched_equals_serial(spark, seed):
    rnd = random.Random(seed)
    counts = {}
    for _ in range(60):
        w = "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 7)))
        counts[w] = counts.get(w, 0) + rnd.randint(1, 9)
    wc = spark.createDataFrame(list(counts.items()), "word string, count long")
    got = [r.token for r in WP.train_wordpiece(wc, 60, 2, specials=["[PAD]"]).orderBy("id").collect()]
    want = _serial(counts, 60, 2, ["[PAD]"])
    assert got == want


def test_encoder_matches_tokenizers_package():
    tokenizers = pytest.importorskip("tokenizers")
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers
    vocab = {"[PAD]": 0, "[UNK]": 1, "goo": 2, "g": 3, "##gle": 4, "##o": 5, "-": 6, "[": 7, "]": 8,
             ".": 9, "co": 10, "##m": 11, "c": 12, "a": 13, "##b": 14, "é": 15, "e": 16}
    tk = Tokenizer(models.WordPiece(vocab, unk_token="[UNK]"))
    tk.normalizer = normalizers.Sequence([normalizers.NFD(), normalizers.Lowercase(), normalizers.StripAccents()])
    tk.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    for text in ["google-co", "Google[.com]", "ab cab", "Éa", "x" * 120, "goog le"]:
        assert WP.encode_text(text, vocab, 1) == tk.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("top_k, max_segments", [(1000, 10_000), (30, 40), (3, 5)])
def test_rounds_on_segments_equal_serial(spark, top_k, max_segments):
    """Cut rankings, and more segments than allowed, change the rounds only."""
    rnd = random.Random(top_k)
    counts = {}
    for _ in range(200):
        w = "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 12)))
        counts[w] = counts.get(w, 0) + rnd.randint(1, 9)
    size = 300 if max_segments == 10_000 else 60
    wc = spark.createDataFrame(list(counts.items()), "word string, count long")
    got = [r.token for r in WP.train_wordpiece(wc, size, 2, ["[PAD]"], top_k, max_segments=max_segments)
           .orderBy("id").collect()]
    assert got == _serial(counts, size, 2, ["[PAD]"])


def test_registered_vocabulary_is_not_cut(spark):
    """The reference's size: merging ends only when no pair reaches the least frequency."""
    from domainlab.plans import catalog
    assert catalog.WP_VOCAB_SIZE == 32_393
    v = catalog.QUERIES["wordpiece_vocab_basic"](spark, "/root/testdata/sf0.001")
    tokens = [r.token for r in v.orderBy("id").collect()]
    assert len(tokens) == len(set(tokens))
    counts = {r["word"]: r["count"] for r in catalog._word_counts(catalog._splits(spark, "/root/testdata/sf0.001")).collect()}
    assert tokens == _serial(counts, 32_393, 2, tokens[:5])


def test_finetune_samples_hold_external_ids(spark):
    """M5: [CLS], the name without brackets, [SEP], padding; the mask marks all but padding."""
    from domainlab.plans import catalog
    sf, L = "/root/testdata/sf0.001", catalog.SUBWORD_L
    vocab = WP.vocab_dict(catalog._subword_vocab(catalog._splits(spark, sf)))
    rows = catalog.QUERIES["finetune_samples"](spark, sf).limit(50).collect()
    assert rows
    for r in rows:
        plain = r["domain"].replace("[", "").replace("]", "")
        want = [2] + WP.encode_text(plain, vocab, 1)[:L - 2] + [3]
        want += [0] * (L - len(want))
        assert r["ext_ids"] == " ".join(map(str, want)), r
        assert r["ext_mask"] == " ".join("1" if i else "0" for i in want)


def test_one_pass_matching_equals_the_longest_match_first():
    def greedy(w, vocab, unk):
        ids, start = [], 0
        while start < len(w):
            for end in range(len(w), start, -1):
                piece = w[start:end] if start == 0 else "##" + w[start:end]
                if piece in vocab:
                    ids.append(vocab[piece])
                    start = end
                    break
            else:
                return [unk]
        return ids

    rnd = random.Random(11)
    for _ in range(300):
        pieces = {("##" if rnd.random() < 0.6 else "") + "".join(rnd.choices("abc", k=rnd.randint(1, 6)))
                  for _ in range(rnd.randint(1, 25))}
        vocab = {p: k + 2 for k, p in enumerate(sorted(pieces))}
        m = WP.Pieces(vocab)
        for _ in range(60):
            w = "".join(rnd.choices("abcd" if rnd.random() < 0.1 else "abc", k=rnd.randint(1, 30)))
            assert m.encode(w, 1) == greedy(w, vocab, 1), (w, vocab)
    assert m.encode("a" * 101, 1) == [1]
