"""Encoding (J1-J3, K1, K3, K4, K6, K8): native higher-order functions only.

The vocabulary is a bounded table (specials + kept TLDs + 38 characters, or a
subword vocabulary of ~32k entries). :class:`Vocab` collects it once behind a size
check and turns it into literal lookups of constant cost (an offset for the fixed
alphabet, an array by id for decoding, small maps in an array by hash for TLD tokens),
so encoding is a narrow projection with no join and no shuffle. Characters are code
points (``(?s)(.)``)."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domainlab.functions import tokens as TK
from domainlab.functions.util import to_col
from domainlab.operators.vocab import CHAR_ALPHABET, CLS, PAD, SEP, SPARSE_TLD, TRUNC, UNK

MAX_VOCAB_ROWS = 200_000


@dataclass
class Vocab:
    """Driver-side view of a bounded vocabulary table ``(token, id, kind)``."""
    tld_ids: dict[str, int]
    max_special_id: int
    id_to_token: dict[int, str]

    @classmethod
    def from_table(cls, vocab: DataFrame) -> "Vocab":
        rows = vocab.limit(MAX_VOCAB_ROWS + 1).collect()
        if len(rows) > MAX_VOCAB_ROWS:
            raise ValueError(f"vocabulary larger than {MAX_VOCAB_ROWS} rows")
        tld = {r["token"]: int(r["id"]) for r in rows if r["kind"] == "tld"}
        specials = [int(r["id"]) for r in rows if r["kind"] in ("special", "tld")]
        return cls(tld, max(specials), {int(r["id"]): r["token"] for r in rows})

    @property
    def char_offset(self) -> int:
        return self.max_special_id + 1

    def token_array(self) -> Column:
        """Tokens by id (NULL where no token has the id)."""
        size = max(self.id_to_token, default=-1) + 1
        return constant([self.id_to_token.get(i) for i in range(size)], "array<string>")


def constant(value, ddl: str) -> Column:
    """A constant of type ``ddl``: one literal that the optimizer parses once."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def hashed_lookup(ids: dict[str, int]) -> Callable[[Column], Column]:
    """Key -> id (NULL if unknown) at a cost that does not grow with ``ids``: a map
    constant is searched key by key, so the keys are dealt by hash to small maps."""
    n = max(1, len(ids) // 4)
    maps: list[dict[str, int]] = [{} for _ in range(n)]
    for key, i in ids.items():
        maps[zlib.crc32(key.encode()) % n][key] = i
    table = constant(maps, "array<map<string,int>>")
    return lambda key: F.try_element_at(F.get(table, (F.crc32(key.cast("binary")) % n).cast("int")), key)


def chars(text) -> Column:
    return F.regexp_extract_all(to_col(text), F.lit("(?s)(.)"), 1)


def char_ids(text, vocab: Vocab) -> Column:
    """Each character -> its id (offset + alphabet position), unknown -> UNK."""
    off = vocab.char_offset

    def one(c):
        p = F.instr(F.lit(CHAR_ALPHABET), c)
        return F.when(p > 0, p + (off - 1)).otherwise(F.lit(UNK)).cast("int")
    return F.transform(chars(text), one)


def tld_ids(domain, vocab: Vocab) -> Column:
    """Each bracket token -> its id, unknown -> SPARSE_TLD."""
    find = hashed_lookup(vocab.tld_ids)
    return F.transform(TK.tld_tokens(domain), lambda t: F.coalesce(find(t), F.lit(SPARSE_TLD)).cast("int"))


def encode_char(domain, vocab: Vocab) -> Column:
    """K1: character ids of the SLD followed by the TLD ids."""
    return F.concat(char_ids(TK.strip_tlds(domain), vocab), tld_ids(domain, vocab))


def decode(ids, vocab: Vocab, sep: str = " ") -> Column:
    """Ids -> tokens joined by ``sep`` (unknown ids -> ``[UNK]``)."""
    tokens = vocab.token_array()
    return F.array_join(F.transform(to_col(ids), lambda i: F.coalesce(F.get(tokens, i), F.lit("[UNK]"))), sep)


def _pads(n: Column) -> Column:
    return F.array_repeat(F.lit(PAD), F.greatest(n, F.lit(0)))


def _last(ids: Column, k: int) -> Column:
    return F.slice(ids, F.greatest(F.size(ids) - k + 1, F.lit(1)), k)


def pack_pretrain(ids, L: int) -> Column:
    """K3: ``n > L-2`` -> [TRUNC] + last L-2 + [SEP]; else ids + [SEP] + pads (no CLS)."""
    a = to_col(ids)
    n = F.size(a)
    trunc = F.concat(F.array(F.lit(TRUNC)), _last(a, L - 2), F.array(F.lit(SEP)))
    fit = F.concat(a, F.array(F.lit(SEP)), _pads(F.lit(L) - n - 1))
    return F.when(n > L - 2, trunc).otherwise(fit)


def pack_finetune(ids, L: int) -> Column:
    """K4: ``n > L-3`` -> [CLS][TRUNC] + last L-3 + [SEP]; else [CLS] + ids + [SEP] +
    pads (``n = L-2`` would fit but is truncated, as in the reference)."""
    a = to_col(ids)
    n = F.size(a)
    trunc = F.concat(F.array(F.lit(CLS), F.lit(TRUNC)), _last(a, L - 3), F.array(F.lit(SEP)))
    fit = F.concat(F.array(F.lit(CLS)), a, F.array(F.lit(SEP)), _pads(F.lit(L) - n - 2))
    return F.when(n > L - 3, trunc).otherwise(fit)


def template(ids) -> Column:
    """K6: ``[CLS] A [SEP]``."""
    return F.concat(F.array(F.lit(CLS)), to_col(ids), F.array(F.lit(SEP)))


def pad_mask(ids) -> Column:
    """K8: true where the id is PAD."""
    return F.transform(to_col(ids), lambda x: x == PAD)
