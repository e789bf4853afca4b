"""Column functions on wrapped domain strings (``naver[.co][.kr]``).

All are native Catalyst expressions, so no row reaches Python; the higher-order functions
among them are interpreted, outside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from domainlab.functions.util import to_col

# Fixed value that must equal the reference's: a bracket token is ``[.`` + one or
# more of letters, digits or ``-`` + ``]``.
TLD_TOKEN_PATTERN = r"(\[\.[a-zA-Z0-9-]+\])"


def tld_tokens(domain) -> Column:
    """T5: bracket tokens in order, duplicates kept, on the lower-cased string."""
    return F.regexp_extract_all(F.lower(to_col(domain)), F.lit(TLD_TOKEN_PATTERN), 1)


def strip_tlds(domain) -> Column:
    """Remove each extracted token from the lower-cased string, one plain
    replace-all per token in order (differs from a single regexp_replace only on
    nested brackets)."""
    d = F.lower(to_col(domain))
    return F.aggregate(tld_tokens(domain), d, lambda acc, t: F.replace(acc, t, F.lit("")))


def unwrap(domain) -> Column:
    """Drop bracket characters for an external vocabulary."""
    return F.translate(F.lower(to_col(domain)), "[]", "")


def ascii_normalize(text) -> Column:
    """T7 for ASCII text: NFD + strip accents are identities, so only lower-case."""
    return F.lower(to_col(text))


# Fixed value: punctuation = ASCII 33-47, 58-64, 91-96, 123-126 plus Unicode
# category P; a word is a run of anything else that is not whitespace, and every
# punctuation character is a word of its own.
PUNCT_CLASS = r"!-/:-@\[-`{-~\p{P}"
WORD_PATTERN = r"(?U)([^\s" + PUNCT_CLASS + r"]+|[" + PUNCT_CLASS + r"])"


def pretokenize(text, split: bool = True) -> Column:
    """Whitespace split with every punctuation character isolated; with
    ``split=False`` the whole (normalised) string is one word."""
    c = to_col(text)
    if not split:
        return F.array(c)
    return F.regexp_extract_all(c, F.lit(WORD_PATTERN), 1)
