"""NFD, lower-case, strip accents.

ASCII strings only need ``lower`` (NFD and accent stripping are identities), which
stays a JVM expression. Only non-ASCII rows go through an Arrow-batched pandas UDF
(Spark has no built-in Unicode normalisation), in the same pass: an ASCII row reaches the
Python worker as a NULL."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from domainlab.functions.util import to_col

ASCII_ONLY = r"^[\x00-\x7F]*$"


def _nfd_lower_strip(s: str) -> str:
    d = unicodedata.normalize("NFD", s).lower()
    return "".join(ch for ch in d if unicodedata.category(ch) != "Mn")


@F.pandas_udf(T.StringType())
def nfd_lower_strip(s: pd.Series) -> pd.Series:
    return s.map(_nfd_lower_strip, na_action="ignore")


def normalize(text) -> Column:
    """NULL stays NULL."""
    c = to_col(text)
    ascii_only = c.rlike(ASCII_ONLY)
    return F.when(ascii_only, F.lower(c)).otherwise(nfd_lower_strip(F.when(~ascii_only, c)))


def normalize_frame(df: DataFrame, col: str, out: str) -> DataFrame:
    """``df`` with ``out`` = :func:`normalize` of ``col``; one scan of the input."""
    return df.withColumn(out, normalize(col))
