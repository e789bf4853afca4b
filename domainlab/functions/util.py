from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ids_text(c) -> Column:
    """Space-joined text form of an integer array (stable for hashing/CSV)."""
    return F.array_join(F.transform(to_col(c), lambda x: x.cast("string")), " ")
