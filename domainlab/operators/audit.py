"""Compare the previous wrapper with the current one on the same names.

Rows, tagged with their source (P9), are reduced to one per original name (A2, smallest
source first) before any lookup; one probe of the suffix lookup then serves both
wrappers (J4), and the names whose prefix the previous wrapper lost (P7) are kept; U2 is
the subset whose original has exactly three dot parts (P8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domainlab.functions import suffix as S
from domainlab.operators.prep import dedup


def audit_wrap(df: DataFrame, col: str, source_col: str, index: S.SuffixIndex
               ) -> tuple[DataFrame, DataFrame]:
    base = df.select(F.lower(col).alias("original_domain"), F.col(source_col).alias("source_file"))
    base = dedup(base, ["original_domain"], ["source_file"])
    both = S.wrap_pair(base, "original_domain", index, "processed_domain", "processed_domain2")
    bad = both.where(F.col("processed_domain").startswith("[")).select(
        "original_domain", "processed_domain", "processed_domain2", "source_file")
    three = bad.where(F.size(F.split("original_domain", r"\.", -1)) == 3)
    return bad, three


def with_source_file(df: DataFrame, out: str = "source_file") -> DataFrame:
    """Tag rows with the name of the file they were read from."""
    return df.withColumn(out, F.col("_metadata.file_name"))
