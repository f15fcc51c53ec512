"""Which stored rows are still valid against the current inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fresh_rows(stored: DataFrame, current: DataFrame, key: str, text: str) -> DataFrame:
    """Rows of ``stored`` whose ``fingerprint`` equals that of the current text with their key; rows of changed or gone inputs are dropped."""
    return stored.join(current.select(key, fingerprint(F.col(text)).alias("fingerprint")), [key, "fingerprint"], "left_semi")
