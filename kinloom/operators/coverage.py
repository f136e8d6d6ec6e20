"""Coverage and issue summaries (AGG-01 to AGG-03, SORT-02)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def coverage(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """AGG-01: for each value of `by` its rows and, for each field, how many rows have it (neither null nor '')."""
    filled = [F.count(F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), 1)).alias(f"with_{f}") for f in fields]
    return rows.groupBy(by).agg(F.count("*").alias("total"), *filled)


def top_codes(issues: DataFrame, code: str, n: int = 5) -> DataFrame:
    """SORT-02: the `n` most frequent codes, ties by code."""
    return issues.groupBy(code).agg(F.count("*").alias("n")).orderBy(F.desc("n"), code).limit(n)
