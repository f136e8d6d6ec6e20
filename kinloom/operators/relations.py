"""Relations between records: references without a record, what is referenced how often, and shared keys (JOIN-10, AGG-05, JOIN-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def orphans(references: DataFrame, declared: DataFrame, target: str, key: str) -> DataFrame:
    """JOIN-10: references whose `target` no row of `declared` has as `key`; null targets are no references."""
    known = declared.select(F.col(key).alias("__key"))
    return references.where(F.col(target).isNotNull()).join(known, F.col(target) == F.col("__key"), "left_anti")


def reference_report(references: DataFrame, declared: DataFrame, kind: str, target: str, key: str) -> DataFrame:
    """AGG-05: (kind, total, valid, orphaned, unique_orphaned) of references.

    References are counted for each target before they meet the records, so a target that is used very often is one row.
    """
    used = references.where(F.col(target).isNotNull()).groupBy(kind, target).agg(F.count("*").alias("n"))
    known = declared.select(F.col(key).alias("__key")).distinct()
    met = used.join(known, F.col(target) == F.col("__key"), "left").withColumn("lost", F.col("__key").isNull())
    return met.groupBy(kind).agg(
        F.sum("n").alias("total"),
        F.sum(F.when(F.col("lost"), 0).otherwise(F.col("n"))).alias("valid"),
        F.sum(F.when(F.col("lost"), F.col("n")).otherwise(0)).alias("orphaned"),
        F.count(F.when(F.col("lost"), 1)).alias("unique_orphaned"),
    )


def shared_keys(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """JOIN-14: (key) that both tables have, each once."""
    return left.select(F.col(left_key).alias("key")).intersect(right.select(F.col(right_key).alias("key")))
