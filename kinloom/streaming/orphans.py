"""References without a target, found in a stream (STRM-01 to STRM-06).

Each batch of records appends its definitions and its references to two tables; the end of the stream is a left anti-join of the whole.
Nothing is kept in state, nothing expires, and a repeated batch overwrites its own folder, so a restart counts nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DEFINITIONS, REFERENCES = "definitions", "references"


def collect(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """STRM-01: `stream` is (xref, ref_type, target), target null for a definition only; reads what is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.select("xref").where("xref IS NOT NULL").distinct().write.mode("overwrite").parquet(f"{folder}/{DEFINITIONS}/batch={number}")
        rows.where("target IS NOT NULL").write.mode("overwrite").parquet(f"{folder}/{REFERENCES}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finalize(spark: SparkSession, folder: str) -> DataFrame:
    """STRM-02, STRM-03, SET-03: (code, record_xref, related_xref), one row for each use of an undefined target."""
    seen = spark.read.parquet(f"{folder}/{DEFINITIONS}").select(F.col("xref").alias("target"))
    lost = spark.read.parquet(f"{folder}/{REFERENCES}").join(seen, "target", "left_anti")
    return lost.select(F.concat(F.lit("ORPHANED_"), "ref_type").alias("code"), F.col("xref").alias("record_xref"), F.col("target").alias("related_xref"))


def counts(spark: SparkSession, folder: str) -> DataFrame:
    """AGG-15, AGG-16: (seen, used) distinct identifiers so far."""
    seen = spark.read.parquet(f"{folder}/{DEFINITIONS}").agg(F.count_distinct("xref").alias("seen"), F.lit(1).alias("__one"))
    used = spark.read.parquet(f"{folder}/{REFERENCES}").agg(F.count_distinct("target").alias("used"), F.lit(1).alias("__one"))
    return seen.join(used, "__one").select("seen", "used")
