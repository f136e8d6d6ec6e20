"""Records validated while they stream in (STRM-01 to STRM-06).

What a record tells by itself is an issue at once; what it defines and refers to is appended to tables, which `finalize` compares when the
stream has ended: a reference may come before its record, and nothing expires. A repeated batch overwrites its own folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinloom.operators import rules
from kinloom.sources import entities, typed
from kinloom.streaming import orphans


def references(records: DataFrame) -> DataFrame:
    """STRM-01: (xref, ref_type, target, field): what people, families and sources refer to; texts of inline notes count as targets too."""
    people, couples, books = typed.individuals(records), typed.families(records), typed.sources(records)
    spread = lambda rows, array, kind, name, value="e": rows.select("xref", F.posexplode(array).alias("i", "e")).select("xref", F.lit(kind).alias("ref_type"), F.expr(value).alias("target"), F.concat(F.lit(name), F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("field"))
    one = lambda rows, column, kind: rows.select("xref", F.lit(kind).alias("ref_type"), F.expr(column).alias("target"), F.lit(column).alias("field"))
    parts = [
        spread(people, "child_in_families", "FAMC", "child_in_families", "e.family_xref"), spread(people, "spouse_in_families", "FAMS", "spouse_in_families"), spread(people, "associations", "ASSO", "associations", "e.individual_xref"),
        one(couples, "husband", "HUSB"), one(couples, "wife", "WIFE"), spread(couples, "children", "CHIL", "children"), one(books, "repository_link.xref", "REPO"),
        *(spread(rows, "citations", "SOUR", "citations", "e.source_xref") for rows in (people, couples)), *(spread(rows, "notes", "NOTE", "notes") for rows in (people, couples, books)),
    ]
    return reduce(DataFrame.unionByName, parts).where("target != ''")


def immediate(records: DataFrame) -> DataFrame:
    """STRM-01: issues that a record has by itself: death before birth."""
    return rules.by_code(rules.own_dates(entities.individuals(records)), "DEATH_BEFORE_BIRTH")


def collect(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Validates a stream of records (the columns of `tagged.records_of`); reads what is there and stops."""

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        rows.select("xref").where("xref != ''").distinct().write.mode("overwrite").parquet(f"{folder}/{orphans.DEFINITIONS}/batch={number}")
        references(rows).write.mode("overwrite").parquet(f"{folder}/{orphans.REFERENCES}/batch={number}")
        immediate(rows).write.mode("overwrite").parquet(f"{folder}/issues/batch={number}")
        rows.unpersist()

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finalize(spark: SparkSession, folder: str, strictness: str = "normal") -> DataFrame:
    """STRM-02, STRM-03, STRM-05: (severity, code, record_xref, related_xref): the immediate issues and one for each use of an undefined target."""
    lost = orphans.finalize(spark, folder).select(F.lit(rules.ERROR).alias("severity"), "code", "record_xref", "related_xref")
    own = spark.read.parquet(f"{folder}/issues").select("severity", "code", "record_xref", "related_xref")
    return rules.shown(own.unionByName(lost), strictness)


def reset(spark: SparkSession, folder: str) -> None:
    """STRM-04: forgets what was collected, wherever the folder lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
