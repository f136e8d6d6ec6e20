"""What the operators share: tables, the shared folder, cut lineage, and bounded samples for fitting."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinloom.shipping import fresh_path, ship, written  # noqa: F401

def arrow_map(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """`df.mapInArrow`, on executors that have this package."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def size_on_disk(spark: SparkSession, df: DataFrame) -> int:
    """Bytes of the files that a written table consists of."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for name in df.inputFiles():
        path = jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    return total


def fold(id_column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % folds


def bounded_sample(df: DataFrame, key: str, stratum: str, per_stratum: int) -> DataFrame:
    """About `per_stratum` rows of each value of `stratum`, chosen by a hash of `key`, so the same on each run.

    For fitting only. The bound is `per_stratum` times the number of strata; strata smaller than that stay whole.
    """
    counts = df.groupBy(stratum).count().collect()
    if not counts:
        return df.limit(0)
    most = 1 << 30
    share = F.lit(0)
    for row in counts:
        if row[0] is not None:
            share = F.when(F.col(stratum) == F.lit(row[0]), F.lit(min(most, int(most * per_stratum / row["count"]) + 1))).otherwise(share)
    return df.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(most)) < share)


def sampled_texts(docs: DataFrame, chosen: DataFrame | None, id_column: str, text_column: str, most_chars: int, more: dict[str, Column] | None = None) -> pd.DataFrame:
    """(id, text, and what `chosen` or `more` has besides) of the rows of `docs`, those that `chosen` has if it is given, in order of id and text.

    For fitting only, on a sample whose rows are bounded already. Should its texts together have more than `most_chars`
    characters, a smaller part of its rows is taken, by a hash of the id, so long texts and short ones stay as likely as each other.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), *(c.alias(n) for n, c in (more or {}).items()))
    rows = written(rows if chosen is None else rows.join(F.broadcast(chosen), "id"), "sample")
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    if total > most_chars:
        rows = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(13)), F.lit(1 << 30)) < int((1 << 30) * most_chars / total))
    return rows.toPandas().sort_values(["id", "text"])
