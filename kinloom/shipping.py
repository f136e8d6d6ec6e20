"""The package on the executors, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives this package to the executors, once for each application, as they need not have it installed."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="kinloom-")) / "kinloom.zip"
    with zipfile.ZipFile(target, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where that setting is absent and all of Spark runs in one process (tests) a folder is made and kept for the session;
    on a cluster its absence is an error, as the driver's own disk is not there for the executors.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not (own := spark.conf.get("kinloom.shared.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = "file://" + tempfile.mkdtemp(prefix="kinloom-")
        spark.conf.set("kinloom.shared.dir", own)
    return own


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read back: a cut in lineage that survives lost executors."""
    path = fresh_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
