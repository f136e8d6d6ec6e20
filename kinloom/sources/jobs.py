"""Progress and cancellation of the jobs that an action starts (SRC-41, SRC-42)."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def group(spark: SparkSession, name: str) -> Iterator[None]:
    """Actions inside belong to the group `name`, which `cancel` stops and `progress` reports."""
    spark.sparkContext.setJobGroup(name, name, interruptOnCancel=True)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, name: str) -> None:
    spark.sparkContext.cancelJobGroup(name)


def progress(spark: SparkSession, name: str) -> tuple[int, int]:
    """(tasks done, tasks known) of a group; -1 known where it has started no stage yet."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for job in tracker.getJobIdsForGroup(name) if (info := tracker.getJobInfo(job)) for i in info.stageIds if (s := tracker.getStageInfo(i))]
    return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages) if stages else -1
