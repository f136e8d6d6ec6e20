"""Reachability by generations (GRAPH-01 to GRAPH-08).

A generation is one join of the frontier with the edges. Each new generation is written to the shared folder, so lineage does not grow
and a lost executor costs one generation; what was reached before is one table of these files and is anti-joined, so cycles end. The number of
jobs is that of the generations, the rows shuffled in one are those of its frontier and of what was reached.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import strings
from kinloom.shipping import fresh_path, written


def reach(edges: DataFrame, seeds: DataFrame, ordered: bool = False) -> DataFrame:
    """GRAPH-01, GRAPH-02, GRAPH-06: (doc_id, seed, node, depth) of every node that (doc_id, seed) reaches over (src, dst).

    A seed is not among its own results, even on a cycle; each node has its least depth. With `ordered`, edges have an `ord` array, and `path`
    sorts the nodes of one depth in the order in which a breadth-first walk discovers them.
    """
    spark: SparkSession = edges.sparkSession
    keep = ["doc_id", "src", "dst", "ord"] if ordered else ["doc_id", "src", "dst"]
    links = edges.select(*keep).where("src != dst")
    links = written(links if ordered else links.distinct(), "links").withColumnRenamed("src", "node")
    start = seeds.select("doc_id", "seed").distinct().withColumn("node", F.col("seed")).withColumn("depth", F.lit(0))
    start = start.withColumn("path", F.array().cast("array<int>")) if ordered else start
    folder, done = fresh_path(spark, "reach"), []

    def put(rows: DataFrame) -> DataFrame:
        done.append(f"{folder}/{len(done)}")
        rows.write.parquet(done[-1])
        return spark.read.schema(start.schema).parquet(done[-1])

    frontier = put(start)
    while not frontier.isEmpty():
        step = frontier.join(links, ["doc_id", "node"]).drop("node").withColumnRenamed("dst", "node")
        keys = step.groupBy("doc_id", "seed", "node")
        found = keys.agg(F.min(F.concat("path", "ord")).alias("path")) if ordered else keys.agg(F.lit(1).alias("__one")).drop("__one")
        before = spark.read.schema(start.schema).parquet(*done).select("doc_id", "seed", "node")
        new = found.join(before, ["doc_id", "seed", "node"], "left_anti").withColumn("depth", F.lit(len(done)))
        frontier = put(new.select(start.columns))
    return spark.read.schema(start.schema).parquet(*done).where("depth > 0")


def reached_people(edges: DataFrame, seeds: DataFrame, people: DataFrame, ordered: bool = False) -> DataFrame:
    """GRAPH-03, GRAPH-04: the rows of `people` that a seed reaches, with seed, depth and, if `ordered`, path; unknown people are left out."""
    found = reach(edges, seeds, ordered).withColumnRenamed("node", "xref")
    return found.join(people, ["doc_id", "xref"])


def closure(references: DataFrame, declared: DataFrame, seeds: DataFrame) -> DataFrame:
    """GRAPH-06: (doc_id, xref) of the seeds and everything they refer to, directly or not.

    A seed that is no pointer or unknown, and a reference from the closure to an unknown record, is an error that names it.
    """
    given = seeds.select("doc_id", F.col("xref").alias("seed")).distinct()
    chain = references.select("doc_id", "src", "dst").where("src != dst").distinct()
    named = given.select("doc_id", F.lit("all").alias("seed"), F.col("seed").alias("node"), F.lit(0).alias("depth"))
    roots = named.select("doc_id", F.lit("all").alias("src"), F.col("node").alias("dst"))
    inside = reach(chain.unionByName(roots), given.select("doc_id", F.lit("all").alias("seed")).distinct()).select("doc_id", F.col("node").alias("xref"))
    known = declared.select("doc_id", "xref", F.lit(True).alias("__known")).distinct()
    checked = inside.join(known, ["doc_id", "xref"], "left")
    lost = F.col("__known").isNull() | ~strings.is_pointer(F.col("xref"))
    name = F.when(lost, F.raise_error(F.concat(F.lit("unresolved reference: "), F.col("xref"))).cast("string")).otherwise(F.col("xref"))
    return checked.select("doc_id", name.alias("xref"))


def subset(records: DataFrame, inside: DataFrame) -> DataFrame:
    """GRAPH-07, GRAPH-08: the records of a closure and the header, whose pointers outside the closure go; rec_no keeps the order."""
    kept = records.join(inside.select("doc_id", "xref"), ["doc_id", "xref"], "left_semi")
    head = records.where("type = 'HEAD'")
    targets = head.select("doc_id", F.explode("tags").alias("t")).select("doc_id", F.col("t.value").alias("xref")).where(strings.is_pointer(F.col("xref")))
    gone = targets.join(inside, ["doc_id", "xref"], "left_anti").groupBy("doc_id").agg(F.collect_set("xref").alias("__gone"))
    cleaned = head.join(gone, "doc_id", "left").withColumn("tags", F.filter("tags", lambda t: ~F.coalesce(F.array_contains("__gone", t["value"]), F.lit(False))))
    return cleaned.drop("__gone").unionByName(kept)
