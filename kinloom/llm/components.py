"""Connected components of a link table by repeated contraction, with DataFrame operations only.

In each round every node points to the least of itself and its neighbours, in the order of a hash, so that sorted
chains do not make it slow; links are renamed to those targets, and links within one target vanish. The rounds' maps
are then composed. Each round is an aggregate with map-side combination and two joins by key, in which Spark splits hot keys;
its tables lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root): for each node with a link to another node, one node of its component, the same for all of them.

    Nulls and links of a node with itself are ignored; repeated links are harmless; no link gives no row.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    edges, maps = written(edges.distinct(), "edges"), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = F.min(F.struct(F.xxhash64("v").alias("h"), F.col("v").alias("n")))
        own = F.struct(F.xxhash64("u").alias("h"), F.col("u").alias("n"))
        step = written(both.groupBy("u").agg(least.alias("m")).select("u", F.least("m", own)["n"].alias("to")), "step")
        maps.append(step)
        moved = edges.join(step, "u").select(F.col("to").alias("a"), "v")
        moved = moved.join(step.withColumnRenamed("u", "v"), "v").select("a", F.col("to").alias("b")).where("a <> b")
        edges = written(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    root = maps[-1].select(F.col("u").alias("node"), F.col("to").alias("root"))
    for step in reversed(maps[:-1]):
        later = root.withColumnsRenamed({"node": "to", "root": "last"})
        root = step.join(later, "to", "left").select(F.col("u").alias("node"), F.coalesce("last", "to").alias("root"))
    return root
