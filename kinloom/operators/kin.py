"""Parents, spouses, children and members by joins (JOIN-01 to JOIN-09).

`edges` is (doc_id, src, dst, ref_type, idx) with FAMC and FAMS from a person to a family and HUSB, WIFE and CHIL from a family to a person;
`people` is (doc_id, xref). References to people who are not there are skipped, repeated ones stay. Every join is an equality on
(doc_id, key), so Catalyst and AQE choose and split it; nothing is gathered for a family or a person.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(edges: DataFrame, kind: str, src: str, dst: str, idx: str | None = None) -> DataFrame:
    kept = [F.col("idx").alias(idx)] if idx else []
    return edges.where(F.col("ref_type") == kind).select("doc_id", F.col("src").alias(src), F.col("dst").alias(dst), *kept)


def _known(rows: DataFrame, people: DataFrame, column: str) -> DataFrame:
    return rows.join(people.select("doc_id", F.col("xref").alias(column)), ["doc_id", column], "left_semi")


def _pair(edges: DataFrame) -> DataFrame:
    """(doc_id, family, husband, wife), null where there is none."""
    both = edges.where(F.col("ref_type").isin("HUSB", "WIFE")).groupBy("doc_id", F.col("src").alias("family"))
    one = lambda kind: F.max(F.when(F.col("ref_type") == kind, F.col("dst")))
    return both.agg(one("HUSB").alias("husband"), one("WIFE").alias("wife"))


def parents(edges: DataFrame, people: DataFrame) -> DataFrame:
    """JOIN-01: (doc_id, person, idx, role, parent) in the order of (idx, role), the husband first."""
    up = _of(edges, "FAMC", "person", "family", "idx").join(_pair(edges), ["doc_id", "family"])
    roles = F.array(F.struct(F.lit(0).alias("role"), F.col("husband").alias("parent")), F.struct(F.lit(1).alias("role"), F.col("wife").alias("parent")))
    both = up.select("doc_id", "person", "idx", F.explode(roles).alias("r")).select("doc_id", "person", "idx", "r.role", "r.parent").where("parent IS NOT NULL")
    return _known(both, people, "parent")


def spouses(edges: DataFrame, people: DataFrame) -> DataFrame:
    """JOIN-02: (doc_id, person, idx, spouse): the wife where the person is the husband, else the husband."""
    own = _of(edges, "FAMS", "person", "family", "idx").join(_pair(edges), ["doc_id", "family"])
    other = F.when(F.col("husband").eqNullSafe(F.col("person")), F.col("wife")).otherwise(F.col("husband"))
    return _known(own.select("doc_id", "person", "idx", other.alias("spouse")).where("spouse IS NOT NULL"), people, "spouse")


def children(edges: DataFrame, people: DataFrame) -> DataFrame:
    """JOIN-03: (doc_id, person, idx, child_idx, child)."""
    down = _of(edges, "FAMS", "person", "family", "idx").join(_of(edges, "CHIL", "family", "child", "child_idx"), ["doc_id", "family"])
    return _known(down.drop("family"), people, "child")


def families_of(edges: DataFrame, families: DataFrame, kind: str) -> DataFrame:
    """JOIN-04 (FAMC) and JOIN-05 (FAMS): (doc_id, person, idx, family) of families that are there."""
    return _known(_of(edges, kind, "person", "family", "idx"), families, "family")


def members(edges: DataFrame, people: DataFrame) -> DataFrame:
    """JOIN-06 to JOIN-09: (doc_id, family, role, idx, member): husband 0, wife 1, then children 2 by idx."""
    role: Column = F.when(F.col("ref_type") == "HUSB", 0).when(F.col("ref_type") == "WIFE", 1).otherwise(2)
    inside = edges.where(F.col("ref_type").isin("HUSB", "WIFE", "CHIL"))
    return _known(inside.select("doc_id", F.col("src").alias("family"), role.alias("role"), "idx", F.col("dst").alias("member")), people, "member")


def parent_of(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, src, dst, ord): parent to child, `ord` the order in which a person's children are met."""
    return children(edges, people).select("doc_id", F.col("person").alias("src"), F.col("child").alias("dst"), F.array("idx", "child_idx").alias("ord"))


def child_of(edges: DataFrame, people: DataFrame) -> DataFrame:
    """(doc_id, src, dst, ord): child to parent, fathers first."""
    return parents(edges, people).select("doc_id", F.col("person").alias("src"), F.col("parent").alias("dst"), F.array("idx", "role").alias("ord"))
