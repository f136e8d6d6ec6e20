"""Joining two sets of records: colliding identifiers, new identifiers, header conflicts (SET-01, JOIN-14, MERGE-01 to MERGE-08, AGG-13, WIN-08).

Mappings are tables and are applied by joins, so their size does not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import strings
from kinloom.sources import tagged

#: Rows that one task numbers; numbering runs within blocks of this many places and then adds the blocks before.
BLOCK = 100_000


def collisions(first: DataFrame, second: DataFrame) -> DataFrame:
    """JOIN-14: (xref, place) of `second` that `first` has too; repeated ones stay. `place` is the order."""
    return second.select("xref", "place").where("xref != ''").join(first.select("xref"), "xref", "left_semi")


def prefixed(colliding: DataFrame, prefix: str) -> DataFrame:
    """MERGE-04: (old, new): the prefix goes between the sign and the letters; an empty one is an error."""
    if not prefix:
        raise ValueError("the prefix is empty")
    return colliding.select(F.col("xref").alias("old"), F.concat(F.lit(f"@{prefix}"), F.substring("xref", 2, 1_000_000_000)).alias("new")).distinct()


def renumbered(first: DataFrame, second: DataFrame, colliding: DataFrame) -> DataFrame:
    """MERGE-05, AGG-13, WIN-08: (old, new): numbers of their own prefix beyond the largest of both sets, in order of `place`.

    Identifiers that are not letters and digits keep no number and get that of an empty prefix 'X'. Running numbers are counted
    within blocks and offset by the blocks before, so no prefix is numbered by one task.
    """
    part = strings.id_number(F.col("xref"))
    prefix = F.coalesce(part["prefix"], F.lit("X"))
    largest = first.select("xref").unionAll(second.select("xref")).select(prefix.alias("prefix"), part["number"].alias("n")).groupBy("prefix").agg((F.max("n") + 1).alias("base"))
    once = colliding.groupBy("xref").agg(F.min("place").alias("place")).withColumn("prefix", prefix).withColumn("block", F.floor(F.col("place") / BLOCK))
    inside = once.withColumn("n", F.row_number().over(Window.partitionBy("prefix", "block").orderBy("place", "xref")))
    sizes = once.groupBy("prefix", "block").agg(F.count("*").alias("size"))
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("size").over(Window.partitionBy("prefix").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = inside.join(offsets.drop("size"), ["prefix", "block"]).join(largest, "prefix", "left")
    number = F.coalesce("base", F.lit(0)) + F.col("offset") + F.col("n") - 1
    return numbered.select(F.col("xref").alias("old"), F.concat(F.lit("@"), "prefix", number.cast("string"), F.lit("@")).alias("new"))


def checked(mapping: DataFrame, existing: DataFrame) -> DataFrame:
    """MERGE-01: the mapping, with an error for a new identifier that is no pointer, is given twice, or is there already."""
    twice = mapping.groupBy("new").agg(F.count("*").alias("n"))
    taken = existing.select(F.col("xref").alias("new"), F.lit(True).alias("taken")).distinct()
    rows = mapping.join(twice, "new").join(taken, "new", "left")
    bad = ~strings.is_pointer(F.col("new")) | (F.col("n") > 1) | F.col("taken").isNotNull()
    new = F.when(bad, F.raise_error(F.concat(F.lit("cannot use identifier "), F.col("new"))).cast("string")).otherwise(F.col("new"))
    return rows.select("old", new.alias("new"))


def remap(rows: DataFrame, mapping: DataFrame, *columns: str) -> DataFrame:
    """MERGE-02: `rows` with the identifiers in `columns` replaced, in one pass: a new identifier is not replaced again."""
    for column in columns:
        names = mapping.select(F.col("old").alias(column), F.col("new").alias("__new"))
        rows = rows.join(names, column, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")
    return rows


def apply_mapping(records: DataFrame, mapping: DataFrame) -> DataFrame:
    """MERGE-02: records with the identifiers of a mapping (doc_id, old, new) replaced on record lines and in every value that is a pointer.

    One pass, so a new identifier is not replaced again, and no text is rewritten. Only the pointers of a record that the mapping has travel
    through the join, and come back as one map for each record.
    """
    used = records.select("doc_id", "rec_no", F.explode(F.array_distinct(F.flatten(F.transform("tags", lambda t: F.array(t["xref"], strings.trim_space(t["value"])))))).alias("old"))
    met = used.where(strings.is_pointer(F.col("old"))).join(mapping, ["doc_id", "old"])
    maps = met.groupBy("doc_id", "rec_no").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__new"))
    joined = records.join(maps, ["doc_id", "rec_no"], "left")

    def renamed(t: Column) -> Column:
        of = lambda x: F.coalesce(F.try_element_at(F.col("__new"), x), t["value"])
        value = F.when(strings.is_pointer(strings.trim_space(t["value"])), of(strings.trim_space(t["value"]))).otherwise(t["value"])
        own = {"xref": F.coalesce(F.try_element_at(F.col("__new"), t["xref"]), t["xref"]), "value": value}
        return F.struct(*(own.get(n, t[n]).alias(n) for n in ("line_number", "level", "xref", "tag", "value", "code", "message")))

    changed = joined.withColumns({"tags": F.when(F.col("__new").isNull(), F.col("tags")).otherwise(F.transform("tags", renamed)), "xref": F.coalesce(F.try_element_at("__new", F.col("xref")), "xref")})
    return changed.select(records.columns)


class IncompatibleHeaders(ValueError):
    """Two sets of records state different versions or encodings."""


class Collision(ValueError):
    """Two sets of records share identifiers, and no strategy says what to do."""


def combine(first: DataFrame, second: DataFrame, strategy: str = "error", prefix: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """SET-01, MERGE-03, MERGE-06: (records, mapping, conflicts) of the second document put behind the first one.

    `strategy` says what becomes of identifiers of the second that the first has: "error", "prefix" or "renumber". Both headers must state the
    same version and encoding, where both state one. The first one's header values win, the second's tags come behind its own.
    """
    heads = [tagged.header(x).join(tagged.detect_version(x), "doc_id") for x in (first, second)]
    stated = [h.select("version", "encoding").first() for h in heads]
    for field in ("version", "encoding"):
        if all(stated) and stated[0][field] and stated[1][field] and stated[0][field] != stated[1][field]:
            raise IncompatibleHeaders(f"{field}: {stated[0][field]} and {stated[1][field]}")
    names = [x.where("xref != ''").select("xref", F.col("rec_no").cast("long").alias("place")) for x in (first, second)]
    colliding = collisions(*names)
    if strategy == "error":
        if shared := colliding.limit(10).collect():
            raise Collision("both have " + ", ".join(r.xref for r in shared))
        mapping = colliding.select(F.col("xref").alias("old"), F.col("xref").alias("new"))
    elif strategy == "prefix":
        mapping = checked(prefixed(colliding, prefix), names[0].unionByName(names[1]))
    elif strategy == "renumber":
        mapping = checked(renumbered(*names, colliding), names[0].unionByName(names[1]))
    else:
        raise ValueError(f"unknown strategy {strategy}")
    name, last = first.agg(F.coalesce(F.min("doc_id"), F.lit("")), F.coalesce(F.max("rec_no"), F.lit(0))).first()
    moved = apply_mapping(second.withColumn("doc_id", F.lit(name)), mapping.select(F.lit(name).alias("doc_id"), "old", "new"))
    behind = moved.where("type NOT IN ('HEAD', 'TRLR')").withColumn("rec_no", F.col("rec_no") + F.lit(last + 1)).select(first.columns)
    more = moved.where("type = 'HEAD'").limit(1).select("doc_id", F.slice("tags", F.lit(2), F.greatest(F.size("tags") - 1, F.lit(0))).alias("__more"))
    own = first.where("type = 'HEAD'").join(F.broadcast(more), "doc_id", "left").withColumn("tags", F.concat("tags", F.coalesce("__more", F.array().cast(first.schema["tags"].dataType)))).select(first.columns)
    fields = ["version", "encoding", "source_system", "language", "copyright", "tree_id"]
    conflicts = merged_headers(heads[0], heads[1], fields)[1]
    return own.unionByName(first.where("type NOT IN ('HEAD', 'TRLR')")).unionByName(behind), mapping, conflicts


def merged_headers(first: DataFrame, second: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """MERGE-06 to MERGE-08: the header of one row with the first's values where it has any, and (field, kept, dropped) of conflicts."""
    one = lambda rows, side: rows.limit(1).select(F.lit(1).alias("__one"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
    both = one(first, "a").join(one(second, "b"), "__one")
    head = both.select(*(F.coalesce(F.nullif(f"a_{f}", F.lit("")), f"b_{f}").alias(f) for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("kept"), F.col(f"b_{f}").alias("dropped")) for f in fields))
    return head, both.select(F.explode(rows).alias("r")).select("r.*").where("kept != '' AND dropped != '' AND kept != dropped")
