"""Records back to tagged lines and files, and what a round trip changes (SINK-01 to SINK-05, SINK-16, SINK-17, FLT-12, STR-18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import lines, strings
from kinloom.functions.calendars import let


def render_tags(level: Column, xref: Column, tag: Column, value: Column) -> Column:
    """SINK-04: the lines of one tag: its own, and a CONT line one level deeper for each further line of its value."""
    parts = strings.split_lines(value)
    first = lines.render_line(level, xref, tag, F.get(parts, F.lit(0)))
    rest = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: lines.render_line(level + 1, F.lit(""), F.lit("CONT"), p))
    return F.concat(F.array(first), rest)


def text_to_tags(value: Column, level: int, tag: str, most: int | None = 248) -> Column:
    """STR-18: array of (level, tag, value): the tag, CONC for what goes beyond `most` bytes (None: never), CONT for each further line."""
    row = lambda at, name, text: F.struct(F.lit(at).alias("level"), F.lit(name).alias("tag") if isinstance(name, str) else name.alias("tag"), text.alias("value"))

    def pieces(line: Column, at: Column) -> Column:
        return F.transform(F.array(line) if most is None else strings.wrap(line, most), lambda p, i: F.when((at == 0) & (i == 0), row(level, tag, p)).otherwise(row(level + 1, F.when(i == 0, "CONT").otherwise("CONC"), p)))

    return F.flatten(F.transform(strings.split_lines(value), pieces))


def fold(tags: Column) -> Column:
    """ENT-27, CONV-08: the text of such an array: CONT starts a line, CONC goes on."""
    return F.aggregate(tags, F.lit(""), lambda text, t: F.concat(text, F.when(t["tag"] == "CONT", F.concat(F.lit("\n"), t["value"])).otherwise(t["value"])))


def drop_custom(tags: Column) -> Column:
    """FLT-12: the tags without those that begin with '_' and everything below them; one pass, skipping deeper levels."""
    start = F.struct(F.lit(1000).alias("skip"), F.array().cast("array<int>").alias("kept"))
    indexed = F.transform(tags, lambda t, i: F.struct(t["level"].alias("level"), F.startswith(t["tag"], F.lit("_")).alias("own"), i.alias("i")))

    def step(state: Column, t: Column) -> Column:
        inside = t["level"] > state["skip"]
        skip = F.when(inside, state["skip"]).when(t["own"], t["level"]).otherwise(1000)
        return F.struct(skip.alias("skip"), F.when(inside | t["own"], state["kept"]).otherwise(F.concat(state["kept"], F.array(t["i"]))).alias("kept"))

    return F.transform(F.aggregate(indexed, start, step, lambda s: s["kept"]), lambda i: F.get(tags, i))


def encode(records: DataFrame, ending: str = "\n", preserve_unknown: bool = True) -> DataFrame:
    """SINK-01 to SINK-03: (doc_id, rec_no, text) of records, from their tags; a trailer of their own is written last anyway."""
    tags = F.filter("tags", lambda t: t["tag"].isNotNull())
    tags = tags if preserve_unknown else drop_custom(tags)
    rendered = F.flatten(F.transform(tags, lambda t: render_tags(t["level"], t["xref"], t["tag"], t["value"])))
    return records.select("doc_id", "rec_no", F.concat(F.array_join(rendered, ending), F.lit(ending)).alias("text"))


def write(records: DataFrame, path: str, ending: str = "\n") -> None:
    """SINK-01: one folder `doc_id=...` for each document; its part files in order of their names hold the records in order.

    Records are spread by range of (doc_id, rec_no), so a document of any size is written by many tasks.
    """
    rows = encode(records, ending).withColumn("text", F.regexp_replace("text", f"{ending}$", ""))
    rows.repartitionByRange("doc_id", "rec_no").sortWithinPartitions("doc_id", "rec_no").select("doc_id", "text").write.mode("overwrite").partitionBy("doc_id").option("lineSep", ending).text(path)


def round_trip_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """SINK-16, SINK-17, JOIN-17: (doc_id, rec_no, idx, before, after): lines at the same place that differ; null: not there."""

    def flat(records: DataFrame, name: str) -> DataFrame:
        line = lambda t: lines.render_line(t["level"], t["xref"], t["tag"], t["value"])
        return records.select("doc_id", "rec_no", F.posexplode(F.transform("tags", line)).alias("idx", name))

    both = flat(before, "before").join(flat(after, "after"), ["doc_id", "rec_no", "idx"], "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))
