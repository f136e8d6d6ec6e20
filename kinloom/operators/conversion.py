"""Conversion between versions and what it costs (CONV-01 to CONV-18, AGG-07 to AGG-12, SET-05).

Each step is a projection over a record's tags; only identifiers that change need a join, as a pointer must be known to change with
its record. The report is a table of rows (doc_id, kind, path, original, result, reason, n), so it grows with what changes and is never
gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import strings
from kinloom.functions.calendars import let
from kinloom.operators import merge
from kinloom.shipping import written
from kinloom.sources import entities, tagged, typed

# Tags that a target version does not have, and the encoding it takes where none is named.
LOST = {"5.5": ("EMAIL", "FAX", "WWW", "FACT", "MAP", "LATI", "LONG"), "7.0": ("EXID", "NO", "TRAN", "PHRASE", "UID", "CREA", "SNOTE")}
DEFAULT_ENCODING = {"5.5": "ANSEL", "5.5.1": "UTF-8", "7.0": "UTF-8"}
VERSIONS = ("5.5", "5.5.1", "7.0")
KINDS = ("transformation", "data_loss", "dropped", "normalized", "approximated", "preserved", "validation")
REPORT = "doc_id string, kind string, path string, original string, result string, reason string, n long"
NOTES = ("dropped", "normalized", "approximated", "preserved")


def lost_tags(source: str, target: str) -> tuple[str, ...]:
    """The tags at stake from one version to another, none for an upgrade."""
    if source == "7.0" and target != "7.0":
        return LOST["7.0"]
    return LOST["5.5"] if (source, target) == ("5.5.1", "5.5") else ()


def tag_loss(tags: DataFrame, lost: tuple[str, ...]) -> DataFrame:
    """AGG-08, AGG-09: `tags` is (xref, tag): (tag, n, records) of the tags that a target does not have: uses, and records with one."""
    used = tags.where(F.col("tag").isin(*lost)).groupBy("tag", "xref").agg(F.count("*").alias("n"))
    return used.groupBy("tag").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


def tags_in_record(tags: Column, wanted: tuple[str, ...]) -> Column:
    """AGG-07: the different tags of a record that are wanted, in the order of their first use."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: t["tag"]), lambda name: name.isin(*wanted)))


def preserved(tags: DataFrame) -> DataFrame:
    """CONV-16: (xref, tag, n) of vendors' own tags."""
    return tags.where("startswith(tag, '_')").groupBy("xref", "tag").agg(F.count("*").alias("n"))


def uppercase(mapping_of: DataFrame) -> DataFrame:
    """CONV-11: (old, new) of identifiers that upper case changes."""
    return mapping_of.select(F.col("xref").alias("old"), F.upper("xref").alias("new")).where("old != new").distinct()


def continued(tags: Column) -> Column:
    """For each tag the place of the tag whose value it goes on from; -1 for tags that are no CONC or CONT directly below one."""
    start = F.struct(F.array().cast("array<struct<level:int,at:int>>").alias("open"), F.array().cast("array<int>").alias("of"))

    def step(state: Column, t: Column) -> Column:
        open_ = F.filter(state["open"], lambda o: o["level"] < t["level"])
        above = F.try_element_at(open_, F.lit(-1))
        goes_on = t["tag"].isin("CONC", "CONT") & F.coalesce(above["level"] == t["level"] - 1, F.lit(False))
        own = F.struct(t["level"].alias("level"), F.size(state["of"]).alias("at"))
        return F.struct(F.when(goes_on, open_).otherwise(F.concat(open_, F.array(own))).alias("open"), F.concat(state["of"], F.array(F.when(goes_on, above["at"]).otherwise(-1))).alias("of"))

    return F.aggregate(tags, start, step, lambda s: s["of"])


def consolidate(tags: Column) -> Column:
    """CONV-08: the tags with CONC and CONT folded into the value they go on from, at every depth; other fields stay."""
    names = ("line_number", "level", "xref", "tag", "value", "code", "message")

    def folded(of: Column) -> Column:
        pieces = F.filter(F.transform(tags, lambda t, i: F.struct(t["tag"].alias("tag"), t["value"].alias("value"), F.get(of, i).alias("of"))), lambda p: p["of"] >= 0)
        placed = F.filter(F.transform(tags, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: F.get(of, p["i"]) < 0)
        grow = lambda text, p: F.concat(text, F.when(p["tag"] == "CONT", "\n").otherwise(""), p["value"])
        return let(pieces, lambda all_: F.transform(placed, lambda p: F.struct(*((F.aggregate(F.filter(all_, lambda x: x["of"] == p["i"]), p["t"]["value"], grow) if n == "value" else p["t"][n]).alias(n) for n in names))))

    return let(continued(tags), folded)


def expand(tags: Column) -> Column:
    """CONV-09: a value with line feeds as its first line and a CONT tag one level deeper for each further one."""
    none = F.lit(None).cast("string")

    def one(t: Column) -> Column:
        def pieces(parts: Column) -> Column:
            first = F.struct(t["line_number"].alias("line_number"), t["level"].alias("level"), t["xref"].alias("xref"), t["tag"].alias("tag"), F.get(parts, F.lit(0)).alias("value"), t["code"].alias("code"), t["message"].alias("message"))
            more = F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), lambda p: F.struct(t["line_number"].alias("line_number"), (t["level"] + 1).alias("level"), F.lit("").alias("xref"), F.lit("CONT").alias("tag"), p.alias("value"), none.alias("code"), none.alias("message")))
            return F.concat(F.array(first), more)

        return let(F.split(t["value"], "\n", -1), pieces)

    return F.flatten(F.transform(tags, one))


def ark_to_own(value: Column, type_uri: Column) -> Column:
    """CONV-13: the value of the _FSFTID tag that stands for an EXID on a downgrade, null for other identifiers."""
    return F.when(strings.is_familysearch_ark(type_uri), strings.escape_at(value))


def _with_value(t: Column, tag: Column, value: Column) -> Column:
    return F.struct(*({"tag": tag, "value": value}.get(n, t[n]).alias(n) for n in ("line_number", "level", "xref", "tag", "value", "code", "message")))


def external_ids_to_own(tags: Column) -> Column:
    """CONV-13: every level-1 EXID whose only subordinate is the TYPE of an ark becomes one _FSFTID tag."""

    def rewritten(at: Column) -> Column:
        """`at`: places of such EXID tags; the TYPE lies behind each."""
        kept = F.filter(F.transform(tags, lambda t, i: F.struct(t.alias("t"), i.alias("i"))), lambda p: ~F.array_contains(at, p["i"] - 1))
        return F.transform(kept, lambda p: F.when(F.array_contains(at, p["i"]), _with_value(p["t"], F.lit("_FSFTID"), strings.escape_at(p["t"]["value"]))).otherwise(p["t"]))

    def is_plain(t: Column, i: Column) -> Column:
        below, behind = F.get(tags, i + 1), F.get(tags, i + 2)
        good = (t["level"] == 1) & (t["tag"] == "EXID") & (below["level"] == 2) & (below["tag"] == "TYPE") & strings.is_familysearch_ark(below["value"]) & (behind.isNull() | (behind["level"] <= 1))
        return F.when(F.coalesce(good, F.lit(False)), i).otherwise(-1)

    return let(F.filter(F.transform(tags, is_plain), lambda i: i >= 0), rewritten)


def encoding_for(current: Column, target: str) -> Column:
    """CONV-14, CONV-15."""
    return F.lit("UTF-8") if target == "7.0" else F.coalesce(F.nullif(current, F.lit("")), F.lit(DEFAULT_ENCODING[target]))


def paths(tags: Column) -> Column:
    """For each tag the tags from the record line down to it, joined by '/'."""
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, t: Column) -> Column:
        padded = F.concat(state["open"], F.array_repeat(F.lit(""), F.greatest(F.lit(0), t["level"] - F.size(state["open"]))))
        return let(F.concat(F.slice(padded, F.lit(1), t["level"]), F.array(t["tag"])), lambda here: F.struct(here.alias("open"), F.concat(state["all"], F.array(F.array_join(here, "/"))).alias("all")))

    return F.aggregate(tags, start, step, lambda s: s["all"])


_PERSONAL = "|".join(sorted(set(entities.PERSON_EVENTS) | {"NO"}))
_COUPLES = "|".join(sorted(set(entities.FAMILY_EVENTS) | {"NO"}))
# What only version 7.0 can hold, as paths of tags; of the last two kinds only with a value.
ONLY_70 = (
    r"SNOTE|(INDI|FAM|SOUR|OBJE|REPO|SUBM|NOTE)/EXID|(INDI|FAM|SOUR|OBJE)/CREA|(INDI|FAM|SOUR)/OBJE/CROP|INDI/NAME/TRAN|OBJE/FILE/TRAN|OBJE/SNOTE"
    rf"|INDI/({_PERSONAL})/OBJE/CROP|FAM/({_COUPLES})/OBJE/CROP"
)
ONLY_70_FILLED = rf"(INDI|FAM)/NO|INDI/ASSO/PHRASE|INDI/({_PERSONAL})/SDATE|FAM/({_COUPLES})/SDATE"


def minimum_version(records: DataFrame) -> DataFrame:
    """AGG-11, AGG-12: (doc_id, version): 7.0 if a record uses something that only it has, else 5.5.1, never 5.5."""
    plain = F.filter("tags", lambda t: t["tag"].isNotNull() & t["level"].isNotNull())
    placed = records.select("doc_id", "type", plain.alias("tags")).withColumn("path", paths(F.col("tags")))
    filled = F.exists(F.arrays_zip("tags", "path"), lambda x: (strings.trim_space(x["tags"]["value"]) != "") & x["path"].rlike(f"^({ONLY_70_FILLED})$"))
    needs = F.exists("path", lambda p: p.rlike(f"^({ONLY_70})$")) | filled | ((F.col("type") == "HEAD") & (F.size(F.map_keys(tagged.schema_of(F.col("tags")))) > 0))
    return placed.groupBy("doc_id").agg(F.when(F.bool_or(needs), "7.0").otherwise("5.5.1").alias("version"))


def _path(*more: Column) -> Column:
    return strings.path(strings.record_path(F.col("type"), F.col("xref")), *more)


def _note(rows: DataFrame, kind: str, path: Column, original: Column | str, result: Column | str, reason: Column | str, n: Column | None = None) -> DataFrame:
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select("doc_id", F.lit(kind).alias("kind"), path.alias("path"), as_column(original).alias("original"), as_column(result).alias("result"), as_column(reason).alias("reason"), (F.lit(1) if n is None else n).cast("long").alias("n"))


def _counted(notes: DataFrame, kind: str, text: str, where: Column) -> DataFrame:
    """A transformation row for each document with such notes."""
    return _note(notes.where(where).groupBy("doc_id").agg(F.sum("n").alias("n")).where("n > 0"), "transformation", F.lit(kind), "", "", text, F.col("n"))


def _media(tags: Column, target: str) -> Column:
    """CONV-12: the media types of an OBJE record's files and their translations, in its tags."""
    to = strings.to_media_type if target == "7.0" else strings.to_legacy_media

    def one(t: Column, path: Column) -> Column:
        mapped = to(t["value"])
        return F.when(path.isin("OBJE/FILE/FORM", "OBJE/FILE/TRAN/FORM") & (t["value"] != "") & (mapped != ""), _with_value(t, t["tag"], mapped)).otherwise(t)

    return let(paths(tags), lambda at: F.transform(tags, lambda t, i: one(t, F.get(at, i))))


def _header(tags: Column, target: str, compat: bool) -> Column:
    """CONV-14, CONV-15: the header's version and encoding, without SCHMA in versions before 7.0; with `compat` the lines below SCHMA stay."""

    def one(t: Column, path: Column) -> Column:
        return F.when(path == "HEAD/GEDC/VERS", _with_value(t, t["tag"], F.lit(target))).when(path == "HEAD/CHAR", _with_value(t, t["tag"], encoding_for(t["value"], target))).otherwise(t)

    def made(at: Column) -> Column:
        gone = (lambda p: p == "HEAD/SCHMA") if compat else (lambda p: (p == "HEAD/SCHMA") | F.startswith(p, F.lit("HEAD/SCHMA/")))
        placed = F.transform(tags, lambda t, i: F.struct(one(t, F.get(at, i)).alias("t"), F.get(at, i).alias("p")))
        return F.transform(placed if target == "7.0" else F.filter(placed, lambda x: ~gone(x["p"])), lambda x: x["t"])

    return let(paths(tags), made)


def _step(records: DataFrame, source: str, target: str, preserve_unknown: bool, compat: bool) -> tuple[DataFrame, list[DataFrame]]:
    """The records of one version in another, and the rows of the report."""
    up = VERSIONS.index(target) > VERSIONS.index(source)
    notes: list[DataFrame] = []
    rows = records.withColumn("tags", F.filter("tags", lambda t: t["tag"].isNotNull() & t["level"].isNotNull()))
    before = rows
    tags = F.col("tags")
    if target == "7.0":
        changed = rows.select("doc_id", "type", "xref", F.explode(F.filter(let(continued(tags), lambda of: F.transform(tags, lambda t, i: F.struct(t["tag"].alias("tag"), F.when(F.get(of, i) >= 0, F.get(tags, F.get(of, i))["tag"]).alias("of")))), lambda x: x["of"].isNotNull())).alias("x"))
        each = changed.groupBy("doc_id", "type", "xref", F.col("x.of").alias("of"), F.col("x.tag").alias("tag")).agg(F.count("*").alias("n"))
        texts = _note(each, "normalized", _path(F.col("of")), F.col("tag"), "", F.when(F.col("tag") == "CONC", "7.0 has no CONC: the text is joined").otherwise("7.0 holds line breaks in the value"), F.col("n"))
        notes += [texts, _counted(texts, "CONC_REMOVED", "CONC tags joined to the values they go on from", F.col("original") == "CONC"), _counted(texts, "CONT_CONVERTED", "CONT tags joined to the values as line breaks", F.col("original") == "CONT")]
        rows = rows.withColumn("tags", consolidate(tags))
        mapping = rows.where("xref != ''").select("doc_id", F.col("xref").alias("old"), F.upper("xref").alias("new")).where("old != new").distinct()
        upper = _note(before.where("xref != '' AND xref != upper(xref)"), "normalized", _path(), F.col("xref"), F.upper("xref"), "7.0 has identifiers in upper case only")
        notes += [upper, _counted(upper, "XREF_UPPERCASE", "identifiers in upper case", F.lit(True))]
        rows = merge.apply_mapping(rows, mapping)
    elif source == "7.0":
        if preserve_unknown:
            people = rows.where("type = 'INDI'")
            ids = people.withColumn("n", F.size(F.filter(external_ids_to_own(tags), lambda t: (t["level"] == 1) & (t["tag"] == "_FSFTID"))) - F.size(F.filter(tags, lambda t: (t["level"] == 1) & (t["tag"] == "_FSFTID")))).where("n > 0")
            mapped = _note(ids, "normalized", _path(F.lit("EXID")), "EXID", "_FSFTID", "an ark identifier as the vendor's own tag", F.col("n"))
            notes += [mapped, _counted(mapped, "EXID_TO_VENDOR_TAG", f"ark identifiers as _FSFTID in {target}", F.lit(True))]
            rows = rows.withColumn("tags", F.when(F.col("type") == "INDI", external_ids_to_own(tags)).otherwise(tags))
        broken = rows.select("doc_id", "type", "xref", F.explode(F.filter("tags", lambda t: F.contains(t["value"], F.lit("\n")))).alias("t"))
        texts = _note(broken, "normalized", _path(F.col("t.tag")), F.col("t.value"), F.substring_index("t.value", "\n", 1), "versions before 7.0 have CONT tags for line breaks", F.length(F.col("t.value")) - F.length(F.replace(F.col("t.value"), F.lit("\n"), F.lit(""))))
        notes += [texts, _counted(texts, "CONT_EXPANDED", "line breaks as CONT tags", F.lit(True))]
        rows = rows.withColumn("tags", expand(tags))
    if "7.0" in (source, target):
        media = rows.where("type = 'OBJE'")
        mapped = media.select("doc_id", "type", "xref", F.posexplode(F.arrays_zip(tags.alias("old"), _media(tags, target).alias("new"))).alias("i", "x")).where("x.old.value != x.new.value")
        forms = _note(mapped, "approximated", _path(F.lit("FILE"), F.lit("FORM")), F.col("x.old.value"), F.col("x.new.value"), "media types by their IANA names" if target == "7.0" else "media types by their old short names")
        notes += [forms, _counted(forms, "MEDIA_TYPE_MAPPED", "media types of the other version", F.lit(True))]
        if not compat:
            rows = rows.withColumn("tags", F.when(F.col("type") == "OBJE", _media(tags, target)).otherwise(tags))
    head = before.where("type = 'HEAD'")
    char = F.coalesce(F.try_element_at(F.filter("tags", lambda t: (t["tag"] == "CHAR") & (t["level"] == 1)), F.lit(-1))["value"], F.lit(""))
    if target == "7.0":
        notes.append(_note(head.where(char != "UTF-8"), "transformation", F.lit("ENCODING_UPDATED"), char, "UTF-8", "7.0 is written in UTF-8 only"))
    else:
        schema = head.where(F.exists("tags", lambda t: (t["tag"] == "SCHMA") & (t["level"] == 1)))
        notes += [_note(schema, "transformation", F.lit("SCHMA_REMOVED"), "", "", "versions before 7.0 have no SCHMA"), _note(schema, "data_loss", F.lit("SCHMA schema definitions"), "", "", f"not in {target}")]
    rows = rows.withColumn("tags", F.when(F.col("type") == "HEAD", _header(tags, target, compat)).otherwise(tags))
    if lost := lost_tags(source, target):
        # after EXID has become the vendor's own tag, where it does
        used = rows.where("type NOT IN ('HEAD', 'TRLR', '')").select("doc_id", "type", "xref", F.explode(tags_in_record(tags, lost)).alias("tag"))
        reason = f"not in {target}"
        notes += [_note(used.groupBy("doc_id", "tag").agg(F.count("*").alias("n")), "data_loss", F.concat("tag", F.lit(" tags")), "", "", reason, F.col("n")), _note(used, "dropped", _path(F.col("tag")), F.col("tag"), "", reason)]
    if preserve_unknown:
        own = before.select("doc_id", "type", "xref", F.explode(F.filter("tags", lambda t: F.startswith(t["tag"], F.lit("_")))).alias("t"))
        notes.append(_note(own, "preserved", _path(F.col("t.tag")), F.col("t.value"), F.col("t.value"), "vendors' own tags stay"))
    done = before.select("doc_id").distinct()
    notes.append(_note(done, "transformation", F.lit("VERSION_UPGRADE" if up else "VERSION_DOWNGRADE"), source, target, f"from {source} to {target}"))
    return rows, notes


class DataLossError(ValueError):
    """A strict conversion would lose data."""


def convert(records: DataFrame, target: str, versions: DataFrame | None = None, preserve_unknown: bool = True, strict: bool = False, validate: bool = True, compat: bool = False) -> tuple[DataFrame, DataFrame]:
    """CONV-01 to CONV-07, CONV-17: (the records in the target version, the report) of documents of any versions.

    `versions` is (doc_id, version), detected if it is not given; documents without one count as 5.5, those that have the target version
    stay as they are. `strict` raises if anything would be lost. With `validate` what the legacy rules say of the result is in the report.
    By default media types are changed in the tags and all below SCHMA goes; `compat` only reports the first and keeps the second.
    """
    if target not in VERSIONS:
        raise ValueError(f"invalid target version: {target}")
    from kinloom.operators import rules

    known = tagged.detect_version(records) if versions is None else versions.select("doc_id", "version")
    placed = records.join(known, "doc_id", "left").withColumn("version", F.coalesce(F.nullif("version", F.lit("")), F.lit("5.5")))
    # every step and every part of the report reads the records, which are lexed once
    placed = written(placed, "versions")
    present = {r.version for r in placed.select("version").distinct().collect()}
    parts, notes = [placed.where(F.col("version") == target).drop("version")], []
    for source in VERSIONS:
        if source != target and source in present:
            rows, said = _step(placed.where(F.col("version") == source).drop("version"), source, target, preserve_unknown, compat)
            parts.append(rows)
            notes += said
    made = reduce(DataFrame.unionByName, parts)
    report = reduce(DataFrame.unionByName, notes) if notes else records.sparkSession.createDataFrame([], REPORT)
    if strict and not report.where("kind = 'data_loss'").isEmpty():
        raise DataLossError("the conversion would lose data")
    if validate:
        issues = rules.legacy(made.join(placed.where(F.col("version") != target).select("doc_id").distinct(), "doc_id", "left_semi"))
        report = report.unionByName(issues.select("doc_id", F.lit("validation").alias("kind"), F.col("record_xref").alias("path"), F.col("related_xref").alias("original"), F.lit("").alias("result"), F.col("code").alias("reason"), F.lit(1).cast("long").alias("n")))
    return made, report


def all_notes(report: DataFrame) -> DataFrame:
    """SET-05: the notes on items, with `ordinal`: what is dropped, normalized, approximated, preserved."""
    order = F.array_position(F.array(*map(F.lit, NOTES)), F.col("kind")).cast("int")
    return report.where(F.col("kind").isin(*NOTES)).withColumn("ordinal", order)


def report_text(report: DataFrame, doc_id: str, source: str, target: str) -> Iterator[str]:
    """CONV-18: the lines of one document's report, one kind after the other; rows pass through the driver one partition at a time."""
    yield f"Conversion: {source} -> {target}"
    titles = {"transformation": "Transformations", "data_loss": "Data Loss", "dropped": "Dropped", "normalized": "Normalized", "approximated": "Approximated", "preserved": "Preserved", "validation": "Validation Issues"}
    own = report.where(F.col("doc_id") == doc_id).cache()
    for kind in KINDS:
        rows = own.where(F.col("kind") == kind)
        if not (n := rows.count()):
            continue
        yield f"{titles[kind]}: {n}" + ("" if kind in ("transformation", "validation") else " items")
        if kind == "validation":
            continue
        for r in rows.orderBy("path", "original", "result", "reason").toLocalIterator():
            if kind == "transformation":
                yield f"  - {r.path}: {r.reason} ({r.n} instances)"
            elif kind == "data_loss":
                yield f"  - {r.path}: {r.reason}"
            else:
                yield f"  - {r.path}"
                yield from (f"      {name}: {value}" for name, value in (("Original", r.original), ("Result", r.result), ("Reason", r.reason)) if value)
    own.unpersist()
