"""Typed rows of records: people, families, events, names, notes and references (ENT-01 to ENT-33, GRAPH-05, FLT-02 to FLT-05).

Every builder is a projection over a record's `tags`, without a shuffle: a tag's children are the tags one level deeper up to the next one of
its own level or less. Absent texts are '', absent structs null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinloom.functions import dates, strings
from kinloom.functions.calendars import let

# The tags of events and attributes of a person and of events of a family.
PERSON_EVENTS = (
    "BIRT", "DEAT", "BAPM", "BURI", "CENS", "CHR", "ADOP", "RESI", "IMMI", "EMIG", "BARM", "BASM", "BLES", "CHRA", "CONF", "FCOM", "GRAD", "RETI", "NATU", "ORDN", "PROB", "WILL", "CREM", "EVEN",
)
ATTRIBUTES = ("OCCU", "CAST", "DSCR", "EDUC", "IDNO", "NATI", "SSN", "TITL", "RELI", "NCHI", "NMR", "PROP", "FACT")
FAMILY_EVENTS = ("MARR", "DIV", "ENGA", "ANUL", "MARB", "MARC", "MARL", "MARS", "DIVF", "EVEN")
#: Reference tags at level 1 and the record type that each must hit.
TARGETS = {"FAMC": "FAM", "FAMS": "FAM", "SOUR": "SOUR", "HUSB": "INDI", "WIFE": "INDI", "CHIL": "INDI"}


def _plain(tags: Column) -> Column:
    return F.filter(tags, lambda t: t["tag"].isNotNull() & t["level"].isNotNull())


def groups(tags: Column) -> Column:
    """Level-1 tags with what is below each: array of struct(tag, value, line_number, below array of tags), one pass."""
    empty = F.array().cast("array<struct<tag:string,value:string,line_number:bigint,from:int>>")
    start = F.struct(F.lit(0).alias("i"), empty.alias("all"))

    def step(state: Column, t: Column) -> Column:
        opened = F.struct(t["tag"].alias("tag"), t["value"].alias("value"), t["line_number"].cast("long").alias("line_number"), (state["i"] + 2).alias("from"))
        return F.struct((state["i"] + 1).alias("i"), F.when(t["level"] == 1, F.concat(state["all"], F.array(opened))).otherwise(state["all"]).alias("all"))

    def close(state: Column) -> Column:
        def one(g: Column, i: Column) -> Column:
            till = F.coalesce(F.get(state["all"], i + 1)["from"] - 1, state["i"] + 1)
            return F.struct(g["tag"].alias("tag"), g["value"].alias("value"), g["line_number"].alias("line_number"), F.slice(tags, g["from"], till - g["from"]).alias("below"))

        return F.transform(state["all"], one)

    return F.aggregate(tags, start, step, close)


def child(below: Column, tag: str, level: int = 2) -> Column:
    """ENT-30: the value of the first direct child, '' without one."""
    return F.coalesce(F.get(F.filter(below, lambda t: (t["tag"] == tag) & (t["level"] == level)), F.lit(0))["value"], F.lit(""))


def text_of(value: Column, below: Column, level: int = 2) -> Column:
    """ENT-22, ENT-27, ENT-32: a value with its continuation lines folded in."""
    more = F.filter(below, lambda t: (t["level"] == level) & t["tag"].isin("CONT", "CONC"))
    return F.aggregate(more, value, lambda text, t: F.concat(text, F.when(t["tag"] == "CONT", "\n").otherwise(""), t["value"]))


def name_parts(full: Column, below: Column) -> Column:
    """ENT-03: struct (full, given, surname, prefix, suffix, nickname, surname_prefix, type); own tags override the slashes."""
    raw = F.regexp_extract(full, "/([^/]*)", 1)
    surname = F.when(F.regexp_like(full, F.lit("/[^/]*/")), raw).otherwise(strings.trim_space(raw))
    own = lambda tag, other: F.coalesce(F.nullif(strings.trim_space(child(below, tag)), F.lit("")), other)
    rest = (("prefix", "NPFX"), ("suffix", "NSFX"), ("nickname", "NICK"), ("surname_prefix", "SPFX"), ("type", "TYPE"))
    return F.struct(full.alias("full"), own("GIVN", strings.given_of(full)).alias("given"), own("SURN", surname).alias("surname"), *(strings.trim_space(child(below, tag)).alias(n) for n, tag in rest))


def event(tag: Column, value: Column, below: Column, negative: Column) -> Column:
    """ENT-10: an event; its date stays as it is written, and parsed where it can be."""
    return F.struct(
        tag.alias("type"), child(below, "DATE").alias("date"), child(below, "PLAC").alias("place"), child(below, "TYPE").alias("detail"), child(below, "CAUS").alias("cause"), child(below, "AGE").alias("age"),
        F.when(tag == "EVEN", value).otherwise("").alias("description"), negative.alias("is_negative"),
    )


def _first(array: Column) -> Column:
    return F.get(array, F.lit(0))


def _last_value(g: Column, tag: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(g, lambda x: x["tag"] == tag), F.lit(-1))["value"], F.lit(""))


def _grouped(records: DataFrame, kind: str) -> DataFrame:
    return records.where(F.col("type") == kind).select("doc_id", "xref", "line_number", groups(_plain(F.col("tags"))).alias("g"))


def _events(g: Column, names: tuple[str, ...]) -> Column:
    wanted = F.filter(g, lambda x: x["tag"].isin(*names) | ((x["tag"] == "NO") & (x["value"] != "")))
    return F.transform(wanted, lambda x: event(F.when(x["tag"] == "NO", strings.trim_space(x["value"])).otherwise(x["tag"]), x["value"], x["below"], x["tag"] == "NO"))


def _parsed_first(events: str, kind: str) -> Column:
    """FLT-04, FLT-05: the parsed date of the first such event, null where it has no date or a faulty one."""
    text = _first(F.filter(events, lambda e: e["type"] == kind))["date"]
    return let(F.when(text != "", dates.parse_date(text)), lambda d: F.when(d["error"].isNull(), d))


def individuals(records: DataFrame) -> DataFrame:
    """ENT-02 to ENT-07: (doc_id, xref, line_number, names, sex, uid, events, attributes, child_in_families, spouse_in_families,
    citations, notes, birth, death), in any order; equal identifiers all stay."""
    return undated(records).withColumn("birth", _parsed_first("events", "BIRT")).withColumn("death", _parsed_first("events", "DEAT"))


def undated(records: DataFrame) -> DataFrame:
    """`individuals` without the parsed dates, for uses that need none: parsing is most of the plan."""
    g = F.col("g")
    of = lambda *tags: F.filter(g, lambda x: x["tag"].isin(*tags))
    return _grouped(records, "INDI").select(
        "doc_id", "xref", "line_number", F.transform(of("NAME"), lambda x: name_parts(x["value"], x["below"])).alias("names"), strings.trim_space(_last_value(g, "SEX")).alias("sex"), _last_value(g, "UID").alias("uid"),
        _events(g, PERSON_EVENTS).alias("events"),
        F.transform(of(*ATTRIBUTES), lambda x: F.struct(x["tag"].alias("type"), x["value"].alias("value"), child(x["below"], "DATE").alias("date"), child(x["below"], "PLAC").alias("place"))).alias("attributes"),
        F.transform(of("FAMC"), lambda x: F.struct(strings.trim_space(x["value"]).alias("family_xref"), child(x["below"], "PEDI").alias("pedigree"))).alias("child_in_families"),
        F.transform(of("FAMS"), lambda x: strings.trim_space(x["value"])).alias("spouse_in_families"),
        F.transform(of("SOUR"), lambda x: F.struct(strings.trim_space(x["value"]).alias("source_xref"), child(x["below"], "PAGE").alias("page"), quality(child(x["below"], "QUAY")).alias("quality"))).alias("citations"),
        F.transform(of("NOTE", "SNOTE"), lambda x: F.when(strings.is_pointer(strings.trim_space(x["value"])), strings.trim_space(x["value"])).otherwise(text_of(x["value"], x["below"]))).alias("notes"),
    )


def quality(text: Column) -> Column:
    """ENT-08: a certainty of 0 to 3, 0 for anything else."""
    number = strings.trim_space(text).try_cast("int")
    return F.when(number.between(0, 3), number).otherwise(0)


def families(records: DataFrame) -> DataFrame:
    """ENT-16: (doc_id, xref, line_number, husband, wife, children, events, marriages); the last HUSB and WIFE win."""
    parsed = F.transform(F.filter("events", lambda e: (e["type"] == "MARR") & (e["date"] != "")), lambda e: dates.parse_date(e["date"]))
    return undated_families(records).withColumn("marriages", F.filter(parsed, lambda d: d["error"].isNull()))


def undated_families(records: DataFrame) -> DataFrame:
    """`families` without the parsed marriages."""
    g = F.col("g")
    return _grouped(records, "FAM").select(
        "doc_id", "xref", "line_number", strings.trim_space(_last_value(g, "HUSB")).alias("husband"), strings.trim_space(_last_value(g, "WIFE")).alias("wife"),
        F.transform(F.filter(g, lambda x: x["tag"] == "CHIL"), lambda x: strings.trim_space(x["value"])).alias("children"), _events(g, FAMILY_EVENTS).alias("events"),
    )


def simple(records: DataFrame, kind: str, fields: dict[str, str]) -> DataFrame:
    """ENT-17 to ENT-26: records of other kinds with the folded text of one level-1 tag for each field, '' without it."""

    def field(tag: str) -> Column:
        return F.coalesce(let(_first(F.filter("g", lambda x: x["tag"] == tag)), lambda x: text_of(x["value"], x["below"])), F.lit(""))

    return _grouped(records, kind).select("doc_id", "xref", "line_number", *(field(tag).alias(name) for name, tag in fields.items()))


def sources(records: DataFrame) -> DataFrame:
    """ENT-17."""
    return simple(records, "SOUR", {"title": "TITL", "author": "AUTH", "publication": "PUBL", "text": "TEXT", "repository": "REPO"})


def repositories(records: DataFrame) -> DataFrame:
    """ENT-21."""
    return simple(records, "REPO", {"name": "NAME", "address": "ADDR", "phone": "PHON", "email": "EMAIL", "website": "WWW"})


def submitters(records: DataFrame) -> DataFrame:
    """ENT-20."""
    return simple(records, "SUBM", {"name": "NAME", "address": "ADDR", "phone": "PHON", "email": "EMAIL", "language": "LANG"})


def media(records: DataFrame) -> DataFrame:
    """ENT-24."""
    return simple(records, "OBJE", {"file": "FILE", "title": "TITL", "note": "NOTE"})


def notes(records: DataFrame) -> DataFrame:
    """ENT-22, ENT-23, ENT-42: (doc_id, xref, text) of shared notes of both kinds."""
    tags = _plain(F.col("tags"))
    below = F.slice(tags, F.lit(2), F.greatest(F.size(tags) - 1, F.lit(0)))
    return records.where(F.col("type").isin("NOTE", "SNOTE")).select("doc_id", "xref", text_of(F.col("value"), below, 1).alias("text"))


def last_of(rows: DataFrame) -> DataFrame:
    """FLT-01, FLT-02, WIN-04: of rows with equal (doc_id, xref) the one of the last line; rows without an identifier go."""
    newest = Window.partitionBy("doc_id", "xref").orderBy(F.desc("line_number"))
    return rows.where("xref != ''").withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n")


def edges(records: DataFrame) -> DataFrame:
    """(doc_id, src, dst, ref_type, idx): typed level-1 references of people and families, idx counting within their kind."""
    people = undated(records)
    fams = undated_families(records)
    spread = lambda rows, array, kind, dst="e": rows.select("doc_id", F.col("xref").alias("src"), F.posexplode(array).alias("idx", "e")).select("doc_id", "src", F.expr(dst).alias("dst"), F.lit(kind).alias("ref_type"), "idx")
    one = lambda column, kind: fams.where(F.col(column) != "").select("doc_id", F.col("xref").alias("src"), F.col(column).alias("dst"), F.lit(kind).alias("ref_type"), F.lit(0).alias("idx"))
    found = spread(people, "child_in_families", "FAMC", "e.family_xref").unionByName(spread(people, "spouse_in_families", "FAMS")).unionByName(spread(people, "citations", "SOUR", "e.source_xref"))
    return found.unionByName(one("husband", "HUSB")).unionByName(one("wife", "WIFE")).unionByName(spread(fams, "children", "CHIL")).where("dst != ''")


def pointers(records: DataFrame) -> DataFrame:
    """GRAPH-05: (doc_id, src, dst, line_number): every pointer in any tag of a record, whatever its tag."""
    flat = records.where("xref != ''").select("doc_id", F.col("xref").alias("src"), F.explode(F.slice("tags", F.lit(2), F.greatest(F.size("tags") - 1, F.lit(0)))).alias("t"))
    return flat.select("doc_id", "src", strings.trim_space(F.col("t.value")).alias("dst"), "t.line_number").where(strings.is_pointer(F.col("dst")))
