"""Typed entities back to tags (SINK-02, SINK-05 to SINK-12, SINK-18 to SINK-41).

Writers are columns: arrays of (level, tag, value), put together with `concat`; nothing is collected and nothing runs in
Python. Empty fields give no tag. They are the inverse of the builders of `typed`, apart from what their docstrings say.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import strings
from kinloom.sources import sinks, typed

MOST = 248
ROWS = "array<struct<level:int,tag:string,value:string>>"


def nothing() -> Column:
    return F.array().cast(ROWS)


def line(level: int, tag: str | Column, value: Column | None = None) -> Column:
    name = F.lit(tag) if isinstance(tag, str) else tag
    return F.array(F.struct(F.lit(level).alias("level"), name.alias("tag"), (F.lit("") if value is None else value).alias("value")))


def filled(level: int, tag: str, value: Column) -> Column:
    return F.when(value != "", line(level, tag, value)).otherwise(nothing())


def fields(level: int, e: Column, names: dict[str, str]) -> list[Column]:
    return [filled(level, tag, e[name]) for name, tag in names.items()]


def lines(level: int, tag: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(level).alias("level"), F.lit(tag).alias("tag"), v.alias("value")))


def many(array: Column, write: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(array, write))


def maybe(struct: Column, write: Callable[[Column], Column]) -> Column:
    return F.when(struct.isNotNull(), write(struct)).otherwise(nothing())


def text(level: int, tag: str, value: Column, most: int | None) -> Column:
    return sinks.text_to_tags(value, level, tag, most)


def external_ids(array: Column, level: int = 1) -> Column:
    """SINK-41."""
    return many(array, lambda x: F.concat(line(level, "EXID", x["value"]), filled(level + 1, "TYPE", x["type"])))


def citation(c: Column, level: int, most: int | None) -> Column:
    """SINK-26, SINK-27: a certainty of 0 is not told from none and gives no tag."""
    data = lambda d: F.concat(line(level + 1, "DATA"), filled(level + 2, "DATE", d["date"]), F.when(d["text"] != "", text(level + 2, "TEXT", d["text"], most)).otherwise(nothing()))
    quality = F.when(c["quality"] > 0, line(level + 1, "QUAY", c["quality"].cast("string"))).otherwise(nothing())
    return F.concat(line(level, "SOUR", c["source_xref"]), filled(level + 1, "PAGE", c["page"]), quality, maybe(c["data"], data), maybe(c["apid"], lambda a: line(level + 1, "_APID", a["raw"])))


def crop(c: Column, level: int) -> Column:
    """SINK-36: zeros give no tag."""
    return F.concat(line(level, "CROP"), *(F.when(c[name] != 0, line(level + 1, tag, c[name].cast("string"))).otherwise(nothing()) for name, tag in typed.CROP_FIELDS.items()))


def media_link(m: Column, level: int) -> Column:
    """SINK-35."""
    return F.concat(line(level, "OBJE", m["media_xref"]), maybe(m["crop"], lambda c: crop(c, level + 1)), filled(level + 1, "TITL", m["title"]))


def address(a: Column, level: int) -> Column:
    """SINK-28: the first line stands both on ADDR and on ADR1."""
    return F.concat(line(level, "ADDR", a["line1"]), filled(level + 1, "ADR1", a["line1"]), *fields(level + 1, a, typed.ADDRESS_FIELDS))


def place(name: Column, detail: Column, level: int) -> Column:
    """SINK-29, SINK-30."""
    at = lambda c: F.concat(line(level + 1, "MAP"), filled(level + 2, "LATI", c["latitude"]), filled(level + 2, "LONG", c["longitude"]))
    return F.concat(line(level, "PLAC", name), maybe(detail, lambda d: F.concat(filled(level + 1, "FORM", d["form"]), maybe(d["coordinates"], at))))


def event(e: Column, level: int, most: int | None) -> Column:
    """SINK-09: a phrase of the date is not written."""
    first = F.when(e["is_negative"], line(level, "NO", e["type"])).otherwise(line(level, e["type"], e["description"]))
    below = level + 1
    named = {name: filled(below, tag, e[name]) for name, tag in typed.EVENT_FIELDS.items()}
    listed = {name: lines(below, tag, e[name]) for name, tag in typed.EVENT_LISTS.items() if name != "notes"}
    return F.concat(
        first, filled(below, "DATE", e["date"]), F.when(e["place"] != "", place(e["place"], e["place_detail"], below)).otherwise(nothing()), named["detail"], named["cause"], named["age"], named["agency"],
        maybe(e["address"], lambda a: address(a, below)), *listed.values(), named["restriction"], named["uid"], named["sort_date"], many(e["notes"], lambda n: text(below, "NOTE", n, most)),
        many(e["citations"], lambda c: citation(c, below, most)), many(e["media"], lambda m: media_link(m, below)),
    )


def attribute(a: Column, level: int, most: int | None) -> Column:
    """SINK-25."""
    return F.concat(line(level, a["type"], a["value"]), *fields(level + 1, a, {"date": "DATE", "place": "PLAC", "detail": "TYPE"}), many(a["citations"], lambda c: citation(c, level + 1, most)))


def ordinance(o: Column, level: int) -> Column:
    """SINK-31."""
    return F.concat(line(level, o["type"]), *fields(level + 1, o, {"date": "DATE", "temple": "TEMP", "place": "PLAC", "status": "STAT", "family_xref": "FAMC"}))


def name(n: Column, level: int) -> Column:
    """SINK-23, SINK-24."""
    parts = {k: v for k, v in typed.NAME_FIELDS.items() if k != "language"}
    other = lambda t: F.concat(line(level + 1, "TRAN", t["value"]), *fields(level + 2, t, typed.NAME_FIELDS))
    return F.concat(line(level, "NAME", n["full"]), *fields(level + 1, n, parts), filled(level + 1, "TYPE", n["type"]), many(n["transliterations"], other))


def family_link(f: Column, level: int) -> Column:
    """SINK-32."""
    return F.concat(line(level, "FAMC", f["family_xref"]), filled(level + 1, "PEDI", f["pedigree"]))


def association(a: Column, level: int, most: int | None) -> Column:
    """SINK-33: the role is always a ROLE tag."""
    return F.concat(line(level, "ASSO", a["individual_xref"]), filled(level + 1, "PHRASE", a["phrase"]), filled(level + 1, "ROLE", a["role"]), many(a["citations"], lambda c: citation(c, level + 1, most)), many(a["notes"], lambda n: text(level + 1, "NOTE", n, most)))


def change_date(c: Column, level: int, tag: str) -> Column:
    """SINK-34: a time needs a date."""
    return F.concat(line(level, tag), F.when(c["date"] != "", F.concat(line(level + 1, "DATE", c["date"]), filled(level + 2, "TIME", c["time"]))).otherwise(nothing()))


def repository_link(r: Column, most: int | None) -> Column:
    """SINK-18: a link without anything gives no tag; a single call number takes the link's own medium if it has none."""
    own = F.when(r["xref"] != "", line(1, "REPO", r["xref"])).otherwise(F.concat(line(1, "REPO"), filled(2, "NAME", F.coalesce(r["inline_name"], F.lit("")))))

    def call(number: Column) -> Column:
        single = F.when(F.size(r["call_numbers"]) == 1, r["media_type"]).otherwise("")
        return F.concat(line(2, "CALN", number), filled(3, "MEDI", F.coalesce(F.nullif(F.try_element_at(r["call_number_media"], number), F.lit("")), single)))

    bare = (r["xref"] == "") & (F.coalesce(r["inline_name"], F.lit("")) == "") & (F.size(r["call_numbers"]) == 0) & (F.size(r["notes"]) == 0)
    return F.when(bare, nothing()).otherwise(F.concat(own, many(r["call_numbers"], call), many(r["notes"], lambda n: text(2, "NOTE", n, most))))


def media_file(f: Column, level: int) -> Column:
    """SINK-37, SINK-38."""
    other = lambda t: F.concat(line(level + 1, "TRAN", t["file_ref"]), filled(level + 2, "FORM", t["form"]))
    form = F.when(f["form"] != "", F.concat(line(level + 1, "FORM", f["form"]), filled(level + 2, "MEDI", f["media_type"]))).otherwise(nothing())
    return F.concat(line(level, "FILE", f["file_ref"]), form, filled(level + 1, "TITL", f["title"]), many(f["translations"], other))


def shared_note_translation(t: Column, level: int, most: int | None) -> Column:
    """SINK-40."""
    return F.concat(text(level, "TRAN", t["value"], most), filled(level + 1, "MIME", t["mime"]), filled(level + 1, "LANG", t["language"]))


def notes_to_write(e: Callable[[str], Column]) -> Column:
    """SINK-11: the notes in their order while they are the same as pointers and inline texts apart; else pointers, then inline texts."""
    split = (F.filter(e("notes"), strings.is_pointer) == e("note_xrefs")) & (F.filter(e("notes"), lambda n: ~strings.is_pointer(n)) == e("inline_notes"))
    apart = F.concat(e("note_xrefs"), e("inline_notes"))
    return F.when(((F.size(e("notes")) > 0) & split) | (F.size(apart) == 0), e("notes")).otherwise(apart)


def _notes(most: int | None) -> Column:
    return many(notes_to_write(F.col), lambda n: text(1, "NOTE", n, most))


def _managed(most: int | None, *, ids: bool = True) -> list[Column]:
    dated = [maybe(F.col(column), lambda c, tag=tag: change_date(c, 1, tag)) for column, tag in (("change_date", "CHAN"), ("creation_date", "CREA"))]
    return dated + ([filled(1, "REFN", F.col("ref_number")), filled(1, "UID", F.col("uid")), external_ids(F.col("external_ids"))] if ids else [])


def entity_tags(kind: str, most: int | None = MOST) -> Column:
    """SINK-05 to SINK-08, SINK-19 to SINK-22, SINK-39: the tags below the record line, over the columns that `typed` gives for a type."""
    c = F.col
    cited, linked = many(c("citations"), lambda x: citation(x, 1, most)), lambda: many(c("media"), lambda m: media_link(m, 1))
    events, rites = lambda: many(c("events"), lambda e: event(e, 1, most)), lambda: many(c("ordinances"), lambda o: ordinance(o, 1))
    home = lambda: maybe(c("address"), lambda a: address(a, 1))
    if kind == "INDI":
        parts = [
            many(c("names"), lambda n: name(n, 1)), filled(1, "SEX", c("sex")), events(), many(c("attributes"), lambda a: attribute(a, 1, most)), rites(), many(c("child_in_families"), lambda f: family_link(f, 1)),
            lines(1, "FAMS", c("spouse_in_families")), many(c("associations"), lambda a: association(a, 1, most)), cited, _notes(most), linked(), *_managed(most), filled(1, "_FSFTID", strings.escape_at(c("family_search_id"))),
        ]
    elif kind == "FAM":
        parts = [filled(1, "HUSB", c("husband")), filled(1, "WIFE", c("wife")), lines(1, "CHIL", c("children")), filled(1, "NCHI", c("number_of_children")), events(), rites(), cited, _notes(most), linked(), *_managed(most)]
    elif kind == "SOUR":
        body = F.when(c("text") != "", text(1, "TEXT", c("text"), most)).otherwise(nothing())
        parts = [filled(1, "TITL", c("title")), filled(1, "AUTH", c("author")), filled(1, "PUBL", c("publication")), body, maybe(c("repository_link"), lambda r: repository_link(r, most)), linked(), _notes(most), *_managed(most)]
    elif kind == "SUBM":
        parts = [filled(1, "NAME", c("name")), home(), lines(1, "PHON", c("phone")), lines(1, "EMAIL", c("email")), lines(1, "LANG", c("language")), external_ids(c("external_ids")), _notes(most)]
    elif kind == "REPO":
        # PHON, EMAIL and WWW are written here, so that they are not lost
        parts = [filled(1, "NAME", c("name")), home(), filled(1, "PHON", c("phone")), filled(1, "EMAIL", c("email")), filled(1, "WWW", c("website")), external_ids(c("external_ids")), _notes(most)]
    elif kind == "NOTE":
        parts = [external_ids(c("external_ids"))]
    elif kind == "SNOTE":
        parts = [filled(1, "MIME", c("mime")), filled(1, "LANG", c("language")), many(c("translations"), lambda t: shared_note_translation(t, 1, most)), cited, external_ids(c("external_ids")), maybe(c("change_date"), lambda d: change_date(d, 1, "CHAN"))]
    elif kind == "OBJE":
        parts = [many(c("files"), lambda f: media_file(f, 1)), _notes(most), cited, *_managed(most, ids=False), lines(1, "REFN", c("ref_numbers")), lines(1, "UID", c("uids")), external_ids(c("external_ids")), filled(1, "RESN", c("restriction"))]
    else:
        raise ValueError(f"no writer for records of type {kind}")
    return F.concat(*parts)


def record_tags(kind: str, most: int | None = MOST) -> Column:
    """SINK-03, SINK-12: the record line and the entity's tags; the text of a note stands on that line and its continuation lines."""
    if kind in ("NOTE", "SNOTE"):
        return F.concat(text(0, kind, F.col("text"), most), entity_tags(kind, most))
    return F.concat(line(0, kind), entity_tags(kind, most))


def to_records(rows: DataFrame, kind: str, most: int | None = MOST, prefer_raw: bool = False) -> DataFrame:
    """(doc_id, rec_no, xref, type, value, tags) of typed rows, in the form of `tagged.records_of`.

    SINK-10: with `prefer_raw` a row whose `tags` has more than its record line keeps them.
    """
    written = typed.once(("written", kind, most), lambda: record_tags(kind, most))
    built = F.transform(written, lambda t, i: F.struct((i + 1).cast("long").alias("line_number"), t["level"].alias("level"), F.when(t["level"] == 0, F.col("xref")).otherwise("").alias("xref"), t["tag"].alias("tag"), t["value"].alias("value"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message")))
    built = built.cast(typed.TAGS)
    tags = F.when(F.size("tags") > 1, F.col("tags").cast(typed.TAGS)).otherwise(built) if prefer_raw else built
    made = rows.select("doc_id", "rec_no", "xref", tags.alias("tags"))
    return made.select("doc_id", "rec_no", "xref", F.lit(kind).alias("type"), F.get("tags", F.lit(0))["value"].alias("value"), "tags")


def header_records(headers: DataFrame, compat: bool = False) -> DataFrame:
    """SINK-02: a HEAD record for each row (doc_id, version, encoding, source_system, language and, if they are kept, tags).

    Version, encoding, source system and language are written; other header tags are kept from `tags`, if there is such a column, unless
    `compat` asks for these four alone.
    """
    four = F.concat(line(0, "HEAD"), F.when(F.col("version") != "", F.concat(line(1, "GEDC"), line(2, "VERS", F.col("version")))).otherwise(nothing()), filled(1, "CHAR", F.col("encoding")), filled(1, "SOUR", F.col("source_system")), filled(1, "LANG", F.col("language")))
    if "tags" in headers.columns and not compat:
        indexed = F.transform(typed.children(F.col("tags"), 1), lambda g: F.struct(g["tag"].alias("tag"), g["value"].alias("value"), g["below"].alias("below")))
        slim = lambda t: F.struct(t["level"].alias("level"), t["tag"].alias("tag"), t["value"].alias("value"))
        more = F.filter(indexed, lambda g: ~g["tag"].isin("GEDC", "CHAR", "LANG") & ~((g["tag"] == "SOUR") & (F.size(g["below"]) == 0)))
        rest = many(more, lambda g: F.concat(F.array(F.struct(F.lit(1).alias("level"), g["tag"].alias("tag"), g["value"].alias("value"))), F.transform(g["below"], slim)))
        has_source = F.exists(more, lambda g: g["tag"] == "SOUR")
        four = F.concat(F.filter(four, lambda t: ~((t["tag"] == "SOUR") & has_source)), rest)
    built = F.transform(four, lambda t, i: F.struct((i + 1).cast("long").alias("line_number"), t["level"].alias("level"), F.lit("").alias("xref"), t["tag"].alias("tag"), t["value"].alias("value"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("message")))
    return headers.select("doc_id", F.lit(0).alias("rec_no"), F.lit("").alias("xref"), F.lit("HEAD").alias("type"), F.lit("").alias("value"), built.cast(typed.TAGS).alias("tags"))
