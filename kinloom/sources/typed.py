"""Typed entities with all that is nested in them, built from a record's tags (ENT-02 to ENT-41).

Every builder is a column over arrays of tags, without a shuffle and without Python. A group is a tag with the tags below it; a builder takes a
group and its level and reads the direct children, one level deeper; what is deeper belongs to them. Of a field that may
stand once the last child wins. Absent texts are '', absent structs null. `entities` has the slim rows that joins use.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import dates, strings
from kinloom.functions.calendars import let
from kinloom.sources.entities import ATTRIBUTES, FAMILY_EVENTS, PERSON_EVENTS, text_of

Builder = Callable[[Column, int], Column]
# Tags of ordinances, of a person and of a couple.
PERSON_ORDINANCES, FAMILY_ORDINANCES = ("BAPL", "CONL", "ENDL", "SLGC"), ("SLGS",)
NAME_FIELDS = {"language": "LANG", "given": "GIVN", "surname": "SURN", "prefix": "NPFX", "suffix": "NSFX", "nickname": "NICK", "surname_prefix": "SPFX"}
ADDRESS_FIELDS = {"line2": "ADR2", "line3": "ADR3", "city": "CITY", "state": "STAE", "postal_code": "POST", "country": "CTRY"}
EVENT_FIELDS = {"detail": "TYPE", "cause": "CAUS", "age": "AGE", "agency": "AGNC", "restriction": "RESN", "uid": "UID", "sort_date": "SDATE"}
EVENT_LISTS = {"phone": "PHON", "email": "EMAIL", "fax": "FAX", "website": "WWW", "notes": "NOTE"}
CROP_FIELDS = {"top": "TOP", "left": "LEFT", "height": "HEIGHT", "width": "WIDTH"}


def children(tags: Column, level: int) -> Column:
    """The tags of a level, each with what is below it: array of struct (tag, value, line_number, below)."""
    places = F.filter(F.transform(tags, lambda t, i: F.when(t["level"] == level, i)), lambda i: i.isNotNull())

    def groups(at: Column) -> Column:
        def one(i: Column, k: Column) -> Column:
            t = F.get(tags, i)
            below = F.slice(tags, i + 2, F.coalesce(F.get(at, k + 1), F.size(tags)) - i - 1)
            return F.struct(t["tag"].alias("tag"), t["value"].alias("value"), t["line_number"].alias("line_number"), below.alias("below"))

        return F.transform(at, one)

    return let(places, groups)


def _of(groups: Column, *tags: str) -> Column:
    return F.filter(groups, lambda g: g["tag"].isin(*tags))


def _last_group(groups: Column, *tags: str) -> Column:
    return F.try_element_at(_of(groups, *tags), F.lit(-1))


def last(groups: Column, *tags: str) -> Column:
    return F.coalesce(_last_group(groups, *tags)["value"], F.lit(""))


def first(groups: Column, tag: str) -> Column:
    """ENT-30."""
    return F.coalesce(F.get(_of(groups, tag), F.lit(0))["value"], F.lit(""))


def values(groups: Column, *tags: str) -> Column:
    return F.transform(_of(groups, *tags), lambda g: g["value"])


def one(groups: Column, tag: str, level: int, build: Builder) -> Column:
    """What the last such child is built to; null without one."""
    return let(_last_group(groups, tag), lambda g: F.when(g.isNotNull(), build(g, level)))


def each(groups: Column, level: int, build: Builder, *tags: str) -> Column:
    return F.transform(_of(groups, *tags), lambda g: build(g, level))


def _below(g: Column, level: int, make: Callable[[Column], Column]) -> Column:
    return let(children(g["below"], level + 1), make)


def _named(fields: dict[str, Column]) -> Column:
    return F.struct(*(c.alias(name) for name, c in fields.items()))


def _whole(texts: Column, low: int | None = None, high: int | None = None) -> Column:
    """The last of the texts that is a whole number, within bounds; 0 without one."""
    numbers = F.filter(F.transform(texts, lambda t: F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))), lambda n: n.isNotNull() & (F.lit(True) if low is None else n.between(low, high)))
    return F.coalesce(F.try_element_at(numbers, F.lit(-1)), F.lit(0))


def transliteration(g: Column, level: int) -> Column:
    """ENT-04."""
    return _below(g, level, lambda c: _named({"value": g["value"]} | {name: last(c, tag) for name, tag in NAME_FIELDS.items()}))


def personal_name(g: Column, level: int) -> Column:
    """ENT-03: parts come from the slashes of the full name; own tags override them."""
    full = g["value"]
    raw = F.regexp_extract(full, "/([^/]*)", 1)
    surname = F.when(F.regexp_like(full, F.lit("/[^/]*/")), raw).otherwise(strings.trim_space(raw))
    given = strings.trim_space(F.substring_index(full, "/", 1))

    def make(c: Column) -> Column:
        own = lambda tag, other: F.when(F.exists(c, lambda x: x["tag"] == tag), strings.trim_space(last(c, tag))).otherwise(other)
        rest = {name: own(tag, F.lit("")) for name, tag in NAME_FIELDS.items() if name not in ("language", "given", "surname")}
        return _named({"full": full, "given": own("GIVN", given), "surname": own("SURN", surname), **rest, "type": last(c, "TYPE"), "transliterations": each(c, level + 1, transliteration, "TRAN")})

    return _below(g, level, make)


def family_link(g: Column, level: int) -> Column:
    """ENT-05."""
    return _below(g, level, lambda c: _named({"family_xref": strings.trim_space(g["value"]), "pedigree": last(c, "PEDI")}))


def external_id(g: Column, level: int) -> Column:
    """ENT-07: the first TYPE counts."""
    return _below(g, level, lambda c: _named({"value": g["value"], "type": first(c, "TYPE")}))


def citation_data(g: Column, level: int) -> Column:
    """ENT-09."""
    return _below(g, level, lambda c: _named({"date": last(c, "DATE"), "text": last(c, "TEXT")}))


def apid(value: Column) -> Column:
    """ENT-34 with the raw text; null for other forms."""
    return let(strings.apid(value), lambda a: F.when(a.isNotNull(), F.struct(value.alias("raw"), a["prefix"].alias("prefix"), a["database"].alias("database"), a["record"].alias("record"))))


def citation(g: Column, level: int) -> Column:
    """ENT-08: a certainty that is no whole number from 0 to 3 counts as 0."""

    def make(c: Column) -> Column:
        return _named({"source_xref": strings.trim_space(g["value"]), "page": last(c, "PAGE"), "quality": _whole(values(c, "QUAY"), 0, 3), "data": one(c, "DATA", level + 1, citation_data), "apid": apid(_last_group(c, "_APID")["value"])})

    return _below(g, level, make)


def association(g: Column, level: int) -> Column:
    """ENT-06."""
    return _below(g, level, lambda c: _named({"individual_xref": strings.trim_space(g["value"]), "role": last(c, "RELA", "ROLE"), "phrase": last(c, "PHRASE"), "notes": values(c, "NOTE"), "citations": each(c, level + 1, citation, "SOUR")}))


def address(g: Column, level: int) -> Column:
    """ENT-11: ADR1 replaces what is there so far; CONT starts a line unless there is none yet; CONC goes on."""

    def grow(text: Column, t: Column) -> Column:
        return F.when(t["tag"] == "ADR1", t["value"]).when((t["tag"] == "CONT") & (text != ""), F.concat(text, F.lit("\n"), t["value"])).otherwise(F.concat(text, t["value"]))

    return _below(g, level, lambda c: _named({"line1": F.aggregate(_of(c, "ADR1", "CONT", "CONC"), g["value"], grow)} | {name: last(c, tag) for name, tag in ADDRESS_FIELDS.items()}))


def coordinates(g: Column, level: int) -> Column:
    """ENT-13."""
    return _below(g, level, lambda c: _named({"latitude": last(c, "LATI"), "longitude": last(c, "LONG")}))


def place(g: Column, level: int) -> Column:
    """ENT-12."""
    return _below(g, level, lambda c: _named({"name": g["value"], "form": last(c, "FORM"), "coordinates": one(c, "MAP", level + 1, coordinates)}))


def crop(g: Column, level: int) -> Column:
    """ENT-41: what is no whole number counts as 0."""
    return _below(g, level, lambda c: _named({name: _whole(values(c, tag)) for name, tag in CROP_FIELDS.items()}))


def media_link(g: Column, level: int) -> Column:
    """ENT-26."""
    return _below(g, level, lambda c: _named({"media_xref": strings.trim_space(g["value"]), "title": last(c, "TITL"), "crop": one(c, "CROP", level + 1, crop)}))


def _parsed(text: Column) -> Column:
    return let(F.when(text != "", dates.parse_date(text)), lambda d: F.when(d["error"].isNull(), d))


def event(g: Column, level: int, dated: bool = False) -> Column:
    """ENT-10: NO makes a negative event of the type in its value; only EVEN has its own value as description."""

    def make(c: Column) -> Column:
        date = _last_group(c, "DATE")
        fields = {"type": F.when(g["tag"] == "NO", g["value"]).otherwise(g["tag"]), "date": F.coalesce(date["value"], F.lit("")), "phrase": first(children(F.coalesce(date["below"], F.array().cast(TAGS)), level + 2), "PHRASE")}
        fields |= {"place": last(c, "PLAC"), "place_detail": one(c, "PLAC", level + 1, place), "description": F.when(g["tag"] == "EVEN", g["value"]).otherwise("")}
        fields |= {name: last(c, tag) for name, tag in EVENT_FIELDS.items()} | {"address": one(c, "ADDR", level + 1, address)} | {name: values(c, tag) for name, tag in EVENT_LISTS.items()}
        fields |= {"is_negative": g["tag"] == "NO", "citations": each(c, level + 1, citation, "SOUR"), "media": each(c, level + 1, media_link, "OBJE")}
        return _named(fields | ({"parsed_date": _parsed(last(c, "DATE"))} if dated else {}))

    return _below(g, level, make)


def attribute(g: Column, level: int, dated: bool = False) -> Column:
    """ENT-14."""

    def make(c: Column) -> Column:
        fields = {"type": g["tag"], "value": g["value"], "date": last(c, "DATE"), "place": last(c, "PLAC"), "detail": last(c, "TYPE"), "citations": each(c, level + 1, citation, "SOUR")}
        return _named(fields | ({"parsed_date": _parsed(last(c, "DATE"))} if dated else {}))

    return _below(g, level, make)


def ordinance(g: Column, level: int) -> Column:
    """ENT-15, ENT-38: the type is the tag."""
    return _below(g, level, lambda c: _named({"type": g["tag"], "date": last(c, "DATE"), "temple": last(c, "TEMP"), "place": last(c, "PLAC"), "status": last(c, "STAT"), "family_xref": strings.trim_space(last(c, "FAMC"))}))


def change_date(g: Column, level: int) -> Column:
    """ENT-19."""

    def make(c: Column) -> Column:
        date = _last_group(c, "DATE")
        return _named({"date": F.coalesce(date["value"], F.lit("")), "time": first(children(F.coalesce(date["below"], F.array().cast(TAGS)), level + 2), "TIME")})

    return _below(g, level, make)


def repository_link(g: Column, level: int) -> Column:
    """ENT-18: an identifier or, without one, the name of an inline repository (null with an identifier); media by call number."""

    def make(c: Column) -> Column:
        calls = F.transform(_of(c, "CALN"), lambda x: F.struct(x["value"].alias("number"), first(children(x["below"], level + 2), "MEDI").alias("medium")))

        def with_calls(k: Column) -> Column:
            known = F.filter(k, lambda x: x["medium"] != "")
            media = F.aggregate(known, F.create_map().cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda n, _: n != x["number"]), F.create_map(x["number"], x["medium"])))
            xref = strings.trim_space(g["value"])
            return _named({"xref": xref, "inline_name": F.when(xref == "", last(c, "NAME")), "call_numbers": F.transform(k, lambda x: x["number"]), "call_number_media": media, "media_type": F.coalesce(F.get(known, F.lit(0))["medium"], F.lit("")), "notes": values(c, "NOTE")})

        return let(calls, with_calls)

    return _below(g, level, make)


def media_translation(g: Column, level: int) -> Column:
    """ENT-40."""
    return _below(g, level, lambda c: _named({"file_ref": g["value"], "form": last(c, "FORM")}))


def media_file(g: Column, level: int) -> Column:
    """ENT-25."""

    def make(c: Column) -> Column:
        form = _last_group(c, "FORM")
        return _named({"file_ref": g["value"], "form": F.coalesce(form["value"], F.lit("")), "media_type": first(children(F.coalesce(form["below"], F.array().cast(TAGS)), level + 2), "MEDI"), "title": last(c, "TITL"), "translations": each(c, level + 1, media_translation, "TRAN")})

    return _below(g, level, make)


def shared_note_translation(g: Column, level: int) -> Column:
    """ENT-39."""
    return _below(g, level, lambda c: _named({"value": text_of(g["value"], g["below"], level + 1), "mime": last(c, "MIME"), "language": last(c, "LANG")}))


TAGS = "array<struct<line_number:bigint,level:int,xref:string,tag:string,value:string,code:string,message:string>>"


def _noted(groups: Column, level: int = 1, tags: tuple[str, ...] = ("NOTE", "SNOTE")) -> dict[str, Column]:
    """ENT-28: pointers trimmed, inline texts with their continuation lines, and both in order."""
    note = lambda g: F.when(strings.is_pointer(strings.trim_space(g["value"])), strings.trim_space(g["value"])).otherwise(text_of(g["value"], g["below"], level + 1))
    all_ = F.transform(_of(groups, *tags), note)
    return {"note_xrefs": F.filter(all_, strings.is_pointer), "inline_notes": F.filter(all_, lambda n: ~strings.is_pointer(n)), "notes": all_}


def _managed(g: Column, created: bool = True) -> dict[str, Column]:
    fields = {"change_date": one(g, "CHAN", 1, change_date)} | ({"creation_date": one(g, "CREA", 1, change_date)} if created else {})
    return fields | {"ref_number": last(g, "REFN"), "uid": last(g, "UID"), "external_ids": each(g, 1, external_id, "EXID")}


_BUILT: dict[tuple, object] = {}


def once(key: tuple, make: Callable[[], object]) -> object:
    """What `make` gives, made once for a JVM: the columns of an entity are thousands of calls to it, and they depend on no DataFrame."""
    key = (id(SparkContext._gateway), *key)
    if key not in _BUILT:
        _BUILT[key] = make()
    return _BUILT[key]


def _rows(records: DataFrame, kind: str, fields: Callable[[Column], dict[str, Column]], dated: bool = False) -> DataFrame:
    """(doc_id, rec_no, xref, line_number, fields, tags) of the records of a type; the groups are computed before the fields."""
    plain = F.filter("tags", lambda t: t["tag"].isNotNull() & t["level"].isNotNull())
    grouped = records.where(F.col("type") == kind).select("doc_id", "rec_no", "xref", "line_number", "value", "tags", children(plain, 1).alias("__g"))
    columns = once((kind, dated), lambda: [c.alias(n) for n, c in fields(F.col("__g")).items()])
    return grouped.select("doc_id", "rec_no", "xref", "line_number", *columns, "tags")


def _happened(groups: Column, names: tuple[str, ...], dated: bool) -> Column:
    wanted = F.filter(groups, lambda g: g["tag"].isin(*names) | ((g["tag"] == "NO") & (strings.trim_space(g["value"]) != "")))
    return F.transform(wanted, lambda g: event(g, 1, dated))


def individuals(records: DataFrame, dated: bool = False) -> DataFrame:
    """ENT-02: people; with `dated`, events and attributes have parsed_date (null for faulty dates)."""

    def fields(g: Column) -> dict[str, Column]:
        found = {"names": each(g, 1, personal_name, "NAME"), "sex": strings.trim_space(last(g, "SEX")), "events": _happened(g, PERSON_EVENTS, dated), "attributes": F.transform(_of(g, *ATTRIBUTES), lambda x: attribute(x, 1, dated))}
        found |= {"ordinances": each(g, 1, ordinance, *PERSON_ORDINANCES), "child_in_families": each(g, 1, family_link, "FAMC"), "spouse_in_families": F.transform(values(g, "FAMS"), strings.trim_space)}
        found |= {"associations": each(g, 1, association, "ASSO"), "citations": each(g, 1, citation, "SOUR"), **_noted(g), "media": each(g, 1, media_link, "OBJE"), **_managed(g)}
        return found | {"family_search_id": strings.unescape_at(last(g, "_FSFTID"))}

    return _rows(records, "INDI", fields, dated)


def families(records: DataFrame, dated: bool = False) -> DataFrame:
    """ENT-16."""

    def fields(g: Column) -> dict[str, Column]:
        found = {"husband": strings.trim_space(last(g, "HUSB")), "wife": strings.trim_space(last(g, "WIFE")), "children": F.transform(values(g, "CHIL"), strings.trim_space), "number_of_children": last(g, "NCHI")}
        return found | {"events": _happened(g, FAMILY_EVENTS, dated), "ordinances": each(g, 1, ordinance, *FAMILY_ORDINANCES), "citations": each(g, 1, citation, "SOUR"), **_noted(g), "media": each(g, 1, media_link, "OBJE"), **_managed(g)}

    return _rows(records, "FAM", fields, dated)


def sources(records: DataFrame) -> DataFrame:
    """ENT-17."""
    return _rows(records, "SOUR", lambda g: {"title": last(g, "TITL"), "author": last(g, "AUTH"), "publication": last(g, "PUBL"), "text": last(g, "TEXT"), "repository_link": one(g, "REPO", 1, repository_link), **_noted(g), "media": each(g, 1, media_link, "OBJE"), **_managed(g)})


def submitters(records: DataFrame) -> DataFrame:
    """ENT-20."""
    return _rows(records, "SUBM", lambda g: {"name": last(g, "NAME"), "address": one(g, "ADDR", 1, address), "phone": values(g, "PHON"), "email": values(g, "EMAIL"), "language": values(g, "LANG"), **_noted(g), "external_ids": each(g, 1, external_id, "EXID")})


def repositories(records: DataFrame) -> DataFrame:
    """ENT-21: phone, email and website are the last of each."""
    return _rows(records, "REPO", lambda g: {"name": last(g, "NAME"), "address": one(g, "ADDR", 1, address), "phone": last(g, "PHON"), "email": last(g, "EMAIL"), "website": last(g, "WWW"), **_noted(g), "external_ids": each(g, 1, external_id, "EXID")})


def _folded(g: Column) -> Column:
    return F.aggregate(_of(g, "CONT", "CONC"), F.col("value"), lambda text, t: F.concat(text, F.when(t["tag"] == "CONT", "\n").otherwise(""), t["value"]))


def notes(records: DataFrame) -> DataFrame:
    """ENT-22, ENT-32."""
    return _rows(records, "NOTE", lambda g: {"text": _folded(g), "external_ids": each(g, 1, external_id, "EXID")})


def shared_notes(records: DataFrame) -> DataFrame:
    """ENT-23."""
    return _rows(records, "SNOTE", lambda g: {"text": _folded(g), "mime": last(g, "MIME"), "language": last(g, "LANG"), "translations": each(g, 1, shared_note_translation, "TRAN"), "citations": each(g, 1, citation, "SOUR"), "external_ids": each(g, 1, external_id, "EXID"), "change_date": one(g, "CHAN", 1, change_date)})


def media_objects(records: DataFrame) -> DataFrame:
    """ENT-24: pointers of SNOTE are both among the notes and in shared_note_xrefs."""

    def fields(g: Column) -> dict[str, Column]:
        managed = _managed(g) | {"ref_numbers": values(g, "REFN"), "uids": values(g, "UID")}
        return {"files": each(g, 1, media_file, "FILE"), **_noted(g), "shared_note_xrefs": F.transform(values(g, "SNOTE"), strings.trim_space), "citations": each(g, 1, citation, "SOUR"), "restriction": last(g, "RESN"), **{k: v for k, v in managed.items() if k not in ("ref_number", "uid")}}

    return _rows(records, "OBJE", fields)


BUILDERS = {"INDI": individuals, "FAM": families, "SOUR": sources, "SUBM": submitters, "REPO": repositories, "NOTE": notes, "SNOTE": shared_notes, "OBJE": media_objects}


def note_texts(records: DataFrame) -> DataFrame:
    """ENT-42: (doc_id, xref, text): what a pointer to a note stands for; a NOTE record is preferred to a SNOTE record, the last of equal ones wins."""
    found = [make(records).select("doc_id", "xref", "text", F.struct(F.lit(rank), "line_number").alias("__order")) for make, rank in ((notes, 1), (shared_notes, 0))]
    return found[0].unionByName(found[1]).where("xref != ''").groupBy("doc_id", "xref").agg(F.max_by("text", "__order").alias("text"))


def all_notes(rows: DataFrame, records: DataFrame) -> DataFrame:
    """ENT-31, ENT-33: (doc_id, xref, all_notes): inline notes first, then the texts of the pointers in their order, each pointer once.

    Pointers without a record are left out; null if nothing is left. For media the pointers of SNOTE count too.
    """
    pointers = F.array_union("note_xrefs", "shared_note_xrefs") if "shared_note_xrefs" in rows.columns else F.col("note_xrefs")
    at = rows.select("doc_id", "rec_no", F.posexplode(pointers).alias("place", "note")).join(note_texts(records).withColumnRenamed("xref", "note"), ["doc_id", "note"])
    texts = at.groupBy("doc_id", "rec_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("__texts"))
    empty = F.array().cast("array<string>")
    joined = rows.join(texts, ["doc_id", "rec_no"], "left").withColumn("all_notes", F.concat("inline_notes", F.coalesce("__texts", empty)))
    return joined.select("doc_id", "xref", F.when(F.size("all_notes") > 0, F.col("all_notes")).alias("all_notes"))


# What may stand under what, as context: tags, and the context that a tag opens ('': nothing below it is looked at).
_NAMES = {"GIVN": "", "SURN": "", "NPFX": "", "NSFX": "", "NICK": "", "SPFX": ""}
_COMMON = {"NOTE": "", "SNOTE": "", "SOUR": "citation", "OBJE": "link", "CHAN": "change", "CREA": "change", "REFN": "", "UID": "", "EXID": ""}
_ADDRESS = dict.fromkeys(("ADR1", "ADR2", "ADR3", "CITY", "STAE", "POST", "CTRY", "CONT", "CONC"), "")
CONTEXTS = {
    "INDI": _COMMON | {"NAME": "name", "SEX": "", "NO": "event", "FAMC": "famc", "FAMS": "", "ASSO": "association"} | dict.fromkeys(PERSON_EVENTS, "event") | dict.fromkeys(ATTRIBUTES, "attribute") | dict.fromkeys(PERSON_ORDINANCES, "ordinance") | dict.fromkeys(("ALIA", "AFN", "RFN", "RIN", "ANCI", "DESI", "SUBM", "RESN", "INIL"), ""),
    "FAM": _COMMON | {"HUSB": "", "WIFE": "", "CHIL": "", "NCHI": "", "NO": "event", "SLGS": "ordinance"} | dict.fromkeys(FAMILY_EVENTS, "event") | dict.fromkeys(("RESN", "SUBM", "ASSO", "FACT"), ""),
    "SOUR": {k: v for k, v in _COMMON.items() if k != "SOUR"} | dict.fromkeys(("TITL", "AUTH", "PUBL", "TEXT", "DATA", "ABBR"), "") | {"REPO": "repository"},
    "SUBM": {"ADDR": "address"} | dict.fromkeys(("NAME", "PHON", "EMAIL", "LANG", "NOTE", "SNOTE", "EXID", "CHAN", "FAX", "WWW", "OBJE", "RIN", "UID"), ""),
    "REPO": {"ADDR": "address"} | dict.fromkeys(("NAME", "PHON", "EMAIL", "WWW", "NOTE", "SNOTE", "EXID", "CHAN", "REFN", "UID", "FAX"), ""),
    "NOTE": dict.fromkeys(("CONT", "CONC", "EXID", "MIME", "LANG", "TRAN", "SOUR", "REFN", "UID", "CHAN"), ""),
    "SNOTE": {"SOUR": "citation", "CHAN": "change"} | dict.fromkeys(("CONT", "CONC", "EXID", "MIME", "LANG", "TRAN"), ""),
    "OBJE": {k: v for k, v in _COMMON.items() if k != "OBJE"} | {"FILE": "file", "RESN": ""},
    "name": _NAMES | {"TYPE": "", "TRAN": "transliteration", "SOUR": "", "NOTE": "", "FONE": "", "ROMN": ""},
    "transliteration": _NAMES | {"LANG": ""},
    "famc": dict.fromkeys(("PEDI", "STAT", "NOTE"), ""),
    "association": {"RELA": "", "ROLE": "", "PHRASE": "", "NOTE": "", "SOUR": "citation"},
    "citation": {"PAGE": "", "QUAY": "", "DATA": "data", "NOTE": "", "OBJE": "", "EVEN": "", "TEXT": ""},
    "data": {"DATE": "", "TEXT": ""},
    "event": dict.fromkeys(("DATE", "HUSB", "WIFE", *EVENT_FIELDS.values(), *EVENT_LISTS.values()), "") | {"PLAC": "place", "ADDR": "address", "SOUR": "citation", "OBJE": "link"},
    "address": _ADDRESS,
    "place": {"MAP": "map"} | dict.fromkeys(("FORM", "FONE", "ROMN", "TRAN", "NOTE", "EXID", "LANG"), ""),
    "map": {"LATI": "", "LONG": ""},
    "attribute": {"DATE": "", "PLAC": "", "TYPE": "", "SOUR": "citation", "NOTE": "", "AGE": ""},
    "ordinance": dict.fromkeys(("DATE", "TEMP", "PLAC", "STAT", "FAMC", "NOTE", "SOUR"), ""),
    "repository": dict.fromkeys(("NAME", "CALN", "NOTE"), ""),
    "change": {"DATE": "", "NOTE": ""},
    "file": {"FORM": "", "TITL": "", "TRAN": "filetranslation"},
    "filetranslation": {"FORM": ""},
    "link": {"CROP": "crop", "TITL": "", "FILE": ""},
    "crop": dict.fromkeys(CROP_FIELDS.values(), ""),
}


def contexts(tags: Column) -> Column:
    """For each tag the context it stands in ('' where nothing is looked at), by a stack of what the tags above it open."""
    table = F.create_map(*(F.lit(x) for context, known in CONTEXTS.items() for tag, opened in known.items() if opened for x in (f"{context}/{tag}", opened)))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.array().cast("array<string>").alias("all"))

    def step(state: Column, t: Column) -> Column:
        context = F.when(t["level"] > 0, F.coalesce(F.get(state["open"], t["level"] - 1), F.lit(""))).otherwise("")
        opened = F.when(t["level"] == 0, t["tag"]).otherwise(F.coalesce(F.try_element_at(table, F.concat(context, F.lit("/"), t["tag"])), F.lit("")))
        above = F.slice(F.concat(state["open"], F.array_repeat(F.lit(""), F.greatest(F.lit(0), t["level"] - F.size(state["open"])))), F.lit(1), t["level"])
        return F.struct(F.concat(above, F.array(opened)).alias("open"), F.concat(state["all"], F.array(context)).alias("all"))

    return F.aggregate(tags, start, step, lambda s: s["all"])


def diagnostics(records: DataFrame) -> DataFrame:
    """ENT-01: (doc_id, line, severity, code, tag, value): tags that their context does not know, and values that are not of their form.

    Vendors' own tags, and what stands below a tag that is not typed, give none.
    """
    plain = F.filter("tags", lambda t: t["tag"].isNotNull() & t["level"].isNotNull())
    kept = records.where(F.col("type").isin(*BUILDERS)).select("doc_id", plain.alias("tags")).withColumn("in", contexts(F.col("tags")))
    flat = kept.select("doc_id", F.posexplode("tags").alias("i", "t"), "in").select("doc_id", "t.line_number", "t.tag", "t.value", F.get("in", F.col("i")).alias("context")).where("context != ''")
    known = F.array(*(F.lit(f"{context}/{tag}") for context, tags in CONTEXTS.items() for tag in tags))
    unknown = ~F.startswith("tag", F.lit("_")) & ~F.array_contains(known, F.concat("context", F.lit("/"), "tag"))
    number = F.when(F.col("value").rlike(r"^[+-]?[0-9]+$"), F.col("value").try_cast("int"))
    faulty = (
        (F.col("context").isin("INDI", "FAM") & (F.col("tag") == "NO") & (strings.trim_space(F.col("value")) == ""))
        | ((F.col("context") == "citation") & (F.col("tag") == "QUAY") & ~F.coalesce(number.between(0, 3), F.lit(False)))
        | ((F.col("context") == "crop") & F.col("tag").isin(*CROP_FIELDS.values()) & number.isNull())
    )
    of_date = flat.where(F.col("context").isin("event", "attribute", "ordinance") & (F.col("tag") == "DATE"))
    parsed = of_date.select("doc_id", "line_number", "tag", "value", F.get(F.array(dates.parse_date(F.col("value"))["error"]), F.lit(0)).alias("error"))
    row = lambda rows, code: rows.select("doc_id", F.col("line_number").alias("line"), F.lit("WARNING").alias("severity"), F.lit(code).alias("code"), "tag", "value")
    return row(flat.where(unknown), "UNKNOWN_TAG").unionByName(row(flat.where(faulty), "INVALID_VALUE")).unionByName(row(parsed.where("error IS NOT NULL"), "INVALID_VALUE"))
