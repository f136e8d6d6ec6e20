"""Validation rules as issue rows (VAL-01 to VAL-24, JOIN-10 to JOIN-16, AGG-02, FLT-06 to FLT-11, SORT-01).

An issue is (doc_id, severity, code, record_xref, related_xref, details); rules are native predicates, after equality joins where two records
matter. `people` is (doc_id, xref, sex, birth, death), births and deaths being date structs or null.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions import dates, strings
from kinloom.operators import kin
from kinloom.shipping import written
from kinloom.sources import entities, tagged

ERROR, WARNING, INFO = "ERROR", "WARNING", "INFO"
# Limits of the age rules, of identifiers' length and of the duplicate score.
MAX_AGE, MIN_PARENT_AGE, MAX_MOTHER_AGE, MAX_FATHER_AGE = 120, 12, 55, 90
MAX_XREF_BYTES = 20
MIN_GIVEN_SIMILARITY, MAX_YEAR_DIFFERENCE, MIN_CONFIDENCE = 0.8, 2, 0.7
SHOWN = {"relaxed": (ERROR,), "normal": (ERROR, WARNING), "strict": (ERROR, WARNING, INFO)}
# vendors' own tags with the tags they may stand under (none: anywhere) and the pattern of their values.
VENDOR_TAGS = {
    "ancestry": (("_APID", ("SOUR",), None), ("_TREE", ("HEAD",), None), ("_MILT", ("INDI",), None), ("_DEST", ("EMIG", "IMMI"), None), ("_PRIM", ("OBJE",), "^[YN]$"), ("_PHOTO", ("INDI",), None)),
    "familysearch": (("_FSFTID", ("INDI",), None), ("_FSORD", ("INDI",), None), ("_FSTAG", (), None)),
    "rootsmagic": (("_PRIM", (), "^[YN]$"), ("_SDATE", (), None), ("_TMPLT", ("SOUR",), None)),
}


@dataclass(frozen=True)
class Limits:
    """VAL-10: the limits of the age rules; 0 stands for the usual one."""

    max_age: int = 0
    min_parent_age: int = 0
    max_mother_age: int = 0
    max_father_age: int = 0

    def usual(self) -> Limits:
        return Limits(self.max_age or MAX_AGE, self.min_parent_age or MIN_PARENT_AGE, self.max_mother_age or MAX_MOTHER_AGE, self.max_father_age or MAX_FATHER_AGE)


def issue(rows: DataFrame, severity: str | Column, code: str | Column, record: str, related: str | None = None, **details: Column) -> DataFrame:
    pairs = [x for name, value in details.items() for x in (F.lit(name), value.cast("string"))]
    made = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    as_column = lambda c: F.lit(c) if isinstance(c, str) else c
    return rows.select("doc_id", as_column(severity).alias("severity"), as_column(code).alias("code"), F.col(record).alias("record_xref"), (F.col(related) if related else F.lit("")).alias("related_xref"), made.alias("details"))


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _dated(d: Column) -> Column:
    return F.coalesce(d["year"] != 0, F.lit(False))


def own_dates(people: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """VAL-05 and VAL-08: death before birth, and lives longer than the limit."""
    most = limits.usual().max_age
    birth, death = F.col("birth"), F.col("death")
    both = people.where(_dated(birth) & _dated(death))
    age = dates.years_between(birth, death)["years"]
    return issue(both.where(dates.is_before(death, birth)), ERROR, "DEATH_BEFORE_BIRTH", "xref", birth_date=birth["original"], death_date=death["original"]).unionByName(
        issue(both.where(age > most), WARNING, "IMPOSSIBLE_AGE", "xref", age=age, max_age=F.lit(most), birth_date=birth["original"], death_date=death["original"])
    )


def parents_dates(edges: DataFrame, people: DataFrame, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """VAL-06 and VAL-09: children born before a parent (over FAMC), parents too young or too old (over FAMS and CHIL).

    Births travel through two equality joins; people without a year of birth leave before them.
    """
    limits = limits.usual()
    dated = people.where(_dated(F.col("birth")))
    born = lambda name: dated.select("doc_id", F.col("xref").alias(name), F.col("birth").alias(f"{name}_birth"))
    up = kin.parents(edges, people).join(born("person"), ["doc_id", "person"]).join(born("parent"), ["doc_id", "parent"])
    early = issue(up.where(dates.is_before(F.col("person_birth"), F.col("parent_birth"))), ERROR, "CHILD_BEFORE_PARENT", "person", "parent", child_birth=F.col("person_birth.original"), parent_birth=F.col("parent_birth.original"))
    old = dated.select("doc_id", F.col("xref").alias("person"), F.col("birth").alias("person_birth"), "sex")
    down = kin.children(edges, people).join(old, ["doc_id", "person"]).join(born("child"), ["doc_id", "child"])
    aged = down.withColumn("age", dates.years_between(F.col("person_birth"), F.col("child_birth"))["years"])
    limit = F.when(F.col("sex") == "F", limits.max_mother_age).otherwise(limits.max_father_age)
    young = issue(aged.where(F.col("age") < limits.min_parent_age), WARNING, "UNREASONABLE_PARENT_AGE", "person", "child", parent_age=F.col("age"), min_age=F.lit(limits.min_parent_age))
    late = issue(aged.where(F.col("age") > limit), WARNING, "UNREASONABLE_PARENT_AGE", "person", "child", parent_age=F.col("age"), max_age=limit)
    return _all([early, young, late])


def marriages_before_birth(edges: DataFrame, people: DataFrame, marriages: DataFrame) -> DataFrame:
    """VAL-07, JOIN-15: `marriages` is (doc_id, family, marriage), one row for each dated marriage."""
    own = edges.where("ref_type = 'FAMS'").select("doc_id", F.col("src").alias("xref"), F.col("dst").alias("family"))
    met = own.join(marriages.where(_dated(F.col("marriage"))), ["doc_id", "family"]).join(people.where(_dated(F.col("birth"))).select("doc_id", "xref", "birth"), ["doc_id", "xref"])
    return issue(met.where(dates.is_before(F.col("marriage"), F.col("birth"))), ERROR, "MARRIAGE_BEFORE_BIRTH", "xref", "family", birth_date=F.col("birth.original"), marriage_date=F.col("marriage.original"))


def typed_orphans(edges: DataFrame, declared: DataFrame) -> DataFrame:
    """JOIN-10 to JOIN-12: references whose target is no record of the type it needs; `declared` is (doc_id, xref, type)."""
    types = F.create_map(*(F.lit(x) for pair in entities.TARGETS.items() for x in pair))
    wanted = edges.where("dst != ''").withColumn("type", types[F.col("ref_type")]).withColumnRenamed("dst", "xref")
    lost = wanted.join(declared.select("doc_id", "xref", "type"), ["doc_id", "xref", "type"], "left_anti")
    return issue(lost, ERROR, F.concat(F.lit("ORPHANED_"), F.col("ref_type")), "src", "xref", idx=F.col("idx"))


def broken_references(records: DataFrame) -> DataFrame:
    """JOIN-13: (doc_id, ..., details line) for tag values between two signs that no record has as identifier, VOID included."""
    flat = records.where("type NOT IN ('HEAD', '')").select("doc_id", "xref", F.explode("tags").alias("t")).select("doc_id", F.col("xref").alias("record"), F.col("t.value").alias("xref"), "t.line_number")
    signs = flat.where("length(xref) > 2 AND startswith(xref, '@') AND endswith(xref, '@')")
    return issue(signs.join(records.select("doc_id", "xref").where("xref != ''"), ["doc_id", "xref"], "left_anti"), ERROR, "BROKEN_XREF", "record", "xref", line=F.col("line_number"))


def required_fields(records: DataFrame) -> DataFrame:
    """VAL-02 to VAL-04: people without a NAME and families without a member, at any level."""
    has = lambda *names: F.exists("tags", lambda t: F.coalesce(t["tag"].isin(*names), F.lit(False)))
    return issue(records.where((F.col("type") == "INDI") & ~has("NAME")), ERROR, "MISSING_REQUIRED_FIELD", "xref").unionByName(issue(records.where((F.col("type") == "FAM") & ~has("HUSB", "WIFE", "CHIL")), ERROR, "EMPTY_FAMILY", "xref"))


def _of_version(rows: DataFrame, headers: DataFrame | None, wanted: Column) -> DataFrame:
    return rows if headers is None else rows.join(headers.where(wanted).select("doc_id").distinct(), "doc_id", "left_semi")


def missing_submitter(headers: DataFrame, compat: bool = False) -> DataFrame:
    """VAL-11: `headers` is (doc_id, version, submitter): versions before 7.0 need a submitter. With `compat` none counts as stated."""
    bad = headers.where(F.col("version").isin("5.5", "5.5.1") & (F.lit(compat) | (F.col("submitter") == ""))).withColumn("xref", F.lit(""))
    return issue(bad, WARNING, "MISSING_SUBM", "xref", version=F.col("version"))


def long_xrefs(declared: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """VAL-19: distinct identifiers of more than MAX_XREF_BYTES bytes between their signs, but in documents of version 7.0 if `headers` tells."""
    declared = _of_version(declared, headers, F.col("version") != "7.0")
    size = F.octet_length(F.regexp_replace("xref", "^@+|@+$", ""))
    return issue(declared.select("doc_id", "xref").distinct().where(size > MAX_XREF_BYTES), WARNING, "XREF_TOO_LONG", "xref", length=size)


def control_characters(values: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """VAL-21: `values` is (doc_id, xref, value); the first control character of each value, in documents of version 7.0 only if `headers` tells."""
    values = _of_version(values, headers, F.col("version") == "7.0")
    at = strings.control_position(F.col("value"))
    return issue(values.where(at.isNotNull()), ERROR, "BANNED_CONTROL_CHARACTER", "xref", position=at)


def encoding_of_version(headers: DataFrame) -> DataFrame:
    """VAL-20: `headers` is (doc_id, version, encoding); version 7.0 is written in UTF-8 only."""
    bad = headers.where((F.col("version") == "7.0") & ~F.upper("encoding").isin("", "UTF-8", "ASCII", "UNICODE")).withColumn("xref", F.lit(""))
    return issue(bad, ERROR, "INVALID_ENCODING_FOR_VERSION", "xref", encoding=F.col("encoding"))


def registry(*vendors: str) -> list[tuple[str, tuple[str, ...], str | None]]:
    """VAL-15 to VAL-18, SET-02: the vendors' tags, the first registration of a tag winning; all vendors if none is named."""
    merged: dict[str, tuple[str, tuple[str, ...], str | None]] = {}
    for vendor in vendors or VENDOR_TAGS:
        for tag in VENDOR_TAGS.get(vendor, ()):
            merged.setdefault(tag[0], tag)
    return sorted(merged.values())


def register(rules: list[tuple[str, tuple[str, ...], str | None]], *batch: tuple[str, tuple[str, ...], str | None]) -> list[tuple[str, tuple[str, ...], str | None]]:
    """VAL-14: the rules and a batch of more; a tag that comes twice is an error, and then nothing of the batch is registered."""
    names = [tag for tag, _, _ in (*rules, *batch)]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise ValueError("registered twice: " + ", ".join(twice))
    return sorted((*rules, *batch))


def check_tag(tag: Column, parent: Column, value: Column, rules: list[tuple[str, tuple[str, ...], str | None]], report_unknown: bool = False) -> Column:
    """VAL-12, VAL-13: the code of what is wrong with an own tag, null for nothing; the parent is looked at before the value."""
    found = F.when(F.lit(report_unknown) & F.startswith(tag, F.lit("_")), "UNKNOWN_CUSTOM_TAG")
    for name, parents, pattern in reversed(rules):
        misplaced = ~parent.isin(*parents) if parents else F.lit(False)
        misvalued = (value != "") & ~value.rlike(pattern) if pattern else F.lit(False)
        found = F.when(tag == name, F.when(misplaced, "INVALID_TAG_PARENT").when(misvalued, "INVALID_TAG_VALUE")).otherwise(found)
    return found


def with_parents(tags: Column) -> Column:
    """WIN-02: for each tag the one above it: the last tag at a lesser level, by a stack; '' for the first."""
    start = F.struct(F.array().cast("array<struct<level:int,tag:string>>").alias("open"), F.array().cast("array<string>").alias("above"))

    def step(state: Column, t: Column) -> Column:
        open_ = F.filter(state["open"], lambda o: o["level"] < t["level"])
        above = F.coalesce(F.try_element_at(open_, F.lit(-1))["tag"], F.lit(""))
        return F.struct(F.concat(open_, F.array(F.struct(t["level"].alias("level"), t["tag"].alias("tag")))).alias("open"), F.concat(state["above"], F.array(above)).alias("above"))

    return F.aggregate(tags, start, step, lambda state: state["above"])


def custom_tags(records: DataFrame, rules: list[tuple[str, tuple[str, ...], str | None]], report_unknown: bool = False) -> DataFrame:
    """VAL-12: issues of the own tags of all records but the header."""
    kept = records.where("type NOT IN ('HEAD', '')").select("doc_id", "xref", F.filter("tags", lambda t: t["tag"].isNotNull()).alias("tags"))
    zipped = kept.select("doc_id", "xref", "tags", with_parents(F.col("tags")).alias("above")).select("doc_id", "xref", F.posexplode("tags").alias("i", "t"), "above")
    named = zipped.select("doc_id", "xref", F.col("t.tag").alias("tag"), F.col("t.value").alias("value"), F.get("above", F.col("i")).alias("parent")).where("startswith(tag, '_')")
    checked = named.withColumn("code", check_tag(F.col("tag"), F.col("parent"), F.col("value"), rules, report_unknown)).where("code IS NOT NULL")
    severity = F.when(F.col("code") == "UNKNOWN_CUSTOM_TAG", WARNING).otherwise(ERROR)
    return issue(checked, severity, F.col("code"), "xref", tag=F.col("tag"), parent=F.col("parent"))


def _described(people: DataFrame, block: list[str]) -> DataFrame:
    return people.where((F.col("given") != "") & reduce(lambda a, b: a & b, [F.col(c) != "" for c in block]))


def duplicate_classes(people: DataFrame, block: list[str]) -> DataFrame:
    """(block columns, given, sex, year, first, class, members): people with one description, counted.

    `people` has xref, line_number, given (normalised), sex, year (null without a birth) and the block columns, the
    normalised surname among them; rows with an empty or null name or block have no class. `class` is the xref of the
    class's first line, `first` that line; equal lines are told apart by xref. Null sexes are one value, and null years.
    """
    least = F.min(F.struct("line_number", "xref"))
    rows = _described(people, block).groupBy(*block, "given", "sex", "year").agg(least.alias("__least"), F.count("*").alias("members"))
    return rows.select(*block, "given", "sex", "year", F.col("__least.line_number").alias("first"), F.col("__least.xref").alias("class"), "members")


def duplicate_members(people: DataFrame, classes: DataFrame, block: list[str]) -> DataFrame:
    """(block columns, xref, line_number, first, class, members): every described person with their class."""
    rows = _described(people, block).select(*block, "given", "sex", "year", "xref", "line_number")
    on = [rows[c] == classes[c] for c in block] + [rows[c].eqNullSafe(classes[c]) for c in ("given", "sex", "year")]
    return rows.join(classes, on).select(*(rows[c] for c in (*block, "xref", "line_number")), classes["first"], classes["class"], classes["members"])


def duplicate_links(classes: DataFrame, block: list[str]) -> DataFrame:
    """JOIN-16, VAL-22, VAL-23: (block columns, left, left_first, left_members, right, right_first, right_members, confidence): each
    pair of classes whose people may be the same once, the one with the earlier first line on the left.

    A class of several people that may be the same among themselves is linked with itself. With `duplicate_members` this is
    the whole result, without all pairs of a group of copies. Different given names of a block are compared before sexes and years come in,
    so a block costs the square of its names, not of its rows; names of one pair differ in length by at most a
    fifth of the longer, which prunes before the edit distance is taken.
    """
    names = classes.select(*block, "given").distinct()
    a, b = names.alias("a"), names.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in block])
    long, short = F.greatest(F.octet_length("a.given"), F.octet_length("b.given")), F.least(F.length("a.given"), F.length("b.given"))
    near = F.greatest(F.length("a.given"), F.length("b.given")) - short <= (1 - MIN_GIVEN_SIMILARITY) * long + 1e-9
    met = a.join(b, same & near & (F.col("a.given") <= F.col("b.given"))).select(*(F.col(f"a.{c}").alias(c) for c in block), F.col("a.given").alias("a_given"), F.col("b.given").alias("b_given"))
    alike = met.withColumn("alike", strings.similarity(F.col("a_given"), F.col("b_given"))).where(F.col("alike") >= MIN_GIVEN_SIMILARITY)

    def side(name: str) -> DataFrame:
        return classes.select(*block, *(F.col(c).alias(f"{name}_{c}") for c in ("given", "sex", "year", "first", "class", "members")))

    scored = alike.join(side("a"), [*block, "a_given"]).join(side("b"), [*block, "b_given"])
    # the two ways round of one pair with equal names are one link; a class alone has no one to be the same as
    a_end, b_end = (F.struct(*(F.col(f"{name}_{c}").alias(c) for c in ("first", "class", "members"))) for name in "ab")
    itself = (a_end == b_end) & (F.col("a_given") == F.col("b_given")) & F.col("a_sex").eqNullSafe(F.col("b_sex")) & F.col("a_year").eqNullSafe(F.col("b_year"))
    whole = lambda name: F.struct(f"{name}_first", f"{name}_class", f"{name}_sex", f"{name}_year")
    once = (F.col("a_given") != F.col("b_given")) | (whole("a") < whole("b")) | (itself & (F.col("a_members") > 1))
    apart = F.abs(F.col("a_year") - F.col("b_year"))
    year = F.when(apart == 0, 0.2).when(apart <= MAX_YEAR_DIFFERENCE, 0.1).otherwise(0.0)
    sex = F.when((F.col("a_sex") != "") & (F.col("a_sex") == F.col("b_sex")), 0.1).otherwise(0.0)
    scored = scored.where(once).withColumn("confidence", F.lit(0.3) + 0.3 * F.col("alike") + year + sex).where(F.col("confidence") >= MIN_CONFIDENCE)
    ends = scored.select(*block, F.least(a_end, b_end).alias("l"), F.greatest(a_end, b_end).alias("r"), "confidence")
    out = [F.col(f"{end[0]}.{c}").alias(name) for end in ("left", "right") for c, name in (("class", end), ("first", f"{end}_first"), ("members", f"{end}_members"))]
    return ends.select(*block, *out, "confidence")


def duplicate_pairs(people: DataFrame, block: list[str]) -> DataFrame:
    """(block columns, left, right, confidence): the links of `duplicate_links` expanded to people, for reports that name each pair.

    A group of n copies has n(n-1)/2 pairs; where that is too many, read links and members instead.
    """
    classes = duplicate_classes(people, block)
    members = duplicate_members(people, classes, block).select(*block, "class", "first", "xref", "line_number")
    side = lambda end: members.select(*block, F.col("class").alias(end), F.col("first").alias(f"{end}_first"), F.struct("line_number", "xref").alias(f"{end}_person"))
    links = duplicate_links(classes, block)
    pairs = links.join(side("left"), [*block, "left", "left_first"]).join(side("right"), [*block, "right", "right_first"])
    l, r = F.col("left_person"), F.col("right_person")
    itself = (F.col("left") == F.col("right")) & (F.col("left_first") == F.col("right_first"))
    kept = F.when(itself, l["line_number"] < r["line_number"]).otherwise(l["line_number"] != r["line_number"])
    return pairs.where(kept).select(*block, F.least(l, r)["xref"].alias("left"), F.greatest(l, r)["xref"].alias("right"), "confidence")


def completeness(people: DataFrame) -> DataFrame:
    """AGG-01, AGG-02: (doc_id, total, with_birth, with_death, with_source, with_place) from individuals."""
    has = lambda c: F.count_if(c)
    place = F.exists("events", lambda e: e["place"] != "")
    return people.groupBy("doc_id").agg(F.count("*").alias("total"), has(F.col("birth").isNotNull()).alias("with_birth"), has(F.col("death").isNotNull()).alias("with_death"), has(F.size("citations") > 0).alias("with_source"), has(place).alias("with_place"))


def shown(issues: DataFrame, strictness: str = "normal", skip: tuple[str, ...] = (), most: int | None = None) -> DataFrame:
    """FLT-09 to FLT-11, SORT-01: issues of the severities of a strictness, without the codes to skip, at most `most` in order."""
    kept = issues.where(F.col("severity").isin(*SHOWN[strictness]) & ~F.col("code").isin(*skip))
    if most is None:
        return kept
    rank = F.when(F.col("severity") == ERROR, 0).when(F.col("severity") == WARNING, 1).otherwise(2)
    return kept.orderBy(rank, "code", "record_xref", "related_xref").limit(most)


def legacy(records: DataFrame) -> DataFrame:
    """VAL-02: the short validation: broken references and required fields."""
    return broken_references(records).unionByName(required_fields(records))


def dated_people(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(people, marriages): slim people with birth and death, and (doc_id, family, marriage), all written to the shared folder.

    Every different date text is parsed once, in a table of its own that people and marriages are joined to: no plan holds the parser more
    than once, and no predicate over a date is pushed below it.
    """
    text = lambda kind: F.coalesce(F.get(F.filter("events", lambda e: e["type"] == kind), F.lit(0))["date"], F.lit(""))
    own = F.get("names", F.lit(0))
    people = entities.undated(records).select(
        "doc_id", "xref", "line_number", "sex", F.coalesce(own["given"], F.lit("")).alias("given"), F.coalesce(own["surname"], F.lit("")).alias("surname"), text("BIRT").alias("birth_text"), text("DEAT").alias("death_text"),
        F.size("names").alias("n_names"), F.size("citations").alias("n_citations"), F.exists("events", lambda e: e["place"] != "").alias("has_place"),
    )
    people = written(people, "people")
    married = entities.undated_families(records).select("doc_id", F.col("xref").alias("family"), F.explode(F.filter("events", lambda e: (e["type"] == "MARR") & (e["date"] != ""))).alias("e"))
    married = written(married.select("doc_id", "family", F.col("e.date").alias("text")), "marriages")
    texts = people.select(F.explode(F.array("birth_text", "death_text")).alias("text")).unionAll(married.select("text")).where("text != ''").distinct()
    parsed = written(texts.select("text", dates.parse_date(F.col("text")).alias("d")), "dates").where("d.error IS NULL")
    for kind in ("birth", "death"):
        people = people.join(parsed.select(F.col("text").alias(f"{kind}_text"), F.col("d").alias(kind)), f"{kind}_text", "left")
    return written(people, "dated"), written(married.join(parsed, "text").select("doc_id", "family", F.col("d").alias("marriage")), "dated")


def names_alike(people: DataFrame) -> DataFrame:
    """VAL-22, VAL-24: issues of people who may be the same, with the confidence and its reasons."""
    name = lambda c: strings.normalize_name(F.col(c))
    named = people.select("doc_id", "xref", "line_number", "sex", F.col("birth.year").alias("year"), name("given").alias("given"), name("surname").alias("surname"))
    pairs = duplicate_pairs(named, ["doc_id", "surname"])
    return issue(pairs, INFO, "POTENTIAL_DUPLICATE", "left", "right", confidence=F.format_string("%.2f", F.col("confidence")), reason_1=F.lit("same surname"), reason_2=F.lit("similar given names"))


def incomplete(people: DataFrame) -> DataFrame:
    """AGG-02: people without a birth date, without a source, without a name; a phrase counts as a date."""
    lacks = ((F.col("birth").isNull(), "MISSING_BIRTH_DATE"), (F.col("n_citations") == 0, "NO_SOURCES"), (F.col("n_names") == 0, "MISSING_NAME"))
    return _all([issue(people.where(test), INFO, code, "xref") for test, code in lacks])


# The categories of the quality report.
CATEGORIES = {
    "date_logic": ("DEATH_BEFORE_BIRTH", "CHILD_BEFORE_PARENT", "MARRIAGE_BEFORE_BIRTH", "IMPOSSIBLE_AGE", "UNREASONABLE_PARENT_AGE"), "duplicate": ("POTENTIAL_DUPLICATE",),
    "completeness": ("MISSING_BIRTH_DATE", "MISSING_DEATH_DATE", "MISSING_NAME", "NO_SOURCES"), "custom_tag": ("INVALID_TAG_PARENT", "INVALID_TAG_VALUE", "UNKNOWN_CUSTOM_TAG"),
}


def category(code: Column) -> Column:
    found = F.when(F.startswith(code, F.lit("ORPHANED_")), "reference")
    for name, codes in CATEGORIES.items():
        found = found.when(code.isin(*codes), name)
    return found


def of_record(issues: DataFrame, xref: str) -> DataFrame:
    """FLT-08: the issues that a record has or is related to."""
    return issues.where((F.col("record_xref") == xref) | (F.col("related_xref") == xref))


def by_code(issues: DataFrame, code: str) -> DataFrame:
    """FLT-07."""
    return issues.where(F.col("code") == code)


# What issues say.
MESSAGES = {
    "DEATH_BEFORE_BIRTH": "death is before birth", "IMPOSSIBLE_AGE": "age is beyond the limit", "CHILD_BEFORE_PARENT": "child is born before parent", "MARRIAGE_BEFORE_BIRTH": "marriage is before birth",
    "UNREASONABLE_PARENT_AGE": "age of the parent is unreasonable", "POTENTIAL_DUPLICATE": "may be the same person", "MISSING_BIRTH_DATE": "individual has no birth date recorded", "NO_SOURCES": "individual has no source citations",
    "MISSING_NAME": "individual has no name recorded", "MISSING_SUBM": "the header needs a submitter", "XREF_TOO_LONG": "identifier is too long", "BROKEN_XREF": "reference to a missing record",
}


def rendered(issues: DataFrame) -> DataFrame:
    """STR-27: (doc_id, text): `[SEVERITY] CODE: message (record -> related)`; codes without a message say their own words."""
    table = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
    message = F.coalesce(F.try_element_at(table, F.col("code")), F.lower(F.replace("code", F.lit("_"), F.lit(" "))))
    related = F.when(F.col("related_xref") != "", F.concat(F.lit(" -> "), "related_xref")).otherwise("")
    place = F.when(F.col("record_xref") != "", F.concat(F.lit(" ("), "record_xref", related, F.lit(")"))).otherwise("")
    return issues.select("doc_id", F.concat(F.lit("["), "severity", F.lit("] "), "code", F.lit(": "), message, place).alias("text"))


def _date_rules(edges: DataFrame, people: DataFrame, marriages: DataFrame, limits: Limits) -> list[DataFrame]:
    return [own_dates(people, limits), parents_dates(edges, people, limits), marriages_before_birth(edges, people, marriages)]


def validate_all(records: DataFrame, vendors: tuple[str, ...] | None = None, strictness: str = "strict", skip: tuple[str, ...] = (), most: int | None = None, limits: Limits = Limits(), compat: bool = False) -> DataFrame:  # noqa: B008
    """VAL-01, VAL-25: header, date, reference, identifier, duplicate and encoding rules over documents of any number, and the rules of
    vendors' tags if vendors are named (an empty tuple names all); then what `shown` leaves.
    """
    people, marriages = dated_people(records)
    edges = written(entities.edges(records), "edges")
    headers = written(tagged.header(records).join(tagged.detect_version(records), "doc_id").select("doc_id", "version", "encoding", "submitter"), "headers")
    declared = records.where("xref != ''").select("doc_id", "xref", "type")
    values = records.select("doc_id", "xref", F.explode("tags").alias("t")).select("doc_id", "xref", F.col("t.value").alias("value")).where("value != ''")
    parts = [missing_submitter(headers, compat), *_date_rules(edges, people, marriages, limits), typed_orphans(edges, declared), long_xrefs(declared, headers), names_alike(people)]
    parts += [custom_tags(records, registry(*vendors))] if vendors is not None else []
    return shown(_all([*parts, encoding_of_version(headers), control_characters(values, headers)]), strictness, skip, most)


def quality(records: DataFrame, vendors: tuple[str, ...] | None = None, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """AGG-01 to AGG-03, AGG-06: (report, issues): one row of counts and shares for each document, and all issues with their category.

    A share is 0 where there are no people. The issues of the report are the second table, which has no bound.
    """
    people, marriages = dated_people(records)
    edges = written(entities.edges(records), "edges")
    declared = records.where("xref != ''").select("doc_id", "xref", "type")
    parts = [*_date_rules(edges, people, marriages, limits), typed_orphans(edges, declared), names_alike(people), incomplete(people)]
    parts += [custom_tags(records, registry(*vendors))] if vendors is not None else []
    issues = written(_all(parts).withColumn("category", category(F.col("code"))), "issues")
    has = lambda name, test: F.count_if(test).alias(name)
    records_of = records.groupBy("doc_id").agg(has("total_individuals", F.col("type") == "INDI"), has("total_families", F.col("type") == "FAM"), has("total_sources", F.col("type") == "SOUR"))
    filled = people.groupBy("doc_id").agg(has("individuals_with_birth_date", F.col("birth").isNotNull()), has("individuals_with_death_date", F.col("death").isNotNull()), has("individuals_with_sources", F.col("n_citations") > 0), has("individuals_with_places", F.col("has_place")))
    said = issues.groupBy("doc_id").agg(F.count("*").alias("total_issues"), *(has(f"{n}_count", F.col("severity") == s) for n, s in (("error", ERROR), ("warning", WARNING), ("info", INFO))), *(has(f"{n}_issues", F.col("category") == n) for n in ("reference", *CATEGORIES)))
    joined = records_of.join(filled, "doc_id", "left").join(said, "doc_id", "left")
    joined = joined.na.fill(0)
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("total_individuals")), F.lit(0.0))
    return joined.withColumns({"birth_date_coverage": share("individuals_with_birth_date"), "death_date_coverage": share("individuals_with_death_date"), "source_coverage": share("individuals_with_sources")}), issues


def as_json(report: DataFrame) -> DataFrame:
    """STR-26: (doc_id, report): the row of `quality` as JSON."""
    return report.select("doc_id", F.to_json(F.struct(*(c for c in report.columns if c != "doc_id"))).alias("report"))
