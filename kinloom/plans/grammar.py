"""Queries of lines, dates, calendars, entities, conversion and rules over the driver tables, with DuckDB equivalents.

The equivalents state expected values as such, or derive them another way: calendars by tables of years, entities and conversions by the lines
that must come out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import calendars, dates, lines, strings
from kinloom.operators import conversion, merge, rules
from kinloom.shipping import fresh_path
from kinloom.sources import sinks, tagged, typed, untyped
from kinloom.streaming import orphans

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(key: str, options: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, options)), (F.col(key) % len(options)).cast("int"))


def _quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(str(x) if isinstance(x, int) else _quoted(x) for x in row) + ")" for row in rows)


# a line, and the level, identifier, tag, value and code that it must give
LINES = [
    ("0 HEAD", 0, "", "HEAD", "", None), ("  1 NAME  two spaces", 1, "", "NAME", " two spaces", None), ("0 @I1@ INDI", 0, "@I1@", "INDI", "", None), ("+1 SEX M ", 1, "", "SEX", "M ", None), ("007 A", 7, "", "A", "", None),
    ("", None, "", None, "", "EMPTY_LINE"), ("   ", None, "", None, "", "EMPTY_LINE"), ("0", None, "", None, "", "SYNTAX_ERROR"), ("x NAME", None, "", None, "", "INVALID_LEVEL"), ("-1 A", None, "", None, "", "INVALID_LEVEL"),
    ("100 A", None, "", None, "", "INVALID_LEVEL"), ("1.0 A", None, "", None, "", "INVALID_LEVEL"), ("0 @I1@", None, "", None, "", "INVALID_XREF"), ("0 @a b@ NOTE x", 0, "@a b@", "NOTE", "x", "INVALID_XREF"),
    ("0 @I1 INDI", 0, "@I1", "INDI", "", "INVALID_XREF"), ("0 @x HEAD", 0, "", "@x", "HEAD", "INVALID_XREF"), ("1 NOTE @I1@", 1, "", "NOTE", "@I1@", None), ("1 A    ", 1, "", "A", "", None),
]


def line_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SRC-17, SRC-18, SRC-40: good and faulty lines."""
    parsed = table(spark, sf_dir, "customer").select("c_custkey", lines.parse_line(_pick("c_custkey", [x[0] for x in LINES])).alias("p"))
    return parsed.select("c_custkey", "p.level", "p.xref", "p.tag", "p.value", "p.code")


# a date with Y for the year; modifier, calendar, day, month, year (-1: Y), BC, dual year (-1: Y's century and 51), phrase, what is interpreted, end's day, month and year (-1: Y, -2: Y + 1), good
DATES = [
    ("BET 1 JAN Y AND 2 FEB Y", "BET", "GREGORIAN", 1, 1, -1, 0, 0, "", "", 2, 2, -1, 1), ("FROM Y TO MAR Z", "FROM TO", "GREGORIAN", 0, 0, -1, 0, 0, "", "", 0, 3, -2, 1), ("TO Y", "TO", "GREGORIAN", 0, 0, -1, 0, 0, "", "", None, None, None, 1),
    ("FROM 5 MAY Y", "FROM", "GREGORIAN", 5, 5, -1, 0, 0, "", "", None, None, None, 1), ("INT 3 MAR Y (at Easter)", "INT", "GREGORIAN", 3, 3, -1, 0, 0, "", "at Easter", None, None, None, 1),
    ("(some day)", "", "GREGORIAN", 0, 0, 0, 0, 0, "some day", "", None, None, None, 1), ("@#DJULIAN@ 4 APR Y", "", "JULIAN", 4, 4, -1, 0, 0, "", "", None, None, None, 1), ("@#DHEBREW@ 7 ADS Y", "", "HEBREW", 7, 7, -1, 0, 0, "", "", None, None, None, 1),
    ("@#DFRENCH R@ 1 COMP Y", "", "FRENCH R", 1, 13, -1, 0, 0, "", "", None, None, None, 1), ("1 FEB Y/51", "", "GREGORIAN", 1, 2, -1, 0, -1, "", "", None, None, None, 1), ("44 BC", "", "GREGORIAN", 0, 0, 44, 1, 0, "", "", None, None, None, 1),
    ("15 MAR 44 B.C.E.", "", "GREGORIAN", 15, 3, 44, 1, 0, "", "", None, None, None, 1), ("abt dec Y", "ABT", "GREGORIAN", 0, 12, -1, 0, 0, "", "", None, None, None, 1), ("CAL Y", "CAL", "GREGORIAN", 0, 0, -1, 0, 0, "", "", None, None, None, 1),
    ("EST Y", "EST", "GREGORIAN", 0, 0, -1, 0, 0, "", "", None, None, None, 1), ("BEF  2 JUN  Y", "BEF", "GREGORIAN", 2, 6, -1, 0, 0, "", "", None, None, None, 1), ("AFT Y", "AFT", "GREGORIAN", 0, 0, -1, 0, 0, "", "", None, None, None, 1),
    ("5 XYZ Y", "", "GREGORIAN", 0, 0, 0, 0, 0, "", "", None, None, None, 0), ("1 2 3 4", "", "GREGORIAN", 0, 0, 0, 0, 0, "", "", None, None, None, 0), ("", "", "GREGORIAN", 0, 0, 0, 0, 0, "", "", None, None, None, 0),
]


def date_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-01 to DATE-09: every form of a date, with years that change."""
    year = (1700 + F.col("o_orderkey") % 200).cast("string")
    text = F.replace(F.replace(_pick("o_orderkey", [x[0] for x in DATES]), F.lit("Y"), year), F.lit("Z"), (1701 + F.col("o_orderkey") % 200).cast("string"))
    # the letters of JULY-like months do not hold a Y or Z here but in XYZ, MAY and DAY, which stay as they are
    text = F.when(F.col("o_orderkey") % len(DATES) == 3, F.concat(F.lit("FROM 5 MAY "), year)).when(F.col("o_orderkey") % len(DATES) == 5, "(some day)").when(F.col("o_orderkey") % len(DATES) == 17, F.concat(F.lit("5 XYZ "), year)).otherwise(text)
    d = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(text).alias("d"))
    return d.select("o_orderkey", "d.modifier", "d.calendar", "d.day", "d.month", "d.year", "d.is_bc", "d.dual_year", "d.phrase", "d.interpreted_from", F.col("d.end_date.day").alias("end_day"), F.col("d.end_date.month").alias("end_month"), F.col("d.end_date.year").alias("end_year"), F.col("d.error").isNull().alias("good"))


def _day(rows: DataFrame) -> tuple[Column, Column, Column]:
    return F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")


def date_julian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-21, DATE-22, DATE-17: the Julian date of a day, the day number of a Julian date, and a Julian date as a Gregorian one."""
    orders = table(spark, sf_dir, "orders")
    jdn = calendars.gregorian_to_jdn(*_day(orders))
    rows = orders.select("o_orderkey", calendars.julian_to_jdn(*_day(orders)).cast("long").alias("as_julian"), calendars.jdn_to_julian(jdn).alias("j"))
    d = F.struct(F.col("j.day").alias("day"), F.col("j.month").alias("month"), F.col("j.year").alias("year"), F.lit("JULIAN").alias("calendar"), F.lit(False).alias("is_bc"), F.lit(0).alias("dual_year"))
    return rows.withColumn("g", dates.to_gregorian(d)).select("o_orderkey", "as_julian", "j.year", "j.month", "j.day", F.col("g.year").alias("g_year"), F.col("g.month").alias("g_month"), F.col("g.day").alias("g_day"))


def date_french(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-23 to DATE-25: French dates of days, and back."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", calendars.gregorian_to_jdn(*_day(orders)).alias("jdn")).withColumn("f", calendars.jdn_to_french(F.col("jdn")))
    return rows.select("o_orderkey", "f.year", "f.month", "f.day", (calendars.french_to_jdn(F.col("f.year"), F.col("f.month"), F.col("f.day")) == F.col("jdn")).alias("same"), calendars.is_french_leap(F.col("f.year")).alias("leap"))


def date_hebrew(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-26 to DATE-32: Hebrew dates of days, and back; the year's days and months."""
    orders = table(spark, sf_dir, "orders")
    rows = orders.select("o_orderkey", calendars.gregorian_to_jdn(*_day(orders)).alias("jdn")).withColumn("h", calendars.jdn_to_hebrew(F.col("jdn")))
    year = F.col("h.year")
    return rows.select("o_orderkey", "h.year", "h.month", "h.day", calendars.hebrew_days_in_year(year).cast("long").alias("days"), calendars.hebrew_months_in_year(year).cast("long").alias("months"), (calendars.hebrew_to_jdn(year, F.col("h.month"), F.col("h.day")) == F.col("jdn")).alias("same"))


def astronomical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-33, DATE-34."""
    key = F.col("c_custkey").cast("int")
    rows = table(spark, sf_dir, "customer").select("c_custkey", calendars.astronomical_year(key % 100 + 1, key % 2 == 0).cast("int").alias("year"), calendars.from_astronomical_year(key % 100 - 50).alias("b"))
    return rows.select("c_custkey", "year", F.col("b.year").cast("int").alias("back"), F.col("b.is_bc").alias("is_bc"))


def _partial(a: int, b: int, c: int) -> Column:
    """A date whose month and day are often unknown; day only with a month."""
    key = F.col("o_orderkey")
    month = (key % a % 13).cast("int")
    return F.struct(F.when(month == 0, 0).otherwise((key % b % 29).cast("int")).alias("day"), month.alias("month"), (1800 + key % c).cast("int").alias("year"), F.lit("GREGORIAN").alias("calendar"), F.lit(False).alias("is_bc"), F.lit(0).alias("dual_year"))


def date_compare_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-10 to DATE-13, SORT-04: partial dates in order."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _partial(17, 31, 5).alias("a"), _partial(19, 37, 7).alias("b"))
    a, b = F.col("a"), F.col("b")
    return rows.select("o_orderkey", dates.compare(a, b).alias("order"), dates.is_before(a, b).alias("before"), dates.is_after(a, b).alias("after"), dates.is_equal(a, b).alias("equal"))


def years_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-18, DATE-36."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", _partial(17, 31, 5).alias("a"), _partial(19, 37, 7).alias("b"))
    y = dates.years_between(F.col("a"), F.col("b"))
    return rows.select("o_orderkey", y["years"].alias("years"), y["exact"].alias("exact"), dates.parent_age_message(F.col("a"), F.col("b"), 3).isNotNull().alias("young"))


def date_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-14, DATE-15: which complete dates there are, and days beyond a month's end."""
    key = F.col("o_orderkey")
    number = lambda c, name: c.cast("int").alias(name)
    d = F.struct(number(key % 35, "day"), number(key % 14, "month"), number(1890 + key % 21, "year"), F.lit("GREGORIAN").alias("calendar"), F.lit(False).alias("is_bc"), F.lit(0).alias("dual_year"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("d"))
    return rows.select("o_orderkey", dates.validate(F.col("d")).isNull().alias("good"), F.datediff(dates.to_date(F.col("d")), F.lit("1890-01-01").cast("date")).alias("days"))


def _people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file with one person for each customer."""
    key = F.col("c_custkey").cast("string")
    text = F.concat(
        F.lit("0 HEAD\n1 SOUR App\n0 @I"), key, F.lit("@ INDI\n1 NAME Given "), key, F.lit(" /Sur "), key, F.lit("/\n2 NPFX Dr\n2 TRAN other\n3 LANG de\n1 SEX F\n1 BIRT\n2 DATE 1 JAN 1900\n2 PLAC Town "), key,
        F.lit("\n3 MAP\n4 LATI N1\n4 LONG E2\n2 ADDR Street "), key, F.lit("\n3 CONT House\n3 CITY City\n2 PHON 1\n2 PHON "), key, F.lit("\n2 SOUR @S1@\n3 QUAY "), (F.col("c_custkey") % 6).cast("string"), F.lit("\n3 DATA\n4 TEXT t\n2 OBJE @O1@\n3 CROP\n4 TOP "), key,
        F.lit("\n1 NO MARR\n1 OCCU baker\n2 TYPE job\n1 BAPL\n2 TEMP T\n1 FAMC @F1@\n2 PEDI adopted\n1 ASSO @I2@\n2 RELA friend\n1 NOTE @N1@\n1 NOTE a\n2 CONT "), key, F.lit("\n1 CHAN\n2 DATE 2020\n3 TIME 10:00\n1 EXID "), key, F.lit("\n2 TYPE u\n0 TRLR\n"),
    )
    return tagged.records_of(table(spark, sf_dir, "customer").select(key.alias("doc_id"), text.alias("text")))


def entity_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ENT-02 to ENT-15, ENT-19, ENT-26, ENT-28, ENT-41: what a person's nested tags become."""
    p = typed.individuals(_people(spark, sf_dir))
    n, e = F.get("names", F.lit(0)), F.get("events", F.lit(0))
    c, at = F.get(e["citations"], F.lit(0)), e["place_detail"]["coordinates"]
    return p.select(
        "xref", n["given"].alias("given"), n["surname"].alias("surname"), F.get(n["transliterations"], F.lit(0))["language"].alias("language"), e["place"].alias("place"), F.concat(at["latitude"], at["longitude"]).alias("at"), e["address"]["line1"].alias("line1"), e["address"]["city"].alias("city"),
        F.array_join(e["phone"], ",").alias("phones"), c["quality"].alias("quality"), c["data"]["text"].alias("cited"), F.get(e["media"], F.lit(0))["crop"]["top"].alias("top"), F.get("events", F.lit(1))["is_negative"].alias("negative"), F.get("attributes", F.lit(0))["detail"].alias("detail"),
        F.get("ordinances", F.lit(0))["temple"].alias("temple"), F.get("child_in_families", F.lit(0))["pedigree"].alias("pedigree"), F.get("associations", F.lit(0))["role"].alias("role"), F.array_join("note_xrefs", ",").alias("note_xrefs"), F.array_join("inline_notes", ",").alias("inline_notes"),
        F.col("change_date.time").alias("time"), F.get("external_ids", F.lit(0))["value"].cast("string").alias("external_id"),
    )


def entity_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SINK-05, SINK-06, SINK-09, SINK-23 to SINK-36, SINK-41: the lines that a typed person is written as."""
    return sinks.encode(untyped.to_records(typed.individuals(_people(spark, sf_dir)), "INDI")).select("doc_id", "text")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One file of an old or new version for each supplier."""
    key = F.col("s_suppkey").cast("string")
    new = F.col("s_suppkey") % 2 == 0
    head = F.concat(F.lit("0 HEAD\n1 GEDC\n2 VERS "), F.when(new, "7.0").otherwise("5.5.1"), F.lit("\n1 CHAR "), F.when(new, "UTF-8").otherwise("ANSEL"), F.lit("\n"))
    old_body = F.concat(F.lit("0 @i"), key, F.lit("@ INDI\n1 NOTE a\n2 CONC b\n2 CONT "), key, F.lit("\n1 _OWN x\n0 @F1@ FAM\n1 HUSB @i"), key, F.lit("@\n0 @O1@ OBJE\n1 FILE f\n2 FORM JPG\n0 TRLR\n"))
    new_body = F.concat(F.lit("0 @I"), key, F.lit("@ INDI\n1 EXID "), key, F.lit("\n2 TYPE https://www.familysearch.org/ark\n1 UID u\n0 @O1@ OBJE\n1 FILE f\n2 FORM image/png\n0 TRLR\n"))
    return tagged.records_of(table(spark, sf_dir, "supplier").select(key.alias("doc_id"), F.concat(head, F.when(new, new_body).otherwise(old_body)).alias("text")))


def _convert(spark: SparkSession, sf_dir: str, target: str) -> tuple[DataFrame, DataFrame]:
    return conversion.convert(_documents(spark, sf_dir), target)


def convert_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONV-01, CONV-05, CONV-08, CONV-11, CONV-12, CONV-14, MERGE-02: the records of version 7.0."""
    return sinks.encode(_convert(spark, sf_dir, "7.0")[0]).select("doc_id", "rec_no", "text")


def convert_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONV-07, CONV-09, CONV-13, CONV-15: the records of version 5.5.1."""
    return sinks.encode(_convert(spark, sf_dir, "5.5.1")[0]).select("doc_id", "rec_no", "text")


def convert_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONV-16, CONV-17, AGG-07 to AGG-09, SET-05, STR-22 to STR-24, WIN-09: what a downgrade reports, counted."""
    return _convert(spark, sf_dir, "5.5.1")[1].groupBy("kind", "original", "result").agg(F.sum("n").alias("n"))


def version_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-33, AGG-12: stated versions, and versions by their tags; the least version that holds all."""
    options = ["1 GEDC\n2 VERS 5.5\n", "1 GEDC\n2 VERS 7.0.0\n", "1 GEDC\n2 VERS 5.5.5\n", "", "1 X\n0 @I@ INDI\n1 EXID 1\n", "1 X\n0 @I@ INDI\n1 BIRT\n2 PLAC\n3 MAP\n"]
    text = F.concat(F.lit("0 HEAD\n"), _pick("c_custkey", options), F.lit("0 TRLR\n"))
    found = tagged.records_of(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("doc_id"), text.alias("text")))
    return tagged.detect_version(found).join(conversion.minimum_version(found).withColumnRenamed("version", "minimum"), "doc_id")


def remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE-01, MERGE-02: identifiers and pointers renamed in one pass, texts left alone."""
    key = F.col("s_suppkey")
    text = F.concat(F.lit("0 @I"), key, F.lit("@ INDI\n1 ALIA @I"), key + 1, F.lit("@\n1 NOTE see @I"), key, F.lit("@\n"))
    found = tagged.records_of(table(spark, sf_dir, "supplier").select(key.cast("string").alias("doc_id"), text.alias("text")))
    ids = lambda by: F.concat(F.lit("@I"), F.col("s_suppkey") + by, F.lit("@"))
    one = lambda by: table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("doc_id"), ids(by).alias("old"), ids(by + 1).alias("new"))
    return sinks.encode(merge.apply_mapping(found, one(0).unionAll(one(1)))).select("doc_id", "text")


def string_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05 to STR-11, STR-14, STR-22, STR-23, STR-25, ENT-34 to ENT-36."""
    key = F.col("c_custkey").cast("string")
    full, xref = F.concat(F.lit("Ann "), key, F.lit(" /Lee "), key, F.lit("/")), F.concat(F.lit("@I"), key, F.lit("@"))
    uri = _pick("c_custkey", ["https://www.familysearch.org/ark", "http://familysearch.org/ark:/1", "http://familysearch.org/arkansas", "x"])
    value = F.concat(_pick("c_custkey", ["1,", "", ":", "2,"]), _pick("c_custkey", ["7::", "8::", "9:", "::"]), key)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", strings.surname_of(full).alias("surname"), strings.given_of(full).alias("given"), strings.display_name(full, F.lit(""), F.lit(""), xref).alias("shown"), strings.display_name(F.lit(""), F.lit(""), F.lit(""), xref).alias("unnamed"),
        strings.is_pointer(F.when(F.col("c_custkey") % 2 == 0, xref).otherwise("@VOID@")).alias("pointer"), strings.escape_at(xref).alias("escaped"), strings.unescape_at(F.concat(F.lit("@"), xref)).alias("unescaped"),
        strings.path(strings.record_path(F.lit("OBJE"), xref), F.lit("FILE"), F.lit("")).alias("path"), strings.is_familysearch_ark(uri).alias("ark"), strings.apid(value)["database"].alias("database"), strings.familysearch_url(key).alias("url"),
    )


def stream_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STRM-01 to STRM-03, STRM-06, SET-03: references of a stream of events to others of its events."""
    folder = fresh_path(spark, "stream")
    events = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # an event with an even number is a record, each one refers to that with thrice its number
    xref = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string"))
    orphans.collect(events.select(xref.alias("xref"), F.col("event_type").alias("ref_type"), (F.col("event_id") * 3).cast("string").alias("target")), folder, f"{folder}/checkpoint").awaitTermination()
    return orphans.finalize(spark, folder).groupBy("code").agg(F.count("*").alias("n"))


def completeness_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-02, STR-27, FLT-07: what people lack, as text."""
    key = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(F.lit("d").alias("doc_id"), F.concat(F.lit("@I"), key, F.lit("@")).alias("xref"), F.when(key % 3 > 0, key).alias("birth"), (key % 2).alias("n_citations"), (key % 5).alias("n_names"))
    return rules.rendered(rules.incomplete(people)).select("text")


def header_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-11, VAL-19 to VAL-21: rules that depend on the version."""
    key = F.col("c_custkey")
    version, encoding = _pick("c_custkey", ["5.5", "5.5.1", "7.0"]), _pick("c_custkey", ["ANSEL", "UTF-8", "UNICODE", "", "UTF-16"])
    headers = table(spark, sf_dir, "customer").select(key.cast("string").alias("doc_id"), version.alias("version"), encoding.alias("encoding"), F.when(key % 2 == 0, "@U@").otherwise("").alias("submitter"))
    named = headers.select("doc_id", F.concat(F.lit("@"), F.repeat(F.lit("x"), (F.col("doc_id").cast("int") % 40)), F.lit("@")).alias("xref"))
    values = headers.select("doc_id", F.lit("@I@").alias("xref"), F.concat(F.lit("é"), F.when(F.col("doc_id").cast("int") % 4 == 0, F.lit("\x01"))).alias("value")).where("value IS NOT NULL")
    found = rules.missing_submitter(headers).unionByName(rules.encoding_of_version(headers)).unionByName(rules.long_xrefs(named, headers)).unionByName(rules.control_characters(values, headers))
    return found.select("doc_id", "severity", "code")


def typed_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10 to JOIN-12: references must hit a record of their type."""
    items = table(spark, sf_dir, "lineitem")
    edges = items.select(F.lit("d").alias("doc_id"), F.col("l_orderkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), _pick("l_linenumber", ["CHIL", "FAMC", "SOUR", "HUSB"]).alias("ref_type"), F.col("l_linenumber").alias("idx"))
    declared = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.col("p_partkey").cast("string").alias("xref"), _pick("p_partkey", ["INDI", "FAM", "SOUR"]).alias("type"))
    return rules.typed_orphans(edges, declared).groupBy("code").agg(F.count("*").alias("n"))


Y = "(1700 + o_orderkey % 200)"
PEOPLE = """'0 @I' || c_custkey || '@ INDI' || chr(10) || '1 NAME Given ' || c_custkey || ' /Sur ' || c_custkey || '/' || chr(10) || '2 GIVN Given ' || c_custkey || chr(10) || '2 SURN Sur ' || c_custkey || chr(10) || '2 NPFX Dr' || chr(10) || '2 TRAN other' || chr(10) || '3 LANG de' || chr(10) || '1 SEX F' || chr(10) ||
    '1 BIRT' || chr(10) || '2 DATE 1 JAN 1900' || chr(10) || '2 PLAC Town ' || c_custkey || chr(10) || '3 MAP' || chr(10) || '4 LATI N1' || chr(10) || '4 LONG E2' || chr(10) || '2 ADDR Street ' || c_custkey || chr(10) || '3 CONT House' || chr(10) || '3 ADR1 Street ' || c_custkey || chr(10) || '4 CONT House' || chr(10) || '3 CITY City' || chr(10) ||
    '2 PHON 1' || chr(10) || '2 PHON ' || c_custkey || chr(10) || '2 SOUR @S1@' || chr(10) || CASE WHEN c_custkey % 6 BETWEEN 1 AND 3 THEN '3 QUAY ' || (c_custkey % 6) || chr(10) ELSE '' END || '3 DATA' || chr(10) || '4 TEXT t' || chr(10) || '2 OBJE @O1@' || chr(10) || '3 CROP' || chr(10) || CASE WHEN c_custkey = 0 THEN '' ELSE '4 TOP ' || c_custkey || chr(10) END || '1 NO MARR' || chr(10) ||
    '1 OCCU baker' || chr(10) || '2 TYPE job' || chr(10) || '1 BAPL' || chr(10) || '2 TEMP T' || chr(10) || '1 FAMC @F1@' || chr(10) || '2 PEDI adopted' || chr(10) || '1 ASSO @I2@' || chr(10) || '2 ROLE friend' || chr(10) || '1 NOTE @N1@' || chr(10) || '1 NOTE a' || chr(10) || '2 CONT ' || c_custkey || chr(10) ||
    '1 CHAN' || chr(10) || '2 DATE 2020' || chr(10) || '3 TIME 10:00' || chr(10) || '1 EXID ' || c_custkey || chr(10) || '2 TYPE u' || chr(10)"""
A, B = (f"(1800 + o_orderkey % {c}) AS {n}_y, o_orderkey % {a} % 13 AS {n}_m, CASE WHEN o_orderkey % {a} % 13 = 0 THEN 0 ELSE o_orderkey % {b} % 29 END AS {n}_d" for n, a, b, c in (("a", 17, 31, 5), ("b", 19, 37, 7)))
PAIRS = f"SELECT *, (a_y * 10000 + greatest(a_m, 1) * 100 + greatest(a_d, 1)) - (b_y * 10000 + greatest(b_m, 1) * 100 + greatest(b_d, 1)) AS diff FROM (SELECT o_orderkey, {A}, {B} FROM orders)"
ODD = "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 1"
EVEN = "SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 2 = 0"


def _texts(rows: str, *parts: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST(k AS VARCHAR) AS doc_id, CAST({i} AS INT) AS rec_no, {text} AS text FROM ({rows})" for i, text in enumerate(parts))


def _sql(text: str) -> str:
    """A text with {k} for the key as SQL."""
    return " || ".join("k" if part == "{k}" else f"replace({_quoted(part)}, '~', chr(10))" for part in text.replace("\n", "~").replace("{k}", "\x00{k}\x00").split("\x00") if part)


NEW_AS_IS = ("0 HEAD\n1 GEDC\n2 VERS 7.0\n1 CHAR UTF-8\n", "0 @I{k}@ INDI\n1 EXID {k}\n2 TYPE https://www.familysearch.org/ark\n1 UID u\n", "0 @O1@ OBJE\n1 FILE f\n2 FORM image/png\n", "0 TRLR\n")
OLD_AS_IS = ("0 HEAD\n1 GEDC\n2 VERS 5.5.1\n1 CHAR ANSEL\n", "0 @i{k}@ INDI\n1 NOTE a\n2 CONC b\n2 CONT {k}\n1 _OWN x\n", "0 @F1@ FAM\n1 HUSB @i{k}@\n", "0 @O1@ OBJE\n1 FILE f\n2 FORM JPG\n", "0 TRLR\n")
UP = ("0 HEAD\n1 GEDC\n2 VERS 7.0\n1 CHAR UTF-8\n", "0 @I{k}@ INDI\n1 NOTE ab\n2 CONT {k}\n1 _OWN x\n", "0 @F1@ FAM\n1 HUSB @I{k}@\n", "0 @O1@ OBJE\n1 FILE f\n2 FORM image/jpeg\n", "0 TRLR\n")
DOWN = ("0 HEAD\n1 GEDC\n2 VERS 5.5.1\n1 CHAR UTF-8\n", "0 @I{k}@ INDI\n1 _FSFTID {k}\n1 UID u\n", "0 @O1@ OBJE\n1 FILE f\n2 FORM PNG\n", "0 TRLR\n")
ORACLES = {
    "line_faults": f"SELECT c_custkey, CAST(level AS INT) AS level, xref, tag, value, code FROM customer JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_values([tuple('NULL' if x is None and j == 1 else x for j, x in enumerate(r)) for r in LINES]).replace(chr(39) + 'NULL' + chr(39), 'NULL')}) v(line, level, xref, tag, value, code)) ON i = c_custkey % {len(LINES)}",
    "date_grammar": f"""SELECT o_orderkey, modifier, calendar, CAST(day AS INT) AS day, CAST(month AS INT) AS month, CAST(CASE WHEN year = -1 THEN {Y} ELSE year END AS INT) AS year, bc = 1 AS is_bc, CAST(CASE WHEN dual = -1 THEN {Y} // 100 * 100 + 51 ELSE dual END AS INT) AS dual_year,
        phrase, told AS interpreted_from, CAST(ed AS INT) AS end_day, CAST(em AS INT) AS end_month, CAST(CASE ey WHEN -1 THEN {Y} WHEN -2 THEN {Y} + 1 ELSE ey END AS INT) AS end_year, good = 1 AS good
        FROM orders JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_values(DATES)}) v(text, modifier, calendar, day, month, year, bc, dual, phrase, told, ed, em, ey, good)) ON i = o_orderkey % {len(DATES)}""",
    "date_julian": """SELECT o_orderkey, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) + 13 AS as_julian, CAST(year(j) AS INT) AS year, CAST(month(j) AS INT) AS month, CAST(day(j) AS INT) AS day, CAST(year(o_orderdate) AS INT) AS g_year, CAST(month(o_orderdate) AS INT) AS g_month, CAST(day(o_orderdate) AS INT) AS g_day
        FROM (SELECT *, CAST(o_orderdate AS DATE) - 13 AS j FROM orders)""",
    "date_french": """WITH y AS (SELECT y, ((1792 + y) % 4 = 0 AND (1792 + y) % 100 <> 0) OR (1792 + y) % 400 = 0 AS leap FROM range(1, 400) r(y)),
        s AS (SELECT y, leap, 2375840 + coalesce(sum(365 + CASE WHEN leap THEN 1 ELSE 0 END) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM y)
        SELECT o_orderkey, CAST(y AS INT) AS year, CAST((n - start) // 30 + 1 AS INT) AS month, CAST((n - start) % 30 + 1 AS INT) AS day, true AS same, leap FROM (SELECT o_orderkey, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders) ASOF JOIN s ON n >= start""",
    "date_hebrew": """WITH m AS (SELECT y, (235 * y - 234) // 19 AS months FROM range(5700, 5800) r(y)), d AS (SELECT y, months * 29 + (12084 + 13753 * months) // 25920 AS day FROM m),
        e AS (SELECT y, day + CASE WHEN (3 * (day + 1)) % 7 < 3 THEN 1 ELSE 0 END AS elapsed FROM d), l AS (SELECT y, elapsed, lag(elapsed) OVER (ORDER BY y) AS before, lead(elapsed) OVER (ORDER BY y) AS after FROM e),
        s AS (SELECT y, 347998 + elapsed + CASE WHEN after - elapsed = 356 THEN 2 WHEN elapsed - before = 382 THEN 1 ELSE 0 END AS start FROM l), t AS (SELECT y, start, lead(start) OVER (ORDER BY y) - start AS days FROM s),
        u AS (SELECT *, [30, CASE WHEN days % 10 = 5 THEN 30 ELSE 29 END, CASE WHEN days % 10 = 3 THEN 29 ELSE 30 END, 29, 30, CASE WHEN days > 360 THEN 30 ELSE 29 END, CASE WHEN days > 360 THEN 29 ELSE 0 END, 30, 29, 30, 29, 30, 29] AS size FROM t),
        o AS (SELECT o_orderkey, y, days, n - start AS rest, size, CAST(len(list_filter(range(1, 14), lambda i: list_sum(size[1:i]) <= n - start)) AS INT) AS passed FROM (SELECT o_orderkey, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS n FROM orders) ASOF JOIN u ON n >= start)
        SELECT o_orderkey, CAST(y AS INT) AS year, passed + 1 AS month, CAST(rest - coalesce(list_sum(size[1:passed]), 0) + 1 AS INT) AS day, CAST(days AS BIGINT) AS days, CAST(CASE WHEN days > 360 THEN 13 ELSE 12 END AS BIGINT) AS months, true AS same FROM o""",
    "astronomical": "SELECT c_custkey, CAST(CASE WHEN c_custkey % 2 = 0 THEN 0 - c_custkey % 100 ELSE c_custkey % 100 + 1 END AS INT) AS year, CAST(CASE WHEN c_custkey % 100 <= 50 THEN 51 - c_custkey % 100 ELSE c_custkey % 100 - 50 END AS INT) AS back, c_custkey % 100 <= 50 AS is_bc FROM customer",
    "date_compare_range": f'SELECT o_orderkey, CAST(sign(diff) AS INT) AS "order", diff < 0 AS before, diff > 0 AS after, diff = 0 AS equal FROM ({PAIRS})',
    "years_between": f"""WITH p AS ({PAIRS}), q AS (SELECT *, a_m * a_d * b_m * b_d <> 0 AS exact, abs(a_y - b_y) AS apart, CASE WHEN a_y < b_y OR (a_y = b_y AND a_m * 100 + a_d <= b_m * 100 + b_d) THEN (b_m * 100 + b_d) - (a_m * 100 + a_d) ELSE (a_m * 100 + a_d) - (b_m * 100 + b_d) END AS rest FROM p),
        r AS (SELECT o_orderkey, exact, apart - CASE WHEN exact AND rest < 0 THEN 1 ELSE 0 END AS years FROM q) SELECT o_orderkey, CAST(years AS INT) AS years, exact, years < 3 AS young FROM r""",
    "date_validate": """WITH d AS (SELECT o_orderkey, o_orderkey % 35 AS d, o_orderkey % 14 AS m, 1890 + o_orderkey % 21 AS y FROM orders)
        SELECT o_orderkey, d = 0 OR m = 0 OR try_cast(y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS DATE) IS NOT NULL AS good,
        CASE WHEN d > 0 AND m > 0 THEN CAST(date_diff('day', DATE '1890-01-01', CAST(make_date(y, 1, 1) + to_months(CAST(m - 1 AS INT)) AS DATE)) + d - 1 AS INT) END AS days FROM d""",
    "entity_person": """SELECT '@I' || c_custkey || '@' AS xref, 'Given ' || c_custkey AS given, 'Sur ' || c_custkey AS surname, 'de' AS language, 'Town ' || c_custkey AS place, 'N1E2' AS at, 'Street ' || c_custkey || chr(10) || 'House' AS line1, 'City' AS city, '1,' || c_custkey AS phones,
        CAST(CASE WHEN c_custkey % 6 <= 3 THEN c_custkey % 6 ELSE 0 END AS INT) AS quality, 't' AS cited, CAST(c_custkey AS INT) AS top, true AS negative, 'job' AS detail, 'T' AS temple, 'adopted' AS pedigree, 'friend' AS role, '@N1@' AS note_xrefs, 'a' || chr(10) || c_custkey AS inline_notes, '10:00' AS time, CAST(c_custkey AS VARCHAR) AS external_id FROM customer""",
    "entity_write": f"SELECT CAST(c_custkey AS VARCHAR) AS doc_id, {PEOPLE} AS text FROM customer",
    "convert_up": _texts(ODD, *map(_sql, UP)) + " UNION ALL " + _texts(EVEN, *map(_sql, NEW_AS_IS)),
    "convert_down": _texts(EVEN, *map(_sql, DOWN)) + " UNION ALL " + _texts(ODD, *map(_sql, OLD_AS_IS)),
    "convert_report": f"""WITH e AS ({EVEN}) SELECT kind, original, result, CAST(count(*) AS BIGINT) AS n FROM e, (VALUES ('transformation', '7.0', '5.5.1'), ('transformation', '', ''), ('transformation', '', ''), ('normalized', 'EXID', '_FSFTID'), ('approximated', 'image/png', 'PNG'), ('data_loss', '', ''), ('dropped', 'UID', '')) v(kind, original, result) GROUP BY ALL
        UNION ALL SELECT 'validation', '', '', CAST(count(*) AS BIGINT) FROM e HAVING count(*) > 0""",
    "version_detect": "SELECT CAST(c_custkey AS VARCHAR) AS doc_id, ['5.5', '7.0', '5.5', '5.5', '7.0', '5.5.1'][c_custkey % 6 + 1] AS version, CASE WHEN c_custkey % 6 = 4 THEN '7.0' ELSE '5.5.1' END AS minimum FROM customer",
    "remap": "SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, '0 @I' || (s_suppkey + 1) || '@ INDI' || chr(10) || '1 ALIA @I' || (s_suppkey + 2) || '@' || chr(10) || '1 NOTE see @I' || s_suppkey || '@' || chr(10) AS text FROM supplier",
    "string_scalars": """SELECT c_custkey, 'Lee ' || c_custkey AS surname, 'Ann ' || c_custkey AS given, 'Ann ' || c_custkey || ' Lee ' || c_custkey AS shown, '@I' || c_custkey || '@' AS unnamed, c_custkey % 2 = 0 AS pointer, '@@I' || c_custkey || '@' AS escaped, '@I' || c_custkey || '@' AS unescaped,
        'MediaObject @I' || c_custkey || '@ > FILE' AS path, c_custkey % 4 < 2 AS ark, CASE c_custkey % 4 WHEN 0 THEN '7' WHEN 1 THEN '8' END AS database, 'https://www.familysearch.org/tree/person/details/' || c_custkey AS url FROM customer""",
    "stream_orphans": "SELECT 'ORPHANED_' || event_type AS code, count(*) AS n FROM events WHERE event_id * 3 NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0) GROUP BY event_type",
    "completeness_issues": """SELECT '[INFO] ' || code || ': ' || said || ' (@I' || c_custkey || '@)' AS text FROM customer, (VALUES ('MISSING_BIRTH_DATE', 'individual has no birth date recorded', 3), ('NO_SOURCES', 'individual has no source citations', 2), ('MISSING_NAME', 'individual has no name recorded', 5)) v(code, said, m) WHERE c_custkey % m = 0""",
    "header_rules": """WITH h AS (SELECT c_custkey AS k, ['5.5', '5.5.1', '7.0'][c_custkey % 3 + 1] AS v, ['ANSEL', 'UTF-8', 'UNICODE', '', 'UTF-16'][c_custkey % 5 + 1] AS e FROM customer), f AS (
        SELECT k, 'WARNING' AS severity, 'MISSING_SUBM' AS code FROM h WHERE v <> '7.0' AND k % 2 = 1 UNION ALL SELECT k, 'ERROR', 'INVALID_ENCODING_FOR_VERSION' FROM h WHERE v = '7.0' AND e IN ('ANSEL', 'UTF-16')
        UNION ALL SELECT k, 'WARNING', 'XREF_TOO_LONG' FROM h WHERE v <> '7.0' AND k % 40 > 20 UNION ALL SELECT k, 'ERROR', 'BANNED_CONTROL_CHARACTER' FROM h WHERE v = '7.0' AND k % 4 = 0) SELECT CAST(k AS VARCHAR) AS doc_id, severity, code FROM f""",
    "typed_references": """WITH e AS (SELECT l_partkey AS k, ['CHIL', 'FAMC', 'SOUR', 'HUSB'][l_linenumber % 4 + 1] AS r FROM lineitem), d AS (SELECT p_partkey AS k, ['INDI', 'FAM', 'SOUR'][p_partkey % 3 + 1] AS t FROM part)
        SELECT 'ORPHANED_' || r AS code, count(*) AS n FROM e WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.k = e.k AND d.t = CASE r WHEN 'FAMC' THEN 'FAM' WHEN 'SOUR' THEN 'SOUR' ELSE 'INDI' END) GROUP BY r""",
}


def queries() -> dict[str, Query]:
    found = (
        line_faults, date_grammar, date_julian, date_french, date_hebrew, astronomical, date_compare_range, years_between, date_validate, entity_person, entity_write, convert_up, convert_down, convert_report, version_detect, remap,
        string_scalars, stream_orphans, completeness_issues, header_rules, typed_references,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
