"""Partial, approximate and multi-calendar dates as native columns (DATE-01 to DATE-18, DATE-35 to DATE-37).

A date is a struct: day, month and year (0: unknown), modifier, calendar, BC flag, second year of a dual year, phrase, and for ranges
and periods the end. Nothing is cut down to a timestamp; `jdn` orders across calendars.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import calendars as cal
from .calendars import div, let

GREGORIAN, JULIAN, HEBREW, FRENCH = "GREGORIAN", "JULIAN", "HEBREW", "FRENCH R"
# The month codes of the interchange format, in order.
MONTHS = {
    GREGORIAN: ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"),
    HEBREW: ("TSH", "CSH", "KSL", "TVT", "SHV", "ADR", "ADS", "NSN", "IYR", "SVN", "TMZ", "AAV", "ELL"),
    FRENCH: ("VEND", "BRUM", "FRIM", "NIVO", "PLUV", "VENT", "GERM", "FLOR", "PRAI", "MESS", "THER", "FRUC", "COMP"),
}
MONTHS[JULIAN] = MONTHS[GREGORIAN]
SIMPLE_MODIFIERS = ("ABT", "CAL", "EST", "BEF", "AFT")
ESCAPE = r"^@#D(?i:(GREGORIAN|JULIAN|HEBREW|FRENCH R))@ ?"
BC = r"^(?i:BC|B\.C\.|BCE|B\.C\.E\.)$"
END_TYPE = "struct<day:int,month:int,year:int,calendar:string,is_bc:boolean,dual_year:int>"
BODY_TYPE = "struct<day:int,month:int,year:int,calendar:string,is_bc:boolean,dual_year:int,error:string>"


def _squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def _month(token: Column, calendar: Column) -> Column:
    """The month's number in a calendar, null for other words."""
    found = F.lit(None).cast("int")
    for name, codes in MONTHS.items():
        number = F.array_position(F.array(*map(F.lit, codes)), F.upper(token)).cast("int")
        found = F.when(calendar == name, F.nullif(number, F.lit(0))).otherwise(found)
    return found


def year_with_dual(token: Column) -> Column:
    """DATE-09: struct (year, dual_year); a short second year is put into the first one's century, without a carry."""
    first = F.regexp_extract(token, r"^([+-]?\d+)(?:/\d+)?$", 1).try_cast("int")
    second = F.regexp_extract(token, r"^[+-]?\d+/(\d+)$", 1)
    n = second.try_cast("int")
    dual = F.when(second == "", 0).when(F.length(second) <= 2, div(first, 100) * 100 + n).otherwise(n)
    return F.struct(first.alias("year"), dual.cast("int").alias("dual_year"))


def parse_body(text: Column, default_calendar: Column) -> Column:
    """`[escape] [[day] month] year [BC]` as BODY_TYPE; `error` tells what is wrong, and then the numbers are 0."""

    def fields(x: Column) -> Column:
        tokens = F.when(F.size(x["t"]) > 1, F.when(F.element_at(x["t"], -1).rlike(BC), F.slice(x["t"], F.lit(1), F.size(x["t"]) - 1)).otherwise(x["t"])).otherwise(x["t"])
        return F.struct(x["c"].alias("c"), tokens.alias("t"), (F.size(tokens) < F.size(x["t"])).alias("bc"))

    def numbers(x: Column) -> Column:
        n = F.size(x["t"])
        year = year_with_dual(F.try_element_at(x["t"], n))
        month = F.when(n >= 2, _month(F.try_element_at(x["t"], F.greatest(n - 1, F.lit(1))), x["c"])).otherwise(0)
        day = F.when(n == 3, F.regexp_extract(F.element_at(x["t"], 1), r"^([+-]?\d+)$", 1).try_cast("int")).otherwise(0)
        return let(F.struct(year.alias("y"), month.alias("m"), day.alias("d"), n.alias("n"), x["c"].alias("c"), x["bc"].alias("bc")), result)

    def result(x: Column) -> Column:
        error = F.when(x["n"] > 3, "too many components").when(x["y"]["year"].isNull(), "invalid year").when(x["m"].isNull(), "invalid month").when(x["d"].isNull(), "invalid day")
        good = error.isNull()
        number = lambda c: F.when(good, c).otherwise(0).cast("int")
        return F.struct(number(x["d"]).alias("day"), number(x["m"]).alias("month"), number(x["y"]["year"]).alias("year"), x["c"].alias("calendar"), x["bc"].alias("is_bc"), number(x["y"]["dual_year"]).alias("dual_year"), error.alias("error"))

    own = F.upper(F.regexp_extract(text, ESCAPE, 1))
    start = F.struct(F.when(own != "", own).otherwise(default_calendar).alias("c"), F.split(F.trim(F.regexp_replace(text, ESCAPE, "")), " ").alias("t"))
    return let(let(start, fields), numbers)


def parse_date(text: Column) -> Column:
    """DATE-01: a date value as a struct; `error` is null for a good one.

    A value in parentheses is a phrase. ABT, CAL, EST, BEF and AFT precede one date, BET ... AND ... a range, FROM ... [TO ...]
    and TO ... a period, INT a date and a phrase. A leading calendar escape holds for both ends unless the second has its own.
    """

    def forms(s: Column) -> Column:
        leading = F.upper(F.regexp_extract(s, ESCAPE, 1))
        return F.struct(s.alias("s"), F.when(leading != "", leading).otherwise(GREGORIAN).alias("c"), F.trim(F.regexp_replace(s, ESCAPE, "")).alias("r"))

    def parts(x: Column) -> Column:
        r = x["r"]
        word = F.upper(F.regexp_extract(r, r"^(\S+)", 1))
        rest = F.trim(F.regexp_replace(r, r"^\S+ ?", ""))
        phrase = x["s"].rlike(r"^\(.*\)$")
        between = r"(?i)^(.*?) AND (.*)$"
        period = r"(?i)^(.*?) TO (.*)$"
        modifier = (
            F.when(phrase, "").when(word.isin(*SIMPLE_MODIFIERS, "INT", "TO"), word).when(word == "BET", "BET")
            .when((word == "FROM") & rest.rlike(period), "FROM TO").when(word == "FROM", "FROM").otherwise("")
        )
        first = (
            F.when(modifier == "", r).when(modifier == "BET", F.regexp_extract(rest, between, 1)).when(modifier == "FROM TO", F.regexp_extract(rest, period, 1))
            .when(modifier == "INT", F.trim(F.regexp_replace(rest, r"\(.*$", ""))).otherwise(rest)
        )
        second = F.when(modifier == "BET", F.regexp_extract(rest, between, 2)).when(modifier == "FROM TO", F.regexp_extract(rest, period, 2))
        interpreted = F.when(modifier == "INT", F.coalesce(F.nullif(F.regexp_extract(rest, r"\((.*)\)", 1), F.lit("")), F.regexp_extract(rest, r"\(([^)]*)$", 1))).otherwise("")
        return F.struct(x["s"].alias("s"), x["c"].alias("c"), modifier.alias("m"), phrase.alias("p"), first.alias("a"), second.alias("b"), interpreted.alias("i"))

    def bodies(x: Column) -> Column:
        a = F.when(~x["p"], parse_body(x["a"], x["c"]))
        b = F.when(x["b"].isNotNull(), parse_body(x["b"], let(a, lambda y: F.coalesce(y["calendar"], x["c"]))))
        return let(F.struct(x["s"].alias("s"), x["m"].alias("m"), x["p"].alias("p"), x["i"].alias("i"), x["c"].alias("c"), a.alias("a"), b.alias("b")), result)

    def result(x: Column) -> Column:
        a, b = x["a"], x["b"]
        error = F.when(x["s"] == "", "empty date").when(x["p"], None).when((x["m"] == "BET") & (F.coalesce(b["error"], F.lit("")) == "invalid year") & (x["s"].rlike("(?i) AND ") == F.lit(False)), "range without AND").otherwise(F.coalesce(a["error"], b["error"]))
        number = lambda c: F.coalesce(c, F.lit(0))
        end = F.when(b.isNotNull(), F.struct(*(b[k].alias(k) for k in ("day", "month", "year", "calendar", "is_bc", "dual_year"))))
        inner = F.when(x["p"], F.substring(x["s"], 2, 1_000_000_000)).otherwise("")
        return F.struct(
            x["s"].alias("original"), number(a["day"]).alias("day"), number(a["month"]).alias("month"), number(a["year"]).alias("year"), x["m"].alias("modifier"), F.coalesce(a["calendar"], x["c"]).alias("calendar"),
            F.coalesce(a["is_bc"], F.lit(False)).alias("is_bc"), number(a["dual_year"]).alias("dual_year"), F.regexp_replace(inner, r"\)$", "").alias("phrase"), x["p"].alias("is_phrase"),
            (x["m"] == "INT").alias("is_interpreted"), x["i"].alias("interpreted_from"), end.alias("end_date"), error.alias("error"),
        )

    parsed = let(let(let(_squeezed(text), forms), parts), bodies)
    return F.when(text.isNotNull(), parsed)


def to_jdn(d: Column, hebrew_rule: str = "standard") -> Column:
    """DATE-16: the day number, unknown month and day as 1; null for year 0. BC counts in the Gregorian and Julian calendar."""
    month, day = F.when(d["month"] == 0, 1).otherwise(d["month"]), F.when(d["day"] == 0, 1).otherwise(d["day"])
    year = cal.astronomical_year(d["year"], d["is_bc"])
    number = F.when(d["calendar"] == JULIAN, cal.julian_to_jdn(year, month, day)).when(d["calendar"] == HEBREW, cal.hebrew_to_jdn(d["year"], month, day, hebrew_rule)).when(d["calendar"] == FRENCH, cal.french_to_jdn(d["year"], month, day)).otherwise(cal.gregorian_to_jdn(year, month, day))
    return F.when(d["year"] != 0, number)


def compare(a: Column, b: Column) -> Column:
    """DATE-10: -1, 0 or 1; null is least. Dates of two calendars compare by day number if both have a year."""
    sign = lambda x, y: F.when(x < y, -1).when(x > y, 1).otherwise(0)
    one = lambda c: F.when(c == 0, 1).otherwise(c)
    years = F.when(a["is_bc"] != b["is_bc"], F.when(a["is_bc"], -1).otherwise(1)).when(a["is_bc"], sign(b["year"], a["year"])).otherwise(sign(a["year"], b["year"]))
    same = let(years, lambda y: F.when(y != 0, y).when(one(a["month"]) != one(b["month"]), sign(one(a["month"]), one(b["month"]))).otherwise(sign(one(a["day"]), one(b["day"]))))
    across = (a["calendar"] != b["calendar"]) & (a["year"] != 0) & (b["year"] != 0)
    return F.when(a.isNull() & b.isNull(), 0).when(a.isNull(), -1).when(b.isNull(), 1).when(across, let(F.struct(to_jdn(a).alias("a"), to_jdn(b).alias("b")), lambda x: sign(x["a"], x["b"]))).otherwise(same)


def is_before(a: Column, b: Column) -> Column:
    """DATE-11: false if either is null."""
    return a.isNotNull() & b.isNotNull() & (compare(a, b) < 0)


def is_after(a: Column, b: Column) -> Column:
    """DATE-12."""
    return a.isNotNull() & b.isNotNull() & (compare(a, b) > 0)


def is_equal(a: Column, b: Column) -> Column:
    """DATE-13: two nulls are equal."""
    return compare(a, b) == 0


def validate(d: Column) -> Column:
    """DATE-14: what is wrong with a complete Gregorian date, null if nothing; partial dates and other calendars pass."""
    days = cal.gregorian_days_in_month(d["year"], d["month"])
    complete = (d["calendar"] == GREGORIAN) & (d["year"] != 0) & (d["month"] != 0) & (d["day"] != 0)
    bad_month = F.format_string("invalid month %d", d["month"])
    bad_day = F.format_string("invalid day %d: month %d has %d days", d["day"], d["month"], days)
    return F.when(complete & ~d["month"].between(1, 12), bad_month).when(complete & ~d["day"].between(1, days), bad_day)


def to_date(d: Column) -> Column:
    """DATE-15: a Spark date, of complete Gregorian dates only; days beyond a month's end go on into the next."""
    months = d["year"] * 12 + d["month"] - 1
    first = cal.gregorian_to_jdn(div(months, 12).cast("int"), (months % 12 + 1).cast("int"), F.lit(1))
    complete = (d["calendar"] == GREGORIAN) & (d["year"] != 0) & (d["month"] != 0) & (d["day"] != 0)
    return F.when(complete, F.date_from_unix_date(first + d["day"] - 1 - 2440588))


def to_gregorian(d: Column) -> Column:
    """DATE-17: struct (day, month, year, is_bc) with the precision of the date: unknown parts stay 0."""

    def convert(x: Column) -> Column:
        y = cal.from_astronomical_year(x["year"])
        return F.struct(F.when(d["day"] == 0, 0).otherwise(x["day"]).alias("day"), F.when(d["month"] == 0, 0).otherwise(x["month"]).alias("month"), y["year"].alias("year"), y["is_bc"].alias("is_bc"))

    own = F.struct(d["day"].alias("day"), d["month"].alias("month"), d["year"].alias("year"), d["is_bc"].alias("is_bc"))
    return F.when(d["calendar"] == GREGORIAN, own).when(d["year"] != 0, let(cal.jdn_to_gregorian(to_jdn(d)), convert))


def years_between(a: Column, b: Column) -> Column:
    """DATE-18: struct (years, exact); whole years to the birthday for two complete Gregorian dates, else the years'
    difference; null if a year is 0 or a date null. BC is ignored."""
    complete = (a["calendar"] == GREGORIAN) & (b["calendar"] == GREGORIAN) & (a["month"] * a["day"] * b["month"] * b["day"] != 0)
    key = lambda d: d["month"] * 100 + d["day"]
    forward = (a["year"] < b["year"]) | ((a["year"] == b["year"]) & (key(a) <= key(b)))
    early_key, late_key = F.when(forward, key(a)).otherwise(key(b)), F.when(forward, key(b)).otherwise(key(a))
    whole = F.abs(a["year"] - b["year"])
    years = F.when(complete & (late_key < early_key), whole - 1).otherwise(whole)
    return F.when((a["year"] != 0) & (b["year"] != 0), F.struct(years.cast("int").alias("years"), complete.alias("exact")))


def birth_before_death(birth: Column, death: Column) -> Column:
    """DATE-35: a message if death is before birth; null otherwise and for nulls."""
    return F.when(is_before(death, birth), F.lit("death is before birth"))


def parent_age_message(parent_birth: Column, child_birth: Column, min_age: int) -> Column:
    """DATE-36: a message if the parent is younger than `min_age`; years are absolute."""
    years = years_between(parent_birth, child_birth)["years"]
    return F.when(years < min_age, F.format_string("parent was %d years old, less than %d", years, F.lit(min_age)))


def marriage_age_message(marriage: Column, first_birth: Column, second_birth: Column, min_age: int) -> Column:
    """DATE-37: a message for the first spouse that was too young at a marriage."""

    def of(birth: Column, who: str) -> Column:
        years = years_between(birth, marriage)["years"]
        return F.when(is_before(marriage, birth), F.lit(f"marriage is before {who}'s birth")).when(years < min_age, F.format_string(f"{who} was %d years old, less than %d", years, F.lit(min_age)))

    return F.coalesce(of(first_birth, "first spouse"), of(second_birth, "second spouse"))
