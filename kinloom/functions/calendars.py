"""Calendar arithmetic as native columns: Gregorian, Julian, French Republican and Hebrew dates and day numbers.

Every division truncates toward zero (`div`), never rounds down. All arguments and results are integer columns; nulls give
null. The formulas are the published ones for Julian day numbers; leap years of the French calendar
follow the Gregorian rule on 1792 + year.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

FRENCH_EPOCH = 2375840
HEBREW_EPOCH = 347998
#: Parts of a day since its begin (1080 an hour) from which a postponement applies: noon, and the two for Tuesday and Monday.
NOON, TUESDAY_PARTS, MONDAY_PARTS = 19440, 9924, 16789


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates toward zero."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def day_parts(year: Column, month: Column, day: Column) -> Column:
    return F.struct(year.cast("int").alias("year"), month.cast("int").alias("month"), day.cast("int").alias("day"))


def gregorian_to_jdn(year: Column, month: Column, day: Column) -> Column:
    """DATE-19: the Julian day number of a Gregorian date."""
    late = div(14 - month, 12)
    y, m = year + 4800 - late, month + 12 * late - 3
    return (day + div(153 * m + 2, 5) + 365 * y + div(y, 4) - div(y, 100) + div(y, 400) - 32045).cast("int")


def _from_march(e: Column, year: Callable[[Column], Column]) -> Column:
    m = div(5 * e + 2, 153)
    return day_parts(year(div(m, 10)), m + 3 - 12 * div(m, 10), e - div(153 * m + 2, 5) + 1)


def jdn_to_gregorian(jdn: Column) -> Column:
    """DATE-20: struct (year, month, day) of a day number."""

    def centuries(a: Column) -> Column:
        b = div(4 * a + 3, 146097)
        return F.struct(b.alias("b"), (a - div(146097 * b, 4)).alias("c"))

    def years(x: Column) -> Column:
        d = div(4 * x["c"] + 3, 1461)
        return _from_march(x["c"] - div(1461 * d, 4), lambda late: 100 * x["b"] + d - 4800 + late)

    return let(let(jdn + 32044, centuries), years)


def julian_to_jdn(year: Column, month: Column, day: Column) -> Column:
    """DATE-21."""
    late = div(14 - month, 12)
    y, m = year + 4800 - late, month + 12 * late - 3
    return (day + div(153 * m + 2, 5) + 365 * y + div(y, 4) - 32083).cast("int")


def jdn_to_julian(jdn: Column) -> Column:
    """DATE-22."""

    def years(c: Column) -> Column:
        d = div(4 * c + 3, 1461)
        return _from_march(c - div(1461 * d, 4), lambda late: d - 4800 + late)

    return let(jdn + 32082, years)


def is_gregorian_leap(year: Column) -> Column:
    return ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)


def gregorian_days_in_month(year: Column, month: Column) -> Column:
    return F.when(month == 2, F.when(is_gregorian_leap(year), 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)


def is_french_leap(year: Column) -> Column:
    """DATE-23."""
    return (year >= 1) & is_gregorian_leap(1792 + year)


def french_to_jdn(year: Column, month: Column, day: Column) -> Column:
    """DATE-24: the leap days before a year in closed form."""
    n = 1791 + year
    leaps = div(n, 4) - div(n, 100) + div(n, 400) - 435
    return (FRENCH_EPOCH + 365 * (year - 1) + F.when(year > 1, leaps).otherwise(0) + 30 * (month - 1) + day - 1).cast("int")


def jdn_to_french(jdn: Column) -> Column:
    """DATE-25: days before the epoch are in year 1 with a day below 1."""
    one = F.lit(1)

    def place(year: Column) -> Column:
        rest = jdn - french_to_jdn(year, one, one)
        month = F.when(rest >= 0, div(rest, 30) + 1).otherwise(1)
        return day_parts(year, month, rest - 30 * (month - 1) + 1)

    def corrected(guess: Column) -> Column:
        later, own = french_to_jdn(guess + 1, one, one), french_to_jdn(guess, one, one)
        return F.greatest(F.lit(1), F.when(jdn >= later, guess + 1).when(jdn < own, guess - 1).otherwise(guess).cast("int"))

    guess = F.greatest(F.lit(1), (div((jdn.cast("long") - FRENCH_EPOCH) * 400, 146097) + 1).cast("int"))
    return let(let(guess, corrected), place)


def is_hebrew_leap(year: Column) -> Column:
    """DATE-26."""
    return (7 * year + 1) % 19 < 7


def hebrew_months_in_year(year: Column) -> Column:
    """DATE-27."""
    return F.when(is_hebrew_leap(year), 13).otherwise(12)


def hebrew_new_year(year: Column, rule: str = "standard") -> Column:
    """DATE-28: the day number of 1 Tishrei, with the four postponements.

    `rule="compat"` tests the weekdays of the two long postponements one day earlier, which gives other new years for some
    years; it exists for comparison with tools that do so.
    """
    tuesday, monday = (2, 1) if rule == "standard" else (1, 0)
    before = year - 1
    cycle = before % 19
    months = 235 * div(before, 19) + 12 * cycle + div(7 * cycle + 1, 19)

    def molad(m: Column) -> Column:
        parts = 204 + 793 * (m % 1080)
        hours = 5 + 12 * m + 793 * div(m, 1080) + div(parts, 1080)
        return F.struct((1 + 29 * m + div(hours, 24)).alias("day"), (1080 * (hours % 24) + parts % 1080).alias("parts"))

    def postponed(x: Column) -> Column:
        day, parts = x["day"], x["parts"]
        late = (parts >= NOON) | ((day % 7 == tuesday) & (parts >= TUESDAY_PARTS) & ~is_hebrew_leap(year)) | ((day % 7 == monday) & (parts >= MONDAY_PARTS) & is_hebrew_leap(before))
        return day + F.when(late, 1).otherwise(0)

    day = let(let(let(months, molad), postponed), lambda d: d + F.when((d % 7).isin(0, 3, 5), 1).otherwise(0))
    return (HEBREW_EPOCH - 1 + day).cast("int")


def hebrew_days_in_year(year: Column, rule: str = "standard") -> Column:
    """DATE-29."""
    return hebrew_new_year(year + 1, rule) - hebrew_new_year(year, rule)


def _hebrew_month_lengths(days: Column, leap: Column) -> Column:
    """The lengths of the thirteen months; the seventh has none in common years."""
    long_second = F.when(days % 10 == 5, 30).otherwise(29)
    third = F.when(days % 10 == 3, 29).otherwise(30)
    six, seven = F.when(leap, 30).otherwise(29), F.when(leap, 29).otherwise(0)
    return F.array(F.lit(30), long_second, third, F.lit(29), F.lit(30), six, seven, *map(F.lit, (30, 29, 30, 29, 30, 29)))


def hebrew_days_in_month(year: Column, month: Column, rule: str = "standard") -> Column:
    """DATE-30: 0 for months that do not exist."""
    lengths = let(hebrew_days_in_year(year, rule), lambda d: _hebrew_month_lengths(d, is_hebrew_leap(year)))
    return F.when(month.between(1, 13), F.try_element_at(lengths, month)).otherwise(0)


def hebrew_to_jdn(year: Column, month: Column, day: Column, rule: str = "standard") -> Column:
    """DATE-31."""
    lengths = let(hebrew_days_in_year(year, rule), lambda d: _hebrew_month_lengths(d, is_hebrew_leap(year)))
    before = F.aggregate(F.slice(lengths, F.lit(1), F.greatest(F.lit(0), F.least(F.lit(13), month - 1))), F.lit(0), lambda a, x: a + x)
    return hebrew_new_year(year, rule) + before + day - 1


def jdn_to_hebrew(jdn: Column, rule: str = "standard") -> Column:
    """DATE-32: an estimate from the mean year, put right by one year either way."""
    guess = (div((jdn.cast("long") - HEBREW_EPOCH) * 98496, 35975351) + 1).cast("int")
    candidates = F.transform(F.sequence(guess - 1, guess + 1), lambda y: F.struct(y.alias("y"), hebrew_new_year(y, rule).alias("start")))
    chosen = F.element_at(F.filter(candidates, lambda c: c["start"] <= jdn), -1)

    def place(c: Column) -> Column:
        lengths = let(hebrew_days_in_year(c["y"], rule), lambda d: _hebrew_month_lengths(d, is_hebrew_leap(c["y"])))
        start = F.struct(F.lit(0).alias("month"), (jdn - c["start"]).cast("int").alias("rest"), F.lit(0).alias("seen"))

        def step(a: Column, length: Column) -> Column:
            inside = (a["month"] == 0) & (a["rest"] < length)
            return F.struct(F.when(inside, a["seen"] + 1).otherwise(a["month"]).alias("month"), F.when((a["month"] == 0) & ~inside, a["rest"] - length).otherwise(a["rest"]).alias("rest"), (a["seen"] + 1).alias("seen"))

        return let(F.aggregate(lengths, start, step), lambda a: day_parts(c["y"], a["month"], a["rest"] + 1))

    return let(chosen, place)


def astronomical_year(year: Column, is_bc: Column) -> Column:
    """DATE-33: n BC is 1 - n."""
    return F.when(is_bc, 1 - year).otherwise(year)


def from_astronomical_year(year: Column) -> Column:
    """DATE-34: struct (year, is_bc)."""
    return F.when(year <= 0, F.struct((1 - year).alias("year"), F.lit(True).alias("is_bc"))).otherwise(F.struct(year.alias("year"), F.lit(False).alias("is_bc")))
