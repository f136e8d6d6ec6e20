"""The line grammar: a physical line to level, identifier, tag and value, and back (SRC-14, SRC-17, SRC-18, SRC-40, SINK-04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .calendars import let

MAX_LEVEL = 99


def _value(rest: Column) -> Column:
    """What follows a tag: one space goes, and a rest of spaces only is empty."""
    return F.when(F.trim(rest) == "", "").otherwise(F.regexp_replace(rest, "^ ", ""))


def _row(level: Column, xref: Column, tag: Column, value: Column, code: Column, message: Column) -> Column:
    return F.struct(level.alias("level"), xref.alias("xref"), tag.alias("tag"), value.alias("value"), code.alias("code"), message.alias("message"))


def parse_line(line: Column) -> Column:
    """struct (level, xref, tag, value, code, message) of a line; `code` is null for a well-formed one.

    Leading white space is accepted. An identifier with a space inside or without its closing sign is recovered: such rows have
    a code and a tag. Rows without a tag hold no line. Levels run from 0 to 99.
    """
    none, empty = F.lit(None).cast("string"), F.lit("")

    def tokens(l: Column) -> Column:
        return F.struct(
            l.alias("l"), F.regexp_extract(l, r"(?s)^\s*(\S+)", 1).alias("f0"), F.regexp_extract(l, r"(?s)^\s*\S+\s+(\S+)", 1).alias("f1"), F.regexp_extract(l, r"(?s)^\s*\S+\s+\S+(.*)$", 1).alias("r1"),
            F.regexp_extract(l, r"(?s)^\s*\S+\s+(@[^@]* [^@]*@)(?=$|[ \t])", 1).alias("sx"), F.regexp_extract(l, r"(?s)^\s*\S+\s+@[^@]* [^@]*@(?=$|[ \t])(.*)$", 1).alias("sr"),
            F.when(F.regexp_extract(l, r"(?s)^\s*(\S+)", 1).rlike("^[+-]?[0-9]+$"), F.regexp_extract(l, r"(?s)^\s*(\S+)", 1).try_cast("int")).alias("n"),
            (F.length(l) - F.length(F.replace(l, F.lit("@"), F.lit("")))).alias("signs"),
        )

    def branch(x: Column) -> Column:
        at = F.startswith(x["f1"], F.lit("@"))
        kind = F.when(at & F.endswith(x["f1"], F.lit("@")), "X").when(at & (x["sx"] != ""), "S").when(at & (x["n"] == 0) & (x["signs"] == 1), "U").otherwise("N")
        return F.struct(*(x[k].alias(k) for k in ("l", "f0", "f1", "n")), x["r1"].alias("r1"), F.when(kind == "S", x["sr"]).otherwise(x["r1"]).alias("r"), F.when(kind == "S", x["sx"]).otherwise(x["f1"]).alias("x"), kind.alias("k"))

    def result(x: Column) -> Column:
        k, level = x["k"], x["n"]
        t2, r2 = F.regexp_extract(x["r"], r"(?s)^\s*(\S+)", 1), F.regexp_extract(x["r"], r"(?s)^\s*\S+(.*)$", 1)
        no_line = lambda code, message: _row(F.lit(None).cast("int"), empty, none, empty, F.lit(code), F.lit(message))
        plain = lambda code, message: _row(level, empty, x["f1"], _value(x["r1"]), code, message)
        with_xref = lambda code, message: _row(level, x["x"], t2, _value(r2), code, message)
        bad = F.lit("INVALID_XREF")
        return (
            F.when(F.trim(F.regexp_replace(x["l"], r"\s", " ")) == "", no_line("EMPTY_LINE", "empty line"))
            .when(x["f1"] == "", no_line("SYNTAX_ERROR", "line must have at least level and tag"))
            .when(level.isNull(), no_line("INVALID_LEVEL", "invalid level number"))
            .when(level < 0, no_line("INVALID_LEVEL", "level cannot be negative"))
            .when(level > MAX_LEVEL, no_line("INVALID_LEVEL", "level exceeds maximum nesting depth"))
            .when((k == "X") & (t2 == ""), no_line("INVALID_XREF", "line with xref must have a tag"))
            .when(k == "X", with_xref(none, none))
            .when((k == "S") & (t2 == ""), no_line("INVALID_XREF", "line with xref must have a tag"))
            .when(k == "S", with_xref(bad, F.lit("xref contains a space")))
            .when((k == "U") & ((t2 == "") | t2.isin("HEAD", "TRLR")), plain(bad, F.lit("xref is not terminated")))
            .when(k == "U", with_xref(bad, F.lit("xref is not terminated")))
            .otherwise(plain(none, none))
        )

    bare = F.regexp_replace(line, r"[\r\n]+$", "")
    return F.when(line.isNotNull(), let(let(let(bare, tokens), branch), result))


def classify(message: Column) -> Column:
    """SRC-40: the code that an error's message stands for."""
    low = F.lower(message)
    has = lambda word: F.contains(low, F.lit(word))
    return F.when(has("empty line"), "EMPTY_LINE").when(has("level") & ~has("at least level"), "INVALID_LEVEL").when(has("xref"), "INVALID_XREF").otherwise("SYNTAX_ERROR")


def render_line(level: Column, xref: Column, tag: Column, value: Column) -> Column:
    """SINK-04: the line, without its ending; a value with line breaks needs continuation lines first."""
    return F.concat_ws(" ", level.cast("string"), F.nullif(xref, F.lit("")), tag, F.nullif(value, F.lit("")))
