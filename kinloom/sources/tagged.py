"""Tagged-line files as DataFrames: files to records to lines, headers, versions, indexes (SRC-01 to SRC-07, SRC-13 to SRC-39).

A file arrives whole as one row, is decoded natively and cut into records by one regular expression, so records spread over the
cluster before any line is lexed. The running line and byte counts need the records of one file in order: one shuffle, in
which a file, at most 2 GB as such a row, is one partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinloom.functions import charset, lines
from kinloom.functions.calendars import let

#: Between a line's ending and a line whose level is 0.
RECORD_START = r"(?<=\n|\r(?!\n))(?=[ \t]*[+-]?0+[ \t])"
TAG_TYPE = "struct<line_number:bigint,level:int,xref:string,tag:string,value:string,code:string,message:string>"
# Tags that only the named version has, and the versions a header may state.
TAGS_70 = ("EXID", "PHRASE", "SCHMA", "SNOTE", "UID", "CREA", "MIME")
TAGS_551 = ("MAP", "LATI", "LONG", "EMAIL", "WWW", "FACT")
VERSIONS = ("5.5", "5.5.1", "7.0", "7.0.0")


def read_texts(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-04 to SRC-07: (doc_id, text, encoding) of every file under `path`; text is null where the bytes are not valid."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = files.select(F.col("path").alias("doc_id"), "content", charset.encoding(F.col("content")).alias("encoding"))
    return named.select("doc_id", charset.decode(F.col("content"), F.col("encoding")).alias("text"), "encoding")


def text_faults(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SRC-11: (doc_id, line, severity, code, message) of the files under `path` that are not valid in their encoding, which have no records."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    named = files.select(F.col("path").alias("doc_id"), "content", charset.encoding(F.col("content")).alias("encoding"))
    bad = named.where(charset.decode(F.col("content"), F.col("encoding")).isNull()).select("doc_id", "encoding", charset.invalid_position(F.col("content")).alias("at"))
    said = F.when((F.col("encoding") == "UTF-8") & F.col("at").isNotNull(), F.format_string("invalid UTF-8 at column %d", F.col("at.column"))).otherwise(F.concat(F.lit("invalid "), "encoding"))
    line = F.when(F.col("encoding") == "UTF-8", F.col("at.line").cast("long"))
    return bad.select("doc_id", line.alias("line"), F.lit("ERROR").alias("severity"), F.lit("INVALID_ENCODING").alias("code"), said.alias("message"))


def records_of(texts: DataFrame) -> DataFrame:
    """SRC-13 to SRC-20, WIN-01, WIN-03: one row for each record of (doc_id, text).

    (doc_id, rec_no, xref, type, value, line_number, byte_offset, byte_length, tags): `tags` are its lines as TAG_TYPE, the level-0
    line first; lines with a `code` are kept and empty ones are left out. Offsets count the bytes of the text as UTF-8,
    line endings included. What stands before the first level-0 line is record 0 without a type; null texts have no records.
    """
    pieces = texts.select("doc_id", F.posexplode(F.split("text", RECORD_START)).alias("rec_no", "body")).where("body != ''")
    cut = pieces.withColumn("parts", F.split(F.regexp_replace("body", "(\r\n|\r|\n)$", ""), "\r\n|\r|\n", -1))
    sized = cut.select("doc_id", "rec_no", "parts", F.size("parts").alias("n_lines"), F.octet_length("body").cast("long").alias("byte_length"), F.col("body").rlike(r"\S").alias("filled"))
    before = Window.partitionBy("doc_id").orderBy("rec_no").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"first": F.coalesce(F.sum("n_lines").over(before), F.lit(0)), "byte_offset": F.coalesce(F.sum("byte_length").over(before), F.lit(0))}
    placed = sized.withColumns(sums).where("filled")

    def lexed(part: Column, at: Column) -> Column:
        return let(lines.parse_line(part), lambda p: F.struct((F.col("first") + at + 1).alias("line_number"), *(p[k].alias(k) for k in ("level", "xref", "tag", "value", "code", "message"))))

    tags = placed.withColumn("tags", F.filter(F.transform("parts", lexed), lambda t: F.coalesce(t["code"] != "EMPTY_LINE", F.lit(True))))
    top = F.get("tags", F.lit(0))
    is_record = F.coalesce(top["level"] == 0, F.lit(False))
    own = lambda field, default: F.when(is_record, top[field]).otherwise(default)
    return tags.select(
        "doc_id", "rec_no", own("xref", "").alias("xref"), own("tag", "").alias("type"), own("value", "").alias("value"), top["line_number"].alias("line_number"), "byte_offset", "byte_length", "tags"
    )


def lines_of(records: DataFrame) -> DataFrame:
    """SRC-15, SRC-16: one row for each line that could be kept, (doc_id, rec_no, line_number, level, xref, tag, value, code)."""
    flat = records.select("doc_id", "rec_no", F.explode("tags").alias("t"))
    return flat.where("t.tag IS NOT NULL").select("doc_id", "rec_no", "t.line_number", "t.level", "t.xref", "t.tag", "t.value", "t.code")


def diagnostics_of(records: DataFrame) -> DataFrame:
    """SRC-03, SRC-16, FLT-13: (doc_id, line, severity, code, message) of every line with a fault and every clamped level."""
    flat = records.select("doc_id", F.explode("tags").alias("t")).where("t.code IS NOT NULL")
    faults = flat.select("doc_id", F.col("t.line_number").alias("line"), F.lit("ERROR").alias("severity"), "t.code", "t.message")
    at = records.select("doc_id", F.explode(level_jumps(F.filter("tags", lambda t: t["level"].isNotNull()))).alias("line"))
    jumps = at.select("doc_id", "line", F.lit("WARNING").alias("severity"), F.lit("BAD_LEVEL_JUMP").alias("code"), F.lit("level jumps by more than one").alias("message"))
    return faults.unionByName(jumps)


def first_faults(diagnostics: DataFrame, most: int = 0) -> DataFrame:
    """SRC-16: at most `most` errors of each document in order of their lines, all for 0 or less; warnings stay."""
    if most <= 0:
        return diagnostics
    order = Window.partitionBy("doc_id", "severity").orderBy("line", "code")
    return diagnostics.withColumn("__n", F.row_number().over(order)).where((F.col("severity") != "ERROR") | (F.col("__n") <= most)).drop("__n")


def strict(records: DataFrame) -> DataFrame:
    """SRC-01, SRC-15: the records, with an error as soon as a line of theirs is faulty."""
    fault = F.get(F.filter("tags", lambda t: t["code"].isNotNull()), F.lit(0))
    said = F.concat(F.lit("line "), fault["line_number"].cast("string"), F.lit(": "), fault["message"])
    return records.withColumn("tags", F.when(fault.isNotNull(), F.raise_error(said).cast(records.schema["tags"].dataType)).otherwise(F.col("tags")))


def clamp_levels(levels: Column) -> Column:
    """SRC-39: levels, each at most one more than the clamped level before it; the first is compared with 0."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all"))

    def step(state: Column, level: Column) -> Column:
        return let(F.least(level, state["last"] + 1), lambda new: F.struct(new.alias("last"), F.concat(state["all"], F.array(new)).alias("all")))

    return F.aggregate(levels, start, step, lambda state: state["all"])


def level_jumps(tags: Column) -> Column:
    """SRC-39: the numbers of the lines whose level is clamped."""
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<bigint>").alias("at"))

    def step(state: Column, t: Column) -> Column:
        jump = t["level"] > state["last"] + 1
        return F.struct(F.least(t["level"], state["last"] + 1).alias("last"), F.when(jump, F.concat(state["at"], F.array(t["line_number"].cast("long")))).otherwise(state["at"]).alias("at"))

    return F.aggregate(tags, start, step, lambda state: state["at"])


def detect_version(records: DataFrame) -> DataFrame:
    """SRC-33: (doc_id, version): what HEAD's GEDC.VERS states if it is known, else by the tags that are used."""
    flat = lines_of(records)
    after_gedc = F.filter("tags", lambda t: ((t["level"] == 2) & (t["tag"] == "VERS")) | (t["level"] == 1))
    stated = F.filter(F.transform(after_gedc, lambda t, i: F.struct(t["level"].alias("l"), t["value"].alias("v"), F.get(after_gedc, i - 1)["tag"].alias("p"))), lambda t: (t["l"] == 2) & (t["p"] == "GEDC"))
    head = records.where("type = 'HEAD'").select("doc_id", F.trim(F.get(stated, F.lit(0))["v"]).alias("v")).groupBy("doc_id").agg(F.min(F.when(F.col("v").isin(*VERSIONS), F.col("v"))).alias("stated"))
    used = flat.groupBy("doc_id").agg(F.bool_or(F.col("tag").isin(*TAGS_70)).alias("is_70"), F.bool_or(F.col("tag").isin(*TAGS_551)).alias("is_551"))
    guess = F.when(F.col("is_70"), "7.0").when(F.col("is_551"), "5.5.1").otherwise("5.5")
    return used.join(head, "doc_id", "left").select("doc_id", F.coalesce(F.when(F.col("stated") == "7.0.0", "7.0").otherwise(F.col("stated")), guess).alias("version"))


def header(records: DataFrame) -> DataFrame:
    """SRC-36: (doc_id, encoding, language, copyright, source_system, tree_id, submitter, schema); the last value of each wins, absent: ''."""
    tags = F.col("tags")
    last = lambda name, level=None: F.coalesce(F.try_element_at(F.filter(tags, lambda t: (t["tag"] == name) & (F.lit(True) if level is None else t["level"] == level)), F.lit(-1))["value"], F.lit(""))
    return records.where("type = 'HEAD'").select(
        "doc_id", F.trim(last("CHAR")).alias("encoding"), last("LANG").alias("language"), last("COPR").alias("copyright"), last("SOUR", 1).alias("source_system"), last("_TREE", 2).alias("tree_id"), F.trim(last("SUBM", 1)).alias("submitter"), schema_of(tags).alias("schema")
    )


def schema_of(tags: Column) -> Column:
    """SRC-37: map of the TAG lines under SCHMA, name to URI; lines without a URI are left out, the last of equal names wins."""
    pairs = F.transform(F.filter(tags, lambda t: (t["tag"] == "TAG") & F.contains(t["value"], F.lit(" "))), lambda t: F.split(t["value"], " ", 2))
    return F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != F.get(p, F.lit(0))), F.create_map(F.get(p, F.lit(0)), F.get(p, F.lit(1)))))


def build_index(records: DataFrame) -> DataFrame:
    """SRC-23, SRC-26, SRC-27, WIN-04: (doc_id, key, by_type, type, byte_offset, byte_length): records by identifier, those
    without one by type; the last of equal keys wins."""
    keyed = records.where("type != ''").withColumn("by_type", F.col("xref") == "").withColumn("key", F.when(F.col("xref") == "", F.col("type")).otherwise(F.col("xref")))
    last = F.max_by(F.struct("type", "byte_offset", "byte_length"), "line_number").alias("r")
    return keyed.groupBy("doc_id", "key", "by_type").agg(last).select("doc_id", "key", "by_type", "r.*")


INDEX_VERSION = 1


def save_index(index: DataFrame, path: str) -> None:
    """SRC-28: writes an index, sorted by key so that lookups read few row groups, and the version of its form."""
    index.repartitionByRange("key").sortWithinPartitions("key", "doc_id").write.mode("overwrite").parquet(f"{path}/index")
    index.sparkSession.range(1).select(F.lit(INDEX_VERSION).alias("version")).write.mode("overwrite").parquet(f"{path}/version")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    """SRC-28: an index that `save_index` wrote; an error if its form has another version."""
    found = spark.read.parquet(f"{path}/version").first()
    if found is None or found.version != INDEX_VERSION:
        raise ValueError(f"index version {found and found.version}, not {INDEX_VERSION}")
    return spark.read.parquet(f"{path}/index")


def from_offset(records: DataFrame, offset: int) -> DataFrame:
    """SRC-31: the records that begin at or behind a byte offset of their document."""
    return records.where(F.col("byte_offset") >= offset)


def record_count(index: DataFrame) -> DataFrame:
    """SRC-32: (doc_id, n): the entries of an index by document."""
    return index.groupBy("doc_id").agg(F.count("*").alias("n"))


def version_before(a: Column, b: Column) -> Column:
    """SRC-34: whether a version is earlier than another one; false if either is unknown."""
    known = F.array(*map(F.lit, ("5.5", "5.5.1", "7.0")))
    x, y = F.array_position(known, a), F.array_position(known, b)
    return F.coalesce((x > 0) & (y > 0) & (x < y), F.lit(False))


def read_record(spark: SparkSession, index: DataFrame, key: str, by_type: bool = False) -> DataFrame:
    """SRC-24, SRC-25, SRC-29, SRC-30: the records that an index has under `key`, cut from UTF-8 files at their offsets.

    Only files with the key are read, all of them; their names pass through the driver, which Spark's list of files needs anyway.
    """
    hits = index.where((F.col("key") == key) & (F.col("by_type") == by_type))
    files = [row.doc_id for row in hits.select("doc_id").distinct().toLocalIterator()]
    if not files:
        return records_of(spark.createDataFrame([], "doc_id string, text string"))
    content = spark.read.format("binaryFile").load(files).select(F.col("path").alias("doc_id"), "content")
    mark = F.when(F.hex(F.substring("content", 1, 3)) == "EFBBBF", 3).otherwise(0)
    cut = F.substring(F.col("content"), (F.col("byte_offset") + 1 + mark).cast("int"), F.col("byte_length").cast("int")).cast("string")
    return records_of(content.join(hits, "doc_id").select("doc_id", cut.alias("text")))
