"""The engine's own queries over the driver tables, each with its DuckDB equivalent where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import calendars, dates, lines, strings
from kinloom.operators import coverage, relations
from kinloom.plans import family, grammar

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def line_lex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-14, SINK-04: customers rendered as lines and read back."""
    rendered = lines.render_line(F.lit(0), F.concat(F.lit("@I"), F.col("c_custkey"), F.lit("@")), F.lit("INDI"), F.col("c_name"))
    parsed = table(spark, sf_dir, "customer").select("c_custkey", lines.parse_line(rendered).alias("p"))
    return parsed.select("c_custkey", "p.level", "p.xref", "p.tag", "p.value", "p.code")


def date_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-01, DATE-16: order dates as text with and without a modifier."""
    text = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "ABT ").otherwise(""), F.upper(F.date_format("o_orderdate", "d MMM yyyy")))
    parsed = table(spark, sf_dir, "orders").select("o_orderkey", dates.parse_date(text).alias("d"))
    return parsed.select("o_orderkey", "d.day", "d.month", "d.year", "d.modifier", dates.to_jdn(F.col("d")).cast("long").alias("jdn"))


def date_jdn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DATE-19, DATE-20: day numbers of order dates, and back."""
    day = F.col("o_orderdate")
    numbered = table(spark, sf_dir, "orders").select("o_orderkey", calendars.gregorian_to_jdn(F.year(day), F.month(day), F.dayofmonth(day)).alias("jdn"))
    back = calendars.jdn_to_gregorian(F.col("jdn"))
    return numbered.withColumn("back", back).select("o_orderkey", F.col("jdn").cast("long").alias("jdn"), "back.year", "back.month", "back.day")


def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: the first word of each text."""
    word = F.split_part(F.col("text"), F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "documents").select("doc_id", strings.normalize_name(word).alias("name"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: the two words of part names."""
    words = table(spark, sf_dir, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("a"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("b"))
    return words.select("p_partkey", F.round(strings.similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


def orphans_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-10: line items whose part is not among the declared ones."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size <= 25")
    return relations.orphans(items, parts, "l_partkey", "p_partkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def reference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-05: references of line items to declared parts, by ship flag."""
    items, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_size <= 25")
    return relations.reference_report(items, parts, "l_returnflag", "l_partkey", "p_partkey")


def shared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-14: identifiers of customers that suppliers have too."""
    return relations.shared_keys(table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier"), "c_custkey", "s_suppkey")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-01: how many documents of each source have labels and a language."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return coverage.coverage(rows, "source", ["lang", "quality", "toxic"])


def issue_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SORT-02: the most frequent event types."""
    return coverage.top_codes(table(spark, sf_dir, "events"), "event_type")


ITEMS = "lineitem l LEFT JOIN (SELECT p_partkey FROM part WHERE p_size <= 25) p ON l.l_partkey = p.p_partkey"
ORACLES = {
    "line_lex": "SELECT c_custkey, 0 AS level, '@I' || c_custkey || '@' AS xref, 'INDI' AS tag, c_name AS value, CAST(NULL AS VARCHAR) AS code FROM customer",
    "date_parse": """SELECT o_orderkey, CAST(day(o_orderdate) AS INT) AS day, CAST(month(o_orderdate) AS INT) AS month, CAST(year(o_orderdate) AS INT) AS year,
        CASE WHEN o_orderkey % 3 = 0 THEN 'ABT' ELSE '' END AS modifier, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS jdn FROM orders""",
    "date_jdn": """SELECT o_orderkey, CAST(julian(CAST(o_orderdate AS DATE)) AS BIGINT) AS jdn, CAST(year(o_orderdate) AS INT) AS year,
        CAST(month(o_orderdate) AS INT) AS month, CAST(day(o_orderdate) AS INT) AS day FROM orders""",
    "normalize_name": "SELECT doc_id, strip_accents(lower(trim(split_part(text, ' ', 1), ' ' || chr(9) || chr(10) || chr(13)))) AS name FROM documents",
    "similarity": """SELECT p_partkey, round(CASE WHEN a = b THEN 1.0 WHEN a = '' OR b = '' THEN 0.0
        ELSE 1 - levenshtein(a, b) / CAST(greatest(strlen(a), strlen(b)) AS DOUBLE) END, 6) AS similarity
        FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b FROM part)""",
    "orphans_typed": f"SELECT l_returnflag, count(*) AS n FROM {ITEMS} WHERE p_partkey IS NULL GROUP BY l_returnflag",
    "reference_report": f"""SELECT l_returnflag, CAST(count(*) AS BIGINT) AS total, CAST(count(p_partkey) AS BIGINT) AS valid,
        CAST(count(*) - count(p_partkey) AS BIGINT) AS orphaned, count(DISTINCT CASE WHEN p_partkey IS NULL THEN l_partkey END) AS unique_orphaned
        FROM {ITEMS} GROUP BY l_returnflag""",
    "shared_keys": "SELECT c_custkey AS key FROM customer INTERSECT SELECT s_suppkey FROM supplier",
    "quality_report": """SELECT source, count(*) AS total, count(nullif(lang, '')) AS with_lang, count(quality) AS with_quality, count(toxic) AS with_toxic
        FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""",
    "issue_topk": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC, event_type LIMIT 5",
}


def queries() -> dict[str, Query]:
    found = (line_lex, date_parse, date_jdn, normalize_name, similarity, orphans_typed, reference_report, shared_keys, quality_report, issue_topk)
    return {f.__name__: f for f in found} | family.queries() | grammar.queries()


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES) | family.oracle_sql() | grammar.oracle_sql()


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of line items to declared parts: how many are there, valid and orphaned."""
    return reference_report(spark, sf_dir)
