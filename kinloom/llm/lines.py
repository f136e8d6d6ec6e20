"""Line dedup by site-relative frequency, with DataFrame operations only.

A line is boilerplate of a site if it repeats there and the share of the site's pages that have it is more than `RATIO`, by `ERRORS` standard errors
of a share of that size: one rule for sites of every size, under which few pages need a larger share than many. Pages
are counted by their text, so a page that a site holds many times counts once. Lines travel as hashes: a page is reduced to
the hashes of its lines before the first shuffle, and texts are not shuffled at all while the boilerplate is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import size_on_disk, written

RATIO = 0.05  # more than one page in twenty: a template, and not a phrase that happens to come again
ERRORS = 3
#: A site has at most (its mean number of lines on a page) / RATIO boilerplate lines, so this holds some 5,000 sites.
BROADCAST_BYTES = 16 << 20


def line_key(line: Column) -> Column:
    """A line without the spaces around it as two hashes of 64 and 32 bits."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("a"), F.hash(bare).alias("b"))


def boilerplate(docs: DataFrame, site_column: str = "source", text_column: str = "text", ratio: float = RATIO, errors: float = ERRORS) -> DataFrame:
    """(site, lines array of line keys): the boilerplate of each site that has any; blank lines never count."""
    text = F.col(text_column).cast("string")
    keys = F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), line_key))
    pages = docs.where(text.isNotNull()).select(F.col(site_column).alias("site"), F.xxhash64(text).alias("t1"), F.md5(text.cast("binary")).alias("t2"), keys.alias("keys"))
    pages = pages.groupBy("site", "t1", "t2").agg(F.any_value("keys").alias("keys"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    lines = pages.select("site", F.explode("keys").alias("key")).groupBy("site", "key").agg(F.count("*").alias("n")).where("n > 1")
    over = F.col("n") - F.lit(ratio) * F.col("pages")
    lines = lines.join(totals.withColumnRenamed("site", "of"), F.col("site").eqNullSafe(F.col("of"))).where((over > 0) & (over * over > F.lit(errors * errors * ratio * (1 - ratio)) * F.col("pages")))
    return lines.groupBy("site").agg(F.collect_set("key").alias("lines"))


def drop_boilerplate(docs: DataFrame, site_column: str = "source", text_column: str = "text", ratio: float = RATIO, errors: float = ERRORS) -> DataFrame:
    """`docs` with the boilerplate lines of its site taken out of each text, and n_lines, n_dropped (int).

    All rows and columns stay, in number and order of lines; blank lines stay. Null texts stay null with 0 lines; a null site is a site of its
    own; what is on one page of a site only is never lost; repeated rows count once and all get the same text; an
    empty table gives no rows. Columns named n_lines or n_dropped are replaced.
    """
    text = F.col(text_column).cast("string")
    found = written(boilerplate(docs, site_column, text_column, ratio, errors).select(F.col("site").alias("__site"), F.col("lines").alias("__lines")), "boilerplate")
    # few sites: their lines go to every task; many: both sides are shuffled by site, and Spark splits large sites
    side = F.broadcast(found) if size_on_disk(docs.sparkSession, found) <= BROADCAST_BYTES else found
    rows = docs.join(side, F.col(site_column).eqNullSafe(F.col("__site")), "left")
    lines = F.split(text, "\n", -1)
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("__lines"), line_key(x)))
    rows = rows.withColumn("__kept", F.when(F.col("__lines").isNotNull(), kept).otherwise(lines))
    rows = rows.withColumns({
        "n_lines": F.when(text.isNull(), 0).otherwise(F.size(lines)),
        "n_dropped": F.when(text.isNull(), 0).otherwise(F.size(lines) - F.size("__kept")),
        text_column: F.array_join("__kept", "\n"),
    })
    return rows.drop("__site", "__lines", "__kept")


ORACLE_SQL = """
WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
lines AS (SELECT DISTINCT source, text, trim(line) AS line
          FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages) WHERE trim(line) <> ''),
counted AS (SELECT source, line, count(*) AS n FROM lines GROUP BY source, line HAVING count(*) > 1),
boiler AS (SELECT c.source, list(c.line) AS dropped FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
           WHERE c.n - CAST(0.05 AS DOUBLE) * t.pages > 0 AND pow(c.n - CAST(0.05 AS DOUBLE) * t.pages, 2) > CAST(0.4275 AS DOUBLE) * t.pages GROUP BY c.source),
cut AS (SELECT d.doc_id, d.source, string_split(d.text, chr(10)) AS before,
               list_filter(string_split(d.text, chr(10)), lambda l: trim(l) = '' OR NOT list_contains(coalesce(b.dropped, []), trim(l))) AS kept
        FROM documents d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, source, array_to_string(kept, chr(10)) AS text, CAST(coalesce(len(before), 0) AS INT) AS n_lines,
       CAST(coalesce(len(before) - len(kept), 0) AS INT) AS n_dropped
FROM cut
"""
