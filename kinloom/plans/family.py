"""Queries of the records' own operators over the driver tables: records, kinship, reachability, rules, merging, conversion.

Customers and parts stand for people, orders for families (the customer is the husband, another one the wife, the parts on its
lines the children), regions, nations, customers and orders for four generations.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.functions import dates, lines, strings
from kinloom.operators import conversion, coverage, graph, kin, merge, rules
from kinloom.sources import sinks, tagged

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small file for each order."""
    line = lambda level, xref, tag, value: lines.render_line(F.lit(level), F.lit(xref), F.lit(tag), value)
    text = F.concat_ws("\n", F.lit("0 HEAD"), line(0, "@F1@", "FAM", F.lit("")), line(1, "", "HUSB", F.concat(F.lit("@I"), "o_custkey", F.lit("@"))), F.lit("1 MARR"), line(2, "", "DATE", F.upper(F.date_format("o_orderdate", "d MMM yyyy"))), F.lit("0 TRLR"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"), text.alias("text"))


def record_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-13 to SRC-20, AGG-14, WIN-01: records, lines and bytes by type."""
    records = tagged.records_of(_files(spark, sf_dir))
    return records.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("n_lines"), F.sum("byte_length").alias("n_bytes"))


def byte_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-20, SRC-23, WIN-03: where each file's records lie."""
    return tagged.build_index(tagged.records_of(_files(spark, sf_dir))).select("doc_id", "key", "type", "byte_offset", "byte_length")


def level_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-39: three levels for each customer."""
    levels = F.array(*((F.col("c_custkey") % n).cast("int") for n in (4, 7, 3)))
    clamped = table(spark, sf_dir, "customer").select("c_custkey", tagged.clamp_levels(levels).alias("l"))
    return clamped.select("c_custkey", *(F.get("l", F.lit(i)).alias(f"l{i}") for i in range(3)))


def tag_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-02: what each of three tags stands under."""
    tags = F.array(F.struct(F.lit(0).alias("level"), F.lit("A").alias("tag")), F.struct((1 + F.col("c_custkey") % 2).cast("int").alias("level"), F.lit("B").alias("tag")), F.struct((1 + F.col("c_custkey") % 3).cast("int").alias("level"), F.lit("C").alias("tag")))
    above = table(spark, sf_dir, "customer").select("c_custkey", rules.with_parents(tags).alias("p"))
    return above.select("c_custkey", *(F.get("p", F.lit(i)).alias(f"p{i}") for i in range(3)))


def continuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-16 to STR-18, ENT-27: whole texts wrapped into tags and folded back."""
    tags = table(spark, sf_dir, "documents").select("doc_id", sinks.text_to_tags(F.coalesce("text", F.lit("")), 1, "NOTE").alias("t"))
    longest = F.aggregate("t", F.lit(0), lambda m, x: F.greatest(m, F.octet_length(x["value"])))
    return tags.select("doc_id", F.md5(sinks.fold(F.col("t"))).alias("text_md5"), (longest <= 248).alias("fits"))


def vendor_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-35."""
    names = F.array(*map(F.lit, ("Ancestry.com Family Trees", "FamilySearch", "RootsMagic 9", "Legacy 10", "Gramps", "MyHeritage", "other")))
    return table(spark, sf_dir, "documents").select("doc_id", strings.vendor(F.get(names, (F.col("doc_id") % 7).cast("int"))).alias("vendor"))


def _date(year: Column, month: Column, day: Column) -> Column:
    number = lambda c, name: c.cast("int").alias(name)
    return F.struct(number(day, "day"), number(month, "month"), number(year, "year"), F.lit("GREGORIAN").alias("calendar"), F.lit(False).alias("is_bc"), F.lit(0).alias("dual_year"), year.cast("string").alias("original"))


def _lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    birth, death = _date(1800 + key % 100, F.month(day), F.dayofmonth(day)), _date(1790 + F.col("o_custkey") % 250, 1 + key % 12, 1 + key % 28)
    return table(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), key.alias("xref"), birth.alias("birth"), death.alias("death"))


def age_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-05, VAL-08, DATE-10, DATE-11, DATE-18."""
    return rules.own_dates(_lives(spark, sf_dir)).select("severity", "code", F.col("record_xref").alias("o_orderkey"))


def _family(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(edges, people): customers with a positive balance and small parts are known people."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    fam, husband, wife = _id("F", "o_orderkey"), _id("C", "o_custkey"), F.concat(F.lit("C"), (F.col("o_custkey") * 7 % 100).cast("string"))
    row = lambda rows, src, dst, kind, idx: rows.select(F.lit("d").alias("doc_id"), src.alias("src"), dst.alias("dst"), F.lit(kind).alias("ref_type"), idx.cast("int").alias("idx"))
    zero, line = F.lit(0), F.col("l_linenumber")
    child, home = _id("P", "l_partkey"), _id("F", "l_orderkey")
    edges = row(orders, fam, husband, "HUSB", zero).unionAll(row(orders, fam, wife, "WIFE", zero)).unionAll(row(orders, husband, fam, "FAMS", zero)).unionAll(row(orders, wife, fam, "FAMS", zero)).unionAll(row(items, home, child, "CHIL", line)).unionAll(row(items, child, home, "FAMC", line))
    customers = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.lit("d").alias("doc_id"), _id("C", "c_custkey").alias("xref"))
    parts = table(spark, sf_dir, "part").where("p_size <= 25").select(F.lit("d").alias("doc_id"), _id("P", "p_partkey").alias("xref"))
    return edges, customers.unionAll(parts)


def parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-01."""
    return kin.parents(*_family(spark, sf_dir)).groupBy("person", "role", "parent").agg(F.count("*").alias("n"))


def spouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-02."""
    return kin.spouses(*_family(spark, sf_dir)).groupBy("person", "spouse").agg(F.count("*").alias("n"))


def children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-03."""
    return kin.children(*_family(spark, sf_dir)).groupBy("person").agg(F.count("*").alias("n"), F.count_distinct("child").alias("n_children"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-06 to JOIN-09."""
    return kin.members(*_family(spark, sf_dir)).groupBy("family", "role").agg(F.count("*").alias("n"))


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = (("nation", _id("R", "n_regionkey"), _id("N", "n_nationkey")), ("customer", _id("N", "c_nationkey"), _id("C", "c_custkey")), ("orders", _id("C", "o_custkey"), _id("O", "o_orderkey")))
    parts = [table(spark, sf_dir, name).select(F.lit("d").alias("doc_id"), up.alias("src"), down.alias("dst")) for name, up, down in levels]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH-01, GRAPH-03: of every region."""
    seeds = table(spark, sf_dir, "region").select(F.lit("d").alias("doc_id"), _id("R", "r_regionkey").alias("seed"))
    return graph.reach(_tree(spark, sf_dir), seeds).select("seed", "node", "depth")


def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH-02, GRAPH-04: of every order."""
    seeds = table(spark, sf_dir, "orders").select(F.lit("d").alias("doc_id"), _id("O", "o_orderkey").alias("seed"))
    up = _tree(spark, sf_dir).select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graph.reach(up, seeds).select("seed", "node", "depth")


def subset_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GRAPH-06: parts that refer to each other in cycles."""
    at = lambda c: F.concat(F.lit("@P"), c.cast("string"), F.lit("@"))
    parts = table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.col("p_partkey"), "p_size", at(F.col("p_partkey")).alias("xref"))
    references = parts.select("doc_id", F.col("xref").alias("src"), at(F.col("p_partkey") * 7 % 100).alias("dst"))
    return graph.closure(references, parts, parts.where("p_size = 1")).select("xref")


def duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16, VAL-22 to VAL-24: parts of one brand whose names share the second word."""
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    people = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("xref"), F.col("p_partkey").alias("line_number"), word(1).alias("given"), F.col("p_type").alias("sex"), F.col("p_size").alias("year"), word(2).alias("surname"), F.col("p_brand").alias("brand"))
    return rules.duplicate_pairs(people, ["surname", "brand"]).select("left", "right", F.round("confidence", 6).alias("confidence"))


def duplicate_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JOIN-16, VAL-22, VAL-23: classes of parts with one description, and which of them may be the same."""
    word = lambda c, n: F.split_part(c, F.lit(" "), F.lit(n))
    people = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("xref"), F.col("p_partkey").alias("line_number"), word("p_name", 1).alias("given"), word("p_type", 1).alias("sex"), F.floor(F.col("p_size") / 4).alias("year"), word("p_name", 2).alias("surname"), F.col("p_brand").alias("brand")
    )
    block = ["surname", "brand"]
    links = rules.duplicate_links(rules.duplicate_classes(people, block), block)
    return links.select("left", "right", "left_members", "right_members", F.round("confidence", 6).alias("confidence"))


def control_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-21, STR-28: a control character before every third text's first line end."""
    text = F.when(F.col("doc_id") % 3 == 0, F.replace(F.col("text"), F.lit("a"), F.lit("\x0b"))).otherwise(F.col("text"))
    found = rules.control_characters(table(spark, sf_dir, "documents").select(F.lit("d").alias("doc_id"), F.col("doc_id").alias("xref"), text.alias("value")))
    return found.select(F.col("record_xref").alias("doc_id"), F.col("details.position").try_cast("long").alias("position"))


def xref_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-19: page addresses as identifiers."""
    found = rules.long_xrefs(table(spark, sf_dir, "pages").select(F.lit("d").alias("doc_id"), "url").withColumnRenamed("url", "xref"))
    return found.select(F.col("record_xref").alias("url"), F.col("details.length").try_cast("long").alias("length"))


def coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-12, STR-13."""
    degrees = F.format_string("%d.5", F.abs(F.col("c_custkey")) % 90)
    parsed = strings.coordinates(F.concat(F.when(F.col("c_custkey") % 2 == 0, "N").otherwise("S"), degrees), F.concat(F.when(F.col("c_custkey") % 3 == 0, "E").otherwise("W"), degrees))
    return table(spark, sf_dir, "customer").select("c_custkey", parsed.alias("p")).select("c_custkey", F.col("p.lat").alias("lat"), F.col("p.long").alias("long"))


def _two_sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    one = lambda name, key: table(spark, sf_dir, name).select(F.concat(F.lit("@I"), F.col(key).cast("string"), F.lit("@")).alias("xref"), F.col(key).alias("place"))
    return one("customer", "c_custkey"), one("supplier", "s_suppkey")


def combine_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE-01, MERGE-02, MERGE-04, SET-01: customers and suppliers under one set of identifiers."""
    first, second = _two_sets(spark, sf_dir)
    mapping = merge.checked(merge.prefixed(merge.collisions(first, second), "B"), first)
    return first.select("xref").unionAll(merge.remap(second, mapping, "xref").select("xref"))


def combine_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MERGE-05, AGG-13, WIN-08."""
    first, second = _two_sets(spark, sf_dir)
    return merge.checked(merge.renumbered(first, second, merge.collisions(first, second)), first)


def uppercase_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CONV-11."""
    return conversion.uppercase(table(spark, sf_dir, "part").select(F.col("p_name").alias("xref")))


def tag_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-08, AGG-09: event types as tags of users."""
    return conversion.tag_loss(table(spark, sf_dir, "events").select(F.col("user_id").alias("xref"), F.col("event_type").alias("tag")), ("click", "view", "purchase"))


def media_type_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-20, STR-21, CONV-12."""
    form = F.get(F.array(*map(F.lit, ("JPG", "pdf", " tif ", "MPG", "image/x", "xyz", "video/mpeg", "TEXT"))), (F.col("doc_id") % 8).cast("int"))
    typed = table(spark, sf_dir, "documents").select("doc_id", strings.to_media_type(form).alias("media_type"))
    return typed.withColumn("legacy", strings.to_legacy_media(F.col("media_type"))).withColumn("kept", strings.to_legacy_media(form))


def registry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VAL-12, VAL-13, VAL-15 to VAL-18."""
    pick = lambda by, *words: F.get(F.array(*map(F.lit, words)), (F.col("event_id") % by).cast("int"))
    code = rules.check_tag(pick(4, "_MILT", "_PRIM", "_FSTAG", "_OWN"), pick(3, "INDI", "OBJE", "FAM"), pick(5, "Y", "N", "", "maybe", "y"), rules.registry(), True)
    return table(spark, sf_dir, "events").select(code.alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def issue_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT-06 to FLT-10, AGG-04, AGG-06: issues of a strictness without a skipped code, counted."""
    kept = rules.shown(rules.own_dates(_lives(spark, sf_dir)), "normal", ("IMPOSSIBLE_AGE",))
    return kept.groupBy("severity", "code").agg(F.count("*").alias("n"))


def roundtrip_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SINK-01, SINK-16, SINK-17, JOIN-17: files written and read back, every fifth one with a changed tag."""
    before = _files(spark, sf_dir)
    changed = F.when(F.col("doc_id").cast("long") % 5 == 0, F.replace(F.col("text"), F.lit("1 MARR"), F.lit("1 DIV"))).otherwise(F.col("text"))
    diff = sinks.round_trip_differences(tagged.records_of(before), tagged.records_of(before.withColumn("text", changed)))
    return diff.select("doc_id", "rec_no", "idx", "before", "after")


def report_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-26: the coverage of all documents by source as one JSON text each."""
    rows = coverage.coverage(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "source", ["lang"])
    return rows.select("source", F.to_json(F.struct("total", "with_lang")).alias("report"))


FAMILY = """people AS (SELECT 'C' || c_custkey AS xref FROM customer WHERE c_acctbal > 0 UNION ALL SELECT 'P' || p_partkey FROM part WHERE p_size <= 25),
    fam AS (SELECT o_orderkey AS f, 'C' || o_custkey AS h, 'C' || (o_custkey * 7 % 100) AS w FROM orders),
    fams AS (SELECT h AS person, f FROM fam UNION ALL SELECT w, f FROM fam), kid AS (SELECT l_orderkey AS f, 'P' || l_partkey AS child FROM lineitem)"""
MARRIED = "upper(strftime(o_orderdate, '%-d %b %Y'))"
LIVES = """SELECT o_orderkey, 1800 + o_orderkey % 100 AS y0, month(o_orderdate) * 100 + day(o_orderdate) AS k0, 1790 + o_custkey % 250 AS y1, (1 + o_orderkey % 12) * 100 + 1 + o_orderkey % 28 AS k1 FROM orders"""
AGES = f"""SELECT 'ERROR' AS severity, 'DEATH_BEFORE_BIRTH' AS code, o_orderkey FROM ({LIVES}) WHERE y1 < y0 OR (y1 = y0 AND k1 < k0)
    UNION ALL SELECT 'WARNING', 'IMPOSSIBLE_AGE', o_orderkey FROM ({LIVES}) WHERE y1 - y0 - CASE WHEN k1 < k0 THEN 1 ELSE 0 END > 120"""
TREE = """SELECT 'R' || n_regionkey AS up, 'N' || n_nationkey AS down FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey FROM orders"""
ORACLES = {
    "record_group": f"""SELECT type, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_lines, CAST(sum(b) AS BIGINT) AS n_bytes FROM (SELECT 'HEAD' AS type, 1 AS k, 7 AS b FROM orders
        UNION ALL SELECT 'TRLR', 1, 6 FROM orders UNION ALL SELECT 'FAM', 4, 11 + strlen('1 HUSB @I' || o_custkey || '@') + 1 + 7 + strlen('2 DATE ' || {MARRIED}) + 1 FROM orders) GROUP BY type""",
    "byte_index": f"""WITH f AS (SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 11 + strlen('1 HUSB @I' || o_custkey || '@') + 1 + 7 + strlen('2 DATE ' || {MARRIED}) + 1 AS b FROM orders)
        SELECT doc_id, 'HEAD' AS key, 'HEAD' AS type, CAST(0 AS BIGINT) AS byte_offset, CAST(7 AS BIGINT) AS byte_length FROM f UNION ALL SELECT doc_id, '@F1@', 'FAM', 7, b FROM f UNION ALL SELECT doc_id, 'TRLR', 'TRLR', 7 + b, 6 FROM f""",
    "level_clamp": """SELECT c_custkey, CAST(l0 AS INT) AS l0, CAST(l1 AS INT) AS l1, CAST(least(c_custkey % 3, l1 + 1) AS INT) AS l2 FROM
        (SELECT c_custkey, l0, least(c_custkey % 7, l0 + 1) AS l1 FROM (SELECT c_custkey, least(c_custkey % 4, 1) AS l0 FROM customer))""",
    "tag_parent": "SELECT c_custkey, '' AS p0, 'A' AS p1, CASE WHEN 1 + c_custkey % 2 < 1 + c_custkey % 3 THEN 'B' ELSE 'A' END AS p2 FROM customer",
    "continuation_fold": "SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '\\r\\n|\\r', chr(10), 'g')) AS text_md5, true AS fits FROM documents",
    "vendor_detect": "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'ancestry' WHEN 1 THEN 'familysearch' WHEN 2 THEN 'rootsmagic' WHEN 3 THEN 'legacy' WHEN 4 THEN 'gramps' WHEN 5 THEN 'myheritage' ELSE 'unknown' END AS vendor FROM documents",
    "age_rules": AGES,
    "parents": f"""WITH {FAMILY}, r AS (SELECT child, 0 AS role, h AS parent FROM kid JOIN fam USING (f) UNION ALL SELECT child, 1, w FROM kid JOIN fam USING (f))
        SELECT child AS person, role, parent, count(*) AS n FROM r WHERE parent IN (SELECT xref FROM people) GROUP BY ALL""",
    "spouses": f"""WITH {FAMILY}, s AS (SELECT person, CASE WHEN h = person THEN w ELSE h END AS spouse FROM fams JOIN fam USING (f))
        SELECT person, spouse, count(*) AS n FROM s WHERE spouse IN (SELECT xref FROM people) GROUP BY ALL""",
    "children": f"WITH {FAMILY} SELECT person, count(*) AS n, count(DISTINCT child) AS n_children FROM fams JOIN kid USING (f) WHERE child IN (SELECT xref FROM people) GROUP BY person",
    "members": f"""WITH {FAMILY}, m AS (SELECT f, 0 AS role, h AS member FROM fam UNION ALL SELECT f, 1, w FROM fam UNION ALL SELECT f, 2, child FROM kid)
        SELECT 'F' || f AS family, role, count(*) AS n FROM m WHERE member IN (SELECT xref FROM people) GROUP BY f, role""",
    "descendants": f"""WITH RECURSIVE tree AS ({TREE}), walk(seed, node, depth) AS (SELECT up, down, 1 FROM tree WHERE up LIKE 'R%' UNION SELECT seed, down, depth + 1 FROM walk JOIN tree ON node = up) SELECT seed, node, depth FROM walk""",
    "ancestors": f"""WITH RECURSIVE tree AS ({TREE}), walk(seed, node, depth) AS (SELECT down, up, 1 FROM tree WHERE down LIKE 'O%' UNION SELECT seed, up, depth + 1 FROM walk JOIN tree ON node = down) SELECT seed, node, depth FROM walk""",
    "subset_closure": "WITH RECURSIVE walk(k) AS (SELECT p_partkey FROM part WHERE p_size = 1 UNION SELECT k * 7 % 100 FROM walk) SELECT '@P' || k || '@' AS xref FROM walk",
    "duplicates": """WITH p AS (SELECT p_partkey AS k, split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s, p_brand, p_size AS y, p_type AS x FROM part),
        m AS (SELECT a.k AS "left", b.k AS "right", CASE WHEN a.g = b.g THEN 1.0 ELSE 1 - levenshtein(a.g, b.g) / CAST(greatest(strlen(a.g), strlen(b.g)) AS DOUBLE) END AS sim, abs(a.y - b.y) AS d, a.x = b.x AS sx
        FROM p a JOIN p b ON a.s = b.s AND a.p_brand = b.p_brand AND a.k < b.k)
        SELECT "left", "right", round(c, 6) AS confidence FROM (SELECT *, CAST(0.3 AS DOUBLE) + 0.3 * sim + CASE WHEN d = 0 THEN CAST(0.2 AS DOUBLE) WHEN d <= 2 THEN 0.1 ELSE 0 END + CASE WHEN sx THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS c FROM m WHERE sim >= 0.8) WHERE c >= 0.7""",
    "duplicate_links": """WITH p AS (SELECT split_part(p_name, ' ', 1) AS g, split_part(p_name, ' ', 2) AS s, p_brand, CAST(floor(p_size / 4) AS BIGINT) AS y, split_part(p_type, ' ', 1) AS x, min(p_partkey) AS k, count(*) AS n FROM part GROUP BY ALL),
        m AS (SELECT a.k AS "left", b.k AS "right", a.n AS left_members, b.n AS right_members, CASE WHEN a.g = b.g THEN 1.0 ELSE 1 - levenshtein(a.g, b.g) / CAST(greatest(strlen(a.g), strlen(b.g)) AS DOUBLE) END AS sim, abs(a.y - b.y) AS d, a.x = b.x AS sx
        FROM p a JOIN p b ON a.s = b.s AND a.p_brand = b.p_brand AND (a.k < b.k OR (a.k = b.k AND a.n > 1)))
        SELECT "left", "right", left_members, right_members, round(c, 6) AS confidence FROM (SELECT *, CAST(0.3 AS DOUBLE) + 0.3 * sim + CASE WHEN d = 0 THEN CAST(0.2 AS DOUBLE) WHEN d <= 2 THEN 0.1 ELSE 0 END + CASE WHEN sx THEN CAST(0.1 AS DOUBLE) ELSE 0 END AS c FROM m WHERE sim >= 0.8) WHERE c >= 0.7""",
    "control_chars": "SELECT doc_id, CAST(strlen(split_part(text, 'a', 1)) AS BIGINT) AS position FROM documents WHERE doc_id % 3 = 0 AND contains(text, 'a')",
    "xref_length": "SELECT DISTINCT url, CAST(strlen(trim(url, '@')) AS BIGINT) AS length FROM pages WHERE strlen(trim(url, '@')) > 20",
    "coordinates": """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE -1 END * (CAST(c_custkey % 90 AS DOUBLE) + 0.5) AS lat, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE -1 END * (CAST(c_custkey % 90 AS DOUBLE) + 0.5) AS long FROM customer""",
    "combine_prefix": "SELECT '@I' || c_custkey || '@' AS xref FROM customer UNION ALL SELECT CASE WHEN s_suppkey IN (SELECT c_custkey FROM customer) THEN '@BI' ELSE '@I' END || s_suppkey || '@' FROM supplier",
    "combine_renumber": """SELECT '@I' || s_suppkey || '@' AS old, '@I' || ((SELECT max(k) FROM (SELECT max(c_custkey) AS k FROM customer UNION ALL SELECT max(s_suppkey) FROM supplier)) + row_number() OVER (ORDER BY s_suppkey)) || '@' AS new
        FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer)""",
    "uppercase_ids": "SELECT DISTINCT p_name AS old, upper(p_name) AS new FROM part WHERE p_name <> upper(p_name)",
    "tag_loss": "SELECT event_type AS tag, count(*) AS n, count(DISTINCT user_id) AS records FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY event_type",
    "media_type_map": """SELECT doc_id, ['image/jpeg', 'application/pdf', 'image/tiff', 'video/mpeg', 'image/x', '', 'video/mpeg', 'text/plain'][doc_id % 8 + 1] AS media_type,
        ['JPG', 'PDF', 'TIFF', 'MPEG', '', '', 'MPEG', 'TXT'][doc_id % 8 + 1] AS legacy, ['JPG', 'pdf', ' tif ', 'MPG', '', 'xyz', 'MPEG', 'TEXT'][doc_id % 8 + 1] AS kept FROM documents""",
    "registry_check": """WITH e AS (SELECT event_id % 4 AS t, event_id % 3 AS p, event_id % 5 AS v FROM events)
        SELECT CASE WHEN t = 0 AND p <> 0 THEN 'INVALID_TAG_PARENT' WHEN t = 1 AND p <> 1 THEN 'INVALID_TAG_PARENT' WHEN t = 1 AND v >= 3 THEN 'INVALID_TAG_VALUE' WHEN t = 3 THEN 'UNKNOWN_CUSTOM_TAG' END AS code, count(*) AS n FROM e GROUP BY 1""",
    "issue_filters": f"SELECT severity, code, count(*) AS n FROM ({AGES}) WHERE code <> 'IMPOSSIBLE_AGE' GROUP BY ALL",
    "roundtrip_diff": "SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, CAST(1 AS INT) AS rec_no, CAST(2 AS INT) AS idx, '1 MARR' AS before, '1 DIV' AS after FROM orders WHERE o_orderkey % 5 = 0",
    "report_json": """SELECT source, '{"total":' || count(*) || ',"with_lang":' || count(nullif(lang, '')) || '}' AS report FROM documents GROUP BY source""",
}


def queries() -> dict[str, Query]:
    found = (
        record_group, byte_index, level_clamp, tag_parent, continuation_fold, vendor_detect, age_rules, parents, spouses, children, members, descendants, ancestors, subset_closure, duplicates, duplicate_links, control_chars,
        xref_length, coordinates, combine_prefix, combine_renumber, uppercase_ids, tag_loss, media_type_map, registry_check, issue_filters, roundtrip_diff, report_json,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
