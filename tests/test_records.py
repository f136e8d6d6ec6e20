import pytest
from pyspark.sql import functions as F

from kinloom.operators import conversion, graph, kin, merge, rules
from kinloom.sources import entities, sinks, tagged
from kinloom.streaming import orphans

FILE = """0 HEAD
1 SOUR Gramps
1 GEDC
2 VERS 5.5.1
1 CHAR UTF-8
0 @I1@ INDI
1 NAME Ann /Lee/
1 SEX F
1 BIRT
2 DATE 1 JAN 1900
2 PLAC Town
1 DEAT
2 DATE 1 JAN 1890
1 FAMS @F1@
1 SOUR @S1@
2 QUAY 2
0 @I2@ INDI
1 NAME Bob /Lee/
1 SEX M
1 FAMS @F1@
1 FAMC @F9@
0 @I3@ INDI
1 BIRT
2 DATE 5 MAY 1905
1 FAMC @F1@
2 PEDI birth
1 NOTE one
2 CONT two
2 CONC  three
0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 MARR
2 DATE 1 JAN 1899
0 @F2@ FAM
0 TRLR
"""


def records(spark, *texts):
    return tagged.records_of(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string"))


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ending", ["\n", "\r\n", "\r"])
def test_records_and_offsets(spark, ending):
    text = FILE.replace("\n", ending)
    found = records(spark, text).orderBy("rec_no").collect()
    assert [r.type for r in found] == ["HEAD", "INDI", "INDI", "INDI", "FAM", "FAM", "TRLR"]
    assert [r.line_number for r in found] == [1, 6, 17, 22, 30, 36, 37]
    for r in found:
        piece = text.encode()[r.byte_offset : r.byte_offset + r.byte_length].decode()
        assert piece.startswith("0 ") and piece.count(ending) == len(r.tags)


def test_odd_files(spark):
    found = records(spark, "", None, "\n\n", "no level\n0 HEAD\n\n1 A\n5 B\n100 C\n0 TRLR")
    assert [(r.doc_id, r.type, len(r.tags)) for r in found.orderBy("doc_id", "rec_no").collect()] == [("d3", "", 1), ("d3", "HEAD", 4), ("d3", "TRLR", 1)]
    assert [(r.line, r.code) for r in tagged.diagnostics_of(found).orderBy("line").collect()] == [(1, "INVALID_LEVEL"), (5, "BAD_LEVEL_JUMP"), (6, "INVALID_LEVEL")]
    with pytest.raises(Exception, match="line 1"):
        tagged.strict(found).collect()


def test_header_version_and_index(spark):
    found = records(spark, FILE, "0 HEAD\n0 @X@ INDI\n1 CREA\n0 @X@ INDI\n0 TRLR\n")
    assert rows(tagged.detect_version(found)) == [("d0", "5.5.1"), ("d1", "7.0")]
    assert tagged.header(found).where("doc_id = 'd0'").first().source_system == "Gramps"
    assert tagged.build_index(found).where("key = '@X@'").first().byte_offset == 25
    assert rows(conversion.minimum_version(found)) == [("d0", "5.5.1"), ("d1", "7.0")]


def test_read_write_and_lookup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes(b"\xef\xbb\xbf" + FILE.encode())
    (tmp_path / "in" / "b.txt").write_bytes(FILE.replace("Ann", "Ään").encode("utf-16"))
    found = tagged.records_of(tagged.read_texts(spark, str(tmp_path / "in")))
    assert found.groupBy("doc_id").count().select("count").distinct().collect()[0][0] == 7
    index = tagged.build_index(found).where("doc_id LIKE '%a.txt'")
    assert [t.tag for t in tagged.read_record(spark, index, "@I2@").first().tags] == ["INDI", "NAME", "SEX", "FAMS", "FAMC"]
    sinks.write(records(spark, FILE), str(tmp_path / "out"))
    written = "".join(p.read_text() for p in sorted((tmp_path / "out" / "doc_id=d0").glob("part*")))
    assert written == FILE


def test_round_trip_and_custom_tags(spark):
    text = "0 @I1@ INDI\n1 _A x\n2 B y\n1 C z\n0 TRLR\n"
    found = records(spark, text)
    assert [r.text for r in sinks.encode(found, preserve_unknown=False).orderBy("rec_no").collect()] == ["0 @I1@ INDI\n1 C z\n", "0 TRLR\n"]
    assert sinks.round_trip_differences(found, records(spark, "".join(r.text for r in sinks.encode(found).orderBy("rec_no").collect()))).count() == 0


def test_entities(spark):
    found = records(spark, FILE)
    people = {r.xref: r for r in entities.individuals(found).collect()}
    assert (people["@I1@"].names[0].given, people["@I1@"].names[0].surname, people["@I1@"].sex, people["@I1@"].birth.year) == ("Ann", "Lee", "F", 1900)
    assert people["@I1@"].citations[0].quality == 2 and people["@I1@"].events[0].place == "Town"
    assert people["@I3@"].child_in_families[0].pedigree == "birth" and people["@I3@"].notes == ["one\ntwo three"]
    first = next(r for r in entities.families(found).collect() if r.xref == "@F1@")
    assert (first.husband, first.wife, first.children, first.marriages[0].year) == ("@I2@", "@I1@", ["@I3@"], 1899)


def test_kin_and_rules(spark):
    found = records(spark, FILE)
    edges, people = entities.edges(found).cache(), entities.individuals(found).cache()
    assert [r.parent for r in kin.parents(edges, people).orderBy("idx", "role").collect()] == ["@I2@", "@I1@"]
    assert rows(kin.spouses(edges, people).select("person", "spouse")) == [("@I1@", "@I2@"), ("@I2@", "@I1@")]
    assert rows(kin.children(edges, people).select("person", "child")) == [("@I1@", "@I3@"), ("@I2@", "@I3@")]
    issues = rules.validate_all(found)
    assert rows(issues.select("code", "record_xref", "related_xref")) == [
        ("DEATH_BEFORE_BIRTH", "@I1@", ""), ("MARRIAGE_BEFORE_BIRTH", "@I1@", "@F1@"), ("MISSING_SUBM", "", ""),
        ("ORPHANED_FAMC", "@I2@", "@F9@"), ("ORPHANED_SOUR", "@I1@", "@S1@"), ("UNREASONABLE_PARENT_AGE", "@I1@", "@I3@"),
    ]
    assert rows(rules.legacy(found).select("code", "record_xref")) == [("BROKEN_XREF", "@I1@"), ("BROKEN_XREF", "@I2@"), ("EMPTY_FAMILY", "@F2@"), ("MISSING_REQUIRED_FIELD", "@I3@")]
    assert rows(rules.broken_references(found).select("record_xref", "related_xref")) == [("@I1@", "@S1@"), ("@I2@", "@F9@")]


def test_reach_ends_on_cycles_and_keeps_order(spark):
    edges = spark.createDataFrame([("d", "a", "c", [1]), ("d", "a", "b", [0]), ("d", "b", "d", [1]), ("d", "c", "d", [0]), ("d", "c", "e", [1]), ("d", "e", "a", [0])], "doc_id string, src string, dst string, ord array<int>")
    seeds = spark.createDataFrame([("d", "a")], "doc_id string, seed string")
    assert [r.node for r in graph.reach(edges, seeds, True).orderBy("depth", "path").collect()] == ["b", "c", "d", "e"]
    assert graph.reach(edges.limit(0), seeds).count() == 0


def test_subset_and_dangling_references(spark):
    found = records(spark, "0 HEAD\n1 SUBM @U1@\n0 @A@ X\n1 R @B@\n0 @B@ X\n0 @C@ X\n1 R @GONE@\n0 TRLR\n")
    seed = lambda x: spark.createDataFrame([("d0", x)], "doc_id string, xref string")
    inside = graph.closure(entities.pointers(found), found, seed("@A@"))
    assert rows(inside.select("xref")) == [("@A@",), ("@B@",)]
    kept = graph.subset(found, inside).orderBy("rec_no").collect()
    assert [r.xref for r in kept] == ["", "@A@", "@B@"] and len(kept[0].tags) == 1
    with pytest.raises(Exception, match="unresolved reference"):
        graph.closure(entities.pointers(found), found, seed("@C@")).collect()


def test_conversion_and_merge(spark):
    tags = records(spark, "0 X\n1 NOTE a\n2 CONC b\n2 CONT c\n1 X\n").select(conversion.consolidate(F.col("tags")).alias("t"))
    assert [(x.level, x.tag, x.value) for x in tags.first().t] == [(0, "X", ""), (1, "NOTE", "ab\nc"), (1, "X", "")]
    ids = spark.createDataFrame([("@I1@", 0), ("@Q@", 1)], "xref string, place long")
    assert rows(merge.renumbered(ids, ids, merge.collisions(ids, ids))) == [("@I1@", "@I2@"), ("@Q@", "@X0@")]
    with pytest.raises(Exception, match="cannot use"):
        merge.checked(spark.createDataFrame([("@I1@", "@Q@")], "old string, new string"), ids).collect()
    head, conflicts = merge.merged_headers(spark.createDataFrame([("x", "")], "a string, b string"), spark.createDataFrame([("y", "z")], "a string, b string"), ["a", "b"])
    assert rows(head) == [("x", "z")] and rows(conflicts) == [("a", "x", "y")]


def test_stream_finds_what_the_batch_finds(spark, tmp_path):
    first = spark.createDataFrame([("@I1@", "FAMS", "@F1@"), ("@I1@", "FAMC", "@F2@")], "xref string, ref_type string, target string")
    later = spark.createDataFrame([("@F1@", None, None)], first.schema)
    for name, part in (("1", first), ("2", later)):
        part.write.parquet(str(tmp_path / "in" / name))
    stream = spark.readStream.schema(first.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in"))
    orphans.collect(stream, str(tmp_path / "kept"), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert rows(orphans.finalize(spark, str(tmp_path / "kept"))) == [("ORPHANED_FAMC", "@I1@", "@F2@")]
    assert rows(orphans.counts(spark, str(tmp_path / "kept"))) == [(2, 2)]
