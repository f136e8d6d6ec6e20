"""Conversion, combination, reports and streams as wholes, against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from kinloom.functions import charset, strings
from kinloom.operators import conversion, graph, merge, rules
from kinloom.sources import entities, jobs, sinks, tagged, untyped
from kinloom.streaming import encoder, validation

OLD = """0 HEAD
1 GEDC
2 VERS 5.5.1
1 CHAR ANSEL
1 SUBM @u1@
0 @i1@ INDI
1 NAME A /B/
1 NOTE one
2 CONC  two
2 SOUR x
2 CONT three
1 FAMS @F1@
1 _MINE z
0 @F1@ FAM
1 WIFE @i1@
0 @O1@ OBJE
1 FILE a
2 FORM JPG
0 @u1@ SUBM
1 NAME S
0 TRLR
"""
NEW = """0 HEAD
1 GEDC
2 VERS 7.0
1 SCHMA
2 TAG _X http://x
0 @I1@ INDI
1 NAME A
1 EXID @5
2 TYPE https://www.familysearch.org/ark
1 EXID 6
2 TYPE other
1 UID 7
0 @O1@ OBJE
1 FILE a
2 FORM image/png
2 TRAN b
3 FORM image/x
0 TRLR
"""


def records(spark, *texts):
    return tagged.records_of(spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "doc_id string, text string"))


def text(rows, doc_id="d0"):
    return "".join(r.text for r in sinks.encode(rows.where(F.col("doc_id") == doc_id)).orderBy("rec_no").collect())


def said(report):
    return {(r.kind, r.path, r.original if r.kind != "transformation" else "", r.n) for r in report.collect()}


def test_conversion(spark):
    found = records(spark, OLD, NEW).cache()
    made, report = conversion.convert(found, "7.0")
    want = OLD.replace("VERS 5.5.1", "VERS 7.0").replace("ANSEL", "UTF-8").replace("@u1@", "@U1@").replace("@i1@", "@I1@").replace("JPG", "image/jpeg")
    assert text(made) == want.replace("1 NOTE one\n2 CONC  two\n2 SOUR x\n2 CONT three\n", "1 NOTE one two\n2 CONT three\n2 SOUR x\n")
    assert text(made, "d1") == NEW
    rows = said(report)
    assert {("transformation", "XREF_UPPERCASE", "", 2), ("transformation", "CONC_REMOVED", "", 1), ("transformation", "VERSION_UPGRADE", "", 1), ("transformation", "ENCODING_UPDATED", "", 1), ("normalized", "Individual @i1@", "@i1@", 1)} <= rows
    assert {("preserved", "Individual @i1@ > _MINE", "z", 1), ("approximated", "MediaObject @O1@ > FILE > FORM", "JPG", 1)} <= rows and not [r for r in rows if r[0] in ("data_loss", "validation")]
    down, report = conversion.convert(found, "5.5.1")
    assert text(down, "d1") == NEW.replace("VERS 7.0", "VERS 5.5.1").replace("1 SCHMA\n2 TAG _X http://x\n", "").replace("1 EXID @5\n2 TYPE https://www.familysearch.org/ark\n", "1 _FSFTID @@5\n").replace("image/png", "PNG")
    rows = said(report)
    assert {("data_loss", "EXID tags", "", 1), ("data_loss", "UID tags", "", 1), ("data_loss", "TRAN tags", "", 1), ("data_loss", "SCHMA schema definitions", "", 1), ("dropped", "Individual @I1@ > EXID", "EXID", 1), ("normalized", "Individual @I1@ > EXID", "EXID", 1)} <= rows
    assert conversion.all_notes(report).agg(F.max("ordinal")).first()[0] == 3
    lines = list(conversion.report_text(report, "d1", "7.0", "5.5.1"))
    assert lines[0] == "Conversion: 7.0 -> 5.5.1" and "  - UID tags: not in 5.5.1" in lines
    with pytest.raises(conversion.DataLossError):
        conversion.convert(found, "5.5", strict=True)
    with pytest.raises(ValueError):
        conversion.convert(found, "8")


@pytest.mark.parametrize("body, version", [("0 @I@ INDI\n1 UID 1\n", "5.5.1"), ("0 @I@ INDI\n1 BIRT\n2 SDATE 1\n", "7.0"), ("0 @I@ INDI\n1 OBJE @O@\n2 CROP\n", "7.0"), ("0 @I@ INDI\n1 SOUR @S@\n2 PHRASE x\n", "5.5.1"), ("0 @I@ INDI\n1 ASSO @J@\n2 PHRASE x\n", "7.0"), ("0 @F@ FAM\n1 NO \n", "5.5.1"), ("0 @N@ SNOTE x\n", "7.0")])
def test_minimum_version(spark, body, version):
    assert conversion.minimum_version(records(spark, "0 HEAD\n" + body + "0 TRLR\n")).first().version == version


def test_combine(spark):
    one, two = records(spark, "0 HEAD\n1 SOUR A\n0 @I1@ INDI\n1 FAMS @F9@\n0 TRLR\n"), records(spark, "0 HEAD\n1 SOUR B\n0 @I1@ INDI\n1 FAMS @F1@\n1 NOTE about @I1@\n0 @F1@ FAM\n1 HUSB @I1@\n0 TRLR\n")
    with pytest.raises(merge.Collision):
        merge.combine(one, two)
    for strategy, new in (("prefix", "@zI1@"), ("renumber", "@I2@")):
        made, mapping, conflicts = merge.combine(one, two, strategy, "z")
        assert text(made) == f"0 HEAD\n1 SOUR A\n1 SOUR B\n0 @I1@ INDI\n1 FAMS @F9@\n0 {new} INDI\n1 FAMS @F1@\n1 NOTE about @I1@\n0 @F1@ FAM\n1 HUSB {new}\n"
        assert [tuple(r) for r in conflicts.collect()] == [("source_system", "A", "B")]
    with pytest.raises(merge.IncompatibleHeaders):
        merge.combine(records(spark, OLD), records(spark, NEW), "prefix", "z")


def test_quality_and_rules(spark):
    body = "0 HEAD\n1 GEDC\n2 VERS 5.5\n0 @I1@ INDI\n1 NAME A /B/\n1 BIRT\n2 DATE (about)\n2 PLAC P\n1 SOUR @S1@\n0 @I2@ INDI\n1 _APID x\n0 @S1@ SOUR\n0 @AVERYLONGIDENTIFIER12345@ NOTE x\x0by\n0 TRLR\n"
    found = records(spark, body, body.replace("5.5", "7.0")).cache()
    report, issues = rules.quality(found)
    r = report.where("doc_id = 'd0'").first()
    assert (r.total_individuals, r.total_sources, r.individuals_with_birth_date, r.birth_date_coverage, r.individuals_with_places, r.completeness_issues, r.info_count) == (2, 1, 1, 0.5, 1, 3, 3)
    assert sorted(x.code for x in rules.of_record(issues.where("doc_id = 'd0'"), "@I2@").collect()) == ["MISSING_BIRTH_DATE", "MISSING_NAME", "NO_SOURCES"]
    assert '"total_individuals":2' in rules.as_json(report).first().report
    all_ = rules.validate_all(found, ())
    assert sorted((x.doc_id, x.severity, x.code) for x in all_.collect()) == [("d0", "ERROR", "INVALID_TAG_PARENT"), ("d0", "WARNING", "MISSING_SUBM"), ("d0", "WARNING", "XREF_TOO_LONG"), ("d1", "ERROR", "BANNED_CONTROL_CHARACTER"), ("d1", "ERROR", "INVALID_TAG_PARENT")]
    assert "[WARNING] MISSING_SUBM: the header needs a submitter" in [x.text for x in rules.rendered(all_).collect()]
    with pytest.raises(ValueError, match="_A"):
        rules.register([("_A", (), None)], ("_B", (), None), ("_A", (), None))
    assert rules.Limits(max_age=99).usual() == rules.Limits(99, 12, 55, 90)


def test_streams(spark, tmp_path):
    found = records(spark, "0 HEAD\n0 @I1@ INDI\n1 FAMC @F9@\n1 NOTE inline\n1 BIRT\n2 DATE 1900\n1 DEAT\n2 DATE 1800\n0 @F1@ FAM\n1 HUSB @I1@\n0 @S1@ SOUR\n1 REPO @R1@\n0 TRLR\n")
    found.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(found.schema).parquet(str(tmp_path / "in"))
    validation.collect(stream(), str(tmp_path / "kept"), str(tmp_path / "c1")).awaitTermination(300)
    assert sorted(r.code for r in validation.finalize(spark, str(tmp_path / "kept")).collect()) == ["DEATH_BEFORE_BIRTH", "ORPHANED_FAMC", "ORPHANED_NOTE", "ORPHANED_REPO"]
    validation.reset(spark, str(tmp_path / "kept"))
    assert not (tmp_path / "kept").exists()
    out = encoder.StreamEncoder(spark, str(tmp_path / "out"))
    with pytest.raises(encoder.EncoderError, match="header not written"):
        out.write_records(found)
    out.write_header(found.where("type = 'HEAD'"))
    out.drain(stream().where("type NOT IN ('HEAD', 'TRLR')"), str(tmp_path / "c2")).awaitTermination(300)
    with pytest.raises(encoder.EncoderError, match="trailer not written"):
        out.close()
    out.error = None
    out.write_trailer()
    out.close()
    written = "".join(p.read_text() for part in sorted((tmp_path / "out").iterdir()) for p in sorted(part.glob("part-*")))
    assert written == text(found)


def test_index_offsets_and_faults(spark, tmp_path):
    found = records(spark, OLD)
    index = tagged.build_index(found)
    tagged.save_index(index, str(tmp_path / "index"))
    assert tagged.load_index(spark, str(tmp_path / "index")).where("key = '@F1@'").first().type == "FAM"
    assert tagged.record_count(index).first().n == 6
    spark.range(1).selectExpr("9 AS version").write.mode("overwrite").parquet(str(tmp_path / "index" / "version"))
    with pytest.raises(ValueError, match="index version 9"):
        tagged.load_index(spark, str(tmp_path / "index"))
    assert tagged.from_offset(found, OLD.index("0 @u1@")).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.ged").write_bytes(b"0 HEAD\n1 NAME \xff\n")
    (tmp_path / "f" / "b.ged").write_bytes(b"0 HEAD\r\n1 CHAR ANSEL\r\n1 NAME \xe2e\xe8\xe2u\xcd\xa1\xfae\r\n")
    assert [(r.line, r.message) for r in tagged.text_faults(spark, str(tmp_path / "f")).collect()] == [(2, "invalid UTF-8 at column 8")]
    read = tagged.read_texts(spark, str(tmp_path / "f")).where("text IS NOT NULL").first()
    assert read.text.splitlines()[2] == "1 NAME éǘeŁe͠"
    assert spark.createDataFrame([(b"\xaf",)], "b binary").select(charset.decode(F.col("b"), F.lit("ANSEL")).alias("t")).first().t is None
    pairs = spark.createDataFrame([("5.5", "5.5.1"), ("7.0", "5.5"), ("5.5.5", "7.0")], "a string, b string")
    assert [r[0] for r in pairs.select(tagged.version_before(F.col("a"), F.col("b"))).collect()] == [True, False, False]
    with jobs.group(spark, "g"):
        found.count()
    assert jobs.progress(spark, "g")[0] > 0


def test_reach_people_and_media_types(spark):
    edges = spark.createDataFrame([("d", f"n{i}", f"n{i + 1}") for i in range(12)] + [("d", "n12", "n0")], "doc_id string, src string, dst string")
    people = spark.createDataFrame([("d", f"n{i}") for i in range(0, 12, 2)], "doc_id string, xref string")
    found = graph.reached_people(edges, spark.createDataFrame([("d", "n0")], "doc_id string, seed string"), people)
    assert sorted((r.depth, r.xref) for r in found.collect()) == [(i, f"n{i}") for i in range(2, 12, 2)]
    forms = spark.createDataFrame([(x,) for x in ("MPG", " text ", "video/x", "zzz", "htm", "video/mpeg")], "f string")
    assert [tuple(r) for r in forms.select(strings.to_media_type(F.col("f")), strings.to_legacy_media(F.col("f"))).collect()] == [("video/mpeg", "MPG"), ("text/plain", " text "), ("video/x", ""), ("", "zzz"), ("", "htm"), ("video/mpeg", "MPEG")]


def test_written_document_begins_with_its_header(spark):
    head = untyped.header_records(tagged.header(records(spark, OLD)).withColumn("version", F.lit("5.5.1")))
    assert text(head) == "0 HEAD\n1 GEDC\n2 VERS 5.5.1\n1 CHAR ANSEL\n"
    assert entities.individuals(records(spark, OLD)).count() == 1
