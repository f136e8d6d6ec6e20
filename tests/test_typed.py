"""Typed entities against values worked out by hand, and their way back to the same lines."""

import pytest
from pyspark.sql import functions as F

from kinloom.sources import sinks, tagged, typed, untyped

# every record has its tags in the order in which they are written
PERSON = """0 @I1@ INDI
1 NAME Ann Mary /van Lee/ Jr
2 GIVN Ann
2 SURN Lee
2 NPFX Dr
2 SPFX van
2 TYPE birth
2 TRAN Anna /Li/
3 LANG de
3 GIVN Anna
1 SEX F
1 BIRT
2 DATE 1 JAN 1900
2 PLAC Town
3 FORM city
3 MAP
4 LATI N10.5
4 LONG W3.25
2 TYPE live
2 CAUS x
2 AGE 0
2 AGNC office
2 ADDR Street 1
3 ADR1 Street 1
3 ADR2 Floor 2
3 CITY Town
3 POST 123
3 CTRY Land
2 PHON 1
2 PHON 2
2 EMAIL a@@b
2 FAX 3
2 WWW w
2 RESN locked
2 UID u1
2 SDATE 2 JAN 1900
2 NOTE hidden
2 SOUR @S1@
3 PAGE 7
3 QUAY 3
3 DATA
4 DATE 1901
4 TEXT first
5 CONT second
3 _APID 1,22::333
2 OBJE @O1@
3 CROP
4 TOP 1
4 WIDTH 9
3 TITL face
1 NO MARR
1 EVEN famous
2 TYPE prize
1 OCCU baker
2 DATE 1920
2 PLAC Town
2 TYPE job
2 SOUR @S1@
1 BAPL
2 DATE 1950
2 TEMP LOGAN
2 STAT DONE
1 FAMC @F1@
2 PEDI adopted
1 FAMS @F2@
1 ASSO @I2@
2 PHRASE friend of the family
2 ROLE WITN
2 SOUR @S1@
2 NOTE seen
1 SOUR @S1@
1 NOTE @N1@
1 NOTE one
2 CONT two
1 NOTE @N2@
1 OBJE @O1@
1 CHAN
2 DATE 3 MAR 2020
3 TIME 10:00
1 CREA
2 DATE 1 MAR 2020
1 REFN 5
1 UID u2
1 EXID 99
2 TYPE http://x
1 _FSFTID @@A-1
"""
OTHERS = """0 @F1@ FAM
1 HUSB @I2@
1 WIFE @I1@
1 CHIL @I3@
1 CHIL @I4@
1 NCHI 2
1 MARR
2 DATE 1899
1 SLGS
2 TEMP X
1 NOTE n
0 @S1@ SOUR
1 TITL Title
1 AUTH Author
1 PUBL Print
1 TEXT body
2 CONT more
1 REPO @R1@
2 CALN 1
3 MEDI book
2 CALN 2
2 NOTE shelf
1 OBJE @O1@
1 REFN 8
0 @S2@ SOUR
1 REPO
2 NAME Attic
2 CALN 3
3 MEDI box
0 @U1@ SUBM
1 NAME Sub
1 ADDR Road
2 ADR1 Road
1 PHON 4
1 EMAIL e
1 LANG de
1 LANG en
1 EXID 1
1 NOTE s
0 @R1@ REPO
1 NAME Archive
1 ADDR Way
2 ADR1 Way
2 CITY City
1 PHON 5
1 EXID 2
0 @N1@ NOTE text
1 CONT next
1 EXID 3
0 @N2@ SNOTE shared
1 CONT line
1 MIME text/plain
1 LANG en
1 TRAN geteilt
2 CONT Zeile
2 MIME text/plain
2 LANG de
1 SOUR @S1@
1 CHAN
2 DATE 2021
0 @O1@ OBJE
1 FILE a.jpg
2 FORM image/jpeg
3 MEDI photo
2 TITL A
2 TRAN a.png
3 FORM image/png
1 NOTE @N2@
1 SOUR @S1@
1 REFN 1
1 REFN 2
1 UID 3
1 EXID 4
1 RESN privacy
"""


def records(spark, text):
    return tagged.records_of(spark.createDataFrame([("d", text)], "doc_id string, text string"))


def back(spark, text, **options):
    found = records(spark, text).cache()
    parts = [untyped.to_records(make(found), kind, **options) for kind, make in typed.BUILDERS.items() if f" {kind}" in text]
    lines = []
    for part in parts:
        lines += [(r.rec_no, r.text) for r in sinks.encode(part).select("rec_no", "text").collect()]
    return "".join(text for _, text in sorted(lines))


def test_person_fields(spark):
    p = typed.individuals(records(spark, PERSON), dated=True).first()
    n, e = p.names[0], p.events[0]
    assert (n.given, n.surname, n.prefix, n.surname_prefix, n.type, n.transliterations[0].language, n.transliterations[0].given) == ("Ann", "Lee", "Dr", "van", "birth", "de", "Anna")
    assert (e.place_detail.coordinates.latitude, e.address.line1, e.address.city, e.phone, e.parsed_date.year, e.citations[0].data.text) == ("N10.5", "Street 1", "Town", ["1", "2"], 1900, "first")
    assert (e.citations[0].quality, e.citations[0].apid.record, e.media[0].crop.width, e.media[0].crop.left) == (3, "333", 9, 0)
    assert [(x.type, x.is_negative, x.description) for x in p.events] == [("BIRT", False, ""), ("MARR", True, ""), ("EVEN", False, "famous")]
    assert (p.note_xrefs, p.inline_notes, p.notes) == (["@N1@", "@N2@"], ["one\ntwo"], ["@N1@", "one\ntwo", "@N2@"])
    assert (p.change_date.time, p.creation_date.time, p.family_search_id, p.associations[0].phrase, p.ordinances[0].temple) == ("10:00", "", "@A-1", "friend of the family", "LOGAN")


def test_back_to_the_same_lines(spark):
    # the text of a citation is one value with CONT below it, which the reader keeps as a tag of its own
    assert back(spark, PERSON) == PERSON.replace("4 TEXT first\n5 CONT second\n", "4 TEXT first\n")
    assert back(spark, OTHERS).replace("1 TEXT body\n", "1 TEXT body\n2 CONT more\n") == OTHERS
    assert back(spark, OTHERS[OTHERS.index("0 @R1@") : OTHERS.index("0 @N1@")], prefer_raw=True) == OTHERS[OTHERS.index("0 @R1@") : OTHERS.index("0 @N1@")]


def test_edges(spark):
    text = "0 @I1@ INDI\n1 NAME /Only\n2 GIVN\n1 BIRT\n2 DATE 32 FOO\n2 DATE 1900\n2 SOUR @S@\n3 QUAY 9\n3 QUAY 2\n2 ADDR\n3 CONT a\n3 CONT b\n3 CONC c\n1 NO\n1 ODD x\n2 INSIDE\n1 FAMC @F@\n2 WRONG\n1 _OWN\n2 X\n"
    found = records(spark, text)
    p = typed.individuals(found).first()
    assert (p.names[0].given, p.names[0].surname, p.events[0].date, p.events[0].citations[0].quality, p.events[0].address.line1, len(p.events)) == ("", "Only", "1900", 2, "a\nbc", 1)
    said = sorted((r.line, r.code, r.tag) for r in typed.diagnostics(found).collect())
    assert said == [(5, "INVALID_VALUE", "DATE"), (8, "INVALID_VALUE", "QUAY"), (14, "INVALID_VALUE", "NO"), (15, "UNKNOWN_TAG", "ODD"), (18, "UNKNOWN_TAG", "WRONG")]
    assert typed.individuals(found.limit(0)).count() == 0


def test_notes_are_resolved_in_order(spark):
    text = OTHERS + "0 @I9@ INDI\n1 NOTE @N2@\n1 NOTE in\n1 NOTE @GONE@\n1 NOTE @N1@\n0 @I8@ INDI\n1 NOTE @GONE@\n"
    found = records(spark, text)
    assert {r.xref: r.all_notes for r in typed.all_notes(typed.individuals(found), found).collect()} == {"@I9@": ["in", "shared\nline", "text\nnext"], "@I8@": None}
    assert typed.all_notes(typed.media_objects(found), found).first().all_notes == ["shared\nline"]


def test_header(spark):
    found = records(spark, "0 HEAD\n1 SOUR App\n2 VERS 1\n1 GEDC\n2 VERS 5.5\n1 CHAR ANSEL\n1 SUBM @U1@\n0 TRLR\n")
    head = tagged.header(found).withColumn("version", F.lit("7.0")).join(found.where("type = 'HEAD'").select("doc_id", "tags"), "doc_id").withColumn("encoding", F.lit("UTF-8"))
    written = [sinks.encode(untyped.header_records(head, compat)).first().text for compat in (False, True)]
    assert written == ["0 HEAD\n1 GEDC\n2 VERS 7.0\n1 CHAR UTF-8\n1 SOUR App\n2 VERS 1\n1 SUBM @U1@\n", "0 HEAD\n1 GEDC\n2 VERS 7.0\n1 CHAR UTF-8\n1 SOUR App\n"]


@pytest.mark.parametrize("line, most, want", [("aa bb cc", 5, ["aa ", "bb cc"]), ("aaaaaaa", 3, ["aaa", "aaa", "a"]), (" aaaaa", 4, [" aaa", "aa"]), ("ééé é", 4, ["éé", "é ", "é"]), ("", 4, [""]), ("ab cd", 5, ["ab cd"]), ("日本語\u0085x", 4, ["日", "本", "語", "\u0085x"])])
def test_wrap_counts_bytes(spark, line, most, want):
    from kinloom.functions import strings

    assert spark.createDataFrame([(line,)], "s string").select(strings.wrap(F.col("s"), most).alias("w")).first().w == want
