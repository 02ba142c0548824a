import gzip
import json

import pytest
from pyspark.sql import functions as F

from folioforge.functions.classes import ClassRange
from folioforge.operators import classify as K
from folioforge.plans import fields
from folioforge.plans.clean import clean_records
from folioforge.sources import marcxml, tables
from folioforge.streaming import cube

OCC = "array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>"
CLASS = f"rec_id int, classifications array<string>, local_call_numbers array<string>, first_author string, first_author_dates string, field_008 string, subject_genre_fields {OCC}"


def occ(tag, *subs, ind2="0"):
    return (tag, ind2, [(s[0], s[1:]) for s in subs])


CASES = {
    # name: (author, dates, 008, occurrences) -> rules, confidence, secondary, review
    "bare": (("Poe, Edgar", None, None, [occ("600", "aEliot, T.")]), "R1", "high", True, False),
    "bare without creator": ((None, None, None, [occ("600", "aEliot, T.")]), "R1", "high", True, False),
    "self": (("Poe, Edgar,", "1809-1849", None, [occ("600", "aPoe, Edgar.", "d1809-1849.")]), "", "low", False, True),
    "self, other born": (("Poe, Edgar", "1809-", None, [occ("600", "aPoe, Edgar", "d1999-")]), "R1", "high", True, False),
    "not lcsh": (("P", None, None, [occ("600", "aEliot, T.", ind2="7")]), "", "low", False, True),
    "criticism": (("P", None, None, [occ("650", "aX", "xHistory and criticism.")]), "R2", "high", True, False),
    "textual": (("P", None, None, [occ("650", "aX", "xCriticism, Textual.")]), "R8", "high", False, True),
    "literature": (("P", None, None, [occ("650", "aX", "xIn literature")]), "R3", "high", True, False),
    "letters": (("P", None, None, [occ("650", "aX", "vCorrespondence"), occ("600", "aY"), occ("650", "aZ", "xIn literature")]), "R9", "high", False, True),
    "life": (("P", None, None, [occ("650", "aX", "vBiography")]), "R5", "medium", True, False),
    "genre": (("P", None, None, [occ("650", "aX", "vFiction.")]), "R6", "high", False, False),
    "form": (("P", None, "x" * 33 + "p" + "x" * 6, []), "R7", "high", False, False),
    "short 008": (("P", None, "x" * 33 + "p", []), "", "low", False, True),
    "character": (("P", None, None, [occ("600", "aHolmes (Fictitious character)")]), "", "low", False, True),
    "655 never": (("P", None, None, [occ("655", "aX", "vFiction")]), "", "low", False, True),
    "nulls": ((None, None, None, None), "", "low", False, True),
    "null parts": (("P", None, None, [None, ("650", None, None), (None, "0", [("x", None), None])]), "", "low", False, True),
}


def test_rules(spark):
    rows = [(i, ["PS1"], None, *case[0]) for i, case in enumerate(CASES.values())]
    got = {r.rec_id: r for r in K.classified_records(spark.createDataFrame(rows, CLASS)).collect()}
    for i, (name, (_, rules, confidence, secondary, review)) in enumerate(CASES.items()):
        r = got[i]
        assert (";".join(r.matched_rules), r.confidence, r.is_secondary, r.review_flag) == (rules, confidence, secondary, review), name


def test_scope_and_missing_columns(spark):
    rows = [(1, ["Z1"], ["PS1"], *CASES["bare"][0]), (2, [], ["PS 2"], *CASES["bare"][0])]
    df = spark.createDataFrame(rows, CLASS)
    assert [r.rec_id for r in K.classified_records(df).collect()] == [2]
    with pytest.raises(ValueError):
        K.classify(df.drop("field_008"))


def test_headings_keep_records_with_null_parts(spark, tmp_path):
    parts = [None, ("650", "0", None), ("651", "0", [None, ("a", "A"), ("x", None), ("x", "B")]), (None, "0", [("a", "C")]), ("655", "7", [])]
    rows = [(1, parts), (2, [None]), (3, []), (4, None), (5, [("600", "0", [("a", "D"), ("x", "E")])])]
    spark.createDataFrame(rows, f"rec_id int, subject_genre_fields {OCC}").write.parquet(str(tmp_path / "marc_records.parquet"))
    got = {r.rec_id: r.headings for r in fields.headings(spark, str(tmp_path)).collect()}
    assert got == {1: "650: ; 651: A -- B; : C; 655: ", 2: "", 5: "600: D -- E"}


def test_cleaning(spark):
    schema = f"rec_id int, lccn string, source_record_id string, classifications array<string>, year array<string>, publishers array<string>, places array<string>, imprint_fields {OCC}, field_008 string, record int"
    rows = [
        (1, " 123 ", "f:1", ["PS3553"], ["c1995", "[1990]"], ["Pub, 1980"], ["Boston and New York :", "[New York]"], None, None, 0),
        (2, "123", "f:2", ["PS3553"], ["1990"], None, ["New York"], None, None, 0),
        (3, None, "f:3", ["PS1"], ["1990"], None, [], None, None, 0), (4, None, "f:4", ["PS1"], ["1990"], None, None, None, None, 0),
        (5, None, None, ["PS1"], ["n.d."], None, ["X"], None, None, 0), (6, None, None, ["Z1"], ["1990"], None, ["X"], None, None, 0),
        (7, None, None, ["PS"], ["1990"], None, ["X"], None, None, 0),
        (8, "8", "f:8", ["PS2"], ["1999"], None, ["X"], [("264", "1", [("c", "1931")]), ("264", "4", [("c", "c1930")])], "x" * 6 + "s1900" + " " * 4 + "nyu" + "x" * 22, 0),
    ]
    names = spark.createDataFrame([("nyu", "New York (State)")], "code string, name string")
    out = clean_records(spark.createDataFrame(rows, schema).drop("record"), ClassRange("PS"), spark.createDataFrame([("new york",), (None,)], "variant string"), "New York City", names)
    got = sorted((r.rec_id, r.record, r.places_clean or "-", r.city_group, r.year_min, r.year_source, r.place_name_008) for r in out.collect())
    # the label is that of the cleaned place, so a number alone names no place
    assert [r.city_group for r in clean_records(spark.createDataFrame([(1, ["PS1"], ["1990"], None, ["1984", "[?]", "New York"])], "rec_id int, classifications array<string>, year array<string>, publishers array<string>, places array<string>").withColumn("lccn", F.lit(None).cast("string")), ClassRange("PS"), spark.createDataFrame([("new york",)], "variant string"), "C").orderBy("place_pos").collect()] == ["No place of publication", "C"]
    assert got == [
        (1, "lccn:123", "boston", "Other", 1990, "legacy", None), (1, "lccn:123", "new york", "New York City", 1990, "legacy", None), (3, "f:3", "-", "No place of publication", 1990, "legacy", None),
        (4, "f:4", "-", "No place of publication", 1990, "legacy", None), (8, "lccn:8", "x", "Other", 1931, "publication", "New York (State)"),
    ]


def record(body, prefix=""):
    return f"<{prefix}record>{body}</{prefix}record>".replace("<d ", f"<{prefix}datafield ind1=' ' ").replace("</d>", f"</{prefix}datafield>").replace("<s ", f"<{prefix}subfield ").replace("</s>", f"</{prefix}subfield>").replace("<c ", f"<{prefix}controlfield ").replace("</c>", f"</{prefix}controlfield>")


def test_marcxml(spark, tmp_path):
    one = record(
        "<c tag='008'>760729s1899    nyu           000 0 eng  </c><d tag='010' ind2=' '><s code='a'>  123 </s></d><d tag='050' ind2=' '><s code='a'>PS1</s><s code='a'>Z2</s></d>"
        "<d tag='260' ind2=' '><s code='a'>Boston :</s><s code='b'/><s code='c'>1990</s></d><d tag='264' ind2='3'><s code='a'>Nope</s><s code='c'>1991</s></d>"
        "<d tag='264' ind2='1'><s code='a'>Boston :</s><s code='a'>Rome</s></d><d tag='650' ind2='0'><s code='a'>A</s><s code='x'> </s><s code='x'>B</s></d><d tag='650'></d><d tag='752' ind2=' '><s code='d'>C</s></d>"
    )
    two = record("<d tag='245' ind2='0'><s code='a'>Second</s></d>")
    bad = "<record><datafield tag='245'><subfield code='a'>x</datafield></record>"
    wrap = lambda *r: "<collection xmlns='http://www.loc.gov/MARC21/slim'>" + "".join(r) + "</collection>"
    for name, text in {"a.xml.gz": wrap(one, bad, two), "b.xml.gz": "<marc:collection xmlns:marc='http://www.loc.gov/MARC21/slim'>" + record("<d tag='245' ind2='0'><s code='a'>Prefixed</s></d>", "marc:") + "</marc:collection>", "combined.xml.gz": wrap(two)}.items():
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(text)
    got = {r.source_record_id: r for r in marcxml.records(marcxml.read_marc(spark, str(tmp_path)), ClassRange("PS")).collect()}
    prefixed = marcxml.records(marcxml.read_marc(spark, str(tmp_path), row_tag="marc:record"), ClassRange("PS")).collect()
    assert [(r.source_record_id, r.title) for r in prefixed] == [("b.xml.gz:1", "Prefixed")]
    assert sorted(got) == ["a.xml.gz:1", "a.xml.gz:3"] and got["a.xml.gz:3"].title == "Second"
    r = got["a.xml.gz:1"]
    assert r.lccn == "  123 " and len(r.field_008) == 40 and r.classifications == ["PS1", "Z2"] and r.matches_class_range
    assert r.places == ["Boston :", "Rome"] and r.publishers == [] and r.year == ["1990", "1991"]
    assert [(o.tag, o.ind2, [tuple(s) for s in o.subfields]) for o in r.subject_genre_fields] == [("650", "0", [("a", "A"), ("x", "B")]), ("650", " ", [])]
    assert len(r.imprint_fields) == 3 and r.place_hierarchy_752[0].subfields[0].text == "C"


def test_tables(spark, tmp_path):
    line = "\t".join(["1", 'Q"x', "Qx", "", "1.5", "2.5", "P", "PPL", "US", "", "NY", "", "", "", "", "", "7", "tz", "2020-01-01"])
    (tmp_path / "g.txt").write_text(line + "\n")
    r = tables.read_gazetteer(spark, str(tmp_path / "g.txt")).first()
    assert r.name == 'Q"x' and r.alternatenames is None and r.population == 0 and r.lat == 1.5 and r.elevation is None
    (tmp_path / "r.txt").write_text("US.NY\tNew York\tNew York\t1\nUS.NX\tNew York\tNew York\t2\nGB.ENG.X\tEngland\tEngland\t3\n")
    assert {tuple(x) for x in tables.read_regions(spark, str(tmp_path / "r.txt")).collect()} == {("US", "NX", "New York"), ("GB", "ENG.X", "England")}
    df = spark.createDataFrame([("001", ["a", "b"]), ("x", None)], "lccn string, l array<string>")
    tables.write_csv(df, str(tmp_path / "out"))
    back = tables.read_rows(spark, str(tmp_path / "out"), {"lccn": "string", "l": "string", "n": "int"})
    assert {tuple(x) for x in back.collect()} == {("001", "a; b", None), ("x", None, None)}
    tables.write_lines(df, "lccn", str(tmp_path / "lines"))
    assert [x[0] for x in spark.read.text(str(tmp_path / "lines")).collect()] == ["001", "x"]
    answers = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "geo_key string, normalized_place string")
    assert tables.append_answers(answers, str(tmp_path / "ans")).count() >= 0
    tables.append_answers(answers.union(spark.createDataFrame([("k3", "c")], answers.schema)), str(tmp_path / "ans"))
    assert spark.read.parquet(str(tmp_path / "ans")).count() == 3


def test_given_compound_names_are_not_cut(spark):
    places = ["VICKARACRES & Keltunholm :", "Guxvale and Trinisos", "Foo  hill & BAR", "Trinidad and Tobago and Rome"]
    df = spark.createDataFrame([(1, None, ["PS1"], ["1990"], None, places)], "rec_id int, lccn string, classifications array<string>, year array<string>, publishers array<string>, places array<string>")
    variants = spark.createDataFrame([], "variant string")
    cut = lambda **more: sorted(r.place for r in clean_records(df, ClassRange("PS"), variants, "X", **more).collect())
    assert cut() == ["BAR", "Foo  hill", "Guxvale", "Keltunholm :", "Rome", "Trinidad and Tobago", "Trinisos", "VICKARACRES"]
    assert cut(compounds=["guxvale and trinisos"]) == ["BAR", "Foo  hill", "Guxvale and Trinisos", "Keltunholm :", "Rome", "Tobago", "Trinidad", "VICKARACRES"]


def test_streaming_cube(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1990, "X"), ("a", 1990, "Y"), ("b", 1991, None)], "key string, year_min int, city_group string")
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: cube.start_cube(spark, str(tmp_path / "in"), rows.schema, "X", ["key", "year_min"], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(60)
    run()
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {(r.key, r.year_min): (r.city_n, r.other_n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("a", 1990): (2, 2), ("b", 1991): (0, 2)}
