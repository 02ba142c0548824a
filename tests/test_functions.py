import unicodedata

import pytest
from pyspark.sql import functions as F

from folioforge.functions import classes as C
from folioforge.functions import text as T
from folioforge.functions import years as Y


def apply(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("v"))).collect()]


def restated_clean(s):
    s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return " ".join("".join(c if c.isalpha() else " " for c in s).split()).lower()


def test_clean_string(spark):
    values = ["New York :", "[São Paulo?]", "Ａｂｃ １２", "1984", "", "L'Été à", "東京 都", "x" * 50_000, "a\tb  c", "Zürich–Köln", "i̇st", "oﬃce ﬁn", "12½ ㎏", "𝚛𝐭", "क\u093eम", "ⅷ ⅳ", "Ærø", "ĳs", "№ 5"]
    assert apply(spark, [*values, None], T.clean_string) == [*map(restated_clean, values), None]


def test_small_text_functions(spark):
    assert apply(spark, ["  A   B,", "", None], T.basic_clean) == ["a b,", None, None]
    assert apply(spark, ["Ōsaka  (x)", "é"], T.match_key) == ["osaka (x)", "e"]
    assert apply(spark, ["A (State)", "A (Republic)", "A ( province ) "], T.strip_qualifier) == ["A", "A (Republic)", "A"]
    assert apply(spark, [" n 0012 ", "SF 000", "abc", None, "2001000001"], T.normalize_lccn) == ["n12", "sf0", None, None, "2001000001"]
    assert apply(spark, [" Fiction.; ", "A,b", None], T.normalize_term) == ["fiction", "a,b", None]
    label = lambda c: T.city_label(c, c.isin("new york", "brooklyn n y"))
    assert apply(spark, ["new york", "brooklyn n y", "boston", " ", None, ""], label) == [T.CITY, T.CITY, T.OTHER, T.NO_PLACE, T.NO_PLACE, T.NO_PLACE]


def test_canonical_place(spark):
    values = ["boston mass", "delaware ohio", "new york n y broadway", "mt horeb wis", "mt", "washington", "district of columbia", "s l", "", None, "paris", "fargo n dak"]
    want = ["boston ma", "delaware oh", "ny", "mt horeb wi", "mt", "washington", "dc", None, None, None, "paris", "fargo nd"]
    got = apply(spark, values, T.canonical_place)
    assert got[:2] + got[3:] == want[:2] + want[3:] and got[2] == "new york ny"


@pytest.mark.parametrize(
    "text, places",
    [
        ("Boston and New York :", ["Boston", "New York :"]), ("New York; London", ["New York", "London"]), ("[Boston ; Paris]", ["Boston", "Paris"]), ("[Boston]", ["[Boston]"]),
        ("Port of Spain, Trinidad and Tobago", ["Port of Spain, Trinidad and Tobago"]), ("and New York,", ["New York,"]), ("A (x and y; z) and B", ["A (x and y; z)", "B"]),
        ("A {b;c) d; e", ["A {b;c) d", "e"]), ("A;;B", ["A", "B"]), (";", [None]), (None, [None]), ("St. Kitts and Nevis & Basel", ["St. Kitts and Nevis", "Basel"]),
    ],
)
def test_split_places(spark, text, places):
    assert apply(spark, [text], T.split_places) == [places]


def test_expand_places(spark):
    assert apply(spark, [["A & B", "B", None], [], None], T.expand_places, "array<string>") == [["A", "B", None], [None], [None]]


def test_nested_text(spark):
    occ = "array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>"
    value = [("752", " ", [("d", "City"), ("a", " Country "), ("b", None), ("z", "x")]), None, ("752", " ", None), ("752", " ", [("e", "Old")])]
    assert apply(spark, [value, [], None], T.flatten_hierarchy, occ) == [["Country, City", "Old"], None, None]
    names = F.create_map(F.lit("nyu"), F.lit("New York"))
    assert apply(spark, [["NYU ", "zz"], None], lambda c: T.decode_codes(c, names), "array<string>") == [["New York", None], None]


def test_year_int(spark):
    values = ["c1995", "[19--]", "1863 [i.e. 1963]", "1900-1950", "1990-1995", "1420 Chestnut, 1888", "10014", "n.d.", "", None, "1850/1899; 1875", "i. e., 1710", "1863 [i.e. 9999] 1864"]
    want = [1995, None, 1963, None, 1990, 1888, None, None, None, None, None, 1710, 1863]
    assert apply(spark, values, Y.year_int) == want


def test_008(spark):
    base = "760729s1899    nyu           000 0 eng d"
    values = [base, base[:6] + "q18991910" + base[15:], base[:6] + "m18991999" + base[15:], base[:6] + "m18991920" + base[15:], base[:-1], None]
    assert apply(spark, values, Y.date1_008) == [1899, None, None, 1899, None, None]
    assert apply(spark, values, Y.place_code_008)[0] == "nyu"
    assert apply(spark, [1999, 0, -5, None], Y.decade, "int") == [1990, None, None, None]


def test_ranges():
    assert C.ClassRange.parse("PR9000-9999") == C.ClassRange("PR", 9000, 9999) == C.ClassRange.parse("PR9000-PR9999")
    assert C.ClassRange.parse("PS") == C.ClassRange("PS") and C.ClassRange.parse("PR9000") == C.ClassRange("PR", 9000, None)
    for bad in ("", "9000", "PR9000-PS9999", "PR-9999"):
        with pytest.raises(ValueError):
            C.ClassRange.parse(bad)


def test_class_matching(spark):
    values = ["PS3553", "PS8123", "PS", "PSX1", "P1", "Z244", None, ""]
    assert apply(spark, values, C.ClassRange("PS").matches) == [True, False, True, False, False, False, False, False]
    assert apply(spark, values, C.ClassRange("P").matches) == [True, False, True, True, True, False, False, False]
    assert apply(spark, values, C.ClassRange("PS", 3000, 3600).matches) == [True] + [False] * 7
    arrays = [["PS8123", "PS3"], ["Z1"], [], None, ["PR1", "PS"]]
    assert apply(spark, arrays, C.is_target, "array<string>") == [False, False, False, False, True]
    assert apply(spark, [["PS3", "PR1", "PS4", "x"], None], C.class_prefixes, "array<string>") == [["PR", "PS"], []]
    assert apply(spark, [1, 499, 500, 3575, None], C.assign_bin, "bigint") == ["PS1-499", "PS1-499", None, "PS3550-3576", None]
    df = spark.createDataFrame([([], ["PS 1"]), (["Z"], ["PS1"]), (None, None), (["PS  3"], None)], "c array<string>, l array<string>")
    assert [r[0] for r in df.select(C.in_scope(F.col("c"), F.col("l"))).collect()] == [True, False, False, True]
