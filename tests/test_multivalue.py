import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.operators import multivalue as M

PLACES = M.Grammar(True, ["Vick and Kelt", "Véck and Kelt", "Melt and Dork"], ["Dorkland (State)"])
FIRMS = M.Grammar(False)


@pytest.mark.parametrize(
    "text, values",
    [
        ("A ; B", ["A", "B"]),
        ("A;B|C", ["A", "B", "C"]),
        ("A / B", ["A", "B"]),
        ("A/B", ["A/B"]),
        ("A--B\tC", ["A", "B", "C"]),
        ("Alpha and Beta :", ["Alpha", "Beta :"]),
        ("Alpha, Beta, and Gamma", ["Alpha", "Beta", "Gamma"]),
        ("Alpha, Region", ["Alpha, Region"]),
        ("Alpha, N. Reg. & Beta", ["Alpha, N. Reg.", "Beta"]),
        ("Vick and Kelt", ["Vick and Kelt"]),
        ("Vicck and Kelt, Melt and Dork", ["Vicck and Kelt, Melt and Dork"]),
        ("Alpha (One Street & Two Street) :", ["Alpha (One Street & Two Street) :"]),
        ("Alpha (One Street) ; Beta", ["Alpha (One Street)", "Beta"]),
        ("[Alpha ; Beta] :", ["Alpha", "Beta"]),
        ('"A; B" ; C', ['"A; B"', "C"]),
        ('"A", "B"', ['"A"', '"B"']),
        ('"A; B', ['"A', "B"]),
        ("[A ; B", ["[A", "B"]),
        ("A ;", ["A"]),
        ("Ａ；Ｂ³", ["Ａ", "Ｂ³"]),
        ("Alpha　ａ​ｎｄ Βeta", ["Alpha", "Βeta"]),
        ("Alpha, Reg., Beta, and Gamma", ["Alpha, Reg.", "Beta", "Gamma"]),
        ("Alpha, Dorkland, Beta, and Gamma", ["Alpha, Dorkland", "Beta", "Gamma"]),
        ("VÃƒÂ©ck and Kelt ; Beta", ["VÃƒÂ©ck and Kelt", "Beta"]),
        ("", []), (" ; ", []), (None, []),
    ],
)
def test_places(text, values):
    assert PLACES.parse(text).values == values


@pytest.mark.parametrize(
    "text, n",
    [("Alpha & Sons", 1), ("Alpha, Bet and Company, 1999", 1), ("(1) A Books (2) B Books", 2), ("A Books\nB Books", 2), ('"A Books, 1990"', 1), ("(1) A Books", 1)],
)
def test_firms(text, n):
    assert len(FIRMS.parse(text).values) == n


def test_errors_are_named():
    assert PLACES.parse('"A; B').errors == ["unclosed quote"]
    assert PLACES.parse('"A" x; B').errors == ["text after quote"]


@given(st.text(alphabet='ab "[]();,&|/-\tand', max_size=60))
@settings(max_examples=300, deadline=None)
def test_any_text_parses(text):
    for grammar in (PLACES, FIRMS):
        kept = "".join(grammar.parse(text).values)
        assert sum(c in "ab" for c in kept) <= sum(c in "ab" for c in text)


def test_edits():
    assert M.within_edits("abcd", "abdc", 1) and M.within_edits("abc", "abxc", 1) and not M.within_edits("abc", "axxc", 1)


def test_rows(spark):
    schema = "field_name string, row_id bigint, elem int, value string, pos int"
    data = [("places", 1, 0, "A ; B", 7), ("places", 1, 0, "A ; B", 7), ("places", 2, 0, None, 7), ("publishers", 3, 1, "x" * 200_000 + " ; y", 7), ("publishers", None, None, "One & Two", 7)]
    df = spark.createDataFrame(data, schema)
    got = sorted((r.field_name, r.row_id or 0, r.pos, r.n_values) for r in M.split_values(df, {"places": M.Lexicon()}).collect())
    assert got == [("places", 1, 0, 2), ("places", 1, 0, 2), ("places", 1, 1, 2), ("places", 1, 1, 2), ("publishers", 0, 0, 1), ("publishers", 3, 0, 2), ("publishers", 3, 1, 2)]
    assert M.split_values(df, {"places": M.Lexicon()}, packed_only=True).count() == 6
    assert M.split_values(df.limit(0), {"places": M.Lexicon()}).count() == 0


def test_lexicons_of_any_size_say_the_same(spark):
    """20,000 compound names and regions: the blocks and joins of a large lexicon give the rows of a broadcast one."""
    names = [f"Vor{i}ham and Kel{i}ton" for i in range(20_000)] + ["Foo Hill & Bar Dale", "Plain"]
    regions = [f"Region{i}" for i in range(20_000)] + ["Nordland (State)"]
    one = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    two = spark.createDataFrame([(r,) for r in regions] + [(None,)], "place string")
    texts = ["Vor77ham and Kel77ton", "Vor78hma & Kel78ton ; Rome", "Rome and Paris", "FOO HILL and bar dale and Rome", "[Foo Hill & Bar Dale and X]", "A, Nordland, B, and C", "A, Region5, and C", "", None, "A, B, and C"]
    df = spark.createDataFrame([("places", i, 0, t) for i, t in enumerate(texts)] + [("firms", 50, 0, "A & B")], "field_name string, row_id bigint, elem int, value string")
    large = M.make_lexicon([one], two)
    assert large.names_table is not None and large.regions_table is not None and not large.listed
    small = M.make_lexicon([one], two, most=100_000)
    assert len(small.listed) == 20_001 and small.names_table is None
    few = M.make_lexicon([one.where("name like 'Vor7%' or name like 'Foo%'")], two.where("place in ('Nordland (State)', 'Region5')"))
    got = sorted(map(tuple, M.split_values(df, {"places": large}).collect()))
    assert got == sorted(map(tuple, M.split_values(df, {"places": few}).collect()))
    values = lambda i: [r[5] for r in got if r[1] == i]
    assert values(0) == [texts[0]] and len(values(1)) == 2 and len(values(2)) == 2 and len(values(3)) == 2 and len(values(4)) == 2
    assert values(5) == ["A, Nordland", "B", "C"] and values(6) == ["A, Region5", "C"] and values(9) == ["A", "B", "C"]
