"""Look-alikes and wrong encodings, on damage made here."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioforge.llm import lookalike as L
from folioforge.llm import mojibake as M

WORDS = "Malmö Göteborg Zürich Köln Besançon Orléans São Coimbra Málaga Cádiz Logroño Århus Tromsø Bodø Évreux Nîmes Salão Peñón Lübeck Düren Almería Åbo Vigo Roma Paris London Berlin Vienna Bergen Oslo Turku".split()
CLEAN = [f"{a} {b}" for a in WORDS for b in ("Books", "& Sons,", "City", "1984", "Press ;")]


def fitted(values=CLEAN):
    """What the operator says of a value, the exact check of words included."""
    total = sum((M.count_pairs(v) for v in values), M.Counter())
    restore = M.Restorer(M.PairModel([(a, b, n) for (a, b), n in total.items()]))
    known = {w.lower() for v in values for w in M.LETTERS.findall(v)}

    def judge(value):
        found = restore(value)
        if found is None:
            return False, None, None
        if found.words <= known:
            return True, found.restored, found.undone
        return (True, found.sure, found.sure_undone) if found.sure_undone else (False, None, None)

    return judge


@pytest.fixture(scope="module")
def restore():
    return fitted()


def test_utf8_read_as_something_else(restore):
    for value in CLEAN:
        assert restore(value) == (False, None, None), value
        for encoding in ("cp1252", "latin-1", "mac_roman"):
            try:
                damaged = value.encode().decode(encoding)
            except UnicodeDecodeError:
                continue
            if damaged == value:
                continue
            assert restore(damaged)[:2] == (True, value), (value, damaged)
            try:
                twice = damaged.encode().decode(encoding)
            except UnicodeDecodeError:
                continue
            assert restore(twice)[:2] == (True, value)


def test_lost_and_partial(restore):
    assert restore("Malm\ufffd Books") == (True, None, "lost")
    assert restore("Malm\x85 Books")[0] and restore("KÃ¶ln und Köln")[:2] == (True, "Köln und Köln")
    for value in (None, "", "plain", "x" * 100_000, "é" * 100_000):
        assert restore(value) == (False, None, None)


ORDINARY = [
    "São Paulo", "Paris – London", "L’Harmattan", "“Boston”", "Århus", "Łódź", "£ London", "Köln · Wien", "Straße", "Guimarães", "Weißenburg", "Besançon", "d’Avignon", "Gießen", "João",
    "Český Krumlov", "Coïmbra", "© 1999", "N° 5", "½ London", "Saône", "ÅRHUS", "Ångström", "Œuvres", "東京", "Москва", "Αθήνα", "L’Œuvre — «Paris»", "… Wien", "Łomża", "José", "§ 12",
]


@pytest.mark.parametrize("value", ORDINARY)
def test_clean_text_stays(restore, value):
    """Letters, punctuation and symbols that the corpus does not have are no damage."""
    assert restore(value) == (False, None, None)


def test_clean_values_have_few_runs():
    total = sum((M.count_pairs(v) for v in CLEAN), M.Counter())
    restore = M.Restorer(M.PairModel([(a, b, n) for (a, b), n in total.items()]))
    odd = [v for v in CLEAN if not v.isascii()]
    assert sum(bool(restore.runs(v)) for v in odd) <= 0.05 * len(odd)


def test_one_byte_confusions():
    # the words of the corpus are those that occur undamaged
    restore = fitted(CLEAN * 3)
    hits = total = 0
    for value in CLEAN:
        try:
            damaged = value.encode("cp1252").decode("cp850")
        except UnicodeError:
            continue
        if damaged != value:
            total += 1
            hits += restore(damaged)[1] == value
    assert hits >= 0.8 * total


def test_the_alphabet_is_bounded():
    many = "".join(chr(c) for c in range(0x4E00, 0x9FFF))
    assert len(set(M.view(many))) <= 3 and len(M.view(many)) == len(many) + 2
    assert len(M.REPERTOIRE) < 1200


@given(st.lists(st.floats(-3, 3), max_size=30))
@settings(max_examples=200, deadline=None)
def test_segments_match_brute_force(weights):
    def best(lo, hi):
        """The maximal segments by definition: the best segment, then those left and right of it."""
        top, where = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += weights[j]
                if total > top + 1e-9:
                    top, where = total, (i, j + 1)
        if where is None:
            return []
        return [*best(lo, where[0]), where, *best(where[1], hi)]

    found = M.segments(weights)
    score = lambda segments: sorted(round(sum(weights[a:b]), 6) for a, b in segments)
    assert sum(score(found)) == pytest.approx(sum(score(best(0, len(weights)))), abs=1e-5)
    assert all(a < b for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))


def model():
    total = sum((L.count_trigrams(v) for v in [*CLEAN, "Коврин, Павел", "Тарусина, Вера", "Δελμάρης, Νίκος"]), M.Counter())
    return L.Unifier(L.ScriptModel([(*k, n) for k, n in total.items()]))


CYRILLIC = {v: k for k, v in (L.CYRILLIC_LOWER | L.CYRILLIC_UPPER).items()}


def test_lookalikes_come_back():
    unify, rng = model(), random.Random(3)
    for value in CLEAN:
        assert unify(value) == value
        damaged = "".join(CYRILLIC.get(c, c) if rng.random() < 0.4 else c for c in value)
        assert unify(damaged) == value, damaged
        wide = "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in value)
        assert unify(wide.replace(" ", "　")) == value
        assert unify("​".join(value)) == value and unify(value.replace(" ", " ")) == value
        assert unify(M.unicodedata.normalize("NFD", value)) == value


def test_readings_come_from_the_trigrams():
    """A letter with several readings is read as its neighbours ask; the path is traced back."""
    unify = model()
    assert unify("Lοndοn") == "London" and unify("Ѕalão") == "Salão" and unify("Тurkυ") == "Turku"
    assert len(L.readings("υ")) > 2 and len(L.readings("І")) > 2


def test_other_scripts_stay():
    unify = model()
    for value in ("Коврин, Павел", "Δελμάρης, Νίκος", "東京", "", None, "x" * 100_000):
        assert unify(value) == value


def test_operators(spark):
    schema = "field_name string, row_id bigint, elem int, value string, form string"
    rows = [("places", i, 0, v, "clash") for i, v in enumerate(CLEAN)]
    rows += [("places", 800 + i, 0, v, None) for i, v in enumerate(("São Paulo", "Guimarães", "L’Harmattan", "Köln · Wien"))]
    rows += [("places", 900, 0, "KÃ¶ln City", "clash"), ("places", 900, 0, "KÃ¶ln City", "clash"), ("places", 901, 0, None, None), ("places", 902, 0, "Vigо City", None), ("places", None, 0, "Ｖigo City", None)]
    df = spark.createDataFrame(rows, schema)
    got = M.garbled_values(df).collect()
    assert [(r.row_id, r.restored) for r in got] == [(900, "Köln City")] * 2
    changed = {(r.row_id, r.form) for r in L.consistent_forms(df, changed_only=True).collect()}
    assert changed == {(902, "Vigo City"), (None, "Vigo City")}
    assert L.consistent_forms(df).count() == len(rows)
    assert M.garbled_values(df.limit(0)).count() == 0 and L.consistent_forms(df.limit(0)).count() == 0
