"""Frequencies, canonical lists and names."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.llm import canonical as K
from folioforge.llm import frequency as Q
from folioforge.llm import names as N

TERMS = "field_name string, term string, record_id string, occurrences int, __block int"


def test_frequencies_match_brute_force(spark):
    rng = random.Random(1)
    rows = [("f", f"t{min(int(rng.expovariate(0.01)), 5000)}", f"r{rng.randrange(300)}", 0, 0) for _ in range(6000)]
    rows += [("f", "hot", f"r{i % 500}", 0, 0) for i in range(4000)] + [("g", "hot", None, 0, 0), ("f", None, "r1", 0, 0), ("f", " ", "r1", 0, 0), (None, "x", "r1", 0, 0)]
    got = {(r.field_name, r.term): (r.occurrences, r.records) for r in Q.term_frequencies(spark.createDataFrame(rows, TERMS)).collect()}
    kept = [(f, t, r) for f, t, r, *_ in rows if t and t.strip() and f]
    n, records = Counter((f, t) for f, t, _ in kept), Counter((f, t) for f, t, r in {k for k in kept} if r)
    assert got == {k: (n[k], records[k]) for k in n}


def test_many_ranges_and_marks(spark):
    df = spark.createDataFrame([("f", f"t{i:05d}", f"r{i // 2}", 0, 0) for i in range(10_000)] + [("f", "all", f"r{i}", 0, 0) for i in range(5000)], TERMS)
    counted = Q.term_frequencies(df)
    assert counted.count() == 10_001
    total = spark.createDataFrame([(5000,)], "n bigint")
    marks = Counter(r.mark for r in Q.mark_terms(counted, total).collect())
    assert marks == {"rare": 10_000, "common": 1}
    assert Q.term_frequencies(df.limit(0)).count() == 0


def test_arrays_are_as_long_as_their_terms():
    ids = random.Random(3).sample(range(10_000_000), 2000)
    batch = pd.DataFrame({"term_id": ids * 2, "occurrences": [2] * 4000, "records": [1] * 4000})
    arrays = pd.concat(Q._block_arrays(iter([batch])))
    assert sum(map(len, arrays["at"])) == sum(map(len, arrays["occurrences"])) == 2000
    rest = pd.DataFrame({"term_id": [ids[0], 5], "occurrences": [7, 7], "records": [1, 1]})
    every = pd.concat([arrays, *Q._block_arrays(iter([rest]))]).sort_values("range_id", kind="stable")
    got = pd.concat(Q._sum_arrays(iter([every[:100], every[100:]]))).set_index("term_id")
    assert len(got) == len({*ids, 5}) and got.loc[ids[0], "occurrences"] == 11 and got.loc[ids[1], "records"] == 2


def test_dictionary_is_dense(spark):
    df = spark.createDataFrame([("f", str(i % 777)) for i in range(3000)], "field_name string, term string")
    ids = [r.term_id for r in Q.dictionary(df, ["field_name", "term"]).collect()]
    assert sorted(ids) == list(range(777))


FORMS = [("Vorham", "Vorham"), ("Vorham", "Stisola"), ("Haxosgrad", "Haxosgrad"), ("Port Penddorf", "Port Penddorf"), ("Gerkivwick", "Gerkivwick"), ("Twin A", "Twinton"), ("Twin B", "Twinton"), ("Saint Mirk", "Saint Mirk")]
VALUES = {
    "vorham": "Vorham", "stisola": "Vorham", "vroham": "Vorham", "vorharn": "Vorham", "printed at haxosgrad": "Haxosgrad", "haxosgrad brar": "Haxosgrad", "port pendorf": "Port Penddorf",
    "gerkiwvick": "Gerkivwick", "st mirk": "Saint Mirk", "twinton": None, "fircombe": None, "s l": None, "": None, "123": None, None: None, "x" * 5000: None,
}


THRESHOLD, MARGIN = 0.57, 0.015


@pytest.mark.parametrize("mapped", [K.map_values, K.by_join])
def test_mapping(spark, mapped):
    values = spark.createDataFrame([(v,) for v in VALUES], "value string")
    forms = spark.createDataFrame([*FORMS, (None, "x"), ("y", None), FORMS[0]], "ref_key string, form string")
    got = {r.value: r.ref_key for r in mapped(values, forms, THRESHOLD, MARGIN, {"st": "saint"}).collect()}
    assert got == VALUES
    assert {r.ref_key for r in mapped(values, forms.limit(0), THRESHOLD, MARGIN).collect()} == {None}
    assert mapped(values.limit(0), forms, THRESHOLD, MARGIN).count() == 0


def syllable_names(rng, n):
    syllables = "ba ko ri tun mel dor sa vik lo pen har zu gri nos fa wel tim ran".split()
    return sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(3, 5))) for _ in range(n)})


def typo(rng, s):
    i = rng.randrange(len(s) - 1)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :], s[:i] + "q" + s[i:]])


def test_both_ways_agree_in_keys_and_scores(spark):
    """Forms that fold alike, repeated forms and near names: the index and the join say the same."""
    rng = random.Random(11)
    names = syllable_names(rng, 120)
    forms = [(n.title(), f) for n in names for f in (n, n.upper(), f"{n} (State)", f" {n},")] + [("Other", names[0]), ("Norda Welmar", "Norda Welmar"), ("Norda Welmar", "norda  welmar")]
    values = [typo(rng, n) for n in names] + [f"printed at {typo(rng, n)}" for n in names[:40]] + names[:30] + [f"{n[:4]}." for n in names] + ["Welmar, Norda", "Nor. Welm.", "zzz", "", None]
    a, b = (
        {r.value: (r.ref_key, round(r.score, 6)) for r in mapped(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(forms, "ref_key string, form string"), THRESHOLD, MARGIN, cut_words=True).collect()}
        for mapped in (K.map_values, K.by_join)
    )
    assert a == b
    assert a["Welmar, Norda"][0] == a["Nor. Welm."][0] == "Norda Welmar" and a["zzz"] == (None, 0.0)


def test_mapping_of_typos(spark):
    rng = random.Random(5)
    names = syllable_names(rng, 400)
    match = K.Matcher(K.Index([(n, n) for n in names[:300]]), THRESHOLD, MARGIN, {}, False)
    assert sum(match(typo(rng, n))[0] == n for n in names[:300]) >= 270
    assert sum(match(n)[0] is not None for n in names[300:]) <= 5


def test_region_forms():
    assert K.name_forms("North Glum (State)") == {"North Glum (State)", "North Glum"}
    assert K.name_forms("Melt and Dork") == {"Melt and Dork", "Melt"} and K.name_forms(None) == set()
    match = K.Matcher(K.Index([(n, f) for n in ("North Glum (State)", "New Glor", "Melt and Dork", "Glumeria") for f in K.name_forms(n)]), THRESHOLD, MARGIN, {}, True)
    want = {"N. Glum.": "North Glum (State)", "No. Glum": "North Glum (State)", "Glum, North": "North Glum (State)", "Mel.": "Melt and Dork", "Glume.": "Glumeria", "Glo.": None, "New Glo.": "New Glor", "N.": None}
    assert {v: match(v)[0] for v in want} == want


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("Poe, Edward", "Edward Poe", True), ("Poe, Edward", "Poe, Ned", True), ("Poe, Edward A.", "Poe, E. A.", True), ("Poe, Edward", "Poe, Robert", False), ("Poe, Edward A.", "Poe, Edward B.", False),
        ("von Poe, Robt.", "Robert von Poe", True), ("Dr. Edward Poe", "Poe, Edward, Mrs.", True), ("Poe, J.", "Poe, Robert", False), ("", "Poe", True),
    ],
)
def test_given_names(a, b, same):
    assert N.same_person(a, b, N.Vocabulary({})) is same


def test_minhash_estimates_similarity():
    hasher, rng = N.MinHash(100), random.Random(6)
    for _ in range(20):
        pool = [str(rng.random()) for _ in range(60)]
        a, b = set(pool[:40]), set(pool[rng.randrange(35) :])
        share = (hasher.signature(a) == hasher.signature(b)).mean()
        assert abs(share - len(a & b) / len(a | b)) < 0.1


def test_bands():
    n = N.bands()
    assert 1 - (1 - N.SIMILAR**N.ROWS) ** n >= N.RECALL > 1 - (1 - N.SIMILAR**N.ROWS) ** (n - 1)


SURNAMES = ["Gekoverpe", "Zedonvontel", "Nosgorlasas", "Hozulizar", "Farkazurlin", "Tabodulmo", "Valdebelres", "Rinlinufo"]


def rows_of_names(spark, extra=()):
    data = []
    for i, s in enumerate(SURNAMES):
        for j, form in enumerate((f"{s}, Robert", f"Robert {s}", f"{s}, Bob", f"{s}, R.", f"{s[:3]}{s[4:]}, Robert", f"{s}, Ursula", f"{s}, U.", f"{s}, ROBERT, 1900")):
            data.append(("first_author", 100 * i + j, N.spelling_key(form), form))
    data += [("publishers", 900, N.spelling_key(f), f) for f in ("Alpha Books", "The Alphor Press")]
    return spark.createDataFrame([*data, *extra], "field_name string, row_id bigint, key string, form string")


def spellings_of(rows):
    return rows.groupBy("field_name", "key").agg({"form": "min"}).withColumnRenamed("min(form)", "form")


def linked(spark, forms, field="first_author"):
    """Classes of forms by the operator."""
    df = spark.createDataFrame([(field, N.spelling_key(f), f) for f in forms], "field_name string, key string, form string").distinct()
    return {r.form: r.centre for r in N.clusters(df).collect()}


def test_clusters_and_pairs(spark):
    rows = rows_of_names(spark, [("first_author", 7000, "gekoverperobert", "Gekoverpe, Robert")])
    found = N.clusters(spellings_of(rows))
    every = found.collect()
    centre = {(r.field_name, r.key): r.centre for r in every}
    assert len(every) == len(centre) and all(r.links >= 0 for r in every)
    for s in SURNAMES:
        key = lambda f: centre["first_author", N.spelling_key(f)]
        assert key(f"{s}, Robert") == key(f"Robert {s}") == key(f"{s}, Bob") == key(f"{s}, R.") == key(f"{s[:3]}{s[4:]}, Robert")
        assert key(f"{s}, Ursula") == key(f"{s}, U.") != key(f"{s}, Robert")
    spelt = rows.groupBy("field_name", F.col("form").alias("value"), "key").agg(F.count(F.lit(1)).alias("n"))
    pairs = {(r.rec_a, r.rec_b) for r in N.variant_pairs(rows.withColumnRenamed("form", "value"), spelt, found, salts=3).collect()}
    # the same spelling in two rows is no pair; each pair once, smaller row first
    assert (0, 7000) not in pairs and (1, 7000) in pairs and (0, 7) not in pairs and (0, 1) in pairs and (0, 5) not in pairs
    assert all(a < b for a, b in pairs)
    assert N.clusters(spellings_of(rows).limit(0)).count() == 0


def test_nicknames_of_common_names(spark):
    got = linked(spark, ["Zorkuvel, Michael", "Zorkuvel, Mike", "Zorkuvel, Joseph", "Zorkuvel, Joe", "Zorkuvel, Giuseppe A.", "Zorkuvel, M."])
    assert got["Zorkuvel, Michael"] == got["Zorkuvel, Mike"] == got["Zorkuvel, M."] != got["Zorkuvel, Joseph"] == got["Zorkuvel, Joe"]


def test_damaged_values(spark):
    forms = [("Verlag Vérnehansen", 4), ("Verlag Vâernehansen", 1), ("Samasnänbel", 1), ("Verlag VÚrnehansen", 2), ("Fßgus", 1), ("Fágus", 5), ("Zesh¹ Books", 1), ("Zeshû Books", 2)]
    rows = spark.createDataFrame([("publishers", f, N.spelling_key(f), n) for f, n in forms], "field_name string, value string, key string, n bigint")
    assert {r.value for r in N.damaged_values(rows).collect()} == {"Verlag Vâernehansen", "Verlag VÚrnehansen", "Fßgus", "Zesh¹ Books"}
    assert N.damaged_values(rows.limit(0)).count() == 0


def test_a_crowded_core_is_not_all_pairs(spark):
    """5,000 spellings of one surname: few of the 12.5 million pairs are verified, and nearly all variants are found."""
    rng = random.Random(2)
    given = sorted({"".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(6, 9))) for _ in range(2500)})[:2400]
    slip = {g: g[:3] + g[4] + g[3] + g[5:] for g in given}
    forms = [f"Gekoverpe, {g.title()}" for g in given] + [f"{slip[g].title()} Gekoverpe" for g in given] + [f"Gekoverpe, {c}." for c in "ABCDEFGHIJKLMNOPRSTUVWZ"] * 9
    forms = sorted(set(forms))
    df = spark.createDataFrame([("first_author", N.spelling_key(f), f) for f in forms], "field_name string, key string, form string")
    shared = spark.sparkContext.broadcast({})
    nodes = N.plain_forms(df, shared).groupBy("field_name", "plain").agg(*[F.max(c).alias(c) for c in ("form", "core", "rank")])
    met = N.met_pairs(nodes, shared)
    assert nodes.count() > 4000 and met.count() < 250_000
    assert met.select("plain_a", "plain_b").distinct().count() == met.count()
    known = {tuple(sorted((r.plain_a, r.plain_b))) for r in met.collect()}
    both = [tuple(sorted((f"gekoverpe, {g}", f"gekoverpe, {slip[g]}"))) for g in given if slip[g] != g]
    assert sum(p in known for p in both) >= 0.95 * len(both)


def test_forms_meet_whatever_the_size_of_their_core(spark):
    """Blocks lose no pair that verification accepts; compared with all pairs."""
    rng = random.Random(7)
    given = ["Robert", "Bob", "Rob", "R.", "Roberta", "Rupert", "Wm.", "William", "Bill", "W.", "Ursula", "Urs.", "U. K.", "", "Robt.", "Chas.", "Charles", "Charels", "Theo", "Ted", "Edward", "T."]
    forms = [f"{s}, {g}".strip(" ,") for s in SURNAMES[:2] for g in given]
    for field, forms in (("first_author", forms), ("publishers", [f"{a}Zorvimel{b}" for a in ("", "The ", "Verlag ", "Messrs. ") for b in ("", " Books", " Bks.", " Press", " & Sons", " Pub. Co.", " Publishing", " Univ. Pr.")])):
        df = spark.createDataFrame([(field, N.spelling_key(f), f) for f in forms], "field_name string, key string, form string")
        shared = spark.sparkContext.broadcast({})
        nodes = N.plain_forms(df, shared).groupBy("field_name", "plain").agg(*[F.max(c).alias(c) for c in ("form", "core", "rank")])
        rows = nodes.collect()
        words = N.Vocabulary({})

        def alike(a, b):
            return N.monge_elkan(words.tokens(a.form), words.tokens(b.form), words.weights) >= N.ALIKE and (field != N.PERSONS or N.same_person(a.form, b.form, words))

        same_core = {(a.plain, b.plain) for a in rows for b in rows if a.plain < b.plain and a.core == b.core and alike(a, b)}
        got = {(r.key_a, r.key_b) for r in N.links(nodes, shared).collect()}
        assert same_core <= got and len(same_core) > 5


def test_single_edits_in_short_cores_are_found(spark):
    rng = random.Random(9)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(4, 12))) for _ in range(80)})
    swap = lambda n, i: n[:i] + n[i + 1] + n[i] + n[i + 2 :]
    cores = sorted(set(names) | {swap(n, rng.randrange(len(n) - 1)) for n in names} | {"x" + n[1:] for n in names} | {f"zorn {n}" for n in names[:20]} | {f"x{n[1:]} zorn" for n in names[:20]} | {"kornel", "komel"})
    cores = sorted({" ".join(sorted(c.split())) for c in cores})
    got = {(r.core_a, r.core_b) for r in N.similar_cores(spark.createDataFrame([("f", c) for c in cores], "field_name string, core string")).collect()}
    rest = lambda a, b: [t for t in a.split() if t not in b.split()]
    near = lambda a, b: len(x := rest(a, b)) == 1 == len(y := rest(b, a)) and len(a.split()) == len(b.split()) and N.token_likeness(x[0], y[0], False) >= N.CORE_ALIKE
    assert {(a, b) for a in cores for b in cores if a < b and near(a, b)} <= got


def test_agreeing_cores_are_found_as_by_comparison_with_all(spark):
    """Long tokens with several edits, cores inside others, nicknames, abbreviations: no pair depends on chance."""
    rng = random.Random(21)
    word = lambda a, b: "".join(rng.choice("abcdefghiklmnoprstuvz") for _ in range(rng.randint(a, b)))
    cores = set(N.NICKNAMES) | {"bob", "jim", "robt", "b", "abc", "cab", "abcd", "co", "and co", "co the zorvim"}
    for _ in range(60):
        short, long = word(5, 11), word(15, 24)
        slips = long
        for _ in range(len(long) // 5):
            slips = typo(rng, slips)
        other = typo(rng, short)
        cores |= {short, long, slips, f"{other} {long}", f"{short} {word(9, 12)}", f"{short} {word(4, 6)} {word(6, 9)}", f"{short} {slips} {word(4, 5)} {word(4, 5)}", f"{other} {long} {word(4, 5)} {word(4, 5)}"}
    cores = sorted({" ".join(sorted(c.split())) for c in cores})
    agree = {(a, b) for a in cores for b in cores if a < b and N.monge_elkan(a.split(), b.split(), {}) >= N.CORE_ALIKE}
    got = [(r.core_a, r.core_b) for r in N.similar_cores(spark.createDataFrame([("f", c) for c in cores], "field_name string, core string")).collect()]
    assert len(got) == len(set(got)) and set(got) == agree and len(agree) > 500


def test_names_that_only_look_alike_do_not_meet():
    """Cores made of the same few syllables share many q-grams, but no key unless few edits part them."""
    rng = random.Random(22)
    syllables = [a + v for a in "bdfghklmnprstvz" for v in "aeiou"]
    tokens = sorted({"".join(rng.choice(syllables) for _ in range(5)) for _ in range(3000)})
    holders: dict[str, list[str]] = {}
    for t in tokens:
        for k in N.near_keys(t):
            holders.setdefault(k, []).append(t)
    met = {(a, b) for h in holders.values() for i, a in enumerate(h) for b in h[i + 1 :]}
    assert len(met) < len(tokens) / 4


def test_damaged_common_words_are_one_form():
    words = N.Vocabulary({"publishing": 2.0, "books": 2.0})
    assert {words.plain(f, False) for f in ("Zorv Publishing", "Zorv Publishnig", "Zorv Pub.", "The Zorv Publishers, 1900")} == {"publishing zorv"}


def test_words_settle_as_by_comparison_with_all():
    rng = random.Random(12)
    words = N.Vocabulary({"publishing": 2.0, "historical": 3.0, "zorvelbuch": 2.0})
    for w in sorted(words.weights)[::3]:
        if len(w) >= 5:
            for _ in range(3):
                t = typo(rng, typo(rng, w) if len(w) >= 9 else w)
                most = 2 if len(t) >= 9 else 1
                near = [(n, v not in words.measured, words.weights[v], v) for v in words.weights if len(v) >= 4 for n in range(1, most + 1) if N.within_edits(t, v, n)]
                if t not in words.weights and t not in N.IDLE and len(t) >= 4 and not any(v.startswith(t) for v in words.weights):
                    assert words._common(t) == (min(near)[3] if near else t), (w, t)
