import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.functions.text import NO_PLACE
from folioforge.operators import places as P
from folioforge.operators.skew import hot_keys, salted_join

GAZ = "geonameid bigint, name string, asciiname string, alternatenames string, lat double, lon double, feature_class string, country string, admin1 string, population bigint"


@pytest.fixture(scope="module")
def gazetteer(spark):
    rows = [
        (1, "Athens", "Athens", None, 1.0, 1.0, "P", "US", "GA", 100), (2, "Athens", "Athens", None, 2.0, 2.0, "P", "US", "IL", 100),
        (3, "Lémont", "Lemont", "Athens,Keepataw", 3.0, 3.0, "P", "US", "IL", 900), (4, "Big", "Big", "New York", 4.0, 4.0, "P", "US", "NY", None),
        (5, "Hill", "Hill", None, 5.0, 5.0, "T", "US", "NY", 1), (6, "Twin", "Twin", "", 6.0, 6.0, "P", "GB", "", 5), (7, "Twin", "Twin", None, 7.0, 7.0, "P", "GB", None, 5),
    ]
    return spark.createDataFrame(rows, GAZ)


def test_index(gazetteer):
    rows = {(r.country, r.name_key, r.tier, r.geonameid) for r in P.gazetteer_index(gazetteer).collect()}
    assert ("us", "lemont", 1, 3) in rows and ("us", "athens", 2, 3) in rows and ("us", "keepataw", 2, 3) in rows
    assert not any(r[3] == 5 or r[1] == "" for r in rows)


def test_match_cascade(spark, gazetteer):
    probes = [
        ("a", "athens", "us", None), ("b", "athens", "US", "IL"), ("c", "keepataw", "us", "IL"), ("d", "athens ga", "us", "GA"), ("e", "new york", "us", "NY"),
        ("f", "twin", "gb", None), ("g", "nowhere", "us", None), ("h", "athens", None, None), ("i", None, "us", None), ("j", "athens", "us", "NY"),
    ]
    df = spark.createDataFrame(probes, "geo_key string, place string, country string, admin1 string")
    got = {r.geo_key: (r.geonameid, r.step, r.ambiguous) for r in P.match_places(df, P.gazetteer_index(gazetteer)).collect()}
    assert got == {"a": (1, 1, True), "b": (2, 1, False), "c": (3, 2, False), "d": (1, 3, False), "e": (4, 2, False), "f": (6, 1, True)}
    assert P.match_places(df.limit(0), P.gazetteer_index(gazetteer)).count() == 0


def test_override(spark, gazetteer):
    index = P.gazetteer_index(gazetteer)
    groups = spark.createDataFrame([("x", "candidate"), ("y", "candidate"), ("z", "008")], "geo_key string, geocode_policy string")
    probes = spark.createDataFrame([("x", "athens", "us", "GA"), ("z", "athens", "us", "GA")], "geo_key string, place string, country string, admin1 string")
    city = index.where("geonameid = 4 and tier = 1")
    got = {r.geo_key: (r.geonameid, r.geocode_reason) for r in P.override_city(P.match_places(probes, index), groups, city).collect()}
    assert got == {"x": (4, "city of several places"), "y": (4, "city of several places"), "z": (1, "direct")}


def test_keys_and_groups(spark):
    schema = "obs_id bigint, lccn string, places string, places_clean string, place_name_008 string, city_group string, several boolean"
    rows = [
        (1, "1", "A", "a", "R", "City", True), (2, "1", "B", "b", "R", "Other", True), (3, "2", "A", "a", "R", "City", True), (4, None, "A", "a", None, "City", True),
        (5, None, "B", "b", None, "Other", True), (6, "1", None, None, None, NO_PLACE, True), (7, "2", "A", "a", "R", "City", True),
    ]
    keyed = P.with_geo_key(spark.createDataFrame(rows, schema).drop("several"), "City")
    assert {r.obs_id: r.geo_key for r in keyed.collect()} == {1: "a||R||candidate", 2: "b||R", 3: "a||R", 4: "a||", 5: "b||", 6: "||", 7: "a||R"}
    groups = {r.geo_key: r.n_records for r in P.geo_groups(keyed).collect()}
    assert groups == {"a||R||candidate": 1, "b||R": 1, "a||R": 2, "a||": 1, "b||": 1}


def test_coalesce(spark):
    schema = "geo_key string, geonames_matched boolean, geonames_lat double, geonames_lon double, geonames_country_code string, geocode_policy string"
    direct = spark.createDataFrame([("a", True, 1.0, 1.0, "US", None), ("b", False, None, None, None, "008")], schema)
    second = spark.createDataFrame([("a", True, 9.0, 9.0, "GB", None), ("b", True, 2.0, 2.0, "GB", None), ("c", None, 3.0, 3.0, "FR", None)], schema)
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "geo_key string")
    got = {r.geo_key: (r.lat, r.country_code, r.geocode_policy_used, r.geocode_source) for r in P.coalesce_geocodes(df, direct, second).collect()}
    assert got == {"a": (1.0, "us", "direct_008", "direct"), "b": (2.0, "gb", "second", "second"), "c": (None, None, None, "unmatched"), None: (None, None, None, "unmatched")}
    with pytest.raises(ValueError):
        P.coalesce_geocodes(df, direct.union(direct), second)
    assert P.residual(df.where("geo_key is not null"), direct.where("geonames_matched")).count() == 2


def test_scopes(spark):
    countries = spark.createDataFrame([("France", "FR"), ("Georgia", "GE")], "name string, country string")
    regions = spark.createDataFrame([("Georgia", "US", "GA"), ("Ohio (State)", "US", "OH"), ("Cork", "IE", "C"), ("Cork", "US", "K")], "name string, country string, admin1 string")
    names = spark.createDataFrame([("Georgia",), ("Ohio",), ("Cork",), ("Ohio (State)",), ("Mars",), ("FRANCE",)], "name string")
    got = {r.name: (r.country, r.admin1) for r in P.scope_by_name(names, countries, regions).collect()}
    assert got == {"Georgia": ("GE", None), "Ohio": ("US", "OH"), "Cork": (None, None), "Ohio (State)": ("US", "OH"), "Mars": (None, None), "FRANCE": ("FR", None)}
    answers = spark.createDataFrame([("1", "X, Ohio, France"), ("2", "Ohio"), ("3", "X, Cork, Georgia"), ("4", None), ("5", "X, , Mars")], "geo_key string, normalized_place string")
    got = {r.geo_key: (r.country, r.admin1) for r in P.answer_scopes(answers, countries, regions).collect()}
    assert got == {"1": ("US", "OH"), "3": ("GE", None)}


def test_guards_and_dedup(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, k string")
    assert sorted(r.i for r in P.keep_first(df, ["k"], ["i"]).collect()) == [1, 3]
    with pytest.raises(ValueError):
        P.require_unique(df, ["k"])
    with pytest.raises(ValueError):
        P.require_columns(df, ["zz"])
    assert P.ensure_columns(df, {"n": "int", "i": "string"}).dtypes == [("i", "int"), ("k", "string"), ("n", "int")]


def test_normalizer(spark):
    df = spark.createDataFrame([("a||", "a"), ("b||", "b")], "geo_key string, places_clean string")
    got = {r.geo_key: r.normalized_place for r in P.normalize_remote(df, P.dictionary_normalizer({"a": "A, Ohio"})).collect()}
    assert got == {"a||": "A, Ohio", "b||": None}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_join(spark, how):
    left = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(600)] + [(999, None)], "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "k string, v int")
    assert hot_keys(left, ["k"], 0.5).count() == 1
    want, got = left.join(right, "k", how), salted_join(left, right, ["k"], how, salts=5, share=0.1)
    order = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert order(got) == order(want)


def test_retry_drops_the_state_however_it_is_written(spark):
    """A state goes whole; words that are no state lose the last one."""
    gazetteer = spark.createDataFrame(
        [(1, "Waterville", "P", "US", "NY", 10), (2, "Boston", "P", "US", "MA", 20), (3, "Springfield", "P", "US", "MA", 5), (4, "Washington", "P", "US", "DC", 5)],
        "geonameid bigint, name string, feature_class string, country string, admin1 string, population bigint",
    ).selectExpr("*", "name as asciiname", "cast(null as string) as alternatenames", "0.0D as lat", "0.0D as lon")
    probes = [
        ("a", "waterville new york", "NY", 1), ("b", "boston mass usa", "MA", 2), ("c", "boston ma", "MA", 2), ("d", "springfield massachusetts broadway", "MA", 3), ("e", "springfield heights", "MA", 3),
        ("f", "new york", "NY", None), ("g", "boston", "NY", None), ("h", "washington d c", "DC", 4), ("i", "s l", "MA", None), ("j", "", "MA", None), ("k", None, "MA", None), ("l", "mt boston mass", "MA", None),
    ]
    df = spark.createDataFrame([(k, p, "us", a) for k, p, a, _ in probes], "geo_key string, place string, country string, admin1 string")
    got = {r.geo_key: (r.geonameid, r.step) for r in P.match_places(df, P.gazetteer_index(gazetteer)).collect()}
    assert got == {k: (n, 3) for k, _, _, n in probes if n}


def test_many_variants_codes_and_regions(spark):
    """20,000 entries of a reference list are all read."""
    variants = spark.createDataFrame([(f"city {i}",) for i in range(20_000)] + [(None,)], "variant string")
    places = spark.createDataFrame([("city 19999",), ("town",), (None,), (" ",), ("city 1",)], "places_clean string")
    assert sorted(r.city_group for r in P.label_city(places, "places_clean", variants, "C").collect()) == ["C", "C", "No place of publication", "No place of publication", "Other"]
    words = ["".join("abcdefghij"[int(d)] for d in f"{i:05d}") for i in range(20_000)]
    regions = spark.createDataFrame([(w, f"r{i}") for i, w in enumerate(words)] + [("new york", "ny"), ("york", "yy")], "name string, code string")
    df = spark.createDataFrame([(f"foo {words[19_999]} street",), ("a new york", ), ("mt horeb",), ("s l",), (None,), ("",)], "p string")
    got = {r.p: r.canonical for r in P.canonical_by_table(df, "p", regions).collect()}
    assert got == {f"foo {words[19_999]} street": "foo r19999", "a new york": "a new yy", "mt horeb": "mt horeb", "s l": None, None: None, "": None}


def test_remote_answers(spark, tmp_path):
    """Three tries with growing pauses; what fails is asked again in the next run, what is finished is not."""
    from folioforge.sources.tables import append_answers

    tried, pauses = {}, []

    def call(row):
        tried[row["geo_key"]] = tried.get(row["geo_key"], 0) + 1
        if row["geo_key"] == "never" or row["geo_key"] == "late" and tried["late"] < 3:
            raise OSError
        return None if row["geo_key"] == "empty" else row["place"].title()

    ask = P.remote_normalizer(call, wait=pauses.append)
    batch = pd.DataFrame({"geo_key": ["now", "late", "never", "empty"], "place": ["a", "b", "c", "d"]})
    got = pd.concat(ask(iter([batch])))
    assert got.set_index("geo_key")["normalized_place"].to_dict() == {"now": "A", "late": "B", "empty": None}
    assert tried == {"now": 1, "late": 3, "never": 3, "empty": 1} and pauses == [1.0, 2.0, 1.0, 2.0]
    places = spark.createDataFrame([(k, k) for k in ("a", "b", "c")], "geo_key string, place string")
    flaky = P.remote_normalizer(lambda row: 1 / 0 if row["geo_key"] == "b" else "x", wait=lambda s: None)
    path = str(tmp_path / "answers")
    append_answers(P.normalize_remote(places, flaky), path)
    left = P.residual(places, P.finished_keys(spark.read.parquet(path)))
    assert [r.geo_key for r in left.collect()] == ["b"]
    done = spark.createDataFrame([("a", "True"), ("b", "false"), ("c", "1"), (None, "true")], "geo_key string, geonames_matched string")
    assert sorted(r.geo_key for r in P.finished_keys(done).collect()) == ["a", "c"]


def test_answers_are_geocoded(spark, gazetteer):
    countries = spark.createDataFrame([("Freedonia", "US")], "name string, country string")
    regions = spark.createDataFrame([("Illinois", "US", "IL"), ("Georgia", "US", "GA"), ("Twinland", "US", "X1"), ("Twinland", "GB", "X2")], "name string, country string, admin1 string")
    answers = spark.createDataFrame(
        [("a", "Athens, Illinois, Freedonia"), ("b", "Lemont, Freedonia"), ("c", "Athens"), ("d", "Athens, Nowhere"), ("e", None), ("f", ", Athens , , Georgia"), ("g", "Zzz, Illinois"), ("h", "Athens, Twinland")],
        "geo_key string, normalized_place string",
    )
    got = {r.geo_key: (r.admin1, r.geonameid, r.geonames_matched) for r in P.geocode_answers(answers, countries, regions, P.gazetteer_index(gazetteer)).collect()}
    assert got == {"a": ("IL", 2, True), "b": (None, 3, True), "c": (None, None, False), "d": (None, None, False), "e": (None, None, False), "f": ("GA", 1, True), "g": ("IL", None, False), "h": (None, None, False)}
    rows = P.crosswalk(spark.createDataFrame([("Illinois (State)",), ("Twinland",), ("Freedonia",), ("Zzz",), (None,)], "name string"), countries, regions).collect()
    assert [tuple(r) for r in rows] == [("Freedonia", "US", None, None), ("Illinois (State)", "US", "IL", None), ("Twinland", None, None, "ambiguous"), ("Zzz", None, None, "unresolved")]
