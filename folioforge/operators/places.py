"""Places: keys and groups, gazetteer matching, scopes, geocode joins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import NO_PLACE, NO_PLACE_MARKERS, canonical_place, city_label, clean_string, geo_key, match_key, strip_qualifier, strip_ws


def ensure_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds missing columns as typed nulls."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """The table itself; ValueError where a column is missing."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The table itself; ValueError where a key occurs twice.  Stops at the first."""
    if df.groupBy(*keys).count().where("count > 1").limit(1).count():
        raise ValueError(f"repeated keys in {', '.join(keys)}")
    return df


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; nulls equal each other."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where("__place = 1").drop("__place")


def label_city(df: DataFrame, cleaned: str, variants: DataFrame, city: str, into: str = "city_group") -> DataFrame:
    """Adds the city group of a cleaned place; ``variants(variant)`` has the cleaned names of the city, however many."""
    known = variants.where("variant is not null").select(F.col("variant").alias("__variant")).distinct().withColumn("__known", F.lit(True))
    joined = df.withColumn("__variant", strip_ws(F.col(cleaned))).join(known, "__variant", "left")
    return joined.withColumn(into, city_label(F.col(cleaned), F.col("__known"), city)).drop("__variant", "__known")


def canonical_by_table(df: DataFrame, column: str, regions: DataFrame, into: str = "canonical") -> DataFrame:
    """Adds the canonical form of a cleaned place, cut at its last region; ``regions(name, code)`` of any size.

    The same rule as :func:`canonical_place`, with names of up to three words from a table.
    """
    values = df.select(column).where(F.col(column).isNotNull()).distinct().withColumn("__t", strip_ws(F.col(column)))
    words = F.split("__t", " ")
    start = F.explode(F.sequence(F.lit(1), F.size(words)))
    grams = values.select(column, words.alias("__w"), start.alias("__j")).where(~((F.col("__j") == 1) & (F.size("__w") > 1) & (F.get("__w", F.lit(0)) == "mt")))
    grams = grams.withColumn("__n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).where("__j + __n - 1 <= size(__w)")
    grams = grams.withColumn("name", F.array_join(F.slice("__w", F.col("__j"), F.col("__n")), " "))
    known = regions.select("name", F.col("code").alias("__code")).dropDuplicates(["name"])
    # the last position that starts a region, there the longest name
    last = grams.join(known, "name").groupBy(column).agg(F.max(F.struct("__j", "__n", "__code")).alias("__hit"))
    found = values.join(last, column, "left")
    city = F.array_join(F.slice(words, F.lit(1), F.col("__hit.__j") - 1), " ")
    form = F.when(F.col("__hit").isNull(), F.col("__t")).otherwise(F.trim(F.concat_ws(" ", city, F.col("__hit.__code"))))
    form = F.when((F.col("__t") != "") & ~F.col("__t").isin(NO_PLACE_MARKERS), form)
    return df.join(found.select(column, form.alias(into)), column, "left")


def is_real(place: Column, group: Column) -> Column:
    return place.isNotNull() & (F.trim(place) != "") & ~group.eqNullSafe(NO_PLACE)


def with_geo_key(df: DataFrame, city: str) -> DataFrame:
    """Adds ``geocode_policy`` and ``geo_key``.

    The policy is ``candidate`` for a city row of a record with several distinct real
    places, else ``008``; a null lccn never has several.
    """
    real = F.when(is_real(F.col("places_clean"), F.col("city_group")), F.col("places_clean"))
    # aggregated before the join, so a hot lccn sends one row per map task and place
    several = df.where(F.col("lccn").isNotNull()).groupBy("lccn").agg((F.count_distinct(real) > 1).alias("several"))
    policy = F.when(F.coalesce("several", F.lit(False)) & F.col("city_group").eqNullSafe(city), "candidate").otherwise("008")
    keyed = df.join(several, "lccn", "left").withColumn("geocode_policy", policy).drop("several")
    return keyed.withColumn("geo_key", geo_key(F.col("places_clean"), F.col("place_name_008"), F.col("geocode_policy")))


def geo_groups(df: DataFrame, order: str = "obs_id") -> DataFrame:
    """One row for each key of rows with a place: first values by ``order`` and the number of rows."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(order), F.col(c))))[c]
    given = df.where(F.col("places_clean").isNotNull() & (F.trim("places_clean") != ""))
    columns = ["places_clean", "place_name_008", "geocode_policy", "places"]
    return given.groupBy("geo_key").agg(*[first(c).alias(c) for c in columns], F.count(F.lit(1)).alias("n_records"))


def gazetteer_index(gazetteer: DataFrame) -> DataFrame:
    """``country, name_key, tier`` and the entry of every cleaned name of a populated place.

    Tier 1 has names and plain names, tier 2 the alternate names that are neither.
    """
    primary = F.array_distinct(F.filter(F.array(clean_string(F.col("name")), clean_string(F.col("asciiname"))), lambda k: k.isNotNull() & (k != "")))
    alternate = F.transform(F.coalesce(F.split("alternatenames", ","), F.array().cast("array<string>")), lambda n: clean_string(n))
    rows = gazetteer.where("feature_class = 'P'").withColumns({"__one": primary, "__two": F.filter(F.array_except(alternate, primary), lambda k: k != "")})
    entry = [
        F.lower("country").alias("country"), "geonameid", "name", F.nullif(F.trim("admin1"), F.lit("")).alias("admin1"), "lat", "lon",
        F.coalesce("population", F.lit(0)).alias("population"),
    ]
    names = F.concat(
        F.transform("__one", lambda k: F.struct(k.alias("name_key"), F.lit(1).alias("tier"))), F.transform("__two", lambda k: F.struct(k.alias("name_key"), F.lit(2).alias("tier")))
    )
    return rows.select(*entry, F.explode(names).alias("__n")).select("__n.*", *[c if isinstance(c, str) else c for c in ("country", "geonameid", "name", "admin1", "lat", "lon", "population")])


def match_places(probes: DataFrame, index: DataFrame, key: str = "geo_key") -> DataFrame:
    """Best entry of each probe ``key, place, country, admin1``: a cascade of four steps.

    Name in tier 1, in tier 2, then its canonical form without the last word in either, so
    that a state goes whole however it is written.  Within the first step that has
    candidates in the scope the largest population wins, ties the least id; ``ambiguous``
    says that there were several.  Probes without candidates have no row.
    """
    words = F.split("__canonical", " ")
    short = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    short = F.when(short != F.col("place"), short)
    names = F.array(F.struct(F.lit(0).alias("step"), F.col("place").alias("name_key")), F.struct(F.lit(2).alias("step"), F.nullif(short, F.lit("")).alias("name_key")))
    # a column of its own, so that it is worked out once
    given = probes.where("place is not null and country is not null").withColumn("__canonical", canonical_place(F.col("place")))
    tried = given.select(key, F.lower("country").alias("country"), F.col("admin1").alias("__admin"), F.inline(names)).where("name_key is not null")
    found = tried.join(index, ["country", "name_key"]).where(F.col("__admin").isNull() | (F.col("admin1") == F.col("__admin")))
    # an entry may be reached by several of its names in one step; it is one candidate
    found = found.withColumn("step", F.col("step") + F.col("tier")).dropDuplicates([key, "step", "geonameid"])
    order = Window.partitionBy(key).orderBy("step", F.col("population").desc(), "geonameid")
    ranked = found.withColumns({"__place": F.row_number().over(order), "__n": F.count(F.lit(1)).over(Window.partitionBy(key, "step"))})
    best = ranked.where("__place = 1")
    return best.select(key, "geonameid", "name", "country", "admin1", "lat", "lon", "step", (F.col("__n") > 1).alias("ambiguous"))


def override_city(matched: DataFrame, groups: DataFrame, city_entry: DataFrame, key: str = "geo_key") -> DataFrame:
    """Candidates whose match is missing or outside the city's region get the city's own entry.

    ``city_entry`` has one row.  Adds ``geocode_reason``.
    """
    fields = ["geonameid", "name", "country", "admin1", "lat", "lon"]
    city = city_entry.select(*[F.col(c).alias(f"__{c}") for c in fields])
    rows = groups.select(key, "geocode_policy").join(matched, key, "left").join(F.broadcast(city.limit(1)), how="left")
    inside = F.col("country").eqNullSafe(F.col("__country")) & F.col("admin1").eqNullSafe(F.col("__admin1"))
    swap = (F.col("geocode_policy") == "candidate") & (F.col("geonameid").isNull() | ~inside)
    reason = F.when(swap, "city of several places").when(F.col("geonameid").isNull(), "no candidate").when(F.col("ambiguous"), "ambiguous").otherwise("direct")
    chosen = {c: F.when(swap, F.col(f"__{c}")).otherwise(F.col(c)) for c in fields}
    out = rows.select(key, "geocode_policy", *[v.alias(c) for c, v in chosen.items()], reason.alias("geocode_reason"))
    return out.withColumn("geonames_matched", F.col("geonameid").isNotNull())


def coalesce_geocodes(df: DataFrame, direct: DataFrame, second: DataFrame, key: str = "geo_key") -> DataFrame:
    """Coordinates from ``direct`` where matched, else from ``second``, else none.

    Both result tables must have each key once, else ValueError.  Adds ``lat, lon,
    country_code, geocode_policy_used, geocode_source``.
    """
    columns = ["geonames_matched", "geonames_lat", "geonames_lon", "geonames_country_code", "geocode_policy"]
    sides = {"d": require_unique(direct, [key]), "s": require_unique(second, [key])}
    for name, side in sides.items():
        df = df.join(side.select(key, *[F.col(c).alias(f"__{name}_{c}") for c in columns]), key, "left")
    hit, other = F.coalesce("__d_geonames_matched", F.lit(False)), F.coalesce("__s_geonames_matched", F.lit(False))
    pick = lambda c: F.when(hit, F.col(f"__d_{c}")).when(other, F.col(f"__s_{c}"))
    out = df.withColumns(
        {
            "lat": pick("geonames_lat"), "lon": pick("geonames_lon"), "country_code": F.lower(pick("geonames_country_code")),
            "geocode_policy_used": F.when(hit, F.coalesce("__d_geocode_policy", F.lit("direct_008"))).when(other, F.coalesce("__s_geocode_policy", F.lit("second"))),
            "geocode_source": F.when(hit, "direct").when(other, "second").otherwise("unmatched"),
        }
    )
    return out.drop(*[f"__{n}_{c}" for n in sides for c in columns])


def residual(keys: DataFrame, *done: DataFrame, key: str = "geo_key") -> DataFrame:
    """Keys that are in none of the finished tables."""
    for other in done:
        keys = keys.join(other.select(key), key, "left_anti")
    return keys


def scope_by_name(names: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """``name, country, admin1``: a country of that name first, else the only region.

    ``countries(name, country)``, ``regions(name, country, admin1)``.  A region name found in
    several countries, and an unknown name, give nulls.
    """
    asked = names.select("name").distinct().withColumn("__k", match_key(strip_qualifier(F.col("name"))))
    national = countries.select(match_key(F.col("name")).alias("__k"), F.col("country").alias("__national")).dropDuplicates(["__k"])
    regional = regions.select(match_key(strip_qualifier(F.col("name"))).alias("__k"), "country", "admin1")
    regional = regional.groupBy("__k").agg(F.count_distinct("country").alias("__n"), F.min(F.struct("country", "admin1")).alias("__r"))
    rows = asked.join(national, "__k", "left").join(regional, "__k", "left")
    sole = F.when(F.col("__n") == 1, F.col("__r"))
    country = F.coalesce("__national", sole["country"])
    return rows.select("name", country.alias("country"), F.when(F.col("__national").isNull(), sole["admin1"]).alias("admin1"))


def answer_scopes(answers: DataFrame, countries: DataFrame, regions: DataFrame, key: str = "geo_key", text: str = "normalized_place") -> DataFrame:
    """Scope of an answer ``Place, Region, Country``: its rightmost region, else its rightmost country.

    Answers of fewer than two parts, and of unknown or ambiguous parts only, have no row.
    """
    # blank parts do not count
    given = F.filter(F.transform(F.split(text, ","), lambda p: strip_ws(p)), lambda p: p != "")
    parts = answers.select(key, F.posexplode(given).alias("pos", "name")).where("pos > 0")
    scoped = parts.join(scope_by_name(parts, countries, regions), "name").where("country is not null")
    order = Window.partitionBy(key).orderBy(F.col("admin1").isNotNull().desc(), F.col("pos").desc())
    return scoped.withColumn("__place", F.row_number().over(order)).where("__place = 1").select(key, "country", "admin1")


def finished_keys(done: DataFrame, key: str = "geo_key", matched: str = "geonames_matched") -> DataFrame:
    """The keys that need no second answer: the matched ones, or all of a list that has keys only."""
    if matched in done.columns:
        done = done.where(F.lower(F.trim(F.col(matched).cast("string"))).isin("true", "1"))
    return done.select(key).where(F.col(key).isNotNull())


def crosswalk(names: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """``place_name_008, country, admin1, note`` of every name, sorted; unresolved and ambiguous ones have a note and no scope."""
    scoped = scope_by_name(names.where("name is not null"), countries, regions)
    several = regions.select(match_key(strip_qualifier(F.col("name"))).alias("__k"), "country").groupBy("__k").agg((F.count_distinct("country") > 1).alias("__several"))
    rows = scoped.withColumn("__k", match_key(strip_qualifier(F.col("name")))).join(several, "__k", "left")
    note = F.when(F.col("country").isNull(), F.when(F.col("__several"), "ambiguous").otherwise("unresolved"))
    return rows.select(F.col("name").alias("place_name_008"), "country", "admin1", note.alias("note")).orderBy("place_name_008")


def geocode_answers(answers: DataFrame, countries: DataFrame, regions: DataFrame, index: DataFrame, key: str = "geo_key", text: str = "normalized_place") -> DataFrame:
    """Every answer ``Place, Region, Country`` with its scope and the entry matched in it, or nulls.

    The first part is the place, cleaned before it is matched.
    """
    scopes = answer_scopes(answers, countries, regions, key, text)
    parts = F.filter(F.transform(F.split(text, ","), lambda p: strip_ws(p)), lambda p: p != "")
    probes = answers.select(key, clean_string(F.get(parts, F.lit(0))).alias("place")).join(scopes, key)
    found = match_places(probes.where("place <> ''"), index, key).select(key, "geonameid", "name", "lat", "lon", "ambiguous")
    out = answers.select(key, text).join(scopes, key, "left").join(found, key, "left")
    return out.withColumn("geonames_matched", F.col("geonameid").isNotNull())


def normalize_remote(places: DataFrame, normalizer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], key: str = "geo_key") -> DataFrame:
    """``key, normalized_place`` from a pluggable normaliser over batches, each partition by itself."""
    return places.mapInPandas(normalizer, f"{key} string, normalized_place string")


def remote_normalizer(call: Callable[[dict], str | None], tries: int = 3, wait: Callable[[float], None] = time.sleep, key: str = "geo_key"):
    """A normaliser that asks ``call`` for each row, up to ``tries`` times with pauses of 1, 2, 4 ... seconds.

    A row that fails every time has no answer and is left out, so the next run asks again;
    an answer of none is an answer.
    """

    def ask(row: dict) -> tuple[bool, str | None]:
        for attempt in range(tries):
            try:
                return True, call(row)
            except Exception:
                if attempt + 1 < tries:
                    wait(2.0**attempt)
        return False, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = [(row[key], *ask(row)) for row in batch.to_dict("records")]
            yield pd.DataFrame([(k, a) for k, good, a in answers if good], columns=[key, "normalized_place"])

    return run


def dictionary_normalizer(answers: dict[str, str], key: str = "geo_key", place: str = "places_clean"):
    """An offline normaliser that looks places up."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({key: batch[key], "normalized_place": [answers.get(p) for p in batch[place]]})

    return run
