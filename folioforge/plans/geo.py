"""Queries over places, gazetteer and geocodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import NO_PLACE, geo_key, normalize_lccn, place_hint, flatten_hierarchy
from folioforge.operators import places as P
from folioforge.plans import oracle as O
from folioforge.session import table

CITY = "Vorham"
#: The country of the map, and its box: longitudes and latitudes, inclusive.
MAP_COUNTRY = "xa"
BOX = (-125.0, -66.0, 24.0, 60.0)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "imprint_places")


def _keyed(spark, sf_dir):
    return P.with_geo_key(_rows(spark, sf_dir), CITY)


def geo_key_policy(spark, sf_dir):
    return _keyed(spark, sf_dir).select("obs_id", "geocode_policy", "geo_key")


def geo_groups(spark, sf_dir):
    return P.geo_groups(_keyed(spark, sf_dir))


def places_per_record(spark, sf_dir):
    real = F.when(P.is_real(F.col("places_clean"), F.col("city_group")), F.col("places_clean"))
    return _rows(spark, sf_dir).where("lccn is not null").groupBy("lccn").agg(F.count_distinct(real).alias("places"))


def dedup_rows(spark, sf_dir):
    """First row of each record, place and year; the record is its lccn or, without one, its source id."""
    record = F.coalesce(F.nullif(F.trim("lccn"), F.lit("")), F.col("source_record_id"))
    rows = _rows(spark, sf_dir).withColumn("record", record)
    return P.keep_first(rows, ["record", "places_clean", "year_min"], ["obs_id"]).select("obs_id", "record", "places_clean", "year_min")


def gazetteer_index(spark, sf_dir):
    return P.gazetteer_index(table(spark, sf_dir, "gazetteer")).select("country", "name_key", "tier", "geonameid", "admin1", "population")


def _scoped(spark, sf_dir):
    scopes = table(spark, sf_dir, "marc_place_008_geonames").where("geonames_country_code is not null")
    scopes = scopes.select("place_name_008", F.col("geonames_country_code").alias("country"), F.col("geonames_admin1_code").alias("admin1"))
    groups = P.geo_groups(_keyed(spark, sf_dir)).withColumn("place", F.trim("places_clean"))
    return groups, groups.join(scopes, "place_name_008").select("geo_key", "place", "country", "admin1")


def gazetteer_match(spark, sf_dir):
    _, probes = _scoped(spark, sf_dir)
    return P.match_places(probes, P.gazetteer_index(table(spark, sf_dir, "gazetteer"))).select("geo_key", "geonameid", "step", "ambiguous")


def direct_geocode(spark, sf_dir):
    groups, probes = _scoped(spark, sf_dir)
    index = P.gazetteer_index(table(spark, sf_dir, "gazetteer"))
    city = index.where((F.col("name") == CITY) & (F.col("tier") == 1)).orderBy(F.col("population").desc(), "geonameid").limit(1)
    found = P.override_city(P.match_places(probes, index), groups, city)
    return found.select("geo_key", "geocode_policy", "geonameid", "geocode_reason", "geonames_matched")


def residual_keys(spark, sf_dir):
    """Groups that no finished geocode covers."""
    done = table(spark, sf_dir, "geocode_results").where("geonames_matched")
    return P.residual(P.geo_groups(_keyed(spark, sf_dir)).select("geo_key", "n_records"), done)


def _geocodes(spark, sf_dir):
    """The geocode table has repeated rows: first by content."""
    order = [F.col("geocode_policy").asc_nulls_first(), "geonames_lat", "geonames_lon", "geocode_reason"]
    every = table(spark, sf_dir, "geocode_results").where("geo_key is not null")
    return P.keep_first(every, ["geo_key"], [F.col("geonames_matched").desc(), *order])


def _coded(spark, sf_dir):
    every = _geocodes(spark, sf_dir)
    direct, second = every.where("geocode_policy = '008'"), every.where("geocode_policy is null")
    rows = _rows(spark, sf_dir).withColumn("geo_key", geo_key(F.col("places_clean"), F.col("place_name_008")))
    return P.coalesce_geocodes(rows, direct, second)


def coalesce_join(spark, sf_dir):
    return _coded(spark, sf_dir).select("obs_id", "geo_key", "lat", "lon", "country_code", "geocode_policy_used", "geocode_source")


def source_counts(spark, sf_dir):
    """Rows and per cent of each geocode source."""
    by = _coded(spark, sf_dir).groupBy("geocode_source").agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("geocode_source", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def coordinate_counts(spark, sf_dir):
    """Rows at each coordinate of the country inside the box, and whether any is of the city."""
    west, east, south, north = BOX
    inside = (F.col("country_code") == MAP_COUNTRY) & F.col("lon").between(west, east) & F.col("lat").between(south, north)
    return _coded(spark, sf_dir).where(inside).groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("city_group").eqNullSafe(CITY)).alias("in_city"))


def marker_sizes(spark, sf_dir):
    """Marker sizes of the coordinates of a map, comparable over all of them."""
    from folioforge.operators.series import marker_size

    counts = coordinate_counts(spark, sf_dir)
    largest = counts.agg(F.max("n").alias("largest"))
    return counts.crossJoin(F.broadcast(largest)).select("lat", "lon", F.round(marker_size(F.col("n"), F.col("largest")), 6).alias("size"))


def peak_split(spark, sf_dir):
    """Rows at each coordinate up to and after the city's peak year."""
    from folioforge.plans.series import peak_year

    peak = peak_year(spark, sf_dir).select(F.col("year_min").alias("peak"))
    years = _rows(spark, sf_dir).where("year_min between 1900 and 2010").select("obs_id", "year_min")
    rows = _coded(spark, sf_dir).drop("year_min").where("lat is not null").join(years, "obs_id").join(F.broadcast(peak), how="cross")
    part = F.when(F.col("year_min") <= F.col("peak"), "to peak").otherwise("after").alias("part")
    return rows.groupBy(part, "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def coverage_report(spark, sf_dir):
    """Groups and rows that a geocode covers, with and without an 008 place."""
    groups = P.geo_groups(_keyed(spark, sf_dir))
    found = _geocodes(spark, sf_dir).select("geo_key", F.coalesce("geonames_matched", F.lit(False)).alias("hit"), F.coalesce(F.col("geocode_reason") == "ambiguous", F.lit(False)).alias("amb"))
    rows = groups.join(found, "geo_key", "left").withColumn("has_008", F.col("place_name_008").isNotNull())
    hit = F.coalesce("hit", F.lit(False))
    return rows.groupBy("has_008").agg(
        F.count(F.lit(1)).alias("groups"), F.sum("n_records").alias("records"), F.count_if(hit).alias("groups_hit"),
        F.sum(F.when(hit, F.col("n_records")).otherwise(0)).alias("records_hit"), F.count_if(F.coalesce("amb", F.lit(False))).alias("ambiguous"),
    )


def agreement_matrix(spark, sf_dir):
    """Old and new city label of each record: any row labelled so, and a 752 city of the name."""
    old = _rows(spark, sf_dir).where("rec_id is not null").groupBy("rec_id").agg(F.bool_or(F.col("city_group").eqNullSafe(CITY)).alias("old"))
    named = F.exists(
        F.coalesce("place_hierarchy_752", F.array().cast("array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>")),
        lambda o: F.coalesce(F.exists(o["subfields"], lambda s: F.coalesce((s["code"] == "d") & (F.trim(s["text"]) == CITY), F.lit(False))), F.lit(False)),
    )
    new = table(spark, sf_dir, "marc_records").select("rec_id", named.alias("new"))
    return old.join(new, "rec_id").groupBy("old", "new").agg(F.count(F.lit(1)).alias("records"))


def group_counts(spark, sf_dir):
    by = _rows(spark, sf_dir).groupBy("city_group").agg(F.count(F.lit(1)).alias("n"))
    return by.crossJoin(F.broadcast(by.agg(F.sum("n").alias("total")))).select("city_group", "n", F.round(100.0 * F.col("n") / F.col("total"), 6).alias("percent"))


def repeated_pct(spark, sf_dir):
    """Per cent of the distinct lccn that occur more than once."""
    keys = _rows(spark, sf_dir).select(F.trim("lccn").alias("k")).where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    pct = F.coalesce(F.try_divide(100.0 * F.count_if(F.col("n") > 1), F.count(F.lit(1))), F.lit(0.0))
    return keys.agg(F.count(F.lit(1)).alias("keys"), F.round(pct, 6).alias("percent"))


def lccn_join(spark, sf_dir):
    """Rows with the title of the first record of their normalised lccn."""
    rec = table(spark, sf_dir, "marc_records").withColumn("k", normalize_lccn(F.col("lccn"))).where("k is not null")
    first = P.keep_first(rec, ["k"], ["rec_id"]).select("k", F.col("rec_id").alias("first_rec"), "title")
    rows = _rows(spark, sf_dir).select("obs_id", normalize_lccn(F.col("lccn")).alias("k"))
    return rows.join(first, "k", "left").select("obs_id", "k", "first_rec", "title")


def semi_several(spark, sf_dir):
    """Rows of records with at most one real place, a semi join."""
    k = _rows(spark, sf_dir).where("lccn is not null").groupBy("lccn").agg(F.count_if(P.is_real(F.col("places_clean"), F.col("city_group"))).alias("k"))
    return _rows(spark, sf_dir).join(k.where("k <= 1"), "lccn", "left_semi").select("obs_id", "lccn")


def place_hints(spark, sf_dir):
    """Context lines of each record: first 008 place and first 752 line."""
    first = _rows(spark, sf_dir).where("place_name_008 is not null").groupBy("rec_id").agg(F.min_by("place_name_008", "obs_id").alias("name"))
    lines = table(spark, sf_dir, "marc_records").select("rec_id", F.get(flatten_hierarchy(F.col("place_hierarchy_752")), F.lit(0)).alias("line"))
    return lines.join(first, "rec_id", "left").select("rec_id", place_hint(F.col("name"), F.col("line")).alias("hint"))


def _scopes(spark, sf_dir):
    codes = table(spark, sf_dir, "marc_place_008_geonames")
    regions = codes.where("geonames_admin1_code is not null").select(F.col("place_name_008").alias("name"), F.col("geonames_country_code").alias("country"), F.col("geonames_admin1_code").alias("admin1"))
    countries = codes.where("geonames_country_code is not null and geonames_admin1_code is null").select(F.col("place_name_008").alias("name"), F.col("geonames_country_code").alias("country"))
    return countries, regions


def scope_names(spark, sf_dir):
    """Scope of every country-code name."""
    names = table(spark, sf_dir, "marc_country_codes").select("name")
    return P.scope_by_name(names, *_scopes(spark, sf_dir))


def answer_scopes(spark, sf_dir):
    """Scopes of typed places read as ``place, region``."""
    answers = _rows(spark, sf_dir).where("places is not null").select(F.col("places").alias("geo_key"), F.col("places").alias("normalized_place")).distinct()
    return P.answer_scopes(answers, *_scopes(spark, sf_dir))


def disambiguation_samples(spark, sf_dir):
    """Groups whose place names occur in several regions of the gazetteer, beside the entry matched in their scope."""
    index = P.gazetteer_index(table(spark, sf_dir, "gazetteer"))
    several = index.where("tier = 1").groupBy("name_key").agg(F.count_distinct("country", "admin1").alias("n")).where("n > 1")
    groups, probes = _scoped(spark, sf_dir)
    asked = groups.join(several.select(F.col("name_key").alias("places_clean")), "places_clean", "left_semi")
    found = P.match_places(probes, index).select("geo_key", "name", "admin1", "ambiguous")
    return asked.join(found, "geo_key", "left").select("places_clean", "place_name_008", F.col("name").isNotNull().alias("geonames_matched"), "name", "admin1", "ambiguous", "n_records")


def seeded_sample(spark, sf_dir):
    """Twenty keys in the order of a seeded hash; a sampling operator."""
    groups = P.geo_groups(_keyed(spark, sf_dir))
    return groups.orderBy(F.md5(F.concat(F.lit("42:"), F.col("geo_key"))), "geo_key").limit(20).select("geo_key").orderBy("geo_key")


def top_groups(spark, sf_dir):
    """The ten keys of most rows, ties by key."""
    return P.geo_groups(_keyed(spark, sf_dir)).orderBy(F.col("n_records").desc(), "geo_key").limit(10).select("geo_key", "n_records")


def prefix_cube(spark, sf_dir):
    """City and other rows by class letter and prefix, and year."""
    from folioforge.functions.classes import class_prefixes

    rec = table(spark, sf_dir, "marc_records")
    keys = rec.select("rec_id", F.explode(F.array_union(class_prefixes(F.col("classifications")), class_prefixes(F.col("classifications"), 1))).alias("prefix"))
    rows = _rows(spark, sf_dir).where("year_min is not null").where(~F.col("city_group").eqNullSafe(NO_PLACE)).select("rec_id", "year_min", "city_group")
    city = F.col("city_group").eqNullSafe(CITY)
    return rows.join(keys, "rec_id").groupBy("prefix", "year_min").agg(F.count_if(city).alias("city_n"), F.count_if(~city).alias("other_n"))


def special_totals(spark, sf_dir):
    """City and other rows by year over all records, those with and those without a PS number."""
    from folioforge.functions.classes import class_prefixes

    rec = table(spark, sf_dir, "marc_records").select("rec_id", F.array_contains(class_prefixes(F.col("classifications")), "PS").alias("has_ps"))
    rows = _rows(spark, sf_dir).where("year_min is not null").where(~F.col("city_group").eqNullSafe(NO_PLACE)).join(rec, "rec_id")
    city = F.col("city_group").eqNullSafe(CITY)
    by = rows.groupingSets([[F.col("year_min")], [F.col("has_ps"), F.col("year_min")]], "has_ps", "year_min").agg(
        F.count_if(city).alias("city_n"), F.count_if(~city).alias("other_n"), F.grouping("has_ps").alias("g")
    )
    return by.select(F.when(F.col("g") == 1, "all").when(F.col("has_ps"), "PS").otherwise("not_PS").alias("special"), "year_min", "city_n", "other_n")


QUERIES = {
    f.__name__: f
    for f in (
        geo_key_policy, geo_groups, places_per_record, dedup_rows, gazetteer_index, gazetteer_match, direct_geocode, residual_keys, coalesce_join, source_counts,
        coordinate_counts, marker_sizes, peak_split, coverage_report, agreement_matrix, group_counts, repeated_pct, lccn_join, semi_several, place_hints, scope_names, answer_scopes,
        disambiguation_samples, seeded_sample, top_groups, prefix_cube, special_totals,
    )
}

_REAL = f"(places_clean IS NOT NULL AND trim(places_clean) <> '' AND city_group IS DISTINCT FROM '{NO_PLACE}')"
_KEYED = f"""several AS (SELECT lccn, count(DISTINCT CASE WHEN {_REAL} THEN places_clean END) > 1 AS several FROM imprint_places WHERE lccn IS NOT NULL GROUP BY 1),
keyed AS (
  SELECT p.*, CASE WHEN coalesce(several, false) AND city_group IS NOT DISTINCT FROM '{CITY}' THEN 'candidate' ELSE '008' END AS geocode_policy,
    coalesce(trim(places_clean), '') || '||' || coalesce(trim(place_name_008), '') || CASE WHEN coalesce(several, false) AND city_group IS NOT DISTINCT FROM '{CITY}' THEN '||candidate' ELSE '' END AS geo_key
  FROM imprint_places p LEFT JOIN several USING (lccn)
)"""
_GROUPS = f"""{_KEYED},
groups AS (
  SELECT geo_key, arg_min(places_clean, obs_id) AS places_clean, arg_min(place_name_008, obs_id) FILTER (place_name_008 IS NOT NULL) AS place_name_008,
    arg_min(geocode_policy, obs_id) AS geocode_policy, arg_min(places, obs_id) FILTER (places IS NOT NULL) AS places, count(*) AS n_records
  FROM keyed WHERE places_clean IS NOT NULL AND trim(places_clean) <> '' GROUP BY 1
)"""
_INDEX = f"""names AS (
  SELECT g.*, list_filter(list_distinct([{O.cleaned('name')}, {O.cleaned('asciiname')}]), lambda k: k IS NOT NULL AND k <> '') AS one,
    list_distinct(list_transform(string_split(alternatenames, ','), lambda n: {O.cleaned('n')})) AS two FROM gazetteer g WHERE feature_class = 'P'
), idx AS (
  SELECT lower(country) AS country, unnest(one) AS name_key, 1 AS tier, geonameid, name, nullif(trim(admin1), '') AS admin1, coalesce(population, 0) AS population FROM names
  UNION ALL SELECT lower(country), unnest(list_filter(two, lambda k: k <> '' AND NOT list_contains(one, k))), 2, geonameid, name, nullif(trim(admin1), ''), coalesce(population, 0) FROM names
)"""
_MATCH = f"""{_GROUPS}, {_INDEX},
probes AS (SELECT geo_key, trim(g.places_clean) AS place, lower(geonames_country_code) AS country, geonames_admin1_code AS scope
  FROM groups g JOIN marc_place_008_geonames USING (place_name_008) WHERE geonames_country_code IS NOT NULL),
canon AS ({O.canonical('SELECT DISTINCT place FROM probes', 'place', O.states())}),
tried AS (SELECT geo_key, country, scope, 0 AS step, place AS name_key FROM probes
  UNION ALL SELECT geo_key, country, scope, 2, regexp_replace(canonical, ' [^ ]*$', '') FROM probes JOIN canon USING (place)
    WHERE contains(canonical, ' ') AND regexp_replace(canonical, ' [^ ]*$', '') <> place),
found AS (SELECT DISTINCT geo_key, step + tier AS step, geonameid, population, i.country, admin1 FROM tried JOIN idx i USING (country, name_key) WHERE scope IS NULL OR admin1 = scope),
ranked AS (SELECT *, row_number() OVER (PARTITION BY geo_key ORDER BY step, population DESC, geonameid) AS k, count(*) OVER (PARTITION BY geo_key, step) AS n FROM found),
best AS (SELECT geo_key, geonameid, CAST(step AS INT) AS step, n > 1 AS ambiguous, country, admin1 FROM ranked WHERE k = 1)"""
_CODES = """codes AS (
  SELECT * FROM geocode_results WHERE geo_key IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY geo_key ORDER BY geonames_matched DESC NULLS LAST, geocode_policy NULLS FIRST, geonames_lat NULLS FIRST, geonames_lon NULLS FIRST, geocode_reason NULLS FIRST) = 1
)"""
_CODED = f"""{_CODES}, rows_ AS (SELECT *, coalesce(trim(places_clean), '') || '||' || coalesce(trim(place_name_008), '') AS geo_key FROM imprint_places),
coded AS (
  SELECT obs_id, geo_key, city_group, CASE WHEN m THEN geonames_lat END AS lat, CASE WHEN m THEN geonames_lon END AS lon, CASE WHEN m THEN lower(geonames_country_code) END AS country_code,
    CASE WHEN m AND geocode_policy = '008' THEN '008' WHEN m THEN 'second' END AS geocode_policy_used, CASE WHEN m AND geocode_policy = '008' THEN 'direct' WHEN m THEN 'second' ELSE 'unmatched' END AS geocode_source
  FROM (SELECT r.obs_id, geo_key, r.city_group, c.*, coalesce(geonames_matched, false) AND (geocode_policy = '008' OR geocode_policy IS NULL) AS m FROM rows_ r LEFT JOIN codes c USING (geo_key))
)"""
_BOXED = f"boxed AS (SELECT lat, lon, count(*) AS n FROM coded WHERE country_code = '{MAP_COUNTRY}' AND lon BETWEEN {BOX[0]} AND {BOX[1]} AND lat BETWEEN {BOX[2]} AND {BOX[3]} GROUP BY 1, 2)"
_LCCN = """CASE WHEN regexp_matches(lower({0}), '\\d') THEN regexp_extract(lower({0}), '([a-z]*)\\s*(\\d+)', 1)
  || CASE WHEN regexp_full_match(regexp_extract(lower({0}), '([a-z]*)\\s*(\\d+)', 2), '0+') THEN '0' ELSE ltrim(regexp_extract(lower({0}), '([a-z]*)\\s*(\\d+)', 2), '0') END END"""
_BARE = "regexp_replace({0}, '(?i)\\s*\\(\\s*(state|province)\\s*\\)\\s*$', '')"
_SCOPE = f"""nat AS (SELECT {O.ascii_key('place_name_008')} AS k, min(geonames_country_code) AS national FROM marc_place_008_geonames WHERE geonames_country_code IS NOT NULL AND geonames_admin1_code IS NULL GROUP BY 1),
reg AS (SELECT {O.ascii_key(_BARE.format('place_name_008'))} AS k, count(DISTINCT geonames_country_code) AS n, min(geonames_country_code) AS c, min(geonames_admin1_code) AS a
  FROM marc_place_008_geonames WHERE geonames_admin1_code IS NOT NULL GROUP BY 1)"""
_SCOPED = "SELECT name, coalesce(national, CASE WHEN n = 1 THEN c END) AS country, CASE WHEN national IS NULL AND n = 1 THEN a END AS admin1"
_PREFIX = "list_filter(list_transform(coalesce(classifications, []), lambda c: regexp_extract(c, '^([A-Z]+)(\\d+)?', 1)), lambda p: p <> '')"
_CUBE = f"count(*) FILTER (city_group IS NOT DISTINCT FROM '{CITY}') AS city_n, count(*) FILTER (city_group IS DISTINCT FROM '{CITY}') AS other_n"
_PLACED = f"year_min IS NOT NULL AND city_group IS DISTINCT FROM '{NO_PLACE}'"

SQL = {
    "geo_key_policy": f"WITH {_KEYED} SELECT obs_id, geocode_policy, geo_key FROM keyed",
    "geo_groups": f"WITH {_GROUPS} SELECT * FROM groups",
    "places_per_record": f"SELECT lccn, count(DISTINCT CASE WHEN {_REAL} THEN places_clean END) AS places FROM imprint_places WHERE lccn IS NOT NULL GROUP BY 1",
    "dedup_rows": """SELECT obs_id, record, places_clean, year_min FROM (SELECT *, coalesce(nullif(trim(lccn), ''), source_record_id) AS record FROM imprint_places)
QUALIFY row_number() OVER (PARTITION BY record, places_clean, year_min ORDER BY obs_id) = 1""",
    "gazetteer_index": f"WITH {_INDEX} SELECT country, name_key, tier, geonameid, admin1, population FROM idx",
    "gazetteer_match": f"WITH {_MATCH} SELECT geo_key, geonameid, step, ambiguous FROM best",
    "direct_geocode": f"""WITH {_MATCH}, city AS (SELECT geonameid AS cid, country AS cc, admin1 AS ca FROM idx WHERE name = '{CITY}' AND tier = 1 ORDER BY population DESC, geonameid LIMIT 1),
s AS (SELECT geo_key, geocode_policy, geonameid, ambiguous, cid, geocode_policy = 'candidate' AND (geonameid IS NULL OR NOT (country IS NOT DISTINCT FROM cc AND admin1 IS NOT DISTINCT FROM ca)) AS swap
  FROM groups LEFT JOIN best USING (geo_key) CROSS JOIN city)
SELECT geo_key, geocode_policy, CASE WHEN swap THEN cid ELSE geonameid END AS geonameid,
  CASE WHEN swap THEN 'city of several places' WHEN geonameid IS NULL THEN 'no candidate' WHEN ambiguous THEN 'ambiguous' ELSE 'direct' END AS geocode_reason, CASE WHEN swap THEN cid ELSE geonameid END IS NOT NULL AS geonames_matched FROM s""",
    "disambiguation_samples": f"""WITH {_MATCH}, shared AS (SELECT name_key FROM idx WHERE tier = 1 GROUP BY 1 HAVING count(DISTINCT CASE WHEN admin1 IS NOT NULL AND country IS NOT NULL THEN country || '.' || admin1 END) > 1)
SELECT g.places_clean, place_name_008, b.geonameid IS NOT NULL AS geonames_matched, e.name, b.admin1, b.ambiguous, n_records
FROM groups g LEFT JOIN best b USING (geo_key) LEFT JOIN gazetteer e ON e.geonameid = b.geonameid WHERE places_clean IN (SELECT name_key FROM shared)""",
    "residual_keys": f"WITH {_GROUPS} SELECT geo_key, n_records FROM groups WHERE geo_key NOT IN (SELECT geo_key FROM geocode_results WHERE geonames_matched AND geo_key IS NOT NULL)",
    "coalesce_join": f"WITH {_CODED} SELECT obs_id, geo_key, lat, lon, country_code, geocode_policy_used, geocode_source FROM coded",
    "source_counts": f"WITH {_CODED} SELECT geocode_source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM coded), 6) AS percent FROM coded GROUP BY 1",
    "coordinate_counts": f"WITH {_CODED} SELECT lat, lon, count(*) AS n, bool_or(city_group IS NOT DISTINCT FROM '{CITY}') AS in_city FROM coded WHERE country_code = '{MAP_COUNTRY}' AND lon BETWEEN {BOX[0]} AND {BOX[1]} AND lat BETWEEN {BOX[2]} AND {BOX[3]} GROUP BY 1, 2",
    "marker_sizes": f"WITH {_CODED}, {_BOXED} SELECT lat, lon, round(4.0 + 396.0 * sqrt(n) / (SELECT sqrt(max(n)) FROM boxed), 6) AS size FROM boxed",
    "peak_split": f"""WITH {_CODED}, y AS (SELECT year_min, round(100.0 * count(*) FILTER (city_group IS NOT DISTINCT FROM '{CITY}') / count(*), 6) AS share FROM imprint_places
  WHERE year_min BETWEEN 1900 AND 2010 AND city_group IS DISTINCT FROM '{NO_PLACE}' GROUP BY 1),
p AS (SELECT year_min AS peak FROM y ORDER BY share DESC, year_min LIMIT 1)
SELECT CASE WHEN i.year_min <= (SELECT peak FROM p) THEN 'to peak' ELSE 'after' END AS part, lat, lon, count(*) AS n
FROM coded JOIN imprint_places i USING (obs_id) WHERE lat IS NOT NULL AND i.year_min BETWEEN 1900 AND 2010 GROUP BY 1, 2, 3""",
    "coverage_report": f"""WITH {_GROUPS}, {_CODES} SELECT place_name_008 IS NOT NULL AS has_008, count(*) AS groups, sum(n_records)::BIGINT AS records, count(*) FILTER (geonames_matched) AS groups_hit,
  coalesce(sum(n_records) FILTER (geonames_matched), 0)::BIGINT AS records_hit, count(*) FILTER (geocode_reason = 'ambiguous') AS ambiguous
FROM groups LEFT JOIN (SELECT geo_key, geonames_matched, geocode_reason FROM codes) USING (geo_key) GROUP BY 1""",
    "agreement_matrix": f"""WITH o AS (SELECT rec_id, bool_or(city_group IS NOT DISTINCT FROM '{CITY}') AS old FROM imprint_places WHERE rec_id IS NOT NULL GROUP BY 1),
n AS (SELECT rec_id, len(list_filter(coalesce(place_hierarchy_752, []), lambda o: len(list_filter(coalesce(o.subfields, []), lambda s: s.code = 'd' AND trim(s.text) = '{CITY}')) > 0)) > 0 AS "new" FROM marc_records)
SELECT old, "new", count(*) AS records FROM o JOIN n USING (rec_id) GROUP BY 1, 2""",
    "group_counts": "SELECT city_group, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM imprint_places), 6) AS percent FROM imprint_places GROUP BY 1",
    "repeated_pct": """SELECT count(*) AS keys, round(coalesce(100.0 * count(*) FILTER (n > 1) / nullif(count(*), 0), 0), 6) AS percent
FROM (SELECT trim(lccn) AS k, count(*) AS n FROM imprint_places WHERE trim(lccn) <> '' GROUP BY 1)""",
    "lccn_join": f"""WITH r AS (SELECT {_LCCN.format('lccn')} AS k, rec_id, title FROM marc_records), f AS (SELECT k, rec_id AS first_rec, title FROM r WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY rec_id) = 1)
SELECT obs_id, p.k, first_rec, title FROM (SELECT obs_id, {_LCCN.format('lccn')} AS k FROM imprint_places) p LEFT JOIN f USING (k)""",
    "semi_several": f"SELECT obs_id, lccn FROM imprint_places WHERE lccn IN (SELECT lccn FROM imprint_places WHERE lccn IS NOT NULL GROUP BY 1 HAVING count(*) FILTER ({_REAL}) <= 1)",
    "place_hints": """WITH f AS (SELECT rec_id, arg_min(place_name_008, obs_id) AS name FROM imprint_places WHERE place_name_008 IS NOT NULL GROUP BY 1),
s AS (SELECT rec_id, i, unnest(o.subfields) AS s, generate_subscripts(o.subfields, 1) AS j FROM (SELECT rec_id, unnest(place_hierarchy_752) AS o, generate_subscripts(place_hierarchy_752, 1) AS i FROM marc_records) WHERE o IS NOT NULL),
l AS (SELECT rec_id, i, string_agg(trim(s.text), ', ' ORDER BY s.code, j) AS line FROM s WHERE s.code IN ('a', 'b', 'c', 'd', 'e') AND trim(s.text) <> '' GROUP BY 1, 2),
h AS (SELECT rec_id, arg_min(line, i) AS line FROM l GROUP BY 1)
SELECT rec_id, nullif(concat_ws(chr(10), '008 place: ' || nullif(trim(name), ''), '752 hierarchy: ' || nullif(trim(line), '')), '') AS hint FROM marc_records LEFT JOIN f USING (rec_id) LEFT JOIN h USING (rec_id)""",
    "scope_names": f"WITH {_SCOPE} {_SCOPED} FROM (SELECT DISTINCT name, {O.ascii_key(_BARE.format('name'))} AS k FROM marc_country_codes) LEFT JOIN nat USING (k) LEFT JOIN reg USING (k)",
    "answer_scopes": f"""WITH {_SCOPE}, p AS (SELECT geo_key, trim(name) AS name, pos FROM (SELECT places AS geo_key, unnest(string_split(places, ',')) AS name, generate_subscripts(string_split(places, ','), 1) - 1 AS pos FROM (SELECT DISTINCT places FROM imprint_places WHERE places IS NOT NULL)) WHERE pos > 0),
s AS (SELECT geo_key, pos, coalesce(national, CASE WHEN n = 1 THEN c END) AS country, CASE WHEN national IS NULL AND n = 1 THEN a END AS admin1
  FROM (SELECT *, {O.ascii_key(_BARE.format('name'))} AS k FROM p WHERE name <> '') LEFT JOIN nat USING (k) LEFT JOIN reg USING (k))
SELECT geo_key, country, admin1 FROM s WHERE country IS NOT NULL QUALIFY row_number() OVER (PARTITION BY geo_key ORDER BY (admin1 IS NOT NULL) DESC, pos DESC) = 1""",
    "seeded_sample": f"WITH {_GROUPS} SELECT geo_key FROM groups ORDER BY md5('42:' || geo_key), geo_key LIMIT 20",
    "top_groups": f"WITH {_GROUPS} SELECT geo_key, n_records FROM groups ORDER BY n_records DESC, geo_key LIMIT 10",
    "prefix_cube": f"""WITH k AS (SELECT rec_id, unnest(list_distinct(list_concat({_PREFIX}, list_transform({_PREFIX}, lambda p: p[1:1])))) AS prefix FROM marc_records)
SELECT prefix, year_min, {_CUBE} FROM imprint_places JOIN k USING (rec_id) WHERE {_PLACED} GROUP BY 1, 2""",
    "special_totals": f"""WITH r AS (SELECT rec_id, list_contains({_PREFIX}, 'PS') AS ps FROM marc_records), j AS (SELECT year_min, city_group, ps FROM imprint_places JOIN r USING (rec_id) WHERE {_PLACED})
SELECT 'all' AS special, year_min, {_CUBE} FROM j GROUP BY 2 UNION ALL SELECT CASE WHEN ps THEN 'PS' ELSE 'not_PS' END, year_min, {_CUBE} FROM j GROUP BY 1, 2""",
}
