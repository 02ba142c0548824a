"""Queries that write tables as files of the shared folder and read them back: sources, sinks, resumable answers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.classes import ClassRange
from folioforge.operators import places as P
from folioforge.plans import oracle as O
from folioforge.plans.geo import CITY, _GROUPS, _INDEX, _SCOPE, _scopes
from folioforge.sources import marcxml, tables
from folioforge.session import shared_folder, table
from folioforge.streaming import cube


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}/{name}"


def _cell(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def marc_files(spark, sf_dir):
    """Records written as gzipped MARCXML files, read and extracted again, with all their contents."""
    path = _folder(spark, "marc")
    xml = marcxml.to_xml(table(spark, sf_dir, "marc_records"))
    xml.select("xml").write.option("compression", "gzip").text(path)
    found = marcxml.records(marcxml.read_marc(spark, path, "*.txt.gz"), ClassRange("PS"))
    return _contents(found)


def _contents(records: DataFrame) -> DataFrame:
    """Lists as texts, for comparison; the identifier of a file is left out."""
    lists = ["classifications", "year", "places", "publishers", "local_call_numbers", "country_codes_044"]
    fields = ["imprint_fields", "subject_genre_fields", "place_hierarchy_752"]
    joined = [F.array_join(c, "\x1f").alias(c) for c in lists]

    def rendered(c: str) -> Column:
        subs = lambda o: F.array_join(F.transform(o["subfields"], lambda s: F.concat_ws("=", s["code"], s["text"])), "\x1f")
        return F.array_join(F.transform(c, lambda o: F.concat(o["tag"], o["ind2"], subs(o))), "\x1e").alias(c)

    return records.select("lccn", "title", "subtitle", "first_author", "first_author_dates", "field_008", *joined, *[rendered(c) for c in fields])


def gazetteer_file(spark, sf_dir):
    """The gazetteer as a tab-separated dump, read back."""
    path = _folder(spark, "gazetteer")
    lines = table(spark, sf_dir, "gazetteer").select(F.concat_ws("\t", *[_cell(c) for c in tables.GAZETTEER]).alias("value"))
    lines.write.text(path)
    return tables.read_gazetteer(spark, path)


def region_file(spark, sf_dir):
    """The regions of the crosswalk as a dump of first-level regions, read back for some countries; of repeated names the last code counts."""
    path = _folder(spark, "regions")
    rows = table(spark, sf_dir, "marc_place_008_geonames").where("geonames_admin1_code is not null")
    name = F.split_part("place_name_008", F.lit(" ("), F.lit(1))
    code = F.concat_ws(".", "geonames_country_code", "geonames_admin1_code")
    lines = rows.orderBy(code, "place_name_008").select(F.concat_ws("\t", code, name, name, F.lit("0")).alias("value"))
    lines.coalesce(1).write.text(path)  # a code list, of one order
    return tables.read_regions(spark, path, ["XA", "VM", "QB"])


def code_file(spark, sf_dir):
    """The country codes as a CSV with header, read back as text."""
    path = _folder(spark, "codes")
    table(spark, sf_dir, "marc_country_codes").write.csv(path, header=True)
    return tables.read_codes(spark, path, "code, name")


def row_file(spark, sf_dir):
    """Flat rows exported as CSV and read back under given types; a missing column is null."""
    path = _folder(spark, "rows")
    rows = table(spark, sf_dir, "imprint_places").select("obs_id", "lccn", "year_min", "city_group", F.array("place_name_008", "city_group").alias("names"))
    tables.write_csv(rows, path)
    return tables.read_rows(spark, path, {"obs_id": "bigint", "lccn": "string", "year_min": "int", "city_group": "string", "names": "string", "absent": "int"})


def line_file(spark, sf_dir):
    """Distinct cleaned places, one a line."""
    path = _folder(spark, "lines")
    tables.write_lines(table(spark, sf_dir, "imprint_places"), "places_clean", path)
    return spark.read.text(path).withColumnRenamed("value", "place")


def answer_file(spark, sf_dir):
    """Answers appended in two runs; what the first has written the second leaves."""
    path = _folder(spark, "answers")
    rows = table(spark, sf_dir, "imprint_places").where("places_clean is not null").select(F.col("places_clean").alias("geo_key"))
    answer = rows.withColumn("normalized_place", F.lit("first"))
    tables.append_answers(answer.where(F.length("geo_key") < 9), path)
    tables.append_answers(answer.withColumn("normalized_place", F.lit("second")), path)
    return spark.read.parquet(path)


def crosswalk(spark, sf_dir):
    """Every decoded name with its scope, in the order of the names, and a note where it needs review; written and read back."""
    path = _folder(spark, "crosswalk")
    countries, regions = _scopes(spark, sf_dir)
    rows = P.crosswalk(table(spark, sf_dir, "marc_country_codes").select("name"), countries, regions)
    tables.write_csv(rows, path)
    return tables.read_rows(spark, path, {c: "string" for c in rows.columns})


def cube_files(spark, sf_dir):
    """City and other rows by year, added up over files that arrive one by one."""
    path = _folder(spark, "cube")
    rows = table(spark, sf_dir, "imprint_places").where("year_min is not null").select("year_min", "city_group")
    rows.write.parquet(f"{path}/in")
    cube.start_cube(spark, f"{path}/in", rows.schema, CITY, ["year_min"], f"{path}/out", f"{path}/state").awaitTermination()
    return spark.read.parquet(f"{path}/out")


def partial_cubes(spark, sf_dir):
    """The same from one partial count a file, united and added."""
    rows = table(spark, sf_dir, "imprint_places").where("year_min is not null").select("year_min", "city_group", "rec_id")
    parts = [cube.counts(rows.where(F.pmod("rec_id", F.lit(3)) == k), CITY, ["year_min"]) for k in range(3)]
    return cube.add_up(reduce(DataFrame.unionByName, parts), ["year_min"])


def answer_geocode(spark, sf_dir):
    """Answers ``Place, Region`` to their scope, matched in the gazetteer: the second geocoding path from end to end."""
    path = _folder(spark, "answers")
    typed = table(spark, sf_dir, "imprint_places").where("places is not null").select(F.col("places").alias("geo_key"), F.col("places").alias("places_clean")).distinct()
    # the offline normaliser gives the typed text back; keys of a finished table are not asked
    asked = P.residual(typed, P.finished_keys(table(spark, sf_dir, "geocode_results")))
    answered = P.normalize_remote(asked, P.remote_normalizer(lambda row: row["places_clean"]))
    tables.append_answers(answered, path)
    index = P.gazetteer_index(table(spark, sf_dir, "gazetteer"))
    return P.geocode_answers(spark.read.parquet(path), *_scopes(spark, sf_dir), index).select("geo_key", "country", "admin1", "geonameid", "ambiguous", "geonames_matched")


def residual_sources(spark, sf_dir):
    """Groups that neither a finished table nor an older list of keys covers."""
    done = table(spark, sf_dir, "geocode_results")
    older = done.where("geocode_reason = 'ambiguous'").select("geo_key")
    groups = P.geo_groups(P.with_geo_key(table(spark, sf_dir, "imprint_places"), CITY))
    return P.residual(groups.select("geo_key", "n_records"), P.finished_keys(done), P.finished_keys(older))


QUERIES = {
    f.__name__: f
    for f in (marc_files, gazetteer_file, region_file, code_file, row_file, line_file, answer_file, crosswalk, cube_files, partial_cubes, answer_geocode, residual_sources)
}

def _keep(c: str) -> str:
    """Whether a text has more than white space."""
    return f"coalesce(regexp_matches({c}, '[^{O.S[1:]}'), false)"


def _blank(c: str) -> str:
    return f"CASE WHEN {_keep(c)} THEN {c} END"


def _joined(c: str) -> str:
    return f"coalesce(array_to_string(list_filter({c}, lambda c: {_keep('c')}), chr(31)), '')"


def _rendered(field: str, tags: str) -> str:
    subs = f"list_filter(coalesce(o.subfields, []), lambda s: s IS NOT NULL AND s.text IS NOT NULL AND {_keep('s.text')})"
    line = f"o.tag || coalesce(o.ind2, ' ') || array_to_string(list_transform({subs}, lambda s: coalesce(s.code, '') || '=' || s.text), chr(31))"
    return f"array_to_string(list_transform(list_filter(coalesce({field}, []), lambda o: o IS NOT NULL AND o.tag IS NOT NULL AND o.tag IN ({tags})), lambda o: {line}), chr(30)) AS {field}"


def _imprint(code: str, published: bool) -> str:
    """Distinct texts of a subfield of the 260s, then of the 264s."""
    of = lambda test: (
        f"flatten(list_transform(list_filter(coalesce(imprint_fields, []), lambda o: o IS NOT NULL AND coalesce({test}, false)), lambda o: list_transform(list_filter(coalesce(o.subfields, []), "
        f"lambda s: s IS NOT NULL AND s.code = '{code}' AND s.text IS NOT NULL AND {_keep('s.text')}), lambda s: s.text)))"
    )
    later = "o.tag = '264'" + (" AND coalesce(o.ind2, ' ') IN (' ', '1')" if published else "")
    every = f"list_concat({of(chr(111) + '.tag = ' + chr(39) + '260' + chr(39))}, {of(later)})"
    # list_distinct has no order
    return f"array_to_string(list_transform(list_filter(list_zip({every}, range(len({every}))), lambda z: list_position({every}, z[1]) = z[2] + 1), lambda z: z[1]), chr(31))"


_SPLIT = "SELECT DISTINCT places AS geo_key FROM imprint_places WHERE places IS NOT NULL"
SQL = {
    "marc_files": f"""SELECT {_blank('lccn')} AS lccn, {_blank('title')} AS title, {_blank('subtitle')} AS subtitle, {_blank('first_author')} AS first_author,
  {_blank('first_author_dates')} AS first_author_dates, nullif(field_008, '') AS field_008, {_joined('classifications')} AS classifications, {_imprint('c', False)} AS year, {_imprint('a', True)} AS places, {_imprint('b', True)} AS publishers,
  {_joined('local_call_numbers')} AS local_call_numbers, {_joined('country_codes_044')} AS country_codes_044,
  {_rendered('imprint_fields', "'260', '264'")}, {_rendered('subject_genre_fields', "'600', '610', '611', '630', '650', '651', '655'")}, {_rendered('place_hierarchy_752', "'752'")} FROM marc_records""",
    "gazetteer_file": "SELECT geonameid, " + ", ".join(f"nullif({c}, '') AS {c}" for c in tables.GAZETTEER if c not in tables.TYPES) + ", lat, lon, coalesce(population, 0) AS population, elevation, dem FROM gazetteer",
    "region_file": """SELECT geonames_country_code AS country, geonames_admin1_code AS admin1, string_split(place_name_008, ' (')[1] AS name FROM marc_place_008_geonames
WHERE geonames_admin1_code IS NOT NULL AND geonames_country_code IN ('XA', 'VM', 'QB')
QUALIFY row_number() OVER (PARTITION BY geonames_country_code, string_split(place_name_008, ' (')[1] ORDER BY geonames_country_code || '.' || geonames_admin1_code DESC, place_name_008 DESC) = 1""",
    "code_file": "SELECT nullif(trim(code), '') AS code, nullif(trim(name), '') AS name FROM marc_country_codes",
    "row_file": "SELECT obs_id, nullif(lccn, '') AS lccn, year_min, nullif(city_group, '') AS city_group, nullif(concat_ws('; ', place_name_008, city_group), '') AS names, NULL::INT AS absent FROM imprint_places",
    "line_file": "SELECT DISTINCT places_clean AS place FROM imprint_places WHERE trim(places_clean) <> ''",
    "answer_file": "SELECT geo_key, CASE WHEN length(geo_key) < 9 THEN 'first' ELSE 'second' END AS normalized_place FROM (SELECT DISTINCT places_clean AS geo_key FROM imprint_places WHERE places_clean IS NOT NULL)",
    "crosswalk": f"""WITH {_SCOPE}, asked AS (SELECT DISTINCT name, {O.ascii_key("regexp_replace(name, '(?i)\\s*\\(\\s*(state|province)\\s*\\)\\s*$', '')")} AS k FROM marc_country_codes WHERE name IS NOT NULL)
SELECT name AS place_name_008, coalesce(national, CASE WHEN n = 1 THEN c END) AS country, CASE WHEN national IS NULL AND n = 1 THEN a END AS admin1,
  CASE WHEN national IS NULL AND n > 1 THEN 'ambiguous' WHEN national IS NULL AND n IS NULL THEN 'unresolved' END AS note FROM asked LEFT JOIN nat USING (k) LEFT JOIN reg USING (k)""",
    "cube_files": f"SELECT year_min, count(*) FILTER (city_group IS NOT DISTINCT FROM '{CITY}') AS city_n, count(*) FILTER (city_group IS DISTINCT FROM '{CITY}') AS other_n FROM imprint_places WHERE year_min IS NOT NULL GROUP BY 1",
    "partial_cubes": f"SELECT year_min, count(*) FILTER (city_group IS NOT DISTINCT FROM '{CITY}') AS city_n, count(*) FILTER (city_group IS DISTINCT FROM '{CITY}') AS other_n FROM imprint_places WHERE year_min IS NOT NULL GROUP BY 1",
    "answer_geocode": f"""WITH {_SCOPE}, typed AS ({_SPLIT} AND places NOT IN (SELECT geo_key FROM geocode_results WHERE geonames_matched AND geo_key IS NOT NULL)),
given AS (SELECT geo_key, list_filter(list_transform(string_split(geo_key, ','), lambda p: {O.strip('p')}), lambda p: p <> '') AS l FROM typed),
bits AS (SELECT geo_key, l[1] AS city, unnest(l[2:]) AS name, generate_subscripts(l[2:], 1) AS pos FROM given),
s AS (SELECT geo_key, city, pos, coalesce(national, CASE WHEN n = 1 THEN c END) AS country, CASE WHEN national IS NULL AND n = 1 THEN a END AS admin1
  FROM (SELECT *, {O.ascii_key("regexp_replace(name, '(?i)\\s*\\(\\s*(state|province)\\s*\\)\\s*$', '')")} AS k FROM bits) LEFT JOIN nat USING (k) LEFT JOIN reg USING (k)),
scoped AS (SELECT geo_key, {O.cleaned('city')} AS place, country, admin1 AS scope FROM s WHERE country IS NOT NULL QUALIFY row_number() OVER (PARTITION BY geo_key ORDER BY (admin1 IS NOT NULL) DESC, pos DESC) = 1),
{_INDEX}, canon AS ({O.canonical('SELECT DISTINCT place FROM scoped', 'place', O.states())}),
tried AS (SELECT geo_key, lower(country) AS country, scope, 0 AS step, place AS name_key FROM scoped WHERE place <> ''
  UNION ALL SELECT geo_key, lower(country), scope, 2, regexp_replace(canonical, ' [^ ]*$', '') FROM scoped JOIN canon USING (place) WHERE contains(canonical, ' ') AND regexp_replace(canonical, ' [^ ]*$', '') <> place),
found AS (SELECT DISTINCT geo_key, step + tier AS step, geonameid, population FROM tried JOIN idx i USING (country, name_key) WHERE scope IS NULL OR admin1 = scope),
best AS (SELECT geo_key, geonameid, count(*) OVER (PARTITION BY geo_key, step) > 1 AS ambiguous FROM found QUALIFY row_number() OVER (PARTITION BY geo_key ORDER BY step, population DESC, geonameid) = 1)
SELECT geo_key, country, scope AS admin1, geonameid, ambiguous, geonameid IS NOT NULL AS geonames_matched FROM typed LEFT JOIN scoped USING (geo_key) LEFT JOIN best USING (geo_key)""",
    "residual_sources": f"""WITH {_GROUPS} SELECT geo_key, n_records FROM groups WHERE geo_key NOT IN (SELECT geo_key FROM geocode_results WHERE (geonames_matched OR geocode_reason = 'ambiguous') AND geo_key IS NOT NULL)""",
}
