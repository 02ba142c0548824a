"""Queries of the scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import classes as C
from folioforge.functions import text as T
from folioforge.functions import years as Y
from folioforge.operators.places import canonical_by_table, label_city
from folioforge.plans import oracle as O
from folioforge.session import table

RANGE = C.ClassRange("PS", 3000, 3599)
SIGNAL = "uuf"


def _records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "marc_records")


def _places(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "imprint_places")


def clean_text(spark, sf_dir):
    """Titles and subtitles cleaned."""
    return _records(spark, sf_dir).select("rec_id", T.clean_string(F.col("title")).alias("title"), T.clean_string(F.col("subtitle")).alias("subtitle"))


def basic_clean(spark, sf_dir):
    return _records(spark, sf_dir).select("rec_id", T.basic_clean(F.col("title")).alias("title"))


def match_keys(spark, sf_dir):
    return table(spark, sf_dir, "gazetteer").select("geonameid", T.match_key(F.col("name")).alias("key"))


def qualifiers(spark, sf_dir):
    names = table(spark, sf_dir, "marc_place_008_geonames")
    return names.select("place_name_008", T.strip_qualifier(F.col("place_name_008")).alias("bare"))


def lccn_keys(spark, sf_dir):
    return _records(spark, sf_dir).select("rec_id", T.normalize_lccn(F.col("lccn")).alias("lccn_key"))


def city_labels(spark, sf_dir):
    """Rows by given and derived label."""
    rows = label_city(_places(spark, sf_dir).select("city_group", "places_clean"), "places_clean", table(spark, sf_dir, "city_variants"), "Vorham", "label")
    return rows.groupBy("city_group", "label").agg(F.count(F.lit(1)).alias("n"))


def canonical_places(spark, sf_dir):
    """Distinct cleaned places cut at their region, of the table of regions."""
    codes = table(spark, sf_dir, "marc_place_008_geonames").where("geonames_country_code is not null")
    code = F.lower(F.concat("geonames_country_code", F.coalesce("geonames_admin1_code", F.lit(""))))
    regions = codes.select(F.lower(F.split_part("place_name_008", F.lit(" ("), F.lit(1))).alias("name"), code.alias("code"))
    return canonical_by_table(_places(spark, sf_dir).select("places_clean").distinct(), "places_clean", regions)


def state_places(spark, sf_dir):
    """Distinct cleaned places cut at their state."""
    return _places(spark, sf_dir).select("places_clean").distinct().select("places_clean", T.canonical_place(F.col("places_clean")).alias("canonical"))


def distinct_places(spark, sf_dir):
    return _places(spark, sf_dir).where("trim(places_clean) <> ''").select("places_clean").distinct()


def split_places(spark, sf_dir):
    """Each place of the strings of a record, in order."""
    return _records(spark, sf_dir).select("rec_id", F.posexplode(T.expand_places(F.col("places"))).alias("pos", "place"))


def year_extract(spark, sf_dir):
    """The year of every delivered year text and publisher."""
    rec = _records(spark, sf_dir)
    one = rec.select("rec_id", F.lit("year").alias("field"), F.posexplode("year").alias("pos", "raw"))
    two = rec.select("rec_id", F.lit("publishers").alias("field"), F.posexplode("publishers").alias("pos", "raw"))
    return one.unionByName(two).select("rec_id", "field", "pos", Y.year_int(F.col("raw")).alias("year"))


def year_evidence(spark, sf_dir):
    """The year of each kind of evidence and the one chosen."""
    sources = Y.year_sources(F.col("year"), F.col("publishers"), F.col("imprint_fields"), F.col("field_008"))
    rows = _records(spark, sf_dir).select("rec_id", *[y.alias(f"y_{n}") for n, y in sources])
    year, source = Y.publication_year([(n, F.col(f"y_{n}")) for n, _ in sources])
    return rows.withColumns({"year_min": year, "year_source": source}).withColumn("decade", Y.decade(F.col("year_min")))


def fields_008(spark, sf_dir):
    """Place code and name, form and first date of the 008."""
    names = table(spark, sf_dir, "marc_country_codes").select(F.trim("code").alias("place_code"), F.col("name").alias("place_name"))
    f = F.col("field_008")
    rows = _records(spark, sf_dir).select("rec_id", F.trim(Y.place_code_008(f)).alias("place_code"), Y.form_008(f).alias("form"), Y.date1_008(f).alias("date1"))
    return rows.join(names, "place_code", "left").select("rec_id", "place_code", "place_name", "form", "date1")


def country_names(spark, sf_dir):
    """Decoded 044 codes in place, unknown ones null."""
    names = table(spark, sf_dir, "marc_country_codes").select(F.trim("code").alias("code"), "name")
    rows = _records(spark, sf_dir).select("rec_id", F.posexplode("country_codes_044").alias("pos", "code"))
    return rows.withColumn("code", F.lower(T.strip_ws(F.col("code")))).join(names, "code", "left").select("rec_id", "pos", "name")


def hierarchy_752(spark, sf_dir):
    rows = _records(spark, sf_dir).select("rec_id", T.flatten_hierarchy(F.col("place_hierarchy_752")).alias("lines"))
    return rows.where("lines is not null").select("rec_id", F.posexplode("lines").alias("pos", "line"))


def cities_752(spark, sf_dir):
    """The city of each place hierarchy of a record."""
    return _records(spark, sf_dir).select("rec_id", F.posexplode(T.last_subfields(F.col("place_hierarchy_752"), "d")).alias("pos", "city"))


def place_signals(spark, sf_dir):
    """Whether a code occurs among the 044 codes or is the 008 place, and whether a 752 names the city."""
    codes = F.transform(F.coalesce("country_codes_044", F.array().cast("array<string>")), lambda c: F.lower(T.strip_ws(c)))
    coded = F.coalesce(F.array_contains(codes, SIGNAL), F.lit(False)) | F.coalesce(F.trim(Y.place_code_008(F.col("field_008"))) == SIGNAL, F.lit(False))
    cities = T.last_subfields(F.col("place_hierarchy_752"), "d")
    return _records(spark, sf_dir).select("rec_id", coded.alias("coded"), (F.size(cities) > 0).alias("has_city"), F.coalesce(F.array_contains(F.transform(cities, lambda c: T.strip_ws(c)), "Vorham"), F.lit(False)).alias("in_city"))


def signal_counts(spark, sf_dir):
    """Records by signal: a cross table."""
    return place_signals(spark, sf_dir).groupBy("coded", "has_city", "in_city").agg(F.count(F.lit(1)).alias("records"))


def signal_examples(spark, sf_dir):
    """The first ten records whose signals disagree, a report."""
    return place_signals(spark, sf_dir).where("coded and has_city and not in_city").orderBy("rec_id").limit(10).select("rec_id")


def legacy_years(spark, sf_dir):
    return _records(spark, sf_dir).select("rec_id", Y.legacy_year(F.col("year"), F.col("publishers")).alias("year"))


def target_places(spark, sf_dir):
    """Distinct places, lightly cleaned, of the records whose first PS number is in the target range."""
    rows = _records(spark, sf_dir).where(C.is_target(F.col("classifications"))).select(F.explode("places").alias("p"))
    return rows.select(T.basic_clean(F.col("p")).alias("place")).where("place is not null").distinct()


def birth_years(spark, sf_dir):
    return _records(spark, sf_dir).select("rec_id", Y.birth_year(F.col("first_author_dates")).alias("birth_year"))


def headings(spark, sf_dir):
    """The rendered headings of every record that has occurrences, null parts skipped."""
    return _records(spark, sf_dir).where("size(subject_genre_fields) > 0").select("rec_id", T.subject_headings(F.col("subject_genre_fields")).alias("headings"))


def class_match(spark, sf_dir):
    """Every class number with its parts and whether it lies in a range."""
    rows = _records(spark, sf_dir).select("rec_id", F.posexplode("classifications").alias("pos", "class"))
    c = T.strip_ws(F.col("class"))
    return rows.select("rec_id", "pos", C.prefix(c).alias("prefix"), C.digits(c).alias("digits"), RANGE.matches(c).alias("in_range"), RANGE.digits_in(c).alias("range_digits"))


def class_scope(spark, sf_dir):
    """Scope, target and range flags of each record, and the first number in range."""
    rec = _records(spark, sf_dir)
    classes = F.col("classifications")
    return rec.select(
        "rec_id", C.in_scope(classes, F.col("local_call_numbers")).alias("in_scope"), C.is_target(classes).alias("is_target"),
        RANGE.any(classes).alias("in_range"), F.get(RANGE.all_of(classes), F.lit(0)).alias("first_class"),
    )


def class_totals(spark, sf_dir):
    """Records that match each of two ranges."""
    specs = {"P": C.ClassRange("P"), "PS": C.ClassRange("PS"), "PS3000-3599": RANGE}
    counts = _records(spark, sf_dir).agg(*[F.count_if(r.any(F.col("classifications"))).alias(n) for n, r in specs.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.col(f"`{n}`").alias("records")) for n in specs])).alias("x")).select("x.*")


QUERIES = {
    f.__name__: f
    for f in (
        clean_text, basic_clean, match_keys, qualifiers, lccn_keys, city_labels, canonical_places, state_places, distinct_places, split_places, year_extract, year_evidence,
        fields_008, country_names, hierarchy_752, cities_752, place_signals, signal_counts, signal_examples, legacy_years, target_places, birth_years, headings, class_match, class_scope, class_totals,
    )
}

_STRIP = "regexp_replace({0}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"
_ONE_SPACE = "regexp_replace(title, '[\\s\\p{Z}]+', ' ', 'g')"
# RE2 has no look-around: digit runs are taken whole and kept where four long.
_YEAR = """CASE
  WHEN length(regexp_extract({0}, '(?i)\\bi\\.?\\s*e\\.?\\s*[,\\s]*(\\d{{4,}})', 1)) = 4
   AND regexp_extract({0}, '(?i)\\bi\\.?\\s*e\\.?\\s*[,\\s]*(\\d{{4,}})', 1)::INT BETWEEN 1500 AND 2030
  THEN regexp_extract({0}, '(?i)\\bi\\.?\\s*e\\.?\\s*[,\\s]*(\\d{{4,}})', 1)::INT
  WHEN len(list_filter(list_zip(regexp_extract_all({0}, '(\\d+)\\s*[-–—/]\\s*(\\d+)', 1), regexp_extract_all({0}, '(\\d+)\\s*[-–—/]\\s*(\\d+)', 2)),
    lambda r: length(r[1]) = 4 AND length(r[2]) = 4 AND r[1]::INT BETWEEN 1500 AND 2030 AND r[2]::INT BETWEEN 1500 AND 2030 AND abs(r[2]::INT - r[1]::INT) > 25)) > 0 THEN NULL
  ELSE list_filter(list_transform(list_filter(regexp_extract_all({0}, '\\d+'), lambda d: length(d) = 4), lambda d: d::INT), lambda y: y BETWEEN 1500 AND 2030)[1] END"""


def _least(texts: str) -> str:
    return f"list_min(list_filter(list_transform(coalesce({texts}, []), lambda t: {_YEAR.format('t')}), lambda y: y IS NOT NULL))"


def _imprint(condition: str) -> str:
    keep = f"list_filter(coalesce(imprint_fields, []), lambda o: o IS NOT NULL AND coalesce({condition}, false))"
    return _least(f"flatten(list_transform({keep}, lambda o: list_transform(list_filter(coalesce(o.subfields, []), lambda s: s IS NOT NULL AND s.code = 'c'), lambda s: s.text)))")


_D1, _D2 = "CASE WHEN regexp_full_match(field_008[8:11], '\\d{4}') THEN field_008[8:11]::INT END", "CASE WHEN regexp_full_match(field_008[12:15], '\\d{4}') THEN field_008[12:15]::INT END"
_DATE = f"""CASE WHEN length(field_008) = 40 AND NOT (field_008[7:7] = 'q' AND ({_D1} IS NULL OR {_D2} IS NULL OR {_D1} <> {_D2}))
  AND NOT (field_008[7:7] = 'm' AND ({_D2} IS NULL OR {_D2} - {_D1} > 25)) AND {_D1} BETWEEN 1500 AND 2030 THEN {_D1} END"""
_P = "regexp_extract({0}, '^([A-Z]+)(\\d+)?', 1)"
_DIG = "TRY_CAST(nullif(regexp_extract({0}, '^([A-Z]+)(\\d+)?', 2), '') AS BIGINT)"
_C = _STRIP.format("class")
_IN = f"coalesce({_P} = 'PS' AND {_DIG} BETWEEN 3000 AND 3599, false)"

_CITIES = """WITH o AS (SELECT rec_id, unnest(place_hierarchy_752) AS o, generate_subscripts(place_hierarchy_752, 1) AS i FROM marc_records),
s AS (SELECT rec_id, i, unnest(o.subfields) AS s, generate_subscripts(o.subfields, 1) AS j FROM o WHERE o IS NOT NULL),
d AS (SELECT rec_id, i, arg_max(s.text, j) AS city FROM s WHERE s.code = 'd' AND trim(s.text) <> '' GROUP BY 1, 2)"""
_SIGNALS = f"""{_CITIES}, c AS (SELECT rec_id, list(trim(city)) AS cities FROM d GROUP BY 1)
SELECT rec_id, coalesce(list_contains(list_transform(coalesce(country_codes_044, []), lambda x: lower(trim(x))), '{SIGNAL}'), false) OR coalesce(length(field_008) = 40 AND trim(field_008[16:18]) = '{SIGNAL}', false) AS coded,
  cities IS NOT NULL AS has_city, coalesce(list_contains(cities, 'Vorham'), false) AS in_city FROM marc_records LEFT JOIN c USING (rec_id)"""

SQL = {
    "clean_text": f"SELECT rec_id, {O.cleaned('title')} AS title, {O.cleaned('subtitle')} AS subtitle FROM marc_records",
    "basic_clean": f"SELECT rec_id, nullif(lower({_STRIP.format(_ONE_SPACE)}), '') AS title FROM marc_records",
    "match_keys": f"SELECT geonameid, {O.ascii_key('name')} AS key FROM gazetteer",
    "qualifiers": "SELECT place_name_008, regexp_replace(place_name_008, '(?i)\\s*\\(\\s*(state|province)\\s*\\)\\s*$', '') AS bare FROM marc_place_008_geonames",
    "lccn_keys": """SELECT rec_id, CASE WHEN regexp_matches(lower(lccn), '\\d') THEN regexp_extract(lower(lccn), '([a-z]*)\\s*(\\d+)', 1)
  || CASE WHEN regexp_full_match(regexp_extract(lower(lccn), '([a-z]*)\\s*(\\d+)', 2), '0+') THEN '0' ELSE ltrim(regexp_extract(lower(lccn), '([a-z]*)\\s*(\\d+)', 2), '0') END END AS lccn_key FROM marc_records""",
    "city_labels": """SELECT city_group, CASE WHEN places_clean IS NULL OR trim(places_clean) = '' THEN 'No place of publication'
  WHEN trim(places_clean) IN (SELECT variant FROM city_variants) THEN 'Vorham' ELSE 'Other' END AS label, count(*) AS n FROM imprint_places GROUP BY 1, 2""",
    "canonical_places": O.canonical("SELECT DISTINCT places_clean FROM imprint_places", "places_clean", """(SELECT lower(string_split(place_name_008, ' (')[1]) AS name,
  lower(geonames_country_code || coalesce(geonames_admin1_code, '')) AS code FROM marc_place_008_geonames WHERE geonames_country_code IS NOT NULL)"""),
    "state_places": O.canonical("SELECT DISTINCT places_clean FROM imprint_places", "places_clean", O.states()),
    "split_places": f"WITH {O.places('SELECT rec_id, places FROM marc_records')} SELECT rec_id, pos, place FROM places",
    "distinct_places": "SELECT DISTINCT places_clean FROM imprint_places WHERE trim(places_clean) <> ''",
    "year_extract": f"""SELECT rec_id, field, CAST(pos AS INT) AS pos, {_YEAR.format('raw')} AS year FROM (
  SELECT rec_id, 'year' AS field, unnest(year) AS raw, generate_subscripts(year, 1) - 1 AS pos FROM marc_records
  UNION ALL SELECT rec_id, 'publishers', unnest(publishers), generate_subscripts(publishers, 1) - 1 FROM marc_records)""",
    "year_evidence": (f"""WITH e AS (SELECT rec_id, {_imprint("o.tag = '260' OR o.tag = '264' AND coalesce(o.ind2, ' ') IN (' ', '', '1')")} AS y_publication, {_DATE} AS y_008,
  {_imprint("o.tag = '264' AND o.ind2 = '4'")} AS y_copyright, {_imprint("o.tag = '264' AND coalesce(o.ind2, ' ') NOT IN (' ', '', '1', '4')")} AS y_other_264,
  {_least('year')} AS y_legacy, {_least('publishers')} AS y_publisher FROM marc_records),
c AS (SELECT *, coalesce(y_publication, y_008, y_copyright, y_other_264, y_legacy, y_publisher) AS year_min FROM e)
SELECT *, CASE WHEN y_publication IS NOT NULL THEN 'publication' WHEN y_008 IS NOT NULL THEN '008' WHEN y_copyright IS NOT NULL THEN 'copyright' WHEN y_other_264 IS NOT NULL THEN 'other_264'
  WHEN y_legacy IS NOT NULL THEN 'legacy' WHEN y_publisher IS NOT NULL THEN 'publisher' END AS year_source, CASE WHEN year_min > 0 THEN (year_min // 10 * 10)::INT END AS decade FROM c"""),
    "fields_008": f"""SELECT rec_id, place_code, name AS place_name, form, date1 FROM (
  SELECT rec_id, CASE WHEN length(field_008) = 40 THEN trim(field_008[16:18]) END AS place_code, CASE WHEN length(field_008) = 40 THEN field_008[34:34] END AS form, {_DATE} AS date1 FROM marc_records)
LEFT JOIN marc_country_codes ON trim(code) = place_code""",
    "country_names": """SELECT rec_id, CAST(pos AS INT) AS pos, name FROM (SELECT rec_id, unnest(country_codes_044) AS c, generate_subscripts(country_codes_044, 1) - 1 AS pos FROM marc_records)
LEFT JOIN marc_country_codes ON trim(code) = lower(trim(c))""",
    "hierarchy_752": """WITH o AS (SELECT rec_id, unnest(place_hierarchy_752) AS o, generate_subscripts(place_hierarchy_752, 1) AS i FROM marc_records),
s AS (SELECT rec_id, i, unnest(o.subfields) AS s, generate_subscripts(o.subfields, 1) AS j FROM o WHERE o IS NOT NULL),
l AS (SELECT rec_id, i, string_agg(trim(s.text), ', ' ORDER BY s.code, j) AS line FROM s WHERE s.code IN ('a', 'b', 'c', 'd', 'e') AND trim(s.text) <> '' GROUP BY 1, 2)
SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS INT) AS pos, line FROM l""",
    "cities_752": f"{_CITIES} SELECT rec_id, CAST(row_number() OVER (PARTITION BY rec_id ORDER BY i) - 1 AS INT) AS pos, city FROM d",
    "place_signals": _SIGNALS,
    "signal_counts": f"SELECT coded, has_city, in_city, count(*) AS records FROM ({_SIGNALS}) GROUP BY 1, 2, 3",
    "signal_examples": f"SELECT rec_id FROM ({_SIGNALS}) WHERE coded AND has_city AND NOT in_city ORDER BY rec_id LIMIT 10",
    "legacy_years": f"SELECT rec_id, least({_least('year')}, {_least('publishers')}) AS year FROM marc_records",
    "target_places": f"""SELECT DISTINCT place FROM (SELECT nullif(lower({_STRIP.format(_ONE_SPACE.replace('title', 'p'))}), '') AS place FROM (SELECT unnest(places) AS p FROM marc_records WHERE
  CASE WHEN len(list_filter(coalesce(classifications, []), lambda c: {_P.format('c')} = 'PS')) = 0 THEN false
    ELSE coalesce({_DIG.format("list_filter(classifications, lambda c: " + _P.format('c') + " = 'PS')[1]")} < 8000, true) END)) WHERE place IS NOT NULL""",
    "birth_years": "SELECT rec_id, nullif(regexp_extract(first_author_dates, '\\d{4}'), '') AS birth_year FROM marc_records",
    "headings": """SELECT rec_id, array_to_string(list_transform(list_filter(subject_genre_fields, lambda o: o IS NOT NULL), lambda o: coalesce(o.tag, '') || ': '
  || coalesce(array_to_string(list_transform(o.subfields, lambda s: s.text), ' -- '), '')), '; ') AS headings FROM marc_records WHERE len(subject_genre_fields) > 0""",
    "class_match": f"""SELECT rec_id, CAST(pos AS INT) AS pos, nullif({_P.format(_C)}, '') AS prefix, {_DIG.format(_C)} AS digits, {_IN.format(_C)} AS in_range, CASE WHEN {_IN.format(_C)} THEN {_DIG.format(_C)} END AS range_digits
FROM (SELECT rec_id, unnest(classifications) AS class, generate_subscripts(classifications, 1) - 1 AS pos FROM marc_records)""",
    "class_scope": f"""SELECT rec_id, CASE WHEN len(coalesce(classifications, [])) > 0 THEN len(list_filter(classifications, lambda c: regexp_matches({_STRIP.format('c')}, '^PS\\s*\\d'))) > 0
    ELSE len(list_filter(coalesce(local_call_numbers, []), lambda c: regexp_matches({_STRIP.format('c')}, '^PS\\s*\\d'))) > 0 END AS in_scope,
  CASE WHEN len(list_filter(coalesce(classifications, []), lambda c: {_P.format('c')} = 'PS')) = 0 THEN false
    ELSE coalesce({_DIG.format("list_filter(classifications, lambda c: " + _P.format('c') + " = 'PS')[1]")} < 8000, true) END AS is_target,
  len(list_filter(coalesce(classifications, []), lambda c: {_IN.format(_STRIP.format('c'))})) > 0 AS in_range,
  list_filter(list_transform(coalesce(classifications, []), lambda c: {_STRIP.format('c')}), lambda c: {_IN.format('c')})[1] AS first_class FROM marc_records""",
    "class_totals": f"""SELECT 'P' AS range, sum((len(list_filter(coalesce(classifications, []), lambda c: {_P.format(_STRIP.format('c'))}[1:1] = 'P'
    AND NOT coalesce({_P.format(_STRIP.format('c'))} = 'PS' AND {_DIG.format(_STRIP.format('c'))} BETWEEN 8001 AND 8599, false))) > 0)::INT)::BIGINT AS records FROM marc_records
UNION ALL SELECT 'PS', sum((len(list_filter(coalesce(classifications, []), lambda c: {_P.format(_STRIP.format('c'))} = 'PS'
    AND NOT coalesce({_DIG.format(_STRIP.format('c'))} BETWEEN 8001 AND 8599, false))) > 0)::INT)::BIGINT FROM marc_records
UNION ALL SELECT 'PS3000-3599', sum((len(list_filter(coalesce(classifications, []), lambda c: {_IN.format(_STRIP.format('c'))})) > 0)::INT)::BIGINT FROM marc_records""",
}
