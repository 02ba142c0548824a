"""From delivered records to one clean row for each record and place; and classification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import classes as C
from folioforge.functions import text as T
from folioforge.functions import years as Y
from folioforge.operators.classify import classified_records
from folioforge.operators.places import ensure_columns, keep_first, label_city
from folioforge.plans import fields
from folioforge.plans import oracle as O
from folioforge.session import table

RANGE = C.ClassRange("PS")
CITY = "Vorham"


def clean_records(
    records: DataFrame, wanted: C.ClassRange, variants: DataFrame, city: str, names_008: DataFrame | None = None, order: str = "rec_id", compounds: list[str] = T.COMPOUND_NAMES
) -> DataFrame:
    """One row for each record in range and place, first of each record, place and year.

    Rows without class digits or a year are left out.  ``variants(variant)`` has the cleaned
    names of the city, ``names_008(code, name)`` decodes the 008 place.  A record is its
    stripped lccn, marked as one, or without one its source id.
    """
    records = ensure_columns(records, {"source_record_id": "string", "imprint_fields": "array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>", "field_008": "string"})
    matching = wanted.all_of(F.col("classifications"))
    rows = records.where(wanted.any(F.col("classifications"))).withColumn("target_class", F.get(matching, F.lit(0)))
    sources = Y.year_sources(F.col("year"), F.col("publishers"), F.col("imprint_fields"), F.col("field_008"))
    rows = rows.withColumns({"class_digits": C.digits(F.col("target_class")), **{f"__{n}": y for n, y in sources}})
    year, source = Y.publication_year([(n, F.col(f"__{n}")) for n, _ in sources])
    rows = rows.withColumns({"year_min": year, "year_source": source, "place_code_008": Y.place_code_008(F.col("field_008"))})
    rows = rows.where("class_digits is not null and year_min is not null")
    lccn = F.concat(F.lit("lccn:"), F.nullif(T.strip_ws(F.col("lccn")), F.lit("")))
    record = F.coalesce(lccn, F.col("source_record_id"), F.concat(F.lit("row:"), F.col(order).cast("string")))
    places = F.posexplode(T.expand_places(F.col("places"), compounds)).alias("place_pos", "place")
    publisher = T.clean_string(F.get(F.col("publishers"), F.lit(0)))
    flat = rows.select(
        F.col(order), "lccn", record.alias("record"), "target_class", "class_digits", "year_min", "year_source", F.trim("place_code_008").alias("place_code_008"),
        Y.decade(F.col("year_min")).alias("decade"), publisher.alias("publisher_clean"), places,
    )
    flat = flat.withColumn("places_clean", T.clean_string(F.col("place")))
    flat = label_city(flat, "places_clean", variants, city)
    first = keep_first(flat, ["record", "places_clean", "year_min"], [order, "place_pos"])
    if names_008 is None:
        return first.withColumn("place_name_008", F.lit(None).cast("string"))
    names = names_008.select(F.trim("code").alias("place_code_008"), F.col("name").alias("place_name_008")).dropDuplicates(["place_code_008"])
    return first.join(names, "place_code_008", "left")


def clean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clean rows of class PS."""
    rows = clean_records(table(spark, sf_dir, "marc_records"), RANGE, table(spark, sf_dir, "city_variants"), CITY, table(spark, sf_dir, "marc_country_codes"))
    return rows.select("rec_id", "record", "target_class", "class_digits", "year_min", "year_source", "place_name_008", "place_pos", "place", "city_group", "decade")


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of the rules for every record in scope."""
    rows = classified_records(table(spark, sf_dir, "marc_records"))
    rules = F.array_join("matched_rules", ";").alias("matched_rules")
    return rows.select("rec_id", "is_secondary", "confidence", rules, "review_flag", "self_subject", "primary_document")


def primary_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose record is not classified as secondary; unknown records stay."""
    marked = classified(spark, sf_dir).select("rec_id", "is_secondary")
    rows = table(spark, sf_dir, "imprint_places").join(marked, "rec_id", "left")
    return rows.where(~F.col("is_secondary").eqNullSafe(True)).select("obs_id", "rec_id", "is_secondary")


QUERIES = {"clean_table": clean_table, "classified": classified, "primary_only": primary_only}

_STRIP = "regexp_replace({0}, '^[\\s\\x{{a0}}]+|[\\s\\x{{a0}}]+$', '', 'g')"
_NORM = "lower(" + _STRIP.replace("{0}", "rtrim(" + _STRIP + ", '.,;:')") + ")"
_OCC = "list_filter(coalesce(subject_genre_fields, []), lambda o: o IS NOT NULL)"
_SUBS = "list_filter(coalesce(o.subfields, []), lambda s: s IS NOT NULL AND s.text IS NOT NULL)"
_SUBDIVIDED = "coalesce(o.tag IN ('600', '610', '611', '630', '650', '651'), false)"
_NAMES = "coalesce(o.tag IN ('600', '610', '611', '630'), false)"
_VALUES = f"CASE WHEN {_SUBDIVIDED} THEN list_transform(list_filter({_SUBS}, lambda s: coalesce(s.code IN ('x', 'v', 'y'), false)), lambda s: {_NORM.format('s.text')}) ELSE [] END"


def _sql_has(v: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({v}, '{t}')" for t in terms) + ")"


def _sql_key(name: str, dates: str) -> str:
    clean = _NORM.format(name)
    one, two = f"regexp_extract({clean}, '^([^,]*)', 1)", f"regexp_extract({clean}, '^[^,]*,(.*)$', 1)"
    return f"CASE WHEN {clean} <> '' THEN {_NORM.format(one)} || '|' || {_NORM.format(two)} || '|' || coalesce(nullif(regexp_extract({dates}, '\\d{{4}}'), ''), '-') END"


_FULL = f"lower(array_to_string(list_transform({_SUBS}, lambda s: s.text), ' '))"
_QUAL = f"coalesce({_sql_has(_FULL, 'fictitious character', 'legendary character')}, false)"
_ANY = lambda *t: f"len(list_filter(vals, lambda v: {_sql_has('v', *t)})) > 0"
_GENRE = ("fiction", "poetry", "drama", "juvenile fiction", "juvenile literature", "literary collections")

_CLASSIFIED = f"""WITH r AS (
  SELECT * FROM marc_records WHERE CASE WHEN len(coalesce(classifications, [])) > 0 THEN len(list_filter(classifications, lambda c: regexp_matches({_STRIP.format('c')}, '^PS\\s*\\d'))) > 0
    ELSE len(list_filter(coalesce(local_call_numbers, []), lambda c: regexp_matches({_STRIP.format('c')}, '^PS\\s*\\d'))) > 0 END
), v AS (
  SELECT rec_id, field_008, subject_genre_fields, flatten(list_transform({_OCC}, lambda o: {_VALUES})) AS vals, {_sql_key('first_author', 'first_author_dates')} AS creator FROM r
), s AS (
  SELECT *, creator IS NOT NULL AND len(list_filter({_OCC}, lambda o: coalesce(o.tag = '600' AND
    {_sql_key("list_filter(" + _SUBS + ", lambda s: s.code = 'a')[1].text", "list_filter(" + _SUBS + ", lambda s: s.code = 'd')[1].text")} = creator, false))) > 0 AS self_subject,
    {_ANY('correspondence', 'interviews')} AS doc FROM v
), f AS (
  SELECT *, NOT self_subject AND NOT doc AND len(list_filter({_OCC}, lambda o: {_NAMES} AND coalesce(o.ind2 = '0', false) AND NOT {_QUAL}
      AND len(list_filter({_VALUES}, lambda v: {_sql_has('v', 'criticism', 'in literature', *_GENRE)})) = 0)) > 0 AS r1,
    len(list_filter(vals, lambda v: contains(v, 'criticism') AND NOT contains(v, 'criticism, textual'))) > 0 AS r2, NOT doc AND {_ANY('in literature')} AS r3,
    NOT self_subject AND {_ANY('biography', 'bio-bibliography')} AS r5, {_ANY(*_GENRE)} AS r6,
    coalesce(length(field_008) = 40 AND field_008[34:34] IN ('p', 'd', 'f', 'j', 'i', 'h', 's', 'm', '1'), false) AS r7, {_ANY('criticism, textual')} AS r8,
    len(list_filter({_OCC}, lambda o: {_NAMES} AND {_QUAL} AND len({_VALUES}) = 0)) > 0 AS unclear FROM s
), c AS (
  SELECT *, r1 OR r2 OR r3 OR r5 AS is_secondary, CASE WHEN r1 OR r2 OR r3 THEN 'high' WHEN r5 THEN 'medium' WHEN r6 OR r7 OR r8 OR doc THEN 'high' ELSE 'low' END AS confidence FROM f
)
SELECT rec_id, is_secondary, confidence, concat_ws(';', CASE WHEN r1 THEN 'R1' END, CASE WHEN r2 THEN 'R2' END, CASE WHEN r3 THEN 'R3' END, CASE WHEN r5 THEN 'R5' END, CASE WHEN r6 THEN 'R6' END,
  CASE WHEN r7 THEN 'R7' END, CASE WHEN r8 THEN 'R8' END, CASE WHEN doc THEN 'R9' END) AS matched_rules,
  self_subject OR doc OR unclear OR r8 OR (NOT is_secondary AND confidence = 'low') AS review_flag, self_subject, doc AS primary_document FROM c"""

_CLASS = "regexp_extract({0}, '^([A-Z]+)(\\d+)?', {1})"
_DIGITS = f"TRY_CAST(nullif({_CLASS.format('{0}', 2)}, '') AS BIGINT)"
_PS = f"list_filter(list_transform(coalesce(classifications, []), lambda c: {_STRIP.format('c')}), lambda c: coalesce({_CLASS.format('c', 1)} = 'PS' AND NOT coalesce({_DIGITS.format('c')} BETWEEN 8001 AND 8599, false), false))"
_CLEAN_TABLE = f"""WITH evidence AS ({fields.SQL['year_evidence']}), {O.places('SELECT rec_id, places FROM marc_records')},
r AS (SELECT m.rec_id, coalesce('lccn:' || nullif({O.strip('lccn')}, ''), source_record_id, 'row:' || m.rec_id) AS record, ({_PS})[1] AS target_class, year_min, year_source, decade,
    CASE WHEN length(field_008) = 40 THEN trim(field_008[16:18]) END AS code FROM marc_records m JOIN evidence USING (rec_id)),
f AS (SELECT r.*, {_DIGITS.format('target_class')} AS class_digits, pos AS place_pos, place, {O.cleaned('place')} AS places_clean FROM r JOIN places USING (rec_id) WHERE target_class IS NOT NULL AND year_min IS NOT NULL),
d AS (SELECT * FROM f WHERE class_digits IS NOT NULL QUALIFY row_number() OVER (PARTITION BY record, places_clean, year_min ORDER BY rec_id, place_pos) = 1)
SELECT rec_id, record, target_class, class_digits, year_min, year_source, name AS place_name_008, place_pos, place,
  CASE WHEN places_clean IS NULL OR places_clean = '' THEN 'No place of publication' WHEN places_clean IN (SELECT variant FROM city_variants WHERE variant IS NOT NULL) THEN '{CITY}' ELSE 'Other' END AS city_group, decade
FROM d LEFT JOIN (SELECT trim(code) AS code, any_value(name) AS name FROM marc_country_codes GROUP BY 1) USING (code)"""

SQL = {
    "clean_table": _CLEAN_TABLE,
    "classified": _CLASSIFIED,
    "primary_only": f"SELECT obs_id, rec_id, is_secondary FROM imprint_places LEFT JOIN (SELECT rec_id, is_secondary FROM ({_CLASSIFIED})) USING (rec_id) WHERE is_secondary IS DISTINCT FROM true",
}
