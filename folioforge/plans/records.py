"""Queries over nested records and packed fields (problems 1 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.operators import multivalue, nested
from folioforge.session import table

NESTED_FIELDS = ["subject_genre_fields", "place_hierarchy_752"]


def _canonical(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [
        nested.canonical_typed(table(spark, sf_dir, "marc_records"), NESTED_FIELDS),
        nested.canonical_json(table(spark, sf_dir, "raw_records"), NESTED_FIELDS),
    ]


def p1_subfields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered subfield with the keys of its occurrence and record."""
    return nested.subfield_rows(_canonical(spark, sf_dir), NESTED_FIELDS)


def p1_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivered occurrence, those without subfields included."""
    return nested.occurrence_rows(_canonical(spark, sf_dir), NESTED_FIELDS)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the subfields whose text is neither null nor blank."""
    rows = p1_subfields(spark, sf_dir)
    return rows.where(F.col("text").rlike(r"(?U)\S")).select("field_name", "rec_id", "occ_pos", "sub_pos")


def packed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``field_name, row_id, elem, value``: places of imprint_places, publishers of marc_records."""
    places = table(spark, sf_dir, "imprint_places").select(
        F.lit("places").alias("field_name"), F.col("obs_id").alias("row_id"), F.lit(0).alias("elem"), F.col("places").alias("value")
    )
    publishers = table(spark, sf_dir, "marc_records").select(
        F.lit("publishers").alias("field_name"), F.col("rec_id").alias("row_id"), F.posexplode("publishers").alias("elem", "value")
    )
    return places.unionByName(publishers)


def place_lexicon(spark: SparkSession, sf_dir: str) -> multivalue.Lexicon:
    """Place names that hold a conjunction, and the names of regions."""
    regions = table(spark, sf_dir, "marc_place_008_geonames").select("place_name_008")
    return multivalue.make_lexicon([table(spark, sf_dir, "gazetteer").select("name"), regions], regions)


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every place and publisher string, with position and error flag."""
    return multivalue.split_values(packed_elements(spark, sf_dir), {"places": place_lexicon(spark, sf_dir)})


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the values of strings that hold two or more."""
    rows = multivalue.split_values(packed_elements(spark, sf_dir), {"places": place_lexicon(spark, sf_dir)}, packed_only=True)
    return rows.select("field_name", "row_id", "elem", "pos")


QUERIES = {
    "p1_found": p1_found,
    "p1_subfields": p1_subfields,
    "p1_occurrences": p1_occurrences,
    "p5_found": p5_found,
    "p5_values": p5_values,
}

_OCC = """
occ AS (
  SELECT 'subject_genre_fields' AS field_name, rec_id, unnest(subject_genre_fields) AS o,
         generate_subscripts(subject_genre_fields, 1) - 1 AS occ_pos FROM marc_records
  UNION ALL
  SELECT 'place_hierarchy_752', rec_id, unnest(place_hierarchy_752), generate_subscripts(place_hierarchy_752, 1) - 1 FROM marc_records
),
fields AS (
  SELECT f.field_name, rec_id, json_extract(payload, '$.' || f.field_name) AS v
  FROM raw_records, (VALUES ('subject_genre_fields'), ('place_hierarchy_752')) f(field_name)
  WHERE json_valid(payload) AND json_type(payload) = 'OBJECT'
),
jocc AS (
  SELECT field_name, rec_id, unnest(l) AS o, generate_subscripts(l, 1) - 1 AS occ_pos
  FROM (SELECT field_name, rec_id, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) ELSE [v] END AS l
        FROM fields WHERE v IS NOT NULL AND json_type(v) <> 'NULL')
),
jsubs AS (
  SELECT field_name, rec_id, occ_pos, json_extract(o, '$.subfields') AS s FROM jocc WHERE json_type(o) = 'OBJECT'
),
jsub AS (
  SELECT field_name, rec_id, occ_pos, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sub_pos
  FROM (SELECT field_name, rec_id, occ_pos, CASE json_type(s) WHEN 'ARRAY' THEN CAST(s AS JSON[]) ELSE [s] END AS l
        FROM jsubs WHERE s IS NOT NULL AND json_type(s) <> 'NULL')
)"""

_SUB = f"""WITH {_OCC},
sub AS (
  SELECT field_name, rec_id, occ_pos, unnest(o.subfields) AS s, generate_subscripts(o.subfields, 1) - 1 AS sub_pos
  FROM occ WHERE o IS NOT NULL
),
rows_ AS (
  SELECT field_name, rec_id, CAST(occ_pos AS INT) AS occ_pos, CAST(sub_pos AS INT) AS sub_pos, s.code AS code, s.text AS text
  FROM sub WHERE s IS NOT NULL
  UNION ALL
  SELECT field_name, rec_id, CAST(occ_pos AS INT), CAST(sub_pos AS INT),
         CASE json_type(s) WHEN 'ARRAY' THEN json_extract_string(s, '$[0]') ELSE json_extract_string(s, '$.code') END,
         CASE json_type(s) WHEN 'ARRAY' THEN json_extract_string(s, '$[1]') ELSE json_extract_string(s, '$.text') END
  FROM jsub WHERE s IS NOT NULL AND json_type(s) <> 'NULL'
)"""

SQL = {
    "p1_subfields": f"{_SUB} SELECT * FROM rows_",
    "p1_found": f"{_SUB} SELECT field_name, rec_id, occ_pos, sub_pos FROM rows_ WHERE text IS NOT NULL AND regexp_matches(text, '[^\\s\\x{{a0}}]')",
    "p1_occurrences": f"""WITH {_OCC}
SELECT field_name, rec_id, CAST(occ_pos AS INT) AS occ_pos, o.tag AS tag, o.ind2 AS ind2,
       CAST(coalesce(len(o.subfields), 0) AS INT) AS n_subfields FROM occ WHERE o IS NOT NULL
UNION ALL
SELECT field_name, rec_id, CAST(occ_pos AS INT), json_extract_string(o, '$.tag'), json_extract_string(o, '$.ind2'),
       CAST(CASE coalesce(json_type(json_extract(o, '$.subfields')), 'NULL') WHEN 'ARRAY' THEN json_array_length(json_extract(o, '$.subfields'))
                 WHEN 'NULL' THEN 0 ELSE 1 END AS INT)
FROM jocc WHERE json_type(o) = 'OBJECT'""",
}
