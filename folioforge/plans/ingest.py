"""Queries over MARCXML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.classes import ClassRange
from folioforge.sources import marcxml
from folioforge.session import table


def marc_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record written as MARCXML, parsed and extracted again: identity and sizes."""
    xml = marcxml.to_xml(table(spark, sf_dir, "marc_records"))
    found = marcxml.records(marcxml.parse_marc(xml), ClassRange("PS"))
    sizes = [F.size(c).alias(f"n_{c}") for c in ("classifications", "imprint_fields", "subject_genre_fields", "place_hierarchy_752")]
    return found.select("source_record_id", "lccn", "title", "first_author", F.length("field_008").alias("length_008"), "matches_class_range", *sizes)


QUERIES = {"marc_ingest": marc_ingest}

_OCC = "len(list_filter(coalesce({0}, []), lambda o: o IS NOT NULL AND o.tag IS NOT NULL AND o.tag IN ({1})))::INT AS n_{0}"
_BLANK = "CASE WHEN regexp_matches({0}, '[^\\s\\x{{a0}}]') THEN {0} END"
SQL = {
    "marc_ingest": f"""SELECT source_record_id, {_BLANK.format('lccn')} AS lccn, {_BLANK.format('title')} AS title, {_BLANK.format('first_author')} AS first_author, nullif(length(field_008), 0)::INT AS length_008,
  len(list_filter(coalesce(classifications, []), lambda c: regexp_extract(trim(c), '^([A-Z]+)(\\d+)?', 1) = 'PS'
    AND NOT coalesce(TRY_CAST(nullif(regexp_extract(trim(c), '^([A-Z]+)(\\d+)?', 2), '') AS BIGINT) BETWEEN 8001 AND 8599, false))) > 0 AS matches_class_range,
  len(list_filter(coalesce(classifications, []), lambda c: regexp_matches(c, '[^\\s\\x{{a0}}]')))::INT AS n_classifications, {_OCC.format('imprint_fields', "'260', '264'")},
  {_OCC.format('subject_genre_fields', "'600', '610', '611', '630', '650', '651', '655'")}, {_OCC.format('place_hierarchy_752', "'752'")} FROM marc_records""",
}
