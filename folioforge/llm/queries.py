"""Queries of the training-text operators and, where it can express them, their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.text import clean_string
from folioforge.llm import canonical, frequency, leakage, lookalike, mojibake, names, packing, toxicity
from folioforge.operators import multivalue
from folioforge.operators.skew import salted_join
from folioforge.plans.records import packed_elements, place_lexicon
from folioforge.session import cut_lineage, spread, table


def _places_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = table(spark, sf_dir, "imprint_places").select(
        F.lit("places").alias("field_name"), F.col("obs_id").alias("row_id"), F.col("places").alias("value")
    )
    authors = table(spark, sf_dir, "marc_records").select(
        F.lit("first_author").alias("field_name"), F.col("rec_id").alias("row_id"), F.col("first_author").alias("value")
    )
    return places.unionByName(authors)


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place and author in its consistent form."""
    return lookalike.consistent_forms(_places_authors(spark, sf_dir))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that look like their ordinary spelling and differ in characters."""
    return lookalike.consistent_forms(_places_authors(spark, sf_dir), changed_only=True).select("field_name", "row_id")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Garbled places and publishers with their restored text."""
    return mojibake.garbled_values(packed_elements(spark, sf_dir))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and publisher elements that are wholly or partly garbled."""
    return p3_restored(spark, sf_dir).select("field_name", "row_id", "elem")


def _imprint_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "imprint_places")
    kinds = F.array(
        F.struct(F.lit("places_clean").alias("field_name"), F.array("places_clean").alias("terms")),
        F.struct(F.lit("places_clean_word").alias("field_name"), F.split("places_clean", " ").alias("terms")),
        F.struct(F.lit("year_min").alias("field_name"), F.array(F.col("year_min").cast("string")).alias("terms")),
    )
    kind = rows.select(F.col("source_record_id").alias("record_id"), F.inline(kinds))
    return kind.select("field_name", F.explode("terms").alias("term"), "record_id")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences, records and mark of every place, place word and year."""
    total = table(spark, sf_dir, "imprint_places").agg(F.countDistinct("source_record_id").alias("n_records"))
    return frequency.mark_terms(frequency.term_frequencies(_imprint_terms(spark, sf_dir)), total)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in exactly one record, or in more than 2 per cent of all records."""
    return p6_terms(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


#: Cosine from which an entry is accepted, and its lead over the next.
PLACE_THRESHOLD, PLACE_MARGIN = 0.57, 0.015
# Usual abbreviations of words in place names.
PLACE_WORDS = {
    "crk": "creek", "ft": "fort", "gr": "grand", "hbr": "harbor", "hts": "heights", "is": "island", "jct": "junction", "lk": "lake", "lndg": "landing",
    "mt": "mount", "mtn": "mountain", "pk": "park", "pt": "port", "riv": "river", "spgs": "springs", "st": "saint", "ste": "sainte", "twp": "township", "vlg": "village", "vly": "valley",
}


def gazetteer_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_key, form``: names, plain names and alternate names of the gazetteer."""
    gazetteer = table(spark, sf_dir, "gazetteer")
    forms = F.concat(F.array("name", "asciiname"), F.coalesce(F.split("alternatenames", ","), F.array().cast("array<string>")))
    rows = gazetteer.select(F.col("name").alias("ref_key"), F.explode(forms).alias("form"))
    return rows.where("ref_key is not null and form is not null").distinct()


def region_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``ref_key, form``: the entries of the 008 crosswalk as they are written."""

    def spell(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(k, f) for k in batch["ref_key"] for f in sorted(canonical.name_forms(k))], columns=["ref_key", "form"])

    entries = table(spark, sf_dir, "marc_place_008_geonames").select(F.col("place_name_008").alias("ref_key"))
    return entries.where("ref_key is not null").mapInPandas(spell, "ref_key string, form string").distinct()


def _place_values(pairs: DataFrame, every: DataFrame, names: multivalue.Lexicon) -> DataFrame:
    """Adds ``value``, the typed place with damage undone, to distinct ``places, places_clean``; packed strings are dropped.

    ``every`` has all typed places, from which the damage is judged.
    """
    damaged = mojibake.repairs(every.select(F.col("places").alias("value"))).withColumnRenamed("value", "places").drop("undone").withColumn("garbled", F.lit(True))
    joined = multivalue.with_hints(pairs, "places", names).join(damaged, "places", "left")
    shared = pairs.sparkSession.sparkContext.broadcast(lookalike.fit(every.select(F.col("places").alias("value"))))
    lists = (names.listed, names.regions)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unify = lookalike.Unifier(shared.value)
        split = multivalue.Splitter(multivalue.Grammar(True, *lists))
        for batch in batches:
            rows = []
            for typed, clean, guards, known, restored, garbled in zip(*(batch[c] for c in ("places", "places_clean", "guards", "known", "restored", "garbled"))):
                if len(split(typed, guards, known).values) > 1:
                    continue
                value = clean
                if typed is not None and not typed.isascii():
                    form = (restored or typed.replace("\ufffd", "")) if garbled is True else unify(typed)
                    if form != typed:
                        value = form
                rows.append((typed, clean, canonical.fold(value)))
            yield pd.DataFrame(rows, columns=["places", "places_clean", "value"])

    return spread(joined).mapInPandas(run, "places string, places_clean string, value string")


def p4_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct typed place that is no exact name: ``places, places_clean, ref_key, score``."""
    rows = table(spark, sf_dir, "imprint_places")
    names = table(spark, sf_dir, "gazetteer").where("name is not null").select(clean_string(F.col("name")).alias("places_clean")).distinct()
    typed = rows.where(F.col("places_clean").rlike(r"(?U)\S"))
    pairs = typed.select("places", "places_clean").distinct().join(names, "places_clean", "left_anti").select("places", "places_clean")
    every = rows.where("places is not null").select("places").distinct()
    # read twice, and costly to make
    values = cut_lineage(_place_values(pairs, every, place_lexicon(spark, sf_dir)).where("value is not null"))
    forms = gazetteer_forms(spark, sf_dir)
    mapped = canonical.map_values(spread(values.select("value").distinct()), forms, PLACE_THRESHOLD, PLACE_MARGIN, PLACE_WORDS)
    return values.join(mapped, "value").select("places", "places_clean", "ref_key", "score")


def p4_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct 008 place name that is no entry: ``place_name_008, ref_key, score``."""
    entries = table(spark, sf_dir, "marc_place_008_geonames").select("place_name_008").where("place_name_008 is not null")
    typed = table(spark, sf_dir, "imprint_places").where("place_name_008 is not null").select("place_name_008").distinct()
    values = typed.join(entries, "place_name_008", "left_anti").select(F.col("place_name_008").alias("value"))
    mapped = canonical.map_values(values, region_forms(spark, sf_dir), PLACE_THRESHOLD, PLACE_MARGIN, cut_words=True)
    return mapped.withColumnRenamed("value", "place_name_008")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry of every place and 008 name that is not exactly one, or ``none``."""
    rows = table(spark, sf_dir, "imprint_places")
    # A null place would match no key of a join; a mark stands for it on both sides.
    typed = F.coalesce("places", F.lit("\x00")).alias("typed")
    places = salted_join(
        rows.where("places_clean is not null").select("obs_id", typed, "places_clean"),
        p4_places(spark, sf_dir).select(typed, "places_clean", "ref_key"),
        ["typed", "places_clean"],
    ).select(F.lit("places_clean").alias("field_name"), "obs_id", F.coalesce("ref_key", F.lit("none")).alias("ref_key"))
    regions = salted_join(
        rows.where("place_name_008 is not null").select("obs_id", "place_name_008"),
        p4_regions(spark, sf_dir).select("place_name_008", "ref_key"),
        ["place_name_008"],
    ).select(F.lit("place_name_008").alias("field_name"), "obs_id", F.coalesce("ref_key", F.lit("none")).alias("ref_key"))
    return places.unionByName(regions)


def _spelt(values: DataFrame, elements: DataFrame) -> DataFrame:
    """``field_name, value, key, form, n`` of distinct names; garbled and packed publishers are left out.

    The model of damage is that of all ``elements``, as for problem 3.
    """
    publishers = values.where("field_name = 'publishers'").select("value")
    damaged = mojibake.repairs(publishers, mojibake.fit(elements)).select(F.lit("publishers").alias("field_name"), "value")
    shared = values.sparkSession.sparkContext.broadcast(lookalike.fit(values))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unify = lookalike.Unifier(shared.value)
        split = multivalue.Splitter(multivalue.Grammar(False))
        for batch in batches:
            rows = []
            for name, value in zip(batch["field_name"], batch["value"]):
                if name == "publishers" and len(split(value).values) > 1:
                    continue
                form = unify(value)
                if key := names.spelling_key(form):
                    rows.append((name, value, key, form))
            yield pd.DataFrame(rows, columns=["field_name", "value", "key", "form"])

    whole = values.join(damaged, ["field_name", "value"], "left_anti")
    return spread(whole.select("field_name", "value", "n")).mapInPandas(run, "field_name string, value string, key string, form string").join(values, ["field_name", "value"])


def _named_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of names, and ``field_name, value, key, form, n`` of each distinct one that counts."""
    records = table(spark, sf_dir, "marc_records")
    authors = records.select(F.lit("first_author").alias("field_name"), F.col("rec_id").alias("row_id"), F.col("first_author").alias("value"))
    firms = records.select(F.lit("publishers").alias("field_name"), F.col("rec_id").alias("row_id"), F.explode("publishers").alias("value"))
    rows = authors.unionByName(firms).where("value is not null")
    values = cut_lineage(rows.groupBy("field_name", "value").agg(F.count(F.lit(1)).alias("n")))
    spelt = cut_lineage(_spelt(values, packed_elements(spark, sf_dir)))
    # garbled elements are left out, and only publishers have any
    damaged = names.damaged_values(spelt.where("field_name = 'publishers'"))
    return rows, cut_lineage(spelt.join(damaged, ["field_name", "value"], "left_anti"))


def _spellings(spelt: DataFrame) -> DataFrame:
    return spelt.groupBy("field_name", "key").agg(F.min("form").alias("form"), F.sum("n").alias("n_rows"))


def p7_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each distinct spelling with its class, the number of its links and of its rows."""
    _, spelt = _named_rows(spark, sf_dir)
    spellings = cut_lineage(_spellings(spelt))
    found = names.clusters(spellings)
    return found.join(spellings.select("field_name", "key", "n_rows"), ["field_name", "key"]).select("field_name", "key", "centre", "links", "n_rows")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of records that name the same person or firm in different spellings."""
    rows, spelt = _named_rows(spark, sf_dir)
    found = cut_lineage(names.clusters(_spellings(spelt)))
    return names.variant_pairs(rows, spelt, found)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of one longer than 1,024 tokens, with its container."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each capacity."""
    return packing.fill(p8_containers(spark, sf_dir))


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and evaluation item that leaked into it, with the passage."""
    return leakage.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the evaluation items that leaked into them."""
    return p9_passages(spark, sf_dir).select("doc_id", "item_id")


def p10_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, best passage and flag of every document."""
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "content_labels"))


def p10_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of flagged documents of every source, those without documents included."""
    sources = table(spark, sf_dir, "text_sources").select("source")
    found = toxicity.rates(p10_scores(spark, sf_dir))
    return sources.join(found, "source", "full_outer").fillna(0, ["documents", "flagged"])


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with at least one abusive, hateful or sexually explicit passage."""
    return p10_scores(spark, sf_dir).where("flagged").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_forms": p2_forms,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_places": p4_places,
    "p4_regions": p4_regions,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p7_found": p7_found,
    "p7_spellings": p7_spellings,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p10_scores": p10_scores,
}

_TERMS = """WITH t AS (
  SELECT 'places_clean' AS field_name, places_clean AS term, source_record_id FROM imprint_places
  UNION ALL SELECT 'places_clean_word', unnest(string_split(places_clean, ' ')), source_record_id FROM imprint_places
  UNION ALL SELECT 'year_min', CAST(year_min AS VARCHAR), source_record_id FROM imprint_places
),
f AS (
  SELECT field_name, term, count(*) AS occurrences, count(DISTINCT source_record_id) AS records
  FROM t WHERE term IS NOT NULL AND trim(term) <> '' GROUP BY 1, 2
),
m AS (
  SELECT f.*, CASE WHEN records > 0.02 * (SELECT count(DISTINCT source_record_id) FROM imprint_places) THEN 'common'
                   WHEN records = 1 THEN 'rare' END AS mark FROM f
)"""

SQL = {
    "p6_terms": f"{_TERMS} SELECT field_name, term, occurrences, records, mark FROM m",
    "p6_found": f"{_TERMS} SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
}
