"""Rule-based record classification over nested subject headings, as one projection.

Rules: R1 bare name subject, R2 criticism, R3 in literature, R5 biography (secondary); R6
genre, R7 literary form, R8 textual criticism, R9 primary document (primary).  Null arrays
count as empty, null occurrences and texts as absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions.classes import in_scope
from folioforge.functions.text import normalize_term, subject_headings
from folioforge.functions.years import birth_year, form_008
from folioforge.operators.nested import OCC_TYPE
from folioforge.operators.places import require_columns

# Tags and terms of the rules.
SUBDIVIDED = ["600", "610", "611", "630", "650", "651"]
NAMES = ["600", "610", "611", "630"]
TEXTUAL = ["criticism, textual"]
CRITICISM = ["criticism"]
IN_LITERATURE = ["in literature"]
GENRE = ["fiction", "poetry", "drama", "juvenile fiction", "juvenile literature", "literary collections"]
PRIMARY = ["correspondence", "interviews"]
BIOGRAPHY = ["biography", "bio-bibliography"]
QUALIFIERS = ["fictitious character", "legendary character"]
LITERARY_FORMS = ["p", "d", "f", "j", "i", "h", "s", "m", "1"]
NEEDED = ["subject_genre_fields", "field_008", "local_call_numbers", "first_author", "first_author_dates", "classifications"]

SUBS = "array<struct<code:string,text:string>>"


def _has(value: Column, terms: list[str]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | value.contains(t)
    return found


def _subs(o: Column) -> Column:
    return F.filter(F.coalesce(o["subfields"], F.array().cast(SUBS)), lambda s: s.isNotNull() & s["text"].isNotNull())


def _values(o: Column) -> Column:
    """Normalised subdivisions of an occurrence that can have them."""
    kept = F.filter(_subs(o), lambda s: s["code"].isin("x", "v", "y"))
    return F.when(o["tag"].isin(SUBDIVIDED), F.transform(kept, lambda s: normalize_term(s["text"]))).otherwise(F.array().cast("array<string>"))


def _text(o: Column) -> Column:
    return F.lower(F.array_join(F.transform(_subs(o), lambda s: s["text"]), " "))


def _first(o: Column, code: str) -> Column:
    return F.get(F.filter(_subs(o), lambda s: s["code"] == code), F.lit(0))["text"]


def name_key(name: Column, dates: Column) -> Column:
    """Surname, given name after the first comma, birth year; null without a name."""
    clean = normalize_term(name)
    surname = normalize_term(F.regexp_extract(clean, r"^([^,]*)", 1))
    given = normalize_term(F.regexp_extract(clean, r"^[^,]*,(.*)$", 1))
    return F.when(clean != "", F.struct(surname.alias("surname"), given.alias("given"), birth_year(dates).alias("born")))


def classify(df: DataFrame) -> DataFrame:
    """Adds ``is_secondary, confidence, matched_rules, review_flag, self_subject, primary_document``."""
    require_columns(df, NEEDED)
    occurrences = F.filter(F.coalesce(F.col("subject_genre_fields").cast(OCC_TYPE), F.array().cast(OCC_TYPE)), lambda o: o.isNotNull())
    df = df.withColumns({"__occ": occurrences, "__creator": name_key(F.col("first_author"), F.col("first_author_dates"))})
    df = df.withColumn("__values", F.flatten(F.transform("__occ", lambda o: _values(o))))
    any_value = lambda terms: F.exists("__values", lambda v: _has(v, terms))
    own = F.exists("__occ", lambda o: F.coalesce((o["tag"] == "600") & name_key(_first(o, "a"), _first(o, "d")).eqNullSafe(F.col("__creator")), F.lit(False)))
    df = df.withColumns({"self_subject": F.col("__creator").isNotNull() & own, "primary_document": any_value(PRIMARY)})

    def bare(o: Column) -> Column:
        prior = F.exists(_values(o), lambda v: _has(v, TEXTUAL + CRITICISM + IN_LITERATURE + GENRE))
        return o["tag"].isin(NAMES) & (o["ind2"] == "0") & ~_has(_text(o), QUALIFIERS) & ~prior

    unclear = lambda o: o["tag"].isin(NAMES) & _has(_text(o), QUALIFIERS) & (F.size(_values(o)) == 0)
    sure = lambda test: F.exists("__occ", lambda o: F.coalesce(test(o), F.lit(False)))
    self_, doc = F.col("self_subject"), F.col("primary_document")
    df = df.withColumns(
        {
            "__R1": ~self_ & ~doc & sure(bare),
            "__R2": F.exists("__values", lambda v: _has(v, CRITICISM) & ~_has(v, TEXTUAL)),
            "__R3": ~doc & any_value(IN_LITERATURE),
            "__R5": ~self_ & any_value(BIOGRAPHY),
            "__R6": any_value(GENRE),
            "__R7": F.coalesce(form_008(F.col("field_008")).isin(LITERARY_FORMS), F.lit(False)),
            "__R8": any_value(TEXTUAL),
            "__R9": doc,
            "__unclear": sure(unclear),
        }
    )
    rule = lambda *names: F.lit(False) if not names else _any([F.col(f"__{n}") for n in names])
    secondary = rule("R1", "R2", "R3", "R5")
    confidence = F.when(rule("R1", "R2", "R3"), "high").when(F.col("__R5"), "medium").when(rule("R6", "R7", "R8", "R9"), "high").otherwise("low")
    matched = F.array_compact(F.array(*[F.when(F.col(f"__{n}"), n) for n in ("R1", "R2", "R3", "R5", "R6", "R7", "R8", "R9")]))
    review = self_ | doc | F.col("__unclear") | F.col("__R8") | (~secondary & (confidence == "low"))
    out = df.withColumns({"is_secondary": secondary, "confidence": confidence, "matched_rules": matched, "review_flag": review})
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def _any(tests: list[Column]) -> Column:
    found = tests[0]
    for t in tests[1:]:
        found = found | t
    return found


def classified_records(records: DataFrame) -> DataFrame:
    """Records in scope with their outcome and rendered headings."""
    scoped = records.where(in_scope(F.col("classifications"), F.col("local_call_numbers")))
    found = classify(scoped)
    return found.withColumn("headings", subject_headings(F.filter(F.coalesce(F.col("subject_genre_fields").cast(OCC_TYPE), F.array().cast(OCC_TYPE)), lambda o: o.isNotNull())))
