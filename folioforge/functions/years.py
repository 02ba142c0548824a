"""Year functions as Column expressions.  Digits are those of ASCII."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Plausible years and the longest span that still dates a publication.
FIRST, LAST, SPAN = 1500, 2030, 25


def plausible(y: Column) -> Column:
    return y.between(FIRST, LAST)


def year_int(c: Column) -> Column:
    """First plausible year of a text.

    A correction ``i.e. YYYY`` wins; a range of plausible years over 25 apart gives null.
    """
    corrected = F.regexp_extract(c, r"(?i)\bi\.?\s*e\.?\s*[,\s]*(\d{4})(?!\d)", 1).try_cast("int")
    span = r"(?<!\d)(\d{4})\s*[-–—/]\s*(\d{4})(?!\d)"
    starts = F.transform(F.regexp_extract_all(c, F.lit(span), 1), lambda y: y.cast("int"))
    ends = F.transform(F.regexp_extract_all(c, F.lit(span), 2), lambda y: y.cast("int"))
    wide = lambda r: plausible(r["a"]) & plausible(r["b"]) & (F.abs(r["b"] - r["a"]) > SPAN)
    vague = F.exists(F.arrays_zip(starts.alias("a"), ends.alias("b")), wide)
    alone = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{4})(?!\d)"), 1), lambda y: y.cast("int"))
    first = F.get(F.filter(alone, plausible), F.lit(0))
    return F.when(plausible(corrected), corrected).when(~vague, first)


def least_year(texts: Column) -> Column:
    """Least year of an array of texts, null if there is none."""
    years = F.transform(F.coalesce(texts, F.array().cast("array<string>")), year_int)
    return F.array_min(F.filter(years, lambda y: y.isNotNull()))


def decade(y: Column) -> Column:
    return F.when(y > 0, (F.floor(y / 10) * 10).cast("int"))


def place_code_008(c: Column) -> Column:
    """Positions 15 to 17 of an 008 of exactly 40 characters."""
    return F.when(F.length(c) == 40, F.substring(c, 16, 3))


def date1_008(c: Column) -> Column:
    """First date of an 008, null for an uncertain span and for a long or open run."""
    date = lambda at: F.regexp_extract(F.substring(c, at, 4), r"^\d{4}$", 0).try_cast("int")
    kind, one, two = F.substring(c, 7, 1), date(8), date(12)
    unsure = (kind == "q") & (one.isNull() | two.isNull() | (one != two))
    run = (kind == "m") & (two.isNull() | (two - one > SPAN))
    return F.when((F.length(c) == 40) & ~unsure & ~run & plausible(one), one)


def _dates(occurrences: Column, keep) -> Column:
    """Least year of the subfields c of the occurrences that ``keep`` names."""
    chosen = F.filter(occurrences, lambda o: F.coalesce(keep(o), F.lit(False)))
    texts = F.transform(chosen, lambda o: F.transform(F.filter(F.coalesce(o["subfields"], F.array().cast("array<struct<code:string,text:string>>")), lambda s: s["code"] == "c"), lambda s: s["text"]))
    return least_year(F.flatten(texts))


def year_sources(year: Column, publishers: Column, imprint: Column, field_008: Column) -> list[tuple[str, Column]]:
    """The six kinds of evidence for a publication year, best first."""
    tag, ind = lambda o: o["tag"], lambda o: F.coalesce(o["ind2"], F.lit(" "))
    return [
        ("publication", _dates(imprint, lambda o: (tag(o) == "260") | ((tag(o) == "264") & ind(o).isin(" ", "", "1")))),
        ("008", date1_008(field_008)),
        ("copyright", _dates(imprint, lambda o: (tag(o) == "264") & (ind(o) == "4"))),
        ("other_264", _dates(imprint, lambda o: (tag(o) == "264") & ~ind(o).isin(" ", "", "1", "4"))),
        ("legacy", least_year(year)),
        ("publisher", least_year(publishers)),
    ]


def publication_year(sources: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """The first kind of evidence with a year: the year and the kind."""
    chosen = F.lit(None).cast("string")
    for name, year in reversed(sources):
        chosen = F.when(year.isNotNull(), name).otherwise(chosen)
    return F.coalesce(*[y for _, y in sources]), chosen


def legacy_year(year: Column, publishers: Column) -> Column:
    """The older rule: the least year of either, nulls ignored."""
    return F.least(least_year(year), least_year(publishers))


def birth_year(c: Column) -> Column:
    """First four digits anywhere, as text."""
    return F.nullif(F.regexp_extract(c, r"\d{4}", 0), F.lit(""))


def form_008(c: Column) -> Column:
    """Literary form, position 33 of a whole 008."""
    return F.when(F.length(c) == 40, F.substring(c, 34, 1))
