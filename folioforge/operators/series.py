"""Annual series: counts, shares, smoothing, bands, spines and their statistics.

Generic in column names.  Each aggregates before any window, so an ordered window without a
partition only ever sees one row a year.  Rows with a null year take part in no series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions.text import NO_PLACE

Z95 = 1.96


def in_years(df: DataFrame, start: int, end: int, year: str = "year_min") -> DataFrame:
    """Rows of an inclusive window of years."""
    return df.where(F.col(year).between(start, end))


def placed(df: DataFrame, group: str = "city_group", no_place: str = NO_PLACE) -> DataFrame:
    """Rows whose group is not the one without a place; a null group stays."""
    return df.where(~F.col(group).eqNullSafe(no_place))


def city_counts(df: DataFrame, city: str, *keys: str, year: str = "year_min", group: str = "city_group", weight: Column | None = None) -> DataFrame:
    """``keys, year, city_n, other_n``: rows, or weights, in and out of the city."""
    inside = F.col(group).eqNullSafe(city)
    unit = F.lit(1) if weight is None else weight
    return df.groupBy(*keys, year).agg(
        F.sum(F.when(inside, unit).otherwise(0)).alias("city_n"), F.sum(F.when(~inside, unit).otherwise(0)).alias("other_n")
    )


def rolling(df: DataFrame, columns: list[str], window: int, *keys: str, year: str = "year_min") -> DataFrame:
    """Trailing mean over ``window`` existing rows, fewer at the start; a window under 1 counts as 1."""
    frame = Window.partitionBy(*keys).orderBy(year).rowsBetween(1 - max(1, window), 0)
    return df.withColumns({c: F.avg(c).over(frame) for c in columns})


def share(part: str = "city_n", rest: str = "other_n") -> Column:
    """Per cent of the part; null without any."""
    return F.try_divide(100.0 * F.col(part), F.col(part) + F.col(rest))


def wald(part: str = "city_n", rest: str = "other_n") -> tuple[Column, Column]:
    """95 per cent Wald interval of a share in per cent, kept within 0 and 100."""
    n = F.col(part) + F.col(rest)
    p = F.try_divide(F.col(part), n)
    half = Z95 * F.sqrt(F.try_divide(p * (1 - p), n))
    return F.greatest(100 * (p - half), F.lit(0.0)), F.least(100 * (p + half), F.lit(100.0))


def spine(df: DataFrame, start: int, end: int, year: str = "year_min") -> DataFrame:
    """One row for each year of a window."""
    return df.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias(year))


def fill_years(counts: DataFrame, years: DataFrame, columns: list[str], *keys: str, year: str = "year_min") -> DataFrame:
    """Counts on every year of a spine (times keys), 0 where there were none."""
    return years.join(counts, [*keys, year], "left").fillna(0, columns)


def city_share(df: DataFrame, city: str, start: int, end: int, window: int = 1, interval: bool = False) -> DataFrame:
    """Share of the city by year over the rows with a place; ``window`` smooths the counts.

    The interval, where asked for, comes from the counts before smoothing.
    """
    counts = city_counts(placed(in_years(df, start, end)), city)
    low, high = wald()
    band = {"low": low, "high": high} if interval else {}
    counts = counts.withColumns(band) if band else counts
    return rolling(counts, ["city_n", "other_n"], window).select("year_min", share().alias("share"), *band)


def first_extreme(df: DataFrame, value: str, *keys: str, largest: bool = True, year: str = "year_min") -> DataFrame:
    """The row with the largest (or least) value of each key, the earliest of a tie; null values are skipped."""
    order = F.col(value).desc() if largest else F.col(value).asc()
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order, F.col(year).asc()))
    return df.where(F.col(value).isNotNull()).withColumn("__place", place).where("__place = 1").drop("__place")


def crossing_stats(series: DataFrame, value: str = "share", level: int = 50, year: str = "year_min") -> DataFrame:
    """One row: first and last year at or above a level, half-even rounded; the first below after; the peak."""
    above = F.bround(F.col(value), 0) >= level
    bounds = series.agg(F.min(F.when(above, F.col(year))).alias("first_above"), F.max(F.when(above, F.col(year))).alias("last_above"))
    below = series.crossJoin(F.broadcast(bounds)).where(~above & (F.col(year) > F.col("first_above"))).agg(F.min(year).alias("first_below_after"))
    peak = first_extreme(series, value, year=year).select(F.col(year).alias("peak_year"), F.col(value).alias("peak_share"))
    low = first_extreme(series, value, largest=False, year=year).select(F.col(year).alias("lowest_year"))
    return bounds.crossJoin(below).join(peak, how="left").join(low, how="left")


def period_probability(df: DataFrame, city: str, split: int, start: int, end: int) -> DataFrame:
    """``period, n, p, odds, odds_ratio`` before and from a year; the ratio is to the earlier period."""
    rows = placed(in_years(df, start, end))
    period = F.when(F.col("year_min") < split, "before").otherwise("from")
    inside = F.col("city_group").eqNullSafe(city).cast("double")
    by = rows.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("n"), F.avg(inside).alias("p"))
    by = by.withColumn("odds", F.try_divide(F.col("p"), 1 - F.col("p")))
    base = by.where("period = 'before'").select(F.col("odds").alias("__base"))
    return by.join(F.broadcast(base), how="left").withColumn("odds_ratio", F.try_divide(F.col("odds"), F.col("__base"))).drop("__base")


def first_occurrence(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """``keys, year_min, city_group``: earliest year, and first non-null group by ``order``, of each key."""
    known = df.where(F.col("year_min").isNotNull())
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    group = F.min(F.when(F.col("city_group").isNotNull(), F.struct(F.col(order), F.col("city_group"))))["city_group"]
    return known.groupBy(*keys).agg(F.min("year_min").alias("year_min"), group.alias("city_group"))


def marker_size(n: Column, largest: Column, smallest_size: float = 4.0, largest_size: float = 400.0) -> Column:
    """Marker sizes that grow with the root of a count."""
    return smallest_size + (largest_size - smallest_size) * F.try_divide(F.sqrt(n), F.sqrt(largest))
