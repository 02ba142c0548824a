"""Queries over annual series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions.classes import BINS, assign_bin
from folioforge.functions.text import NO_PLACE, canonical_place
from folioforge.operators import series as S
from folioforge.plans import oracle as O
from folioforge.session import table

CITY, START, END, WINDOW = "Vorham", 1900, 2010, 5
SPLIT = 1960


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "imprint_places")


def _r(*columns: str):
    return [F.round(F.col(c), 6).alias(c) for c in columns]


def city_share(spark, sf_dir):
    return S.city_share(_rows(spark, sf_dir), CITY, START, END).select("year_min", *_r("share"))


def city_share_smoothed(spark, sf_dir):
    return S.city_share(_rows(spark, sf_dir), CITY, START, END, WINDOW).select("year_min", *_r("share"))


def city_share_ci(spark, sf_dir):
    return S.city_share(_rows(spark, sf_dir), CITY, START, END, WINDOW, interval=True).select("year_min", *_r("share", "low", "high"))


def category_counts(spark, sf_dir):
    """City, other and no place on every year of the window."""
    rows = S.in_years(_rows(spark, sf_dir), START, END)
    kind = F.when(F.col("city_group") == CITY, "city").when(F.col("city_group") == NO_PLACE, "no_place").otherwise("other")
    counts = rows.withColumn("kind", kind).groupBy("year_min").pivot("kind", ["city", "other", "no_place"]).count()
    return S.fill_years(counts, S.spine(rows, START, END), ["city", "other", "no_place"])


def poisson_band(spark, sf_dir):
    """City counts with a 95 per cent Poisson band, not below 0."""
    counts = category_counts(spark, sf_dir).select("year_min", F.col("city").alias("n"))
    half = S.Z95 * F.sqrt("n")
    return counts.select("year_min", "n", F.round(F.greatest(F.col("n") - half, F.lit(0.0)), 6).alias("low"), F.round(F.col("n") + half, 6).alias("high"))


def unique_publishers(spark, sf_dir):
    return S.in_years(_rows(spark, sf_dir), START, END).groupBy("year_min").agg(F.count_distinct("publisher_clean").alias("publishers"))


def publisher_correlation(spark, sf_dir):
    """Pearson correlation of other counts and publishers over the years that both have; null if either is constant."""
    other = category_counts(spark, sf_dir).select("year_min", F.col("other").alias("a"))
    both = other.join(unique_publishers(spark, sf_dir).withColumnRenamed("publishers", "b"), "year_min")
    varies = (F.stddev_pop("a") > 0) & (F.stddev_pop("b") > 0)
    found = both.agg(varies.alias("varies"), F.count(F.lit(1)).alias("years"), F.covar_pop("a", "b").alias("c"), (F.stddev_pop("a") * F.stddev_pop("b")).alias("s"))
    return found.select("years", F.when(F.col("varies"), F.round(F.try_divide("c", "s"), 6)).alias("correlation"))


def _binned(spark, sf_dir):
    rows = S.placed(S.in_years(_rows(spark, sf_dir), START, END))
    return rows.withColumn("bin", assign_bin(F.col("class_digits"))).where("bin is not null")


def _bin_spine(spark):
    bins = F.explode(F.array(*[F.lit(b[0]) for b in BINS])).alias("bin")
    return S.spine(spark.range(1), START, END).select("year_min", bins)


def range_share_matrix(spark, sf_dir):
    """Smoothed share by year and class bin; cells of fewer than 5 smoothed rows are null."""
    counts = S.city_counts(_binned(spark, sf_dir), CITY, "bin")
    full = S.fill_years(counts, _bin_spine(spark), ["city_n", "other_n"], "bin")
    smooth = S.rolling(full, ["city_n", "other_n"], WINDOW, "bin")
    enough = F.round(F.col("city_n") + F.col("other_n"), 9) >= 5
    return smooth.select("bin", "year_min", F.when(enough, F.round(S.share(), 6)).alias("share"))


def range_totals(spark, sf_dir):
    """Rows of each bin with the first, highest and last year of its share."""
    counts = S.city_counts(_binned(spark, sf_dir), CITY, "bin").withColumn("share", F.round(S.share(), 6))
    total = counts.groupBy("bin").agg(
        F.sum(F.col("city_n") + F.col("other_n")).alias("n"), F.min_by("share", "year_min").alias("first_share"), F.max_by("share", "year_min").alias("last_share")
    )
    peak = S.first_extreme(counts, "share", "bin").select("bin", F.col("year_min").alias("peak_year"), F.col("share").alias("peak_share"))
    return total.join(peak, "bin")


def featured_ranges(spark, sf_dir):
    """Bins with at least a tenth of all binned rows, in their fixed order."""
    counts = _binned(spark, sf_dir).groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    place = F.array_position(F.array(*[F.lit(b[0]) for b in BINS]), F.col("bin")).cast("int").alias("place")
    return counts.crossJoin(F.broadcast(total)).where("n >= 0.1 * total").select("bin", "n", place).orderBy("place")


def peak_year(spark, sf_dir):
    return S.first_extreme(city_share(spark, sf_dir), "share")


def crossing_stats(spark, sf_dir):
    """The city's share never nears half here, so the level is 12 per cent."""
    return S.crossing_stats(city_share(spark, sf_dir), level=12)


def period_probability(spark, sf_dir):
    return S.period_probability(_rows(spark, sf_dir), CITY, SPLIT, START, END).select("period", "n", *_r("p", "odds", "odds_ratio"))


def first_occurrence(spark, sf_dir):
    """First year and group of each pair of publisher and place."""
    return S.first_occurrence(_rows(spark, sf_dir), ["publisher_clean", "places_clean"], "obs_id")


def new_publisher_share(spark, sf_dir):
    """Share of the city among first occurrences by year."""
    return S.city_share(first_occurrence(spark, sf_dir), CITY, START, END, WINDOW).select("year_min", *_r("share"))


def first_appearance_stats(spark, sf_dir):
    """Places that first appear after 1950."""
    first = _rows(spark, sf_dir).where("trim(places_clean) <> '' and year_min is not null").groupBy("places_clean").agg(F.min("year_min").alias("y"))
    late = F.count_if(F.col("y") > 1950)
    return first.agg(F.count(F.lit(1)).alias("places"), late.alias("after"), F.round(F.coalesce(F.try_divide(100.0 * late, F.count(F.lit(1))), F.lit(0.0)), 6).alias("percent"))


def first_appearance_canonical(spark, sf_dir):
    """The same of places in their canonical form; markers of no place are none."""
    rows = _rows(spark, sf_dir).where("year_min is not null").select(canonical_place(F.col("places_clean")).alias("place"), "year_min").where("place is not null")
    first = rows.groupBy("place").agg(F.min("year_min").alias("y"))
    late = F.count_if(F.col("y") > 1950)
    return first.agg(F.count(F.lit(1)).alias("places"), late.alias("after"), F.round(F.coalesce(F.try_divide(100.0 * late, F.count(F.lit(1))), F.lit(0.0)), 6).alias("percent"))


def _real():
    return F.col("places_clean").isNotNull() & (F.trim("places_clean") != "") & ~F.col("city_group").eqNullSafe(NO_PLACE)


def place_histogram(spark, sf_dir):
    """Records with none, one or several real places."""
    k = _rows(spark, sf_dir).where("lccn is not null").groupBy("lccn").agg(F.count_if(_real()).alias("k"))
    bucket = F.when(F.col("k") == 0, "0").when(F.col("k") == 1, "1").otherwise(">1").alias("bucket")
    by = k.groupBy(bucket).agg(F.count(F.lit(1)).alias("records"))
    total = by.agg(F.sum("records").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("bucket", "records", F.round(100.0 * F.col("records") / F.col("total"), 6).alias("percent"))


def place_share_methods(spark, sf_dir):
    """Share by year where a record of several places is dropped, split or counted in full."""
    rows = _rows(spark, sf_dir).where("lccn is not null")
    k = rows.groupBy("lccn").agg(F.count_if(_real()).alias("k"))
    counted = S.placed(S.in_years(rows, START, END)).join(k, "lccn")
    weights = {
        "drop": F.when(F.col("k") <= 1, 1.0).otherwise(0.0),
        "fractional": 1.0 / F.greatest(F.col("k"), F.lit(1)),
        "equal": F.lit(1.0),
    }
    methods = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), w.alias("weight")) for m, w in weights.items()]))
    spread = counted.select("year_min", "city_group", methods.alias("m")).select("year_min", "city_group", "m.*").where("weight > 0")
    shares = S.city_counts(spread, CITY, "method", weight=F.col("weight"))
    return shares.select("method", "year_min", F.round(S.share(), 6).alias("share"))


QUERIES = {
    f.__name__: f
    for f in (
        city_share, city_share_smoothed, city_share_ci, category_counts, poisson_band, unique_publishers, publisher_correlation, range_share_matrix,
        range_totals, featured_ranges, peak_year, crossing_stats, period_probability, first_occurrence, new_publisher_share, first_appearance_stats, first_appearance_canonical,
        place_histogram, place_share_methods,
    )
}

_COUNTS = f"""counts AS (
  SELECT year_min, sum((city_group IS NOT DISTINCT FROM '{CITY}')::INT) AS c, sum((city_group IS DISTINCT FROM '{CITY}')::INT) AS o
  FROM imprint_places WHERE year_min BETWEEN {START} AND {END} AND city_group IS DISTINCT FROM '{NO_PLACE}' GROUP BY 1
)"""
_SMOOTH = f"""smooth AS (
  SELECT year_min, c AS c0, o AS o0, avg(c) OVER w AS c, avg(o) OVER w AS o FROM counts
  WINDOW w AS (ORDER BY year_min ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
)"""
_SHARE = f"share AS (SELECT year_min, round(100.0 * c / nullif(c + o, 0), 6) AS share FROM counts)"
_CATEGORIES = f"""SELECT y.year_min::INT AS year_min, coalesce(sum((city_group = '{CITY}')::INT), 0)::BIGINT AS city,
  coalesce(sum((obs_id IS NOT NULL AND city_group IS DISTINCT FROM '{CITY}' AND city_group IS DISTINCT FROM '{NO_PLACE}')::INT), 0)::BIGINT AS other,
  coalesce(sum((city_group = '{NO_PLACE}')::INT), 0)::BIGINT AS no_place
FROM range({START}, {END + 1}) y(year_min) LEFT JOIN imprint_places p ON p.year_min = y.year_min GROUP BY 1"""
_UNIQUE = f"SELECT year_min, count(DISTINCT publisher_clean) AS publishers FROM imprint_places WHERE year_min BETWEEN {START} AND {END} GROUP BY 1"
_BIN = "CASE " + " ".join(f"WHEN class_digits BETWEEN {a} AND {b} THEN '{n}'" for n, a, b in BINS) + " END"
_BINNED = f"""binned AS (
  SELECT {_BIN} AS bin, year_min, city_group FROM imprint_places
  WHERE year_min BETWEEN {START} AND {END} AND city_group IS DISTINCT FROM '{NO_PLACE}' AND {_BIN} IS NOT NULL
), cells AS (
  SELECT bin, year_min, sum((city_group IS NOT DISTINCT FROM '{CITY}')::INT)::BIGINT AS c, sum((city_group IS DISTINCT FROM '{CITY}')::INT)::BIGINT AS o
  FROM binned GROUP BY 1, 2
)"""
_FIRST = f"""SELECT publisher_clean, places_clean, min(year_min) AS year_min, arg_min(city_group, obs_id) FILTER (city_group IS NOT NULL) AS city_group
FROM imprint_places WHERE publisher_clean IS NOT NULL AND places_clean IS NOT NULL AND year_min IS NOT NULL GROUP BY 1, 2"""
_REAL = f"(places_clean IS NOT NULL AND trim(places_clean) <> '' AND city_group IS DISTINCT FROM '{NO_PLACE}')"

SQL = {
    "city_share": f"WITH {_COUNTS}, {_SHARE} SELECT * FROM share",
    "city_share_smoothed": f"WITH {_COUNTS}, {_SMOOTH} SELECT year_min, round(100.0 * c / nullif(c + o, 0), 6) AS share FROM smooth",
    "city_share_ci": f"""WITH {_COUNTS}, {_SMOOTH}, band AS (SELECT *, c0 / (c0 + o0) AS p, 1.96 * sqrt(c0 / (c0 + o0) * (1 - c0 / (c0 + o0)) / (c0 + o0)) AS h FROM smooth)
SELECT year_min, round(100.0 * c / nullif(c + o, 0), 6) AS share, round(greatest(100 * (p - h), 0.0), 6) AS low, round(least(100 * (p + h), 100.0), 6) AS high FROM band""",
    "category_counts": _CATEGORIES,
    "poisson_band": f"""SELECT year_min, city AS n, round(greatest(city - 1.96 * sqrt(city), 0.0), 6) AS low, round(city + 1.96 * sqrt(city), 6) AS high FROM ({_CATEGORIES})""",
    "unique_publishers": _UNIQUE,
    "publisher_correlation": f"SELECT count(*) AS years, round(corr(other, publishers), 6) AS correlation FROM ({_CATEGORIES}) JOIN ({_UNIQUE}) USING (year_min)",
    "range_share_matrix": f"""WITH {_BINNED}, grid AS (
  SELECT b.bin, y.year_min::INT AS year_min, coalesce(c, 0) AS c, coalesce(o, 0) AS o
  FROM (VALUES {', '.join(f"('{b[0]}')" for b in BINS)}) b(bin) CROSS JOIN range({START}, {END + 1}) y(year_min) LEFT JOIN cells ON cells.bin = b.bin AND cells.year_min = y.year_min
), smooth AS (
  SELECT bin, year_min, avg(c) OVER w AS c, avg(o) OVER w AS o FROM grid
  WINDOW w AS (PARTITION BY bin ORDER BY year_min ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW)
) SELECT bin, year_min, CASE WHEN round(c + o, 9) >= 5 THEN round(100.0 * c / nullif(c + o, 0), 6) END AS share FROM smooth""",
    "range_totals": f"""WITH {_BINNED}, s AS (SELECT *, round(100.0 * c / (c + o), 6) AS share FROM cells),
p AS (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY share DESC, year_min) AS k FROM s)
SELECT bin, sum(c + o)::BIGINT AS n, arg_min(share, year_min) AS first_share, arg_max(share, year_min) AS last_share,
  max(CASE WHEN k = 1 THEN year_min END) AS peak_year, max(CASE WHEN k = 1 THEN share END) AS peak_share FROM p GROUP BY 1""",
    "featured_ranges": f"""WITH {_BINNED}, n AS (SELECT bin, count(*) AS n FROM binned GROUP BY 1)
SELECT bin, n, list_position([{', '.join(f"'{b[0]}'" for b in BINS)}], bin)::INT AS place FROM n WHERE n >= 0.1 * (SELECT sum(n) FROM n)""",
    "peak_year": f"WITH {_COUNTS}, {_SHARE} SELECT * FROM share ORDER BY share DESC, year_min LIMIT 1",
    "crossing_stats": f"""WITH {_COUNTS}, {_SHARE}, b AS (SELECT min(year_min) FILTER (round_even(share, 0) >= 12) AS first_above, max(year_min) FILTER (round_even(share, 0) >= 12) AS last_above FROM share)
SELECT first_above, last_above, (SELECT min(year_min) FROM share WHERE round_even(share, 0) < 12 AND year_min > first_above) AS first_below_after,
  (SELECT year_min FROM share ORDER BY share DESC, year_min LIMIT 1) AS peak_year, (SELECT max(share) FROM share) AS peak_share,
  (SELECT year_min FROM share ORDER BY share, year_min LIMIT 1) AS lowest_year FROM b""",
    "period_probability": f"""WITH p AS (
  SELECT CASE WHEN year_min < {SPLIT} THEN 'before' ELSE 'from' END AS period, count(*) AS n, avg((city_group IS NOT DISTINCT FROM '{CITY}')::INT) AS p
  FROM imprint_places WHERE year_min BETWEEN {START} AND {END} AND city_group IS DISTINCT FROM '{NO_PLACE}' GROUP BY 1
) SELECT period, n, round(p, 6) AS p, round(p / (1 - p), 6) AS odds, round((p / (1 - p)) / (SELECT p / (1 - p) FROM p WHERE period = 'before'), 6) AS odds_ratio FROM p""",
    "first_occurrence": _FIRST,
    "new_publisher_share": f"WITH imprint_firsts AS ({_FIRST}), {_COUNTS.replace('FROM imprint_places', 'FROM imprint_firsts')}, {_SMOOTH} SELECT year_min, round(100.0 * c / nullif(c + o, 0), 6) AS share FROM smooth",
    "first_appearance_canonical": f"""SELECT count(*) AS places, count(*) FILTER (y > 1950) AS "after", round(coalesce(100.0 * count(*) FILTER (y > 1950) / nullif(count(*), 0), 0), 6) AS percent
FROM (SELECT canonical, min(year_min) AS y FROM imprint_places JOIN ({O.canonical('SELECT DISTINCT places_clean FROM imprint_places', 'places_clean', O.states())}) USING (places_clean)
  WHERE canonical IS NOT NULL AND year_min IS NOT NULL GROUP BY 1)""",
    "first_appearance_stats": """SELECT count(*) AS places, count(*) FILTER (y > 1950) AS "after", round(coalesce(100.0 * count(*) FILTER (y > 1950) / nullif(count(*), 0), 0), 6) AS percent
FROM (SELECT places_clean, min(year_min) AS y FROM imprint_places WHERE trim(places_clean) <> '' AND year_min IS NOT NULL GROUP BY 1)""",
    "place_histogram": f"""WITH k AS (SELECT lccn, sum({_REAL}::INT) AS k FROM imprint_places WHERE lccn IS NOT NULL GROUP BY 1)
SELECT CASE WHEN k = 0 THEN '0' WHEN k = 1 THEN '1' ELSE '>1' END AS bucket, count(*) AS records, round(100.0 * count(*) / (SELECT count(*) FROM k), 6) AS percent FROM k GROUP BY 1""",
    "place_share_methods": f"""WITH k AS (SELECT lccn, sum({_REAL}::INT) AS k FROM imprint_places WHERE lccn IS NOT NULL GROUP BY 1),
w AS (SELECT year_min, city_group, k FROM imprint_places JOIN k USING (lccn) WHERE year_min BETWEEN {START} AND {END} AND city_group IS DISTINCT FROM '{NO_PLACE}'),
m AS (SELECT 'drop' AS method, year_min, city_group, 1.0::DOUBLE AS weight FROM w WHERE k <= 1
  UNION ALL SELECT 'fractional', year_min, city_group, 1.0::DOUBLE / greatest(k, 1) FROM w UNION ALL SELECT 'equal', year_min, city_group, 1.0 FROM w)
SELECT method, year_min, round(100.0 * coalesce(sum(weight) FILTER (city_group IS NOT DISTINCT FROM '{CITY}'), 0) / sum(weight), 6) AS share FROM m GROUP BY 1, 2""",
}
