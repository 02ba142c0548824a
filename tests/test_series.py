import pandas as pd

from folioforge.functions.text import NO_PLACE
from folioforge.operators import series as S

SCHEMA = "obs_id bigint, year_min int, city_group string, publisher_clean string, places_clean string, share int"


def table(spark, rows):
    return spark.createDataFrame([(i, y, g, p, c, 0) for i, (y, g, p, c) in enumerate(rows)], SCHEMA)


ROWS = [(1900, "X", "p", "a"), (1900, "O", "p", "b"), (1902, "X", "q", "a"), (1902, NO_PLACE, None, None), (1905, "O", "q", "c"), (None, "X", "r", "a"), (1905, None, "p", "d"), (1800, "X", "z", "a")]


def test_share_and_smoothing(spark):
    df = table(spark, ROWS)
    got = {r.year_min: r.share for r in S.city_share(df, "X", 1900, 1910).collect()}
    assert got == {1900: 50.0, 1902: 100.0, 1905: 0.0}
    counts = pd.DataFrame({"c": [1, 1, 0], "o": [1, 0, 2]}).rolling(2, min_periods=1).mean()
    want = (100 * counts.c / (counts.c + counts.o)).tolist()
    smooth = [r.share for r in S.city_share(df, "X", 1900, 1910, window=2).orderBy("year_min").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(smooth, want))
    assert S.city_share(df, "X", 1900, 1910, window=-3).count() == 3
    assert S.city_share(df.limit(0), "X", 1900, 1910, interval=True).count() == 0


def test_ties_and_crossing(spark):
    df = spark.createDataFrame([(1901, 49.5), (1902, 50.5), (1903, 50.5), (1904, 20.0), (1905, None)], "year_min int, share double")
    assert S.first_extreme(df, "share").first().year_min == 1902
    got = S.crossing_stats(df).first()
    # half-even: 49.5 and 50.5 both round to 50
    assert (got.first_above, got.last_above, got.first_below_after, got.peak_year, got.lowest_year) == (1901, 1903, 1904, 1902, 1904)
    assert S.crossing_stats(df.limit(0)).first().peak_year is None


def test_periods_and_first(spark):
    df = table(spark, ROWS)
    got = {r.period: r for r in S.period_probability(df, "X", 1902, 1900, 1910).collect()}
    assert got["before"].n == 2 and got["before"].p == 0.5 and got["from"].n == 3
    first = {(r.publisher_clean, r.places_clean): (r.year_min, r.city_group) for r in S.first_occurrence(df, ["publisher_clean", "places_clean"], "obs_id").collect()}
    assert first[("p", "d")] == (1905, None) and first[("q", "a")] == (1902, "X") and ("r", "a") not in first


def test_spine(spark):
    counts = S.city_counts(S.in_years(table(spark, ROWS), 1900, 1905), "X")
    full = S.fill_years(counts, S.spine(counts, 1899, 1905), ["city_n", "other_n"])
    assert full.count() == 7 and full.where("year_min = 1901").first().city_n == 0
