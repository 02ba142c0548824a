"""Joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys above this share of the rows count as hot; at most ``1 / HOT_SHARE`` keys can be,
#: which bounds the list that is broadcast.
HOT_SHARE = 0.005


def hot_keys(df: DataFrame, on: list[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows of ``df``: at most ``1 / share`` rows.

    Counted with map-side combination, so a hot key sends one row per map task.
    """
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"))
    total = df.agg(F.count(F.lit(1)).alias("__total"))  # one row
    return counts.crossJoin(F.broadcast(total)).where(F.col("__n") > F.col("__total") * share).select(*on)


def hot_sums(counts: DataFrame, on: list[str], n: str, share: float = HOT_SHARE) -> DataFrame:
    """The same from a table that already has counts: keys whose ``n`` sums to more than ``share`` of all."""
    sums = counts.groupBy(*on).agg(F.sum(n).alias("__n"))
    total = counts.agg(F.sum(n).alias("__total"))  # one row
    return sums.crossJoin(F.broadcast(total)).where(F.col("__n") > F.col("__total") * share).select(*on)


def salted_join(
    left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", salts: int = 16, share: float = HOT_SHARE, hot: DataFrame | None = None
) -> DataFrame:
    """Equi-join in which rows of ``left`` with hot keys are spread over ``salts`` tasks.

    ``how`` is ``inner``, ``left``, ``left_semi`` or ``left_anti``.  Only the few rows of
    ``right`` with a hot key are copied, once a salt.  Null keys match nothing, as in SQL.
    The salt is a hash of the row, so a task that runs again sends every row where it went
    before; rows of ``left`` should differ in some column, such as an identifier.  ``hot`` has
    the hot keys where they are known, at most ``1 / share``; else ``left`` is counted.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how}")
    hot = (hot_keys(left, on, share) if hot is None else hot).withColumn("__hot", F.lit(True))
    spread = (
        left.join(F.broadcast(hot), on, "left")
        .withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")).otherwise(F.lit(0)))
        .drop("__hot")
    )
    copied = (
        right.join(F.broadcast(hot), on, "left")
        .withColumn(
            "__salt",
            F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))),
        )
        .drop("__hot")
    )
    return spread.join(copied, [*on, "__salt"], how).drop("__salt")
