"""The additive count cube kept up to date over arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(rows: DataFrame, city: str, keys: list[str]) -> DataFrame:
    """``keys, city_n, other_n``; works on streams and tables alike."""
    inside = F.col("city_group").eqNullSafe(city)
    return rows.groupBy(*keys).agg(F.count_if(inside).alias("city_n"), F.count_if(~inside).alias("other_n"))


def add_up(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial counts of any number of files added; a key that a file lacks counts as 0 there."""
    return parts.groupBy(*keys).agg(F.sum("city_n").alias("city_n"), F.sum("other_n").alias("other_n"))


def start_cube(spark: SparkSession, folder: str, schema, city: str, keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Count the rows of the parquet files of a folder; each trigger replaces the table at ``target``.

    State is one row for each combination of keys, not of the input.
    """
    rows = spark.readStream.schema(schema).parquet(folder)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    query = counts(rows, city, keys).writeStream.outputMode("complete").foreachBatch(replace)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def answer_stream(spark: SparkSession, folder: str, schema, target: str, checkpoint: str, key: str = "geo_key") -> StreamingQuery:
    """Append arriving answers once for each key; restarts resume where they stopped."""
    from folioforge.sources.tables import append_answers

    rows = spark.readStream.schema(schema).parquet(folder)
    query = rows.writeStream.foreachBatch(lambda batch, _: append_answers(batch, target, key) and None)
    return query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
