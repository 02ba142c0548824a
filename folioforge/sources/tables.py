"""Readers and writers of the other files: gazetteer dumps, code lists, exports, resumable answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GAZETTEER = [
    "geonameid", "name", "asciiname", "alternatenames", "lat", "lon", "feature_class", "feature_code", "country", "cc2", "admin1", "admin2", "admin3",
    "admin4", "population", "elevation", "dem", "timezone", "modified",
]
TYPES = {"geonameid": "bigint", "lat": "double", "lon": "double", "population": "bigint", "elevation": "int", "dem": "int"}


def read_gazetteer(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated dump of 19 columns; quotes are data, blanks become null, a blank population 0."""
    parts = F.split(F.col("value"), "\t", -1)
    blank = lambda i: F.nullif(F.get(parts, F.lit(i)), F.lit(""))
    columns = [blank(i).try_cast(TYPES[c]).alias(c) if c in TYPES else blank(i).alias(c) for i, c in enumerate(GAZETTEER)]
    return spark.read.text(list(paths)).select(*columns).fillna(0, ["population"])


def read_regions(spark: SparkSession, path: str, countries: list[str] | None = None) -> DataFrame:
    """``country, admin1, name``: first-level regions; of repeated names in a country the last line counts."""
    parts = F.split(F.col("value"), "\t", -1)
    rows = spark.read.text(path).withColumn("__at", F.monotonically_increasing_id())
    code = F.split(F.get(parts, F.lit(0)), r"\.", 2)
    rows = rows.select(F.get(code, F.lit(0)).alias("country"), F.get(code, F.lit(1)).alias("admin1"), F.get(parts, F.lit(2)).alias("name"), "__at")
    if countries is not None:
        rows = rows.where(F.col("country").isin(countries))
    last = F.row_number().over(Window.partitionBy("country", "name").orderBy(F.col("__at").desc()))
    return rows.withColumn("__p", last).where("__p = 1").select("country", "admin1", "name")


def read_codes(spark: SparkSession, path: str, columns: str) -> DataFrame:
    """A code list with header; every column is text, blanks become null."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c.strip()} string" for c in columns.split(",")))
    return rows.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) for c in rows.columns])


def read_rows(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """A CSV with header under given types, identifiers as text; missing columns become null."""
    rows = spark.read.csv(path, header=True, inferSchema=False, escape='"', multiLine=True)
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).try_cast(t).alias(c) for c, t in columns.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header; arrays are joined by ``; ``, blanks at the ends of texts are kept."""
    arrays = {f.name for f in df.schema if f.dataType.typeName() == "array"}
    df.select(*[F.array_join(F.transform(c, lambda x: x.cast("string")), "; ").alias(c) if c in arrays else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"')


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct non-blank texts, one a line; the files in the order of their names are sorted."""
    df.where(F.trim(column) != "").select(column).distinct().orderBy(column).write.mode("overwrite").text(path)


def append_answers(answers: DataFrame, path: str, key: str = "geo_key") -> DataFrame:
    """Append answers whose key the file does not have yet and return those; safe to repeat."""
    spark = answers.sparkSession
    try:
        done = spark.read.parquet(path).select(key)
        answers = answers.join(done, key, "left_anti")
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    answers = answers.dropDuplicates([key])
    answers.write.mode("append").parquet(path)
    return answers
