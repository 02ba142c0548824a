"""MARCXML files to the table of records.

The reader streams one record at a time; a gzip file is one task, so the rows are spread by
their file and number only after parsing.  Blanks in values are kept: an 008 has exactly 40
characters.  A record that is not well-formed takes its number and is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioforge.functions.classes import ClassRange

SUBFIELD = "array<struct<_code:string,_VALUE:string>>"
DATAFIELD = f"array<struct<_tag:string,_ind1:string,_ind2:string,subfield:{SUBFIELD}>>"
SCHEMA = f"controlfield array<struct<_tag:string,_VALUE:string>>, datafield {DATAFIELD}"
CORRUPT = "_corrupt_record"

# Tags of the grouped fields.
SUBJECTS = ["600", "610", "611", "630", "650", "651", "655"]
HIERARCHY = ["752"]
IMPRINT = ["260", "264"]
PUBLICATION = [" ", "1"]


def read_marc(spark: SparkSession, path: str, pattern: str = "*.xml.gz", left_out: str = "combined", row_tag: str = "record") -> DataFrame:
    """Parsed records of a folder with ``source_record_id`` = ``file:number``, numbers from 1.

    Files whose names contain ``left_out`` are skipped.  ``row_tag`` has the prefix of
    prefixed files, ``marc:record``.  The record-wise parser goes on after a record that is not well-formed;
    the other one may drop the rest of the file.
    """
    reader = spark.read.format("xml").schema(f"{SCHEMA}, {CORRUPT} string")
    options = {"rowTag": row_tag, "ignoreNamespace": "true", "ignoreSurroundingSpaces": "false", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "pathGlobFilter": pattern, "useLegacyXMLParser": "true"}
    rows = reader.options(**options).load(path).select("*", F.col("_metadata.file_name").alias("file"))
    rows = rows.where(~F.col("file").contains(left_out)).withColumn("__at", F.monotonically_increasing_id())
    number = F.row_number().over(Window.partitionBy("file").orderBy("__at"))
    return rows.withColumn("source_record_id", F.concat_ws(":", "file", number)).drop("__at")


def parse_marc(df: DataFrame, column: str = "xml") -> DataFrame:
    """The same from a column with the XML text of one record a row."""
    parsed = F.from_xml(F.col(column), SCHEMA, {"ignoreNamespace": "true", "ignoreSurroundingSpaces": "false"})
    return df.withColumn("__r", parsed).select(*df.columns, "__r.*")


def _texts(field: Column, code: str) -> Column:
    subs = F.coalesce(field["subfield"], F.array().cast(SUBFIELD))
    kept = F.filter(subs, lambda s: (s["_code"] == code) & s["_VALUE"].isNotNull() & s["_VALUE"].rlike(r"(?U)\S"))
    return F.transform(kept, lambda s: s["_VALUE"])


def _fields(tag: str, test=None) -> Column:
    fields = F.coalesce(F.col("datafield"), F.array().cast(DATAFIELD))
    return F.filter(fields, lambda f: (f["_tag"] == tag) & (F.lit(True) if test is None else test(f)))


def values(tag: str, code: str, test=None) -> Column:
    """All texts of a subfield, in order."""
    return F.flatten(F.transform(_fields(tag, test), lambda f: _texts(f, code)))


def occurrences(tags: list[str]) -> Column:
    """Grouped fields in order; blank subfields are dropped, fields left without any are kept."""
    fields = F.filter(F.coalesce(F.col("datafield"), F.array().cast(DATAFIELD)), lambda f: f["_tag"].isin(tags))

    def one(f: Column) -> Column:
        subs = F.filter(F.coalesce(f["subfield"], F.array().cast(SUBFIELD)), lambda s: s["_VALUE"].isNotNull() & s["_VALUE"].rlike(r"(?U)\S"))
        texts = F.transform(subs, lambda s: F.struct(s["_code"].alias("code"), s["_VALUE"].alias("text")))
        return F.struct(f["_tag"].alias("tag"), F.coalesce(f["_ind2"], F.lit(" ")).alias("ind2"), texts.alias("subfields"))

    return F.transform(fields, one)


def records(parsed: DataFrame, wanted: ClassRange) -> DataFrame:
    """The 18 columns of a record, one projection; all records are kept and flagged.

    Places and publishers of a 264 count only for publication, its dates always.
    """
    published = lambda f: F.coalesce(f["_ind2"], F.lit(" ")).isin(PUBLICATION)
    merged = lambda code, test: F.array_distinct(F.concat(values("260", code), values("264", code, test)))
    first = lambda tag, code: F.get(values(tag, code), F.lit(0))
    controls = F.coalesce("controlfield", F.array().cast("array<struct<_tag:string,_VALUE:string>>"))
    if CORRUPT in parsed.columns:
        parsed = parsed.where(F.col(CORRUPT).isNull())
    return parsed.select(
        first("010", "a").alias("lccn"),
        "source_record_id",
        values("050", "a").alias("classifications"),
        wanted.any(values("050", "a")).alias("matches_class_range"),
        first("245", "a").alias("title"),
        first("245", "b").alias("subtitle"),
        merged("c", None).alias("year"),
        merged("a", published).alias("places"),
        merged("b", published).alias("publishers"),
        occurrences(IMPRINT).alias("imprint_fields"),
        first("100", "a").alias("first_author"),
        first("100", "d").alias("first_author_dates"),
        values("090", "a").alias("local_call_numbers"),
        occurrences(SUBJECTS).alias("subject_genre_fields"),
        F.get(F.filter(controls, lambda c: c["_tag"] == "008"), F.lit(0))["_VALUE"].alias("field_008"),
        values("044", "a").alias("country_codes_044"),
        values("044", "c").alias("country_codes_044_iso"),
        occurrences(HIERARCHY).alias("place_hierarchy_752"),
    )


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def to_xml(df: DataFrame) -> DataFrame:
    """``rec_id, source_record_id, xml``: the MARCXML of records, for exchange and round trips."""

    def field(tag: str, ind2: Column, subs: Column) -> Column:
        inner = F.array_join(F.transform(subs, lambda s: F.concat(F.lit('<subfield code="'), _escape(F.coalesce(s["code"], F.lit(""))), F.lit('">'), _escape(s["text"]), F.lit("</subfield>"))), "")
        return F.concat(F.lit(f'<datafield tag="{tag}" ind1=" " ind2="'), _escape(F.coalesce(ind2, F.lit(" "))), F.lit('">'), inner, F.lit("</datafield>"))

    single = lambda tag, **codes: field(tag, F.lit(" "), F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(k).alias("code"), F.col(c).alias("text"))) for k, c in codes.items()])))
    empty = F.array().cast("array<string>")
    each = lambda tag, c: F.array_join(F.transform(F.filter(F.coalesce(F.col(c), empty), lambda x: x.isNotNull()), lambda x: field(tag, F.lit(" "), F.array(F.struct(F.lit("a").alias("code"), x.alias("text"))))), "")

    def grouped(c: str) -> Column:
        type_ = "array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>"
        kept = F.filter(F.coalesce(F.col(c).cast(type_), F.array().cast(type_)), lambda o: o.isNotNull() & o["tag"].isNotNull())

        def one(o: Column) -> Column:
            subs = F.filter(F.coalesce(o["subfields"], F.array().cast("array<struct<code:string,text:string>>")), lambda s: s.isNotNull() & s["text"].isNotNull())
            return F.concat(F.lit('<datafield tag="'), o["tag"], F.lit('" ind1=" " ind2="'), _escape(F.coalesce(o["ind2"], F.lit(" "))), F.lit('">'), F.array_join(F.transform(subs, lambda s: F.concat(F.lit('<subfield code="'), _escape(F.coalesce(s["code"], F.lit(""))), F.lit('">'), _escape(s["text"]), F.lit("</subfield>"))), ""), F.lit("</datafield>"))

        return F.array_join(F.transform(kept, one), "")

    control = F.when(F.col("field_008").isNotNull(), F.concat(F.lit('<controlfield tag="008">'), _escape(F.col("field_008")), F.lit("</controlfield>"))).otherwise("")
    body = [
        control, single("010", a="lccn"), each("044", "country_codes_044"), each("050", "classifications"), each("090", "local_call_numbers"),
        single("100", a="first_author", d="first_author_dates"), single("245", a="title", b="subtitle"), grouped("imprint_fields"), grouped("subject_genre_fields"), grouped("place_hierarchy_752"),
    ]
    xml = F.concat(F.lit('<record xmlns="http://www.loc.gov/MARC21/slim">'), *body, F.lit("</record>"))
    return df.select("rec_id", "source_record_id", xml.alias("xml"))
