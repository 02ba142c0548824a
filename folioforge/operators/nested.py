"""Deeply nested semi-structured records to related flat tables.

One projection per source: nested ``transform`` calls attach the record key, the
occurrence position and the subfield position to every leaf, ``flatten`` joins the arrays
and one ``inline`` per target table emits the rows.  No shuffle, no Python.

Tables and links::

    occurrences(field_name, rec_id, occ_pos, tag, ind2, n_subfields)
    subfields  (field_name, rec_id, occ_pos, sub_pos, code, text)

``(field_name, rec_id, occ_pos)`` is the parent key of a subfield.  Positions count from 0
as delivered, null and blank elements included.

Defined results: a null or empty field has no rows; a null occurrence takes a position and
has no row; an occurrence without subfields is an occurrence row with 0 subfields; a null
subfield takes a position and has no row; a lone object counts as a list of one; a payload
that is not whole JSON, or not an object, has no rows; null ``rec_id`` is carried through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCC_TYPE = "array<struct<tag:string,ind2:string,subfields:array<struct<code:string,text:string>>>>"


def _parts(value: str) -> str:
    """SQL: a variant as an array of variants; a lone object or scalar becomes a list of one."""
    return (
        f"case when {value} is null or is_variant_null({value}) then cast(array() as array<variant>) "
        f"when schema_of_variant({value}) like 'ARRAY%' then try_variant_get({value}, '$', 'array<variant>') "
        f"else array({value}) end"
    )


def json_occurrences(root: str, field: str) -> Column:
    """Canonical occurrences of ``field`` in a variant column ``root``.

    Subfields may be objects with ``code`` and ``text`` or ``[code, text]`` pairs; either
    container may be a list or a lone element.
    """
    whole = f"case when schema_of_variant({root}) like 'OBJECT%' then try_variant_get({root}, '$.{field}', 'variant') end"
    pair = "schema_of_variant(s) like 'ARRAY%'"
    subs = "try_variant_get(o, '$.subfields', 'variant')"
    # A lone [code, text] pair would read as a list of scalars: scalars have no code or text.
    sub = (
        "case when s is null or is_variant_null(s) then null else named_struct("
        f"'code', case when {pair} then try_variant_get(s, '$[0]', 'string') else try_variant_get(s, '$.code', 'string') end, "
        f"'text', case when {pair} then try_variant_get(s, '$[1]', 'string') else try_variant_get(s, '$.text', 'string') end) end"
    )
    occ = (
        "case when o is null or is_variant_null(o) then null else named_struct("
        "'tag', try_variant_get(o, '$.tag', 'string'), 'ind2', try_variant_get(o, '$.ind2', 'string'), "
        f"'subfields', transform({_parts(subs)}, s -> {sub})) end"
    )
    return F.expr(f"transform({_parts(whole)}, o -> {occ})").cast(OCC_TYPE)


def canonical_json(df: DataFrame, fields: list[str], payload: str = "payload", rec_id: str = "rec_id") -> DataFrame:
    """``rec_id`` and the canonical occurrence arrays of ``fields`` from JSON payloads.

    Text after the closing brace makes a payload broken; so do repeated keys in an object.
    """
    whole = F.when(F.regexp_replace(payload, r"\s+$", "").endswith("}"), F.col(payload))
    parsed = df.select(F.col(rec_id).cast("bigint").alias("rec_id"), F.try_parse_json(whole).alias("__json"))
    return parsed.select("rec_id", *[json_occurrences("__json", f).alias(f) for f in fields])


def canonical_typed(df: DataFrame, fields: list[str], rec_id: str = "rec_id") -> DataFrame:
    """``rec_id`` and the occurrence arrays of ``fields`` of an already typed table."""
    return df.select(F.col(rec_id).cast("bigint").alias("rec_id"), *[F.col(f).cast(OCC_TYPE).alias(f) for f in fields])


def _leaves(field: str) -> Column:
    def occurrence(o: Column, i: Column) -> Column:
        rows = F.transform(
            F.coalesce(o["subfields"], F.array().cast("array<struct<code:string,text:string>>")),
            lambda s, j: F.when(
                s.isNotNull(),
                F.struct(
                    F.lit(field).alias("field_name"),
                    F.col("rec_id"),
                    i.alias("occ_pos"),
                    j.alias("sub_pos"),
                    s["code"].alias("code"),
                    s["text"].alias("text"),
                ),
            ),
        )
        return F.filter(rows, lambda r: r.isNotNull())

    nested = F.transform(F.coalesce(F.col(field), F.array().cast(OCC_TYPE)), occurrence)
    return F.flatten(F.filter(nested, lambda rows: rows.isNotNull()))


def _branches(field: str) -> Column:
    rows = F.transform(
        F.coalesce(F.col(field), F.array().cast(OCC_TYPE)),
        lambda o, i: F.when(
            o.isNotNull(),
            F.struct(
                F.lit(field).alias("field_name"),
                F.col("rec_id"),
                i.alias("occ_pos"),
                o["tag"].alias("tag"),
                o["ind2"].alias("ind2"),
                F.coalesce(F.size(o["subfields"]), F.lit(0)).alias("n_subfields"),
            ),
        ),
    )
    return F.filter(rows, lambda r: r.isNotNull())


def _inline(df: DataFrame, columns: list[Column]) -> DataFrame:
    return df.select(F.inline(F.flatten(F.array(*columns))))


def subfield_rows(canonical: list[DataFrame], fields: list[str]) -> DataFrame:
    """The subfields table of one or more canonical sources."""
    return reduce(DataFrame.unionByName, [_inline(df, [_leaves(f) for f in fields]) for df in canonical])


def occurrence_rows(canonical: list[DataFrame], fields: list[str]) -> DataFrame:
    """The occurrences table of one or more canonical sources."""
    return reduce(DataFrame.unionByName, [_inline(df, [_branches(f) for f in fields]) for df in canonical])
