import json

from folioforge.operators import nested as N

FIELDS = ["subject_genre_fields", "place_hierarchy_752"]
RAW = "rec_id bigint, payload string, pos int, code string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def found(spark, payloads):
    df = spark.createDataFrame([(i, p, 9, "clash") for i, p in enumerate(payloads)], RAW)
    return N.canonical_json(df, FIELDS)


def test_shapes_of_json(spark):
    occ = {"tag": "650", "ind2": "0", "subfields": [{"code": "a", "text": "x"}, None, {"code": None, "text": " "}]}
    pair = {"tag": "650", "subfields": [["a", "y"], ["b", None]]}
    payloads = [
        json.dumps({"subject_genre_fields": [occ, None, pair]}),
        json.dumps({"subject_genre_fields": occ}),
        json.dumps({"subject_genre_fields": {"tag": "650", "subfields": {"code": "a", "text": "lone"}}}),
        json.dumps({"subject_genre_fields": None, "place_hierarchy_752": []}),
        json.dumps({"subject_genre_fields": [{"tag": "1", "subfields": None}, {"tag": "2", "subfields": []}]}),
        json.dumps({"subject_genre_fields": [occ]})[:-1],
        json.dumps({"subject_genre_fields": [occ]}) + "{",
        "[1]", "", None, "null", '{"subject_genre_fields": 5}', '{"subject_genre_fields": ["text"]}',
    ]
    subs = rows(N.subfield_rows([found(spark, payloads)], FIELDS).select("rec_id", "occ_pos", "sub_pos", "text").fillna("-"))
    assert subs == [
        (0, 0, 0, "x"), (0, 0, 2, " "), (0, 2, 0, "y"), (0, 2, 1, "-"), (1, 0, 0, "x"), (1, 0, 2, " "), (2, 0, 0, "lone"),
    ]
    occs = rows(N.occurrence_rows([found(spark, payloads)], FIELDS).where("rec_id < 5").select("rec_id", "occ_pos", "n_subfields"))
    assert occs == [(0, 0, 3), (0, 2, 2), (1, 0, 3), (2, 0, 1), (4, 0, 0), (4, 1, 0)]


def test_typed_and_empty(spark):
    schema = f"rec_id bigint, subject_genre_fields {N.OCC_TYPE}, place_hierarchy_752 {N.OCC_TYPE}, occ_pos string"
    data = [
        (1, [("650", None, [("a", "x"), None]), None, ("650", "1", None)], None, "clash"),
        (1, [("650", None, [("a", "x"), None]), None, ("650", "1", None)], None, "clash"),
        (None, [], [("752", " ", [("d", "é" * 100_000)])], None),
    ]
    typed = N.canonical_typed(spark.createDataFrame(data, schema), FIELDS)
    got = N.subfield_rows([typed], FIELDS)
    assert got.count() == 3 and got.where("rec_id is null").select("occ_pos", "sub_pos").first() == (0, 0)
    assert N.occurrence_rows([typed], FIELDS).where("rec_id = 1").count() == 4
    empty = N.canonical_typed(spark.createDataFrame([], schema), FIELDS)
    assert N.subfield_rows([empty], FIELDS).count() == 0
    assert N.subfield_rows([typed, found(spark, [])], FIELDS).count() == 3


def test_plan_is_narrow(spark):
    typed = N.canonical_typed(spark.createDataFrame([], f"rec_id bigint, subject_genre_fields {N.OCC_TYPE}, place_hierarchy_752 {N.OCC_TYPE}"), FIELDS)
    plan = N.subfield_rows([typed], FIELDS)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
