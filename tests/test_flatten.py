import json

from pyspark.sql import functions as F

from quarry.operators import flatten as X


def children(spark, *payloads):
    df = spark.createDataFrame([(i, p, "clash") for i, p in enumerate(payloads)], "export_id long, payload string, v string")
    return sorted((r["export_id"], r["child_kind"], r["elem_pos"], r["sub_pos"], r["child_key"]) for r in X.export_children(df).collect())


def test_shapes_of_one_record(spark):
    rec = {
        "authors": [{"author_id": 990001, "author_avaialable_names": ["A B", None, " c "]}, None, {"author_id": {"$numberLong": "12"}, "author_avaialable_names": "Solo"}],
        "iitd_authors": json.dumps([{"kerberos": "k1"}, {"kerberos": None}]),
        "classification": [{}, {"subdomain_id": {"$oid": "ab"}, "topics": '["t1","t2"]'}],
    }
    want = sorted(
        [(0, "author", 0, -1, "990001"), (0, "author", 2, -1, "12"), (0, "author_name", 0, 0, "A B"), (0, "author_name", 0, 2, " c "), (0, "author_name", 2, 0, "Solo"),
         (0, "iitd_author", 0, -1, "k1"), (0, "iitd_author", 1, -1, ""), (0, "classification", 1, -1, "ab"), (0, "topic", 1, 0, "t1"), (0, "topic", 1, 1, "t2")]
    )
    assert children(spark, json.dumps(rec)) == want
    for wrapped in ({"meta": 1, "document": rec}, {"op": "x", "o": {"document": rec}}, {"o": rec}, json.dumps(rec)):
        assert children(spark, json.dumps(wrapped)) == want


def test_invalid_null_and_empty(spark):
    assert children(spark, '{"authors": [{"author_id": "1"}', None, "", "{}", "[]", "null", '{"authors": null, "classification": {}}', '{"authors": {"author_id": "é"}}') == [(7, "author", 0, -1, "é")]


def test_inferred_tree_carries_parents_and_places(spark):
    docs = spark.createDataFrame([(1, '{"a": [{"b": [1, [2, [3]]], "row_key": "r"}, {"b": 3, "it\'s": {"z": "1"}}], "c": {"d": "x"}, "e": 5, "f": {"$oid": "q"}}'), (2, '{"a": "none", "c": "{\\"d\\": [7]}"}')], "id long, j string")
    t = X.flatten(docs.select("id", X.parse(F.col("j")).alias("v")), "id")
    # no depth at which arrays are left out; typed scalars are no tables
    assert t.paths() == ["a", "a.b", "a.b.[]", "a.b.[].[]", "a.it's", "c", "c.d"]
    rows = t.rows.withColumn("x", X.text_of(F.col("v"))).collect()
    got = sorted((r["id"], r["path"], tuple(r["places"]), r["x"]) for r in rows if r["path"].startswith("a.b"))
    assert got == [(1, "a.b", (0, 0), "1"), (1, "a.b", (0, 1), "[2,[3]]"), (1, "a.b", (1, 0), "3"), (1, "a.b.[]", (0, 1, 0), "2"), (1, "a.b.[]", (0, 1, 1), "[3]"), (1, "a.b.[].[]", (0, 1, 1, 0), "3")]
    # keys are unique, and a parent key is that of the row one level up
    by = {r["row_key"]: r for r in rows}
    assert len(by) == len(rows)
    for r in rows:
        if len(r["places"]) > 1:
            up = by[r["parent_key"]]
            assert up["id"] == r["id"] and list(up["places"]) == list(r["places"])[:-1] and r["path"].startswith(up["path"] + ".")
    a = t.table("a")
    assert a.columns == ["id", "row_key", "parent_key", "place_0", "value", "row_key_"]
    assert sorted((r["id"], r["place_0"], r["value"], r["row_key_"]) for r in a.collect()) == [(1, 0, None, "r"), (1, 1, None, ""), (2, 0, "none", "")]
    assert sorted((r["id"], r["value"]) for r in t.table("c.d").collect()) == [(1, "x"), (2, "7")]
    empty = X.flatten(docs.limit(0).select("id", X.parse(F.col("j")).alias("v")), "id")
    assert empty.paths() == [] and empty.rows.count() == 0


def test_an_unseen_array_field_becomes_a_table(spark):
    exports = spark.createDataFrame([(1, '{"document": {"authors": [], "grants": [{"no": 4, "parts": ["x", "y"]}]}}'), (2, "{}")], "export_id long, payload string")
    t = X.export_tables(exports)
    assert t.paths() == ["authors", "grants", "grants.parts"]
    assert [(r["export_id"], r["place_0"], r["no"]) for r in t.table("grants").collect()] == [(1, 0, "4")]
    assert X.export_children(exports).count() == 0
