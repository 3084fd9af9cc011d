import math
import random

from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import skew
from quarry.operators.components import connected_components


def nearest_rank(values, q):
    v = sorted(values)
    return v[max(1, math.ceil(q * len(v))) - 1]


def test_exact_quantiles_equal_sorting(spark):
    rnd = random.Random(1)
    rows = [("hot", rnd.randint(0, 10**6)) for _ in range(3000)] + [(f"k{i % 40}", rnd.choice([0, 1, 5, 10**9, -3])) for i in range(400)]
    rows += [(None, 4), ("hot", None), ("only null", None)]
    got = skew.exact_quantiles(spark.createDataFrame(rows, "k string, v long"), ["k"], "v", [0.0, 0.25, 0.5, 0.9, 1.0], buckets=7).collect()
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {(r["k"], r["q"]): (r["n"], r["value"]) for r in got} == {(k, q): (len(v), nearest_rank(v, q)) for k, v in by.items() for q in (0.0, 0.25, 0.5, 0.9, 1.0)}


def test_exact_quantiles_of_doubles_and_nothing(spark):
    rows = [("a", x / 7) for x in range(50)] + [("a", float("nan"))]
    got = skew.exact_quantiles(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", [0.5], buckets=4).collect()
    assert [(r["n"], r["value"]) for r in got] == [(50, 24 / 7)]
    assert skew.exact_quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0


def test_split_join_equals_join(spark):
    facts = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}", "x") for i in range(300)] + [(999, None, "x")], "id long, k string, note string")
    dim = facts.where("k IS NOT NULL").groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("extra", F.length("k"))
    for share in (0.001, 0.5, 2.0):
        got = skew.split_join(facts, dim, ["k"], "n", share)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, facts.join(dim.drop("n"), "k").select(*got.columns).collect()))
    assert skew.split_join(facts, dim.limit(0), ["k"], "n").count() == 0


def test_key_profile_with_nulls_ties_and_extra_columns(spark):
    schema = "paper_key string, kerberos string, subject_area array<string>, citation_count int, publication_year int, papers int, w int"
    rows = [("1", " A ", ["X", "x ", None], 5, 2000, 9, 9), ("2", "a", None, None, None, 9, 9), ("3", None, [], 7, 2001, 9, 9), ("4", " ", ["y"], 7, 1999, 9, 9)]
    got = {(r["field_name"], r["key_value"]): r.asDict() for r in skew.key_profile(spark.createDataFrame(rows, schema)).collect()}
    assert set(got) == {("kerberos", "a"), ("subject_area", "x"), ("subject_area", "y")}
    assert got["kerberos", "a"] | {} == {"field_name": "kerberos", "key_value": "a", "papers": 2, "citations": 5, "first_year": 2000, "last_year": 2000, "citations_p50": 5, "citations_p90": 5}
    assert skew.key_profile(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 200), (None, 5), (5, None)] + [(1000, 1001 + i) for i in range(30)]
    got = {}
    for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(r["component"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == [list(range(41)), [100, 101], list(range(1000, 1031))] and all(c in s for c, s in got.items())
    assert connected_components(spark.createDataFrame([], T.StructType.fromDDL("a long, b long"))).count() == 0


def test_exact_quantiles_of_infinite_and_wide_ranges(spark):
    inf, big = float("inf"), 1.7e308
    values = [-inf, -inf, -big, -3.0, -1e-300, 0.0, 1e-300, 2.0, big, big, inf, float("nan")]
    got = skew.exact_quantiles(spark.createDataFrame([("a", v) for v in values] + [("b", inf), ("b", -inf)], "k string, v double"), ["k"], "v", [0.0, 0.2, 0.5, 0.8, 1.0], buckets=4).collect()
    want = {("a", q): nearest_rank(values[:-1], q) for q in (0.0, 0.2, 0.5, 0.8, 1.0)} | {("b", q): nearest_rank([inf, -inf], q) for q in (0.0, 0.2, 0.5, 0.8, 1.0)}
    assert {(r["k"], r["q"]): r["value"] for r in got} == want


def test_heavy_keys_equal_counting(spark):
    rnd = random.Random(3)
    rows = [("kerberos", "hot")] * 400 + [("kerberos", f"k{rnd.randrange(60)}") for _ in range(600)] + [("subject_area", f"a{rnd.randrange(9)}") for _ in range(900)]
    df = spark.createDataFrame([(f, k, 1, 2000) for f, k in rows], "field_name string, key_value string, citation_count int, publication_year int")
    n = {}
    for r in rows:
        n[r] = n.get(r, 0) + 1
    for share in (0.0, 0.01, 0.1, 0.4, 0.9):
        for bits in (1, 8, 64):
            got = sorted(map(tuple, skew.heavy_keys(df, 1000, share, bits).collect()))
            assert got == sorted(k for k, c in n.items() if c >= share * 1000), (share, bits)
    assert skew.heavy_keys(df.limit(0), 0).count() == 0
