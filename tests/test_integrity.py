from datetime import datetime as D

from quarry.operators import integrity

REFS = "ref_table string, ref_field string, row_key string, parent_table string, ref_value string, ref_time timestamp"
PARENTS = "parent_table string, ref_value string, created_at timestamp, deleted_at timestamp"


def test_reasons_and_bounds(spark):
    parents = spark.createDataFrame(
        [("p", "a", D(2000, 1, 1), None), ("p", "b", D(2000, 1, 1), D(2010, 1, 1)), ("p", "c", None, D(2005, 1, 1)), ("p", "c", D(2008, 1, 1), None), ("q", "zz", D(2000, 1, 1), None)], PARENTS
    )
    rows = [
        ("1", "a", D(2001, 1, 1)), ("2", "a", D(1999, 1, 1)), ("3", "b", D(2010, 1, 1)), ("4", "b", D(2009, 12, 31)), ("5", "zz", D(2001, 1, 1)),
        ("6", "c", D(1980, 1, 1)), ("7", "c", D(2006, 1, 1)), ("8", "c", D(2009, 1, 1)), ("9", None, D(2001, 1, 1)), ("10", "a", None), ("11", "gone", None), ("2", "a", D(1999, 1, 1)),
    ]
    refs = spark.createDataFrame([("t", "f", k, "p", v, t) for k, v, t in rows], REFS)
    got = {(r["row_key"], r["reason"]) for r in integrity.dangling_references(refs, parents).collect()}
    assert got == {("2", "later"), ("3", "deleted"), ("5", "missing"), ("7", "deleted"), ("11", "missing")}
    assert integrity.dangling_references(refs, parents).count() == 5
    report = integrity.reference_report(integrity.dangling_references(refs, parents)).collect()
    assert sum(r["n_refs"] for r in report) == 5


def test_empty_tables(spark):
    none_r, none_p = spark.createDataFrame([], REFS), spark.createDataFrame([], PARENTS)
    assert integrity.dangling_references(none_r, none_p).count() == 0
    one = spark.createDataFrame([("t", "f", "1", "p", "x", D(2001, 1, 1))], REFS)
    assert [r["reason"] for r in integrity.dangling_references(one, none_p).collect()] == ["missing"]
