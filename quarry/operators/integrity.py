"""References whose target record does not exist at the reference's time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.operators.skew import split_join


def long_parents(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``{name: (table, id column)}`` to ``parent_table, ref_value, created_at, deleted_at``."""
    parts = [
        t.select(F.lit(n).alias("parent_table"), norm_key(k).alias("ref_value"), F.col("created_at").alias("created_at"), F.col("deleted_at").alias("deleted_at"))
        for n, (t, k) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts).where(F.col("ref_value").isNotNull())


def _alive(intervals: Column, first: Column, last: Column) -> Column:
    """True where one interval holds both times; a missing bound is open."""
    return F.exists(
        intervals,
        lambda i: F.coalesce(i["c"] <= first, F.lit(True)) & F.coalesce(i["d"] > last, F.lit(True)),
    )


def dangling_references(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of ``refs`` whose parent record does not exist at ``ref_time``.

    ``refs``: ``ref_table, ref_field, row_key, parent_table, ref_value,
    ref_time``; ``parents``: see :func:`long_parents`. Values must be normalised
    by the caller; null values are no references. A record exists from
    ``created_at`` (null: always) until before ``deleted_at`` (null: still). A
    reference without a time is dangling only if no such id was ever there.
    Several records of one id count as the union of their intervals. Repeated
    references of one row and field come out once.

    Child keys are counted per key first (merged before the shuffle) and joined
    by union with the tagged parents; one group per parent table and key keeps
    those that lack a parent over some of their times. Only these keys go back
    to the references, hot ones by a broadcast bounded by share.

    Output: the columns of ``refs`` and ``reason`` (``missing``, ``deleted`` or
    ``later``).
    """
    keys = ["parent_table", "ref_value"]
    refs = refs.where(F.col("ref_value").isNotNull())
    none_t = F.lit(None).cast(refs.schema["ref_time"].dataType)
    child = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("ref_time").alias("t0"), F.max("ref_time").alias("t1")).select(*keys, F.lit(False).alias("is_parent"), "n", "t0", "t1", none_t.alias("c"), none_t.alias("d"))
    parent = parents.select(*keys, F.lit(True).alias("is_parent"), F.lit(0).cast("long").alias("n"), none_t.alias("t0"), none_t.alias("t1"), F.col("created_at").alias("c"), F.col("deleted_at").alias("d"))
    groups = (
        child.unionByName(parent)
        .groupBy(*keys)
        .agg(
            F.max("is_parent").alias("has_parent"),
            F.sum("n").alias("n"),
            F.min("t0").alias("t0"),
            F.max("t1").alias("t1"),
            F.collect_list(F.when(F.col("is_parent"), F.struct("c", "d"))).alias("intervals"),
        )
        .where("n > 0")
    )
    lacking = groups.where(~F.col("has_parent") | ~_alive(F.col("intervals"), F.col("t0"), F.col("t1"))).select(*keys, "n", "intervals")
    back = split_join(refs, lacking, keys, "n")
    t = F.col("ref_time")
    dead = back.where((F.size("intervals") == 0) | ~_alive(F.col("intervals"), t, t))
    reason = (
        F.when(F.size("intervals") == 0, "missing")
        .when(F.exists("intervals", lambda i: i["d"] <= t), "deleted")
        .otherwise("later")
    )
    return dead.withColumn("reason", reason).drop("intervals").dropDuplicates(["ref_table", "ref_field", "row_key", *keys])


def reference_report(dangling: DataFrame) -> DataFrame:
    """Counts per table, field, month of the reference and reason."""
    return dangling.groupBy("ref_table", "ref_field", F.date_format("ref_time", "yyyy-MM").alias("ref_month"), "reason").agg(
        F.count(F.lit(1)).alias("n_refs"), F.countDistinct("ref_value").alias("n_values")
    )


def paper_references(papers: DataFrame) -> DataFrame:
    """Long references of ``papers`` (one row per paper with ``paper_key``)."""

    def one(field: str, parent: str, value: Column) -> Column:
        return F.struct(F.lit(field).alias("ref_field"), F.lit(parent).alias("parent_table"), norm_key(value).alias("ref_value"))

    def many(field: str, parent: str, part: str) -> Column:
        return F.transform(F.coalesce("iitd_authors", F.array().cast(papers.schema["iitd_authors"].dataType)), lambda a: one(field, parent, a[part]))

    all_refs = F.concat(
        many("iitd_authors.faculty_ref", "faculty", "faculty_ref"),
        many("iitd_authors.department_ref", "departments", "department_ref"),
        F.array(
            one("classification.thematic_area_id", "thematic_areas", F.col("classification.thematic_area_id")),
            one("classification.domain_id", "domains", F.col("classification.domain_id")),
            one("classification.subdomain_id", "subdomains", F.col("classification.subdomain_id")),
        ),
    )
    return papers.select(F.col("paper_key").alias("row_key"), F.col("created_at").alias("ref_time"), F.explode(F.array_distinct(all_refs)).alias("r")).select(
        F.lit("papers").alias("ref_table"), F.col("r.ref_field").alias("ref_field"), "row_key", F.col("r.parent_table").alias("parent_table"), F.col("r.ref_value").alias("ref_value"), "ref_time"
    ).where(F.col("ref_value").isNotNull())


def facet_references(facets: DataFrame) -> DataFrame:
    return facets.select(
        F.lit("taxonomy_facet_counts").alias("ref_table"),
        F.lit("department_id").alias("ref_field"),
        F.col("facet_id").cast("string").alias("row_key"),
        F.lit("departments").alias("parent_table"),
        norm_key("department_id").alias("ref_value"),
        F.col("updated_at").alias("ref_time"),
    ).where(F.col("ref_value").isNotNull())
