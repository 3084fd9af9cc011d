"""Classification: winner rows, the facet cube, ranked members and browsing."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.normal import norm_key
from quarry.functions.text import slugify

LEVELS = ("thematic_area_id", "domain_id", "subdomain_id")
# The level combinations that are materialised, each with and without department.
MASKS = (("thematic_area_id",), ("domain_id",), ("domain_id", "subdomain_id"), ("thematic_area_id", "domain_id"), ("thematic_area_id", "domain_id", "subdomain_id"))


def classified(papers: DataFrame) -> DataFrame:
    """``paper_key``, the three levels and one row per resolved author (``kerberos, faculty_ref, department``)."""
    return papers.select(
        "paper_key", *[norm_key(f"classification.{c}").alias(c) for c in LEVELS], F.explode_outer("iitd_authors").alias("a")
    ).select(
        "paper_key", *LEVELS, norm_key("a.kerberos").alias("kerberos"), norm_key("a.faculty_ref").alias("faculty_ref"), norm_key("a.department_ref").alias("department_id")
    ).where(F.coalesce(*LEVELS).isNotNull())


def facet_cube(rows: DataFrame) -> DataFrame:
    """Papers and faculty of every materialised combination of levels, with and without department.

    One ``GROUPING SETS`` over the exploded authors. A null level value never
    stands for "not part of this combination": such groups are dropped. Cells
    without papers do not exist.
    """
    dims = [*LEVELS, "department_id"]
    sets = [list(m) for m in MASKS] + [[*m, "department_id"] for m in MASKS]
    cols = [F.col(c) for c in dims]
    g = rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        *[F.grouping(c).alias(f"g_{c}") for c in dims],
        F.countDistinct("paper_key").alias("paper_count"),
        F.countDistinct(F.when(F.col("faculty_ref").isNotNull(), F.col("kerberos"))).alias("faculty_count"),
    )
    whole = F.lit(True)
    for c in dims:
        whole = whole & ((F.col(f"g_{c}") == 1) | F.col(c).isNotNull())
    return g.where(whole).drop(*[f"g_{c}" for c in dims])


def members(rows: DataFrame, by: list[str]) -> DataFrame:
    """``by, kerberos, papers, rank, faculty_total``: faculty of each cell by papers, then kerberos."""
    x = rows.where("kerberos IS NOT NULL AND faculty_ref IS NOT NULL")
    for c in by:
        x = x.where(F.col(c).isNotNull())
    n = x.groupBy(*by, "kerberos").agg(F.countDistinct("paper_key").alias("papers"))
    w = W.partitionBy(*by)
    return n.withColumn("rank", F.row_number().over(w.orderBy(F.desc("papers"), "kerberos"))).withColumn("faculty_total", F.count(F.lit(1)).over(w))


def recommended_count(ranked: DataFrame, by: list[str], coverage: float = 0.8, least: int = 6, most: int = 12) -> DataFrame:
    """``by, recommended``: the smallest prefix that covers ``coverage`` of all papers, within ``least`` and ``most``
    (and the list), carried on through ties up to one and a half times ``most``."""
    w = W.partitionBy(*by)
    x = ranked.withColumn("cum", F.sum("papers").over(w.orderBy("rank").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("papers").over(w))
    need = x.groupBy(*by).agg(F.min(F.when(F.col("cum") >= coverage * F.col("total"), F.col("rank"))).alias("cut"), F.max("rank").alias("n"))
    need = need.withColumn("cut", F.least(F.greatest(F.col("cut"), F.lit(least)), F.greatest(F.lit(most), F.lit(least)), F.col("n")))
    y = ranked.join(need, by)
    edge = y.where(F.col("rank") == F.col("cut")).select(*by, F.col("papers").alias("edge"))
    y = y.join(edge, by)
    tied = y.groupBy(*by).agg(F.first("cut").alias("cut"), F.max(F.when(F.col("papers") == F.col("edge"), F.col("rank"))).alias("last"))
    return tied.select(*by, F.greatest(F.col("cut"), F.least(F.col("last"), F.lit(int(1.5 * most + 0.5)))).cast("int").alias("recommended"))


def winner_rows(rows: DataFrame, key: str, rank: Column, score: Column, order: Column) -> DataFrame:
    """One row per key: best confidence, then score (missing last), then the earliest row."""
    w = W.partitionBy(key).orderBy(F.desc_nulls_last(rank), F.desc_nulls_last(score), order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def first_seen_topics(papers: DataFrame, by: Column, size: int = 25) -> DataFrame:
    """``key, topics``: topics of each key in order of papers, distinct without regard to case, the first spelling kept."""
    x = papers.select(by.alias("key"), "paper_key", F.posexplode("classification.topics").alias("pos", "topic")).where("key IS NOT NULL AND trim(topic) <> ''")
    first = x.groupBy("key", F.lower(F.trim("topic")).alias("t")).agg(F.min(F.struct("paper_key", "pos", F.trim("topic").alias("topic"))).alias("f"))
    r = F.row_number().over(W.partitionBy("key").orderBy("f.paper_key", "f.pos", "t"))
    return first.withColumn("r", r).where(F.col("r") <= size).groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "f.topic"))), lambda s: s["topic"]).alias("topics"))


def dominant_domains(rows: DataFrame, domains: DataFrame, coverage: float = 0.8) -> DataFrame:
    """``kerberos, domain_id, papers, rank``: a member's domains until ``coverage`` of the papers is reached."""
    names = domains.select(norm_key("domain_id").alias("domain_id"), "node_name")
    n = rows.where("kerberos IS NOT NULL AND faculty_ref IS NOT NULL AND domain_id IS NOT NULL").groupBy("kerberos", "domain_id").agg(F.countDistinct("paper_key").alias("papers"))
    x = n.join(names, "domain_id")
    w = W.partitionBy("kerberos")
    o = w.orderBy(F.desc("papers"), "node_name", "domain_id")
    x = x.withColumn("rank", F.row_number().over(o)).withColumn("before", F.sum("papers").over(o.rowsBetween(W.unboundedPreceding, 0)) - F.col("papers")).withColumn("total", F.sum("papers").over(w))
    return x.where(F.col("before") < coverage * F.col("total")).select("kerberos", "domain_id", "papers", "rank")


def unique_slugs(nodes: DataFrame, key: str, name: str) -> DataFrame:
    """``key, slug``: slugs of names in order of key; one that is taken gets the first free of ``-2``, ``-3``, ...

    Slugs can only meet where they are equal but for numbers at the end, so each such group is settled by itself.
    A null name has a null slug.
    """
    kind = nodes.schema[key].dataType.simpleString()
    s = nodes.select(F.col(key).alias("k"), slugify(name).alias("base")).withColumn("stem", F.regexp_replace("base", r"(-?[0-9]+)*$", ""))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        used: dict[str, int] = {}
        out = []
        for base in pdf["base"]:
            slug, n = base, used.get(base, 1)
            while slug is not None and slug in used:
                n += 1
                slug = f"{base}-{n}"
            if slug is not None:
                used[base] = n  # numbers below are taken
                used.setdefault(slug, 1)
            out.append(slug)
        return pd.DataFrame({key: pdf["k"], "slug": out})

    return s.groupBy("stem").applyInPandas(settle, f"{key} {kind}, slug string")


def upsert_nodes(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Nodes of both, what an existing node has stays (full outer join)."""
    o, n = old.alias("o"), new.alias("n")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *[F.coalesce(f"o.{c}", f"n.{c}").alias(c) for c in keep])
