"""Facet counts and bucket statistics over a match set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# The half-open year ranges shown.
YEAR_RANGES = (("2020+", 2020, None), ("2010-2019", 2010, 2020), ("2000-2009", 2000, 2010), ("before 2000", None, 2000))


def terms_facet(hits: DataFrame, value: Column, size: int, by_key: bool = False) -> DataFrame:
    """``rank, value, count`` of the ``size`` largest buckets (ties by key), or of the highest keys. Nulls form no bucket."""
    counts = hits.select(value.alias("value")).where("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("count"))
    order = [F.desc("value")] if by_key else [F.desc("count"), F.asc("value")]
    return counts.orderBy(*order).limit(size).withColumn("rank", F.row_number().over(W.orderBy(*order))).select("rank", "value", "count")


def year_ranges(hits: DataFrame, year: str) -> DataFrame:
    """``range, count`` of the fixed ranges, empty ones too, in one aggregate row turned on its side."""
    y = F.col(year)

    def inside(lo: int | None, hi: int | None) -> Column:
        return (F.lit(True) if lo is None else y >= lo) & (F.lit(True) if hi is None else y < hi)

    wide = hits.agg(*[F.count(F.when(inside(lo, hi), 1)).alias(n) for n, lo, hi in YEAR_RANGES])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("range"), F.col(f"`{n}`").alias("count")) for n, *_ in YEAR_RANGES])).alias("x")).select("x.range", "x.count")


def buckets(hits: DataFrame, key: Column, size: int, nested: bool = False) -> DataFrame:
    """``key, papers, max_score, avg_score, citations`` of hits (``doc_id, score, citation_count``).

    ``key`` may be an array (exploded); ``nested`` counts each paper once per
    key however often its array repeats it.
    """
    x = hits.select("doc_id", "score", "citation_count", key.alias("key")).where("key IS NOT NULL")
    if nested:
        x = x.distinct()
    out = x.groupBy("key").agg(
        F.count(F.lit(1)).alias("papers"), F.round(F.max("score"), 6).alias("max_score"), F.round(F.avg("score"), 6).alias("avg_score"),
        F.coalesce(F.sum("citation_count"), F.lit(0)).cast("long").alias("citations"),
    )
    return out.orderBy(F.desc("papers"), "key").limit(size)


def merge_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two bucket lists over the same papers: the larger of each measure, never the sum."""
    return a.unionByName(b).groupBy("key").agg(*[F.max(c).alias(c) for c in ("papers", "max_score", "avg_score", "citations")])


def author_score(best: Column, mean: Column, papers: Column) -> Column:
    return 0.6 * best + 0.3 * mean + 0.1 * F.log2(1 + papers)


def above_share_of_best(df: DataFrame, score: str, share: float = 0.25) -> DataFrame:
    """Rows whose score reaches ``share`` of the best one; the best is one row, joined back broadcast."""
    best = df.agg(F.max(score).alias("_best"))
    return df.join(F.broadcast(best), F.col(score) >= share * F.col("_best")).drop("_best")
