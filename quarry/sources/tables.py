"""Table readers: one Parquet path per table, columns pruned by Catalyst."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def paper_key(papers: DataFrame) -> Column:
    """Key of a paper: its trimmed, lower-cased ``mongo_id``; a delivery without one stands for itself."""
    return F.coalesce(norm_key(papers["mongo_id"]), F.concat(F.lit("delivery:"), papers["delivery_id"].cast("string")))


def latest_papers(papers: DataFrame, *columns: str) -> DataFrame:
    """One row per paper: the delivery with the latest ``updated_at`` (then the
    largest ``delivery_id``) of each ``mongo_id``.

    Ids compare trimmed and in lower case. A delivery without a usable
    ``mongo_id`` stands for itself under the key ``delivery:<delivery_id>``.
    Output: ``paper_key`` and the columns asked for.
    """
    key = paper_key(papers)
    payload = F.struct(*[F.col(c).alias(c) for c in columns])
    order = F.struct(F.col("updated_at").alias("u"), F.col("delivery_id").alias("d"))
    return (
        papers.select(key.alias("paper_key"), payload.alias("_p"), order.alias("_o"))
        .groupBy("paper_key")
        .agg(F.max_by("_p", "_o").alias("_p"))
        .select("paper_key", *[F.col("_p")[c].alias(c) for c in columns])
    )
