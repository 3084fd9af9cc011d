"""Queries of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.llm import mixing, names, packing, spam, vectors
from quarry.plans.registry import Registry
from quarry.sources.tables import paper_key, table

REG = Registry()


_NEAR = """WITH u AS (SELECT vec_id, list_transform(embeddings, lambda x: x::double) AS v FROM embed_vectors
  WHERE len(embeddings) = 128 AND len(list_filter(embeddings, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embeddings, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM u),
s AS (SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.v, b.v), 9) AS cosine FROM n a JOIN n b ON a.vec_id <> b.vec_id),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, other) AS rank FROM s WHERE cosine >= 0.8::double) WHERE rank <= 10)"""


@REG.add("p2_found", f"{_NEAR} SELECT DISTINCT least(vec_id, other) AS vec_id_a, greatest(vec_id, other) AS vec_id_b FROM near")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_pairs(vectors.neighbour_lists(table(spark, d, "embed_vectors")))


@REG.add("p2_search", f"{_NEAR} SELECT vec_id, rank::int AS rank, other AS neighbour_id, cosine FROM near WHERE vec_id % 50 = 0")
def p2_search(spark: SparkSession, d: str) -> DataFrame:
    """Ranked neighbours of the stated query set, every id divisible by 50, against all rows."""
    lists = vectors.neighbour_lists(table(spark, d, "embed_vectors")).where(F.col("vec_id") % 50 == 0)
    return lists.select("vec_id", F.posexplode("near").alias("r", "n")).select("vec_id", (F.col("r") + 1).alias("rank"), F.col("n.id").alias("neighbour_id"), (-F.col("n.c")).alias("cosine"))


@REG.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.score_pages(table(spark, d, "documents")).where("is_spam").select("doc_id")


@REG.add("p8_scores")
def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return spam.score_pages(table(spark, d, "documents"))


@REG.add("p6_packing")
def p6_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents"), table(spark, d, "token_budgets"))


@REG.add("p6_report")
def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_report(p6_packing(spark, d), table(spark, d, "token_budgets"))


@REG.add("p7_mix")
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


@REG.add("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _linked(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers")
    return names.linked_keys(table(spark, d, "faculty"), papers.select(paper_key(papers).alias("paper_key"), "kerberos", "authors", "iitd_authors"))


@REG.add("p1_found")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return names.entity_pairs(_linked(spark, d))


@REG.add("p1_entities")
def p1_entities(spark: SparkSession, d: str) -> DataFrame:
    """One row per linked key with its entity and the number of the entity's keys."""
    return _linked(spark, d).withColumn("n_keys", F.count(F.lit(1)).over(W.partitionBy("entity")))
