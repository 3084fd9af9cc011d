"""Queries of retrieval evaluation and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.functions.text import STOP_WORDS, terms
from quarry.operators import evaluation
from quarry.plans import sqlparts as S
from quarry.plans.registry import Registry
from quarry.sources.tables import latest_papers, table

REG = Registry()

# a run and judgments from the papers themselves: per field, papers by citations; recent ones are relevant, by year
_RUN = f"""{S.LATEST}, run AS (SELECT field_associated AS query_id, paper_key AS doc_id, row_number() OVER (PARTITION BY field_associated ORDER BY citation_count DESC NULLS LAST, paper_key) AS rank
  FROM latest WHERE field_associated IS NOT NULL),
rel AS (SELECT field_associated AS query_id, paper_key AS doc_id, least(publication_year - 2014, 3)::int AS grade FROM latest WHERE field_associated IS NOT NULL AND publication_year > 2014),
h AS (SELECT run.*, grade FROM run LEFT JOIN rel USING (query_id, doc_id)),
got AS (SELECT query_id, count(*) FILTER (rank <= 10 AND grade IS NOT NULL) AS found, min(rank) FILTER (grade IS NOT NULL) AS first,
  sum(CASE WHEN rank <= 10 THEN (pow(2, coalesce(grade, 0)) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY query_id),
best AS (SELECT query_id, count(*) AS n_rel, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, doc_id) AS r FROM rel) GROUP BY query_id),
met AS (SELECT query_id, round(found / n_rel::double, 6) AS recall, round(found / 10.0::double, 6) AS precision, round(coalesce(1.0::double / first, 0), 6) AS mrr, round(coalesce(dcg / idcg, 0), 6) AS ndcg
  FROM got LEFT JOIN best USING (query_id))"""


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    p = latest_papers(table(spark, d, "papers"), "field_associated", "citation_count", "publication_year").where("field_associated IS NOT NULL")
    w = W.partitionBy("field_associated").orderBy(F.desc_nulls_last("citation_count"), "paper_key")
    run = p.select(F.col("field_associated").alias("query_id"), F.col("paper_key").alias("doc_id"), F.row_number().over(w).alias("rank"))
    rel = p.where("publication_year > 2014").select(F.col("field_associated").alias("query_id"), F.col("paper_key").alias("doc_id"), F.least(F.col("publication_year") - 2014, F.lit(3)).alias("grade"))
    return evaluation.metrics(run, rel)


@REG.add("retrieval_metrics", f"WITH {_RUN} SELECT * FROM met")
def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d)


@REG.add("macro_average", f"WITH {_RUN} SELECT count(*) AS queries, count(recall) AS judged, round(avg(recall), 6) AS recall, round(avg(precision), 6) AS precision, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met")
def macro_average(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.macro_average(_metrics(spark, d))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@REG.add(
    "title_bigrams",
    f"""WITH {S.LATEST}, t AS (SELECT paper_key, list_filter({S.toks('title')}, lambda t: length(t) > 3 AND t NOT IN ({_STOP}) AND NOT regexp_full_match(t, '[0-9]+')) AS ts FROM latest),
    b AS (SELECT DISTINCT paper_key, ts[i] || ' ' || ts[i + 1] AS bigram FROM (SELECT *, unnest(range(1, len(ts))) AS i FROM t)),
    c AS (SELECT bigram, count(*) AS docs FROM b GROUP BY bigram HAVING count(*) >= 3)
    SELECT row_number() OVER (ORDER BY docs DESC, bigram) AS rank, bigram, docs FROM c ORDER BY rank LIMIT 100""",
)
def title_bigrams(spark: SparkSession, d: str) -> DataFrame:
    from quarry.functions.text import shingles

    words = F.filter(terms("title"), lambda t: (F.length(t) > 3) & ~t.isin(STOP_WORDS) & ~t.rlike("^[0-9]+$"))
    b = latest_papers(table(spark, d, "papers"), "title").select("paper_key", F.explode(F.array_distinct(shingles(words))).alias("bigram"))
    c = b.groupBy("bigram").agg(F.count(F.lit(1)).alias("docs")).where("docs >= 3").orderBy(F.desc("docs"), "bigram").limit(100)
    return c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("docs"), "bigram"))).select("rank", "bigram", "docs")


@REG.add(
    "corpus_profile",
    f"""WITH {S.LATEST} SELECT count(*) AS papers, count(*) FILTER (trim(abstract) NOT IN ('', '(No abstract available)')) AS with_abstract, count(*) FILTER (len(authors) > 0) AS with_authors,
    count(DISTINCT {S.norm('document_type')}) AS document_types, min(publication_year) AS first_year, max(publication_year) AS last_year FROM latest""",
)
def corpus_profile(spark: SparkSession, d: str) -> DataFrame:
    p = latest_papers(table(spark, d, "papers"), "abstract", "authors", "document_type", "publication_year")
    return p.agg(
        F.count(F.lit(1)).alias("papers"), F.count(F.when(~F.trim("abstract").isin("", "(No abstract available)"), 1)).alias("with_abstract"),
        F.count(F.when(F.size("authors") > 0, 1)).alias("with_authors"), F.countDistinct(norm_key("document_type")).alias("document_types"),
        F.min("publication_year").alias("first_year"), F.max("publication_year").alias("last_year"),
    )


@REG.add(
    "p95_latency",
    """SELECT event_type, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.5) AS median FROM events GROUP BY event_type""",
)
def p95_latency(spark: SparkSession, d: str) -> DataFrame:
    """Nearest-rank percentiles of a measure per kind of event, by refined histograms."""
    from quarry.operators.skew import exact_quantiles

    q = exact_quantiles(table(spark, d, "events"), ["event_type"], "value", [0.95, 0.5])
    return q.groupBy("event_type").agg(F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"), F.max(F.when(F.col("q") == 0.5, F.col("value"))).alias("median"))


@REG.add("top_fields", "SELECT row_number() OVER (ORDER BY n DESC, field_associated) AS rank, field_associated, n FROM (SELECT field_associated, count(*) AS n FROM papers WHERE field_associated IS NOT NULL GROUP BY 1 HAVING count(*) >= 3) ORDER BY rank LIMIT 8")
def top_fields(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "papers").where("field_associated IS NOT NULL").groupBy("field_associated").agg(F.count(F.lit(1)).alias("n")).where("n >= 3").orderBy(F.desc("n"), "field_associated").limit(8)
    return c.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "field_associated"))).select("rank", "field_associated", "n")


@REG.add(
    "jaccard_self_join",
    f"""WITH {S.LATEST}, t AS (SELECT field_associated AS f, paper_key AS id, list_distinct({S.toks('title')}) AS t FROM latest WHERE field_associated IS NOT NULL AND trim(title) <> '')
    SELECT x.id AS a, y.id AS b, round(len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t))::double, 6) AS jaccard FROM t x JOIN t y ON x.f = y.f AND x.id < y.id
    WHERE len(list_intersect(x.t, y.t)) / len(list_distinct(x.t || y.t))::double >= 0.5::double""",
)
def jaccard_self_join(spark: SparkSession, d: str) -> DataFrame:
    p = latest_papers(table(spark, d, "papers"), "field_associated", "title").withColumn("ts", terms("title"))
    return evaluation.title_overlap(p, "field_associated", "paper_key", "ts", 0.5)


@REG.add("sample_by_hash", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids FROM (SELECT doc_id FROM documents LIMIT 50)")
def sample_by_hash(spark: SparkSession, d: str) -> DataFrame:
    """A seeded sample of fixed size; which rows it holds depends on the hash, how many does not."""
    s = table(spark, d, "documents").orderBy(F.xxhash64("doc_id", F.lit(42)), "doc_id").limit(50)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("ids"))


@REG.add(
    "calibrated_judgments",
    f"WITH {_RUN} SELECT query_id, doc_id, CASE WHEN rank <= 10 THEN 3 WHEN rank <= 25 THEN 2 ELSE 1 END AS grade FROM h WHERE grade IS NOT NULL AND rank <= 50",
)
def calibrated_judgments(spark: SparkSession, d: str) -> DataFrame:
    p = latest_papers(table(spark, d, "papers"), "field_associated", "citation_count", "publication_year").where("field_associated IS NOT NULL")
    w = W.partitionBy("field_associated").orderBy(F.desc_nulls_last("citation_count"), "paper_key")
    run = p.select(F.col("field_associated").alias("query_id"), F.col("paper_key").alias("doc_id"), F.row_number().over(w).alias("rank"))
    judged = p.where("publication_year > 2014").select(F.col("field_associated").alias("query_id"), F.col("paper_key").alias("doc_id"))
    return evaluation.calibrate(run, judged)
