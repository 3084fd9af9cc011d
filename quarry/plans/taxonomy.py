"""Queries of classification, the facet cube and browsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.operators import taxonomy as X
from quarry.plans import sqlparts as S
from quarry.plans.registry import Registry
from quarry.sources.tables import latest_papers, table

REG = Registry()

_ROWS = f"""{S.LATEST}, e AS (SELECT paper_key, classification AS c, CASE WHEN len(iitd_authors) > 0 THEN iitd_authors ELSE [NULL] END AS ia FROM latest),
rows AS (SELECT * FROM (SELECT paper_key, {S.norm('c.thematic_area_id')} AS thematic_area_id, {S.norm('c.domain_id')} AS domain_id, {S.norm('c.subdomain_id')} AS subdomain_id,
  {S.norm('a.kerberos')} AS kerberos, {S.norm('a.faculty_ref')} AS faculty_ref, {S.norm('a.department_ref')} AS department_id FROM (SELECT *, unnest(ia) AS a FROM e))
  WHERE coalesce(thematic_area_id, domain_id, subdomain_id) IS NOT NULL)"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return X.classified(latest_papers(table(spark, d, "papers"), "classification", "iitd_authors"))


_DIMS = [*X.LEVELS, "department_id"]
_SETS = ", ".join("(" + ", ".join(s) + ")" for s in [*X.MASKS, *[(*m, "department_id") for m in X.MASKS]])
_WHOLE = " AND ".join(f"(grouping({c}) = 1 OR {c} IS NOT NULL)" for c in _DIMS)
_CUBE = f"""cube AS (SELECT {', '.join(_DIMS)}, count(DISTINCT paper_key) AS paper_count, count(DISTINCT CASE WHEN faculty_ref IS NOT NULL THEN kerberos END) AS faculty_count
  FROM rows GROUP BY GROUPING SETS ({_SETS}) HAVING {_WHOLE})"""


@REG.add("facet_cube", f"WITH {_ROWS}, {_CUBE} SELECT * FROM cube")
def facet_cube(spark: SparkSession, d: str) -> DataFrame:
    return X.facet_cube(_rows(spark, d))


@REG.add("node_stats", f"WITH {_ROWS}, {_CUBE} SELECT domain_id, paper_count, faculty_count FROM cube WHERE domain_id IS NOT NULL AND thematic_area_id IS NULL AND subdomain_id IS NULL AND department_id IS NULL")
def node_stats(spark: SparkSession, d: str) -> DataFrame:
    return X.facet_cube(_rows(spark, d)).where("domain_id IS NOT NULL AND thematic_area_id IS NULL AND subdomain_id IS NULL AND department_id IS NULL").select("domain_id", "paper_count", "faculty_count")


@REG.add(
    "browse_domain_join",
    f"""WITH {_ROWS}, {_CUBE}, n AS (SELECT * FROM cube WHERE domain_id IS NOT NULL AND thematic_area_id IS NULL AND subdomain_id IS NULL AND department_id IS NULL),
    sub AS (SELECT {S.norm('domain_id')} AS domain_id, count(*) AS n FROM subdomains GROUP BY 1)
    SELECT row_number() OVER (ORDER BY display_order, d.domain_id) AS rank, slug, coalesce(paper_count, 0) AS paper_count, coalesce(faculty_count, 0) AS faculty_count, coalesce(sub.n, 0) AS subdomain_count
    FROM domains d LEFT JOIN n ON n.domain_id = {S.norm('d.domain_id')} LEFT JOIN sub ON sub.domain_id = {S.norm('d.domain_id')}""",
)
def browse_domain_join(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "domains").select(norm_key("domain_id").alias("domain_id"), F.col("domain_id").alias("raw"), "slug", "display_order")
    sub = table(spark, d, "subdomains").groupBy(norm_key("domain_id").alias("domain_id")).agg(F.count(F.lit(1)).alias("n"))
    x = nodes.join(node_stats(spark, d), "domain_id", "left").join(sub, "domain_id", "left")
    zero = F.lit(0)
    return x.select(
        F.row_number().over(W.orderBy("display_order", "raw")).alias("rank"), "slug", F.coalesce("paper_count", zero).alias("paper_count"),
        F.coalesce("faculty_count", zero).alias("faculty_count"), F.coalesce("n", zero).alias("subdomain_count"),
    )


_MEMBERS = """mem AS (SELECT domain_id, kerberos, count(DISTINCT paper_key) AS papers FROM rows WHERE kerberos IS NOT NULL AND faculty_ref IS NOT NULL AND domain_id IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY domain_id ORDER BY papers DESC, kerberos) AS rank, count(*) OVER (PARTITION BY domain_id) AS faculty_total FROM mem)"""


@REG.add("members_ranked", f"WITH {_ROWS}, {_MEMBERS} SELECT * FROM rk WHERE rank <= 500")
def members_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The display cap of 500 members a cell; ``faculty_total`` counts all."""
    return X.members(_rows(spark, d), ["domain_id"]).where("rank <= 500")


@REG.add(
    "pareto_recommended_count",
    f"""WITH {_ROWS}, {_MEMBERS}, c AS (SELECT *, sum(papers) OVER (PARTITION BY domain_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum, sum(papers) OVER (PARTITION BY domain_id) AS total FROM rk),
    n AS (SELECT domain_id, least(greatest(min(rank) FILTER (cum >= 0.8::double * total), 6), 12, max(rank)) AS cut FROM c GROUP BY domain_id),
    g AS (SELECT rk.domain_id, cut, max(rank) FILTER (papers = (SELECT x.papers FROM rk x WHERE x.domain_id = n.domain_id AND x.rank = n.cut)) AS last FROM rk JOIN n USING (domain_id) GROUP BY rk.domain_id, n.domain_id, cut)
    SELECT domain_id, greatest(cut, least(last, 18)) AS recommended FROM g""",
)
def pareto_recommended_count(spark: SparkSession, d: str) -> DataFrame:
    return X.recommended_count(X.members(_rows(spark, d), ["domain_id"]), ["domain_id"])


@REG.add(
    "dominant_domains",
    f"""WITH {_ROWS}, n AS (SELECT kerberos, domain_id, count(DISTINCT paper_key) AS papers FROM rows WHERE kerberos IS NOT NULL AND faculty_ref IS NOT NULL AND domain_id IS NOT NULL GROUP BY ALL),
    x AS (SELECT n.*, row_number() OVER w AS rank, sum(papers) OVER (PARTITION BY kerberos ORDER BY papers DESC, node_name, n.domain_id ROWS UNBOUNDED PRECEDING) - papers AS before, sum(papers) OVER (PARTITION BY kerberos) AS total
      FROM n JOIN domains d ON {S.norm('d.domain_id')} = n.domain_id WINDOW w AS (PARTITION BY kerberos ORDER BY papers DESC, node_name, n.domain_id))
    SELECT kerberos, domain_id, papers, rank FROM x WHERE before < 0.8::double * total""",
)
def dominant_domains(spark: SparkSession, d: str) -> DataFrame:
    return X.dominant_domains(_rows(spark, d), table(spark, d, "domains"))


@REG.add(
    "winner_row_per_group",
    f"""WITH x AS (SELECT {S.norm('mongo_id')} AS mongo_id, delivery_id, citation_count, document_type FROM papers)
    SELECT mongo_id, delivery_id FROM (SELECT *, row_number() OVER (PARTITION BY mongo_id
      ORDER BY CASE {S.norm('document_type')} WHEN 'article' THEN 3 WHEN 'review' THEN 2 ELSE 1 END DESC, citation_count DESC NULLS LAST, delivery_id) AS r FROM x) WHERE r = 1""",
)
def winner_row_per_group(spark: SparkSession, d: str) -> DataFrame:
    kind = norm_key("document_type")
    confidence = F.when(kind == "article", 3).when(kind == "review", 2).otherwise(1)
    x = table(spark, d, "papers").withColumn("mongo_id", norm_key("mongo_id"))
    return X.winner_rows(x, "mongo_id", confidence, F.col("citation_count"), F.col("delivery_id")).select("mongo_id", "delivery_id")


@REG.add(
    "topics_first_seen",
    f"""WITH {S.LATEST}, t AS (SELECT {S.norm('classification.domain_id')} AS key, paper_key, generate_subscripts(classification.topics, 1) - 1 AS pos, unnest(classification.topics) AS topic FROM latest),
    f AS (SELECT key, lower(trim(topic)) AS t, min_by(trim(topic), (paper_key, pos)) AS topic, min((paper_key, pos)) AS o FROM t WHERE key IS NOT NULL AND trim(topic) <> '' GROUP BY ALL)
    SELECT key, list(topic ORDER BY r) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, t) AS r FROM f) WHERE r <= 25 GROUP BY key""",
)
def topics_first_seen(spark: SparkSession, d: str) -> DataFrame:
    return X.first_seen_topics(latest_papers(table(spark, d, "papers"), "classification"), norm_key("classification.domain_id"))


@REG.add(
    "slugify_unique",
    r"""WITH s AS (SELECT subdomain_id, regexp_replace(regexp_replace(replace(lower(node_name), '&', ' and '), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS base FROM subdomains)
    SELECT subdomain_id, CASE WHEN r = 1 THEN base ELSE base || '-' || r END AS slug FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY subdomain_id) AS r FROM s)""",
)
def slugify_unique(spark: SparkSession, d: str) -> DataFrame:
    return X.unique_slugs(table(spark, d, "subdomains"), "subdomain_id", "node_name")


@REG.add(
    "upsert_nodes",
    f"""SELECT coalesce(o.node_name, n.field_associated) AS node_name, coalesce(o.display_order, n.display_order) AS display_order FROM domains o
    FULL JOIN (SELECT field_associated, row_number() OVER (ORDER BY field_associated) AS display_order FROM (SELECT DISTINCT field_associated FROM papers WHERE field_associated IS NOT NULL)) n ON n.field_associated = o.node_name""",
)
def upsert_nodes(spark: SparkSession, d: str) -> DataFrame:
    """New nodes get their place in name order; an existing node keeps its own. Nodes are few: one window over them."""
    new = table(spark, d, "papers").select(F.col("field_associated").alias("node_name")).where("node_name IS NOT NULL").distinct()
    new = new.withColumn("display_order", F.row_number().over(W.orderBy("node_name")))
    return X.upsert_nodes(table(spark, d, "domains").select("node_name", "display_order"), new, "node_name", ["display_order"])


@REG.add(
    "departments_with_papers",
    f"""SELECT {S.norm('department_id')} AS department_id, min(department_name) AS department_name, min(department_code) AS department_code FROM taxonomy_facet_counts
    WHERE {S.norm('department_id')} IS NOT NULL AND paper_count > 0 GROUP BY 1""",
)
def departments_with_papers(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "taxonomy_facet_counts").withColumn("department_id", norm_key("department_id")).where("department_id IS NOT NULL AND paper_count > 0")
    return f.groupBy("department_id").agg(F.min("department_name").alias("department_name"), F.min("department_code").alias("department_code"))


@REG.add(
    "cube_null_pinned",
    f"SELECT facet_id, paper_count FROM taxonomy_facet_counts WHERE {S.norm('thematic_area_id')} IS NOT NULL AND domain_id IS NULL AND subdomain_id IS NULL AND department_id IS NULL",
)
def cube_null_pinned(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "taxonomy_facet_counts")
    pinned = norm_key("thematic_area_id").isNotNull()
    for c in ("domain_id", "subdomain_id", "department_id"):
        pinned = pinned & F.col(c).eqNullSafe(F.lit(None).cast("string"))
    return f.where(pinned).select("facet_id", "paper_count")


@REG.add(
    "taxonomy_papers_page",
    f"""WITH {S.LATEST}, x AS (SELECT paper_key, publication_year, citation_count FROM latest WHERE {S.norm('classification.domain_id')} = (SELECT min({S.norm('domain_id')}) FROM domains))
    SELECT row_number() OVER (ORDER BY publication_year DESC NULLS LAST, citation_count DESC NULLS LAST, paper_key) AS rank, paper_key FROM x ORDER BY rank LIMIT 20""",
)
def taxonomy_papers_page(spark: SparkSession, d: str) -> DataFrame:
    first = table(spark, d, "domains").agg(F.min(norm_key("domain_id"))).first()[0]
    order = [F.desc_nulls_last("publication_year"), F.desc_nulls_last("citation_count"), F.asc("paper_key")]
    p = latest_papers(table(spark, d, "papers"), "classification", "publication_year", "citation_count").where(norm_key("classification.domain_id") == first)
    return p.orderBy(*order).limit(20).select(F.row_number().over(W.orderBy(*order)).alias("rank"), "paper_key")
