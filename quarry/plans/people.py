"""Queries of identity joins and people for a query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.functions.text import terms
from quarry.operators import bm25, facets, identity
from quarry.plans import sqlparts as S
from quarry.plans.registry import Registry
from quarry.plans.search import BOOST, Q
from quarry.sources.indexes import paper_index, paper_snapshot
from quarry.sources.tables import table

REG = Registry()

_IDS = f"""fid AS (
  SELECT DISTINCT expert_id, id_kind, id FROM (
    SELECT {S.norm('expert_id')} AS expert_id, 'scopus' AS id_kind, {S.norm('x')} AS id FROM (SELECT expert_id, unnest(scopus_id) AS x FROM faculty)
    UNION ALL SELECT {S.norm('expert_id')}, 'kerberos', {S.norm("split_part(email, '@', 1)")} FROM faculty) WHERE id IS NOT NULL),
pid AS (
  SELECT DISTINCT paper_key, id_kind, id FROM (
    SELECT paper_key, 'scopus' AS id_kind, {S.norm('a.author_id')} AS id FROM (SELECT paper_key, unnest(authors) AS a FROM latest)
    UNION ALL SELECT paper_key, 'kerberos', {S.norm('kerberos')} FROM latest) WHERE id IS NOT NULL),
own AS (SELECT paper_key, expert_id, CASE WHEN count(DISTINCT id_kind) = 2 THEN 'both' WHEN max(id_kind) = 'kerberos' THEN 'kerberos' ELSE 'scopus_id' END AS matched_via
  FROM pid JOIN fid USING (id_kind, id) GROUP BY ALL)"""
_BASE = f"WITH {S.LATEST}, {_IDS}"
_HITS = f"""WITH {S.PAPER_TOKENS}, {S.scored(Q, BOOST)}, {S.matched(1)}, {_IDS}, hits AS (SELECT m.doc_id, m.score, l.* FROM m JOIN latest l ON l.paper_key = m.doc_id)"""


def _papers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return paper_snapshot(spark, d).select("paper_key", *cols)


def _hits(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d, "title", "abstract", "authors", "kerberos", "citation_count")
    return bm25.match(paper_index(spark, d), Q, 1, BOOST).join(p.withColumnRenamed("paper_key", "doc_id"), "doc_id")


@REG.add("dual_identity_union", f"{_BASE} SELECT * FROM own")
def dual_identity_union(spark: SparkSession, d: str) -> DataFrame:
    return identity.authorship(_papers(spark, d, "authors", "kerberos"), table(spark, d, "faculty"))


@REG.add(
    "resolved_authorship",
    f"""{_BASE}, k AS (SELECT DISTINCT {S.norm("split_part(email, '@', 1)")} AS k FROM faculty WHERE email IS NOT NULL)
    SELECT paper_key, expert_id, matched_via, NULL::varchar AS kerberos, 'faculty' AS source FROM own
    UNION ALL SELECT paper_key, NULL, 'kerberos', {S.norm('kerberos')}, 'csv_fallback' FROM latest WHERE {S.norm('kerberos')} NOT IN (SELECT k FROM k WHERE k IS NOT NULL)""",
)
def resolved_authorship(spark: SparkSession, d: str) -> DataFrame:
    return identity.resolved_authorship(_papers(spark, d, "authors", "kerberos"), table(spark, d, "faculty"))


@REG.add(
    "related_faculty",
    f"{_HITS} SELECT expert_id, count(DISTINCT doc_id) AS papers, coalesce(sum(citation_count), 0)::bigint AS citations FROM hits JOIN own ON own.paper_key = hits.doc_id GROUP BY expert_id",
)
def related_faculty(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    own = identity.authorship(h.withColumnRenamed("doc_id", "paper_key"), table(spark, d, "faculty")).select(F.col("paper_key").alias("doc_id"), "expert_id")
    return own.join(h.select("doc_id", "citation_count"), "doc_id").groupBy("expert_id").agg(F.countDistinct("doc_id").alias("papers"), F.coalesce(F.sum("citation_count"), F.lit(0)).cast("long").alias("citations"))


def _bucket_sql(source: str, size: int) -> str:
    return f"""SELECT key, count(*) AS papers, round(max(score), 6) AS max_score, round(avg(score), 6) AS avg_score, coalesce(sum(citation_count), 0)::bigint AS citations
      FROM ({source}) WHERE key IS NOT NULL GROUP BY key ORDER BY papers DESC, key LIMIT {size}"""


_FLAT = f"SELECT doc_id, score, citation_count, {S.norm('a.author_id')} AS key FROM (SELECT doc_id, score, citation_count, unnest(authors) AS a FROM hits)"
_NEST = f"SELECT DISTINCT * FROM ({_FLAT})"
_KERB = f"SELECT doc_id, score, citation_count, {S.norm('kerberos')} AS key FROM hits"


def _author_key():
    return F.explode(F.transform("authors", lambda a: norm_key(a["author_id"])))


@REG.add("author_buckets", f"{_HITS} {_bucket_sql(_FLAT, 200)}")
def author_buckets(spark: SparkSession, d: str) -> DataFrame:
    return facets.buckets(_hits(spark, d), _author_key(), 200)


@REG.add("author_buckets_nested", f"{_HITS} {_bucket_sql(_NEST, 200)}")
def author_buckets_nested(spark: SparkSession, d: str) -> DataFrame:
    return facets.buckets(_hits(spark, d), _author_key(), 200, nested=True)


@REG.add("kerberos_buckets", f"{_HITS} {_bucket_sql(_KERB, 200)}")
def kerberos_buckets(spark: SparkSession, d: str) -> DataFrame:
    return facets.buckets(_hits(spark, d), norm_key("kerberos"), 200)


@REG.add(
    "bucket_merge_max",
    f"""{_HITS} SELECT key, max(papers) AS papers, max(max_score) AS max_score, max(avg_score) AS avg_score, max(citations) AS citations
    FROM (SELECT * FROM ({_bucket_sql(_FLAT, 200)}) UNION ALL SELECT * FROM ({_bucket_sql(_NEST, 200)})) GROUP BY key""",
)
def bucket_merge_max(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d)
    return facets.merge_buckets(facets.buckets(h, _author_key(), 200), facets.buckets(h, _author_key(), 200, nested=True))


_SCORED = f"""b AS (SELECT key, round(0.6::double * max_score + 0.3::double * avg_score + 0.1::double * log2(1 + papers), 4) AS score FROM ({_bucket_sql(_NEST, 200)}))"""


@REG.add("author_score_threshold", f"{_HITS}, {_SCORED} SELECT key, score FROM b WHERE score >= 0.25::double * (SELECT max(score) FROM b)")
def author_score_threshold(spark: SparkSession, d: str) -> DataFrame:
    b = facets.buckets(_hits(spark, d), _author_key(), 200, nested=True)
    s = b.select("key", F.round(facets.author_score(F.col("max_score"), F.col("avg_score"), F.col("papers")), 4).alias("score"))
    return facets.above_share_of_best(s, "score")


@REG.add(
    "people_sidebar_departments",
    f"""{_HITS}, e AS (SELECT expert_id, count(*) AS papers, coalesce(sum(citation_count), 0)::bigint AS citations,
        round(0.6::double * max(score) + 0.3::double * avg(score) + 0.1::double * log2(1 + count(*)), 4) AS score FROM hits JOIN own ON own.paper_key = hits.doc_id GROUP BY expert_id),
    k AS (SELECT * FROM e WHERE score >= 0.25::double * (SELECT max(score) FROM e)),
    pp AS (SELECT k.*, coalesce(department_name, 'Other') AS department_name FROM k JOIN faculty f ON {S.norm('f.expert_id')} = k.expert_id
          LEFT JOIN departments d ON {S.norm('d.department_id')} = {S.norm('f.department')}),
    r AS (SELECT *, row_number() OVER (PARTITION BY department_name ORDER BY score DESC, expert_id) AS r FROM pp),
    g AS (SELECT department_name, count(*) AS people, sum(papers)::bigint AS papers, sum(citations)::bigint AS citations,
        round(avg(score) FILTER (r <= 3) * (1 + 0.1::double * log2(count(*))), 4) AS score FROM r GROUP BY department_name)
    SELECT *, row_number() OVER (ORDER BY (department_name = 'Other')::int, citations DESC, score DESC, department_name) AS rank FROM g""",
)
def people_sidebar_departments(spark: SparkSession, d: str) -> DataFrame:
    h, fac = _hits(spark, d), table(spark, d, "faculty")
    own = identity.authorship(h.withColumnRenamed("doc_id", "paper_key"), fac).select(F.col("paper_key").alias("doc_id"), "expert_id")
    e = own.join(h.select("doc_id", "score", "citation_count"), "doc_id").groupBy("expert_id").agg(
        F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citation_count"), F.lit(0)).cast("long").alias("citations"),
        F.round(facets.author_score(F.max("score"), F.avg("score"), F.count(F.lit(1))), 4).alias("score"),
    )
    e = facets.above_share_of_best(e, "score").join(fac.select(norm_key("expert_id").alias("expert_id"), norm_key("department").alias("department")), "expert_id")
    return identity.by_department(e, table(spark, d, "departments"))


_ANCHOR = f"(SELECT {S.norm('a.author_id')} AS id FROM (SELECT unnest(authors) AS a FROM latest) WHERE {S.norm('a.author_id')} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"


@REG.add(
    "coauthors_top50",
    f"""WITH {S.LATEST}, me AS {_ANCHOR}, mine AS (SELECT * FROM latest WHERE list_contains(list_transform(authors, lambda a: {S.norm('a.author_id')}), (SELECT id FROM me))),
    x AS (SELECT {S.norm('a.author_id')} AS author_id, count(*) AS n FROM (SELECT unnest(authors) AS a FROM mine) GROUP BY 1)
    SELECT row_number() OVER (ORDER BY n DESC, author_id) AS rank, author_id, n FROM x WHERE author_id IS NOT NULL AND author_id <> (SELECT id FROM me) ORDER BY rank LIMIT 50""",
)
def coauthors_top50(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d, "authors")
    me = p.select(F.explode("authors").alias("a")).select(norm_key("a.author_id").alias("id")).where("id IS NOT NULL").groupBy("id").count().orderBy(F.desc("count"), "id").first()
    return identity.coauthors(p, [me["id"]])


@REG.add(
    "faculty_paper_counts",
    f"""{_BASE}, c AS (SELECT id, count(*) AS n FROM pid WHERE id_kind = 'scopus' GROUP BY id)
    SELECT fid.expert_id, coalesce(sum(n), 0)::bigint AS paper_count FROM fid LEFT JOIN c USING (id) WHERE id_kind = 'scopus' GROUP BY fid.expert_id""",
)
def faculty_paper_counts(spark: SparkSession, d: str) -> DataFrame:
    """Papers per profile as the sum over its ids: a paper under two ids of one person counts twice."""
    counts = identity.paper_ids(_papers(spark, d, "authors", "kerberos")).where("id_kind = 'scopus'").groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    f = identity.faculty_ids(table(spark, d, "faculty")).where("id_kind = 'scopus'")
    return f.join(counts, "id", "left").groupBy("expert_id").agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("paper_count"))


@REG.add(
    "resolve_profiles",
    f"""{_BASE}, ids AS (SELECT DISTINCT id FROM pid WHERE id_kind = 'scopus' UNION SELECT {S.norm('expert_id')} FROM faculty),
    c AS (SELECT id, 0 AS o, expert_id FROM fid WHERE id_kind = 'scopus' UNION ALL SELECT {S.norm('expert_id')}, 1, {S.norm('expert_id')} FROM faculty)
    SELECT id, expert_id FROM (SELECT id, expert_id, row_number() OVER (PARTITION BY id ORDER BY o, expert_id) AS r FROM ids JOIN c USING (id)) WHERE r = 1""",
)
def resolve_profiles(spark: SparkSession, d: str) -> DataFrame:
    fac = table(spark, d, "faculty")
    ids = identity.paper_ids(_papers(spark, d, "authors", "kerberos")).where("id_kind = 'scopus'").select("id").union(fac.select(norm_key("expert_id").alias("id"))).distinct()
    return identity.resolve_profile(fac, ids)


@REG.add(
    "display_name_overlay",
    rf"""{_BASE}, n AS (SELECT {S.norm('expert_id')} AS expert_id, trim(regexp_replace(concat_ws(' ', title, firstname, lastname), '\s+', ' ', 'g')) AS name FROM faculty)
    SELECT paper_key, expert_id, name FROM own JOIN n USING (expert_id)""",
)
def display_name_overlay(spark: SparkSession, d: str) -> DataFrame:
    fac = table(spark, d, "faculty")
    names = fac.select(norm_key("expert_id").alias("expert_id"), identity.display_name().alias("name"))
    return identity.authorship(_papers(spark, d, "authors", "kerberos"), fac).select("paper_key", "expert_id").join(names, "expert_id")


@REG.add(
    "unmatched_anti_join",
    f"{_BASE} SELECT DISTINCT id FROM pid WHERE id_kind = 'kerberos' AND id NOT IN (SELECT id FROM fid WHERE id_kind = 'kerberos')",
)
def unmatched_anti_join(spark: SparkSession, d: str) -> DataFrame:
    known = identity.faculty_ids(table(spark, d, "faculty")).where("id_kind = 'kerberos'").select("id")
    return identity.paper_ids(_papers(spark, d, "authors", "kerberos")).where("id_kind = 'kerberos'").select("id").distinct().join(known, "id", "left_anti")


@REG.add(
    "department_resolution",
    f"""WITH n AS (SELECT facet_id, {S.norm('department_name')} AS name, {S.norm('department_code')} AS code FROM taxonomy_facet_counts),
    dep AS (SELECT {S.norm('department_id')} AS id, {S.norm('department_name')} AS name, {S.norm('department_code')} AS code FROM departments),
    bn AS (SELECT name, min(id) AS id FROM dep WHERE name IS NOT NULL GROUP BY name), bc AS (SELECT code, min(id) AS id FROM dep WHERE code IS NOT NULL GROUP BY code)
    SELECT facet_id, coalesce(bn.id, bc.id) AS department_id FROM n LEFT JOIN bn USING (name) LEFT JOIN bc ON bc.code = n.code""",
)
def department_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Copied department names and codes back to ids: by name, then by code; null where neither is known."""
    dep = table(spark, d, "departments").select(norm_key("department_id").alias("id"), norm_key("department_name").alias("name"), norm_key("department_code").alias("code"))
    by_name = dep.where("name IS NOT NULL").groupBy("name").agg(F.min("id").alias("by_name"))
    by_code = dep.where("code IS NOT NULL").groupBy("code").agg(F.min("id").alias("by_code"))
    n = table(spark, d, "taxonomy_facet_counts").select("facet_id", norm_key("department_name").alias("name"), norm_key("department_code").alias("code"))
    return n.join(by_name, "name", "left").join(by_code, "code", "left").select("facet_id", F.coalesce("by_name", "by_code").alias("department_id"))


@REG.add(
    "name_variants",
    r"""WITH f AS (SELECT expert_id, trim(firstname) AS f, trim(lastname) AS l, trim(title) AS t FROM faculty),
    i AS (SELECT *, list_transform(list_filter(regexp_split_to_array(f, '\s+'), lambda w: w <> ''), lambda w: left(w, 1)) AS ini FROM f),
    v AS (SELECT expert_id, unnest([concat_ws(' ', f, l), concat_ws(' ', t, f, l), concat_ws(' ', l, f), concat_ws(', ', l, f),
      concat_ws(' ', array_to_string(list_transform(ini, lambda x: x || '.'), ' '), l), concat_ws(' ', l, array_to_string(list_transform(ini, lambda x: x || '.'), ' ')),
      concat_ws(' ', array_to_string(ini, ''), l)]) AS v FROM i)
    SELECT expert_id, trim(regexp_replace(v, '\s+', ' ', 'g')) AS variant FROM v WHERE trim(v) <> '' GROUP BY ALL""",
)
def name_variants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "faculty").select("expert_id", F.explode(identity.name_variants()).alias("variant"))


@REG.add(
    "name_token_vocabulary",
    f"""SELECT DISTINCT token FROM (SELECT regexp_replace(unnest(regexp_split_to_array(lower(concat_ws(' ', firstname, lastname)), '\\s+')), '[^a-z]', '', 'g') AS token FROM faculty) WHERE length(token) >= 2""",
)
def name_token_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    words = F.split(F.lower(F.concat_ws(" ", "firstname", "lastname")), r"\s+")
    return table(spark, d, "faculty").select(F.explode(words).alias("w")).select(F.regexp_replace("w", "[^a-z]", "").alias("token")).where(F.length("token") >= 2).distinct()


@REG.add(
    "lead_authors",
    f"""WITH {S.LATEST}, a AS (SELECT paper_key, generate_subscripts(authors, 1) AS i, unnest(authors) AS a FROM latest)
    SELECT paper_key, {S.norm('a.author_id')} AS author_id FROM (SELECT *, row_number() OVER (PARTITION BY paper_key ORDER BY coalesce(try_cast(trim(a.author_position) AS int), 1073741824), i) AS r FROM a) WHERE r = 1""",
)
def lead_authors(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "authors").where(F.size("authors") > 0).select("paper_key", identity.lead_author().alias("author_id"))


@REG.add(
    "suggest_authors",
    f"""WITH f AS (SELECT expert_id, {S.toks("concat_ws(' ', firstname, lastname)")} AS ts, coalesce(h_index, 0) AS h, coalesce(citation_count, 0) AS c FROM faculty),
    s AS (SELECT expert_id, round(3.0::double * len(list_filter(ts, lambda t: t = 'nisha')) + 1.0::double * len(list_filter(ts, lambda t: starts_with(t, 'ni')))
      + 0.5::double * ln(1 + h) + 0.2::double * log10(1 + c), 4) AS score FROM f WHERE len(list_filter(ts, lambda t: starts_with(t, 'ni'))) > 0)
    SELECT row_number() OVER (ORDER BY score DESC, expert_id) AS rank, expert_id, score FROM s ORDER BY rank LIMIT 8""",
)
def suggest_authors(spark: SparkSession, d: str) -> DataFrame:
    ts = terms(F.concat_ws(" ", "firstname", "lastname"))
    x = table(spark, d, "faculty").withColumn("ts", ts).where(F.exists("ts", lambda t: t.startswith("ni")))
    score = 3.0 * F.size(F.filter("ts", lambda t: t == "nisha")) + F.size(F.filter("ts", lambda t: t.startswith("ni"))) + 0.5 * F.log1p(F.coalesce("h_index", F.lit(0))) + 0.2 * F.log10(1 + F.coalesce("citation_count", F.lit(0)))
    best = x.select("expert_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "expert_id").limit(8)
    return best.select(F.row_number().over(W.orderBy(F.desc("score"), "expert_id")).alias("rank"), "expert_id", "score")


@REG.add("author_query_cascade", f"SELECT expert_id FROM faculty WHERE {S.norm('firstname')} = 'nisha' OR {S.norm('lastname')} = 'nisha' ORDER BY expert_id LIMIT 25")
def author_query_cascade(spark: SparkSession, d: str) -> DataFrame:
    return identity.author_query(table(spark, d, "faculty"), " Nisha ")
