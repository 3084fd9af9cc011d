"""Queries of the general data-quality operators: hot keys, dangling references, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import flatten, integrity, skew
from quarry.plans.registry import Registry
from quarry.session import checkpoint
from quarry.sources.tables import latest_papers, table

REG = Registry()

_NORM = r"nullif(regexp_replace(lower({0}), '^\s+|\s+$', '', 'g'), '')"


def _n(x: str) -> str:
    return _NORM.format(x)


_LATEST = f"""latest AS (
  SELECT * FROM (
    SELECT *, coalesce({_n('mongo_id')}, 'delivery:' || delivery_id) AS paper_key,
           row_number() OVER (PARTITION BY coalesce({_n('mongo_id')}, 'delivery:' || delivery_id) ORDER BY updated_at DESC NULLS LAST, delivery_id DESC) AS rn
    FROM papers) WHERE rn = 1)"""

_LONG = f"""{_LATEST}, long AS (
  SELECT 'kerberos' AS field_name, {_n('kerberos')} AS key_value, paper_key, citation_count, publication_year FROM latest
  UNION ALL
  SELECT DISTINCT 'subject_area', {_n('a')}, paper_key, citation_count, publication_year
  FROM (SELECT unnest(subject_area) AS a, * FROM latest)),
named AS (SELECT * FROM long WHERE key_value IS NOT NULL)"""


def _papers(spark: SparkSession, d: str) -> DataFrame:
    return latest_papers(table(spark, d, "papers"), "kerberos", "subject_area", "citation_count", "publication_year")


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return skew.key_profile(_papers(spark, d))


@REG.add(
    "p3_found",
    f"""WITH {_LONG} SELECT field_name, key_value FROM named GROUP BY ALL
    HAVING count(*) >= 0.03::double * (SELECT count(*) FROM latest)""",
)
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    # both reads of the papers come from one written table
    papers = checkpoint(_papers(spark, d).select("kerberos", "subject_area", "citation_count", "publication_year"))
    return skew.heavy_keys(skew.key_rows(papers), papers.count())


@REG.add(
    "p3_key_profile",
    f"""WITH {_LONG}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY field_name, key_value ORDER BY citation_count) AS r,
             count(*) OVER (PARTITION BY field_name, key_value) AS n FROM named WHERE citation_count IS NOT NULL),
    qs AS (SELECT field_name, key_value, max(CASE WHEN r = greatest(1, ceil(0.5::double * n)) THEN citation_count END) AS citations_p50,
             max(CASE WHEN r = greatest(1, ceil(0.9::double * n)) THEN citation_count END) AS citations_p90 FROM ranked GROUP BY ALL)
    SELECT field_name, key_value, count(*) AS papers, coalesce(sum(citation_count), 0)::bigint AS citations, min(publication_year) AS first_year,
           max(publication_year) AS last_year, any_value(citations_p50) AS citations_p50, any_value(citations_p90) AS citations_p90
    FROM named LEFT JOIN qs USING (field_name, key_value) GROUP BY field_name, key_value""",
)
def p3_key_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(spark, d)


def _dangling(spark: SparkSession, d: str) -> DataFrame:
    papers = latest_papers(table(spark, d, "papers"), "iitd_authors", "classification", "created_at")
    refs = integrity.paper_references(papers).unionByName(integrity.facet_references(table(spark, d, "taxonomy_facet_counts")))
    ids = {"faculty": "faculty_id", "departments": "department_id", "thematic_areas": "thematic_area_id", "domains": "domain_id", "subdomains": "subdomain_id"}
    return integrity.dangling_references(refs, integrity.long_parents({n: (table(spark, d, n), k) for n, k in ids.items()}))


_REFS = f"""WITH {_LATEST}, ia AS (SELECT paper_key, created_at, unnest(iitd_authors) AS a FROM latest),
parents AS (
  SELECT 'faculty' AS pt, {_n('faculty_id')} AS id, created_at AS c, deleted_at AS d FROM faculty
  UNION ALL SELECT 'departments', {_n('department_id')}, created_at, deleted_at FROM departments
  UNION ALL SELECT 'thematic_areas', {_n('thematic_area_id')}, created_at, deleted_at FROM thematic_areas
  UNION ALL SELECT 'domains', {_n('domain_id')}, created_at, deleted_at FROM domains
  UNION ALL SELECT 'subdomains', {_n('subdomain_id')}, created_at, deleted_at FROM subdomains),
refs AS (
  SELECT 'papers' AS ref_table, 'iitd_authors.faculty_ref' AS ref_field, paper_key AS row_key, 'faculty' AS pt, {_n('a.faculty_ref')} AS v, created_at AS t FROM ia
  UNION SELECT 'papers', 'iitd_authors.department_ref', paper_key, 'departments', {_n('a.department_ref')}, created_at FROM ia
  UNION SELECT 'papers', 'classification.thematic_area_id', paper_key, 'thematic_areas', {_n('classification.thematic_area_id')}, created_at FROM latest
  UNION SELECT 'papers', 'classification.domain_id', paper_key, 'domains', {_n('classification.domain_id')}, created_at FROM latest
  UNION SELECT 'papers', 'classification.subdomain_id', paper_key, 'subdomains', {_n('classification.subdomain_id')}, created_at FROM latest
  UNION SELECT 'taxonomy_facet_counts', 'department_id', facet_id::varchar, 'departments', {_n('department_id')}, updated_at FROM taxonomy_facet_counts),
dangling AS (
  SELECT *, CASE WHEN NOT EXISTS (SELECT 1 FROM parents p WHERE p.pt = r.pt AND p.id = r.v) THEN 'missing'
                 WHEN EXISTS (SELECT 1 FROM parents p WHERE p.pt = r.pt AND p.id = r.v AND p.d <= r.t) THEN 'deleted' ELSE 'later' END AS reason
  FROM refs r WHERE v IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM parents p WHERE p.pt = r.pt AND p.id = r.v AND coalesce(p.c <= r.t, true) AND coalesce(p.d > r.t, true)))"""


@REG.add("p4_found", f"{_REFS} SELECT ref_table, ref_field, row_key, v AS ref_value, strftime(t, '%Y-%m') AS ref_month FROM dangling")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _dangling(spark, d).select("ref_table", "ref_field", "row_key", "ref_value", F.date_format("ref_time", "yyyy-MM").alias("ref_month"))


@REG.add(
    "p4_report",
    f"{_REFS} SELECT ref_table, ref_field, strftime(t, '%Y-%m') AS ref_month, reason, count(*) AS n_refs, count(DISTINCT v) AS n_values FROM dangling GROUP BY ALL",
)
def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return integrity.reference_report(_dangling(spark, d))


def _dec(x: str) -> str:
    return f"""(CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[\\[{{"]') AND json_valid({x} ->> '$') THEN ({x} ->> '$')::JSON ELSE {x} END)"""


def _text(x: str) -> str:
    tags = ", ".join(f"""{x} ->> '$."{t}"'""" for t in flatten.SCALAR_TAGS)
    return f"(CASE WHEN {x} IS NULL OR json_type({x}) = 'NULL' THEN '' WHEN json_type({x}) = 'OBJECT' THEN coalesce({tags}, {x}::varchar) ELSE coalesce({x} ->> '$', '') END)"


def _items(source: str, field: str, keep: str) -> str:
    """Rows of a list field: places kept, nulls left out."""
    return f"""SELECT {keep}, pos, {_dec('e')} AS v FROM (
      SELECT {keep}, unnest(items) AS e, generate_subscripts(items, 1) - 1 AS pos FROM (
        SELECT {keep}, CASE WHEN l IS NULL OR json_type(l) = 'NULL' THEN [] WHEN json_type(l) = 'ARRAY' THEN json_extract(l, '$[*]') ELSE [l] END AS items
        FROM (SELECT {keep}, {_dec(f"json_extract(v, '$.{field}')")} AS l FROM {source}))) WHERE e IS NOT NULL AND json_type(e) <> 'NULL'"""


def _open(source: str, field: str) -> str:
    inner = _dec(f"json_extract(v, '$.{field}')")
    return f"SELECT export_id, CASE WHEN json_type({inner}) = 'OBJECT' THEN {inner} ELSE v END AS v FROM {source}"


_EXPORTS = f"""WITH parsed AS (SELECT export_id, {_dec('j')} AS v FROM (SELECT export_id, CASE WHEN json_valid(payload) THEN payload::JSON END AS j FROM paper_exports)),
outer_ AS ({_open('parsed', 'o')}), docs AS ({_open('outer_', 'document')}),
authors AS ({_items('docs', 'authors', 'export_id')}), staff AS ({_items('docs', 'iitd_authors', 'export_id')}), classes AS ({_items('docs', 'classification', 'export_id')}),
authors_ AS (SELECT export_id, pos AS elem, v FROM authors), classes_ AS (SELECT export_id, pos AS elem, v FROM classes),
names AS ({_items('authors_', 'author_avaialable_names', 'export_id, elem')}), topics AS ({_items('classes_', 'topics', 'export_id, elem')})"""


def _key(field: str) -> str:
    return _text(_dec(f"json_extract(v, '$.{field}')"))


@REG.add(
    "p5_found",
    f"""{_EXPORTS}
    SELECT export_id, 'author' AS child_kind, pos AS elem_pos, -1::bigint AS sub_pos, {_key('author_id')} AS child_key FROM authors
    UNION ALL SELECT export_id, 'iitd_author', pos, -1, {_key('kerberos')} FROM staff
    UNION ALL SELECT export_id, 'classification', pos, -1, {_key('subdomain_id')} FROM classes WHERE v::varchar <> '{{}}'
    UNION ALL SELECT export_id, 'author_name', elem, pos, {_text('v')} FROM names
    UNION ALL SELECT export_id, 'topic', elem, pos, {_text('v')} FROM topics""",
)
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.export_children(table(spark, d, "paper_exports"))


@REG.add(
    "p5_author_table",
    f"""{_EXPORTS} SELECT export_id, pos AS author_pos, {_key('author_id')} AS author_id, {_key('author_position')} AS author_position, {_key('author_name')} AS author_name FROM authors""",
)
def p5_author_table(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the authors with its own columns."""
    authors = flatten.export_tables(table(spark, d, "paper_exports")).table("authors")
    return authors.select("export_id", F.col("place_0").alias("author_pos"), "author_id", "author_position", "author_name")


@REG.add(
    "p5_name_parents",
    f"""{_EXPORTS} SELECT export_id, {_text('n.v')} AS author_name, {_text(_dec("json_extract(a.v, '$.author_id')"))} AS author_id FROM names n JOIN authors a USING (export_id) WHERE a.pos = n.elem""",
)
def p5_name_parents(spark: SparkSession, d: str) -> DataFrame:
    """Names joined to their authors by the surrogate parent key."""
    t = flatten.export_tables(table(spark, d, "paper_exports"))
    names = t.table("authors.author_avaialable_names").select("export_id", flatten.PARENT_KEY, F.col("value").alias("author_name"))
    return names.join(t.table("authors").select(F.col(flatten.ROW_KEY).alias(flatten.PARENT_KEY), "author_id"), flatten.PARENT_KEY).select("export_id", "author_name", "author_id")
