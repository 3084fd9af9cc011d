"""Queries of the entry points: chosen fields, spelling variants, typeahead and browsing by slug."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.browse import NotFound, TaxonomyBrowser
from quarry.functions.text import with_variants
from quarry.operators import bm25
from quarry.plans import sqlparts as S
from quarry.plans import taxonomy as T
from quarry.plans.registry import Registry
from quarry.plans.search import NOW
from quarry.search import FIELD_BOOSTS, PaperSearch
from quarry.sources.tables import latest_papers, table
from quarry.suggest import suggest_authors, suggest_papers

REG = Registry()
_COLUMNS = ("title", "abstract", "publication_year", "citation_count", "document_type", "field_associated", "subject_area", "authors", "kerberos", "open_search_id")


def _search(spark: SparkSession, d: str) -> PaperSearch:
    return PaperSearch(latest_papers(table(spark, d, "papers"), *_COLUMNS), table(spark, d, "faculty"), table(spark, d, "departments"))


_FIELDS = f"""{S.LATEST}, tokens AS (
  SELECT paper_key AS doc_id, 'title' AS field, {S.toks('title')} AS ts FROM latest UNION ALL
  SELECT paper_key, 'field', {S.toks('field_associated')} FROM latest UNION ALL
  SELECT paper_key, 'subject', {S.toks("array_to_string(subject_area, ' ')")} FROM latest)"""


@REG.add("search_in_fields", f"WITH {_FIELDS}, {S.scored(['engineering', 'sensor'], FIELD_BOOSTS)}, {S.matched(2)} SELECT * FROM {S.top('m', 20)}")
def search_in_fields(spark: SparkSession, d: str) -> DataFrame:
    s = _search(spark, d)
    return bm25.top_k(s._match(s.papers, "engineering sensor", "advanced", ["title", "subject_area", "field"]), 20)


@REG.add(
    "search_in_author",
    f"""WITH {S.LATEST}, f AS (SELECT * FROM faculty WHERE {S.norm('firstname')} = 'boris' OR {S.norm('lastname')} = 'boris' ORDER BY expert_id LIMIT 25),
    ids AS (SELECT DISTINCT {S.norm('i')} AS i FROM (SELECT unnest(scopus_id) AS i FROM f)), kerbs AS (SELECT DISTINCT {S.norm("split_part(email, '@', 1)")} AS k FROM f)
    SELECT paper_key AS doc_id FROM latest WHERE {S.norm('kerberos')} IN (SELECT k FROM kerbs)
      OR list_has_any(list_transform(authors, lambda a: {S.norm('a.author_id')}), (SELECT list(i) FROM ids WHERE i IS NOT NULL))""",
)
def search_in_author(spark: SparkSession, d: str) -> DataFrame:
    """A name that resolves to staff: their papers by author id or kerberos."""
    s = _search(spark, d)
    return s._match(s.papers, "Boris", "advanced", ["author"]).select("doc_id")


_VARIANT = f"""WITH {S.PAPER_TOKENS}, {S.scored(['fiber', 'network', 'fibre'], {'title': 4.0, 'abstract': 1.5})},
one AS (SELECT doc_id, CASE term WHEN 'fibre' THEN 'fiber' ELSE term END AS term, score FROM s),
pt AS (SELECT doc_id, term, max(score) + 0.3::double * (sum(score) - max(score)) AS score FROM one GROUP BY ALL),
m AS (SELECT doc_id, sum(score) AS score FROM pt GROUP BY doc_id HAVING count(*) >= 2)"""


@REG.add("spelling_variant_and", f"{_VARIANT} SELECT * FROM {S.top('m', 20)}")
def spelling_variant_and(spark: SparkSession, d: str) -> DataFrame:
    """A word and its other spelling are one term of those asked for."""
    tokens = bm25.analysed(latest_papers(table(spark, d, "papers"), "title", "abstract"), "paper_key", {"title": "title", "abstract": "abstract"})
    words = ["fiber", "network"]
    return bm25.top_k(bm25.match(tokens, words, 2, {"title": 4.0, "abstract": 1.5}, variants=with_variants(words)), 20)


@REG.add(
    "accented_name_terms",
    """SELECT t AS term, count(*) AS n FROM (SELECT unnest(string_split(lower(trim(lastname)), ' ')) AS t FROM faculty) WHERE regexp_full_match(t, '[a-zà-ÿ]*[à-ÿ][a-zà-ÿ]*') GROUP BY t""",
)
def accented_name_terms(spark: SparkSession, d: str) -> DataFrame:
    """Words with letters beyond ASCII stay whole; the SQL splits at blanks and asks for letters."""
    from quarry.functions.text import terms

    words = F.filter(F.split(F.lower(F.trim("lastname")), " "), lambda w: w.rlike("^[a-zà-ÿ]+$"))
    t = table(spark, d, "faculty").select(F.explode(terms(F.array_join(words, " "))).alias("term")).where(F.col("term").rlike("[à-ÿ]"))
    return t.groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "typeahead_papers",
    f"""WITH {S.LATEST}, t AS (SELECT paper_key, title, {S.toks('title')} AS tt, {S.toks('abstract')} AS ta, citation_count, publication_year FROM latest),
    x AS (SELECT paper_key, title,
      CASE WHEN len(list_filter(tt, lambda t: starts_with(t, 'energy'))) > 0 AND len(list_filter(tt, lambda t: starts_with(t, 'den'))) > 0 THEN 4.0::double ELSE 0.0::double END
      + 2.0::double * len(list_filter(range(1, len(tt)), lambda i: tt[i] = 'energy' AND tt[i + 1] = 'den')) + 0.7::double * len(list_filter(range(1, len(ta)), lambda i: ta[i] = 'energy' AND ta[i + 1] = 'den'))
      + 0.5::double * len(list_filter(list_distinct(ta), lambda t: t IN ('energy', 'den'))) AS found,
      log10(1 + 0.2::double * coalesce(citation_count, 0)) + coalesce(exp(ln(0.5::double) * pow(abs(publication_year - {NOW}) / 8.0::double, 2)), 0) AS known FROM t)
    SELECT row_number() OVER (ORDER BY round(found + known, 4) DESC, paper_key) AS rank, paper_key, round(found + known, 4) AS score, title FROM x WHERE found > 0 ORDER BY rank LIMIT 8""",
)
def typeahead_papers(spark: SparkSession, d: str) -> DataFrame:
    return suggest_papers(latest_papers(table(spark, d, "papers"), "title", "abstract", "citation_count", "publication_year"), "Energy den", NOW)


@REG.add(
    "typeahead_authors",
    f"""WITH f AS (SELECT {S.norm('expert_id')} AS expert_id, trim(concat_ws(' ', trim(firstname), trim(lastname))) AS name, coalesce(h_index, 0) AS h, coalesce(citation_count, 0) AS c FROM faculty),
    x AS (SELECT *, CASE WHEN len(list_filter({S.toks('name')}, lambda t: starts_with(t, 'boris'))) > 0 THEN 3.0::double ELSE 0.0::double END + CASE WHEN lower(name) = 'boris' THEN 8.0::double ELSE 0.0::double END
      + 1.5::double * CASE WHEN len(list_filter({S.toks('name')}, lambda t: levenshtein(t, 'boris') <= 1 OR t IN ('obris', 'brois', 'boirs', 'borsi'))) > 0 THEN 1 ELSE 0 END AS found FROM f)
    SELECT row_number() OVER (ORDER BY round(found + log10(1 + 0.3::double * h) + log10(1 + 0.1::double * c), 4) DESC, expert_id) AS rank, expert_id,
      round(found + log10(1 + 0.3::double * h) + log10(1 + 0.1::double * c), 4) AS score, name FROM x WHERE found > 0 ORDER BY rank LIMIT 8""",
)
def typeahead_authors(spark: SparkSession, d: str) -> DataFrame:
    return suggest_authors(table(spark, d, "faculty"), "Boris")


# --- browsing by slug ---


def _rows(spark: SparkSession, ask: Callable[[], DataFrame], columns: str) -> DataFrame:
    """Rows of a browse. A slug or code that no node of these tables bears has none, as in the SQL; the browser itself raises."""
    try:
        return ask()
    except NotFound:
        return spark.createDataFrame([], columns)


_NODES = "rank int, slug string, name string, paper_count bigint, faculty_count bigint"


def _browser(spark: SparkSession, d: str) -> TaxonomyBrowser:
    return TaxonomyBrowser(latest_papers(table(spark, d, "papers"), "classification", "iitd_authors"), *[table(spark, d, n) for n in ("thematic_areas", "domains", "subdomains", "departments")])


_BASE = f"WITH {T._ROWS}, {T._CUBE}, dep AS (SELECT {S.norm('department_id')} AS id FROM departments WHERE {S.norm('department_code')} = 'pp01'), dom AS (SELECT {S.norm('domain_id')} AS id FROM domains WHERE slug = 'applied-photonics-and-slope-design')"


def _listed(table_: str, key: str, where: str, more: str = "") -> str:
    return f"""{_BASE} SELECT row_number() OVER (ORDER BY n.display_order, {S.norm(f'n.{key}')}) AS rank, {S.norm('n.slug')} AS slug, n.node_name AS name, c.paper_count, c.faculty_count{more}
    FROM {table_} n JOIN cube c ON c.{key} = {S.norm(f'n.{key}')} WHERE {where}"""


@REG.add("browse_themes_of_department", _listed("thematic_areas", "thematic_area_id", "c.domain_id IS NULL AND c.subdomain_id IS NULL AND c.department_id = (SELECT id FROM dep)"))
def browse_themes(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, lambda: _browser(spark, d).themes(department=" pp01"), _NODES)


@REG.add(
    "browse_domains",
    _listed(
        "domains", "domain_id", "c.thematic_area_id IS NULL AND c.subdomain_id IS NULL AND c.department_id IS NULL",
        ", (SELECT count(*) FROM cube s WHERE s.domain_id = c.domain_id AND s.subdomain_id IS NOT NULL AND s.thematic_area_id IS NULL AND s.department_id IS NULL) AS subdomain_count",
    ),
)
def browse_domains(spark: SparkSession, d: str) -> DataFrame:
    return _browser(spark, d).domains()


@REG.add("browse_subdomains", _listed("subdomains", "subdomain_id", "c.thematic_area_id IS NULL AND c.department_id IS NULL AND c.domain_id = (SELECT id FROM dom)"))
def browse_subdomains(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, lambda: _browser(spark, d).subdomains("applied-photonics-and-slope-design"), _NODES)


@REG.add(
    "browse_faculty_page",
    f"""{_BASE}, m AS (SELECT kerberos, count(DISTINCT paper_key) AS papers FROM rows WHERE kerberos IS NOT NULL AND faculty_ref IS NOT NULL AND domain_id = (SELECT id FROM dom) GROUP BY kerberos)
    SELECT * FROM (SELECT row_number() OVER (ORDER BY papers DESC, kerberos) AS rank, kerberos, papers FROM m) WHERE rank <= 20""",
)
def browse_faculty_page(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, lambda: _browser(spark, d).faculty(domain="applied-photonics-and-slope-design")[0], "rank int, kerberos string, papers bigint")
