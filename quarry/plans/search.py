"""Queries of lexical, vector and hybrid retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.functions.normal import clean, norm_key
from quarry.operators import bm25, facets, filters, ranking
from quarry.plans import sqlparts as S
from quarry.plans.registry import Registry
from quarry.sources.indexes import document_index, paper_index, paper_snapshot
from quarry.sources.tables import table

REG = Registry()
Q = ["sensor", "network", "energy"]
LONG = ["adaptive", "battery", "network", "energy", "density", "benchmark"]
BOOST = {"title": 4.0, "abstract": 1.5}
NOW = 2026


def _papers(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return paper_snapshot(spark, d).select("paper_key", *cols)


def _doc_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bm25.analysed(table(spark, d, "documents"), "doc_id", {"text": "text"})


def _paper_tokens(spark: SparkSession, d: str) -> DataFrame:
    return bm25.analysed(_papers(spark, d, "title", "abstract"), "paper_key", {"title": "title", "abstract": "abstract"})


# --- filters ---


@REG.add(
    "scan_filter_range",
    f"""WITH {S.LATEST} SELECT paper_key, publication_year, citation_count FROM latest
    WHERE publication_year >= 2012 AND publication_year <= 2018 AND {S.norm('document_type')} = 'article'""",
)
def scan_filter_range(spark: SparkSession, d: str) -> DataFrame:
    f = {"year_from": 2012, "year_to": 2018, "document_type": "Article", "no_such_filter": 1, "citations": 0}
    return _papers(spark, d, "publication_year", "citation_count", "document_type").where(filters.paper_filter(f)).select("paper_key", "publication_year", "citation_count")


@REG.add(
    "filter_isin_arrays",
    f"""WITH {S.LATEST} SELECT paper_key, len(subject_area) AS n_areas FROM latest
    WHERE len(list_filter(list_transform(subject_area, lambda x: {S.norm('x')}), lambda x: x IN ('engineering sciences', 'computing sciences'))) > 0
      AND {S.norm('document_type')} IN ('article', 'review', 'conference paper')""",
)
def filter_isin_arrays(spark: SparkSession, d: str) -> DataFrame:
    f = {"subject_area": ["Engineering Sciences", "Computing Sciences"], "document_types": ["Article", "Review", "Conference Paper"]}
    return _papers(spark, d, "subject_area", "document_type").where(filters.paper_filter(f)).select("paper_key", F.size("subject_area").cast("long").alias("n_areas"))


@REG.add("filter_interdisciplinary", f"WITH {S.LATEST} SELECT paper_key FROM latest WHERE len(subject_area) >= 3")
def filter_interdisciplinary(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "subject_area").where(filters.paper_filter({"interdisciplinary": True})).select("paper_key")


@REG.add(
    "filter_any_author",
    f"""WITH {S.LATEST} SELECT paper_key FROM latest WHERE len(list_filter(authors, lambda a: {S.norm('a.author_id')} = '99000000039')) > 0 OR {S.norm('kerberos')} = 'wetlab'""",
)
def filter_any_author(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "authors", "kerberos").where(filters.paper_filter({"author_id": "99000000039"}, author_kerberos="wetlab")).select("paper_key")


@REG.add(
    "filter_first_author_uncorrelated",
    f"""WITH {S.LATEST} SELECT paper_key FROM latest WHERE {S.norm('kerberos')} = 'wetlab' AND len(list_filter(authors, lambda a: trim(a.author_position) = '1')) > 0""",
)
def filter_first_author(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "authors", "kerberos").where(filters.paper_filter({"first_author_only": True, "kerberos": "wetlab"})).select("paper_key")


@REG.add("valid_object_ids", "SELECT count(*) FILTER (regexp_full_match(mongo_id, '[a-f0-9]{24}')) AS valid, count(*) FILTER (NOT coalesce(regexp_full_match(mongo_id, '[a-f0-9]{24}'), false)) AS invalid FROM papers")
def valid_object_ids(spark: SparkSession, d: str) -> DataFrame:
    ok = filters.is_object_id("mongo_id")
    return table(spark, d, "papers").agg(F.count(F.when(ok, 1)).alias("valid"), F.count(F.when(~ok, 1)).alias("invalid"))


@REG.add("browse_documents", f"SELECT row_number() OVER (ORDER BY publication_year DESC NULLS LAST, doc_id) AS rank, doc_id, publication_year FROM documents WHERE {S.norm('source')} = 'patents' ORDER BY rank LIMIT 20")
def browse_documents(spark: SparkSession, d: str) -> DataFrame:
    order = [F.desc_nulls_last("publication_year"), F.asc("doc_id")]
    x = table(spark, d, "documents").where(filters.document_filter({"source": "patents"})).orderBy(*order).limit(20)
    return x.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "doc_id", "publication_year")


# --- lexical ---


def _lexical(name: str, words: list[str], required: int, docs: bool, boosts: dict[str, float] | None = None) -> None:
    sql = f"WITH {S.DOC_TOKENS if docs else S.PAPER_TOKENS}, {S.scored(words, boosts)}, {S.matched(required)} SELECT * FROM {S.top('m', 20)}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        return bm25.top_k(bm25.match(document_index(spark, d) if docs else paper_index(spark, d), words, required, boosts), 20)

    REG.add(name, sql)(run)


_lexical("bm25_or_topk", Q, 1, True)
_lexical("bm25_and_topk", Q, len(Q), True)
_lexical("bm25_nofm_terms", LONG, T.required_matches(len(LONG)), True)
_lexical("best_fields_tie_breaker", Q, 1, False, BOOST)
_lexical("cross_fields_and", Q, len(Q), False, BOOST)
_lexical("spelling_variant_or", ["fiber", T.spelling_variant("fiber"), "optimizer", T.spelling_variant("optimizer")], 1, False)


@REG.add(
    "basic_search_filtered",
    f"""WITH {S.DOC_TOKENS}, {S.scored(Q)}, {S.matched(len(Q))}, f AS (SELECT m.* FROM m JOIN documents USING (doc_id)
      WHERE {S.norm('lang')} = 'en' AND n_chars >= 500 AND publication_year >= 2010) SELECT * FROM {S.top('f', 20)}""",
)
def basic_search_filtered(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(filters.document_filter({"lang": "en", "min_chars": 500, "year_from": 2010})).select("doc_id")
    return bm25.top_k(bm25.match(document_index(spark, d), Q, len(Q)).join(docs, "doc_id", "left_semi"), 20)


@REG.add("phrase_exact", f"WITH {S.PAPER_TOKENS} SELECT doc_id, field FROM tokens WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' energy density ')")
def phrase_exact(spark: SparkSession, d: str) -> DataFrame:
    return _paper_tokens(spark, d).where(bm25.phrase_at(F.col("ts"), ["energy", "density"])).select("doc_id", "field")


@REG.add(
    "phrase_slop",
    f"""WITH {S.PAPER_TOKENS}, pos AS (SELECT doc_id, field, ts, unnest(range(1, len(ts) + 1)) AS i FROM tokens)
    SELECT DISTINCT doc_id, field FROM pos WHERE ts[i] = 'sensor' AND (ts[i + 1] = 'network' OR ts[i + 2] = 'network' OR ts[i + 3] = 'network')""",
)
def phrase_slop(spark: SparkSession, d: str) -> DataFrame:
    return _paper_tokens(spark, d).where(bm25.phrase_at(F.col("ts"), ["sensor", "network"], slop=2)).select("doc_id", "field")


@REG.add("phrase_prefix", f"WITH {S.PAPER_TOKENS} SELECT doc_id, field FROM tokens WHERE contains(' ' || array_to_string(ts, ' '), ' bit error ra')")
def phrase_prefix(spark: SparkSession, d: str) -> DataFrame:
    return _paper_tokens(spark, d).where(bm25.phrase_prefix_at(F.col("ts"), ["bit", "error", "ra"])).select("doc_id", "field")


@REG.add(
    "phrase_boost",
    f"""WITH {S.PAPER_TOKENS}, {S.scored(['sensor', 'network'], BOOST)}, {S.matched(2)},
    b AS (SELECT doc_id, sum(CASE field WHEN 'title' THEN 20.0::double ELSE 6.0::double END) AS bonus FROM tokens
          WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' sensor network ') GROUP BY doc_id),
    x AS (SELECT m.doc_id, m.score + coalesce(bonus, 0) AS score FROM m LEFT JOIN b USING (doc_id)) SELECT * FROM {S.top('x', 20)}""",
)
def phrase_boost(spark: SparkSession, d: str) -> DataFrame:
    t = _paper_tokens(spark, d)
    bonus = t.where(bm25.phrase_at(F.col("ts"), ["sensor", "network"])).groupBy("doc_id").agg(F.sum(F.when(F.col("field") == "title", 20.0).otherwise(6.0)).alias("bonus"))
    x = bm25.match(paper_index(spark, d), ["sensor", "network"], 2, BOOST).join(bonus, "doc_id", "left").select("doc_id", (F.col("score") + F.coalesce("bonus", F.lit(0.0))).alias("score"))
    return bm25.top_k(x, 20)


@REG.add(
    "refine_chain_intersect",
    f"""WITH {S.DOC_TOKENS} SELECT doc_id FROM tokens WHERE list_contains(ts, 'sensor') INTERSECT SELECT doc_id FROM tokens WHERE list_contains(ts, 'energy')
    INTERSECT SELECT doc_id FROM tokens WHERE list_contains(ts, 'density')""",
)
def refine_chain_intersect(spark: SparkSession, d: str) -> DataFrame:
    t = _doc_tokens(spark, d)
    out = t.select("doc_id").distinct()
    for w in T.query_terms("sensor energy ENERGY density"):
        out = out.join(t.where(F.array_contains("ts", w)).select("doc_id"), "doc_id", "left_semi")
    return out


@REG.add(
    "mixed_author_text",
    f"""WITH {S.LATEST}, x AS (SELECT paper_key, {S.toks('title')} || {S.toks('abstract')} AS ts,
      list_transform(authors, lambda a: {S.toks('a.author_name')}) AS names FROM latest)
    SELECT paper_key FROM x WHERE (list_contains(ts, 'sensor') OR len(list_filter(names, lambda n: list_contains(n, 'sensor'))) > 0)
      AND (list_contains(ts, 'prof') OR len(list_filter(names, lambda n: list_contains(n, 'prof'))) > 0)""",
)
def mixed_author_text(spark: SparkSession, d: str) -> DataFrame:
    p = _papers(spark, d, "title", "abstract", "authors")
    hit = F.lit(True)
    for w in ("sensor", "prof"):
        name = F.exists(F.coalesce("authors", F.array().cast(p.schema["authors"].dataType)), _named(w))
        hit = hit & (F.array_contains(T.terms("title"), w) | F.array_contains(T.terms("abstract"), w) | name)
    return p.where(hit).select("paper_key")


def _named(w: str):
    return lambda a: F.array_contains(T.terms(a["author_name"]), w)


@REG.add(
    "roster_gate_semijoin",
    f"""WITH {S.LATEST}, roster AS (SELECT DISTINCT {S.norm('x')} AS id FROM (SELECT unnest(scopus_id) AS x FROM faculty)),
    a AS (SELECT paper_key, unnest(authors) AS a FROM latest)
    SELECT DISTINCT paper_key FROM a WHERE {S.norm('a.author_id')} IN (SELECT id FROM roster WHERE id IS NOT NULL) AND list_contains({S.toks('a.author_name')}, 'prof')""",
)
def roster_gate_semijoin(spark: SparkSession, d: str) -> DataFrame:
    roster = table(spark, d, "faculty").select(F.explode("scopus_id").alias("x")).select(norm_key("x").alias("id")).where("id IS NOT NULL").distinct()
    a = _papers(spark, d, "authors").select("paper_key", F.explode("authors").alias("a")).where(F.array_contains(T.terms("a.author_name"), "prof"))
    return a.select("paper_key", norm_key("a.author_id").alias("id")).join(roster, "id", "left_semi").select("paper_key").distinct()


@REG.add(
    "fuzzy_vocabulary",
    f"""WITH {S.DOC_TOKENS}, v AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ts)) AS term FROM tokens) GROUP BY term),
    w(word) AS (VALUES ('sensro'), ('netwrk'), ('laminate')),
    x AS (SELECT word, term, df, CASE WHEN length(word) = length(term) AND damerau_levenshtein(word, term) = 1 THEN 1 ELSE levenshtein(word, term) END AS d FROM v, w
          WHERE abs(length(word) - length(term)) <= 2)
    SELECT word, term, df, d, row_number() OVER (PARTITION BY word ORDER BY d, df DESC, term) AS r FROM x
    WHERE d <= CASE WHEN length(word) <= 2 THEN 0 WHEN length(word) <= 5 THEN 1 ELSE 2 END QUALIFY r <= 10""",
)
def fuzzy_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return bm25.fuzzy_terms(bm25.vocabulary(_doc_tokens(spark, d)), ["sensro", "netwrk", "laminate"])


@REG.add(
    "did_you_mean_vocab",
    f"""WITH {S.DOC_TOKENS}, v AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(ts)) AS term FROM tokens) GROUP BY term),
    w(word) AS (VALUES ('sensro'), ('polimer'), ('turbin')),
    x AS (SELECT word, term, df, CASE WHEN length(word) = length(term) AND damerau_levenshtein(word, term) = 1 THEN 1 ELSE levenshtein(word, term) END AS d FROM v, w
          WHERE term[1] = word[1] AND term <> word AND abs(length(word) - length(term)) <= 2 AND df > coalesce((SELECT max(df) FROM v u WHERE u.term = word), 0))
    SELECT word, term, df, d, row_number() OVER (PARTITION BY word ORDER BY df DESC, d, term) AS rank FROM x WHERE d <= 2 QUALIFY rank <= 3""",
)
def did_you_mean_vocab(spark: SparkSession, d: str) -> DataFrame:
    return bm25.suggestions(bm25.vocabulary(_doc_tokens(spark, d)), ["sensro", "polimer", "turbin", "to"])


@REG.add(
    "highlight_titles",
    rf"""WITH {S.LATEST} SELECT paper_key, regexp_replace(title, '(?i)\b(network|sensor)\b', '{T.OPEN}\1{T.CLOSE}', 'g') AS marked FROM latest
    WHERE regexp_matches(title, '(?i)\b(network|sensor)\b')""",
)
def highlight_titles(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "title").select("paper_key", T.highlight("title", ["sensor", "network"]).alias("marked")).where("marked IS NOT NULL")


@REG.add(
    "plural_folding",
    f"""WITH {S.LATEST}, t AS (SELECT unnest({S.toks('title')}) AS t FROM latest),
    f AS (SELECT CASE WHEN length(t) > 4 AND t LIKE '%ies' AND NOT regexp_matches(t, '[ae]ies$') THEN left(t, -3) || 'y'
      WHEN length(t) > 3 AND t LIKE '%es' AND NOT regexp_matches(t, '[aeo]es$') THEN left(t, -1)
      WHEN length(t) > 3 AND t LIKE '%s' AND NOT regexp_matches(t, '[us]s$') THEN left(t, -1) ELSE t END AS term FROM t)
    SELECT term, count(*) AS n FROM f GROUP BY term""",
)
def plural_folding(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "title").select(F.explode(T.terms("title")).alias("t")).select(T.fold_plural(F.col("t")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@REG.add("english_stems")
def english_stems(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "title").select(F.explode(T.english(T.terms("title"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@REG.add(
    "edge_ngram_prefix",
    f"""SELECT expert_id FROM faculty WHERE len(list_filter({S.toks("concat_ws(' ', firstname, lastname)")}, lambda t: length(t) >= 2 AND starts_with(t, 'ra'))) > 0""",
)
def edge_ngram_prefix(spark: SparkSession, d: str) -> DataFrame:
    names = T.terms(F.concat_ws(" ", "firstname", "lastname"))
    grams = F.flatten(F.transform(names, lambda t: T.edge_ngrams(t)))
    return table(spark, d, "faculty").where(F.array_contains(grams, "ra")).select("expert_id")


@REG.add(
    "title_shingles",
    f"""WITH {S.LATEST}, t AS (SELECT {S.toks('title')} AS ts FROM latest), s AS (SELECT ts[i] || ' ' || ts[i + 1] AS shingle FROM (SELECT ts, unnest(range(1, len(ts))) AS i FROM t))
    SELECT shingle, count(*) AS n FROM s GROUP BY shingle""",
)
def title_shingles(spark: SparkSession, d: str) -> DataFrame:
    return _papers(spark, d, "title").select(F.explode(T.shingles(T.terms("title"))).alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))


@REG.add("normalized_prefixes", r"SELECT facet, count(*) AS n FROM (SELECT trim(regexp_replace(lower(field_associated), '\s+', ' ', 'g')) AS facet FROM papers) GROUP BY facet")
def normalized_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "papers").select(clean("field_associated").alias("facet")).groupBy("facet").agg(F.count(F.lit(1)).alias("n"))


# --- vectors and fusion ---

_COS = "list_dot_product(embedding::double[], q.v::double[]) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q.v::double[], q.v::double[])))"
_KNN = f"knn AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings, (SELECT embedding AS v FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) q)"


def _anchor(spark: SparkSession, d: str) -> int:
    return table(spark, d, "embeddings").agg(F.min("vec_id")).first()[0]


@REG.add("knn_topk", f"WITH {_KNN} SELECT * FROM {S.top('knn', 20)}")
def knn_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ranking.knn(e, "vec_id", "embedding", ranking.vector_of(e, "vec_id", "embedding", _anchor(spark, d)), 20)


@REG.add("knn_prefilter", f"WITH {_KNN}, f AS (SELECT knn.* FROM knn JOIN embeddings ON vec_id = doc_id WHERE label = 3) SELECT * FROM {S.top('f', 10)}")
def knn_prefilter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return ranking.knn(e, "vec_id", "embedding", ranking.vector_of(e, "vec_id", "embedding", _anchor(spark, d)), 10, F.col("label") == 3)


@REG.add("similar_docs_excl_self", f"WITH {_KNN}, f AS (SELECT * FROM knn WHERE doc_id <> (SELECT min(vec_id) FROM embeddings)) SELECT * FROM {S.top('f', 10)}")
def similar_docs_excl_self(spark: SparkSession, d: str) -> DataFrame:
    return ranking.similar(table(spark, d, "embeddings"), "vec_id", "embedding", _anchor(spark, d), 10)


_RRF = f"""{_KNN}, {S.DOC_TOKENS}, {S.scored(Q)}, {S.matched(1)}, a AS (SELECT * FROM {S.top('m', 100)}), b AS (SELECT * FROM {S.top('knn', 100)})"""


@REG.add(
    "rrf_hybrid",
    f"""WITH {_RRF}, u AS (SELECT doc_id, round(sum(1.0::double / (60 + rank)), 6) AS score FROM (SELECT doc_id, rank FROM a UNION ALL SELECT doc_id, rank FROM b) GROUP BY doc_id)
    SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM u""",
)
def rrf_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.reciprocal_rank_fusion(list(_arms(spark, d)))


def _arms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return bm25.top_k(bm25.match(document_index(spark, d), Q), 100), ranking.knn(e, "vec_id", "embedding", ranking.vector_of(e, "vec_id", "embedding", _anchor(spark, d)), 100)


@REG.add(
    "field_ordered_hybrid",
    f"""WITH {_RRF}, u AS (SELECT doc_id, max(score) AS score FROM (SELECT doc_id, score FROM a UNION ALL SELECT doc_id, score FROM b) GROUP BY doc_id)
    SELECT row_number() OVER (ORDER BY publication_year DESC NULLS LAST, score DESC, doc_id) AS rank, doc_id, publication_year AS value, score
    FROM u JOIN documents USING (doc_id) ORDER BY rank LIMIT 20""",
)
def field_ordered_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return ranking.field_ordered(list(_arms(spark, d)), table(spark, d, "documents"), "doc_id", "publication_year", 20)


_PAPER_HITS = f"{S.PAPER_TOKENS}, {S.scored(Q, BOOST)}, {S.matched(1)}, hits AS (SELECT m.doc_id, m.score, l.* FROM m JOIN latest l ON l.paper_key = m.doc_id)"


def _hits(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return bm25.match(paper_index(spark, d), Q, 1, BOOST).join(_papers(spark, d, *cols).withColumnRenamed("paper_key", "doc_id"), "doc_id")


@REG.add(
    "impact_score",
    f"""WITH {_PAPER_HITS}, x AS (SELECT doc_id, score * (1.2::double * log10(1 + 0.3::double * coalesce(citation_count, 0))
      + 0.8::double * coalesce(exp(ln(0.5::double) * pow(abs(publication_year - {NOW}) / 5.0::double, 2)), 0)) AS score FROM hits)
    SELECT * FROM {S.top('(SELECT * FROM x WHERE score >= 0.3)', 20, 4)}""",
)
def impact_score(spark: SparkSession, d: str) -> DataFrame:
    h = _hits(spark, d, "citation_count", "publication_year")
    x = h.select("doc_id", ranking.impact_score(F.col("score"), F.col("citation_count"), F.col("publication_year"), NOW).alias("score"))
    return bm25.top_k(x.where("score >= 0.3"), 20, digits=4)


@REG.add(
    "minmax_fusion",
    f"""WITH {_PAPER_HITS}, w AS (SELECT t.rank, t.doc_id, t.score, title, abstract FROM {S.top('m', 50)} t JOIN latest ON paper_key = t.doc_id),
    r AS (SELECT *, len(list_intersect(list_distinct({S.toks("left(concat_ws(chr(10), title, abstract), 1200)")}), ['sensor', 'network'])) / 2.0::double AS rr FROM w),
    n AS (SELECT *, CASE WHEN max(rr) OVER () - min(rr) OVER () < 1e-9 THEN 0.5::double ELSE (rr - min(rr) OVER ()) / (max(rr) OVER () - min(rr) OVER ()) END AS nr,
      CASE WHEN max(score) OVER () - min(score) OVER () < 1e-9 THEN 0.5::double ELSE (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) END AS ns FROM r),
    f AS (SELECT doc_id, round(0.7::double * nr + 0.3::double * ns + CASE WHEN contains(lower(title), 'sensor network') THEN 0.3::double ELSE 0 END, 6) AS fused FROM n)
    SELECT row_number() OVER (ORDER BY fused DESC, doc_id) AS rank, doc_id, fused FROM f""",
)
def minmax_fusion(spark: SparkSession, d: str) -> DataFrame:
    window = bm25.top_k(bm25.match(paper_index(spark, d), Q, 1, BOOST), 50).drop("rank")
    p = _papers(spark, d, "title", "abstract").withColumnRenamed("paper_key", "doc_id")
    return ranking.rerank(window.join(p, "doc_id"), "sensor network").select("rank", "doc_id", "fused")


@REG.add(
    "rerank_page_straddle",
    f"""WITH {_PAPER_HITS}, raw AS (SELECT * FROM {S.top('m', 60)}), head AS (SELECT row_number() OVER (ORDER BY doc_id) AS rank, doc_id FROM raw WHERE rank <= 50)
    SELECT rank, doc_id FROM head WHERE rank > 40 UNION ALL SELECT rank, doc_id FROM raw WHERE rank > 50 AND rank <= 60""",
)
def rerank_page_straddle(spark: SparkSession, d: str) -> DataFrame:
    raw = bm25.top_k(bm25.match(paper_index(spark, d), Q, 1, BOOST), 60)
    head = raw.where("rank <= 50").select("doc_id", F.row_number().over(W.orderBy("doc_id")).alias("rank"))
    return ranking.rerank_page(head, raw, 50, 40, 20)


@REG.add(
    "deep_page_count",
    f"""WITH {S.DOC_TOKENS}, {S.scored(Q)}, {S.matched(1)}, t AS (SELECT count(*) AS total FROM m)
    SELECT total, 501 AS page, 20 AS per_page, least(ceil(total / 20.0), 500)::bigint AS total_pages, least(total, 50) AS ranked_window, 1 AS count_only FROM t""",
)
def deep_page_count(spark: SparkSession, d: str) -> DataFrame:
    total = bm25.match(document_index(spark, d), Q).count()
    p = ranking.pagination(total, 501, 20)
    return spark.range(1).select(*[F.lit(v).cast("long" if k in ("total", "total_pages", "ranked_window") else "int").alias(k) for k, v in p.items()])


@REG.add("hydrate_preserve_rank", f"WITH {_PAPER_HITS} SELECT t.rank, t.doc_id, title, publication_year FROM {S.top('m', 20)} t JOIN latest ON paper_key = t.doc_id")
def hydrate_preserve_rank(spark: SparkSession, d: str) -> DataFrame:
    from quarry.operators.identity import hydrate

    return hydrate(bm25.top_k(bm25.match(paper_index(spark, d), Q, 1, BOOST), 20), _papers(spark, d, "title", "publication_year"), "paper_key", "title", "publication_year")


# --- facets over the match set ---


def _register_facets() -> None:
    """Column expressions need a session, so they are built when the query runs."""
    kinds = {
        "facet_years_desc": ("publication_year", lambda: F.col("publication_year"), 30, True),
        "facet_document_types": (S.norm("document_type"), lambda: norm_key("document_type"), 15, False),
        "facet_fields": ("field_associated", lambda: F.col("field_associated"), 30, False),
        "facet_array_terms": (f"unnest(list_transform(subject_area, lambda x: {S.norm('x')}))", lambda: F.explode(F.transform("subject_area", norm_key)), 50, False),
    }
    for name, (value, expr, size, by_key) in kinds.items():
        order = "value DESC" if by_key else "count DESC, value"
        sql = f"""WITH {_PAPER_HITS}, c AS (SELECT {value} AS value FROM hits), g AS (SELECT value, count(*) AS count FROM c WHERE value IS NOT NULL GROUP BY value)
        SELECT row_number() OVER (ORDER BY {order}) AS rank, value, count FROM g ORDER BY rank LIMIT {size}"""

        def run(spark: SparkSession, d: str, expr=expr, size=size, by_key=by_key) -> DataFrame:
            return facets.terms_facet(_hits(spark, d, "publication_year", "document_type", "field_associated", "subject_area"), expr(), size, by_key)

        REG.add(name, sql)(run)


_register_facets()


@REG.add(
    "facet_year_ranges",
    f"""WITH {_PAPER_HITS} SELECT '2020+' AS range, count(*) FILTER (publication_year >= 2020) AS count FROM hits
    UNION ALL SELECT '2010-2019', count(*) FILTER (publication_year >= 2010 AND publication_year < 2020) FROM hits
    UNION ALL SELECT '2000-2009', count(*) FILTER (publication_year >= 2000 AND publication_year < 2010) FROM hits
    UNION ALL SELECT 'before 2000', count(*) FILTER (publication_year < 2000) FROM hits""",
)
def facet_year_ranges(spark: SparkSession, d: str) -> DataFrame:
    return facets.year_ranges(_hits(spark, d, "publication_year"), "publication_year")


@REG.add(
    "two_tier_documents",
    f"""WITH {S.DOC_TOKENS}, t1 AS (SELECT doc_id FROM tokens WHERE contains(' ' || array_to_string(ts, ' ') || ' ', ' sensor network energy ')),
    t2 AS (SELECT doc_id FROM tokens WHERE list_contains(ts, 'sensor') AND list_contains(ts, 'network') AND list_contains(ts, 'energy'))
    SELECT doc_id, 'phrase' AS match_tier FROM t1 UNION ALL SELECT doc_id, 'terms' FROM t2 WHERE NOT EXISTS (SELECT 1 FROM t1)""",
)
def two_tier_documents(spark: SparkSession, d: str) -> DataFrame:
    found, tier = bm25.two_tier(_doc_tokens(spark, d), Q)
    return found.withColumn("match_tier", F.lit(tier))
