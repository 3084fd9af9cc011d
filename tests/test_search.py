import random

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import bm25, evaluation, filters, ranking, taxonomy


def test_terms_and_thresholds():
    assert T.query_terms("The  Solar battery, solar") == ["solar", "battery"]
    assert T.query_terms("to be") == ["to", "be"]
    assert [T.required_matches(n) for n in (1, 3, 4, 6, 10)] == [1, 3, 3, 5, 8]
    assert T.required_matches(6, strict=True) == 6


@pytest.mark.parametrize("a,b", [("color", "colour"), ("colorful", "colourful"), ("colour", "color"), ("neighborhood", "neighbourhood"), ("solar", None)])
def test_spelling_variants(a, b):
    assert T.spelling_variant(a) == b


@pytest.mark.parametrize("w,s", [("communication", "commun"), ("community", "commun"), ("batteries", "batteri"), ("caresses", "caress"), ("hopping", "hop"), ("relational", "relat"), ("sky", "sky"), ("feed", "feed"), ("generalization", "gener")])
def test_porter(w, s):
    assert T.porter_stem(w) == s


def test_text_expressions(spark):
    df = spark.createDataFrame([("Batteries, roots & buses",), (None,), ("",)], "t string")
    rows = df.select(T.terms("t").alias("ts"), F.transform(T.terms("t"), T.fold_plural).alias("p"), T.slugify("t").alias("s"), T.highlight("t", ["roots"]).alias("h"), T.shingles(T.terms("t")).alias("n"), T.english(T.terms("t")).alias("e")).collect()
    assert rows[0]["ts"] == ["batteries", "roots", "buses"] and rows[0]["p"] == ["battery", "root", "buse"]
    assert rows[0]["s"] == "batteries-roots-and-buses" and rows[0]["h"] == f"Batteries, {T.OPEN}roots{T.CLOSE} & buses"
    assert rows[0]["n"] == ["batteries roots", "roots buses"] and rows[0]["e"] == ["batteri", "root", "buse"]
    assert rows[1]["ts"] == [] and rows[2]["ts"] == [] and rows[1]["h"] is None and rows[1]["e"] == []


def tokens(spark, *texts):
    return bm25.analysed(spark.createDataFrame(list(enumerate(texts)), "id long, t string"), "id", {"t": "t"})


def test_phrases(spark):
    t = tokens(spark, "sensor network", "network sensor", "sensor a network", "sensor a b c network", None, "")
    at = lambda slop: sorted(r["doc_id"] for r in t.where(bm25.phrase_at(F.col("ts"), ["sensor", "network"], slop)).collect())
    assert at(0) == [0] and at(2) == [0, 2] and at(4) == [0, 2, 3]
    assert [r["doc_id"] for r in t.where(bm25.phrase_prefix_at(F.col("ts"), ["sensor", "net"])).collect()] == [0]


def test_refining_only_narrows(spark):
    rnd = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta"]
    t = tokens(spark, *[" ".join(rnd.choices(words, k=3)) for _ in range(60)])
    ids = lambda ws: {r["doc_id"] for r in bm25.match(t, ws, len(ws)).collect()}
    assert ids(["alpha", "beta"]) == ids(["beta", "alpha"]) == ids(["alpha"]) & ids(["beta"])
    assert ids(["nothing"]) == set()


def test_no_words_match_nothing(spark):
    t = tokens(spark, "a b", None)
    assert bm25.match(t, []).count() == 0 and bm25.suggestions(bm25.vocabulary(t), ["to"]).count() == 0 and bm25.fuzzy_terms(bm25.vocabulary(t), []).count() == 0


def test_fuzzy_counts_a_swap_once(spark):
    vocab = spark.createDataFrame([("grapehne", 1), ("graphene", 9), ("grape", 3)], "term string, df long")
    got = {r["term"]: r["d"] for r in bm25.fuzzy_terms(vocab, ["graphene"]).collect()}
    assert got == {"graphene": 0, "grapehne": 1}


def test_filters_ignore_unknown_and_unset(spark):
    df = spark.createDataFrame([("1", 2010, "Article", None), ("2", None, None, ["a", "b", "c"])], "paper_key string, publication_year int, document_type string, subject_area array<string>")
    ids = lambda f: [r["paper_key"] for r in df.where(filters.paper_filter(f)).collect()]
    assert ids({}) == ["1", "2"] and ids({"what": 1, "year_from": 0}) == ["1", "2"]
    assert ids({"year_from": 2010, "year_to": 2010}) == ["1"] and ids({"interdisciplinary": True}) == ["2"]
    assert filters.normalize_search_in(["title", "nope", "title", "abstract"]) == ["abstract", "title"] and filters.normalize_search_in([]) is None


def test_rerank_prefers_scores_and_pins_titles(spark):
    w = spark.createDataFrame([(1, "plain", "solar cell text", 9.0), (2, "solar cell", None, 1.0), (3, "other", "other", 12.0)], "doc_id long, title string, abstract string, score double")
    assert [r["doc_id"] for r in ranking.rerank(w, "solar cell").orderBy("rank").collect()] == [2, 1, 3]

    def broken(_):
        raise RuntimeError

    assert [r["doc_id"] for r in ranking.rerank(w, "solar cell", broken).orderBy("rank").collect()] == [3, 1, 2]


def test_knn_leaves_out_zero_and_short_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, [1.0, 1.0]), (5, None), (6, [2.0, 0.0])], "id long, v array<double>")
    assert [(r["rank"], r["doc_id"]) for r in ranking.knn(v, "id", "v", [1.0, 0.0], 5).orderBy("rank").collect()] == [(1, 1), (2, 6), (3, 4)]


def test_pages():
    assert ranking.pagination(95, 1, 20)["total_pages"] == 5
    assert ranking.pagination(10**6, 501, 20) == {"total": 10**6, "page": 501, "per_page": 20, "total_pages": 500, "ranked_window": 50, "count_only": 1}


def test_suggest_intent():
    assert ranking.suggest_intent("nisha pal", {"nisha", "palardavescu"}, 3, 1, 9.0, 1.0)[0] == "author"
    assert ranking.suggest_intent("energy density of solar cells", {"nisha"}, 0, 5, 0.0, 9.0)[0] == "paper"


@pytest.mark.parametrize("counts,want", [([3, 2], 2), ([9, 5, 3, 2, 1], 5), ([100] + [1] * 30, 18), ([5] * 200, 18), ([9, 8, 7, 6, 5, 4, 3, 2, 1], 6), ([1000 - i for i in range(100)], 12)])
def test_recommended_count(spark, counts, want):
    df = spark.createDataFrame([("c", f"k{i:03}", n, i + 1) for i, n in enumerate(counts)], "cell string, kerberos string, papers long, rank int")
    assert taxonomy.recommended_count(df, ["cell"]).first()["recommended"] == want


def test_metrics(spark):
    run = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "c", 3), ("none", "a", 1)], "query_id string, doc_id string, rank int")
    judged = spark.createDataFrame([("q", "b", 3), ("q", "z", 1)], "query_id string, doc_id string, grade int")
    got = {r["query_id"]: r for r in evaluation.metrics(run, judged).collect()}
    assert (got["q"]["recall"], got["q"]["precision"], got["q"]["mrr"]) == (0.5, 0.1, 0.5)
    assert got["none"]["recall"] is None and got["none"]["mrr"] == 0.0 and got["none"]["ndcg"] == 0.0


def test_two_tiers(spark):
    t = tokens(spark, "sensor network", "network of a sensor", None)
    assert [tuple(r) for r in bm25.two_tier(t, ["sensor", "network"])[0].collect()] == [(0,)]
    found, tier = bm25.two_tier(t, ["network", "a"])
    assert tier == "terms" and [r[0] for r in found.collect()] == [1]
    assert bm25.two_tier(t, [])[0].count() == 0


def test_author_query(spark):
    from quarry.operators.identity import author_query

    f = spark.createDataFrame([("e1", "Ana ", "Bel"), ("e2", "Ana", "Cruz"), ("e3", None, None), ("e4", "Eva Maria", "De La Cruz")], "expert_id string, firstname string, lastname string")
    ids = lambda q: [r[0] for r in author_query(f, q).collect()]
    assert ids("ana bel") == ["e1"] and ids("X Cruz") == ["e2"] and ids("ANA") == ["e1", "e2"] and ids("nobody") == [] and ids("") == []
    assert ids("eva maria de la cruz") == ["e2"]
