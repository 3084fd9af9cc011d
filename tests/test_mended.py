"""Cases in which an earlier version gave wrong answers."""

import pytest
from pyspark.sql import functions as F

from quarry import browse, suggest
from quarry.functions import text as T
from quarry.operators import bm25, filters, ranking, taxonomy
from quarry.search import PaperSearch

PAPERS = "paper_key string, title string, abstract string, field_associated string, subject_area array<string>, authors array<struct<author_id:string,author_position:string,author_name:string,author_available_names:array<string>>>, kerberos string, publication_year int, citation_count int, document_type string, open_search_id string"


def papers(spark):
    def row(key, title, abstract=None, field=None, areas=None, authors=(), kerberos=None):
        return (key, title, abstract, field, areas, [(i, str(n + 1), name, [name]) for n, (i, name) in enumerate(authors)], kerberos, 2020, 3, "article", None)

    rows = [
        row("p1", "A color and colour study"), row("p2", "Colour of a sensor"), row("p3", "Émile café naïve σύστημα"), row("p4", "Soil", field="Soil Mechanics", areas=["Water Studies"], authors=[("11", "Zoe Ulanbel"), ("99", "Tara Pruavi")]),
        row("p5", "Nothing", authors=[("98", "Zoe Pruavi")], kerberos="kx1"), row("p6", None),
    ]
    return spark.createDataFrame(rows, PAPERS)


def faculty(spark):
    return spark.createDataFrame([("e1", "Zoe", "Ulanbel", "zulan1@x", ["11"], 4, 10, None), ("e2", "Kim", "Xander", "kx1@x", None, None, None, None)], "expert_id string, firstname string, lastname string, email string, scopus_id array<string>, h_index int, citation_count int, title string")


def ids(df):
    return sorted(r["doc_id"] for r in df.collect())


def test_a_word_and_its_variant_are_one_term(spark):
    s = PaperSearch(papers(spark), faculty(spark))
    assert ids(s.search("color sensor", mode="basic").hits) == ["p2"] and ids(s.search("color", mode="basic").hits) == ["p1", "p2"]


@pytest.mark.parametrize("a,b", T.SPELLINGS)
def test_every_pair_works_both_ways(a, b):
    assert T.spelling_variant(a) == b and T.spelling_variant(b) == a and len(T.SPELLINGS) == 43


def test_chosen_fields(spark):
    s = PaperSearch(papers(spark), faculty(spark))
    found = lambda q, *f: ids(s.search(q, mode="basic", search_in=list(f)).hits)
    assert found("mechanics", "field") == ["p4"] and found("water", "subject") == ["p4"] and found("water", "subject_area") == ["p4"] and found("mechanics", "title") == []
    assert found("soil water", "title", "subject") == ["p4"] and ids(s.search("soil nothing", mode="basic", search_in=["title", "subject"]).hits) == []
    # a name that resolves to staff means their papers, by author id or kerberos
    assert found("Zoe Ulanbel", "author") == ["p4"] and found("Xander", "author") == ["p5"]
    # else the words must be in one listed author's names; authors off the roster don't count
    assert found("ulanbel z", "author") == [] and found("pruavi tara", "author") == []
    assert ids(s.author_scoped("99", "pruavi tara", search_in=["author"]).hits) == ["p4"]
    assert ids(s.search("zoe soil", search_in=["author", "title"]).hits) == ["p4"]


def test_letters_of_any_script_stay_whole(spark):
    got = papers(spark).where("paper_key = 'p3'").select(T.terms("title").alias("t")).first()["t"]
    assert got == ["émile", "café", "naïve", "σύστημα"] and T.query_terms("Émile's café") == ["émile", "s", "café"]
    assert ids(PaperSearch(papers(spark)).search("café σύστημα", mode="basic").hits) == ["p3"]


def test_a_swap_is_one_edit(spark):
    df = spark.createDataFrame([("siol",), ("solo",), ("coil",), ("x",), (None,)], "f string")
    assert sorted(r["f"] for r in df.where(filters.fuzzy_any("f", ["soil"])).collect()) == ["coil", "siol"]


def test_slugs_are_unique(spark):
    rows = [(1, "A"), (2, "A"), (3, "A-2"), (4, "A"), (5, "B & C"), (6, None), (7, "a 2"), (8, "A3"), (9, "")]
    got = {r["k"]: r["slug"] for r in taxonomy.unique_slugs(spark.createDataFrame(rows, "k int, n string"), "k", "n").collect()}
    assert got == {1: "a", 2: "a-2", 3: "a-2-2", 4: "a-3", 5: "b-and-c", 6: None, 7: "a-2-3", 8: "a3", 9: ""}
    assert taxonomy.unique_slugs(spark.createDataFrame([], "k int, n string"), "k", "n").count() == 0


def test_a_scorer_that_fails_in_a_task_leaves_the_first_order(spark):
    w = spark.createDataFrame([("a", "t", "x", 2.0), ("b", "u", "y", 3.0)], "doc_id string, title string, abstract string, score double")
    broken = lambda text: F.raise_error(F.concat(F.lit("no "), text)).cast("double")
    assert [r["doc_id"] for r in ranking.rerank(w, "q", broken).orderBy("rank").collect()] == ["b", "a"]


def test_vectors_and_reranking_together(spark):
    v = spark.createDataFrame([("p1", [1.0, 0.0]), ("p2", [0.0, 1.0]), ("p5", [0.1, 1.0])], "paper_key string, embedding array<double>")
    s = PaperSearch(papers(spark), faculty(spark), vectors=v)
    assert ids(s.search("color", query_vector=[0.0, 1.0]).hits) == ids(s.search("color", query_vector=[0.0, 1.0], rerank=True).hits) == ["p1", "p2", "p5"]
    assert s.search("colour of a sensor", query_vector=[1.0, 0.0], rerank=True).hits.orderBy("rank").first()["doc_id"] == "p2"
    assert ids(s.search("color", query_vector=[0.0, 1.0], search_in=["title"]).hits) == ["p1", "p2"]
    assert ids(s.similar("p2")) == ["p1", "p5"] and s.similar("p9").count() == 0


def test_typeahead(spark):
    s = suggest.suggest(papers(spark), faculty(spark), " zoe  ul")
    assert [r["expert_id"] for r in s.authors.collect()] == ["e1"] and s.intent == "author"
    t = suggest.suggest(papers(spark), faculty(spark), "colour of")
    assert t.papers.first()["paper_key"] in ("p1", "p2") and t.intent == "paper" and t.authors.count() == 0
    for short in (None, "", "z"):
        assert suggest.suggest(papers(spark), faculty(spark), short).papers.count() == 0
    assert ranking.suggest_intent("x", set(), 0, 0, 0, 0) == ("mixed", 0.0)


def test_browsing_by_slug(spark):
    c = "struct<thematic_area_id:string,domain_id:string,subdomain_id:string,topics:array<string>>"
    a = "array<struct<kerberos:string,faculty_ref:string,department_ref:string>>"
    rows = [("p1", ("t1", "d1", "s1", None), [("k1", "f1", "m1")]), ("p2", ("t1", "d1", None, None), [("k1", "f1", "m1"), ("k2", "f2", "m2")]), ("p3", ("t1", "d2", None, None), None), ("p4", None, None)]
    node = lambda key, *r: spark.createDataFrame(list(r), f"{key} string, slug string, node_name string, display_order int")
    subs = spark.createDataFrame([("s1", "sub", "Sub", 1, "D1 ")], "subdomain_id string, slug string, node_name string, display_order int, domain_id string")
    deps = spark.createDataFrame([("m1", "AA", "Alpha"), ("m2", "BB", "Beta"), ("m3", "CC", None)], "department_id string, department_code string, department_name string")
    b = browse.TaxonomyBrowser(spark.createDataFrame(rows, f"paper_key string, classification {c}, iitd_authors {a}"), node("thematic_area_id", ("t1", "theme", "T", 1)), node("domain_id", ("d1", "one", "One", 2), ("d2", "two", "Two", 1), ("d3", "three", "Three", 3)), subs, deps)
    assert [(r["slug"], r["paper_count"], r["subdomain_count"]) for r in b.domains().orderBy("rank").collect()] == [("two", 1, 0), ("one", 2, 1)]
    assert [r["slug"] for r in b.domains(department="bb").collect()] == ["one"] and [r["slug"] for r in b.subdomains("one").collect()] == ["sub"]
    assert b.resolve(subdomain="sub") == browse.Config(None, "d1", "s1", None)
    with pytest.raises(browse.BadRequest):
        b.resolve(domain="two", subdomain="sub")
    with pytest.raises(browse.NotFound):
        b.resolve(theme="none")
    assert b.counts(domain="one") == {"paper_count": 2, "faculty_count": 2} and b.counts(theme="theme", subdomain="sub", department="bb") == {"paper_count": 0, "faculty_count": 0}
    hits, meta = b.faculty(domain="one", per_page=1)
    assert [r["kerberos"] for r in hits.collect()] == ["k1"] and meta["faculty_total"] == 2 and meta["total_pages"] == 2
    assert [r["paper_key"] for r in b.papers_of(" K1 ", domain="one").collect()] == ["p1", "p2"] and [r["code"] for r in b.departments().collect()] == ["aa", "bb"]
    with pytest.raises(browse.BadRequest):
        b.papers_of(" ")


def test_no_words_with_variants(spark):
    t = bm25.analysed(papers(spark), "paper_key", {"t": "title"})
    assert bm25.match(t, [], variants={"a": "b"}).count() == 0


def test_a_stored_index_gives_what_the_texts_give(spark, tmp_path):
    t = bm25.analysed(papers(spark), "paper_key", {"title": "title", "field": "field_associated"})
    index = bm25.write_index(t, str(tmp_path / "i"))
    for words, need, variants in ((["color", "sensor"], 1, {"colour": "color"}), (["soil", "mechanics"], 2, None), (["nothing", "absent"], 1, None), ([], 1, None)):
        rows = lambda x: sorted((r["doc_id"], round(r["score"], 9)) for r in bm25.match(x, words, need, {"title": 4.0}, variants=variants).collect())  # noqa: B023, E731
        assert rows(index) == rows(t) == rows(bm25.open_index(spark, str(tmp_path / "i")))
    empty = bm25.write_index(t.limit(0), str(tmp_path / "e"))
    assert bm25.match(empty, ["soil"]).count() == 0
