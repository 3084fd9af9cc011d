import os

import pytest

from quarry.search import PaperSearch, refine_terms
from quarry.sources import files
from quarry.sources.tables import latest_papers, table

SF = "/root/testdata/sf0.001"


def test_refine_terms():
    assert refine_terms(["solar", " battery ", "", "Solar", "lithium"]) == ["solar", "battery", "lithium"]
    assert refine_terms("one") == ["one"] and refine_terms(None) == []


def test_classification_files(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("Title,MongoDB_ID,Domain,Sub_Domain\n A , 1 ,d1,s\n\nB,2,d2,s\n")
    rows = files.read_classification_csv(spark, str(p), ("Title", "MongoDB_ID"))
    assert [(r["Title"], r["MongoDB_ID"]) for r in rows.orderBy("row_id").collect()] == [("A", "1"), ("B", "2")]
    with pytest.raises(ValueError, match="several"):
        files.assert_one_parent(rows)
    with pytest.raises(ValueError, match="missing"):
        files.read_classification_csv(spark, str(p))
    assert files.write_keyed(rows, str(tmp_path / "out"), "Title", dry_run=True).count() == 2 and not (tmp_path / "out").exists()
    files.write_keyed(rows.union(rows), str(tmp_path / "out"), "Title")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_search_narrows_pages_and_falls_back(spark):
    cols = ["title", "abstract", "publication_year", "citation_count", "document_type", "field_associated", "subject_area", "authors", "kerberos", "open_search_id"]
    s = PaperSearch(latest_papers(table(spark, SF, "papers"), *cols).cache(), table(spark, SF, "faculty"), table(spark, SF, "departments"))
    all_ = s.search("sensor", mode="basic", per_page=100)
    ids = lambda p: [r["doc_id"] for r in p.hits.collect()]
    assert set(ids(s.search("sensor", mode="basic", refine_chain=["network"], per_page=100))) <= set(ids(all_))
    two = ids(s.search("sensor", mode="basic", page=1, per_page=2)) + ids(s.search("sensor", mode="basic", page=2, per_page=2))
    assert two == ids(all_)[:4] and len(set(two)) == len(two)
    assert s.search("zzzzqqqq").pagination["total"] == 0
    fuzzy = s.search("sensro")
    assert fuzzy.pagination["total"] > 0 and fuzzy.suggestions.count() > 0
    for sort in ("date", "citations", "impact"):
        assert s.search("sensor", sort=sort).hits.count() > 0
    assert s.search("sensor", rerank=True).hits.count() > 0 and s.people("sensor").count() > 0
    assert sum(r["count"] for r in all_.facets["year_ranges"].collect()) <= all_.pagination["total"]
    author = s.papers.selectExpr("explode(authors) a").selectExpr("trim(a.author_id) id").first()["id"]
    assert s.author_scoped(author, "the").pagination["total"] <= s.documents_by_author(author, per_page=1000).count()
    assert s.collaborators(author).count() >= 0 and s.document(s.papers.first()["paper_key"]).count() == 1
