import pytest

from quarry import jobs
from quarry.sources.files import CLASSIFICATION_COLUMNS

C = "struct<thematic_area_id:string,domain_id:string,subdomain_id:string,topics:array<string>>"
A = "array<struct<kerberos:string,faculty_ref:string,department_ref:string>>"


def write(path, *rows):
    lines = [",".join(CLASSIFICATION_COLUMNS)] + [",".join(str(r.get(c, "")) for c in CLASSIFICATION_COLUMNS) for r in rows]
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def row(key, sub="S", score=1, sure="HIGH", domain="D"):
    return {"Title": "t", "MongoDB_ID": key, "Broad_Theme": "T & U", "Domain": domain, "Sub_Domain": sub, "L3_Score": score, "L3_Confidence": sure, "Topic": "x"}


def test_ingest(spark, tmp_path):
    csv = write(tmp_path / "c.csv", row("P1", "S a", 0.2), row("p1", "S-a", 0.9), row("p1", "low", 9, "LOW"), row("p9"), row(""), row("p2", "S", "bad"))
    papers = spark.createDataFrame([("p1",), ("p2",), ("p3",)], "paper_key string")
    dry = jobs.ingest(spark, csv, papers, str(tmp_path / "out"), dry_run=True)
    assert dry.counts == {"rows": 6, "without_id": 1, "matched": 2, "unmatched": 1, "duplicate_groups": 1, "largest_group": 3} and dry.examples == {"unmatched": ["p9"]}
    assert not (tmp_path / "out").exists()
    for _ in range(2):  # a rerun replaces
        jobs.ingest(spark, csv, papers, str(tmp_path / "out"))
    assert sorted((r["paper_key"], r["subdomain"]) for r in spark.read.parquet(str(tmp_path / "out/classified")).collect()) == [("p1", "S-a"), ("p2", "S")]
    assert sorted(r["slug"] for r in spark.read.parquet(str(tmp_path / "out/subdomains")).collect()) == ["low", "s", "s-a", "s-a-2"]
    with pytest.raises(ValueError, match="several"):
        jobs.ingest(spark, write(tmp_path / "d.csv", row("p1"), row("p2", domain="E")), papers, str(tmp_path / "no"))


def test_rollup_and_faculty_domains(spark, tmp_path):
    rows = [("p1", ("t1", "d1", "s1", None), [("k1", "f1", "m1")]), ("p2", ("t1", "d1", None, None), [("k1", "f1", "m1"), ("k2", "f2", "m2")]), ("p3", None, None)]
    papers = spark.createDataFrame(rows, f"paper_key string, classification {C}, iitd_authors {A}")
    dry = jobs.rollup(papers, str(tmp_path / "r"), 7, dry_run=True)
    done = jobs.rollup(papers, str(tmp_path / "r"), 7)
    assert dry.counts == done.counts and done.counts["largest"] == 2
    stats = {(r["level"], r["node_id"]): (r["paper_count"], r["faculty_count"]) for r in spark.read.parquet(str(tmp_path / "r/node_stats")).collect()}
    assert stats == {("thematic_area_id", "t1"): (2, 2), ("domain_id", "d1"): (2, 2), ("subdomain_id", "s1"): (1, 1)}
    domains = spark.createDataFrame([("D1", "One")], "domain_id string, node_name string")
    out = jobs.faculty_domains(papers, domains, str(tmp_path / "f"))
    assert out.counts == {"members": 2, "links": 2} and jobs.rollup(papers.limit(0), str(tmp_path / "e"), 1).counts["rows"] == 0
