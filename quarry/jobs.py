"""Batch jobs: source, operator and sink wired together, each with a report and a dry run that writes nothing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.operators import taxonomy
from quarry.sources import files

# How sure a row of a classification file may be, best first.
CONFIDENCE = ("HIGH", "MEDIUM", "LOW")


@dataclass
class Report:
    """Counts of a job and a few examples of what it could not place."""

    counts: dict[str, int]
    examples: dict[str, list] = field(default_factory=dict)
    tables: dict[str, DataFrame] = field(default_factory=dict)


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} AS double)")


def ingest(spark: SparkSession, csv: str, papers: DataFrame, out: str, dry_run: bool = False) -> Report:
    """Classification file to nodes and classified papers under ``out``.

    Every subdomain has one domain, else an error. Of several rows of a paper the surest counts, then the best score, then the first.
    Rows whose paper is unknown are counted and some are named. Nodes are keyed by name, with unique slugs; ``papers``: ``paper_key``.
    """
    rows = files.read_classification_csv(spark, csv)
    files.assert_one_parent(rows)
    rows = rows.withColumn("paper_key", norm_key("MongoDB_ID"))
    sure = F.lit(0)
    for n, c in enumerate(reversed(CONFIDENCE), 1):
        sure = F.when(F.upper(F.trim("L3_Confidence")) == c, n).otherwise(sure)
    keyed = rows.where("paper_key IS NOT NULL")
    best = taxonomy.winner_rows(keyed, "paper_key", sure, _number("L3_Score"), F.col("row_id"))
    known = papers.select("paper_key").distinct()
    matched, lost = best.join(known, "paper_key", "left_semi"), best.join(known, "paper_key", "left_anti")
    tables = {"classified": matched.select("paper_key", F.col("Broad_Theme").alias("theme"), F.col("Domain").alias("domain"), F.col("Sub_Domain").alias("subdomain"), F.col("Topic").alias("topic"))}
    for name, column in (("themes", "Broad_Theme"), ("domains", "Domain"), ("subdomains", "Sub_Domain")):
        nodes = keyed.select(F.col(column).alias("node_name")).where("node_name IS NOT NULL AND node_name <> ''").distinct()
        tables[name] = nodes.join(taxonomy.unique_slugs(nodes, "node_name", "node_name"), "node_name")
    for name, df in tables.items():
        files.write_keyed(df, f"{out}/{name}", df.columns[0], dry_run)
    many = keyed.groupBy("paper_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("groups"), F.max("n").alias("most")).first()
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count("paper_key").alias("keyed")).first()
    counts = {"rows": n["rows"], "without_id": n["rows"] - n["keyed"], "matched": matched.count(), "unmatched": lost.count(), "duplicate_groups": many["groups"], "largest_group": many["most"] or 0}
    return Report(counts, {"unmatched": [r["paper_key"] for r in lost.select("paper_key").orderBy("paper_key").limit(5).collect()]}, tables)


def rollup(papers: DataFrame, out: str, run: int, dry_run: bool = False) -> Report:
    """The facet cube of classified papers and the counts of every node, rebuilt in full under ``out``. ``run`` marks the rows."""
    cube = taxonomy.facet_cube(taxonomy.classified(papers)).withColumn("rollup_run", F.lit(run).cast("long"))
    levels = [*taxonomy.LEVELS, "department_id"]
    alone = lambda c: F.col(c).isNotNull() & ~F.coalesce(*[F.when(F.col(x).isNotNull(), True) for x in levels if x != c], F.lit(False))
    parts = [cube.where(alone(c)).select(F.lit(c).alias("level"), F.col(c).alias("node_id"), "paper_count", "faculty_count") for c in taxonomy.LEVELS[:2]]
    inner = cube.where("subdomain_id IS NOT NULL AND domain_id IS NOT NULL AND thematic_area_id IS NULL AND department_id IS NULL")
    stats = parts[0].unionByName(parts[1]).unionByName(inner.select(F.lit("subdomain_id").alias("level"), F.col("subdomain_id").alias("node_id"), "paper_count", "faculty_count"))
    cube = files.write_table(cube, f"{out}/facet_counts", ("domain_id", "subdomain_id"), dry_run)
    stats = files.write_table(stats, f"{out}/node_stats", ("level", "node_id"), dry_run)
    n = cube.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.max("paper_count"), F.lit(0)).alias("largest")).first()
    return Report({"rows": n["rows"], "largest": n["largest"], "nodes": stats.count()}, tables={"facet_counts": cube, "node_stats": stats})


def faculty_domains(papers: DataFrame, domains: DataFrame, out: str, coverage: float = 0.8, dry_run: bool = False) -> Report:
    """Each member's domains until ``coverage`` of the papers is reached, as one row a member: ``kerberos, domains``."""
    top = taxonomy.dominant_domains(taxonomy.classified(papers), domains, coverage)
    rows = top.groupBy("kerberos").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "domain_id"))), lambda x: x["domain_id"]).alias("domains"))
    rows = files.write_keyed(rows, f"{out}/faculty_domains", "kerberos", dry_run)
    n = rows.agg(F.count(F.lit(1)).alias("members"), F.coalesce(F.sum(F.size("domains")), F.lit(0)).alias("links")).first()
    return Report({"members": n["members"], "links": n["links"]}, tables={"faculty_domains": rows})
