"""Entry points of the classification: nodes by slug, counts, members and papers of a configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.functions.normal import norm_key
from quarry.operators import taxonomy

PER_PAGE, MOST_PER_PAGE = 20, 100


class NotFound(LookupError):
    """No node of that slug or code."""


class BadRequest(ValueError):
    """Identifiers that contradict each other."""


@dataclass(frozen=True)
class Config:
    """Ids of a browse configuration; ``None`` where a level is not part of it."""

    thematic_area_id: str | None = None
    domain_id: str | None = None
    subdomain_id: str | None = None
    department_id: str | None = None


class TaxonomyBrowser:
    """Browsing over classified papers (``paper_key, iitd_authors, classification``) and the four catalogs.

    The cube and its members are computed once per browser and written where they are first asked for.
    Catalogs are looked up by slug or code, compared trimmed and in lower case; of several nodes of one slug the least id counts.
    """

    def __init__(self, papers: DataFrame, themes: DataFrame, domains: DataFrame, subdomains: DataFrame, departments: DataFrame) -> None:
        self.papers, self.rows = papers, taxonomy.classified(papers)
        self.nodes = {
            "theme": self._node(themes, "thematic_area_id"), "domain": self._node(domains, "domain_id"), "subdomain": self._node(subdomains, "subdomain_id", norm_key("domain_id").alias("parent")),
            "department": departments.select(norm_key("department_id").alias("id"), norm_key("department_code").alias("slug"), F.col("department_name").alias("name"), F.lit(0).alias("display_order")),
        }
        self.cube = taxonomy.facet_cube(self.rows)

    @staticmethod
    def _node(d: DataFrame, key: str, *more) -> DataFrame:
        return d.select(norm_key(key).alias("id"), norm_key("slug").alias("slug"), F.col("node_name").alias("name"), "display_order", *more)

    def _find(self, kind: str, wanted: str | None):
        if not wanted:
            return None
        row = self.nodes[kind].where(F.col("slug") == wanted.strip().lower()).orderBy("id").first()
        if row is None:
            raise NotFound(f"{kind} {wanted}")
        return row

    def resolve(self, theme: str | None = None, domain: str | None = None, subdomain: str | None = None, department: str | None = None) -> Config:
        """Slugs and code to ids. A subdomain implies its domain and must lie in one given explicitly."""
        t, d, s, p = self._find("theme", theme), self._find("domain", domain), self._find("subdomain", subdomain), self._find("department", department)
        if s is not None and d is not None and s["parent"] != d["id"]:
            raise BadRequest(f"subdomain {subdomain} is not part of domain {domain}")
        return Config(t and t["id"], d["id"] if d else s and s["parent"], s and s["id"], p and p["id"])

    def _cells(self, c: Config, *free: str) -> DataFrame:
        """Cube rows of the configuration; levels in ``free`` are open, all others of the configuration pinned, null where it has none."""
        x = self.cube
        for level in (*taxonomy.LEVELS, "department_id"):
            value = getattr(c, level)
            x = x.where(F.col(level).isNotNull() if level in free else F.col(level).isNull() if value is None else F.col(level) == value)
        return x

    def _listing(self, kind: str, level: str, c: Config) -> DataFrame:
        counts = self._cells(c, level).select(F.col(level).alias("id"), "paper_count", "faculty_count")
        x = self.nodes[kind].join(counts, "id")
        return x.withColumn("rank", F.row_number().over(W.orderBy("display_order", "id"))).select("rank", "slug", "name", "paper_count", "faculty_count")

    def themes(self, department: str | None = None) -> DataFrame:
        """Themes with papers and their counts, in display order."""
        return self._listing("theme", "thematic_area_id", self.resolve(department=department))

    def domains(self, theme: str | None = None, department: str | None = None) -> DataFrame:
        """Domains with papers, their counts and the number of subdomains with papers of the whole catalog."""
        c = self.resolve(theme=theme, department=department)
        subs = self._cells(Config(), "domain_id", "subdomain_id").groupBy(F.col("domain_id").alias("id")).agg(F.count(F.lit(1)).alias("subdomain_count"))
        x = self._listing("domain", "domain_id", c)
        named = self.nodes["domain"].join(subs, "id").select("slug", "subdomain_count")
        return x.join(named, "slug", "left").withColumn("subdomain_count", F.coalesce("subdomain_count", F.lit(0)))

    def subdomains(self, domain: str, theme: str | None = None, department: str | None = None) -> DataFrame:
        c = self.resolve(theme=theme, domain=domain, department=department)
        if c.domain_id is None:
            raise NotFound(f"domain {domain}")
        return self._listing("subdomain", "subdomain_id", c)

    def departments(self) -> DataFrame:
        """Departments with classified papers, by name."""
        seen = self.rows.select(F.col("department_id").alias("id")).where("id IS NOT NULL").distinct()
        return self.nodes["department"].join(seen, "id", "left_semi").select("id", "name", F.col("slug").alias("code")).orderBy("name", "id")

    def counts(self, **config: str | None) -> dict[str, int]:
        """Papers and faculty of a configuration; zero where the cube has no such row."""
        row = self._cells(self.resolve(**config)).select("paper_count", "faculty_count").first()
        return {"paper_count": row[0] if row else 0, "faculty_count": row[1] if row else 0}

    def faculty(self, page: int = 1, per_page: int = PER_PAGE, **config: str | None) -> tuple[DataFrame, dict[str, int]]:
        """A page of the members of a configuration by papers, and its totals with the recommended number."""
        c, per_page = self.resolve(**config), min(per_page, MOST_PER_PAGE)
        x = self.rows
        for level in (*taxonomy.LEVELS, "department_id"):
            if getattr(c, level) is not None:
                x = x.where(F.col(level) == getattr(c, level))
        ranked = taxonomy.members(x.withColumn("config", F.lit(1)), ["config"])
        best = taxonomy.recommended_count(ranked.select("config", "kerberos", "papers", "rank"), ["config"]).first()
        total = ranked.count()
        start = (page - 1) * per_page
        hits = ranked.where((F.col("rank") > start) & (F.col("rank") <= start + per_page)).select("rank", "kerberos", "papers").orderBy("rank")
        return hits, {"faculty_total": total, "recommended_count": best["recommended"] if best else 0, "page": page, "per_page": per_page, "total_pages": -(-total // per_page)}

    def papers_of(self, kerberos: str, page: int = 1, per_page: int = PER_PAGE, **config: str | None) -> DataFrame:
        """A page of a member's papers in a configuration, by key."""
        if not kerberos or not kerberos.strip():
            raise BadRequest("kerberos is required")
        c, per_page = self.resolve(**config), min(per_page, MOST_PER_PAGE)
        x = self.rows.where(F.col("kerberos") == kerberos.strip().lower())
        for level in taxonomy.LEVELS:
            if getattr(c, level) is not None:
                x = x.where(F.col(level) == getattr(c, level))
        return x.select("paper_key").distinct().orderBy("paper_key").offset((page - 1) * per_page).limit(per_page)
