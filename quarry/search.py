"""Entry points: a request as keyword arguments, a page of results as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.functions.text import query_terms, required_matches, with_variants
from quarry.operators import bm25, facets, filters, identity, ranking
from quarry.session import checkpoint

# Weights of the fields.
BOOSTS = {"title": 4.0, "abstract": 1.5}
FIELD_BOOSTS = BOOSTS | {"author": 3.0, "subject": 3.6, "field": 3.0}
WINDOW = 50


@dataclass
class Page:
    """``hits``: ``rank, doc_id, score`` and the asked columns; counts; facets by name."""

    hits: DataFrame
    pagination: dict[str, int]
    facets: dict[str, DataFrame]
    suggestions: DataFrame | None = None


def refine_terms(chain: str | list[str] | None) -> list[str]:
    """Trimmed, non-empty, distinct without regard to case, in order."""
    items = [chain] if isinstance(chain, str) else chain or []
    first: dict[str, str] = {}
    for t in items:
        if t and t.strip():
            first.setdefault(t.strip().lower(), t.strip())
    return list(first.values())


class PaperSearch:
    """Search over papers (one row per paper, ``paper_key``), with optional vectors and staff.

    ``mode`` "basic" asks for all content terms, un-fuzzy; "advanced" for N of M
    terms, fused with the vector arm where a query vector is given, and falls
    back to fuzzy terms when nothing matches.
    """

    def __init__(
        self, papers: DataFrame, faculty: DataFrame | None = None, departments: DataFrame | None = None, vectors: DataFrame | None = None, author_scoped: bool = False
    ) -> None:
        self.papers, self.faculty, self.departments, self.vectors = papers, faculty, departments, vectors
        self.scoped = author_scoped

    def _listed_authors(self, papers: DataFrame) -> DataFrame:
        """``paper_key, author_id, names``: authors whose names may match: those on the roster, or all in an author's own papers."""
        names = F.concat_ws(" ", F.col("a.author_name"), F.array_join(F.coalesce("a.author_available_names", F.array().cast("array<string>")), " "))
        a = papers.select("paper_key", F.explode("authors").alias("a")).select("paper_key", norm_key("a.author_id").alias("author_id"), names.alias("names"))
        if self.scoped:
            return a
        if self.faculty is None:
            return a.limit(0)
        roster = self.faculty.select(F.explode("scopus_id").alias("author_id")).select(norm_key("author_id").alias("author_id")).distinct()
        return a.join(roster, "author_id", "left_semi")

    def _tokens(self, papers: DataFrame, search_in: list[str] | None) -> DataFrame:
        wanted = filters.normalize_search_in(search_in) or list(BOOSTS)
        columns = {"title": "title", "abstract": "abstract", "field": "field_associated", "subject": F.array_join(F.coalesce("subject_area", F.array().cast("array<string>")), " ")}
        plain = {f: columns[f] for f in wanted if f in columns}
        parts = [bm25.analysed(papers, "paper_key", plain)] if plain else []
        if "author" in wanted:
            names = self._listed_authors(papers).groupBy("paper_key").agg(F.array_join(F.collect_list("names"), " ").alias("names"))
            parts.append(bm25.analysed(names, "paper_key", {"author": "names"}))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def _match(self, papers: DataFrame, query: str, mode: str, search_in: list[str] | None) -> DataFrame:
        """``doc_id, score``. Where fields are chosen, every word must be in one of them; a name alone first means the staff it resolves to."""
        words, chosen = query_terms(query), filters.normalize_search_in(search_in)
        if chosen == ["author"] and words:
            return self._match_author(papers, query, words)
        need = len(words) if chosen else required_matches(len(words), strict=mode == "basic")
        return bm25.match(self._tokens(papers, search_in), words, need, FIELD_BOOSTS, variants=with_variants(words))

    def _match_author(self, papers: DataFrame, query: str, words: list[str]) -> DataFrame:
        staff = identity.author_query(self.faculty, query) if self.faculty is not None else None
        if staff is not None and not staff.isEmpty():
            mine = self.faculty.join(staff, "expert_id", "left_semi")  # 25 profiles at most
            ids = [r[0] for r in mine.select(F.explode("scopus_id").alias("i")).select(norm_key("i")).distinct().collect() if r[0]]
            kerbs = [r[0] for r in mine.select(identity.email_prefix()).distinct().collect() if r[0]]
            theirs = F.exists(F.coalesce("authors.author_id", F.array().cast("array<string>")), lambda a: norm_key(a).isin(ids)) | F.coalesce(norm_key("kerberos").isin(kerbs), F.lit(False))
            return papers.where(theirs).select(F.col("paper_key").alias("doc_id"), F.lit(1.0).alias("score"))
        # all words in one author's names; the best author of a paper counts
        each = self._listed_authors(papers).select(F.struct("paper_key", "author_id").alias("who"), "names")
        found = bm25.match(bm25.analysed(each, "who", {"author": "names"}), words, len(words), FIELD_BOOSTS)
        return found.groupBy(F.col("doc_id.paper_key").alias("doc_id")).agg(F.max("score").alias("score"))

    def search(
        self, query: str, filters_: dict[str, Any] | None = None, sort: str = "relevance", page: int = 1, per_page: int = 20, mode: str = "advanced", search_in: list[str] | None = None,
        refine_chain: str | list[str] | None = None, rerank: bool = False, query_vector: list[float] | None = None, now_year: int | None = None, columns: tuple[str, ...] = ("title", "publication_year"),
    ) -> Page:
        now_year = now_year or date.today().year
        docs = self.papers.where(filters.paper_filter(filters_ or {}))
        for term in refine_terms(refine_chain):
            # each step only narrows: an earlier term must match in full
            keep = self._match(docs, term, "basic", search_in).select(F.col("doc_id").alias("paper_key"))
            docs = docs.join(keep, "paper_key", "left_semi")
        # the match is read by the page, the counts and every facet
        hits = checkpoint(self._match(docs, query, mode, search_in))
        suggestions = None
        if mode == "advanced" and hits.isEmpty():
            vocab = bm25.vocabulary(self._tokens(docs, search_in))
            suggestions = bm25.suggestions(vocab, query_terms(query))
            near = [r["term"] for r in bm25.fuzzy_terms(vocab, query_terms(query)).collect()]  # at most ten a word
            hits = checkpoint(bm25.match(self._tokens(docs, search_in), near, 1, FIELD_BOOSTS))
        total = hits.count()
        meta = ranking.pagination(total, page, per_page)
        offset = (page - 1) * per_page
        if meta["count_only"]:
            return Page(hits.limit(0), meta, {}, suggestions)
        found = hits.join(docs.withColumnRenamed("paper_key", "doc_id"), "doc_id")
        ranked = None
        if sort in ("date", "citations"):
            field = "publication_year" if sort == "date" else "citation_count"
            ranked = ranking.field_ordered([hits], self.papers, "paper_key", field, offset + per_page).where(F.col("rank") > offset)
        elif sort == "impact" and mode == "advanced":
            s = found.select("doc_id", ranking.impact_score(F.col("score"), F.col("citation_count"), F.col("publication_year"), now_year).alias("score")).where("score >= 0.3")
            ranked = bm25.top_k(s, per_page, offset)
        elif mode == "advanced" and (rerank or (query_vector and self.vectors is not None)):
            raw = bm25.top_k(hits, max(WINDOW, offset + per_page))
            # a search in chosen fields has no vector arm: it asks for words, not for sense
            if query_vector and self.vectors is not None and not filters.normalize_search_in(search_in):
                depth = max(100, offset + per_page)
                arms = [bm25.top_k(hits, depth), ranking.knn(self.vectors.join(docs.select("paper_key"), "paper_key", "left_semi"), "paper_key", "embedding", query_vector, depth)]
                raw = ranking.reciprocal_rank_fusion(arms)
            if not rerank:
                ranked = raw.where((F.col("rank") > offset) & (F.col("rank") <= offset + per_page))
        if mode == "advanced" and rerank and sort not in ("date", "citations", "impact"):
            text = self.papers.select(F.col("paper_key").alias("doc_id"), "title", "abstract")
            head = ranking.rerank(raw.where(F.col("rank") <= WINDOW).drop("rank").join(text, "doc_id"), query)
            ranked = ranking.rerank_page(head, raw, WINDOW, offset, per_page).join(raw.select("doc_id", "score"), "doc_id")
        elif ranked is None:
            ranked = bm25.top_k(hits, per_page, offset)
        page_hits = ranked.join(self.papers.select(F.col("paper_key").alias("doc_id"), *columns), "doc_id").orderBy("rank")
        shown = {
            "years": facets.terms_facet(found, F.col("publication_year"), 30, by_key=True),
            "year_ranges": facets.year_ranges(found, "publication_year"),
            "document_types": facets.terms_facet(found, norm_key("document_type"), 15),
            "fields": facets.terms_facet(found, F.col("field_associated"), 30),
            "subject_areas": facets.terms_facet(found, F.explode(F.transform("subject_area", norm_key)), 50),
        }
        return Page(page_hits, meta, shown, suggestions)

    def author_scoped(self, author_id: str, query: str, **kw: Any) -> Page:
        """Search within the papers of one author, by id or, for a member of staff, by kerberos too."""
        mine = filters.paper_filter({"author_id": author_id}, author_kerberos=self._kerberos(author_id))
        return PaperSearch(self.papers.where(mine), self.faculty, self.departments, self.vectors, author_scoped=True).search(query, **kw)

    def _kerberos(self, author_id: str) -> str | None:
        if self.faculty is None:
            return None
        mine = F.array_contains(F.transform("scopus_id", norm_key), author_id.lower()) | (norm_key("expert_id") == author_id.lower())
        row = self.faculty.where(mine).select(identity.email_prefix().alias("k")).orderBy("k").first()
        return row["k"] if row else None

    def people(self, query: str, filters_: dict[str, Any] | None = None, mode: str = "advanced") -> DataFrame:
        """Departments of the people behind the matching papers."""
        docs = self.papers.where(filters.paper_filter(filters_ or {}))
        hits = self._match(docs, query, mode, None).withColumnRenamed("doc_id", "paper_key").join(docs, "paper_key")
        own = identity.authorship(hits, self.faculty).join(hits.select("paper_key", "score", "citation_count"), "paper_key")
        score = F.round(facets.author_score(F.max("score"), F.avg("score"), F.count(F.lit(1))), 4)
        e = own.groupBy("expert_id").agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citation_count"), F.lit(0)).cast("long").alias("citations"), score.alias("score"))
        e = facets.above_share_of_best(e, "score").join(self.faculty.select(norm_key("expert_id").alias("expert_id"), norm_key("department").alias("department")), "expert_id")
        return identity.by_department(e, self.departments)

    def document(self, wanted: str) -> DataFrame:
        """One paper by its key, else by its search id."""
        return self.papers.where((F.col("paper_key") == wanted.lower()) | (F.col("open_search_id").cast("string") == wanted)).orderBy(F.col("paper_key") != wanted.lower()).limit(1)

    def documents_by_author(self, author_id: str, page: int = 1, per_page: int = 20) -> DataFrame:
        mine = self.papers.where(filters.paper_filter({"author_id": author_id}, author_kerberos=self._kerberos(author_id)))
        return mine.orderBy(F.desc_nulls_last("publication_year"), "paper_key").offset((page - 1) * per_page).limit(per_page)

    def similar(self, wanted: str, limit: int = 10) -> DataFrame:
        """``rank, doc_id, score`` of the papers nearest to a stored paper's vector, itself left out; none without a vector."""
        mine = self.vectors.where(F.col("paper_key") == wanted.lower()).select("embedding").first() if self.vectors is not None else None
        if mine is None or mine[0] is None:
            return self.papers.limit(0).select(F.lit(0).alias("rank"), F.col("paper_key").alias("doc_id"), F.lit(0.0).alias("score"))
        return ranking.knn(self.vectors, "paper_key", "embedding", list(mine[0]), min(limit, 50), F.col("paper_key") != wanted.lower())

    def collaborators(self, author_id: str, size: int = 50) -> DataFrame:
        return identity.coauthors(self.papers, [author_id.lower()], size)
