"""Vector arms, rank fusion, field-ordered ranking and score fusion."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quarry.session import checkpoint

def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null for unequal lengths or a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (n > 0), dot(a, b) / n)


def knn(vectors: DataFrame, vec_id: str, vec: str, query: list[float], k: int, where: Column | None = None, digits: int = 6) -> DataFrame:
    """``rank, doc_id, score`` of the ``k`` nearest, exactly; ``where`` is applied before the cut.

    One pass with the query as a literal; each task keeps its own best ``k``.
    """
    v = vectors.where(where) if where is not None else vectors
    q = F.array(*[F.lit(float(x)) for x in query])
    s = v.select(F.col(vec_id).alias("doc_id"), F.round(cosine(F.col(vec), q), digits).alias("score")).where("score IS NOT NULL")
    best = s.orderBy(F.desc("score"), "doc_id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))).select("rank", "doc_id", "score")


def vector_of(vectors: DataFrame, vec_id: str, vec: str, wanted: int) -> list[float]:
    """The stored vector of one row; empty if there is none."""
    row = vectors.where(F.col(vec_id) == wanted).select(vec).first()
    return [float(x) for x in row[0]] if row and row[0] is not None else []


def similar(vectors: DataFrame, vec_id: str, vec: str, wanted: int, limit: int = 10) -> DataFrame:
    """Nearest rows of a stored row's vector, itself excluded; at most 50."""
    q = vector_of(vectors, vec_id, vec, wanted)
    return knn(vectors, vec_id, vec, q, min(limit, 50), F.col(vec_id) != wanted)


def reciprocal_rank_fusion(arms: list[DataFrame], k: int = 60, digits: int = 6) -> DataFrame:
    """``rank, doc_id, score``: sum over the arms of 1 / (k + rank). A document counts in the arms that have it."""
    parts = [a.select("doc_id", F.col("rank").alias("r"), F.lit(i).alias("arm")) for i, a in enumerate(arms)]
    s = reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("r"))), digits).alias("score"))
    return s.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id"))).select("rank", "doc_id", "score")


def field_ordered(arms: list[DataFrame], docs: DataFrame, doc_id: str, field: str, limit: int) -> DataFrame:
    """Union of the arms ordered by a field of the documents (missing last), then best score, then id."""
    u = reduce(DataFrame.unionByName, [a.select("doc_id", "score") for a in arms]).groupBy("doc_id").agg(F.max("score").alias("score"))
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(field).alias("value"))
    out = u.join(d, "doc_id").orderBy(F.desc_nulls_last("value"), F.desc("score"), "doc_id").limit(limit)
    return out.withColumn("rank", F.row_number().over(W.orderBy(F.desc_nulls_last("value"), F.desc("score"), "doc_id"))).select("rank", "doc_id", "value", "score")


def decay(distance: Column, scale: float, at_scale: float = 0.5) -> Column:
    """Bell-shaped decay that is ``at_scale`` at distance ``scale``."""
    return F.exp(F.log(F.lit(at_scale)) * F.pow(F.abs(distance) / scale, F.lit(2.0)))


def impact_score(score: Column, citations: Column, year: Column, now_year: int) -> Column:
    """Relevance times (1.2 log10(1 + 0.3 citations) + 0.8 decay of age over 5 years); missing counts are 0, missing years add nothing."""
    cites = F.log10(1 + 0.3 * F.coalesce(citations, F.lit(0)))
    return score * (1.2 * cites + 0.8 * F.coalesce(decay(year - now_year, 5.0), F.lit(0.0)))


def min_max(c: str, over: W | None = None) -> Column:
    """Scaled to 0..1; a constant list is 0.5 throughout."""
    w = over or W.partitionBy()
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi - lo < 1e-9, F.lit(0.5)).otherwise((F.col(c) - lo) / (hi - lo))


def overlap_scorer(query: str) -> Callable[[Column], Column]:
    """Stand-in for a cross-encoder: share of the query's terms that the text has."""
    from quarry.functions.text import query_terms, terms

    words = query_terms(query)
    return lambda text: F.size(F.array_intersect(terms(text), F.array(*[F.lit(w) for w in words]))) / float(max(1, len(words)))


def rerank(window: DataFrame, query: str, scorer: Callable[[Column], Column] | None = None, alpha: float = 0.7, pin: float = 0.3) -> DataFrame:
    """Reordered window (``doc_id, title, abstract, score``): alpha norm(rerank) + (1 - alpha) norm(first) + pin for a title that contains the query.

    The window is a page-sized cut made before, so ranking it in one task is
    bounded. Text is cut to 1,200 characters for the scorer. A scorer that
    cannot be built, or fails on a row, leaves the first-stage order: the window is scored and written at once.
    """
    try:
        rr = (scorer or overlap_scorer(query))(F.substring(F.concat_ws("\n", "title", "abstract"), 1, 1200))
        x = checkpoint(window.withColumn("rr", rr)) if scorer else window.withColumn("rr", rr)
    except Exception:
        return window.withColumn("fused", F.col("score")).withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "doc_id")))
    q = query.strip().lower()
    pinned = F.when(F.lit(len(q) >= 3) & F.contains(F.lower("title"), F.lit(q)), F.lit(pin)).otherwise(F.lit(0.0))
    x = x.withColumn("fused", F.round(alpha * min_max("rr") + (1 - alpha) * min_max("score") + pinned, 6))
    return x.withColumn("rank", F.row_number().over(W.orderBy(F.desc("fused"), "doc_id"))).drop("rr")


def pagination(total: int, page: int, per_page: int, window: int = 10_000, ranked: int = 50) -> dict[str, int]:
    """Page counts; pages beyond the window exist only as a count."""
    pages = min(-(-total // per_page), max(1, window // per_page))
    return {"total": total, "page": page, "per_page": per_page, "total_pages": pages, "ranked_window": min(total, ranked), "count_only": int(page * per_page > window)}


def rerank_page(reranked: DataFrame, raw: DataFrame, k: int, offset: int, per_page: int) -> DataFrame:
    """A page that may straddle the reranked window: reranked up to ``k``, then the raw order."""
    head = reranked.where(F.col("rank") <= k).select("rank", "doc_id")
    tail = raw.where(F.col("rank") > k).select("rank", "doc_id")
    return head.unionByName(tail).where((F.col("rank") > offset) & (F.col("rank") <= offset + per_page))


# Words that tell a topic in a typed prefix, those that leave it open at the end, and the weights of the evidence.
TOPIC_WORDS = frozenset("a an and are as at based by for from in into of on or the their to using via with within".split())
OPEN_ENDS = frozenset("for using of with in on and based via to".split())
INTENT_WEIGHTS = {"names": 0.30, "shape": 0.12, "found": 0.60, "topic": 0.35}


def suggest_intent(
    prefix: str, author_names: set[str], n_authors: int, n_papers: int, best_author: float, best_paper: float,
    weights: dict[str, float] = INTENT_WEIGHTS, floor: float = 0.6, ceiling: float = 0.4,
) -> tuple[str, float]:
    """``author``, ``paper`` or ``mixed`` with its confidence, over two short lists on the driver.

    Evidence for an author: the share of content words that are name words (the last one as a prefix), the shape
    of a name, and how well authors were found against papers. For a paper: topic words, length, an open end, and
    how well papers were found. The author's share of all evidence decides; nothing found, or no evidence, is mixed at 0.
    """
    words = prefix.lower().split()
    content = [re.sub("[^a-z]", "", w) for w in words if w not in TOPIC_WORDS]
    n = len(words)

    def is_name(i: int, w: str) -> bool:
        return w in author_names or (i == len(content) - 1 and len(w) >= 2 and any(x.startswith(w) for x in author_names))

    names = sum(1 for i, w in enumerate(content) if w and is_name(i, w)) / len(content) if content else 0.0
    initials = any(re.fullmatch(r"[a-z]\.?", w) for w in words)
    shape = 0.0 if n >= 5 else min(1.0, 0.6 * (1 <= n <= 3) + 0.2 * (n <= 2) + 0.4 * initials)
    topic = min(1.0, 0.4 * any(w in TOPIC_WORDS for w in words) + 0.4 * (n >= 4) + 0.2 * (n >= 6) + 0.3 * (n > 0 and words[-1] in OPEN_ENDS))
    author, paper = (best_author if n_authors else 0.0), (best_paper if n_papers else 0.0)
    found = author + paper
    for_author = weights["names"] * names + weights["shape"] * shape + weights["found"] * (author / found if found > 0 else 0.0)
    for_paper = weights["topic"] * topic + weights["found"] * (paper / found if found > 0 else 0.0)
    total = for_author + for_paper
    if total <= 0 or not (n_authors or n_papers):
        return "mixed", 0.0
    p = for_author / total
    return ("author" if p >= floor else "paper" if p <= ceiling else "mixed"), int(max(p, 1 - p) * 100 + 0.5) / 100
