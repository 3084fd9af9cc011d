"""Typeahead: people and papers for a typed prefix, and which of the two is meant."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.functions.text import edit_allowance, edits_to, query_terms, shingles, terms
from quarry.operators import identity, ranking

LEAST_PREFIX, DEFAULT_LIMIT, MOST = 2, 8, 20


@dataclass
class Suggestions:
    """Ranked people and papers, ``author``, ``paper`` or ``mixed``, and its confidence."""

    authors: DataFrame
    papers: DataFrame
    intent: str
    confidence: float


def _top(x: DataFrame, key: str, limit: int, *columns: str) -> DataFrame:
    x = x.withColumn("score", F.round("score", 4)).orderBy(F.desc("score"), key).limit(limit)
    return x.select(F.row_number().over(W.orderBy(F.desc("score"), key)).alias("rank"), key, "score", *columns)


def _starts(w: str) -> Callable[[Column], Column]:
    return lambda t: t.startswith(w)


def _is_near(w: str) -> Callable[[Column], Column]:
    return lambda t: edits_to(t, w) <= edit_allowance(F.lit(len(w)))


def _all_prefixes(ts: Column, words: list[str]) -> Column:
    ok = F.lit(bool(words))
    for w in words:
        ok = ok & F.exists(ts, _starts(w))
    return ok


def _pairs(words: list[str]) -> list[str]:
    return [" ".join(p) for p in zip(words, words[1:])]


def _hits(ts: Column, wanted: list[str]) -> Column:
    return F.size(F.filter(ts, lambda t: t.isin(wanted))) if wanted else F.lit(0)


def suggest_authors(faculty: DataFrame, prefix: str, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``rank, expert_id, score, name``: profiles whose name has every typed word as a prefix (3), is the text itself (8), or has
    near words (1.5 a word), plus the logarithms of h-index and citations. Counts of matches stand for an index's statistics."""
    words = prefix.lower().split()
    name = F.trim(F.concat_ws(" ", F.trim("firstname"), F.trim("lastname")))
    ts = terms(name)
    near = F.lit(0)
    for w in words:
        near = near + F.exists(ts, _is_near(w)).cast("int")
    starts, whole = _all_prefixes(ts, words), F.lower(name) == " ".join(words)
    x = faculty.where(F.col("expert_id").isNotNull()).select(
        norm_key("expert_id").alias("expert_id"), name.alias("name"),
        (F.when(starts, 3.0).otherwise(0.0) + F.when(whole, 8.0).otherwise(0.0) + 1.5 * near).alias("found"),
        (F.log10(1 + 0.3 * F.coalesce("h_index", F.lit(0))) + F.log10(1 + 0.1 * F.coalesce("citation_count", F.lit(0)))).alias("known"),
    )
    return _top(x.where("found > 0").withColumn("score", F.col("found") + F.col("known")), "expert_id", limit, "name")


def suggest_papers(papers: DataFrame, prefix: str, now_year: int, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """``rank, paper_key, score, title``: papers whose title has every typed word as a prefix (4), pairs of words in title (2 each) and
    abstract (0.7), words in the abstract (0.5), plus the logarithm of citations and a decay over eight years."""
    words = prefix.lower().split()
    title, abstract = terms("title"), terms("abstract")
    found = F.when(_all_prefixes(title, words), 4.0).otherwise(0.0) + 2.0 * _hits(shingles(title), _pairs(words)) + 0.5 * _hits(F.array_distinct(abstract), query_terms(prefix)) + 0.7 * _hits(shingles(abstract), _pairs(words))
    known = F.log10(1 + 0.2 * F.coalesce("citation_count", F.lit(0))) + F.coalesce(ranking.decay(F.col("publication_year") - now_year, 8.0), F.lit(0.0))
    x = papers.select("paper_key", "title", found.alias("found"), known.alias("known")).where("found > 0")
    return _top(x.withColumn("score", F.col("found") + F.col("known")), "paper_key", limit, "title")


def suggest(papers: DataFrame, faculty: DataFrame, prefix: str | None, limit: int | None = None, now_year: int | None = None) -> Suggestions:
    """Both lists and the intent of a typed prefix; one of under ``LEAST_PREFIX`` letters gives empty lists."""
    text = " ".join((prefix or "").split())
    limit = min(max(limit or DEFAULT_LIMIT, 1), MOST)
    authors = suggest_authors(faculty, text, limit)
    found = suggest_papers(papers, text, now_year or date.today().year, limit)
    if len(text) < LEAST_PREFIX:
        return Suggestions(authors.limit(0), found.limit(0), "mixed", 0.0)
    a, p = authors.collect(), found.collect()  # twenty rows at most
    words = [w for w in text.lower().split() if w]
    # only the name words that the prefix may mean travel
    vocab = faculty.select(F.explode(terms(identity.display_name())).alias("t")).where(F.length("t") >= 2)
    last = words[-1]
    names = {r[0] for r in vocab.where(F.col("t").isin(words) | F.col("t").startswith(last)).distinct().limit(1000).collect()}
    intent, confidence = ranking.suggest_intent(text, names, len(a), len(p), a[0]["score"] if a else 0.0, p[0]["score"] if p else 0.0)
    return Suggestions(authors, found, intent, confidence)
