"""Request filters as one conjunctive, non-scoring predicate."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.normal import norm_key
from quarry.functions.text import edit_allowance, edits_to, terms

SEARCH_FIELDS = ("title", "abstract", "author", "subject", "field")
# Other names of a field.
SEARCH_ALIASES = {"subject_area": "subject", "authors": "author", "field_associated": "field"}


def normalize_search_in(fields: list[str] | None) -> list[str] | None:
    """Known fields, once each, sorted; none means all fields."""
    return sorted({g for f in fields or [] if (g := SEARCH_ALIASES.get(f, f)) in SEARCH_FIELDS}) or None


def drop_unset(filters: dict[str, Any]) -> dict[str, Any]:
    """Zero, empty and missing values constrain nothing."""
    return {k: v for k, v in filters.items() if v not in (None, 0, "", [], False)}


def fuzzy_any(text: str, words: list[str]) -> Column:
    """Any term of ``text`` within the automatic edit allowance of any word; an adjacent swap is one edit."""
    def near(t: Column) -> Column:
        ok = F.lit(False)
        for w in words:
            ok = ok | (edits_to(t, w) <= edit_allowance(F.lit(len(w))))
        return ok

    return F.exists(terms(text), near)


def paper_filter(filters: dict[str, Any], author_kerberos: str | None = None, strict_first_author: bool = False) -> Column:
    """Predicate over paper rows. Unknown keys are ignored, unset values do not constrain.

    ``first_author_only`` asks for *some* author at position 1, whoever the
    ``author_id`` is; ``strict_first_author`` ties both to one author. An
    ``author_id`` with a known kerberos also matches the papers under it.
    Null columns never satisfy a filter.
    """
    f = drop_unset(filters)
    p = F.lit(True)
    if "year_from" in f:
        p = p & (F.col("publication_year") >= f["year_from"])
    if "year_to" in f:
        p = p & (F.col("publication_year") <= f["year_to"])
    if "field_associated" in f:
        p = p & fuzzy_any("field_associated", f["field_associated"].lower().split())
    if "document_type" in f:
        p = p & (norm_key("document_type") == f["document_type"].lower())
    if "document_types" in f:
        p = p & norm_key("document_type").isin([x.lower() for x in f["document_types"]])
    if "subject_area" in f:
        p = p & F.arrays_overlap(F.transform("subject_area", norm_key), F.array(*[F.lit(x.lower()) for x in f["subject_area"]]))
    position_one = lambda a: F.trim(a["author_position"]) == "1"
    if "author_id" in f:
        mine = lambda a: norm_key(a["author_id"]) == f["author_id"].lower()
        one = F.exists("authors", lambda a: mine(a) & position_one(a)) if strict_first_author and f.get("first_author_only") else F.exists("authors", mine)
        p = p & ((one | (norm_key("kerberos") == author_kerberos.lower())) if author_kerberos else one)
    if f.get("first_author_only"):
        p = p & F.exists("authors", position_one)
    if f.get("interdisciplinary"):
        p = p & (F.size("subject_area") >= 3)
    if "kerberos" in f:
        p = p & (norm_key("kerberos") == f["kerberos"].lower())
    return F.coalesce(p, F.lit(False))


def document_filter(filters: dict[str, Any]) -> Column:
    """Predicate over ``documents`` rows: source(s), language, owner, years, length."""
    f = drop_unset(filters)
    p = F.lit(True)
    if "source" in f:
        p = p & (norm_key("source") == f["source"].lower())
    if "sources" in f:
        p = p & norm_key("source").isin([x.lower() for x in f["sources"]])
    if "lang" in f:
        p = p & (norm_key("lang") == f["lang"].lower())
    if "kerberos" in f:
        p = p & (norm_key("kerberos") == f["kerberos"].lower())
    if "year_from" in f:
        p = p & (F.col("publication_year") >= f["year_from"])
    if "year_to" in f:
        p = p & (F.col("publication_year") <= f["year_to"])
    if "min_chars" in f:
        p = p & (F.col("n_chars") >= f["min_chars"])
    return F.coalesce(p, F.lit(False))


def is_object_id(c: str) -> Column:
    return F.coalesce(F.col(c).rlike("^[a-f0-9]{24}$"), F.lit(False))
