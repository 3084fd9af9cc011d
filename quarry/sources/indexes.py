"""Tables that queries share, written once an application."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import bm25
from quarry.session import shared_folder
from quarry.sources.tables import latest_papers, table

_BUILT: dict[tuple[str, str, str], object] = {}


def _place(spark: SparkSession, d: str, name: str) -> tuple[tuple[str, str, str], str]:
    key = (spark.sparkContext.applicationId, d, name)
    return key, f"{shared_folder(spark)}/{name}-{hashlib.sha256(repr(key).encode()).hexdigest()[:16]}"


def paper_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """All columns of one row per paper (:func:`latest_papers`). The tables of a folder are taken not to change while the application runs."""
    key, path = _place(spark, d, "papers")
    if key not in _BUILT:
        papers = table(spark, d, "papers")
        latest_papers(papers, *papers.columns).write.mode("overwrite").parquet(path)
        _BUILT[key] = spark.read.parquet(path)
    return _BUILT[key]


def document_index(spark: SparkSession, d: str) -> bm25.Index:
    """Postings of ``documents.text``."""
    key, path = _place(spark, d, "document-postings")
    if key not in _BUILT:
        _BUILT[key] = bm25.write_index(bm25.analysed(table(spark, d, "documents"), "doc_id", {"text": "text"}), path)
    return _BUILT[key]


def paper_index(spark: SparkSession, d: str) -> bm25.Index:
    """Postings of titles and abstracts of papers."""
    key, path = _place(spark, d, "paper-postings")
    if key not in _BUILT:
        _BUILT[key] = bm25.write_index(bm25.analysed(paper_snapshot(spark, d), "paper_key", {"title": "title", "abstract": "abstract"}), path)
    return _BUILT[key]
