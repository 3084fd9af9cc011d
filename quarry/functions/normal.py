"""Normalisation of keys and short strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm_key(c: str | Column) -> Column:
    """Trimmed, lower-cased key; blank becomes null."""
    s = F.lower(F.btrim(col(c), F.lit(" \t\n\r\f")))
    return F.when(s != "", s)


def clean(c: str | Column) -> Column:
    """Trimmed, lower-cased, inner whitespace collapsed."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"\s+", " "))
