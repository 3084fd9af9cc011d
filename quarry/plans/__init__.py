"""Registered queries and their SQL counterparts."""

from __future__ import annotations


def registries() -> list:
    from quarry.plans import browse, evaluation, people, quality, search, taxonomy

    return [quality.REG, search.REG, people.REG, taxonomy.REG, evaluation.REG, browse.REG]
