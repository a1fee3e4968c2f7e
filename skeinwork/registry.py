"""Collects the queries and SQL of every section module."""

from __future__ import annotations

from .plans import crawl, graph, planning, relational, search, text, vectors, versions
from .plans.base import Query

FLAGSHIP = "search_pipeline"
SECTIONS = (relational.S, versions.S, planning.S, text.S, search.S, vectors.S, graph.S, crawl.S)


def queries() -> dict[str, Query]:
    return {k: f for s in SECTIONS for k, f in s.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for s in SECTIONS for k, q in s.sql.items()}
