"""Query plans: what is computed from the tables, with SQL that gives the same results."""

from __future__ import annotations

from quarrylight.plans import chunking, extraction, graph, ingest, references, retrieval, search, text

_MODULES = (ingest, text, chunking, graph, extraction, retrieval, search, references)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: q for m in _MODULES for name, q in m.SQL.items()}


def flagship(spark, root):
    return queries()["retrieve_fused"](spark, root)
