"""The registered queries and their SQL."""

from __future__ import annotations

from lumenfew.plans import embeddings, models, tables


def queries() -> dict:
    return {name: q for part in (embeddings, tables, models) for name, q in part.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for part in (embeddings, tables, models) for name, sql in part.SQL.items()}
