"""The registered queries of the corpus and evaluation operators, with their DuckDB SQL."""

from __future__ import annotations

from .plans import chat_queries, document_queries, evaluation_queries, store_queries

MODULES = [document_queries, chat_queries, evaluation_queries, store_queries]


def queries() -> dict:
    return {name: f for m in MODULES for name, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
