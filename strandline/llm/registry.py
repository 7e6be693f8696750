"""Queries of this subpackage, and their SQL."""

from __future__ import annotations

from strandline.llm import queries_events, queries_sets, queries_texts

_MODULES = [queries_events, queries_sets, queries_texts]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
