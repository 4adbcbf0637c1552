"""Registered queries of the library and their SQL twins."""

from __future__ import annotations

from textloom.plans import answers, asking, code, elements, events, rag, records, relational, search, text, vectors, web

_GROUPS = (search, text, vectors, web, rag, records, code, elements, events, relational, answers, asking)


def queries() -> dict:
    return {name: query for group in _GROUPS for name, query in group.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: statement for group in _GROUPS for name, statement in group.SQL.items()}
