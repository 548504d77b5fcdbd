"""Queries over the provided tables, one or more for each operator, with the DuckDB SQL that checks them."""

from __future__ import annotations

from graphloom.bindings import cache, change, code, digest, graph, scalar, text

_PARTS = (graph, cache, text, scalar, digest, change, code)
QUERIES = {k: v for part in _PARTS for k, v in part.QUERIES.items()}
ORACLE_SQL = {k: v for part in _PARTS for k, v in part.ORACLE_SQL.items()}
