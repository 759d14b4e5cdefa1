"""All registered queries and the DuckDB SQL they are compared with."""

from __future__ import annotations

from claimworks.plans import detect_queries, evidence_queries, planner_queries, record_queries, report_queries

_PARTS = (detect_queries, record_queries, planner_queries, evidence_queries, report_queries)
QUERIES = {name: run for part in _PARTS for name, run in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
