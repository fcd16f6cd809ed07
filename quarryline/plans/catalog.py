"""Registered queries of the core operators and their DuckDB SQL."""

from __future__ import annotations

from quarryline.plans import code_queries, core_queries, finding_queries, graph_queries, line_queries, link_queries, report_queries, review_queries, scan_queries, score_queries, source_queries

PARTS = (line_queries, core_queries, graph_queries, finding_queries, code_queries, score_queries, review_queries, link_queries, source_queries, scan_queries, report_queries)
QUERIES = {name: make for part in PARTS for name, make in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
