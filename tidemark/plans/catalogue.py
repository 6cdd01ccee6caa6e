"""Every registered query of the library and its DuckDB SQL."""

from __future__ import annotations

from . import access_queries, coverage_queries, decision_queries, evaluation_queries, history_queries, ingest_queries, market_queries, model_queries, report_queries

FLAGSHIP = "market_consensus"
QUERIES: dict = {}
ORACLES: dict = {}
for _module in (market_queries, history_queries, evaluation_queries, decision_queries, model_queries, ingest_queries, report_queries, access_queries, coverage_queries):
    QUERIES.update(_module.R.queries)
    ORACLES.update(_module.R.oracles)
