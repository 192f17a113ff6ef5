"""All registered queries of the matching engine and their DuckDB equivalents."""

from __future__ import annotations

from . import benefit_queries, candidate_queries, catalogue_queries, curate_queries, curation_job_queries, file_queries, match_queries, message_queries, outside_queries, packet_queries, review_queries, text_queries

_MODULES = (match_queries, benefit_queries, curate_queries, curation_job_queries, candidate_queries, catalogue_queries, packet_queries, text_queries, message_queries, review_queries, outside_queries, file_queries)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in _MODULES for k, s in m.ORACLES.items()}
