"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from strandline.plans import cluster_queries, format_queries, glm_queries, interval_queries, model_queries, problems, reference_queries, spectra_queries, statistics_queries, streaming_queries, summary_queries, variant_queries

_MODULES = [problems, variant_queries, interval_queries, statistics_queries, model_queries, streaming_queries, reference_queries, format_queries, spectra_queries, glm_queries, cluster_queries, summary_queries]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
