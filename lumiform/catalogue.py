"""Every query of the engine, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from lumiform.plans import geometry_queries, ops_queries, prose_queries, queries, study_queries, table_queries  # noqa: F401  the others register their queries with the first

QUERIES = dict(queries.QUERIES)
ORACLE = dict(queries.ORACLE)
FLAGSHIP = "score_axis_pairwise"
