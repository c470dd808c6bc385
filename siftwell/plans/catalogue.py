"""Every query of the library by name, with its DuckDB equivalent."""

from __future__ import annotations

from . import knowledge_queries, quality_queries, signals_sql

QUERIES: dict = quality_queries.QUERIES | knowledge_queries.QUERIES
ORACLE_SQL: dict[str, str] = quality_queries.ORACLE_SQL | knowledge_queries._oracles(quality_queries.SIG, signals_sql.chunk_scores(), signals_sql.extraction_scores(), signals_sql.signals("pages", "html", "page_id"))
