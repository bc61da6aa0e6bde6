"""Every registered query of the engine proper, by name, and its SQL for DuckDB."""

from __future__ import annotations

from gleanery.plans import cache_queries, enrich_queries, fusion_queries, image_queries, ladder_queries, page_queries, parse_queries, text_queries  # noqa: F401
from gleanery.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
