"""The registered query of each operator, and its SQL where DuckDB can express it."""

from __future__ import annotations

from gleanery.llm import embedding_dedup, license_scan, ngram_join, packing, quality_rules, secret_scan, source_mixing, token_counts, toxicity, warc

_MODULES = [toxicity, warc, source_mixing, token_counts, ngram_join, license_scan, quality_rules, secret_scan, packing, embedding_dedup]

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
