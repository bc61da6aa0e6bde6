"""The document pipeline: each stage is one operator of gleanery.llm, written as Parquet and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import ngram_join, packing, secret_scan, source_mixing, toxicity
from gleanery.llm.common import table, written

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("toxicity", toxicity.stage),
    ("ngram_jaccard_join", ngram_join.stage),
    ("secret_scan", secret_scan.stage),
    ("source_mixing", source_mixing.stage),
    ("best_fit_packing", packing.stage),
]

#: SQL has no form for the fitted model, the raking and the packing; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, in order."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
