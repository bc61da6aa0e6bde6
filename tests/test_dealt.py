"""Rows that become much work are dealt out by their number, whatever the files that hold them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.operators import page_fields
from gleanery.plans import enrich_queries, ladder_queries, page_queries, parse_queries  # noqa: F401
from gleanery.plans.base import QUERIES


@pytest.fixture(scope="module")
def one_file(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("part")
    k = F.col("id")
    rows = spark.range(12_001).select(k.alias("p_partkey"), F.lit("Oats").alias("p_name"), F.lit("Brand#11").alias("p_brand"), F.lit("X").alias("p_type"), (k % 50 + 1).cast("int").alias("p_size"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")
    return str(folder)


def test_tasks_grow_with_requests(spark, one_file):
    held = ladder_queries._requests(spark, one_file).groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert held[:2] == (7, 12_000) and held[2] < 2_500


@pytest.mark.parametrize("name", ["visible_facts", "embedded_state", "jsonld_fields", "page_tags", "linked_product"])
def test_pages_of_one_file_are_parsed_in_several_tasks(spark, one_file, name):
    held = QUERIES[name](spark, one_file).groupBy(F.spark_partition_id()).count().agg(F.count("*"), F.sum("count"), F.max("count")).first()
    assert held[:2] == (7, 12_001) and held[2] < 2_500


def test_enrichment_parses_pages_in_several_tasks(spark, one_file, monkeypatch):
    seen = []
    with_fields = page_fields.with_fields
    monkeypatch.setattr(page_fields, "with_fields", lambda pages: seen.append(pages) or with_fields(pages))
    plan = QUERIES["enrich_parts"](spark, one_file)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert seen[0].groupBy(F.spark_partition_id()).count().count() == 4 * spark.sparkContext.defaultParallelism
