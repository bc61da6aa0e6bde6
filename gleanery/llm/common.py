"""Helpers shared by the training-data operators: shared-folder tables, graph components, grouped Arrow streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.sources.scratch import free, new_path, written, written_at

__all__ = ["connected_components", "table", "whole_groups", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the edge list; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which need a number of rounds that grows
    with the logarithm of the longest path. Every step is a join or an aggregate over edges; each round is written to
    the shared folder, and the one before it is removed. Edges with a null end, self loops and repeated edges add nothing; an empty edge list gives an
    empty result.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    path = new_path(edges.sparkSession, "edges")
    e = written_at(e.distinct(), path)
    mark = lambda d: d.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    before = mark(e)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, path = path, new_path(edges.sparkSession, "edges")
        e = written_at(small.union(low.select("u", F.col("m").alias("v"))).distinct(), path)
        free(last)
        now = mark(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold only whole groups of a partition sorted by key (a long), and where each group starts, with the end.

    What is kept between batches is the one group that is not known to be over.
    """
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        k = t.column(key).to_numpy()
        if held and k[0] == last and k[-1] == last:
            held.append(t)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        done = pa.concat_tables([*held, t.slice(0, cut)])
        if done.num_rows:
            yield done, _starts(done.column(key).to_numpy())
        held, last = [t.slice(cut)], k[-1]
    if held:
        done = pa.concat_tables(held)
        yield done, _starts(done.column(key).to_numpy())


def _starts(k: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
