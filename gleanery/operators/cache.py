"""The result cache as a keyed table: latest row per key, versioned reads, deletes and clears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key. An aggregate, so long histories of one key are summed before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("row_")
    return log.groupBy(*keys).agg(newest).select(*keys, "row_.*").select(*log.columns)


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the rows of `rows` in place of those with the same keys; further columns are filled with nulls."""
    return table.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


def read_through(requests: DataFrame, cache: DataFrame, keys: list[str], version: int, fields: list[str]) -> DataFrame:
    """requests with the cached fields and `hit`: rows of this version with the status Success, unless a refresh is asked for."""
    good = cache.where((F.col("version") == version) & (F.col("status") == "Success")).select(*keys, F.struct(*fields).alias("row_"))
    joined = requests.join(good, keys, "left")
    hit = F.col("row_").isNotNull() & ~F.coalesce(F.col("force_refresh"), F.lit(False))
    return joined.select(*requests.columns, *(F.when(hit, F.col("row_")[f]).alias(f) for f in fields), hit.alias("hit"))


def misses(requests: DataFrame, cache: DataFrame, keys: list[str], version: int) -> DataFrame:
    good = cache.where((F.col("version") == version) & (F.col("status") == "Success"))
    return requests.join(good, keys, "left_anti")


def delete(cache: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return cache.join(keys.select(*on).distinct(), on, "left_anti")


def cleared(cache: DataFrame, market: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(what stays, what goes) of a clear of one market or of all."""
    gone = F.lit(True) if market is None else F.coalesce(market, F.lit(False))
    return cache.where(~gone), cache.where(gone)
