"""Candidate pages: ladders of ranked search results, unions, one page per host, early stop and rescue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("n_", F.row_number().over(w)).where("n_ = 1").drop("n_")


def ladder(results: DataFrame, per_query: int = 6, stop_at: int = 10, req: str = "req_id", query: str = "query_no", rank: str = "rank", link: str = "link") -> DataFrame:
    """The links of a request's queries in order: `per_query` of each, each link once, and no query once stop_at are found."""
    taken = first_seen(results.where((F.col(rank) < per_query) & F.col(link).startswith("http")), [req, link], [query, rank])
    before = F.coalesce(F.count("*").over(Window.partitionBy(req).orderBy(query).rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(req).orderBy(query, rank))
    return taken.withColumn("before_", before).where(F.col("before_") < stop_at).withColumn("pos", place - 1).where(F.col("pos") < stop_at).drop("before_")


def conditional_step(found: DataFrame, more: DataFrame, fewer_than: int, req: str = "req_id") -> DataFrame:
    """found, with the rows of `more` for requests that have fewer than so many rows yet."""
    enough = found.groupBy(req).count().where(F.col("count") >= fewer_than)
    return found.unionByName(more.join(enough, req, "left_anti"), allowMissingColumns=True)


def best_per_host(rows: DataFrame, most: int = 12, req: str = "req_id", host: str = "host", path: str = "path", pos: str = "pos") -> DataFrame:
    """The page with the longest path of each host, in the order in which hosts came up, `most` of them; ties keep the earlier page."""
    best = Window.partitionBy(req, host).orderBy(F.length(path).desc(), pos)
    rows = rows.withColumn("n_", F.row_number().over(best)).withColumn("seen_", F.min(pos).over(Window.partitionBy(req, host)))
    place = F.row_number().over(Window.partitionBy(req).orderBy("seen_"))
    return rows.where("n_ = 1").withColumn("place", place).where(F.col("place") <= most).drop("n_", "seen_")


def read_until(rows: DataFrame, full: Column, most: int = 4, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The rows that are read when reading stops after `most` with content."""
    w = Window.partitionBy(*(keys or ["req_id"])).orderBy(*(order or ["pos"])).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before_", F.coalesce(F.sum(full.cast("int")).over(w), F.lit(0))).where(F.col("before_") < most).drop("before_")


def needing_rescue(covered: DataFrame, least: int = 4, req: str = "req_id", field: str = "field") -> DataFrame:
    """Requests whose pages cover fewer than `least` distinct fields, with how many."""
    return covered.groupBy(req).agg(F.count_distinct(field).alias("n_fields")).where(F.col("n_fields") < least)


def new_hosts(rows: DataFrame, seen: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """Rows of keys not seen, `most` for each request in the given order."""
    w = Window.partitionBy(keys[0]).orderBy(*order)
    return rows.join(seen.select(*keys).distinct(), keys, "left_anti").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def render_queue(pages: DataFrame, most: int = 3, req: str = "req_id") -> DataFrame:
    """Pages to render: thin trusted pages that are verified, then thin ones, then the rest; `most` a request."""
    rank = F.when(F.col("verified") & F.col("trusted"), 0).when(F.col("verified"), 1).otherwise(2)
    w = Window.partitionBy(req).orderBy(rank, "pos")
    return pages.where(~F.col("readable")).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def links_per_host(rows: DataFrame, most: int = 2, req: str = "req_id", host: str = "host", pos: str = "pos") -> DataFrame:
    """The first link of each host, `most` a request, in order."""
    w = Window.partitionBy(req).orderBy(pos)
    return first_seen(rows, [req, host], [pos]).withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)


def padded(items: Column, n: int) -> list[Column]:
    """n columns from an array, empty texts where it is short."""
    return [F.coalesce(F.get(items, i), F.lit("")) for i in range(n)]
