"""Queries over the cache: latest rows, read-through, clears, reruns, taxonomy, the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import cache, lookups
from gleanery.plans.base import query
from gleanery.sources.scratch import new_path
from gleanery.sources.tables import table
from gleanery.streaming import cache_stream

_LATEST = "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) as n from events) where n = 1"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value", "ts")


@query(_LATEST)
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of writes: the last row of each key."""
    return cache.latest(_log(spark, sf_dir), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query(f"""
with c as (select *, (event_id % 4)::int as version, case when value > 20 then 'Success' else 'Error' end as status from ({_LATEST})), r as (select distinct user_id, event_type from events)
select r.user_id, r.event_type, case when h then c.event_id end as event_id, coalesce(h, false) as hit
from r left join (select *, user_id % 5 <> 0 as h from c where version = 3 and status = 'Success') c on c.user_id = r.user_id and c.event_type = r.event_type
""")
def cache_read_through(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests met with rows of the current version that succeeded; every fifth user asks for a refresh."""
    rows = cache_latest(spark, sf_dir).withColumn("version", (F.col("event_id") % 4).cast("int")).withColumn("status", F.when(F.col("value") > 20, "Success").otherwise("Error"))
    asked = table(spark, sf_dir, "events").select("user_id", "event_type").distinct().withColumn("force_refresh", F.col("user_id") % 5 == 0)
    return cache.read_through(asked, rows, ["user_id", "event_type"], 3, ["event_id"]).drop("force_refresh")


@query(f"""
select event_type, count(*) filter (event_type <> 'click')::bigint as kept, count(*) filter (event_type = 'click')::bigint as removed from ({_LATEST}) group by event_type
""")
def cache_clear_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a clear of one market keeps and takes away."""
    kept, gone = cache.cleared(cache_latest(spark, sf_dir), F.col("event_type") == "click")
    rows = kept.select("event_type", F.lit(1).alias("k"), F.lit(0).alias("g")).union(gone.select("event_type", F.lit(0), F.lit(1)))
    return rows.groupBy("event_type").agg(F.sum("k").alias("kept"), F.sum("g").alias("removed"))


@query(f"""
with c as ({_LATEST}), f as (select user_id, event_type, -event_id as event_id, value + 1 as value from c where user_id % 7 = 0)
select * from c where user_id % 7 <> 0 and user_id % 11 <> 0 union all select * from f where user_id % 11 <> 0
""")
def cache_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New rows in place of old ones, and users deleted on a forced refresh."""
    rows = cache_latest(spark, sf_dir)
    fresh = rows.where("user_id % 7 = 0").withColumn("event_id", -F.col("event_id")).withColumn("value", F.col("value") + 1)
    out = cache.upsert(rows, fresh, ["user_id", "event_type"])
    return cache.delete(out, rows.where("user_id % 11 = 0"), ["user_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
with b as (select o_custkey, o_orderkey, o_totalprice, o_orderstatus from orders), f as (select o_custkey, max(o_totalprice) as price from orders where o_custkey % 3 = 0 group by o_custkey)
select b.o_custkey, b.o_orderkey, case when f.price is not null and b.o_orderkey = m.k then f.price else b.o_totalprice end as o_totalprice, b.o_orderstatus
from b join (select o_custkey, min(o_orderkey) as k from b group by o_custkey) m using (o_custkey) left join f on f.o_custkey = b.o_custkey
""")
def rerun_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh values over the first row of each key."""
    base = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    fresh = base.where("o_custkey % 3 = 0").groupBy("o_custkey").agg(F.max("o_totalprice").alias("o_totalprice"))
    return lookups.merge_rerun(base, fresh, "o_custkey", "o_orderkey", ("o_totalprice",))


@query("""
select c_custkey, n_name, r_name from customer join nation on c_nationkey = n_nationkey join region on r_regionkey = (n_regionkey + c_custkey % 2) % 5 where c_custkey % 2 = 0
""")
def taxonomy_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of region and nation that the tables know; every other customer's path is wrong."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    known = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat(F.lit(" "), F.col("r_name")).alias("r_name"), "n_name")
    claimed = nation.select("n_nationkey", "n_name", "n_regionkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(claimed, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(region, F.col("r_regionkey") == (F.col("n_regionkey") + F.col("c_custkey") % 2) % 5).select("c_custkey", "n_name", "r_name")
    return lookups.valid_paths(rows, known, ("r_name", "n_name"))


@query("""
select event_id, 'k' as key, (props::json->>'k') as value from events
""")
def json_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and values of events' properties."""
    pairs = F.from_json("props", "map<string,string>")
    return table(spark, sf_dir, "events").select("event_id", F.explode(pairs).alias("key", "value"))


@query(_LATEST)
def cache_stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same latest rows, kept by a stream over the events."""
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.select("user_id", "event_type", "event_id", "value", "ts")
    return cache_stream.keep_latest(stream, new_path(spark, "stream"), ["user_id", "event_type"], ["ts", "event_id"], spark).drop("ts")
