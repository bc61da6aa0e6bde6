"""Queries that fuse and grade: the flagship, early stop, rescue, coverage, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text
from gleanery.operators import candidates, export, fuse
from gleanery.plans.base import query
from gleanery.sources.tables import table


@query("""
with p as (select l_partkey as req_id, l_suppkey as host, l_quantity as v, s_nationkey = 0 as trusted, l_returnflag as flag, l_orderkey, l_linenumber, l_extendedprice from lineitem join supplier on s_suppkey = l_suppkey),
r as (select *, row_number() over (partition by req_id order by case when trusted then 0 else 1 end, case flag when 'A' then 0 when 'R' then 1 else 2 end, host, l_orderkey, l_linenumber, v, l_extendedprice) as n from p),
w as (select req_id, host, v as value, trusted from r where n = 1),
c as (select w.req_id, count(distinct p.host) as n_hosts from w join p on p.req_id = w.req_id and abs(p.v - w.value) <= greatest(0.5, 0.03 * greatest(abs(p.v), abs(w.value))) group by w.req_id)
select w.req_id, w.value, w.host, w.trusted, c.n_hosts::bigint as n_hosts, case when w.trusted then 'H' when c.n_hosts >= 2 then 'M' else 'L' end as reliability,
  case when w.trusted then 'trusted source' when c.n_hosts >= 2 then c.n_hosts || ' sources agree' else 'single source' end as provenance from w join c using (req_id)
""")
def fuse_and_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as pages about parts: ranked, the first value taken, corroborated by other suppliers, graded.

    The winner comes from one aggregation that sums before the shuffle; the winner alone meets its part's values.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") == 0).alias("trusted"))
    pages = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("req_id"), F.col("l_suppkey").alias("host"), F.col("l_quantity").alias("value"), "trusted", "l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    route = F.when(F.col("l_returnflag") == "A", "A").when(F.col("l_returnflag") == "R", "B")
    rank = fuse.page_rank(F.col("trusted"), route, F.lit(False), F.struct("host", "l_orderkey", "l_linenumber", "value", "l_extendedprice"))
    best = pages.groupBy("req_id").agg(F.min(F.struct(rank.alias("rank"), "host", "value", "trusted")).alias("w")).select("req_id", "w.host", "w.value", "w.trusted")
    agree = text.numbers_agree(F.col("w.value"), F.col("v.value"))
    out = fuse.corroborated(best, pages.select("req_id", "host", "value"), agree, ["req_id"])
    yes, fine = F.lit(True), F.lit(False)
    return out.select(
        "req_id", "value", "host", "trusted", "n_hosts",
        fuse.reliability(yes, F.col("trusted"), F.col("corroborated"), fine).alias("reliability"),
        fuse.provenance(yes, F.col("trusted"), F.col("n_hosts"), fine).alias("provenance"),
    )


@query("""
with p as (select l_orderkey as req_id, l_discount, l_tax, l_quantity, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, l_discount > 0.02 as a, l_tax > 0.02 as b, l_quantity > 10 as c from lineitem)
select req_id, (array_agg(l_discount order by pos) filter (a))[1] as discount, (array_agg(l_tax order by pos) filter (b))[1] as tax, (array_agg(l_quantity order by pos) filter (c))[1] as quantity,
  min(pos) filter (a) as discount_pos, min(pos) filter (b) as tax_pos from p group by req_id
""")
def fill_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of three fields the first value in rank order that isn't empty, each from its own page."""
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    keep = lambda c, least: F.when(F.col(c) > least, F.col(c)).cast("string")
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("req_id"), pos.cast("long").alias("pos"), keep("l_discount", 0.02).alias("discount"), keep("l_tax", 0.02).alias("tax"), keep("l_quantity", 10).alias("quantity"))
    out = fuse.fill(pages, F.struct("pos"), ("discount", "tax", "quantity"))
    number = lambda c: F.col(c).cast("double").alias(c)
    return out.select("req_id", number("discount"), number("tax"), number("quantity"), F.col("discount_rank.pos").alias("discount_pos"), F.col("tax_rank.pos").alias("tax_pos"))


@query("""
with p as (select *, l_discount > 0 as full_, coalesce(sum((l_discount > 0)::int) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey rows between unbounded preceding and 1 preceding), 0) as before from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey from p where before < 2
""")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of an order that are read when reading stops after two with a discount."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return candidates.read_until(lines, F.col("l_discount") > 0, 2, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"]).drop("l_discount")


@query("""
with f as (select l_partkey as req_id, count(distinct l_returnflag || l_linestatus) as n_fields from lineitem group by l_partkey having count(distinct l_returnflag || l_linestatus) < 6),
s as (select distinct l_partkey as req_id, l_suppkey as host from lineitem where l_linenumber = 1),
c as (select distinct l_partkey as req_id, l_suppkey as host from lineitem join f on f.req_id = l_partkey),
n as (select c.*, row_number() over (partition by c.req_id order by c.host) as n from c where not exists (select 1 from s where s.req_id = c.req_id and s.host = c.host))
select n.req_id, n.host, n.n::int as n, f.n_fields::bigint as n_fields from n join f using (req_id) where n <= 3
""")
def rescue_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that are covered badly, with up to three suppliers not seen yet."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("req_id"), F.col("l_suppkey").alias("host"), "l_linenumber", F.concat("l_returnflag", "l_linestatus").alias("field"))
    poor = candidates.needing_rescue(lines, 6)
    more = lines.join(poor, "req_id").select("req_id", "host", "n_fields").distinct()
    return candidates.new_hosts(more, lines.where("l_linenumber = 1"), ["req_id", "host"], ["host"], 3).select("req_id", "host", "n", "n_fields")


@query("""
with l as (select user_id, event_type, min(event_id) as pos from events group by user_id, event_type), v as (select user_id, event_type from l where pos % 2 = 0),
x as (select l.* from l anti join v on v.user_id = l.user_id and v.event_type = l.event_type)
select u.user_id, coalesce((select string_agg(event_type, ' | ' order by pos) from x where x.user_id = u.user_id), '') as links, coalesce((select count(*) from x where x.user_id = u.user_id), 0)::int as n from (select distinct user_id from events) u
""")
def audit_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's links without the verified ones, in order, at most eight, as one text."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("pos"))
    item = F.struct("pos", F.col("event_type").alias("url"))
    # A user has at most as many links as there are event types.
    rows = first.groupBy("user_id").agg(F.collect_list(F.when(F.col("pos") % 2 != 0, item)).alias("links"))
    return rows.select("user_id", export.joined_links(F.col("links"), 8).alias("links"), F.least(F.size("links"), F.lit(8)).alias("n"))


@query("""
select user_id, event_type, count(*)::bigint as n from events group by user_id, event_type
""")
def status_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by type."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("""
select o_orderkey, case when n > 0 and o_orderstatus <> 'F' then 'success' when n > 0 then 'page_not_readable' else 'no_source' end as status,
  case when n > 0 then null when o_orderpriority = '1-URGENT' then 'Search failed' else 'Not found' end as failure,
  concat_ws(' + ', case when o_orderstatus = 'O' then 'code' end, case when n > 2 then 'name' end) as basis
from orders left join (select l_orderkey, count(*) as n from lineitem group by l_orderkey) on l_orderkey = o_orderkey
""")
def status_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, reason of failure and basis of orders as requests with line items as pages."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    verified = F.col("n") > 0
    return rows.select(
        "o_orderkey",
        fuse.status(verified & (F.col("o_orderstatus") != "F"), verified).alias("status"),
        export.failed_status(F.col("o_orderpriority") == "1-URGENT", F.col("n")).alias("failure"),
        export.link_basis(F.col("o_orderstatus") == "O", F.col("n") > 2, F.lit(False)).alias("basis"),
    )
