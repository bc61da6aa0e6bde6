"""Queries over images: ranking, near-duplicates by hash, ownership of URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery import config
from gleanery.operators import images
from gleanery.plans.base import query
from gleanery.sources.tables import table

#: Signs of a vector's numbers as two halves of 32 bits.
_HALVES = ", ".join(f"list_sum(list_transform(range(1, 33), lambda i: case when embedding[i + {at}] > 0 then 1::bigint << (i - 1) else 0 end))::bigint as h{at}" for at in (0, 32))
_APART = "bit_count(xor({0}.h0, {1}.h0)) + bit_count(xor({0}.h32, {1}.h32))"


def _hash() -> Column:
    """The signs of the sixty-four numbers as bits."""
    bits = F.transform(F.slice("embedding", 1, 64), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(bits, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


@query("""
with s as (select p_partkey, p_brand, case p_size % 4 when 0 then 100 when 1 then 75 when 2 then 60 else 30 end + least(20, p_retailprice / 75) + 40 * (p_size / 50.0) as score from part),
r as (select *, row_number() over (partition by p_brand order by score desc, p_partkey) as n from s)
select p_brand, p_partkey, round(score, 6) as score, n::int as n from r where n <= 2
""")
def image_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images: the two best of each brand by source, size and match."""
    source = F.when(F.col("p_size") % 4 == 0, "jsonld_retailer").when(F.col("p_size") % 4 == 1, "shopping_result").when(F.col("p_size") % 4 == 2, "serpapi_strict").otherwise("elsewhere")
    score = images.score(images.priority(source, config.IMAGE_PRIORITY), F.col("p_retailprice"), F.col("p_size") / 50)
    n = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("score"), "p_partkey"))
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", score.alias("score"))
    return rows.withColumn("n", n).where("n <= 2").withColumn("score", F.round("score", 6))


@query(f"""
with h as materialized (select vec_id, label, {_HALVES} from embeddings),
a as materialized (select h.* from h join (select label, min(vec_id) as vec_id from h group by label) using (label, vec_id)),
b as materialized (select h.* from h join (select h.label, min(h.vec_id) as vec_id from h join a on a.label = h.label where {_APART.format("a", "h")} >= 5 group by h.label) using (label, vec_id)),
c as (select h.label, min(h.vec_id) as vec_id from h join a on a.label = h.label join b on b.label = h.label where {_APART.format("a", "h")} >= 5 and {_APART.format("b", "h")} >= 5 group by h.label)
select label, vec_id, 1 as n from a union all select label, vec_id, 2 from b union all select label, vec_id, 3 from c
""")
def phash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three vectors of each label whose hashes differ in five bits from each better one picked."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.lit(1.0).alias("score"), _hash().alias("hash"))
    return images.pick_distinct(rows, ["label"], "score", "vec_id", "hash", most=3)


@query(f"""
with h as (select vec_id, label, {_HALVES} from embeddings)
select a.vec_id, b.vec_id as other, ({_APART.format("a", "b")})::int as distance from h a join h b on a.label = b.label and a.vec_id < b.vec_id and {_APART.format("a", "b")} < 5
""")
def hash_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of images of one label whose hashes differ in fewer than five bits."""
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", _hash().alias("hash"))
    return images.neighbours(rows, ["label"], "vec_id", "hash").select("vec_id", "other", "distance")


@query("""
with u as (select event_id, user_id, props::json->>'k' as url from events), w as (select *, first_value(user_id) over (partition by url order by event_id) as first_owner from u)
select event_id, url, user_id, first_owner, first_owner <> user_id as duplicate from w
""")
def dup_image_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which user has a URL first, and who uses another's."""
    u = table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").alias("url"))
    return images.url_owners(u, "url", "user_id", ["event_id"])


@query("""
select p_partkey, case when p_size % 6 = 0 then 'extension' when p_size < 8 then 'too small' when p_size % 11 = 0 then 'title' when p_size % 5 = 0 and p_partkey % 2 = 1 then 'match'
  when p_size % 5 > 0 and p_size / 50.0 < case when p_partkey % 2 = 0 then 0.35 else 0.55 end then 'match' else 'ok' end as verdict from part
""")
def image_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first check that each image fails."""
    from gleanery.functions import text, urls

    size, trusted = F.col("p_size"), F.col("p_partkey") % 2 == 0
    url = F.concat(F.lit("https://cdn.example/p/"), F.col("p_partkey").cast("string"), F.when(size % 6 == 0, ".svg").otherwise(".jpg"))
    match = F.when(size % 5 == 0, F.lit(-1.0)).otherwise(size / 50)
    title = F.when(size % 11 == 0, "garden hose").otherwise("oat drink")
    out = images.verdict(urls.display_reason(url), urls.image_fault(size * 15, size * 15), text.food_title(title), images.accepted(match, trusted))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("verdict"))
