"""The ladders as queries: parts as requests, with search results, pages and images made for them by arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Settings
from gleanery.operators import export, ladders, models
from gleanery.plans.base import query
from gleanery.sources.tables import dealt, table

_SETTINGS = Settings(trusted_hosts=("trusted.example",))
#: A part k is asked by name unless k % 5 = 0. h spreads what a result (k, step, rank) is; searches 3 and 6 fail for some parts.
_H = "(k * 31 + step * 17 + rank * 7 + (k + step) * rank) % 60"
_FAILS = "(step = 3 and k % 6 = 1 or step = 6 and k % 4 = 3)"
_HOST = "case h % 4 when 0 then 'www.brand' || (k % 7) || '.example' when 1 then 'shop' || (h % 9) || '.example' when 2 then 'trusted.example' else 'www.amazon.com' end"
_TITLE = "case when h % 3 = 0 then 'Brand' || (k % 7) || ' oat drink ' || case when h % 2 = 0 then '330' else '500' end || ' ml - Shop' when h % 3 = 1 then 'Barcode 123' when h % 15 = 2 then 'Garden drink | x' else 'Other thing | x' end"

#: What the results are, told once for both ladders: f has a row for each place, ordered by o.
_RESULTS = f"""
g as (select k, step, rank, {_H} as h, k % 5 > 0 as asked, {_FAILS} as fails from (select p_partkey as k from part where p_partkey > 0), unnest(range(8)) a(step), unnest(range(6)) b(rank)),
f as (select *, step * 10 + rank as o, h % 4 = 0 and asked as brand, h % 4 < 3 as allowed, h % 5 = 0 as code, h % 3 = 1 as garbage, not asked or h % 3 = 0 or h % 15 = 2 as relevant,
  h % 4 = 2 or h % 4 = 0 and asked as trusted, h % 3 = 0 and h % 2 = 1 as conflict, case when h % 3 = 0 then 1.0 when h % 15 = 2 then 0.5 else 0 end as ratio, h % 6 = 0 as proven,
  case when h % 3 = 0 then 'Brand' || (k % 7) || ' oat drink ' || case when h % 2 = 0 then '330' else '500' end || ' ml' when h % 3 = 1 then 'Barcode 123' when h % 15 = 2 then 'Garden drink' else 'Other thing' end as t,
  'https://' || {_HOST} || '/p/' || k || '/' || h as link from g where not fails)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    # Each row becomes a hundred, which are sorted in its task.
    part = dealt(table(spark, sf_dir, "part"), "p_partkey", 2_000).select(F.col("p_partkey").alias("k")).where("k > 0")
    known = k % 4 == 0
    asked = F.when(k % 5 > 0, F.concat(F.lit("Brand"), (k % 7).cast("string"), F.lit(" oat drink (4 Pack), 4x330 ml"))).otherwise("")
    return part.select(k.alias("req_id"), F.concat(F.lit("7"), F.lpad(k.cast("string"), 12, "0")).alias("ean"), asked.alias("ground_truth"), F.when(known, F.concat(F.lit("Registry name "), k.cast("string"))).alias("name"), known.alias("verified"))


def _made(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    requests = _requests(spark, sf_dir)
    rows = requests.select(F.col("req_id").alias("k"), "ean", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(5))))
    rows = rows.withColumn("h", F.expr(_H)).withColumn("link", F.concat(F.lit("https://"), F.expr(_HOST), F.lit("/p/"), F.col("k").cast("string"), F.lit("/"), F.col("h").cast("string")))
    there = F.expr(f"not {_FAILS}")
    names = F.element_at(F.array(*map(F.lit, ladders.STEPS)), F.col("step") + 1)
    snippet = F.when(F.col("h") % 5 == 0, F.concat(F.lit("code "), "ean", F.lit(" here"))).otherwise("none")
    landed = [F.when(there, c).alias(n) for c, n in ((F.col("link"), "link"), (F.expr(_TITLE), "title"), (snippet, "snippet"))]
    results = rows.where(there | (F.col("rank") == 0)).select(F.col("k").alias("req_id"), names.alias("step"), "rank", *landed, F.when(~there, 429).alias("error"))
    pages = rows.where(there & (F.col("h") % 6 == 0)).groupBy(F.col("link").alias("url")).agg(F.concat(F.lit("<p>EAN: "), F.min("ean"), F.lit("</p>")).alias("html"))
    return requests, results, pages


@query(f"""
with {_RESULTS},
p as (select * from f where rank < case when step < 3 then 5 else 4 end and step < 7 and case step when 0 then asked and allowed and brand when 1 then asked and allowed and code
  when 2 then true when 3 then true when 4 then relevant else asked and allowed and not garbage end),
q as (select *, row_number() over (partition by k, step order by rank) as nth from p),
n as (select *, allowed and row_number() over (partition by k, allowed, link order by o) = 1 as fresh from q where step > 0 or nth = 1),
b as (select *, coalesce(sum(fresh::int) over (partition by k order by step range between unbounded preceding and 1 preceding), 0) as before from n),
t as (select *, step in (0, 5, 6) or step = 1 and not garbage or step = 3 and rank = 0 and not garbage as names from b where step < 4 or before < 4),
r as (select k, arg_min(case when names then t end, case when names then o end) as name, bool_or(step = 1) as verified, string_agg(case when fresh then link end, ' ' order by o) as links, count(*) filter (where fresh) as n_links from t group by k)
select p_partkey as req_id, case when p_partkey % 4 = 0 then 'Registry name ' || p_partkey else r.name end as name, p_partkey % 4 = 0 or coalesce(r.verified, false) as verified, coalesce(links, '') as links, coalesce(n_links, 0) as n_links
from part left join r on k = p_partkey where p_partkey > 0
""")
def discover_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to read for each part, from six searches of which the last three depend on what was found."""
    requests, results, _ = _made(spark, sf_dir)
    out = ladders.discover(requests, results, _SETTINGS)
    return out.select("req_id", "name", "verified", F.array_join("links", " ").alias("links"), F.size("links").cast("long").alias("n_links"))


@query(f"""
with {_RESULTS},
s as (select *, case when step < 2 then 5 else 4 end > rank and step <> 2 as within, k % 4 = 0 as known from f),
v as (select *, case when step = 0 then brand and allowed and row_number() over (partition by k, step, brand and allowed order by rank) = 1
  when step = 1 then asked and allowed and not garbage and (code or proven) when step in (3, 4) then allowed and (step = 3 or relevant)
  else asked and allowed and not garbage and (proven or trusted and not conflict and ratio >= 0.6) end as gives,
  case when step = 3 then rank = 0 and not garbage when step = 4 then rank = 0 and not garbage and relevant and trusted and not conflict end as first from s where within),
a as (select *, case when step in (3, 4) then first when step = 0 then gives and proven else gives end as names from v),
w as (select k, min(o) filter (where names) as win from a where not known group by k),
d as (select a.*, win, case when step = 0 then gives when known then false when step in (3, 4) then gives and (win is null or step <= win // 10) else gives and o = win end as takes from a left join w using (k)),
l as (select k, link, min(o) as o, arg_min(step = 0 or step = 1 or step > 4 and proven, o) as front from d where takes group by k, link),
u as (select k, string_agg(link, ' ' order by case when front then -o else o end) as links from l group by k),
c as (select k, bool_or(takes and (step = 1 or proven and step in (0, 5, 6, 7))) as verified, any_value(win) as win, arg_min(t, o) filter (where o = win) as t from d group by k),
e as (select distinct k, step from g where fails),
x as (select e.k, bool_or(k % 4 > 0 and (win is null or win // 10 >= step)) as search_failed from e left join w using (k) group by e.k)
select p_partkey as req_id, case when p_partkey % 4 = 0 then 'Registry name ' || p_partkey when c.t is null or contains(lower(c.t), 'garden') then 'Product with EAN 7' || lpad(p_partkey::varchar, 12, '0') else c.t end as name,
  ['brand', 'name_code', 'aggregator', 'market', 'code', 'name_market', 'name', 'name_plain'][c.win // 10 + 1] as named_by, p_partkey % 4 = 0 or c.verified as verified, coalesce(search_failed, false) as search_failed, coalesce(links, '') as links
from part join c on c.k = p_partkey left join u on u.k = p_partkey left join x on x.k = p_partkey
""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts from registries, searches and landed pages, with which search gave them."""
    requests, results, pages = _made(spark, sf_dir)
    out = ladders.resolve(requests, results, ladders.evidence(requests, results, pages), _SETTINGS)
    return out.withColumn("links", F.array_join("links", " "))


@query("""
with k as (select p_partkey as k, p_partkey % 5 > 0 as asked, p_partkey % 4 = 0 as known from part where p_partkey > 0)
select k as req_id, case when k % 3 = 0 then 'Search failed' else 'Not found' end as failure from k where not known and k % 10 = 5
""")
def early_exits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that no source knows: neither named, proven, listed nor pictured; a failed search is told apart from a miss."""
    requests, results, pages = _made(spark, sf_dir)
    k = F.col("req_id")
    # Every tenth part that nobody asks by name is without results, but for the search that fails for some of them.
    gone = k % 10 == 5
    landed = results.where(~gone).unionByName(requests.where(gone & (k % 3 == 0)).select("req_id", F.lit("code").alias("step"), F.lit(0).alias("rank"), *(F.lit(None).cast("string").alias(c) for c in ("link", "title", "snippet")), F.lit(503).alias("error")))
    out = ladders.resolve(requests, landed, ladders.evidence(requests, landed, pages), _SETTINGS)
    out = out.join(requests.select("req_id", F.col("verified").alias("known")).hint("merge"), "req_id")
    early = export.ends_early(F.col("name"), F.col("verified"), F.col("known"), F.when(gone, 0).otherwise(1), ladders.PLACEHOLDER)
    return out.where(early).select("req_id", export.failed_status(F.col("search_failed"), F.size("links")).alias("failure"))


@query("""
select p_partkey, case when p_size % 3 = 0 then 'Success' else 'Failed Validation' end as status, case when p_size % 3 = 0 then ['H', 'M', 'L', 'L'][p_partkey % 4 + 1] else 'L' end as reliability,
  case when p_size % 3 = 1 then 'Verified page(s) found but not readable (JS/cookie wall) — no field is shown without a readable source behind it.'
  when p_size % 3 = 2 then 'No verified source page could be read for this EAN — no field is shown without a readable source behind it.'
  when p_partkey % 4 = 0 then 'Confirmed by a trusted source (the brand''s own site or a tier-1 retailer) — ' || s || '.'
  when p_partkey % 4 = 1 then 'No trusted (brand/tier-1) source found; the value(s) shown are corroborated across >=2 independent retailer pages — ' || s || '.'
  else 'Only a single non-tier-1 source backs this data, with no corroboration from another retailer — ' || s || '. Verify manually before upload.' end as reasoning
from (select *, case p_partkey % 3 when 0 then '' when 1 then 'a.example' else 'a.example, b.example' end as s from part)
""")
def reliability_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status, reliability and the text that gives the reason, for every state a part can be in."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    status = F.element_at(F.array(*map(F.lit, ("success", "page_not_readable", "no_source"))), F.col("p_size") % 3 + 1)
    level = F.element_at(F.array(F.lit("H"), F.lit("M"), F.lit("L"), F.lit(None)), (k % 4 + 1).cast("int"))
    hosts = F.when(k % 3 == 1, F.array(F.lit("a.example"))).when(k % 3 == 2, F.array(*map(F.lit, ("a.example", "b.example", "c.example"))))
    return part.select("p_partkey", export.final_status(status).alias("status"), export.final_reliability(status, level).alias("reliability"), export.reasoning(status, level, hosts).alias("reasoning"))


@query("""
select p_partkey, case when p_partkey % 5 = 0 then '' else p_type end as category, case when p_partkey % 5 = 0 then '' else '["' || p_brand || '","x"]' end as tags, case when p_partkey % 5 in (0, 1) then '' else p_size::varchar end as size from part
""")
def answer_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed columns of classifiers' answers: an object amid other words, lists in it, missing keys, words for none, no object at all."""
    part, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    size = F.when(k % 5 == 1, F.lit("null")).otherwise(F.col("p_size").cast("string"))
    body = F.concat(F.lit('{"category": "'), "p_type", F.lit('", "tags": ["'), "p_brand", F.lit('", "x"], "size": '), size, F.lit("}"))
    said = F.when(k % 5 == 0, F.lit("no answer {")).otherwise(F.concat(F.lit("Here it is:\n"), body, F.lit("\nDone.")))
    return part.select("p_partkey", *models.answer_columns(said, ("category", "tags", "size")))


_IMAGE = "'https://' || case when h % 7 = 3 then 'www.ebay.com' else 'img' || (h % 5) || '.example' end || '/' || k || '/' || (h % 13) || '.jpg'"


@query(f"""
with g as (select k, step, rank, {_H} as h from (select p_partkey as k from part where p_partkey > 0), unnest(range(9)) a(step), unnest(range(13)) b(rank)),
u as (select *, case when h % 4 > 0 then {_IMAGE} else '' end as original, case when h % 12 > 0 then 'https://thumb.example/' || k || '/' || (h % 11) else '' end as thumbnail from g),
f as (select *, case when original = '' then thumbnail else original end as key from u where rank < [1, 8, 10, 13, 12, 12, 6, 6, 1][step + 1] and not contains(original, 'ebay') and (k % 3 > 0 or step = 0)),
d as (select k, key, min(step * 100 + rank) as o from f where key <> '' group by k, key),
p as (select *, row_number() over (partition by k order by o, key) as pos from d)
select k as req_id, pos, key, ['registry_a', 'brand', 'shopping', 'page', 'strict', 'barcode', 'shopping_name', 'last', 'registry_b'][o // 100 + 1] as stage, o % 100 as rank from p where pos <= 20
""")
def image_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images to look at for each part, from nine stages."""
    rows = _requests(spark, sf_dir).select(F.col("req_id").alias("k"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("step")).withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(12))))
    rows = rows.withColumn("h", F.expr(_H))
    stage = F.element_at(F.array(*map(F.lit, ladders.IMAGE_STAGES)), F.col("step") + 1)
    original = F.when(F.col("h") % 4 > 0, F.expr(_IMAGE))
    thumbnail = F.when(F.col("h") % 12 > 0, F.concat(F.lit("https://thumb.example/"), F.col("k").cast("string"), F.lit("/"), (F.col("h") % 11).cast("string")))
    images = rows.select(F.col("k").alias("req_id"), stage.alias("stage"), "rank", original.alias("original"), thumbnail.alias("thumbnail"), F.lit("").alias("title"), F.lit("").alias("domain"))
    named = _requests(spark, sf_dir).select("req_id", (F.col("req_id") % 3 > 0).alias("named"))
    out = ladders.image_candidates(images, named, _SETTINGS)
    return out.select("req_id", F.col("pos").cast("long").alias("pos"), "key", "stage", F.col("rank").cast("long").alias("rank"))
