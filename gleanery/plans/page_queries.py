"""Queries over pages: hosts, gates, titles, text, parsed records, candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import html, urls
from gleanery.operators import candidates, lookups, page_fields, verify
from gleanery.plans.base import query
from gleanery.sources.tables import dealt, table

_TRUSTED = ("example.com", "thther.example.org")
_AGGREGATORS = ("example.net",)


@query("""
select page_id, string_split(url, '/')[3] as host, regexp_replace(url, '^https?:/*[^/]*', '') as path, length(regexp_replace(url, '^https?:/*[^/]*', ''))::int as path_length from pages
""")
def host_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths of pages."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.path(u).alias("path"), F.length(urls.path(u)).alias("path_length"))


@query("""
with h as (select page_id, url, lower(string_split(url, '/')[3]) as host from pages)
select page_id, host, (host = 'example.com' or host like '%.example.com' or host = 'thther.example.org' or host like '%.thther.example.org') as trusted,
  (host = 'example.net' or host like '%.example.net') as aggregator, regexp_matches(lower(url), 'amazon\\.|ebay\\.|aliexpress\\.|alibaba\\.|barcodelookup\\.|go-upc\\.|openfoodfacts\\.org|openfoodfacts\\.net|off\\.') as excluded from h
""")
def trust_tier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts on the trusted and the aggregator list or below one on it, met by equality of suffixes."""
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.lower(urls.host(F.col("url"))).alias("host"))
    trusted = spark.createDataFrame([(h,) for h in _TRUSTED], "host string")
    rows = lookups.with_host_flag(rows, trusted, "trusted")
    rows = rows.withColumn("aggregator", urls.under(F.col("host"), _AGGREGATORS)).withColumn("excluded", urls.excluded(F.col("url")))
    return rows.select("page_id", "host", "trusted", "aggregator", "excluded")


_VARIANTS = ("", "/logo.svg", "/img/thumb-1.jpg", "/a_xs.png", "/media-amazon.com/a,b.jpg", "/products/1.jpg?x=1")


@query("""
with v as (select page_id, k, split_part(url, '?', 1) || ['', '/logo.svg', '/img/thumb-1.jpg', '/a_xs.png', '/media-amazon.com/a,b.jpg', '/products/1.jpg?x=1'][k + 1] as u from pages, unnest(range(6)) t(k)),
g as (select *, lower(u) as low, string_split_regex(split_part(lower(u), '?', 1), '[/_\\-.]+') as ws from v)
select page_id, k::int as k, starts_with(u, 'http') and not regexp_matches(low, 'off\\.|amazon\\.[^c]|amazon\\.c') as displayable, starts_with(u, 'http') as durable,
  case when contains(low, 'amazon.') or contains(low, 'off.') then 'excluded host' when regexp_matches(split_part(low, '?', 1), '\\.(svg|gif|ico|webmanifest|json|xml)$') then 'extension' when contains(low, '_xs.') then 'blocked part'
  when list_has_any(ws, ['logo', 'icon', 'banner', 'placeholder', 'spinner', 'loading', 'payment', 'paypal', 'mastercard', 'visa', 'social', 'pinterest', 'tiktok', 'facebook', 'instagram', 'twitter', 'youtube', 'thumbnail', 'thumb', 'avatar', 'favicon', 'sprite']) then 'path word' end as reason
from g
""")
def url_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates for variants of page URLs, and the strict gate's first reason."""
    kinds = F.posexplode(F.array(*map(F.lit, _VARIANTS))).alias("k", "tail")
    rows = table(spark, sf_dir, "pages").select("page_id", "url", kinds)
    u = F.col("u")
    rows = rows.select("page_id", "k", F.concat(F.split_part(F.col("url"), F.lit("?"), F.lit(1)), F.col("tail")).alias("u"))
    return rows.select("page_id", "k", urls.displayable(u).alias("displayable"), urls.durable(u).alias("durable"), urls.display_reason(u).alias("reason"))


@query("""
select page_id, trim(regexp_replace(concat_ws(' ', nullif(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>([^<]+)</title>', 1), '<[^>]+>', ' ', 'g'), ''),
  nullif(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '')), '\\s+', ' ', 'g')) as title from pages
""")
def title_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and first headings."""
    return table(spark, sf_dir, "pages").select("page_id", html.title_bits(F.col("html")).alias("title"))


@query("""
with t as (select page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) as s from pages)
select page_id, length(s)::int as n_chars, md5(s) as digest, least(length(s), 20000)::int as n_visible from t
""")
def strip_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of pages."""
    rows = table(spark, sf_dir, "pages").select("page_id", html.stripped(F.col("html")).alias("s"), html.visible(F.col("html")).alias("v"))
    return rows.select("page_id", F.length("s").alias("n_chars"), F.md5("s").alias("digest"), F.length("v").alias("n_visible"))


@query("""
select page_id, page_id % 90 + 0.5 as fat_g, case when (page_id % 50) * 41.84 <= 4000 then round((page_id % 50) * 4.184 * 10, 6) end as energy_kj, 'cocoa ' || page_id || ' and milk powder' as ingredients,
  case when page_id % 3 > 0 then 'nuts and soya' end as allergens from pages
""")
def labelled_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled facts in the text of each page with a made sentence behind it."""
    n = F.col("page_id")
    told = F.concat(
        F.lit("Zutaten: cocoa "), n.cast("string"), F.lit(" and milk powder. Fett "), (n % 90).cast("string"), F.lit(",5 g Energie "), (n % 50 * 10).cast("string"),
        F.lit(" kcal. Allergens: "), F.when(n % 3 == 0, "see ingredient list").otherwise("nuts and soya"), F.lit(". Verwendung"),
    )
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat(html.stripped(F.coalesce("html", F.lit(""))), F.lit(" "), told).alias("t"))
    return rows.select(
        "page_id", html.inline_number(F.col("t"), "fat_g").alias("fat_g"), F.round(html.inline_number(F.col("t"), "energy_kj"), 6).alias("energy_kj"), html.ingredients(F.col("t")).alias("ingredients"), html.allergens(F.col("t")).alias("allergens")
    )


@query("""
select p_partkey, p_brand as brand, p_size::varchar as fat_g, case when p_size <= 40 then (p_size * 2.5)::decimal(20,3) end as salt, lpad(p_partkey::varchar, 13, '0') as gtin, case when p_partkey > 0 then 'A' end as route from part
""")
def jsonld_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with linked data made from parts, parsed to records and verified by their code."""
    code = F.lpad(F.col("p_partkey").cast("string"), 13, "0")
    nutrition = F.struct(F.lit("NutritionInformation").alias("@type"), F.concat(F.col("p_size").cast("string"), F.lit(" g")).alias("fatContent"), F.concat(F.when(F.col("p_size") <= 40, F.col("p_size")).cast("string"), F.lit(" g")).alias("sodiumContent"))
    product = F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_brand").alias("name")).alias("brand"), code.alias("gtin13"), nutrition.alias("nutrition"))
    page = F.concat(F.lit('<html><head><script type="application/ld+json">'), F.to_json(product), F.lit("</script></head><body><h1>x</h1></body></html>"))
    rows = page_fields.with_fields(dealt(table(spark, sf_dir, "part"), "p_partkey", 2_000).select("p_partkey", code.alias("ean"), page.alias("html")))
    f = F.col("fields")
    route = verify.route(F.col("html"), F.col("ean"), F.array(F.lit("x")), f["gtins"], F.lit(False))
    return rows.select("p_partkey", f["brand"].alias("brand"), f["fat_g"].alias("fat_g"), f["salt_g"].cast("decimal(20,3)").alias("salt"), F.get(f["gtins"], 0).alias("gtin"), route.alias("route"))


@query("""
with c as (select page_id % 7 as req_id, page_id::bigint as pos, lower(string_split(url, '/')[3]) as host, regexp_replace(url, '^https?:/*[^/]*', '') as path from pages union all
  select page_id % 7, page_id + 100000, lower(string_split(url, '/')[3]), regexp_replace(url, '^https?:/*[^/]*', '') || '/more' from pages where page_id % 3 = 0),
b as (select *, row_number() over (partition by req_id, host order by length(path) desc, pos) as n, min(pos) over (partition by req_id, host) as seen from c),
r as (select *, row_number() over (partition by req_id order by seen) as place from b where n = 1)
select req_id, host, path, pos, place::int as place from r where place <= 12
""")
def best_per_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest page of each host for seven requests, twelve hosts each."""
    u = F.col("url")
    pages = table(spark, sf_dir, "pages").select("page_id", (F.col("page_id") % 7).alias("req_id"), F.lower(urls.host(u)).alias("host"), urls.path(u).alias("path"))
    more = pages.where("page_id % 3 = 0").select("req_id", (F.col("page_id") + 100_000).alias("pos"), "host", F.concat("path", F.lit("/more")).alias("path"))
    rows = pages.select("req_id", F.col("page_id").alias("pos"), "host", "path").union(more)
    return candidates.best_per_host(rows).select("req_id", "host", "path", "pos", "place")


@query("""
with s as (select e.user_id as req_id, event_id % 6 as query_no, row_number() over (partition by e.user_id, event_id % 6 order by event_id) - 1 as rank, 'http://h' || (event_id % 40) || '.example' as link from events e),
f as (select *, row_number() over (partition by req_id, link order by query_no, rank) as n from s where rank < 6),
t as (select req_id, query_no, rank, link, count(*) over (partition by req_id order by query_no range between unbounded preceding and 1 preceding) as before, row_number() over (partition by req_id order by query_no, rank) - 1 as pos from f where n = 1)
select req_id, query_no, rank, link, pos from t where before < 10 and pos < 10
""")
def search_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of six ranked queries for each user, until ten are found."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("req_id", "query_no").orderBy("event_id")) - 1
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("req_id"), (F.col("event_id") % 6).alias("query_no"), "event_id", F.concat(F.lit("http://h"), (F.col("event_id") % 40).cast("string"), F.lit(".example")).alias("link"))
    out = candidates.ladder(e.withColumn("rank", rank).drop("event_id"))
    return out.select("req_id", "query_no", F.col("rank").cast("long").alias("rank"), "link", F.col("pos").cast("long").alias("pos"))
