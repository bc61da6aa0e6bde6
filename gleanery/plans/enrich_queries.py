"""The whole enrichment as a query: parts as requests, with pages made for them on three hosts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.config import Settings
from gleanery.plans.base import query
from gleanery.plans.enrich import enrich
from gleanery.sources.tables import dealt, table

#: Which of its three pages a part has, and what each page tells.
_THERE = "case k when 0 then p_partkey % 3 = 0 when 1 then p_partkey % 5 > 0 else p_partkey % 2 = 0 end"
_FACTS = {
    "fat": "case when k < 2 then p_size * 0.5 when p_partkey % 7 > 0 then p_size * 0.5 + case when p_partkey % 4 = 0 then 0 else 30 end end",
    "protein": "case when k = 1 then case when p_partkey % 11 = 0 then 90 else 2 end when k = 0 and p_partkey % 9 = 0 then 3 end",
    "salt": "case when k = 2 then 1 end",
}
_HOSTS = ("trusted.example", "a.example", "b.example")


@query(f"""
with g as (select p_partkey as req_id, k, ['{"', '".join(_HOSTS)}'][k + 1] as host, {", ".join(f"({e})::double as {f}" for f, e in _FACTS.items())} from part, unnest(range(3)) u(k) where {_THERE} and p_partkey > 0),
p as (select *, (fat is not null)::int + (protein is not null)::int + (salt is not null)::int >= 2 as readable,
  k = min(case when fat is not null then k end) over w or k = min(case when protein is not null then k end) over w or k = min(case when salt is not null then k end) over w as gave from g window w as (partition by req_id)),
r as (select req_id, bool_or(readable) as readable, bool_or(readable and k = 0) as trusted, arg_min(fat, k) as fat, arg_min(protein, k) as protein, arg_min(salt, k) as salt from p group by req_id),
i as (select *, coalesce(fat, 0) + coalesce(protein, 0) > 100.5 as bad from r),
n as (select req_id, field, count(*) as n from (select i.req_id, unnest([case when p.fat = i.fat then 1 end, case when p.protein = i.protein then 2 end, case when p.salt = i.salt then 3 end]) as field
  from i join p on p.req_id = i.req_id where not bad and p.readable and p.k > 0) where field is not null group by req_id, field),
h as (select req_id, max(n) as n from n group by req_id),
l as (select req_id, string_agg('https://' || host || '/p/' || req_id, ' ' order by k) as links from (select *, row_number() over (partition by req_id order by k) as n from p where readable or gave) where n <= 2 group by req_id)
select p_partkey as req_id, case when not bad then rtrim(rtrim(printf('%.3f', fat), '0'), '.') end as fat_g, case when not bad then protein::int::varchar end as protein_g, case when not bad then salt::int::varchar end as salt_g,
  case when readable then 'success' when i.req_id is not null then 'page_not_readable' else 'no_source' end as status, case when readable then case when bad then 'L' when trusted then 'H' when h.n >= 2 then 'M' else 'L' end end as reliability,
  case when not coalesce(readable, false) then 'none' else case when trusted then 'trusted source' when h.n >= 2 then h.n || ' sources agree' else 'single source' end || case when bad then '; nutrition withheld' else '' end end as provenance,
  case when bad then 'macro sum' end as implausible, coalesce(links, '') as links
from part left join i on i.req_id = p_partkey left join h on h.req_id = p_partkey left join l on l.req_id = p_partkey
""")
def enrich_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts enriched from pages that agree, contradict one another, are thin, or can't be right."""
    part = dealt(table(spark, sf_dir, "part"), "p_partkey", 10_000).select("p_partkey", "p_name", "p_size", F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"))
    requests = part.select(F.col("p_partkey").alias("req_id"), "ean", F.col("p_name").alias("name"), F.lit("").alias("ground_truth"))
    there = part.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2)))).where(F.expr(_THERE))
    url = F.concat(F.lit("https://"), F.element_at(F.array(*map(F.lit, _HOSTS)), F.col("k") + 1), F.lit("/p/"), F.col("p_partkey").cast("string"))
    rows = [F.concat(F.lit(f"<tr><td>{name.title()}</td><td>"), F.expr(f"cast({e} as double)").cast("string"), F.lit(" g</td></tr>")) for name, e in _FACTS.items()]
    html = F.concat(F.lit('<script type="application/ld+json">{"gtin13":"'), "ean", F.lit('"}</script><table>'), F.concat_ws("", *rows), F.lit("</table>"))
    made = there.select(F.col("p_partkey").alias("req_id"), F.col("k").alias("pos"), url.alias("url"), html.alias("html"))
    out = enrich(requests, made.select("req_id", "pos", "url"), made.select("url", "html"), Settings(trusted_hosts=(_HOSTS[0],)))
    return out.select("req_id", "fat_g", "protein_g", "salt_g", "status", "reliability", "provenance", "implausible", F.array_join("source_links", " ").alias("links"))
