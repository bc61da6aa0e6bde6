"""Queries over barcodes, names, weights and numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import barcode, numbers, text
from gleanery.operators import fuse, lookups
from gleanery.plans.base import query
from gleanery.sources.tables import table

_WORDS = "list_filter(list_distinct(string_split(trim(regexp_replace(regexp_replace(lower({}), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')), lambda t: length(t) > 3)"


def _line() -> Column:
    code = F.lpad(F.col("o_orderkey").cast("string"), 13, "0")
    return F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("REFRESH "), code, F.lit("  "), F.col("o_orderpriority"))).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.col("o_orderpriority"), F.lit(" "), code, F.lit(" "), F.col("o_orderstatus"))
    ).otherwise(F.concat(F.lit("no code "), F.col("o_orderpriority")))


@query("""
with l as (select o_orderkey, case o_orderkey % 3 when 0 then 'REFRESH ' || lpad(o_orderkey::varchar, 13, '0') || '  ' || o_orderpriority
  when 1 then o_orderpriority || ' ' || lpad(o_orderkey::varchar, 13, '0') || ' ' || o_orderstatus else 'no code ' || o_orderpriority end as line from orders),
r as (select o_orderkey, starts_with(upper(trim(line)), 'REFRESH') as force_refresh, case when starts_with(upper(trim(line)), 'REFRESH') then trim(substr(trim(line), 8)) else trim(line) end as rest from l),
e as (select *, nullif(regexp_extract(rest, '\\b([0-9]{8,14})\\b', 1), '') as ean from r),
g as (select *, trim(regexp_replace(case when ean is null then rest else replace(rest, ean, '') end, '\\s+', ' ', 'g')) as ground_truth from e)
select o_orderkey, ean, ground_truth, force_refresh, case when ground_truth = '' then ean else concat_ws('|', ean, lower(ground_truth)) end as cache_key from g
""")
def request_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request lines made from orders, parsed back."""
    rows = table(spark, sf_dir, "orders").withColumn("line", _line())
    out = rows.select("o_orderkey", *(c.alias(n) for n, c in barcode.parse_line(F.col("line")).items()))
    return out.withColumn("cache_key", barcode.cache_key(F.col("ean"), F.col("ground_truth")))


@query("""
with c as (select p_brand, lpad(p_partkey::varchar, 12, '0') as body, p_size % 10 as given from part),
s as (select p_brand, given, (10 - list_sum(list_transform(range(1, 13), lambda i: (body[13 - i])::int * case when i % 2 = 1 then 3 else 1 end)) % 10) % 10 as want from c)
select p_brand, count(*)::bigint as n_codes, count(*) filter (given = want)::bigint as n_valid from s group by p_brand
""")
def gtin_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid check digits by brand."""
    code = F.concat(F.lpad(F.col("p_partkey").cast("string"), 12, "0"), (F.col("p_size") % 10).cast("string"))
    return table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("n_codes"), F.count_if(barcode.valid(code)).alias("n_valid"))


@query("""
select o_orderkey, count(*)::bigint as n_lines, sum(l_quantity) as quantity from orders join lineitem on o_orderkey = l_orderkey where o_orderkey > 0 group by o_orderkey
""")
def barcode_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero-padded codes met with plain ones."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", barcode.key(F.lpad(F.col("o_orderkey").cast("string"), 13, "0")).alias("k"))
    lines = table(spark, sf_dir, "lineitem").select(barcode.key(F.col("l_orderkey").cast("string")).alias("k"), "l_quantity")
    return orders.join(lines, "k").groupBy("o_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("quantity"))


@query("""
select p_partkey, coalesce(a.s_name, b.s_name) as name, case when a.s_name is not null then 1 when b.s_name is not null then 2 end as tier
from part left join (select * from supplier where s_suppkey % 3 = 0 and s_suppkey > 0) a on p_partkey = a.s_suppkey left join (select * from supplier where s_suppkey % 2 = 0 and s_suppkey > 0) b on p_partkey = b.s_suppkey
""")
def registry_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two registries: the second counts only where the first knows nothing."""
    parts = table(spark, sf_dir, "part").select("p_partkey", F.lpad(F.col("p_partkey").cast("string"), 13, "0").alias("ean"))
    known = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("string").alias("ean"), F.col("s_name").alias("name"))
    out = lookups.with_registries(parts, known.where("s_suppkey % 3 = 0"), known.where("s_suppkey % 2 = 0"))
    return out.select("p_partkey", "name", "tier")


@query(f"""
with t as (select doc_id, lang, {_WORDS.format("coalesce(text, '')")} as ts from documents)
select lang, count(*)::bigint as n_docs, sum(len(ts))::bigint as n_tokens, max(len(ts))::bigint as most from t group by lang
""")
def sig_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct significant words of documents, by language."""
    n = F.size(text.tokens(F.col("text"))).cast("long")
    return table(spark, sf_dir, "documents").select("lang", n.alias("n")).groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_tokens"), F.max("n").alias("most"))


@query(f"""
with h as (select page_id, trim(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g')) as name, lower(regexp_replace(html, '<[^>]+>', ' ', 'g')) as body from pages),
p as (select a.page_id, a.body, {_WORDS.format("a.name")} as own, coalesce({_WORDS.format("b.name")}, []) as other from h a left join h b on b.page_id = a.page_id + 1),
r as (select page_id, case when len(own) > 0 then len(list_filter(own, lambda t: contains(body, t))) / len(own)::double else 0 end as own_ratio,
  case when len(other) > 0 then len(list_filter(other, lambda t: contains(body, t))) / len(other)::double else 0 end as other_ratio, len(other) = 0 as free from p)
select page_id, round(own_ratio, 6) as own_ratio, round(greatest(own_ratio, other_ratio), 6) as best_ratio, (free or other_ratio >= 0.3) as relevant from r
""")
def name_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's words against its own name and its successor's; the last page has no other."""
    name = F.trim(F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " "))
    h = table(spark, sf_dir, "pages").select("page_id", name.alias("name"), F.regexp_replace("html", r"<[^>]+>", " ").alias("body"))
    p = h.join(h.select((F.col("page_id") - 1).alias("page_id"), F.col("name").alias("other")), "page_id", "left")
    both = F.array("name", "other")
    return p.select(
        "page_id",
        F.round(text.name_ratio(F.col("name"), F.col("body")), 6).alias("own_ratio"),
        F.round(text.best_ratio(both, F.col("body")), 6).alias("best_ratio"),
        text.relevant(F.col("other"), F.col("body"), F.lit("")).alias("relevant"),
    )


@query("""
with t as (select p_partkey, case p_partkey % 4 when 0 then p_name || ' 6 x ' || p_size || ' g' when 1 then p_name || ' ' || p_size || ',5 ml (pack of 3)' when 2 then p_name || ' ' || p_size || 'KG' else p_name end as s,
  p_partkey % 4 as k, p_size, p_name from part)
select p_partkey, case k when 0 then p_name || ' ' || p_size || ' g' when 1 then p_name || ' ' || p_size || ',5 ml' when 2 then p_name || ' ' || p_size || 'KG' else p_name end as bare,
  case k when 0 then p_size || 'g' when 1 then p_size || ',5ml' when 2 then p_size || 'kg' end as weight,
  coalesce(k in (0, 1, 2) and not (k = 0 and p_size = 20), false) as conflict from t
""")
def weight_hint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack notations off, unit sizes read, and whether a size differs from 20 g."""
    k, size, name = F.col("p_partkey") % 4, F.col("p_size").cast("string"), F.col("p_name")
    s = F.when(k == 0, F.concat(name, F.lit(" 6 x "), size, F.lit(" g"))).when(k == 1, F.concat(name, F.lit(" "), size, F.lit(",5 ml (pack of 3)"))).when(k == 2, F.concat(name, F.lit(" "), size, F.lit("KG"))).otherwise(name)
    rows = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    return rows.select("p_partkey", text.without_packs(F.col("s")).alias("bare"), text.weight(F.col("s")).alias("weight"), text.weights_conflict(F.array(F.lit("cocoa 20 g")), F.col("s")).alias("conflict"))


@query("""
with w as (select p_partkey, string_split(upper(p_name[1]) || p_name[2:] || ' ' || p_brand, ' ') as ws from part),
b as (select p_partkey, list_filter(ws, lambda w: length(w) >= 3 and regexp_matches(w, '^[A-Z]') and lower(w) not in ('mix', 'bio', 'organic', 'product', 'item', 'food', 'snack', 'pack', 'bag', 'box', 'latte', 'limone', 'miele')
  and not regexp_matches(replace(w, '.', ''), '^[0-9]+$'))[1] as brand from w)
select p_partkey, brand, coalesce(length(regexp_replace(lower(brand), '[^a-z0-9]', '', 'g')) >= 4 and contains('shop.brand12.almond.example', regexp_replace(lower(brand), '[^a-z0-9]', '', 'g')), false) as in_host from b
""")
def brand_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The brand in a product's name, and whether it stands in a host."""
    named = F.concat(F.upper(F.substring("p_name", 1, 1)), F.substring(F.col("p_name"), F.lit(2), F.length("p_name")), F.lit(" "), F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.brand(named).alias("brand"))
    return rows.withColumn("in_host", text.brand_in_host(F.col("brand"), F.lit("shop.brand12.almond.example")))


@query("""
with n as (select doc_id, string_split(coalesce(text, ''), chr(10))[1] as s from documents)
select doc_id, length(trim(lower(s))) < 3 or starts_with(trim(lower(s)), 'http') or starts_with(trim(lower(s)), 'www.') or regexp_matches(trim(lower(s)), 'upc lookup|ninguno|^lookup |barcode\\s+\\d|unknown product|^no\\s+(name|product)|^[\\d\\s#]+$|#####') as garbage,
  not regexp_matches(lower(s), 'hardware|tool|screw|bolt|nut |drill|plumb|pipe|furniture|sofa|chair|table|bed |bath|shower|toilet|clothing|shirt|shoe|dress|jacket|electronic|laptop|phone|cable|printer|router|paint|roller|brush|wallpaper|vehicle|car |truck|tyre|tire|garden|plant|flower|seed |safari|tour|travel|lodge|camp |wildlife') as food,
  trim(split_part(split_part(s, '-', 1), '|', 1)) as name from n
""")
def garbage_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First lines as names: garbage, food, and cut at hyphen and bar."""
    s = F.split_part(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(1))
    rows = table(spark, sf_dir, "documents").select("doc_id", s.alias("s"))
    return rows.select("doc_id", text.garbage_name(F.col("s")).alias("garbage"), text.food_title(F.col("s")).alias("food"), text.name_from_title(F.col("s")).alias("name"))


_SHAPES = ("{0}.{1} g", "{0},{1} g", "ca. {0},{1}", "{0}", "1.{0}.{1}", "x {0},{1}00 kJ")


@query("""
with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (floor(l_quantity)::bigint % 100)::varchar as a, lpad((floor(l_extendedprice)::bigint % 100)::varchar, 2, '0') as b, (l_orderkey + l_linenumber) % 6 as k from lineitem),
n as (select *, case k when 0 then (a || '.' || b)::double when 1 then (a || '.' || b)::double when 2 then (a || '.' || b)::double when 3 then a::double when 4 then ('1' || a || b)::double
  else case when length(a || '') <= 3 and length(b || '00') = 3 then (a || b || '00')::double else (a || '.' || b || '00')::double end end as v from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, v as number, case when abs(v - round(v)) < 1e-9 then round(v)::bigint::varchar else rtrim(rtrim(v::decimal(30,3)::varchar, '0'), '.') end as shown from n
""")
def number_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers written in six ways, read back and written plainly."""
    a, b = (F.floor("l_quantity") % 100).cast("string"), F.lpad((F.floor("l_extendedprice") % 100).cast("string"), 2, "0")
    k, shape = (F.col("l_orderkey") + F.col("l_linenumber")) % 6, F.lit(None).cast("string")
    for i, s in enumerate(_SHAPES):
        pieces = [F.lit(x) if x not in ("0", "1") else (a, b)[int(x)] for x in s.replace("{", "\0").replace("}", "\0").split("\0") if x] if i != 4 else [F.lit("1."), a, F.lit("."), b]
        shape = F.when(k == i, F.concat(*pieces)).otherwise(shape)
    v = numbers.to_double(F.col("s"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", shape.alias("s")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", v.alias("number"), numbers.text_of(v).alias("shown"))


@query("""
with q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 20 as v, (l_orderkey + l_linenumber) % 4 as k from lineitem)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case k when 0 then v when 1 then v * 4.184 when 2 then case when v > 400 then v else v * 4.184 end end, 6) as kj,
  round(case k when 3 then v / 1000 * 2.5 else v * 2.5 end, 6) as salt, case when k < 3 and v <= 100 then v end as within from q
""")
def unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities as kJ, kcal, bare numbers and mg: energy, salt and range."""
    k = (F.col("l_orderkey") + F.col("l_linenumber")) % 4
    unit = F.when(k == 0, " kJ").when(k == 1, " kcal").when(k == 2, "").otherwise(" mg")
    s = F.concat((F.col("l_quantity") * 20).cast("bigint").cast("string"), unit)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", k.alias("k"), s.alias("s"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(F.when(F.col("k") < 3, numbers.energy_kj(F.col("s"))), 6).alias("kj"),
        F.round(numbers.salt_g(F.col("s")), 6).alias("salt"),
        F.when(F.col("k") < 3, numbers.bounded(F.lit("fat_g"), numbers.to_double(F.col("s")))).alias("within"),
    )


def _nutrition() -> dict[str, Column]:
    return {
        "fat_g": F.col("l_quantity"), "carbohydrates_g": F.col("l_quantity") * 0.8, "protein_g": F.col("l_discount") * 300, "saturates_g": F.when(F.col("l_linenumber") == 2, F.col("l_quantity") + 1),
        "sugars_g": F.when(F.col("l_linenumber") == 3, F.col("l_quantity")), "energy_kj": F.when(F.col("l_linenumber") >= 4, F.col("l_tax") * 10_000), "fiber_g": F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 2),
    }


_FACTS = """select l_orderkey, l_linenumber, l_quantity as fat, l_quantity * 0.8 as carb, l_discount * 300 as prot, case when l_linenumber = 2 then l_quantity + 1 end as sat,
  case when l_linenumber = 3 then l_quantity end as sug, case when l_linenumber >= 4 then l_tax * 10000 end as kj, case when l_linenumber = 1 then l_quantity * 2 end as fib from lineitem"""


@query(f"""
with f as ({_FACTS}),
r as (select case when fat + carb + prot > 100.5 then 'macro sum' when sat > fat + 0.5 then 'saturates over fat' when sug > carb + 0.5 then 'sugars over carbohydrates'
  when kj > 0 and (9 * fat + 4 * carb + 4 * prot + 2 * coalesce(fib, 0)) * 4.184 > greatest(kj * 3, kj + 800) then 'energy under macros'
  when fat > 100 then 'fat_g over 100' when carb > 100 then 'carbohydrates_g over 100' when prot > 92 then 'protein_g over 92' when sug > 100 then 'sugars_g over 100' when sat > 100 then 'saturates_g over 100'
  when fib > 90 then 'fiber_g over 90' when kj > 4000 then 'energy_kj over 4000' end as reason from f)
select coalesce(reason, 'plausible') as reason, count(*)::bigint as n from r group by 1
""")
def plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why nutrition made from line items can't be right, counted."""
    rows = table(spark, sf_dir, "lineitem").select(F.coalesce(fuse.implausible(_nutrition()), F.lit("plausible")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""
with f as ({_FACTS}),
t as (select concat_ws(',', case when sug <= case when l_linenumber % 2 = 0 then 2.5 else 5 end then 'low sugar' end, case when fat <= case when l_linenumber % 2 = 0 then 1.5 else 3 end then 'low fat' end,
  case when prot * 4 * 4.184 > 0.2 * kj then 'high protein' end) as tags from f)
select tags, count(*)::bigint as n from t group by tags
""")
def nutrient_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims that follow from numbers, counted."""
    return table(spark, sf_dir, "lineitem").select(fuse.tags(_nutrition(), F.col("l_linenumber") % 2 == 0).alias("tags")).groupBy("tags").agg(F.count("*").alias("n"))


@query("""
with a as (select p_partkey, p_name, list_filter(list_distinct(string_split(p_name, ' ')), lambda t: length(t) > 3) as ws, p_retailprice as v from part),
b as (select p_partkey - 1 as p_partkey, p_name as other_name, ws as other, v as w from a)
select a.p_partkey, abs(v - w) <= greatest(0.5, 0.03 * greatest(v, w)) as numbers, p_name = other_name or (len(ws) > 0 and len(other) > 0
  and len(list_intersect(ws, other)) >= 0.8 * greatest(len(ws), len(other))) as texts from a join b on a.p_partkey = b.p_partkey
""")
def values_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's price and name against its successor's."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    n = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"), F.col("p_retailprice").alias("w"))
    return p.join(n, "p_partkey").select("p_partkey", text.numbers_agree(F.col("p_retailprice"), F.col("w")).alias("numbers"), text.texts_agree(F.col("p_name"), F.col("other")).alias("texts"))


@query("""
select p_partkey, case when p_size % 5 = 0 then '' else p_brand end as brand, case when p_size % 7 = 0 then '' else p_size || ' kJ / ' || case when abs(p_size / 4.184 - round(p_size / 4.184)) < 0.05 then round(p_size / 4.184)::bigint::varchar
  else round((p_size / 4.184)::decimal(30,9), 1)::decimal(30,1)::varchar end || ' kcal' end as energy, p_partkey::varchar as code from part
""")
def export_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sanitised export with energy in both units, columns by cluster."""
    from gleanery.operators import export

    words = F.when(F.col("p_size") % 10 == 0, "null").when(F.col("p_size") % 5 == 0, F.lit(None)).otherwise(F.col("p_brand"))
    kj = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.col("p_size").cast("string"))
    rows = export.sanitised(table(spark, sf_dir, "part").select("p_partkey", words.alias("brand"), numbers.energy_label(kj).alias("energy"), F.col("p_partkey").alias("code")))
    return rows.select(*export.ordered(rows.columns, [["p_partkey", "brand"], ["energy"]])).withColumn("p_partkey", F.col("p_partkey").cast("long"))


