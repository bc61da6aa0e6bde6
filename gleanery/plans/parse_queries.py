"""Queries over pages made from parts, one for each reader of the page parser; SQL says what each page tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import page_fields
from gleanery.plans.base import query
from gleanery.sources.tables import dealt, table


def _parsed(spark: SparkSession, sf_dir: str, page: str, *columns: str) -> DataFrame:
    """The part table's pages, made by a SQL expression, as records with some of their fields."""
    rows = dealt(table(spark, sf_dir, "part"), "p_partkey", 2_000).select("p_partkey", F.expr(page).alias("html"))
    f = F.col("fields")
    pick = {"gtins": F.array_join(f["gtins"], ",")}
    return page_fields.with_fields(rows).select("p_partkey", *(pick.get(c, f[c]).alias(c) for c in columns))


_SHOWN = "rtrim(rtrim(printf('%.3f', {}), '0'), '.')"


@query(f"""
select p_partkey, case when p_size % 5 > 0 then p_brand end as brand, case when p_partkey % 2 = 0 then p_size || '.5' else p_size::varchar end as net_weight, case when p_size % 3 = 0 then 'Norway' else 'Chile & Peru' end as place_of_origin,
  'Maker ' || p_partkey as manufacturer_name, case when p_partkey % 3 > 0 then 'Street ' || p_size || ', 0150' end as manufacturer_address,
  case when p_partkey % 4 = 0 then repeat('oats and salt, ', 60) || 'sugar' else 'oats, salt ' || p_size end as ingredients, {_SHOWN.format("p_size * 4.184::double")} as energy_kj, p_size::varchar as fiber_g,
  case when p_partkey % 3 = 0 then '1.2' when p_partkey % 3 = 1 then {_SHOWN.format("p_size / 1000::double * 2.5")} end as salt_g, 'per 30 g' as nutritional_info from part
""")
def linked_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A product and its nutrition apart: garbage brands, sizes for weights, lists of ingredients, fibre in both spellings, salt before sodium."""
    page = """concat('<script type="application/ld+json">[{"@type":["Thing","NutritionInformation"],"calories":"', p_size, ' kcal",', if(p_size % 2 = 0, '"fibreContent"', '"fiberContent"'), ':"', p_size, ' g",',
      case p_partkey % 3 when 0 then '"saltContent":"1,2 g","sodiumContent":"9 g",' when 1 then concat('"sodiumContent":"', p_size, ' mg",') else '"saltContent":"none","sodiumContent":"9 g",' end, '"servingSize":" 30 g"},',
      '{"@type":"product","nutrition":{"fatContent":"99 g"},"brand":', if(p_size % 5 > 0, concat('{"name":"', p_brand, '"}'), '"Unknown product"'), ',', if(p_partkey % 2 = 0, concat('"weight":{"value":"', p_size, ',5 kg"}'), concat('"weight":"net","size":"', p_size, ' g"')),
      ',"countryOfOrigin":', if(p_size % 3 = 0, '{"name":" Norway"}', '"Chile & Peru"'), ',"manufacturer":', if(p_partkey % 3 > 0, concat('{"name":"Maker ', p_partkey, '","address":{"streetAddress":"Street ', p_size, '","postalCode":"0150"}}'), concat('"Maker ', p_partkey, '"')),
      ',', if(p_partkey % 4 = 0, concat('"ingredients":"', repeat('oats and salt, ', 60), 'sugar"'), concat('"ingredients":"oats","recipeIngredient":["oats","salt ', p_size, '"]')), '}]</script>')"""
    return _parsed(spark, sf_dir, page, "brand", "net_weight", "place_of_origin", "manufacturer_name", "manufacturer_address", "ingredients", "energy_kj", "fiber_g", "salt_g", "nutritional_info")


@query("""
select p_partkey, case when p_size % 4 > 0 then p_brand end as brand, lpad(p_partkey::varchar, 13, '0') as gtins, 'Title & ' || p_size as og_title, case when p_size % 3 > 0 then 'About ' || p_partkey end as og_description from part
""")
def page_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties and social tags, with their attributes in either order."""
    page = """concat('<meta property="og:title" content="Title &amp; ', p_size, '"><meta content="', if(p_size % 3 > 0, concat('About ', p_partkey), ''), '" name="og:description">',
      if(p_partkey % 2 = 0, concat('<meta itemprop="gtin13" content="', lpad(p_partkey, 13, '0'), '">'), concat('<span content="', lpad(p_partkey, 13, '0'), '" itemprop="sku">x</span>')),
      '<b itemprop="brand" content="', if(p_size % 4 > 0, p_brand, '#####'), '">y</b>')"""
    return _parsed(spark, sf_dir, page, "brand", "gtins", "og_title", "og_description")


@query(f"""
select p_partkey, p_size::varchar as fat_g, case when p_size <= 40 then {_SHOWN.format("p_size * 2.5::double")} end as salt_g, case when p_partkey % 2 = 0 then {_SHOWN.format("p_size * 41.84::double")} else p_size::varchar end as energy_kj,
  'oats, salt ' || p_size as ingredients, case when p_partkey % 7 > 0 then p_size + 0.5 || '' end as sugars_g, lpad(p_partkey::varchar, 13, '0') as gtins from part
""")
def embedded_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested state in JSON scripts and in what scripts assign, of which six pieces are read; the first value in range counts."""
    page = """concat('<script id="__NEXT_DATA__">{"a":[{"b":{"fat_100g":', p_size, ',"fat_100G":1}},[{"ean":"', lpad(p_partkey, 13, '0'), '"}]],"sodium_100g":"', p_size, ' g","ingredients":["no"],"ingredients_text":"oats, salt ', p_size, '"}</script>',
      '<script type="application/json">{broken</script>', if(p_partkey % 7 = 0, repeat('<script type="application/json">[]</script>', 3), ''),
      '<script>var x; window.__NUXT__ = {"n":{"energy-kj":4001,', if(p_partkey % 2 = 0, concat('"energy-kcal_100g":', p_size * 10), concat('"energy-kj_100g":"', p_size, '"')), ',"t":"};"}}; y()</script>',
      '<script>window.__APOLLO_STATE__={"sugars_100g":', p_size, '.5}</script>')"""
    return _parsed(spark, sf_dir, page, "fat_g", "salt_g", "energy_kj", "ingredients", "sugars_g", "gtins")


@query(f"""
select p_partkey, p_size || '.5' as fat_g, case when p_size % 4 > 0 then '2' end as saturates_g, {_SHOWN.format("p_size * 4.184::double")} as energy_kj, p_size::varchar as carbohydrates_g, case when p_size % 3 > 0 then '0.4' end as salt_g, '7' as protein_g from part
""")
def visible_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table rows with empty cells and cells left open, and columns of labels beside columns of values."""
    page = """concat('<script>Fat 1 g</script><table><tr><th>per</th><th>100 g</th></tr><tr><td>Fett<td>-<td>', p_size, ',5 g<tr><td>davon gesättigte</td><td>', if(p_size % 4 > 0, '2', '200'), ' g</td></tr></table><div><div><p>Energy</p><p>Carbohydrate</p><p>Salt</p><p>other</p></div>',
      '<div><p>short</p></div><div><p>', p_size, ' kcal</p><p>', p_size, ' g</p><p>', if(p_size % 3 > 0, '0,4 g', 'n/a'), '</p><p>9 g</p></div></div><p>Eiweiß: 7 g</p>')"""
    return _parsed(spark, sf_dir, page, "fat_g", "saturates_g", "energy_kj", "carbohydrates_g", "salt_g", "protein_g")
