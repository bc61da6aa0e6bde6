"""Scalar functions on the edges of their definitions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gleanery.functions import barcode, html, numbers, text, urls
from gleanery.operators import page_fields


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("1,234.5", 1234.0), ("1,234,567", 1234.0), ("12.5.", 125.0), ("-3", 3.0), ("12 3", 123.0), ("13.062 kJ", 13.062), ("1.234.567", 1234567.0), ("0,5 g", 0.5), ("1.234,5", 1234.5), ("1,234", 1234.0), ("", None), (None, None), ("none", None)],
)
def test_to_double(spark, raw, want):
    assert one(spark, numbers.to_double, raw) == want
    assert page_fields.number(raw) == want


@pytest.mark.parametrize(("v", "want"), [(12.0, "12"), (0.039, "0.039"), (1.5, "1.5"), (2.10049, "2.1"), (None, None)])
def test_text_of(spark, v, want):
    assert one(spark, numbers.text_of, v, "double") == want


@pytest.mark.parametrize(("s", "want"), [("250 kJ", 250.0), ("100 kcal", 418.4), ("401", 401.0), ("100", 418.4), ("250 kcal / 1046 kJ", 250.0)])
def test_energy(spark, s, want):
    assert one(spark, numbers.energy_kj, s) == pytest.approx(want)
    assert page_fields.energy(s) == pytest.approx(want)


@pytest.mark.parametrize(("kj", "want"), [("418.4", "418.4 kJ / 100 kcal"), ("100", "100 kJ / 23.9 kcal"), ("", ""), (None, ""), ("much", "much")])
def test_energy_label(spark, kj, want):
    assert one(spark, numbers.energy_label, kj) == want


@pytest.mark.parametrize(("code", "want"), [("4006381333931", True), ("4006381333932", False), ("96385074", True), ("036000291452", True), ("123", False), ("40063813339x1", False), (None, False), ("", False)])
def test_check_digit(spark, code, want):
    assert one(spark, barcode.valid, code) is want


def test_barcode_equality(spark):
    rows = spark.createDataFrame([("0012", "12"), ("000", "0"), (None, "1")], "a string, b string")
    assert [r[0] for r in rows.select(barcode.same(F.col("a"), F.col("b"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("line", "want"),
    [("REFRESH 4006381333931 oat  drink", ("4006381333931", "oat drink", True)), ("oat 4006381333931 drink 4006381333931", ("4006381333931", "oat drink", False)), ("no code", (None, "no code", False)), ("refresh12345678", ("12345678", "", True))],
)
def test_parse_line(spark, line, want):
    row = spark.createDataFrame([(line,)], "x string").select(*(c.alias(n) for n, c in barcode.parse_line(F.col("x")).items())).first()
    assert (row.ean, row.ground_truth, row.force_refresh) == want


@pytest.mark.parametrize(("s", "want"), [("6 x 330 ml", "330ml"), ("oats 500 G", "500g"), ("0,5l cola", "0,5l"), ("plain", None)])
def test_weight(spark, s, want):
    assert one(spark, text.weight, s) == want


@pytest.mark.parametrize(("s", "want"), [("Cola (6 Pack) 6 x 330 ml", "Cola 330 ml"), ("Oats (pack of 3), ", "Oats"), ("Tea", "Tea")])
def test_packs(spark, s, want):
    assert one(spark, text.without_packs, s) == want


@pytest.mark.parametrize(("s", "want"), [("Mix Alpina oats", "Alpina"), ("oats", None), ("123. Tea", "Tea")])
def test_brand(spark, s, want):
    assert one(spark, text.brand, s) == want


@pytest.mark.parametrize(("s", "want"), [("ab", True), ("http://x", True), ("UPC Lookup 1", True), ("12 34", True), ("Oat drink", False), (None, True)])
def test_garbage(spark, s, want):
    assert one(spark, text.garbage_name, s) is want


@pytest.mark.parametrize(("u", "want"), [("https://a.b:80/c", "a.b:80"), ("http://x", "x"), ("ftp://x/y", None), (None, None)])
def test_host(spark, u, want):
    assert one(spark, urls.host, u) == want


def test_suffix_match(spark):
    rows = spark.createDataFrame([("shop.example.com",), ("example.com",), ("badexample.com",), (None,)], "h string")
    assert [r[0] for r in rows.select(urls.under(F.col("h"), ("Example.com",))).collect()] == [True, True, False, False]


def test_values_agree(spark):
    rows = spark.createDataFrame([(10.0, 10.5), (10.0, 10.6), (100.0, 103.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(text.numbers_agree(F.col("a"), F.col("b"))).collect()] == [True, False, True, False]


def test_labelled_code(spark):
    pages = [("<b>EAN: 0012345678</b>", True), ("gtin13\": \"123456789", False), ("nothing", False)]
    rows = spark.createDataFrame(pages, "p string, w boolean")
    assert [r[0] for r in rows.select(html.labelled_code(F.col("p"), F.lit("12345678"))).collect()] == [w for _, w in pages]


PAGE = """<html><head><title>Oat drink</title><meta property="og:title" content="Oat &amp; more"><meta property="og:image" content="http://i/x.jpg">
<script type="application/ld+json">{"@graph": [{"@type": "Product", "brand": {"name": "Alpina"}, "gtin13": "4006381333931", "image": ["http://i/a.jpg", {"url": "http://i/b.jpg"}],
"nutrition": {"@type": "NutritionInformation", "fatContent": "1,5 g", "sodiumContent": "40 mg"}}]}</script>
<script>window.__INITIAL_STATE__ = {"p": {"sugars_100g": 4.1, "ean": "96385074", "energy-kcal_100g": 46}};</script></head>
<body><table><tr><td>Fett<td>9 g<tr><th>Eiweiß</th><td>-</td><td>1,0 g</td></tr></table>
<div><p>Fibre</p><p>Salt</p><p>Carbohydrate</p></div><div><p>0,8 g</p><p>0,1 g</p><p>6,6 g</p></div>
<p>Zutaten: water, oats 10 %. Allergens: see ingredient list. May contain: nuts. x</p></body></html>"""


def test_page_record():
    r = page_fields.page_record(PAGE)
    assert (r["brand"], r["fat_g"], r["salt_g"], r["sugars_g"], r["protein_g"], r["fiber_g"], r["carbohydrates_g"]) == ("Alpina", "1.5", "0.1", "4.1", "1", "0.8", "6.6")
    assert r["energy_kj"] == "192.464"
    assert r["ingredients"].startswith("water, oats")
    assert r["allergens"] is None
    assert r["may_contain"] == "nuts"
    assert r["gtins"] == ["4006381333931", "96385074"]
    assert r["og_title"] == "Oat & more"
    assert page_fields.images(PAGE) == [("jsonld_retailer", "http://i/a.jpg"), ("jsonld_retailer", "http://i/b.jpg"), ("og_retailer", "http://i/x.jpg")]


@pytest.mark.parametrize("page", [None, "", "<", "<script type='application/ld+json'>{bad}</script>", "<table><tr><td>Fat", "]]><p></p></div>", '<script type="application/ld+json">[[{"@type":"Product","weight":{"value":null},"manufacturer":{"address":[1]}}]]</script>'])
def test_odd_pages(page):
    assert page_fields.page_record(page)["fat_g"] is None


def test_page_fields_on_executors(spark):
    row = page_fields.with_fields(spark.createDataFrame([(PAGE,), (None,)], "html string")).select("fields.brand", page_fields.has_content(F.col("fields")).alias("full")).collect()
    assert [tuple(r) for r in row] == [("Alpina", True), (None, False)]
