"""The whole enrichment on landed pages."""

from __future__ import annotations

import pandas as pd

from gleanery.config import Settings
from gleanery.operators import models
from gleanery.plans.enrich import Models, enrich, search_and_enrich

EAN = "4006381333931"
ROW = "<tr><td>{}</td><td>{}</td></tr>"


def page(code, title, facts, tail=""):
    table = "".join(ROW.format(k, v) for k, v in facts.items())
    return f"<html><head><title>{title}</title></head><body><p>EAN: {code}</p><table>{table}</table>{tail}</body></html>"


PAGES = [
    ("https://shop.example.com/oat/1", page(EAN, "Alpina oat drink", {"Fat": "1,5 g", "Sugars": "4 g"})),
    ("https://shop.example.com/", page(EAN, "start", {"Fat": "9 g", "Sugars": "9 g"})),
    ("https://a.example/x", page(EAN, "oat", {"Fat": "1,6 g", "Protein": "1 g"}, "<p>Ingredients: water, oats and salt. Energy</p>")),
    ("https://b.example/x", page(EAN, "oat", {"Fat": "1.5 g", "Salt": "0,1 g"})),
    ("https://amazon.de/x", page(EAN, "oat", {"Fat": "7 g", "Salt": "7 g"})),
    ("https://c.example/other", page("4006381333932", "something else", {"Fat": "50 g", "Salt": "1 g"})),
    ("https://d.example/bad", page("96385074", "odd", {"Fat": "80 g", "Carbohydrate": "60 g"})),
    ("https://trusted.example/n", page("0", "Alpina Muesli crunchy 500 g", {"Fat": "3 g", "Salt": "1 g"})),
]
REQUESTS = [(1, EAN, "Alpina oat drink", ""), (2, "96385074", "odd", ""), (3, "12345670", "Alpina Muesli crunchy", "500 g"), (4, "036000291452", "none", "")]
FOUND = [(1, i, u) for i, (u, _) in enumerate(PAGES[:6])] + [(2, 0, PAGES[6][0]), (3, 0, PAGES[7][0]), (4, 0, PAGES[5][0])]


def run(spark, plugged=None):
    return {
        r.req_id: r
        for r in enrich(
            spark.createDataFrame(REQUESTS, "req_id int, ean string, name string, ground_truth string"),
            spark.createDataFrame(FOUND, "req_id int, pos int, url string"),
            spark.createDataFrame(PAGES, "url string, html string"),
            Settings(trusted_hosts=("trusted.example",)),
            plugged,
        ).collect()
    }


def test_enrich(spark):
    got = run(spark)
    a = got[1]
    assert (a.fat_g, a.sugars_g, a.protein_g, a.salt_g, a.ingredients) == ("1.5", "4", "1", "0.1", "water, oats and salt")
    assert (a.status, a.reliability, a.provenance) == ("success", "M", "3 sources agree")
    assert a.source_links == [PAGES[0][0], PAGES[2][0]]  # two links, one a host
    assert (got[2].fat_g, got[2].reliability, got[2].implausible) == (None, "L", "macro sum")
    assert (got[3].fat_g, got[3].reliability, got[3].provenance) == ("3", "H", "trusted source")
    assert (got[4].status, got[4].reliability, got[4].source_links, got[4].fat_g) == ("no_source", None, [], None)


def test_models_are_plugged_in(spark):
    def fill(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"ingredients": ["guessed"] * len(b), "place_of_origin": ["Norway"] * len(b)}, index=b.index)

    def broken(b: pd.DataFrame) -> pd.DataFrame:
        raise ValueError("no answer")

    rows = spark.createDataFrame([(1, "x" * 300, "own", None), (2, "short", None, None)], "id int, text string, ingredients string, place_of_origin string")
    fields = ("ingredients", "place_of_origin")
    got = sorted(tuple(r)[2:] for r in models.fill_missing(rows, "text", fill, fields).orderBy("id").collect() if r.id == 1)
    assert got == [("own", "Norway")]
    assert models.fill_missing(rows, "text", broken, fields).count() == 2
    failed = run(spark, Models(fill=broken))
    assert failed[1].fat_g == "1.5" and all(r.model_error is None for r in failed.values())  # no page's text is long enough to ask
    told = models.fill_missing(rows, "text", broken, fields, error="why").orderBy("id").collect()
    assert [r.why for r in told] == ["ValueError: no answer", None]
    assert models.classify(rows, ["text"], ("c1", "ingredients"), None, ("ingredients",)).columns == [*rows.columns, "c1"]


def test_search_results_are_enriched(spark):
    requests = spark.createDataFrame([(1, EAN, "Alpina oat drink", None, None), (2, "96385074", None, None, None)], "req_id int, ean string, ground_truth string, name string, verified boolean")
    results = [
        (1, "name_code", 0, PAGES[2][0], "Alpina oat drink - a", f"EAN {EAN}", None),
        (1, "aggregator", 0, PAGES[4][0], "excluded", None, None),
        (1, "market", 0, PAGES[5][0], "something else", None, None),
        (1, "market", 1, PAGES[3][0], "oat", None, None),
        (2, "market", 0, None, None, None, 429),
    ]
    results = spark.createDataFrame(results, "req_id int, step string, rank int, link string, title string, snippet string, error int")
    pages = spark.createDataFrame(PAGES, "url string, html string")
    got = {r.req_id: r for r in search_and_enrich(requests, results, pages, Settings()).collect()}
    assert (got[1].fat_g, got[1].protein_g, got[1].salt_g) == ("1.6", "1", "0.1")
    assert list(got[1].source_links) == [PAGES[2][0], PAGES[3][0]]
    assert (got[1].status, got[2].status, got[2].fat_g) == ("success", "no_source", None)
