"""Ladders at their edges: missing values, repeated places, failed searches, the order of links."""

from __future__ import annotations

from gleanery.config import Settings
from gleanery.operators import ladders

REQUESTS = "req_id long, ean string, ground_truth string, name string, verified boolean"
RESULTS = "req_id long, step string, rank int, link string, title string, snippet string, error int"
IMAGES = "req_id long, stage string, rank int, original string, thumbnail string, title string, domain string"
OATS = (1, "0123", "Oatly oat drink 330 ml", None, None)
SETTINGS = Settings(trusted_hosts=("good.example",))


def found(spark, requests, results):
    rows = ladders.discover(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(results, RESULTS), SETTINGS)
    return {r.req_id: (r.name, r.verified, r.links) for r in rows.collect()}


def named(spark, requests, results, pages=()):
    q, r = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(results, RESULTS)
    p = spark.createDataFrame(list(pages), "url string, html string")
    rows = ladders.resolve(q, r, ladders.evidence(q, r, p), SETTINGS)
    return {r.req_id: (r.name, r.named_by, r.verified, r.search_failed, r.links) for r in rows.collect()}


def result(step, rank, link, title="Oatly oat drink 330 ml", snippet=None, error=None, req=1):
    return (req, step, rank, link, title, snippet, error)


def test_nothing_landed(spark):
    requests = [OATS, (2, None, None, "", None), (3, "7", None, "Kept", True)]
    assert found(spark, requests, []) == {1: (None, False, []), 2: (None, False, []), 3: ("Kept", True, [])}
    assert found(spark, [], [result("market", 0, "http://a")]) == {}
    assert named(spark, requests, []) == {1: ("Product with EAN 0123", None, False, False, []), 2: ("Product with EAN ", None, False, False, []), 3: ("Kept", None, True, False, [])}


def test_pages_until_there_are_enough(spark):
    rows = [result("market", i, f"http://m{i}", None) for i in range(6)] + [result("code", 0, "http://c"), result("name", 0, "http://n")]
    assert found(spark, [OATS], rows) == {1: (None, False, ["http://m0", "http://m1", "http://m2", "http://m3"])}
    few = found(spark, [OATS], [rows[0], *rows[6:]])[1]
    assert few == ("Oatly oat drink 330 ml", False, ["http://m0", "http://c", "http://n"])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_small_requests_are_not_sent_to_the_driver(spark):
    q, r = spark.createDataFrame([OATS], REQUESTS), spark.createDataFrame([result("market", 0, "http://m")], RESULTS)
    assert "Broadcast" not in plan(ladders.discover(q, r, SETTINGS))
    pages = spark.createDataFrame([("http://m", "<p>EAN: 0123</p>")], "url string, html string")
    assert "Broadcast" not in plan(ladders.resolve(q, r, ladders.evidence(q, r, pages), SETTINGS))


def test_repeated_places_and_links_count_once(spark):
    rows = [result("market", 0, "http://b"), result("market", 0, "http://a"), result("market", 0, "http://a"), result("market", 1, "http://a"), result("aggregator", 0, None), result("odd", 0, "http://z"), result(None, 0, "http://z"), result("market", None, "http://z")]
    assert found(spark, [OATS], rows)[1] == ("Oatly oat drink 330 ml", False, ["http://a"])


def test_first_brand_hit_and_code_in_snippet(spark):
    rows = [result("brand", 0, "http://other"), result("brand", 1, "http://oatly.example/1", "Oats - Oatly"), result("brand", 2, "http://oatly.example/2"), result("name_code", 0, "http://x", snippet="code 123"), result("name_code", 1, "http://www.amazon.com/x", snippet="0123")]
    assert found(spark, [OATS], rows)[1] == ("Oats", True, ["http://oatly.example/1", "http://x"])


def test_proven_links_go_first(spark):
    rows = [result("brand", 0, "http://oatly.example/1", "Brand page"), result("market", 0, "http://m", "Barcode 5"), result("name", 0, "http://p", "Oat one"), result("name", 1, "http://q", "Oat two")]
    page = ("http://p", "<p>EAN: 0123</p>")
    assert named(spark, [OATS], rows, [page])[1] == ("Oat one", "name", True, False, ["http://p", "http://oatly.example/1", "http://m"])
    assert named(spark, [OATS], rows)[1] == ("Product with EAN 0123", None, False, False, ["http://oatly.example/1", "http://m"])
    assert named(spark, [OATS], rows, [page, ("http://oatly.example/1", '{"gtin13":"0123"}')])[1] == ("Brand page", "brand", True, False, ["http://oatly.example/1"])


def test_trusted_and_alike_or_not_at_all(spark):
    good, other = "http://good.example/a", "http://other.example/a"
    assert named(spark, [OATS], [result("name", 0, other), result("name_plain", 1, good)])[1] == ("Oatly oat drink 330 ml", "name_plain", False, False, [good])
    assert named(spark, [OATS], [result("name", 0, good, "Oatly oat drink 500 ml")])[1][1:] == (None, False, False, [])
    assert named(spark, [OATS], [result("code", 0, good, "Oatly drink")])[1] == ("Oatly drink", "code", False, False, [good])
    assert named(spark, [OATS], [result("code", 0, other, "Oatly drink")])[1] == ("Product with EAN 0123", None, False, False, [other])


def test_failed_searches_and_names_of_no_food(spark):
    failed = result("market", 0, None, None, error=429)
    assert named(spark, [OATS], [failed])[1] == ("Product with EAN 0123", None, False, True, [])
    assert named(spark, [OATS], [failed, result("name_code", 0, "http://a", "Garden hose", snippet="0123")])[1] == ("Product with EAN 0123", "name_code", True, False, ["http://a"])
    assert named(spark, [(1, "0123", None, "Unknown product", None)], [])[1][0] == "Product with EAN 0123"


def test_image_stages(spark):
    q = [(1, "strict", 0, "http://a", None, "", ""), (1, "brand", 3, None, "http://a", "", ""), (1, "brand", 8, "http://late", None, "", ""), (1, "shopping", 0, "http://b", "http://www.ebay.com/x", "", ""), (1, "page", 0, "", None, "", ""), (2, "brand", 0, "http://c", None, "", ""), (2, "registry_a", 0, "http://d", None, "", "")]
    images = spark.createDataFrame(q, IMAGES)
    got = ladders.image_candidates(images, spark.createDataFrame([(1, True)], "req_id long, named boolean"))
    assert sorted((r.req_id, r.pos, r.key, r.stage) for r in got.collect()) == [(1, 1, "http://a", "brand"), (2, 1, "http://d", "registry_a")]
    many = spark.createDataFrame([(1, "page", i, f"http://p{i:02}", None, "", "") for i in range(30)], IMAGES)
    assert [r.key for r in ladders.image_candidates(many, spark.createDataFrame([(1, True)], "req_id long, named boolean")).orderBy("pos").collect()] == [f"http://p{i:02}" for i in range(20)]
    more = spark.createDataFrame([(r, "last", i, u, None, "", "") for r in (1, 2) for i, u in enumerate(("http://a", "http://new", "http://new"))], IMAGES)
    last = ladders.last_resort(more, got, spark.createDataFrame([(2,)], "req_id long"))
    assert [(r.req_id, r.key, r["rank"]) for r in last.collect()] == [(1, "http://new", 1)]


def test_promoted_links(spark):
    columns = "req_id long, pos int, host string, url string"
    own = spark.createDataFrame([(1, 5, "a", "http://a/1"), (2, 0, "a", "u"), (2, 1, "b", "v")], columns)
    shared = spark.createDataFrame([(1, 0, "a", "http://a/2"), (1, 1, "b", "http://b/1"), (1, 2, "c", "http://c/1"), (2, 0, "c", "w"), (3, 0, "d", "x")], columns)
    assert sorted((r.req_id, r.n, r.url) for r in ladders.promoted(own, shared).collect()) == [(1, 1, "http://a/1"), (1, 2, "http://b/1"), (2, 1, "u"), (2, 2, "v"), (3, 1, "x")]
