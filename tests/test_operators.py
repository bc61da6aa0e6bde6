"""Operators whose behaviour the registered queries don't pin."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from gleanery.operators import candidates, export, fuse, images, lookups
from gleanery.sources import sinks, tables


def test_pick_distinct_looks_past_the_top(spark):
    near = [("g", 100.0 - i, i, 1) for i in range(10)]
    rows = spark.createDataFrame([*near, ("g", 1.0, 99, 0xFFFF), ("h", 1.0, 5, None)], "k string, s double, id int, hash long")
    got = images.pick_distinct(rows, ["k"], "s", "id", "hash", most=2).collect()
    assert sorted(map(tuple, got)) == [("g", 0, 1), ("g", 99, 2), ("h", 5, 1)]


def test_fill_takes_first_filled(spark):
    pages = spark.createDataFrame([(1, 2, "b", None), (1, 1, "", "x"), (2, 1, None, None)], "req_id int, pos int, fat_g string, brand string")
    got = {r.req_id: (r.fat_g, r.brand) for r in fuse.fill(pages, F.struct("pos"), ("fat_g", "brand")).collect()}
    assert got == {1: ("b", "x"), 2: (None, None)}


def test_conditional_step(spark):
    found = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "req_id int, link string")
    more = spark.createDataFrame([(1, "c"), (2, "c"), (3, "c")], "req_id int, link string")
    got = candidates.conditional_step(found, more, 2).collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (1, "b"), (2, "a"), (2, "c"), (3, "c")]


def test_registry_tiers(spark):
    req = spark.createDataFrame([("0012",), ("7",), (None,)], "ean string")
    a = spark.createDataFrame([("12", "A")], "ean string, name string")
    b = spark.createDataFrame([("12", "B"), ("007", "B")], "ean string, name string")
    got = sorted(map(tuple, lookups.with_registries(req, a, b).collect()), key=str)
    assert got == [("0012", "A", 1), ("7", "B", 2), (None, None, None)]


def test_search_sources(spark):
    ok = json.dumps({"organic_results": [{"link": "http://a", "title": "t"}, {"link": "http://b"}]})
    raw = spark.createDataFrame([(1, ok), (2, json.dumps({"_error": 429})), (3, "{")], "req_id int, body string")
    assert sorted((r.req_id, r["rank"], r.link) for r in tables.search_results(raw).collect()) == [(1, 0, "http://a"), (1, 1, "http://b")]
    assert [(r.req_id, r.error) for r in tables.search_errors(raw).where("error = 429").collect()] == [(2, 429)]


def test_registry_source(spark):
    body = json.dumps({"code": "12", "product": {"name": "Oats", "specs": [["a", "b"], ["c"]], "categoryPath": ["x"]}})
    row = tables.registry(spark.createDataFrame([(body,), ("{}",)], "body string")).first()
    assert (row.ean, row.name, row.specs, row.category_path) == ("12", "Oats", {"a": "b"}, ["x"])


def test_taxonomy_and_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text("C1;C2\r\nFood ;Oats\r\nFood;\r\n")
    t = tables.taxonomy(spark, str(tmp_path / "t.csv"))
    assert sorted(map(tuple, t.collect()), key=str) == [("Food", "Oats"), ("Food", None)]
    rows = spark.createDataFrame([("Food", " Oats"), ("Food", None), ("Toys", None)], "C1 string, C2 string")
    assert lookups.valid_paths(rows, t, ("C1", "C2")).count() == 2
    sinks.write_csv(rows, str(tmp_path / "out"), [["C2"]])
    assert spark.read.csv(str(tmp_path / "out"), header=True).columns == ["C2", "C1"]


def test_requests(spark):
    lines = spark.createDataFrame([("REFRESH 4006381333931 x",), ("4006381333932 y",), ("",)], "raw string")
    assert [r.ean for r in tables.requests(lines).collect()] == ["4006381333931", None, None]


def test_export_order():
    assert export.ordered(["a", "b", "c"], [["c"], ["a", "z"]]) == ["c", "a", "b"]


def test_render_queue(spark):
    rows = [(1, 1, True, True, True), (1, 2, False, False, False), (1, 3, True, False, False), (1, 4, True, True, False)]
    pages = spark.createDataFrame(rows, "req_id int, pos int, verified boolean, trusted boolean, readable boolean")
    assert [r.pos for r in candidates.render_queue(pages, 2).orderBy("n").collect()] == [4, 3]


def png(path, pixels):
    import struct
    import zlib

    h, w = len(pixels), len(pixels[0])
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(v for p in row for v in (p, p, p)) for row in pixels)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_perceptual_hash(spark, tmp_path):
    rng = np.random.default_rng(1)
    picture = np.kron(rng.integers(20, 220, (8, 8)), np.ones((8, 8), dtype=int))
    png(tmp_path / "a.png", picture.tolist())
    png(tmp_path / "b.png", (picture + rng.integers(0, 9, (64, 64))).tolist())
    png(tmp_path / "c.png", [[255 * ((x // 8 + y // 8) % 2) for x in range(64)] for y in range(64)])
    read = spark.read.format("image").load(str(tmp_path))
    h = {r.o.rsplit("/", 1)[1]: r.h for r in read.select(F.col("image.origin").alias("o"), images.perceptual_hash(F.col("image")).alias("h")).collect()}
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert bits(h["a.png"], h["b.png"]) < 8 < bits(h["a.png"], h["c.png"])


def test_bytes_and_kinds(spark, tmp_path):
    from gleanery.functions import urls

    (tmp_path / "p.html").write_bytes("é<b>x".encode())
    (tmp_path / "big.bin").write_bytes(b"x" * 9000)
    assert tables.pages_from_files(spark, str(tmp_path / "p.html")).first().html == "é<b>x"
    assert tables.image_bytes(spark, str(tmp_path)).count() == 1
    rows = spark.createDataFrame([("text/html", bytearray(b"\xff\xd8\xff\x00")), ("image/PNG; q=1", bytearray(b"")), (None, bytearray(b"GIF89a")), (None, bytearray(b"zz"))], "k string, d binary")
    assert [r[0] for r in rows.select(urls.image_kind(F.col("k"), F.col("d"))).collect()] == ["image/jpeg", "image/png", "image/gif", None]
    data = spark.createDataFrame([(1, 1, bytearray(b"a" * 130)), (1, 2, bytearray(b"a" * 140)), (1, 3, bytearray(b"b"))], "req_id int, pos int, d binary")
    assert [r.pos for r in images.prefix_distinct(data, "d", ["req_id"], ["pos"]).orderBy("pos").collect()] == [1, 3]


def test_code_evidence(spark):
    from gleanery.functions import text
    from gleanery.operators import verify

    rows = spark.createDataFrame([("<title>Alpina oats</title> 4006381333931", "oats"), ("<title>else</title> 4006381333931", "oats"), ("ean 4006381333931", ""), ("x", "oats")], "p string, g string")
    assert [r[0] for r in rows.select(verify.code_evidence(F.col("p"), F.lit("4006381333931"), F.col("g"))).collect()] == [True, False, True, False]
    assert rows.select(verify.snippet_has_code(F.col("p"), F.lit("0004006381333931"))).first()[0] is True
    assert rows.select(text.search_clause(F.lit("site:a OR "), F.lit(""), F.lit("site:b"))).first()[0] == "site:a OR site:b"
