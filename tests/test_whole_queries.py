"""Queries over small tables of their own, against brute force."""

from __future__ import annotations

import numpy as np

from gleanery.plans.registry import QUERIES


def differing(a, b):
    return sum((x > 0) != (y > 0) for x, y in zip(a, b, strict=True))


def vectors(spark, folder, rows):
    spark.createDataFrame([(i, label, [float(x) for x in v]) for i, label, v in rows], "vec_id long, label int, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")


def test_phash_dedup_compares_all_signs(spark, tmp_path):
    base = np.ones(64)
    tail, last, few = base.copy(), base.copy(), base.copy()
    tail[20:30], last[60:], few[59:] = -1, -1, -1
    rows = [(0, 0, base), (1, 0, tail), (2, 0, last), (3, 0, few), (4, 0, -base), (5, 1, last)]
    vectors(spark, tmp_path, rows)
    want = []
    for label in (0, 1):
        picked = []
        for i, _, v in (r for r in rows if r[1] == label):
            if len(picked) < 3 and all(differing(v, w) >= 5 for w in picked):
                picked.append(v)
                want.append((label, i, len(picked)))
    assert sorted((r.label, r.vec_id, r.n) for r in QUERIES["phash_dedup"](spark, str(tmp_path)).collect()) == want
    assert [i for label, i, _ in want if label == 0] == [0, 1, 3]


def test_hash_neighbours_finds_all_pairs(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        v = rng.choice([-1, 1], 64)
        for k in range(4):
            w = v.copy()
            w[rng.choice(64, rng.integers(0, 7), replace=False)] *= -1
            rows.append((1000 * k + i * 7, int(rng.integers(0, 2)), w))
    rows += [(9000, 0, -np.ones(64)), (9001, 0, np.concatenate([-np.ones(60), np.ones(4)]))]
    vectors(spark, tmp_path, rows)
    want = sorted((i, j, d) for i, k, v in rows for j, m, w in rows if i < j and k == m and (d := differing(v, w)) < 5)
    assert sorted((r.vec_id, r.other, r.distance) for r in QUERIES["hash_neighbours"](spark, str(tmp_path)).collect()) == want
    assert {d for *_, d in want} == {0, 1, 2, 3, 4}


def test_labelled_scan_reads_the_page(spark, tmp_path):
    long = "<p>words</p>" * 3000
    rows = [
        (1, f"<html><script>Fat 77 g</script>{long}<td>Fat</td><td>12,3 g</td><p>Zutaten: oats, salt and sugar. Allergens: milk. </p></html>"),
        (2, "<p>Fett 3 g then Fat 9 g and Energie 100 kJ</p>"),
        (3, "<p>nothing</p>"),
        (4, None),
        (5, "<p>Fettarm</p>"),
    ]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.fat_g, r.energy_kj, r.ingredients, r.allergens) for r in QUERIES["labelled_scan"](spark, str(tmp_path)).collect()}
    assert got == {
        1: (12.3, 41.84, "oats, salt and sugar", "milk"),
        2: (9.0, 100.0, "cocoa 2 and milk powder", "nuts and soya"),
        3: (3.5, 125.52, "cocoa 3 and milk powder", None),
        4: (4.5, 167.36, "cocoa 4 and milk powder", "nuts and soya"),
        5: (5.5, 209.2, "cocoa 5 and milk powder", "nuts and soya"),
    }


def test_name_match_reads_whole_pages_and_keeps_the_last(spark, tmp_path):
    pages = [(1, "<h1>Oat drink</h1>" + "<p>word </p>" * 1500 + "<p>Crunchy almond</p>"), (2, "<h1>Crunchy almond</h1>"), (5, "<h1>Cocoa</h1>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.own_ratio, r.best_ratio, r.relevant) for r in QUERIES["name_match"](spark, str(tmp_path)).collect()}
    assert got == {1: (1.0, 1.0, True), 2: (1.0, 1.0, True), 5: (1.0, 1.0, True)}


def test_rescue_set_takes_odd_keys(spark, tmp_path):
    lines = [(k, h, n, "A", "F") for k in (2, 3) for n, h in enumerate((10, 11, 12, 13, 14), 1)]
    full = [(5, h, h, f, s) for h, (f, s) in enumerate([(f, s) for f in "ANR" for s in "FO"], 1)]
    spark.createDataFrame(lines + full, "l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.req_id, r.host, r.n, r.n_fields) for r in QUERIES["rescue_set"](spark, str(tmp_path)).collect())
    assert got == [(k, h, n, 1) for k in (2, 3) for n, h in enumerate((11, 12, 13), 1)]
