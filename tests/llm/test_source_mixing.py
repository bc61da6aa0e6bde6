from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import source_mixing as sm


def test_rake_meets_margins():
    rng = random.Random(1)
    cells = {(a, b): rng.uniform(1, 100) for a in "xyz" for b in "pq"}
    targets = {"one": {"x": 0.2, "y": 0.3, "z": 0.5}, "two": {"p": 0.4, "q": 0.6}}
    raked = sm.rake(cells, targets)
    f = raked.factors
    assert raked.reached() == {(d, v) for d, shares in targets.items() for v in shares}
    total = sum(cells.values())
    for axis, shares in enumerate(targets.values()):
        for name, want in shares.items():
            assert sum(v * f[k] for k, v in cells.items() if k[axis] == name) / total == pytest.approx(want, abs=1e-6)
    odds = lambda w: w["x", "p"] * w["y", "q"] / w["x", "q"] / w["y", "p"]
    assert odds({k: v * f[k] for k, v in cells.items()}) == pytest.approx(odds(cells))  # raking leaves interactions


def test_rake_without_some_values():
    assert sm.rake({}, {"a": {"x": 1.0}}).factors == {}
    f = sm.rake({("x",): 5.0, ("u",): 5.0, ("e",): 0.0}, {"a": {"x": 0.5, "gone": 0.5}}).factors
    assert f == {("u",): 0.0, ("x",): 2.0}


def test_contradicting_targets_are_told():
    cells = {("x", "p"): 3.0, ("y", "q"): 7.0}  # x is p and y is q, so both margins can't be had
    raked = sm.rake(cells, {"one": {"x": 0.5, "y": 0.5}, "two": {"p": 0.2, "q": 0.8}})
    assert raked.reached() == {("two", "p"), ("two", "q")}
    assert ("one", "x", 0.5, pytest.approx(0.2)) in raked.margins
    assert sm.rake(cells, {"one": {"z": 1.0}}).margins == [("one", "x", None, pytest.approx(0.3)), ("one", "y", None, pytest.approx(0.7))]


def test_chances_leave_the_margins():
    f = {("a",): 5.0, ("b",): 0.5}
    assert sm.chances(f, 0.6, None) == {("a",): pytest.approx(3.0), ("b",): pytest.approx(0.3)}
    assert sm.chances(f, 0.6, 1) == {("a",): 1.0, ("b",): pytest.approx(0.1)}
    assert sm.chances(f, 0.1, 1) == {("a",): pytest.approx(0.5), ("b",): pytest.approx(0.05)}
    assert sm.chances({}, 0.5, 1) == {}


@pytest.mark.parametrize("most", [None, 1, 3])
def test_the_drawn_margins_are_the_targets(spark, docs, most):
    """A hot source with half of all rows and a scarce one with a hundredth of its target."""
    rng = random.Random(9)
    source = lambda: "src0" if rng.random() < 0.5 else "src7" if rng.random() < 0.01 else "src3"
    rows = [(i, "w " * rng.randrange(5, 60), source(), rng.choice(("en", "en", "de"))) for i in range(30_000)]
    targets = {"source": {"src0": 0.3, "src3": 0.4, "src7": 0.3}, "lang": {"en": 0.5, "de": 0.5}}
    out = sm.mix(docs(rows), targets, {d: F.col(d) for d in targets}, sm.token_count(F.col("text")), most=most, carry=["doc_id"]).cache()
    assert out.where("not on_target").count() == 0
    assert most is None or out.agg(F.max("chance")).first()[0] == pytest.approx(most)
    n = out.where("copies > 0").count()
    for r in sm.margins(out, list(targets)).collect():
        assert r.expected == pytest.approx(targets[r.dim][r.value], abs=1e-6)
        assert r.drawn == pytest.approx(targets[r.dim][r.value], abs=0.01 if most is None else 3 / n**0.5)
    by = {r["source"]: r for r in out.groupBy("cell.source").agg(F.sum("chance").alias("want"), F.sum("copies").alias("got"), F.count("*").alias("n")).collect()}
    for r in by.values():
        assert abs(r["want"] - r["got"]) <= 4 * (r["n"] ** 0.5) / 2 + 1


def test_draws_repeat(spark, docs):
    rows = [(i, "w " * 20, "src0" if i % 3 else f"src{1 + i % 19}", "en" if i % 2 else "de") for i in range(2000)]
    first, again = (sorted(map(tuple, sm.mix_documents(docs(rows)).select("doc.doc_id", "copies").collect())) for _ in range(2))
    assert first == again
    kept = Counter(r.doc_id for r in sm.stage(spark, docs(rows), "").collect())
    assert sorted(kept.items()) == [(i, n) for i, n in first if n]


def test_odd_rows(spark, docs):
    d = docs([(None, None, None, None), (1, "", "elsewhere", "xx"), (1, "", "elsewhere", "xx"), (2, "Licensed under a License " * 40_000, "src1", "en")])
    out = sm.mix_documents(d).select("doc.doc_id", "cell.source", "cell.topic", "tokens", "chance", "copies").collect()
    assert sorted((r.doc_id or 0, r.source, r.topic, r.tokens) for r in out) == [(0, "other", "general", 0), (1, "other", "general", 0), (1, "other", "general", 0), (2, "src1", "legal", 160_000)]
    assert all(r.chance == 1.0 and r.copies == 1 for r in out if r.tokens == 0)
    assert sm.mix_documents(docs([])).collect() == []
    assert sm.stage(spark, d, "").columns == d.columns


def test_sql(spark, docs, same, tmp_path):
    rng = random.Random(5)
    d = docs([(i, ("License " if i % 17 == 0 else "mail@x " if i % 13 == 0 else "") + "w " * rng.randrange(60), f"src{rng.choice((0, 0, rng.randrange(25)))}", rng.choice(("en", "de", "fr", "xx"))) for i in range(500)] + [(None, None, None, None)])
    d.write.parquet(str(tmp_path / "documents.parquet"))
    same(sm.op3_source_mixing(spark, str(tmp_path)), sm.ORACLE["op3_source_mixing"], documents=d)
