from __future__ import annotations

import random

import pyarrow as pa
import pytest

from gleanery.llm import common


@pytest.mark.parametrize("shape", ["path", "star", "random", "empty", "odd"])
def test_components(spark, shape):
    rng = random.Random(shape)
    edges = {
        "path": [(i, i + 1) for i in range(60)],
        "star": [(i, 99) for i in range(60)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(120)],
        "empty": [],
        "odd": [(1, None), (None, None), (2, 2), (4, 3), (4, 3), (3, 4)],
    }[shape]
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root}


def test_whole_groups():
    keys = [1, 1, 2, 3, 3, 3, 3, 3, 4, 5, 5]
    for step in (1, 2, 3, 11):
        batches = [pa.RecordBatch.from_pydict({"k": keys[i : i + step], "v": list(range(i, min(i + step, len(keys))))}) for i in range(0, len(keys), step)]
        seen = []
        for t, starts in common.whole_groups(iter(batches), "k"):
            k, v = t.column("k").to_pylist(), t.column("v").to_pylist()
            for a, b in zip(starts[:-1], starts[1:]):
                assert len(set(k[a:b])) == 1
                seen.append((k[a], v[a:b]))
        assert [g for g, _ in seen] == [1, 2, 3, 4, 5] and [x for _, v in seen for x in v] == list(range(len(keys)))


def test_written_ends_lineage(spark):
    df = common.written(spark.range(5).selectExpr("id", "id * 2 as twice"), "t")
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().executedPlan().toString()
