"""The cache stream over several calls, and windowed counts."""

from __future__ import annotations

import os

from gleanery.sources import scratch
from gleanery.streaming import cache_stream

SCHEMA = "k string, v int, ts long"


def land(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{name}")


def run(spark, folder, **options):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    return sorted(((r.k, r.v) for r in cache_stream.keep_latest(stream, f"{folder}/out", ["k"], ["ts"], spark, **options).collect()), key=str)


def test_history_outlives_its_files(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, "a", [(f"k{i}", i, 1) for i in range(40)] + [("k1", 100, 5), (None, 7, 1)])
    assert run(spark, folder) == sorted([("k1", 100), (None, 7), *((f"k{i}", i) for i in range(40) if i != 1)], key=str)
    for file in (tmp_path / "in" / "a").iterdir():
        file.unlink()
    land(spark, folder, "b", [("k2", 200, 9), ("new", 1, 1), ("k1", 0, 2)])
    want = sorted([("k1", 100), ("k2", 200), ("new", 1), (None, 7), *((f"k{i}", i) for i in range(40) if i not in (1, 2))], key=str)
    assert run(spark, folder) == want
    assert run(spark, folder) == want  # nothing new
    for k in range(4):
        land(spark, folder, f"c{k}", [("k3", 300 + k, 10 + k)])
        got = run(spark, folder)
    assert got == sorted([("k1", 100), ("k2", 200), ("k3", 303), ("new", 1), (None, 7), *((f"k{i}", i) for i in range(40) if i not in (1, 2, 3))], key=str)
    assert len(os.listdir(tmp_path / "out" / "heads")) <= 2
    assert len([d for d in os.listdir(tmp_path / "out" / "data") if d.isdigit()]) <= 4  # versions that nothing names are gone


def test_a_batch_that_runs_again(spark, tmp_path):
    folder = str(tmp_path)
    land(spark, folder, "a", [("x", 1, 1)])
    run(spark, folder)
    commits = tmp_path / "out" / "state" / "commits"
    land(spark, folder, "b", [("x", 2, 2), ("y", 1, 1)])
    run(spark, folder)
    for file in commits.iterdir():  # as if the driver had been lost before the second batch was told done
        if file.name.strip(".").startswith("1"):
            file.unlink()
    assert run(spark, folder) == [("x", 2), ("y", 1)]


def test_counts_by_window(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:05:00", "b"), ("2024-01-03 00:00:00", "z")]
    spark.createDataFrame(rows, "ts string, k string").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts string, k string").parquet(f"{tmp_path}/in")
    query = cache_stream.counts_by_window(stream, "ts", "k").writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    got = sorted((str(r.window.start), r.k, r.n) for r in spark.table("counted").collect())
    assert got == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1), ("2024-01-03 00:00:00", "z", 1)]


def test_scratch_is_freed(spark):
    path = scratch.new_path(spark, "x")
    scratch.written_at(spark.range(3), path)
    folder, name = path.rsplit("/", 1)
    assert name in scratch.listed(spark, folder)
    scratch.free(path)
    assert name not in scratch.listed(spark, folder) and path not in scratch._HELD


def test_no_local_folder_on_a_cluster(monkeypatch):
    import pytest

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getConf = Conf

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
