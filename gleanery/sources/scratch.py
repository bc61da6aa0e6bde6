"""New paths in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: What is to be removed when the driver ends: a path's file system and the path in it, taken while the session lives.
_HELD: dict[str, tuple] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only in local mode a temporary folder of this machine where that is unset."""
    set_ = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if set_:
        return set_.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = f"file://{tempfile.mkdtemp(prefix='gleanery-')}"
        _hold(spark, _OWN[app])
    return _OWN[app]


def _hold(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    _HELD[path] = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is there is removed by ``free`` or when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _hold(spark, path)
    return path


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where there is no such folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free(path: str) -> None:
    """Removes what was written at a path that nothing reads any more."""
    fs, where = _HELD.pop(path)
    fs.delete(where, True)


@atexit.register
def _free_all() -> None:
    for path in list(_HELD):
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            free(path)


def written_at(df: DataFrame, path: str) -> DataFrame:
    """df written as Parquet and read again: its lineage ends there, and a lost executor loses nothing."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``written_at`` a new path in the shared folder."""
    return written_at(df, new_path(df.sparkSession, name))
