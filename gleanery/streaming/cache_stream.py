"""The cache kept by a stream: each micro-batch is folded into the latest row per key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import cache
from gleanery.sources import scratch


def _head(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, dict[int, int]]:
    """(batch, batch that wrote each bucket last) of the newest manifest, or of the newest before a batch; -1 without one."""
    found = scratch.listed(spark, f"{folder}/heads")
    numbers = [int(n) for n in found if n.isdigit() and (before is None or int(n) < before)]
    if not numbers:
        return -1, {}
    rows = spark.read.schema("bucket int, batch long").parquet(f"{folder}/heads/{max(numbers)}").collect()  # one row a bucket
    return max(numbers), {r["bucket"]: r["batch"] for r in rows}


def _rows(spark: SparkSession, folder: str, schema, where: dict[int, int]) -> DataFrame:
    paths = [f"{folder}/data/{batch}/bucket={bucket}" for bucket, batch in sorted(where.items())]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def keep_latest(stream: DataFrame, folder: str, keys: list[str], order: list[str], spark: SparkSession, buckets: int = 16) -> DataFrame:
    """Runs a stream to its end and gives the latest row per key, of all that was ever folded into folder.

    Keys are dealt into buckets; a batch rewrites the buckets that it touches and a manifest that names, for each bucket,
    the batch that wrote it last. The checkpoint is in folder too, so a later call goes on where the last one ended. A
    batch that runs again after a failure starts from the manifest before it and overwrites its own files, so rows are
    neither lost nor doubled. What neither of the two newest manifests names is removed. Rows with a null key have
    a bucket like others. buckets must stay what it was at a folder's first call.
    """
    schema = stream.schema

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")
        batch = batch.persist()
        try:
            touched = {r["bucket"] for r in batch.select(bucket).distinct().collect()}  # at most `buckets` numbers
            before, where = _head(session, folder, number)
            old = _rows(session, folder, schema, {b: w for b, w in where.items() if b in touched})
            cache.latest(batch.unionByName(old), keys, order).select("*", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/data/{number}")
            now = where | dict.fromkeys(touched, number)
            session.createDataFrame(sorted(now.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/heads/{number}")
        finally:
            batch.unpersist()
        for n in scratch.listed(session, f"{folder}/heads"):
            if n.isdigit() and int(n) < before:
                scratch.remove(session, f"{folder}/heads/{n}")
        for n in scratch.listed(session, f"{folder}/data"):
            if n.isdigit() and int(n) not in {*where.values(), *now.values()}:
                scratch.remove(session, f"{folder}/data/{n}")

    query = stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return _rows(spark, folder, schema, _head(spark, folder)[1])


def counts_by_window(stream: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per key and window, final when the watermark has passed it."""
    when = F.col(ts).cast("timestamp")
    return stream.withColumn(ts, when).withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"))
