"""Lookups: tiered registries, host lists and taxonomy paths as equality joins. Spark picks broadcast by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import barcode, urls


def with_registries(requests: DataFrame, *registries: DataFrame, code: str = "ean", columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """requests with the columns of the first registry that knows the code; `tier` says which, null for none.

    Codes compare without leading zeros. A registry that names a code twice counts by its smallest row of columns.
    """
    out = requests.withColumn("key_", barcode.key(F.col(code)))
    for i, r in enumerate(registries):
        hit = F.min(F.struct(*columns)).alias(f"hit_{i}")
        out = out.join(r.select(barcode.key(F.col(code)).alias("key_"), *columns).where("key_ is not null").groupBy("key_").agg(hit), "key_", "left")
    hits = [F.col(f"hit_{i}") for i in range(len(registries))]
    tier = F.coalesce(*(F.when(h.isNotNull(), i + 1) for i, h in enumerate(hits)))
    return out.select(*requests.columns, *(F.coalesce(*(h[c] for h in hits)).alias(c) for c in columns), tier.alias("tier"))


def with_host_flag(rows: DataFrame, hosts: DataFrame, flag: str, host: str = "host", listed: str = "host") -> DataFrame:
    """rows with a flag for hosts that are on a list or below a host on it.

    Each distinct host is opened to its suffixes and met by equality, so no pair of row and list is compared.
    """
    known = hosts.select(F.lower(F.col(listed)).alias("suffix_")).distinct()
    own = rows.select(F.col(host).alias("host_")).where("host_ is not null").distinct()
    hit = own.select("host_", F.explode(urls.suffixes(F.col("host_"))).alias("suffix_")).join(known, "suffix_", "left_semi").select("host_").distinct()
    joined = rows.join(hit.withColumn("hit_", F.lit(True)), F.col(host) == F.col("host_"), "left")
    return joined.select(*rows.columns, F.coalesce("hit_", F.lit(False)).alias(flag))


def valid_paths(rows: DataFrame, taxonomy: DataFrame, levels: tuple[str, ...]) -> DataFrame:
    """The rows whose trimmed path is in the taxonomy; missing and blank levels are the same."""
    level = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    known = taxonomy.select(*(level(c).alias(f"t{i}") for i, c in enumerate(levels))).distinct()
    same = [level(c) == F.col(f"t{i}") for i, c in enumerate(levels)]
    test = same[0]
    for s in same[1:]:
        test = test & s
    return rows.join(known, test, "left_semi")


def merge_rerun(base: DataFrame, fresh: DataFrame, key: str, position: str, columns: tuple[str, ...]) -> DataFrame:
    """base with the columns of fresh on the first row of each key that fresh has."""
    first = base.groupBy(key).agg(F.min(position).alias("first_"))
    new = fresh.select(F.col(key).alias("key_"), F.struct(*columns).alias("new_"))
    out = base.join(first, key).join(new, (F.col(key) == F.col("key_")) & (F.col(position) == F.col("first_")), "left")
    return out.select(*(F.when(F.col("new_").isNotNull(), F.col("new_")[c]).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns))
