"""Images: policy on scores, ranking, near-duplicate suppression by perceptual hash, ownership of URLs."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleanery.sources.scratch import written


def priority(source: Column, table: dict[str, int], other: int = 30) -> Column:
    out = F.lit(other)
    for name, p in table.items():
        out = F.when(source == name, p).otherwise(out)
    return out


def score(base: Column, long_edge: Column, match: Column) -> Column:
    return base + F.least(F.lit(20.0), F.coalesce(long_edge, F.lit(0)) / 75) + 40 * F.coalesce(match, F.lit(0.5))


def accepted(match: Column, trusted: Column, trusted_least: float = 0.35, least: float = 0.55) -> Column:
    """Whether a match score passes; -1 stands for a scorer that failed, which only trusted images pass."""
    return F.when(match < 0, trusted).otherwise(match >= F.when(trusted, trusted_least).otherwise(least))


def verdict(url_fault: Column, image_fault: Column, title_ok: Column, passed: Column) -> Column:
    """The first check that an image fails, or "ok"; cheap checks come first."""
    return F.coalesce(url_fault, image_fault, F.when(~title_ok, "title"), F.when(~passed, "match"), F.lit("ok"))


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two hashes; a missing hash is 999 away."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(999))


def neighbours(images: DataFrame, keys: list[str], tie: str, hash_col: str, under: int = 5) -> DataFrame:
    """(keys, tie, other, distance): every pair of a group whose 64-bit hashes differ in fewer than `under` bits.

    Of `under` bands of bits such a pair has one in common, so pairs meet by equality of a band; the first common one gives the row.
    """
    edges = [64 * i // under for i in range(under + 1)]
    masks = [((1 << b) - (1 << a) + (1 << 63)) % (1 << 64) - (1 << 63) for a, b in zip(edges, edges[1:])]

    def band(h: Column, i: int) -> Column:
        return h.bitwiseAND(F.lit(masks[i]).cast("bigint"))

    rows = images.where(F.col(hash_col).isNotNull()).select(*keys, F.col(tie).alias("id_"), F.col(hash_col).alias("hash_"))
    dealt = rows.select("*", F.posexplode(F.array(*(band(F.col("hash_"), i) for i in range(under)))).alias("band_", "bits_"))
    a, b = dealt.alias("a"), dealt.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*keys, "band_", "bits_")]
    met = a.join(b, [*on, F.col("a.id_") < F.col("b.id_")])
    differs = F.col("a.hash_").bitwiseXOR(F.col("b.hash_"))
    first = F.coalesce(*(F.when(band(differs, i) == 0, i) for i in range(under)))
    d = distance(F.col("a.hash_"), F.col("b.hash_"))
    return met.where((d < under) & (first == F.col("a.band_"))).select(*(F.col(f"a.{k}").alias(k) for k in keys), F.col("a.id_").alias(tie), F.col("b.id_").alias("other"), d.alias("distance"))


def _met(rows: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """rows with the one row of others that has the same keys, nulls being equal; keys of others come prefixed with k_."""
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in keys]
    return rows.join(others.select(*(F.col(k).alias(f"k_{k}") for k in keys), *(c for c in others.columns if c not in keys)), same, "left").drop(*(f"k_{k}" for k in keys))


def pick_distinct(images: DataFrame, keys: list[str], score_col: str, tie: str, hash_col: str, most: int = 2, least_distance: int = 5) -> DataFrame:
    """(keys, tie, n): the best images of each group that differ enough from each better one that was picked.

    Picks are made round by round: the best of what is left, an aggregate that is summed before the shuffle; then what is
    too near to it goes. So no group is ever gathered, however many near-duplicates it begins with. A missing score
    is the lowest, a missing hash is far from all.
    """
    left = images.select(*keys, F.struct(F.col(score_col).isNull().alias("a"), (-F.col(score_col)).alias("b"), F.col(tie).alias("id"), F.col(hash_col).alias("hash")).alias("x_"))
    picks = []
    for n in range(1, most + 1):
        best = written(left.groupBy(*keys).agg(F.min("x_").alias("best_")), "picks")
        picks.append(best.select(*keys, F.col("best_.id").alias(tie), F.lit(n).alias("n")))
        left = _met(left, best, keys).where(((F.col("x_.id") != F.col("best_.id")) | F.col("x_.hash").isNotNull()) & (distance(F.col("x_.hash"), F.col("best_.hash")) >= least_distance)).drop("best_")
    return reduce(DataFrame.union, picks)


def url_owners(rows: DataFrame, url: str, owner: str, order: list[str]) -> DataFrame:
    """rows with `first_owner` of each URL and `duplicate` where that is another.

    The first owner is an aggregate, so a URL with a third of all rows is summed before the shuffle and met as one row.
    """
    first = rows.groupBy(url).agg(F.min_by(owner, F.struct(*order)).alias("first_owner"))
    return _met(rows, first, [url]).withColumn("duplicate", F.col("first_owner") != F.col(owner))


def prefix_distinct(rows: DataFrame, data: str, keys: list[str], order: list[str], length: int = 120, most: int = 2) -> DataFrame:
    """The first row of each byte prefix, `most` a group."""
    w = Window.partitionBy(*keys, "prefix_").orderBy(*order)
    kept = rows.withColumn("prefix_", F.substring(data, 1, length)).withColumn("n_", F.row_number().over(w)).where("n_ = 1")
    return kept.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("n") <= most).drop("n_", "prefix_")


def _phash(image: dict) -> int | None:
    """The 64 signs of the low cosine frequencies of a 32 x 32 grey picture against their median."""
    h, w, c, data = image["height"], image["width"], image["nChannels"], image["data"]
    if not data or h < 1 or w < 1:
        return None
    x = np.frombuffer(data, dtype=np.uint8).reshape(h, w, c)[:, :, :3].mean(axis=2)
    x = x[np.ix_(np.arange(32) * h // 32, np.arange(32) * w // 32)]
    k = np.arange(32)
    basis = np.cos(np.pi * (2 * k[None, :] + 1) * k[:, None] / 64)
    low = (basis @ x @ basis.T)[:8, :8].ravel()
    return int(np.packbits(low > np.median(low)).view(">i8")[0])


@F.pandas_udf(T.LongType())
def perceptual_hash(image: pd.DataFrame) -> pd.Series:
    """Over the struct that Spark's image source gives."""
    return pd.Series([_phash(r) for r in image.to_dict("records")], dtype="Int64")
