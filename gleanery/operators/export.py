"""The output edge: fixed columns, sanitised texts, audit lists, not-found rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import config
from gleanery.functions import text


def ordered(columns: list[str], clusters: list[list[str]]) -> list[str]:
    """Columns by cluster, those of no cluster last in their own order."""
    named = [c for cluster in clusters for c in cluster if c in columns]
    return named + [c for c in columns if c not in named]


def sanitised(df: DataFrame) -> DataFrame:
    """Every column as text, without nulls and words for them."""
    return df.select(*(text.sanitised(F.col(c).cast("string")).alias(c) for c in df.columns))


def with_missing(found: DataFrame, missing: DataFrame) -> DataFrame:
    """Full rows and the shorter rows of products without a source, in one schema."""
    return found.unionByName(missing, allowMissingColumns=True)


def joined_links(links: Column, most: int = 5, sep: str = " | ") -> Column:
    """The first links as one text; links are an array of (pos, url)."""
    return F.array_join(F.slice(F.transform(F.array_sort(links), lambda x: x["url"]), 1, most), sep)


def link_basis(by_code: Column, by_name: Column, by_registry: Column) -> Column:
    return F.concat_ws(" + ", F.when(by_code, "code"), F.when(by_name, "name"), F.when(by_registry, "registry"))


def failed_status(search_failed: Column, n_sources: Column) -> Column:
    """Why a request ends early, or null: a search that failed is no proof that nothing is there."""
    return F.when(n_sources > 0, F.lit(None)).when(search_failed, "Search failed").otherwise("Not found")


def final_status(status: Column) -> Column:
    return F.when(status == "success", "Success").otherwise("Failed Validation")


def final_reliability(status: Column, reliability: Column) -> Column:
    """H, M or L of a success; L for all else."""
    return F.when((status == "success") & reliability.isin("H", "M"), reliability).otherwise("L")


def reasoning(status: Column, reliability: Column, sources: Column, most: int = 2) -> Column:
    """Why a row is as reliable as it is, with its first sources, an array of hosts; missing ones are an empty text."""
    named = F.array_join(F.slice(F.coalesce(sources, F.array().cast("array<string>")), 1, most), ", ")
    told = {k: F.format_string(v.replace("%s", "%1$s"), named) for k, v in config.REASONS.items()}
    success = F.when(reliability == "H", told["H"]).when(reliability == "M", told["M"]).otherwise(told["L"])
    return F.when(status == "success", success).when(status == "page_not_readable", told["page_not_readable"]).otherwise(told["no_source"])


def ends_early(name: Column, verified: Column, known: Column, n_images: Column, placeholder: str) -> Column:
    """Whether no source knows a product: no name, no proof of its code, no registry and no image."""
    false, none = F.lit(False), F.lit(0)
    return F.coalesce(name.startswith(placeholder), F.lit(True)) & ~F.coalesce(verified, false) & ~F.coalesce(known, false) & (F.coalesce(n_images, none) == 0)


def merged(classified: list[str], fields: list[str]) -> list[str]:
    """The classifier's columns without those that the record has itself."""
    return [c for c in classified if c not in fields]
