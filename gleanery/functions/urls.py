"""URL expressions: hosts, gates and image checks. The first reason for which a URL fails is told."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import config


def host(url: Column) -> Column:
    """The third part of an http URL between slashes, with its port; null for others."""
    return F.when(url.startswith("http"), F.get(F.split(url, "/"), 2))


def path(url: Column) -> Column:
    """What follows the host, with its slash; empty without."""
    return F.when(url.startswith("http"), F.regexp_replace(url, r"^https?:/*[^/]*", ""))


def holds_any(text: Column, parts: Iterable[str]) -> Column:
    """Whether one of the parts stands in the text, as one pattern: a filter works a text out once for each mention of it."""
    some = "|".join(re.escape(p) for p in parts)
    return F.coalesce(text.rlike(some), F.lit(False)) if some else F.lit(False)


def suffixes(host_: Column) -> Column:
    """a.b.c as [a.b.c, b.c, c]: a suffix join becomes an equality join."""
    parts = F.split(F.lower(host_), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def under(host_: Column, hosts: Iterable[str]) -> Column:
    """Whether the host is one of a short list or below one."""
    listed = [h.lower() for h in hosts]
    return F.coalesce(F.arrays_overlap(suffixes(host_), F.array(*map(F.lit, listed))), F.lit(False)) if listed else F.lit(False)


def http(url: Column) -> Column:
    return F.coalesce(url.startswith("http"), F.lit(False))


def excluded(url: Column, parts: Iterable[str] = config.EXCLUDED_TOKENS) -> Column:
    return holds_any(F.lower(url), parts)


def displayable(url: Column) -> Column:
    return http(url) & ~holds_any(url, config.REDIRECT_TOKENS) & ~excluded(url)


def durable(url: Column) -> Column:
    return http(url) & ~holds_any(F.lower(url), config.EPHEMERAL_TOKENS)


def _composite(low: Column) -> Column:
    return F.contains(low, F.lit("media-amazon.com")) & (F.contains(low, F.lit(",")) | F.contains(low, F.lit("_bo")))


def _bad_extension(low: Column) -> Column:
    bare = F.split_part(low, F.lit("?"), F.lit(1))
    return bare.rlike("(" + "|".join(e.replace(".", r"\.") for e in config.BAD_IMAGE_EXTENSIONS) + ")$")


def image(url: Column) -> Column:
    """The loose image gate."""
    low = F.lower(url)
    return http(url) & ~excluded(url) & ~_bad_extension(low) & ~holds_any(low, config.BAD_IMAGE_TOKENS) & ~_composite(low)


def display_reason(url: Column) -> Column:
    """The strict image gate's first reason, or null for a URL that passes."""
    low = F.lower(url)
    words = F.split(F.split_part(low, F.lit("?"), F.lit(1)), r"[/_\-.]+")
    return (
        F.when(~http(url), "not http")
        .when(excluded(url), "excluded host")
        .when(_bad_extension(low), "extension")
        .when(holds_any(low, config.BAD_DISPLAY_PARTS), "blocked part")
        .when(F.arrays_overlap(words, F.array(*map(F.lit, config.BAD_DISPLAY_PATH_TOKENS))), "path word")
        .when(_composite(low), "composite")
    )


def image_kind(declared: Column, data: Column) -> Column:
    """The declared kind if it is one of four, else what the first bytes say."""
    clean = F.lower(F.trim(F.split_part(declared, F.lit(";"), F.lit(1))))
    out = F.when(clean.isin(*config.IMAGE_KINDS), clean)
    for magic, kind in config.MAGIC:
        out = out.when(F.hex(F.substring(data, 1, len(magic) // 2)) == magic, kind)
    return out


def image_fault(width: Column, height: Column, least_edge: int = 120, ratios: tuple[float, float] = (0.3, 3.0)) -> Column:
    """Why an image can't be shown, or null."""
    ratio = width / F.nullif(height, F.lit(0))
    return F.when(F.coalesce(height, F.lit(0)) == 0, "no height").when(F.greatest(width, height) < least_edge, "too small").when(~ratio.between(*ratios), "aspect")
