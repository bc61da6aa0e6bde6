"""Whether a page is about the product: by its code (A), or by name and weight on trusted hosts (B)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import barcode, html, text


def route(page: Column, ean: Column, anchors: Column, gtins: Column, trusted: Column, least: float = 0.55, require_trust: bool = True) -> Column:
    """'A', 'B' or null. With least 0.8 and without require_trust this is the older, ungated rule."""
    by_code = html.labelled_code(page, ean) | F.coalesce(F.exists(gtins, lambda g: barcode.same(g, ean)), F.lit(False))
    title = html.title_bits(page)
    by_name = (title != "") & (text.best_ratio(anchors, title) >= least) & ~text.weights_conflict(anchors, title)
    gate = F.coalesce(trusted, F.lit(False)) if require_trust else F.lit(True)
    return F.when(by_code, "A").when(gate & F.coalesce(by_name, F.lit(False)), "B")


def code_evidence(page: Column, ean: Column, ground_truth: Column, least: float = 0.4) -> Column:
    """Labelled code: true. A bare one: true if the title has enough of the wanted name."""
    bare = F.contains(page, F.regexp_replace(F.trim(ean), "^0+", "")) & (barcode.key(ean).isNotNull())
    wanted = F.coalesce(ground_truth, F.lit("")) != ""
    return F.coalesce(html.labelled_code(page, ean) | (bare & wanted & (text.name_ratio(ground_truth, html.title_bits(page)) >= least)), F.lit(False))


def trusted(host: Column, listed: Column, brand: Column) -> Column:
    return F.coalesce(listed, F.lit(False)) | text.brand_in_host(brand, host)


def snippet_has_code(snippet: Column, ean: Column) -> Column:
    """Whether a search result's text holds the code, with or without its leading zeros."""
    return F.coalesce(F.contains(snippet, ean) | F.contains(snippet, barcode.key(ean)), F.lit(False))
