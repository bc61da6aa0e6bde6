"""HTML expressions that need no parser: titles, visible text and labelled facts by pattern."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery import config
from gleanery.functions import numbers
from gleanery.functions.binding import let


def squeezed(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def title_bits(html: Column) -> Column:
    """og:title, title and first h1 in one line, tags taken out."""
    patterns = (r"(?is)<meta[^>]+og:title[^>]+content=[\"']([^\"']+)", r"(?is)<title[^>]*>([^<]+)</title>", r"(?is)<h1[^>]*>(.*?)</h1>")
    bits = [F.nullif(F.regexp_replace(F.regexp_extract(html, p, 1), r"<[^>]+>", " "), F.lit("")) for p in patterns]
    return squeezed(F.concat_ws(" ", *bits))


def stripped(html: Column, tags: tuple[str, ...] = ("script", "style")) -> Column:
    """The text of a page: the tags' blocks and all other tags as blanks."""
    for t in tags:
        html = F.regexp_replace(html, rf"(?is)<{t}.*?</{t}>", " ")
    return squeezed(F.regexp_replace(html, r"<[^>]+>", " "))


def visible(html: Column, most: int = 20_000) -> Column:
    """The first `most` characters of the page's text."""
    return F.left(stripped(html, ("script", "style", "noscript")), F.lit(most))


def inline_number(text: Column, field: str) -> Column:
    """A nutrition number beside its label and unit in flat text: the first label that matches, in the list's order."""
    labels = dict(config.NUTRITION_LABELS)[field]
    unit = "(?:kj|kcal)" if field == "energy_kj" else "(?:g|mg)"
    low = F.lower(text)
    hits = [F.nullif(F.regexp_extract(low, rf"{re.escape(v)}[^0-9<]{{0,25}}[0-9][0-9.,]*\s*{unit}", 0), F.lit("")) for v in labels]

    def number(hit: Column) -> Column:
        return numbers.energy_kj(hit) if field == "energy_kj" else numbers.to_double(F.regexp_extract(hit, r"([0-9][0-9.,]*)\s*(?:g|mg)$", 1))

    return numbers.bounded(F.lit(field), let(F.coalesce(*hits), number))


def labelled_paragraph(text: Column, labels: tuple[str, ...], stops: tuple[str, ...], least: int, window: int = 600, most: int = 500) -> Column:
    """The segment after the first label that gives one: up to a sentence end or a word that begins another section."""
    low = F.lower(text)
    stop = "|".join((r"\.\s", r"\n", *config.SECTION_STOPS, *stops))
    pointer = r"(?i)\b(" + "|".join(config.POINTER_WORDS) + r")\b"
    tries = []
    for label in labels:
        at = F.locate(label, low)
        after = F.regexp_replace(F.substring(text, at + len(label), F.lit(window)), r"^[\s:：\-–—.]+", "")
        seg = squeezed(F.get(F.split(after, stop, 2), 0))
        seg = F.regexp_replace(seg, r"(?i)^(?:" + "|".join(labels) + r")\s*[:：]?\s*", "")

        def fitting(seg: Column) -> Column:
            fits = F.length(seg) >= least
            if labels is not config.INGREDIENT_LABELS:
                fits = fits & ~seg.rlike(pointer)
            return F.when(fits, F.left(seg, F.lit(most)))

        tries.append(F.when(at > 0, let(seg, fitting)))
    return F.coalesce(*tries)


def ingredients(text: Column) -> Column:
    return labelled_paragraph(text, config.INGREDIENT_LABELS, ("Allerg",), 8)


def allergens(text: Column) -> Column:
    return labelled_paragraph(text, config.ALLERGEN_LABELS, ("Zutaten", "Ingredient", "Ingrédient", "Ingredienti"), 3)


def may_contain(text: Column) -> Column:
    return labelled_paragraph(text, config.MAY_CONTAIN_LABELS, ("Zutaten", "Ingredient", "Allerg"), 3)


def labelled_code(html: Column, ean: Column) -> Column:
    """Whether the code stands in a labelled place: leading zeros don't count, further digits do."""
    bare = F.regexp_replace(F.trim(ean), "^0+", "")
    strict = F.concat(F.lit(r"(?i)(gtin\d*|\"sku\"|itemprop=[\"']gtin)[\s\"':=]+[\"']?0*"), bare, F.lit(r"(?!\d)"))
    loose = F.concat(F.lit(r"(?i)(ean|gtin|barcode|strichcode|streepjescode|codice\s*a\s*barre|c[oó]digo\s*de\s*barras|upc)[^0-9]{0,30}0*"), bare, F.lit(r"(?!\d)"))
    return F.coalesce(F.when(bare == "", False).otherwise(F.regexp(html, strict) | F.regexp(html, loose)), F.lit(False))


def og_image(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?is)<meta[^>]+og:image[^>]+content=[\"']([^\"']+)", 1), F.lit(""))
