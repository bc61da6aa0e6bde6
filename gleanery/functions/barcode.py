"""Barcode expressions. Barcodes are digit strings; leading zeros show but don't count in comparisons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = (8, 12, 13, 14)


def key(code: Column) -> Column:
    """The comparison key: trimmed, without leading zeros; null where nothing is left."""
    return F.nullif(F.regexp_replace(F.trim(code), "^0+", ""), F.lit(""))


def same(a: Column, b: Column) -> Column:
    return F.coalesce(key(a) == key(b), F.lit(False))


def check_digit(body: Column) -> Column:
    """GS1 modulo 10: weights 3 and 1 by turns from the right of the body."""
    digits = F.transform(F.split(F.reverse(body), ""), lambda d: d.try_cast("int"))
    weighted = F.transform(digits, lambda d, i: d * F.when(i % 2 == 0, 3).otherwise(1))
    total = F.aggregate(weighted, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0)))
    return (10 - total % 10) % 10


def valid(code: Column) -> Column:
    """Whether the code has 8, 12, 13 or 14 digits and the right last one."""
    c = F.trim(code)
    shape = c.rlike("^([0-9]{8}|[0-9]{12,14})$")
    right = check_digit(F.substring(c, F.lit(1), F.length(c) - 1)) == F.right(c, F.lit(1)).try_cast("int")
    return F.coalesce(shape & right, F.lit(False))


def refresh(line: Column) -> Column:
    return F.coalesce(F.upper(F.trim(line)).startswith("REFRESH"), F.lit(False))


def parse_line(line: Column) -> dict[str, Column]:
    """ean, ground_truth and force_refresh of a request line: the first run of 8 to 14 digits, and the rest without it."""
    text = F.trim(line)
    again = refresh(line)
    rest = F.when(again, F.trim(F.substring(text, F.lit(8), F.length(text)))).otherwise(text)
    ean = F.regexp_extract(rest, r"\b([0-9]{8,14})\b", 1)
    left = F.when(ean == "", rest).otherwise(F.replace(rest, ean, F.lit("")))
    return {"ean": F.nullif(ean, F.lit("")), "ground_truth": F.trim(F.regexp_replace(left, r"\s+", " ")), "force_refresh": again}


def cache_key(ean: Column, ground_truth: Column) -> Column:
    """The code, with the normalised text where there is some."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(ground_truth, F.lit(""))), r"\s+", " "))
    return F.when(text == "", ean).otherwise(F.concat_ws("|", ean, text))
