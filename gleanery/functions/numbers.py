"""Numbers and units out of messy text, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.config import BOUNDS, KJ_PER_KCAL
from gleanery.functions.binding import let


def to_double(raw: Column) -> Column:
    """The first decimal number in a text, in European or English notation; null without one.

    After digits, dots and blanks one more separator and its digits count. A comma is a decimal one unless it parts three
    digits; of two kinds the last is decimal; several dots part thousands. A sign doesn't count.
    """
    text = F.replace(raw, F.lit(" "), F.lit(" "))
    found = F.replace(F.regexp_extract(text, r"([0-9][0-9.\s]*[.,]?[0-9]*)", 1), F.lit(" "), F.lit(""))

    def plain(n: Column) -> Column:
        comma, dots = F.contains(n, F.lit(",")), F.length(n) - F.length(F.replace(n, F.lit("."), F.lit("")))
        return (
            F.when(comma & (dots > 0), F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
            .when(comma & n.rlike(r"^[0-9]{1,3},[0-9]{3}$"), F.replace(n, F.lit(","), F.lit("")))
            .when(comma, F.replace(n, F.lit(","), F.lit(".")))
            .when(dots > 1, F.replace(n, F.lit("."), F.lit("")))
            .otherwise(n)
        )

    return let(let(found, plain), lambda n: F.when(n.rlike(r"^([0-9]+\.?[0-9]*)$"), n.try_cast("double")))


def text_of(v: Column) -> Column:
    """A number as text: whole within 1e-9, else with at most three decimals and no zeros at the end."""

    def shown(v: Column) -> Column:
        whole = F.abs(v - F.round(v)) < 1e-9
        three = F.round(v.cast("decimal(30,9)"), 3).cast("decimal(30,3)").cast("string")
        return F.when(whole, F.round(v).cast("decimal(30,0)").cast("string")).otherwise(F.regexp_replace(F.regexp_replace(three, "0+$", ""), r"\.$", ""))

    return let(v, shown)


def energy_kj(raw: Column) -> Column:
    """Energy in kJ: kJ as it stands, kcal converted, and without a unit by size (over 400 it is kJ)."""
    low = F.lower(raw)

    def unit(v: Column) -> Column:
        kcal = v * KJ_PER_KCAL
        return F.when(F.contains(low, F.lit("kj")), v).when(F.contains(low, F.lit("cal")), kcal).when(v > 400, v).otherwise(kcal)

    return let(to_double(low), unit)


def salt_g(raw: Column) -> Column:
    """Salt in g from sodium in g, or in mg where the text says so."""
    return let(to_double(F.lower(raw)), lambda v: F.when(F.contains(F.lower(raw), F.lit("mg")), v / 1000).otherwise(v) * 2.5)


def bounded(field: Column, v: Column) -> Column:
    """v where the field's range per 100 g has it, or the field has no range; else null."""

    def inside(v: Column) -> Column:
        out = v
        for name, (low, high) in BOUNDS.items():
            out = F.when((field == name) & ~v.between(low, high), F.lit(None)).otherwise(out)
        return out

    return let(v, inside)


def energy_label(kj: Column) -> Column:
    """"<kJ> kJ / <kcal> kcal"; the kcal are whole within 0.05. A text that is no number stays as it is."""
    v = F.replace(kj, F.lit(","), F.lit(".")).try_cast("double")
    kcal = v / KJ_PER_KCAL
    shown = F.when(F.abs(kcal - F.round(kcal)) < 0.05, F.round(kcal).cast("bigint").cast("string")).otherwise(F.round(kcal.cast("decimal(30,9)"), 1).cast("decimal(30,1)").cast("string"))
    return F.when(F.coalesce(kj, F.lit("")) == "", "").when(v.isNull(), kj).otherwise(F.concat(kj, F.lit(" kJ / "), shown, F.lit(" kcal")))
