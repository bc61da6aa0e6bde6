"""Fusing pages to one record: rank, first value in rank order, corroboration by other hosts, plausibility and grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import config
from gleanery.functions import text


def page_rank(trusted: Column, route: Column, aggregator: Column, pos: Column) -> Column:
    """Trusted pages first, then by route, then aggregators, then as they came."""
    by_route = F.when(route == "A", 0).when(route == "B", 1).otherwise(2)
    return F.struct((~trusted).cast("int").alias("a"), by_route.alias("b"), (~aggregator).cast("int").alias("c"), pos.alias("d"))


def fill(pages: DataFrame, rank: Column, fields: tuple[str, ...] = config.FIELDS, req: str = "req_id") -> DataFrame:
    """A record for each request: of each field the first value in rank order that isn't empty, and where it is from.

    One aggregation for all fields; it sums before the shuffle, so a request with many pages is no heavier.
    """
    pages = pages.withColumn("rank_", rank)
    has = lambda f: F.coalesce(F.col(f), F.lit("")) != ""
    aggs = [F.min(F.when(has(f), F.struct("rank_", F.col(f).alias("v")))).alias(f) for f in fields]
    return pages.groupBy(req).agg(*aggs).select(req, *(F.col(f)["v"].alias(f) for f in fields), *(F.col(f)["rank_"].alias(f"{f}_rank") for f in fields))


def long_form(pages: DataFrame, keep: list[str], fields: tuple[str, ...] = config.FIELDS) -> DataFrame:
    """A row for each field of a page that isn't empty."""
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields)))
    return pages.select(*keep, pairs.alias("p")).select(*keep, "p.field", "p.value").where("value <> ''")


def corroborated(winners: DataFrame, values: DataFrame, agree: Column, keys: list[str], host: str = "host", least: int = 2) -> DataFrame:
    """winners with n_hosts, the distinct hosts whose value agrees, and corroborated. agree compares w.value and v.value.

    Winners meet the values of their own key alone, one winner a key, so the work is linear in the values.
    """
    met = winners.alias("w").join(values.alias("v").hint("merge"), [F.col(f"w.{k}") == F.col(f"v.{k}") for k in keys])
    counts = met.where(agree).groupBy(*(F.col(f"w.{k}").alias(k) for k in keys)).agg(F.count_distinct(F.col(f"v.{host}")).alias("n_hosts"))
    return winners.join(counts.hint("merge"), keys, "left").withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0))).withColumn("corroborated", F.col("n_hosts") >= least)


def agreement(field: Column, a: Column, b: Column, number_a: Column, number_b: Column, least: float = 0.8) -> Column:
    """Numbers within their tolerance, texts by their tokens."""
    return F.when(field.isin(*config.NUTRITION, "net_weight", "gross_weight"), text.numbers_agree(number_a, number_b)).otherwise(text.texts_agree(a, b, least))


def implausible(values: dict[str, Column]) -> Column:
    """Why nutrition per 100 g can't be right, the first reason; null if it can. values are doubles, null for unknown."""
    v = {k: values.get(k, F.lit(None).cast("double")) for k in config.NUTRITION}
    zero = {k: F.coalesce(c, F.lit(0.0)) for k, c in v.items()}
    kj = (9 * zero["fat_g"] + 4 * zero["carbohydrates_g"] + 4 * zero["protein_g"] + 2 * zero["fiber_g"]) * config.KJ_PER_KCAL
    out = (
        F.when(zero["fat_g"] + zero["carbohydrates_g"] + zero["protein_g"] > 100.5, "macro sum")
        .when(v["saturates_g"] > v["fat_g"] + 0.5, "saturates over fat")
        .when(v["sugars_g"] > v["carbohydrates_g"] + 0.5, "sugars over carbohydrates")
        .when((v["energy_kj"] > 0) & (kj > F.greatest(v["energy_kj"] * 3, v["energy_kj"] + 800)), "energy under macros")
    )
    for k, cap in config.CAPS:
        out = out.when(v[k] > cap, f"{k} over {cap}")
    return out


def status(readable: Column, verified: Column) -> Column:
    return F.when(readable, "success").when(verified, "page_not_readable").otherwise("no_source")


def reliability(readable: Column, trusted: Column, corroborated_: Column, implausible_: Column) -> Column:
    """H for trusted contributors, M for corroborated values, else L; L where nutrition is implausible; null without a page."""
    return F.when(readable, F.when(implausible_, "L").when(trusted, "H").when(corroborated_, "M").otherwise("L"))


def provenance(readable: Column, trusted: Column, n_hosts: Column, implausible_: Column) -> Column:
    told = F.when(trusted, "trusted source").when(n_hosts >= 2, F.concat(n_hosts.cast("string"), F.lit(" sources agree"))).otherwise("single source")
    return F.when(~readable, "none").when(implausible_, F.concat(told, F.lit("; nutrition withheld"))).otherwise(told)


def tags(values: dict[str, Column], liquid: Column) -> Column:
    """Claims that follow from numbers: low sugar, low fat, high protein."""
    low_sugar = values["sugars_g"] <= F.when(liquid, 2.5).otherwise(5.0)
    low_fat = values["fat_g"] <= F.when(liquid, 1.5).otherwise(3.0)
    protein = values["protein_g"] * 4 * config.KJ_PER_KCAL > 0.2 * values["energy_kj"]
    named = (("low sugar", low_sugar), ("low fat", low_fat), ("high protein", protein))
    return F.concat_ws(",", *(F.when(F.coalesce(c, F.lit(False)), n) for n, c in named))
