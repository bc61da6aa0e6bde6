"""Ladders over landed search results: which pages to read, what a product is called, which images to look at.

Results are (req_id, step, rank, link, title, snippet, error), step a key of STEPS and rank from 0; where a place was landed twice
the least row counts. A failed search is one row with its error. A ladder keeps the places within its limits, so what is gathered
for a request is bounded by these limits, and walks them in order by one native fold.

Requests are as many as their results, so tables of them are met by merge joins: the size that Spark guesses from compressed files
lets it broadcast tables that the driver can't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.config import Settings
from gleanery.functions import text, urls
from gleanery.operators import verify
from gleanery.operators.candidates import links_per_host

#: Searches in the order in which they are made.
STEPS = {"brand": 0, "name_code": 1, "aggregator": 2, "market": 3, "code": 4, "name_market": 5, "name": 6, "name_plain": 7}
#: How many results of each search are looked at.
PAGE_LIMITS = {"brand": 5, "name_code": 5, "aggregator": 5, "market": 4, "code": 4, "name_market": 4, "name": 4}
NAME_LIMITS = {"brand": 5, "name_code": 5, "market": 4, "code": 4, "name_market": 4, "name": 4, "name_plain": 4}
IMAGE_STAGES = {"registry_a": 0, "brand": 1, "shopping": 2, "page": 3, "strict": 4, "barcode": 5, "shopping_name": 6, "last": 7, "registry_b": 8}
IMAGE_LIMITS = {"registry_a": 1, "brand": 8, "shopping": 10, "page": 60, "strict": 12, "barcode": 12, "shopping_name": 6, "last": 6, "registry_b": 1}
PLACEHOLDER = "Product with EAN "


def _table(values: dict[str, int], key: Column) -> Column:
    """The value of a key; null for others."""
    return F.element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


def _wanted() -> Column:
    return text.without_packs(F.coalesce(F.col("ground_truth"), F.lit("")))


def _seen(requests: DataFrame, results: DataFrame, limits: dict[str, int], settings: Settings, trust: bool) -> DataFrame:
    """Each place within the limits with what the steps ask of it, as the column x; one row for a place.

    What only some steps ask is null for the others. With trust, x tells whether places from the code on are trusted and alike.
    """
    place = results.where(F.col("rank").between(0, _table(limits, F.col("step")) - 1)).select("req_id", _table(STEPS, F.col("step")).alias("step"), "rank", F.struct("link", "title", "snippet", "error").alias("r_"))
    one = place.groupBy("req_id", "step", "rank").agg(F.min("r_").alias("r_"))
    asked = requests.select("req_id", "ean", _wanted().alias("wanted_")).withColumn("brand_", text.brand("wanted_"))
    rows = one.join(asked.hint("merge"), "req_id")
    link, host = F.coalesce("r_.link", F.lit("")), F.lower(urls.host(F.col("r_.link")))
    title = text.name_from_title(F.coalesce("r_.title", F.lit("")))
    late = F.col("step") >= STEPS["code"]
    alike = (
        F.when(late, verify.trusted(host, urls.under(host, settings.trusted_hosts), F.col("brand_"))).alias("trusted"),
        F.when(late, text.weights_conflict(F.array(F.nullif(F.col("wanted_"), F.lit(""))), title)).alias("conflict"),
        F.when(late, text.word_ratio(F.col("wanted_"), title)).alias("ratio"),
    )
    x = F.struct(
        "step",
        "rank",
        link.alias("link"),
        title.alias("title"),
        (F.col("wanted_") != "").alias("asked"),
        F.col("r_.error").isNotNull().alias("failed"),
        ((link != "") & ~urls.excluded(link, settings.excluded_tokens)).alias("allowed"),
        urls.http(link).alias("http"),
        text.garbage_name(title).alias("garbage"),
        F.when(F.col("step") == STEPS["brand"], text.brand_in_host(F.col("brand_"), host)).alias("brand"),
        F.when(F.col("step") == STEPS["name_code"], verify.snippet_has_code(F.col("r_.snippet"), F.col("ean"))).alias("code"),
        F.when(F.col("step") == STEPS["code"], text.relevant(F.col("wanted_"), F.col("r_.title"), F.col("r_.snippet"), settings.min_relevance)).alias("relevant"),
        *(alike if trust else ()),
    )
    return rows.select("req_id", x.alias("x"))


def evidence(requests: DataFrame, results: DataFrame, pages: DataFrame, limits: dict[str, int] | None = None) -> DataFrame:
    """(req_id, link): the results of searches by brand or name whose landed page (url, html) is about the code."""
    by_page = {k: v for k, v in (limits or NAME_LIMITS).items() if k not in ("market", "code")}
    pairs = results.where(F.col("rank").between(0, _table(by_page, F.col("step")) - 1)).select("req_id", "link").distinct()
    asked = requests.select("req_id", "ean", _wanted().alias("wanted_"))
    met = pairs.join(asked.hint("merge"), "req_id").join(pages.select(F.col("url").alias("link"), "html").hint("merge"), "link")
    return met.where(verify.code_evidence(F.col("html"), F.col("ean"), F.col("wanted_"))).select("req_id", "link").distinct()


def _added(links: Column, link: Column, wanted: Column, front: Column | None = None) -> Column:
    new = wanted & ~F.array_contains(links, link)
    out = F.when(new, F.concat(links, F.array(link))).otherwise(links)
    return out if front is None else F.when(new & front, F.concat(F.array(link), links)).otherwise(out)


def discover(requests: DataFrame, results: DataFrame, settings: Settings | None = None, enough: int = 4) -> DataFrame:
    """(req_id, name, verified, links) for each request (req_id, ean, ground_truth, name, verified): its pages to read, in order.

    The first brand-host hit, results whose snippet has the code, aggregators and market sites are taken; the code alone and the
    two name searches only while fewer than `enough` links were there when the search began. A name that is missing comes from the
    first title that may give one. Requests without results, or with nulls for a text, keep what they have and get no links.
    """
    settings = settings or Settings()
    x = F.col("x")
    named = x["step"] >= STEPS["name_market"]
    passes = (
        F.when(x["failed"], False)
        .when(x["step"] == STEPS["brand"], x["asked"] & x["allowed"] & x["brand"])
        .when(x["step"] == STEPS["name_code"], x["asked"] & x["allowed"] & x["code"])
        .when(x["step"] == STEPS["code"], x["relevant"])
        .when(named, x["asked"] & x["allowed"] & ~x["garbage"])
        .otherwise(True)
    )
    rows = _seen(requests, results, PAGE_LIMITS, settings, False).groupBy("req_id").agg(F.array_sort(F.collect_list(F.when(passes, x))).alias("xs_"))
    rows = requests.select("req_id", "name", "verified").join(rows.hint("merge"), "req_id", "left")
    start = F.struct(
        F.array().cast("array<string>").alias("links"),
        F.nullif(F.col("name"), F.lit("")).alias("name"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.lit(-1).alias("step"),
        F.lit(0).alias("before"),
    )

    def walk(s: Column, x: Column) -> Column:
        entering = x["step"] != s["step"]
        before = F.when(entering, F.size(s["links"])).otherwise(s["before"])
        takes = F.when(x["step"] == STEPS["brand"], entering).otherwise((x["step"] < STEPS["code"]) | (before < enough))
        names = F.when(x["step"] == STEPS["market"], (x["rank"] == 0) & ~x["garbage"]).otherwise((x["step"] != STEPS["aggregator"]) & (x["step"] != STEPS["code"]) & ((x["step"] == STEPS["brand"]) | ~x["garbage"]))
        return F.struct(
            _added(s["links"], x["link"], takes & x["http"] & x["allowed"]).alias("links"),
            F.coalesce(s["name"], F.when(takes & names, F.nullif(x["title"], F.lit("")))).alias("name"),
            (s["verified"] | (takes & (x["step"] == STEPS["name_code"]))).alias("verified"),
            x["step"].alias("step"),
            before.alias("before"),
        )

    end = F.aggregate(F.coalesce("xs_", F.array()), start, walk)
    return rows.withColumn("end_", end).select("req_id", F.col("end_.name").alias("name"), F.col("end_.verified").alias("verified"), F.col("end_.links").alias("links"))


def found(discovered: DataFrame) -> DataFrame:
    """(req_id, pos, url) from what discover() gives, pos from 0."""
    return discovered.select("req_id", F.posexplode("links").alias("pos", "url"))


def resolve(requests: DataFrame, results: DataFrame, confirmed: DataFrame, settings: Settings | None = None, least_ratio: float = 0.6) -> DataFrame:
    """(req_id, name, named_by, verified, search_failed, links) for each request (req_id, ean, ground_truth, name, verified).

    confirmed is what evidence() gives. The registry's name counts unless it is none. Then, until one names the product: the brand's
    own page, a result with the code, the first market result, a trusted first result for the code alone, a result for the name that
    is confirmed, or trusted and alike. Links that prove the code go first. A name that is not of food gives way to the placeholder,
    and stays verified. search_failed: a search that was due from the market on had failed. named_by is null for a registry's name or none.
    """
    settings = settings or Settings()
    x = F.col("x")
    step = x["step"]
    due = (
        F.when(x["failed"], step >= STEPS["market"])
        .when(step == STEPS["brand"], x["asked"] & x["allowed"] & x["brand"])
        .when(step == STEPS["name_code"], x["asked"] & x["allowed"] & ~x["garbage"])
        .when(step >= STEPS["name_market"], x["asked"] & x["allowed"] & ~x["garbage"])
        .otherwise(True)
    )
    rows = _seen(requests, results, NAME_LIMITS, settings, True).groupBy("req_id").agg(F.array_sort(F.collect_list(F.when(due, x))).alias("xs_"))
    # A request has at most as many confirmed links as places.
    proven = confirmed.groupBy("req_id").agg(F.collect_set("link").alias("proven_"))
    rows = requests.select("req_id", "ean", "name", "verified").join(rows.hint("merge"), "req_id", "left").join(proven.hint("merge"), "req_id", "left")
    rows = rows.withColumn("proven_", F.coalesce("proven_", F.array().cast("array<string>")))
    start = F.struct(
        F.array().cast("array<string>").alias("links"),
        F.when(~text.garbage_name(F.col("name")), F.col("name")).alias("name"),
        F.lit(-1).alias("named_by"),
        F.coalesce("verified", F.lit(False)).alias("verified"),
        F.lit(False).alias("failed"),
        F.lit(-1).alias("step"),
        F.lit(True).alias("open"),
    )

    def walk(s: Column, x: Column) -> Column:
        step, entering = x["step"], x["step"] != s["step"]
        opened = F.when(entering, s["name"].isNull()).otherwise(s["open"])
        brand, market, code, by_name = step == STEPS["brand"], step == STEPS["market"], step == STEPS["code"], step >= STEPS["name_market"]
        proven = F.array_contains(F.col("proven_"), x["link"])
        alike = x["trusted"] & ~x["conflict"]
        takes = (
            F.when(brand, entering)
            .when(step == STEPS["name_code"], s["name"].isNull() & (x["code"] | proven))
            .when(by_name, s["name"].isNull() & (proven | (alike & (x["ratio"] >= least_ratio))))
            .otherwise(opened & x["allowed"] & (market | x["relevant"]))
        )
        takes = takes & ~x["failed"]
        first = opened & (x["rank"] == 0) & ~x["garbage"] & ~x["failed"]
        names = F.when(brand, takes & proven).when(market, first).when(code, first & alike & x["relevant"]).otherwise(takes)
        verifies = takes & F.when(brand | by_name, proven).otherwise(step == STEPS["name_code"])
        name = F.when(names, F.nullif(x["title"], F.lit("")))
        return F.struct(
            _added(s["links"], x["link"], takes, brand | verifies).alias("links"),
            F.coalesce(s["name"], name).alias("name"),
            F.when(s["name"].isNull() & name.isNotNull(), step).otherwise(s["named_by"]).alias("named_by"),
            (s["verified"] | verifies).alias("verified"),
            (s["failed"] | (x["failed"] & opened)).alias("failed"),
            step.alias("step"),
            opened.alias("open"),
        )

    end = F.aggregate(F.coalesce("xs_", F.array()), start, walk)
    name = F.coalesce(F.when(text.food_title(F.col("end_.name")), F.col("end_.name")), F.concat(F.lit(PLACEHOLDER), F.coalesce("ean", F.lit(""))))
    step_name = F.get(F.array(*map(F.lit, STEPS)), F.col("end_.named_by"))
    return rows.withColumn("end_", end).select(
        "req_id", name.alias("name"), step_name.alias("named_by"), F.col("end_.verified").alias("verified"), F.col("end_.failed").alias("search_failed"), F.col("end_.links").alias("links")
    )


def _usable(images: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    original, thumbnail = F.coalesce("original", F.lit("")), F.coalesce("thumbnail", F.lit(""))
    key = F.when(original != "", original).otherwise(thumbnail)
    return images.where(~urls.excluded(original, excluded) & ~urls.excluded(thumbnail, excluded)).withColumn("key", key).where(F.col("key") != "")


def image_candidates(images: DataFrame, named: DataFrame, settings: Settings | None = None, most: int = 20) -> DataFrame:
    """Images (req_id, stage, rank, original, thumbnail, title, domain) to look at, with key and pos from 1; `most` a request.

    Stages come in the order of IMAGE_STAGES, each address once, by its first place. A request that is not `named` (req_id,
    named) can't be told apart by a picture, so only the first registry's image counts there; unlisted requests are not named.
    """
    settings = settings or Settings()
    rows = images.where(F.col("rank").between(0, _table(IMAGE_LIMITS, F.col("stage")) - 1)).join(named.select("req_id", "named").hint("merge"), "req_id", "left")
    rows = _usable(rows.where(F.coalesce("named", F.lit(False)) | (F.col("stage") == "registry_a")), settings.excluded_tokens)
    first = F.min(F.struct(_table(IMAGE_STAGES, F.col("stage")).alias("order"), "rank", "stage", "original", "thumbnail", "title", "domain")).alias("x")
    one = rows.groupBy("req_id", "key").agg(first)
    place = F.row_number().over(Window.partitionBy("req_id").orderBy("x.order", "x.rank", "key"))
    return one.withColumn("pos", place).where(F.col("pos") <= most).select("req_id", "pos", "key", "x.stage", "x.rank", "x.original", "x.thumbnail", "x.title", "x.domain")


def last_resort(more: DataFrame, seen: DataFrame, valid: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The images of a last search for requests without a valid one (req_id), each address once and none that was seen (req_id, key)."""
    settings = settings or Settings()
    rows = _usable(more, settings.excluded_tokens).join(valid.select("req_id").distinct().hint("merge"), "req_id", "left_anti").join(seen.select("req_id", "key").distinct().hint("merge"), ["req_id", "key"], "left_anti")
    first = F.min(F.struct("rank", "original", "thumbnail", "title", "domain")).alias("x")
    return rows.groupBy("req_id", "key").agg(first).select("req_id", "key", "x.*")


def promoted(own: DataFrame, shared: DataFrame, most: int = 2) -> DataFrame:
    """Links (req_id, pos, host, url) of the request's own search, then those that the other search verified; one a host, `most` in all."""
    ranked = [d.select("req_id", "host", "url", F.struct(F.lit(i).alias("part"), F.col("pos").alias("pos")).alias("pos")) for i, d in enumerate((own, shared))]
    return links_per_host(ranked[0].unionByName(ranked[1]), most)
