"""The whole enrichment as one plan: requests and landed pages to a graded record for each request."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery import config
from gleanery.config import Settings
from gleanery.functions import html, numbers, text, urls
from gleanery.operators import candidates, fuse, ladders, models, page_fields, verify
from gleanery.sources.scratch import written


@dataclass(frozen=True)
class Models:
    """Plug-ins; none by default."""

    fill: models.Model | None = None
    translate: models.Model | None = None


def read_pages(requests: DataFrame, found: DataFrame, pages: DataFrame, settings: Settings) -> DataFrame:
    """Verified pages of each request, parsed: found is (req_id, pos, url), pages (url, html).

    Pages are narrowed to one for a host before any is parsed; the parsed ones are written once, for they are used thrice.
    Parsing costs far more than a page's bytes tell Spark, so pages are dealt out for it. Tables with a row for each
    request are met by merge joins here and below, as in operators.ladders.
    """
    u = F.col("url")
    rows = found.where(urls.http(u) & ~urls.excluded(u, settings.excluded_tokens)).withColumn("host", F.lower(urls.host(u))).withColumn("path", urls.path(u))
    best = candidates.best_per_host(rows, settings.max_candidates).select("req_id", "place", "url", "host")
    names = requests.select("req_id", "ean", F.filter(F.array("name", "ground_truth"), lambda a: F.coalesce(a, F.lit("")) != "").alias("anchors"), text.brand(F.coalesce("ground_truth", "name")).alias("brand_"))
    rows = best.join(pages.select("url", "html").hint("merge"), "url").join(names.hint("merge"), "req_id")
    listed = urls.under(F.col("host"), settings.trusted_hosts)
    rows = rows.withColumn("trusted", verify.trusted(F.col("host"), listed, F.col("brand_"))).withColumn("aggregator", urls.under(F.col("host"), settings.aggregator_hosts))
    rows = page_fields.with_fields(rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, "req_id", "url"))
    route = verify.route(F.col("html"), F.col("ean"), F.col("anchors"), F.col("fields.gtins"), F.col("trusted"), settings.min_name_ratio, settings.require_trust)
    rows = rows.withColumn("route", route).where("route is not null").withColumn("readable", page_fields.has_content(F.col("fields"))).withColumn("text", html.visible(F.col("html")))
    return written(rows.select("req_id", "place", "url", "host", "trusted", "aggregator", "route", "readable", "text", *(F.col(f"fields.{f}").alias(f) for f in config.FIELDS)), "pages")


def enrich(requests: DataFrame, found: DataFrame, pages: DataFrame, settings: Settings | None = None, plugged: Models | None = None) -> DataFrame:
    """A record for each request (req_id, ean, name, ground_truth): 19 fields, status, reliability, provenance, source_links.

    Sources are the pages that gave a field or have content; of their links the first of each host are told, in rank
    order, settings.max_links of them. Requests without a verified page come back with empty fields and the status
    no_source. model_error tells what went wrong where a plugged-in model failed.
    """
    settings, plugged = settings or Settings(), plugged or Models()
    read = read_pages(requests, found, pages, settings)
    rank = fuse.page_rank(F.col("trusted"), F.col("route"), F.col("aggregator"), F.col("place"))
    used = candidates.read_until(read, F.col("readable"), settings.max_read, ["req_id"], ["place"]).withColumn("rank", rank)
    record = fuse.fill(used, F.col("rank"))
    gave = record.select("req_id", F.array_distinct(F.array(*(f"{f}_rank" for f in config.FIELDS))).alias("winners"))
    record = record.drop(*(f"{f}_rank" for f in config.FIELDS))

    sources = used.join(gave.hint("merge"), "req_id").where(F.col("readable") | F.array_contains("winners", F.col("rank")))
    # A request has at most max_candidates pages, one of each host.
    told = F.transform(F.array_sort(F.collect_list(F.struct("rank", "url"))), lambda x: x["url"])
    told = sources.groupBy("req_id").agg(F.slice(told, 1, settings.max_links).alias("source_links"))
    best = F.min(F.when(F.col("readable"), F.struct("rank", "text"))).alias("best")
    seen = used.groupBy("req_id").agg(F.bool_or("readable").alias("readable"), F.bool_or(F.col("trusted") & F.col("readable")).alias("trusted"), best)
    record = record.join(seen.hint("merge"), "req_id").withColumn("text", F.col("best.text")).drop("best")
    record = models.translate(models.fill_missing(record, "text", plugged.fill, error="model_error"), plugged.translate, error="model_error")
    if "model_error" not in record.columns:
        record = record.withColumn("model_error", F.lit(None).cast("string"))
    why = fuse.implausible({k: F.replace(F.col(k), F.lit(","), F.lit(".")).try_cast("double") for k in config.NUTRITION})
    record = record.withColumn("implausible", why)
    record = record.withColumns({k: F.when(F.col("implausible").isNull(), F.col(k)) for k in config.NUTRITION})

    values = fuse.long_form(used.where("readable and not trusted"), ["req_id", "host"])
    winners = fuse.long_form(record, ["req_id"])
    agree = fuse.agreement(F.col("w.field"), F.col("w.value"), F.col("v.value"), numbers.to_double(F.col("w.value")), numbers.to_double(F.col("v.value")), settings.min_agreement)
    hosts = fuse.corroborated(winners, values, agree, ["req_id", "field"], least=settings.min_hosts).groupBy("req_id").agg(F.max("n_hosts").alias("n_hosts"))

    record = record.join(hosts.hint("merge"), "req_id", "left").withColumn("n_hosts", F.coalesce("n_hosts", F.lit(0))).withColumn("verified", F.lit(True))
    out = requests.select("req_id", "ean").join(record.hint("merge"), "req_id", "left").join(told.hint("merge"), "req_id", "left")
    bad = F.col("implausible").isNotNull()
    verified, readable, trusted = (F.coalesce(c, F.lit(False)) for c in ("verified", "readable", "trusted"))
    return out.select(
        "req_id",
        "ean",
        *config.FIELDS,
        fuse.status(readable, verified).alias("status"),
        fuse.reliability(readable, trusted, F.col("n_hosts") >= settings.min_hosts, bad).alias("reliability"),
        fuse.provenance(readable, trusted, F.col("n_hosts"), bad).alias("provenance"),
        "implausible",
        F.coalesce(F.col("source_links"), F.array().cast("array<string>")).alias("source_links"),
        "model_error",
    )


def search_and_enrich(requests: DataFrame, results: DataFrame, pages: DataFrame, settings: Settings | None = None, plugged: Models | None = None) -> DataFrame:
    """enrich() from landed search results: requests (req_id, ean, ground_truth, name, verified), of which the last two are a registry's."""
    # Written once, for names and links are read apart.
    known = written(ladders.discover(requests, results, settings), "discovered")
    named = requests.select("req_id", "ean", "ground_truth").join(known.select("req_id", "name").hint("merge"), "req_id")
    return enrich(named, ladders.found(known), pages, settings, plugged)
