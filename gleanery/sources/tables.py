"""Landed tables: request lines, registries, search results, pages, taxonomy. Fetching stays outside the query plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import barcode

SEARCH = (
    "struct<_error:int,organic_results:array<struct<link:string,title:string,snippet:string>>,"
    "shopping_results:array<struct<thumbnail:string,link:string,title:string,source:string>>,"
    "images_results:array<struct<original:string,thumbnail:string,title:string,source:string>>>"
)
REGISTRY = (
    "struct<code:string,product:struct<name:string,brand:string,description:string,imageUrl:string,ingredients:struct<text:string>,"
    "category:string,categoryPath:array<string>,specs:array<array<string>>>>"
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dealt(rows: DataFrame, key: str, each: int) -> DataFrame:
    """Rows of which each becomes much work, by their key in tasks of about `each` rows, one for each core at least.

    A small file is read by one task, and a fixed number of tasks grow with the table. Counting a parquet table reads its footers.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // each)), key)


def requests(lines: DataFrame, line: str = "raw") -> DataFrame:
    """Request lines with their code, text and refresh flag; lines without a valid code have a null `ean`."""
    parts = barcode.parse_line(F.col(line))
    out = lines.withColumns(parts)
    return out.withColumn("ean", F.when(barcode.valid(F.col("ean")), F.col("ean")))


def taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """A ;-separated file with one path a line, cells trimmed, absent levels null."""
    raw = spark.read.csv(path, sep=";", header=True, lineSep=None)
    return raw.select(*(F.nullif(F.trim(F.col(c)), F.lit("")).alias(c.strip()) for c in raw.columns))


def search_results(raw: DataFrame, kind: str = "organic_results", body: str = "body") -> DataFrame:
    """The ranked entries of landed search answers; an answer with an error code has none."""
    parsed = raw.withColumn("answer_", F.from_json(body, SEARCH)).where("answer_._error is null")
    return parsed.select(*(c for c in raw.columns if c != body), F.posexplode(F.col(f"answer_.{kind}")).alias("rank", "entry")).select("*", "entry.*").drop("entry")


def search_errors(raw: DataFrame, body: str = "body") -> DataFrame:
    """Landed answers that were errors, with their code; an answer that can't be read has code 0."""
    code = F.coalesce(F.from_json(body, SEARCH)["_error"], F.when(F.from_json(body, SEARCH).isNull(), 0))
    return raw.withColumn("error", code).where("error is not null").drop(body)


def registry(raw: DataFrame, body: str = "body") -> DataFrame:
    """Landed registry answers as rows; answers without a product are left out."""
    p = F.col("answer_.product")
    specs = F.map_from_entries(F.transform(F.filter(p["specs"], lambda s: F.size(s) == 2), lambda s: F.struct(s[0], s[1])))
    return (
        raw.withColumn("answer_", F.from_json(body, REGISTRY))
        .where("answer_.product is not null")
        .select(F.col("answer_.code").alias("ean"), p["name"].alias("name"), p["brand"].alias("brand"), p["description"].alias("description"), p["imageUrl"].alias("image_url"), p["ingredients"]["text"].alias("ingredients"), p["category"].alias("category"), p["categoryPath"].alias("category_path"), specs.alias("specs"))
    )


def registry_list(raw: DataFrame, body: str = "body") -> DataFrame:
    """The second registry's answers, lists of entries; entries with an error are left out."""
    kind = "array<struct<barcode:string,ean:string,name:string,image:string,error:string>>"
    rows = raw.select(F.explode(F.from_json(body, kind)).alias("e")).select("e.*").where("error is null")
    return rows.select(F.coalesce("barcode", "ean").alias("ean"), "name", F.col("image").alias("image_url"))


def pages_from_files(spark: SparkSession, path: str, most: int = 4_000_000) -> DataFrame:
    """Landed page files as (url, html): the first `most` bytes, undecodable ones dropped."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.try_to_binary(F.hex(F.substring("content", 1, most)), F.lit("hex")).cast("string").alias("html"))


def image_bytes(spark: SparkSession, path: str, least: int = 8_000) -> DataFrame:
    """Landed image files of at least `least` bytes."""
    return spark.read.format("binaryFile").load(path).where(F.col("length") >= least)
