"""Seed addresses of a crawl: a text file, a sitemap, or one address."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrove.functions.text import decode_entities, trim_blank
from pagetrove.plans.frontier import frontier

# An address ends at the next tag, so a line may hold any number of them.
LOC = r"(?is)<loc\s*>([^<]*)</loc\s*>"


def read_seeds(spark: SparkSession, source: str) -> DataFrame:
    """``url`` rows; the ending of ``source`` picks the format. Blank lines and empty sitemap
    entries are skipped; sitemap files are read whole, as an entry may span lines."""
    if source.endswith(".txt"):
        return non_empty(spark.read.text(source).select(F.col("value").alias("url")))
    if source.endswith(".xml"):
        found = F.explode(F.regexp_extract_all("value", F.lit(LOC), 1))
        rows = spark.read.text(source, wholetext=True).select(found.alias("url"))
        return non_empty(rows.withColumn("url", decode_entities(F.col("url"))))
    return non_empty(spark.createDataFrame([(source,)], "url string"))


def read_sitemap(spark: SparkSession, path: str) -> DataFrame:
    """``url`` rows of a sitemap of any size, or of a folder of them, by Spark's XML source: large
    files are split among tasks."""
    rows = spark.read.format("xml").schema("loc string").option("rowTag", "url").load(path)
    return non_empty(rows.select(F.col("loc").alias("url")))


def read_sitemap_index(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """``sitemap, url``: the addresses of all sitemaps that an index names.

    The sitemaps are looked up in ``folder`` by the last part of their address. An index has at most
    50,000 entries by the format's own rule; their names are all that the driver gets.
    """
    named = spark.read.format("xml").schema("loc string").option("rowTag", "sitemap").load(path)
    names = sorted({r.name for r in named.select(F.regexp_extract(trim_blank(F.col("loc")), "([^/]+)/?$", 1).alias("name")).collect()} - {""})
    if not names:
        return spark.createDataFrame([], "sitemap string, url string")
    rows = spark.read.format("xml").schema("loc string").option("rowTag", "url").load([f"{folder}/{n}" for n in names])
    found = rows.select(F.regexp_extract(F.input_file_name(), "([^/]+)(?:/part-[^/]*)?$", 1).alias("sitemap"), F.col("loc").alias("url"))
    return non_empty(found)


def non_empty(seeds: DataFrame) -> DataFrame:
    return seeds.withColumn("url", trim_blank(F.col("url"))).filter(F.col("url") != "")


@dataclass(frozen=True)
class CrawlMode:
    follow_links: bool
    max_pages: int


def crawl_mode(seeds: DataFrame, max_pages: int = 100) -> CrawlMode:
    """One seed: follow its links, up to ``max_pages``. Several: visit just those, uncapped."""
    single = len(seeds.take(2)) == 1
    return CrawlMode(single, max_pages if single else -1)


def next_addresses(seeds: DataFrame, pages: DataFrame, mode: CrawlMode, case_sensitive: bool = False) -> DataFrame:
    """``url, depth`` of one crawl step: the seeds that were not visited yet, at depth 0, and,
    if the mode follows links, the new links of the visited pages, as many as it has room for."""
    fresh = seeds.select("url").distinct().join(pages.select("url"), "url", "left_anti").withColumn("depth", F.lit(0))
    if not mode.follow_links:
        return fresh
    room = mode.max_pages if mode.max_pages < 0 else max(mode.max_pages - pages.count(), 0)
    return fresh.unionByName(frontier(pages, seeds, room, case_sensitive=case_sensitive))
