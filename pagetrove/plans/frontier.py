"""Frontier: the links to visit next."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.functions.urls import normalize_url
from pagetrove.operators.links import cap_frontier, is_denied, page_links
from pagetrove.session import write_scratch


def new_links(
    pages: DataFrame, known: DataFrame, depth: str | None = None, case_sensitive: bool = False, same_host: bool = True,
) -> DataFrame:
    """``url, depth``: each allowed link of the pages once, unless it is known or in the batch.

    Links are grouped by target before they meet the known addresses, so a link that every
    page carries is one row per task by then.
    """
    level = F.col(depth) if depth else F.lit(0)
    links = page_links(pages.withColumn("__depth", level), same_host, keep=("__depth",))
    allowed = links.filter(~is_denied(F.col("link"), case_sensitive))
    targets = allowed.groupBy(F.col("link").alias("url")).agg((F.min("__depth") + 1).alias("depth"))
    targets = write_scratch(targets, "targets")
    visited = known.select("url").unionByName(pages.select("url")).select(normalize_url(F.col("url")).alias("url"))
    # The known addresses meet the few targets first, by broadcast while their file is small.
    hits = visited.join(targets.select("url"), "url", "left_semi").distinct()
    return targets.join(hits, "url", "left_anti")


def frontier(
    pages: DataFrame, known: DataFrame, max_pages: int = 100, depth: str | None = None, case_sensitive: bool = False,
) -> DataFrame:
    return cap_frontier(new_links(pages, known, depth, case_sensitive), max_pages)


def link_table(pages: DataFrame, case_sensitive: bool = False, same_host: bool = True) -> DataFrame:
    """``source, link``: the allowed links between addresses, each once, sources as links name them."""
    links = page_links(pages, same_host).filter(~is_denied(F.col("link"), case_sensitive))
    return links.select(normalize_url(F.col("url")).alias("source"), "link").distinct()


def reach(links: DataFrame, seeds: DataFrame, max_pages: int = -1, max_depth: int = -1) -> DataFrame:
    """``url, depth``: what a crawl from the seeds gets to, each address at its least depth.

    A round follows the links of the level before; the link table, which should be a stored one, is
    met by that level's addresses alone, and the addresses reached before by the new ones alone.
    Rounds end with the links, at ``max_depth``, or where ``max_pages`` addresses are reached, of
    which the first by depth and address are kept; -1 means no limit. An address that has no page is
    reached but leads nowhere.
    """
    start = seeds.select(normalize_url(F.col("url")).alias("url")).filter(F.col("url").isNotNull()).distinct()
    levels = [write_scratch(start.withColumn("depth", F.lit(0)), "level")]
    n_reached = n_new = levels[0].count()
    while n_new and len(levels) - 1 != max_depth and (max_pages < 0 or n_reached < max_pages):
        here = levels[-1].select(F.col("url").alias("source"))
        found = write_scratch(links.join(here, "source", "left_semi").select(F.col("link").alias("url")).distinct(), "found")
        before = reduce(DataFrame.unionByName, levels).select("url").join(found, "url", "left_semi")
        level = write_scratch(found.join(before, "url", "left_anti").withColumn("depth", F.lit(len(levels))), "level")
        n_new = level.count()
        n_reached += n_new
        levels.append(level)
    return cap_frontier(reduce(DataFrame.unionByName, levels), max_pages)


def crawl_counts(pages: DataFrame, case_sensitive: bool = False, same_host: bool = True) -> DataFrame:
    """``visited, enqueued``: pages read, and links queued (counted before the deny list on
    the case-sensitive path, after it on the other)."""
    links = page_links(pages, same_host)
    if not case_sensitive:
        links = links.filter(~is_denied(F.col("link")))
    zero = F.lit(0).cast("long")
    parts = pages.agg(F.count("*").alias("visited")).withColumn("enqueued", zero).unionByName(
        links.agg(F.count("*").alias("enqueued")).withColumn("visited", zero)
    )
    return parts.agg(F.sum("visited").alias("visited"), F.sum("enqueued").alias("enqueued"))
