"""Links of a page, the deny list, and the frontier of pages to visit next."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.config import LINK_DENY_LIST
from pagetrove.functions.bind import bind
from pagetrove.functions.text import base_href, decode_entities, drop_scripts, unquoted
from pagetrove.functions.urls import hostname, resolve_link
from pagetrove.session import write_scratch

HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def page_links(pages: DataFrame, same_host: bool = True, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep..., url, href, link``: every link of each page, resolved against the page's base
    element, or else against its address."""
    def resolved(quoted: Column, base: Column) -> Column:
        return bind(decode_entities(unquoted(quoted)), lambda h: F.struct(h.alias("href"), resolve_link(base, h).alias("link")))

    def all_links(html: Column) -> Column:
        base = F.when(html.rlike(r"(?i)<base\s"), resolve_link(F.col("url"), F.nullif(base_href(html), F.lit(""))))
        found = F.regexp_extract_all(html, F.lit(HREF), 1)
        return bind(F.coalesce(base, F.col("url")), lambda b: F.transform(found, lambda quoted: resolved(quoted, b)))

    rows = pages.select(*keep, "url", F.explode(bind(drop_scripts(F.col("html")), all_links)).alias("found"))
    links = rows.select(*keep, "url", "found.href", "found.link").filter(F.col("link").isNotNull())
    return links.filter(hostname(F.col("link")) == hostname(F.col("url"))) if same_host else links


def is_denied(url: Column, case_sensitive: bool = False, deny: tuple[str, ...] = LINK_DENY_LIST) -> Column:
    """True when the address contains an entry of the deny list.

    With ``case_sensitive=False`` the address is lower-cased first; the entries never are.
    Entries that contain another entry cannot change the answer and are not tested.
    """
    needed = [d for d in dict.fromkeys(deny) if not any(o != d and o in d for o in deny)]
    text = url if case_sensitive else F.lower(url)
    return bind(text, lambda u: reduce(or_, [F.contains(u, F.lit(d)) for d in needed]))


def cap_frontier(links: DataFrame, max_pages: int, per: str | None = None) -> DataFrame:
    """The first ``max_pages`` links by depth and address, overall or per value of ``per``;
    -1 keeps all."""
    if max_pages < 0:
        return links
    if per is not None:
        order = Window.partitionBy(per).orderBy("depth", "url")
        return links.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= max_pages).drop("__n")
    return _first_by_range(links, max_pages)


def _first_by_range(links: DataFrame, n: int) -> DataFrame:
    """The first ``n`` links without gathering them in one task: whole ranges of the sort
    order while they fit, and the head of the range the cut falls into."""
    ranged = links.repartitionByRange("depth", "url").withColumn("__part", F.spark_partition_id())
    ranged = write_scratch(ranged, "ranges")
    last, room = None, n
    for part, size in ranged.groupBy("__part").count().orderBy("__part").toLocalIterator():
        last = part
        if size > room:
            break
        room -= size
    else:
        return ranged.drop("__part")
    head = ranged.filter(F.col("__part") == last).orderBy("depth", "url").limit(room)
    return ranged.filter(F.col("__part") < last).unionByName(head).drop("__part")
