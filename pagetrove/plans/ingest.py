"""Ingest: pages to webpage, chunk and vector rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from pagetrove.config import IngestConfig
from pagetrove.functions.text import (
    article_html, article_sitename, article_summary, article_text, dense_text, drop_scripts, page_title,
)
from pagetrove.functions.urls import hostname
from pagetrove.operators.chunking import chunk_text, content_hash, number_chunks
from pagetrove.operators.dedup import drop_known, first_wins_pairs
from pagetrove.operators.embed import Embedder, hashed_embedder
from pagetrove.operators.store import Store
from pagetrove.session import Scratch, write_scratch


def extract_articles(pages: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """``page_id, url, host, title, summary, sitename, text`` of each page; no shuffle."""
    clean = pages.select("page_id", "url", drop_scripts(F.col("html")).alias("clean"))
    body = clean.select("*", article_html(F.col("clean")).alias("article"))
    return body.select(
        "page_id", "url", hostname(F.col("url")).alias("host"),
        page_title(F.col("clean")).alias("title"),
        article_summary(F.col("clean"), F.col("article")).alias("summary"),
        article_sitename(F.col("clean")).alias("sitename"),
        (dense_text(F.col("clean")) if config.article == "dense" else article_text(F.col("article"), config.block_breaks)).alias("text"),
    )


REASONS = ("no address", "no html", "no text")


def _reason() -> Column:
    """Why ingest leaves a page out, null if it doesn't: an address that is null or can't be parsed, no html, no text."""
    return F.when(F.col("url").isNull() | F.col("host").isNull(), "no address").when(
        F.col("chunks").isNull(), "no html").when(F.size("chunks") == 0, "no text")


def _chunked(pages: DataFrame, config: IngestConfig) -> DataFrame:
    articles = extract_articles(pages, config)
    return articles.withColumn("chunks", chunk_text(F.col("text"), config)).drop("text")


def reject_reason(pages: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """``page_id, reason``: why ingest leaves a page out, one of REASONS, null if it doesn't.

    A page without an address is not parsed, as its html has no say.
    """
    addressed = pages.withColumn("html", F.when(F.col("url").isNotNull() & hostname(F.col("url")).isNotNull(), F.col("html")))
    return _chunked(addressed, config).select("page_id", _reason().alias("reason"))


def reject_counts(pages: DataFrame, config: IngestConfig = IngestConfig()) -> DataFrame:
    """``reason, n``: how many pages ingest would leave out, by reason; ``ingest`` returns the same of what it did.

    Counted without a filter by reason or a grouping, whose filter would be worked out a second time,
    and before the rows are shared out.
    """
    counts = reject_reason(pages, config).agg(*[F.count_if(F.col("reason") == r).alias(r) for r in REASONS])
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n")) for r in REASONS]))
    return counts.select(each.alias("e")).select("e.reason", "e.n").filter("n > 0")


def parse_pages(pages: DataFrame, config: IngestConfig = IngestConfig(), rejects: Observation | None = None) -> DataFrame:
    """Pages with their chunk list, content hash and a row number that tells apart copies of
    one page in a batch; no shuffle. ``rejects`` counts the pages by reject reason on the way."""
    return parsed_rows(pages, config, rejects).withColumn("row_id", F.monotonically_increasing_id())


def parsed_rows(pages: DataFrame, config: IngestConfig = IngestConfig(), rejects: Observation | None = None) -> DataFrame:
    rows = _chunked(pages, config)
    if rejects is not None:
        rows = rows.observe(rejects, *[F.count_if(_reason() == r).alias(r) for r in REASONS])
    sitename = F.col("sitename") if config.sitename == "article" else F.col("host")
    parsed = rows.filter(F.col("url").isNotNull() & F.col("host").isNotNull()).select(
        "page_id", "url", "title", "summary", sitename.alias("sitename"), "chunks")
    return parsed.withColumn("hash", content_hash(F.col("chunks")))


def new_pages(parsed: DataFrame, stored: DataFrame | None = None, save=write_scratch) -> DataFrame:
    """The parsed pages to store: with chunks, not stored by url or content, first wins
    within the batch.

    Works on narrow key rows; the wide rows are only filtered by the result. ``parsed`` must
    be a written table, so that its row numbers stand and no page is extracted twice.
    """
    parsed = parsed.filter(F.size("chunks") > 0)
    keys = parsed.select("page_id", "row_id", "url", "hash")
    if stored is not None:
        keys = drop_known(drop_known(keys, stored, "url", save), stored, "hash", save)
    kept = first_wins_pairs(keys, ("page_id", "row_id"), save=save).select("row_id")
    return parsed.join(kept, "row_id", "left_semi")


def webpage_rows(pages: DataFrame) -> DataFrame:
    return pages.select("hash", "title", "url", "summary", "sitename")


def vector_rows(chunks: DataFrame, embed: Embedder) -> DataFrame:
    return chunks.select(F.col("pid").alias("id"), embed(F.col("chunk")).alias("values"))


def ingest(
    store: Store, pages: DataFrame, batch_id: int,
    config: IngestConfig = IngestConfig(), embed: Embedder | None = None, writer: str = "batch",
) -> dict[str, int]:
    """Add a batch of ``pages(page_id, url, html)`` to the store, under the name of a writer.

    Pages that ``reject_reason`` has a reason for are left out. Returns how many, by reason,
    observed while the pages are parsed.

    The same batch may run again after a failure: what it wrote before does not count as
    stored, and is replaced. Webpages go last, so readers never see a page without chunks.
    """
    stored = store.read_others("webpages", batch_id, writer).select("url", "hash")
    rejects = Observation("rejects")
    with Scratch(pages.sparkSession) as scratch:
        parsed = scratch.write(parse_pages(pages, config, rejects), "parsed")
        store_pages(store, scratch.write(new_pages(parsed, stored, scratch.write), "fresh"), batch_id, config, embed, writer)
    counted = rejects.get
    return {r: counted.get(r, 0) for r in REASONS}


def store_pages(
    store: Store, fresh: DataFrame, batch_id: int, config: IngestConfig, embed: Embedder | None, writer: str,
) -> None:
    """Append the rows of new pages, a written table, to the store; webpages last."""
    chunks = number_chunks(fresh)
    store.append("chunks", chunks, batch_id, writer)
    store.append("vectors", vector_rows(chunks, embed or hashed_embedder(config.dims)), batch_id, writer)
    store.append("webpages", webpage_rows(fresh), batch_id, writer)
