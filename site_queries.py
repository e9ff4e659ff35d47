"""The registered queries: each operator and job of the package over the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetrove.config import IngestConfig, SearchConfig
from pagetrove.functions.urls import breadcrumb, has_query_or_fragment, hostname, normalize_url, site_key, url_path
from pagetrove.operators.chunking import content_hash, merge_single_sentences, number_chunks, pack_chunks, paragraphs
from pagetrove.operators.dedup import exists_in, first_per_key, first_wins_pairs
from pagetrove.operators.embed import hashed_embedder, model_embedder, word_model
from pagetrove.operators.links import is_denied, page_links
from pagetrove.operators.rank import dedup_results, group_first_site, score_results
from pagetrove.operators.store import Store, table_stats
from pagetrove.operators.vector_lists import VectorLists
from pagetrove.operators.vector_table import VectorTable
from pagetrove.operators.vectors import LshIndex, vector_topk
from pagetrove.plans.frontier import crawl_counts, frontier, link_table, reach
from pagetrove.plans.ingest import (
    extract_articles, ingest, new_pages, parse_pages, reject_counts, vector_rows, webpage_rows,
)
from pagetrove.plans.reset import left_over, reset
from pagetrove.plans.search import search
from pagetrove.plans.serve import filter_domain, number_pages, serve_page, with_site_links
from pagetrove.session import scratch_path, write_scratch
from pagetrove.sources.pages import read_pages, spread, stream_pages
from pagetrove.sources.seeds import crawl_mode, next_addresses, read_seeds, read_sitemap_index
from pagetrove.streaming import known_pages, stream_frontier, stream_ingest, stream_ingest_marked

CONFIG = IngestConfig()
SEARCH = SearchConfig()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_pages(spark, f"{sf_dir}/pages.parquet")


def documents_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


# -- text ----------------------------------------------------------------------------------

def page_titles_hosts(spark: SparkSession, sf: str) -> DataFrame:
    return extract_articles(pages_of(spark, sf)).select(
        "page_id", "title", "host", has_query_or_fragment(F.col("url")).alias("has_tail")
    )


def article_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = extract_articles(pages_of(spark, sf)).select("page_id", "summary", "sitename", "text")
    return rows.fillna("", ["summary", "sitename"])


def dense_text(spark: SparkSession, sf: str) -> DataFrame:
    """The article as the densest run of blocks, also of pages whose article and main elements are gone."""
    pages = pages_of(spark, sf)
    bare = pages.withColumn("html", F.regexp_replace("html", "(?i)</?(article|main)[^>]*>", "")).withColumn("kind", F.lit("bare"))
    both = pages.withColumn("kind", F.lit("whole")).unionByName(bare)
    rows = extract_articles(both.withColumn("page_id", F.col("page_id") * 2 + (F.col("kind") == "bare").cast("int")), IngestConfig(article="dense"))
    return rows.select("page_id", "text")


def _document_paragraphs(spark: SparkSession, sf: str):
    """Documents mark paragraphs with single line breaks."""
    return documents_of(spark, sf).select("doc_id", "source", "lang", paragraphs(F.col("text"), "\n").alias("paras"))


def _rows(df: DataFrame, key: str, items, name: str) -> DataFrame:
    return df.select(key, F.posexplode(items).alias("pos", name)).withColumn("pos", F.col("pos") + 1)


def clean_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_document_paragraphs(spark, sf), "doc_id", F.col("paras"), "paragraph")


def merge_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_document_paragraphs(spark, sf), "doc_id", merge_single_sentences(F.col("paras")), "paragraph")


def _document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = _document_paragraphs(spark, sf)
    return docs.select("doc_id", "source", "lang", pack_chunks(merge_single_sentences(F.col("paras"))).alias("chunks"))


def pack(spark: SparkSession, sf: str) -> DataFrame:
    return _rows(_document_chunks(spark, sf), "doc_id", F.col("chunks"), "chunk")


def chunk_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = _document_chunks(spark, sf).filter(F.size("chunks") > 0).select(
        F.concat_ws("/", "source", "doc_id").alias("url"), F.col("lang").alias("title"), "chunks",
        content_hash(F.col("chunks")).alias("hash"),
    )
    return number_chunks(docs, keep=("hash",))


def model_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """The same vectors from a model that is made once a worker."""
    docs = documents_of(spark, sf).select("doc_id", model_embedder(word_model(CONFIG.dims))(F.col("text")).alias("v"))
    cells = docs.select("doc_id", F.posexplode("v").alias("dim", "w")).filter("w <> 0")
    return cells.select("doc_id", "dim", F.round(F.col("w").cast("double"), 6).alias("weight"))


def hashed_embedding(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents_of(spark, sf).select("doc_id", hashed_embedder(CONFIG.dims)(F.col("text")).alias("v"))
    cells = docs.select("doc_id", F.posexplode("v").alias("dim", "w")).filter("w <> 0")
    return cells.select("doc_id", "dim", F.round(F.col("w").cast("double"), 6).alias("weight"))


# -- dedup ---------------------------------------------------------------------------------

def dedup_url(spark: SparkSession, sf: str) -> DataFrame:
    """Addresses are unique in the table, so they are compared by site and path."""
    url = F.col("url")
    keys = pages_of(spark, sf).select("page_id", F.concat(site_key(hostname(url)), url_path(url)).alias("address"))
    return first_per_key(keys, "address", "page_id")


def dedup_hash(spark: SparkSession, sf: str) -> DataFrame:
    return first_per_key(table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("hash")), "hash", "doc_id")


def dedup_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """Source and first word play the url, so that urls and contents collide independently."""
    keys = table(spark, sf, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat_ws("/", "source", F.element_at(F.split("text", " "), 1)).alias("url"),
        F.sha2("text", 256).alias("hash"),
    )
    return first_wins_pairs(keys)


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return write_scratch(parse_pages(pages_of(spark, sf), CONFIG), "parsed")


def _fresh(spark: SparkSession, sf: str) -> DataFrame:
    return write_scratch(new_pages(_parsed(spark, sf)), "fresh")


def new_pages_only(spark: SparkSession, sf: str) -> DataFrame:
    """Re-crawl of all pages when those under http:// are stored already."""
    parsed = _parsed(spark, sf)
    known = new_pages(parsed).filter(F.col("url").startswith("http://")).select("url", "hash")
    return new_pages(parsed, known).select("page_id", "url", "hash")


def url_exists(spark: SparkSession, sf: str) -> DataFrame:
    return exists_in(pages_of(spark, sf).select("page_id", "url"), _fresh(spark, sf), "url")


def stored_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).all_urls()


# -- links and addresses -------------------------------------------------------------------

def links(spark: SparkSession, sf: str) -> DataFrame:
    return page_links(pages_of(spark, sf)).select("page_id", "href", "link")


def link_deny(spark: SparkSession, sf: str) -> DataFrame:
    link = F.col("link")
    return page_links(pages_of(spark, sf)).select(
        "page_id", "link", is_denied(link).alias("denied"), is_denied(link, case_sensitive=True).alias("denied_case_sensitive")
    )


def _frontier(max_pages: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pages = pages_of(spark, sf)
        return frontier(pages, pages.select("url"), max_pages)
    return run


def seed_urls(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses written as a text list with blank lines and as a sitemap with all entries of a
    file on one line, and read back; the first as a single seed, beside a blank one."""
    pages = pages_of(spark, sf)
    urls = pages.select("url")
    text, sitemap = scratch_path(spark, "seeds") + ".txt", scratch_path(spark, "sitemap") + ".xml"
    urls.select(F.explode(F.array(F.concat(F.lit(" "), "url"), F.lit(""), F.lit("\t "))).alias("value")).write.text(text)
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    urls.select(F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc></url>")).alias("value")).write.option("lineSep", " ").text(sitemap)
    both = [read_seeds(spark, p).withColumn("source", F.lit(s)) for p, s in ((text, "text"), (sitemap, "sitemap"))]
    first = [r.url for r in pages.orderBy("page_id").limit(1).collect()]
    both += [read_seeds(spark, s).withColumn("source", F.lit("single")) for s in (*first, "  ")]
    return functools.reduce(DataFrame.unionByName, both).select("source", "url")


def sitemap_index(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses in sitemaps of up to 1,000 entries, named by an index, and read back by the XML source."""
    folder = scratch_path(spark, "sitemaps")
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    entry = F.concat(F.lit("<url><loc>"), escaped, F.lit("</loc><priority>0.5</priority></url>"))
    maps = pages_of(spark, sf).groupBy(F.floor(F.col("page_id") / 1000).alias("map")).agg(F.array_join(F.collect_list(entry), "\n").alias("entries"))
    maps = write_scratch(maps, "maps")
    maps.select("map", F.concat(F.lit("<?xml version='1.0'?><urlset>"), "entries", F.lit("</urlset>")).alias("value")).write.partitionBy("map").text(folder)
    names = maps.select(F.concat(F.lit("<sitemap><loc>https://example.com/map="), "map", F.lit("</loc></sitemap>")).alias("name"))
    index = names.agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list("name"), ""), F.lit("</sitemapindex>")))
    index.write.text(f"{folder}-index.xml")
    return read_sitemap_index(spark, f"{folder}-index.xml", folder)


def crawl_step(spark: SparkSession, sf: str) -> DataFrame:
    """Pages under http:// were visited; the others are seeds, which are visited alone, and the
    first page is a single seed whose links are followed."""
    pages = pages_of(spark, sf)
    seen = pages.filter(F.col("url").startswith("http://"))
    many = pages.select("url")
    one = pages.orderBy("page_id").limit(1).select("url")
    steps = [next_addresses(seeds, seen, crawl_mode(seeds, -1)).withColumn("seeds", F.lit(name)) for seeds, name in ((many, "many"), (one, "one"))]
    return steps[0].unionByName(steps[1]).select("seeds", "url", F.col("depth").cast("int").alias("depth"))


def _tree_of_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The pages, each leading to two others of its host too, and the first page of every host."""
    by_host = Window.partitionBy(hostname(F.col("url"))).orderBy("page_id")
    seats = write_scratch(pages_of(spark, sf).withColumn("n", F.row_number().over(by_host)).withColumn("host", hostname(F.col("url"))), "seats")
    anchor = F.concat(F.lit('<a href="'), F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit('">more</a>'))
    more = seats.filter("n > 1").groupBy("host", F.floor(F.col("n") / 2).cast("int").alias("n")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("n", anchor.alias("a")))).getField("a"), "").alias("more"))
    linked = seats.join(more, ["host", "n"], "left").withColumn("html", F.concat("html", F.coalesce("more", F.lit(""))))
    return linked.select("page_id", "url", "html"), seats.filter("n = 1").select("url")


def _reach(max_pages: int):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        pages, seeds = _tree_of_pages(spark, sf)
        return reach(write_scratch(link_table(pages), "links"), seeds, max_pages, max_depth=4)
    return run


def _broken_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Every page, and copies of it that lack an address, the html, or any text."""
    pages = pages_of(spark, sf)
    none = F.lit(None).cast("string")
    broken = [pages.withColumn("url", none), pages.withColumn("url", F.lit("nowhere")).filter("page_id % 2 = 0"),
              pages.withColumn("html", none), pages.withColumn("html", F.lit("<title>t</title><p> </p>")).filter("page_id % 3 = 0")]
    for more in broken:
        pages = pages.unionByName(more)
    return pages


def ingest_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return reject_counts(_broken_pages(spark, sf), CONFIG)


def ingest_observed(spark: SparkSession, sf: str) -> DataFrame:
    """What an ingest of the same pages counts on its way."""
    store = Store(spark, scratch_path(spark, "store")).create()
    counted = ingest(store, _broken_pages(spark, sf), batch_id=0, config=CONFIG)
    return spark.createDataFrame(list(counted.items()), "reason string, n long")


def counts(spark: SparkSession, sf: str) -> DataFrame:
    return crawl_counts(pages_of(spark, sf))


def site_keys(spark: SparkSession, sf: str) -> DataFrame:
    host = hostname(F.col("url"))
    return pages_of(spark, sf).select("page_id", host.alias("host"), site_key(host).alias("site"))


def breadcrumbs(spark: SparkSession, sf: str) -> DataFrame:
    return pages_of(spark, sf).select("page_id", breadcrumb(F.col("url")).alias("path"))


# -- vectors -------------------------------------------------------------------------------

def _vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Every stored vector is a query too."""
    rows = table(spark, sf, "embeddings")
    return (
        rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values")),
        rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")),
    )


def _topk(metric: str):
    return lambda spark, sf: vector_topk(*_vectors(spark, sf), k=10, metric=metric)


def vector_topk_lsh(spark: SparkSession, sf: str) -> DataFrame:
    """By sign planes, where a setting with enough recall saves work; else the exact search."""
    vectors, queries = _vectors(spark, sf)
    index = LshIndex.tuned(vectors, queries, k=10)
    return index.topk(index.index(vectors), queries, k=10) if index else vector_topk(vectors, queries, k=10)


def vector_topk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The exact search that skips lists by their bounds."""
    vectors, queries = _vectors(spark, sf)
    return VectorLists.build(vectors).topk_exact(queries, k=10)


def vector_topk_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """Inverted lists and codes, where that saves work at the recall asked for; else the exact search."""
    vectors, queries = _vectors(spark, sf)
    return VectorLists.build(vectors).topk(queries, k=10)


def vector_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What inverted lists and codes find of the true ten of every document's vector, among the
    vectors of all documents, whether they save work or not."""
    vectors = write_scratch(documents_of(spark, sf).select(
        F.col("doc_id").alias("id"), hashed_embedder(64)(F.col("text")).alias("values")), "document-vectors")
    queries = vectors.select(F.col("id").alias("qid"), F.col("values").alias("qvec"))
    index = VectorLists.build(vectors)
    settings = index.tune(queries, k=10, max_share=1.0)
    found = index.topk(queries, k=10, settings=settings).select("qid", "id", F.lit(True).alias("found"))
    true = vector_topk(vectors, queries, k=10)
    return true.join(found, ["qid", "id"], "left").groupBy().agg(
        F.count_distinct("qid").alias("n_queries"), F.count("*").alias("n_true"),
        (F.count("found") >= 0.9 * F.count("*")).alias("recall_reached"))


PLANES = LshIndex(dims=64, tables=8, planes=4)


def vector_topk_planes(spark: SparkSession, sf: str) -> DataFrame:
    """The index with a fixed number of planes, whatever the table's size, so that SQL can follow it."""
    vectors, queries = _vectors(spark, sf)
    return PLANES.topk(PLANES.index(vectors), queries, k=10)


def _vector_store(spark: SparkSession, sf: str) -> tuple[Store, DataFrame]:
    store = Store(spark, scratch_path(spark, "store")).create()
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), "label")
    store.append("vectors", rows, 0)
    return store, rows


def upsert_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of the labels below 5 arrive again, doubled."""
    store, rows = _vector_store(spark, sf)
    doubled = rows.filter("label < 5").select("id", F.transform("values", lambda x: x * F.lit(2).cast("float")).alias("values"))
    store.upsert_vectors(doubled, batch_id=1)
    cells = store.read("vectors").select("id", F.posexplode("values").alias("dim", "x"))
    return cells.select("id", F.col("dim") + 1, F.round(F.col("x").cast("double"), 6).alias("value")).toDF("id", "dim", "value")


def delete_vectors(spark: SparkSession, sf: str) -> DataFrame:
    store, rows = _vector_store(spark, sf)
    store.delete_vectors(rows.filter("label < 5"))
    return store.read("vectors").select("id")


def _vector_table(spark: SparkSession, sf: str) -> tuple[VectorTable, DataFrame]:
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("values"), "label")
    vectors = VectorTable(spark, scratch_path(spark, "vector-table"), slots=32).create()
    vectors.upsert(rows)
    return vectors, rows


def upsert_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """The same into a table that rewrites only the partitions it must."""
    vectors, rows = _vector_table(spark, sf)
    vectors.upsert(rows.filter("label < 5").select("id", F.transform("values", lambda x: x * F.lit(2).cast("float")).alias("values")))
    cells = vectors.read().select("id", F.posexplode("values").alias("dim", "x"))
    return cells.select("id", F.col("dim") + 1, F.round(F.col("x").cast("double"), 6).alias("value")).toDF("id", "dim", "value")


def delete_partitions(spark: SparkSession, sf: str) -> DataFrame:
    vectors, rows = _vector_table(spark, sf)
    vectors.delete(rows.filter("label < 5"))
    return vectors.read().select("id")


# -- store ---------------------------------------------------------------------------------

def _ingested(spark: SparkSession, sf: str) -> Store:
    store = Store(spark, scratch_path(spark, "store")).create()
    ingest(store, pages_of(spark, sf), batch_id=0, config=CONFIG)
    return store


def ingest_webpages(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).read("webpages")


def ingest_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return _ingested(spark, sf).read("chunks")


def store_stats(spark: SparkSession, sf: str) -> DataFrame:
    store = _ingested(spark, sf)
    return table_stats({name: store.read(name) for name in ("webpages", "chunks", "vectors")}).fillna(0, ["dims"])


def reset_check(spark: SparkSession, sf: str) -> DataFrame:
    store = _ingested(spark, sf)
    before = left_over(store.stats()).first()["n_left"]
    return reset(store).select(F.lit(before).cast("long").alias("n_before"), "n_left", "is_empty")


def orphan_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """The chunks of all pages are stored, but only the webpages under https://."""
    full = _ingested(spark, sf)
    store = Store(spark, scratch_path(spark, "store")).create()
    store.append("chunks", full.read("chunks"), 0)
    store.append("webpages", full.read("webpages").filter(F.col("url").startswith("https://")), 0)
    return store.orphans().select("id", "url")


def _page_files(spark: SparkSession, sf: str) -> str:
    """The pages dealt into four files, for streams of several micro-batches."""
    path = scratch_path(spark, "page-files")
    pages_of(spark, sf).repartition(4, "page_id").write.parquet(path)
    return path


def streamed_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A store that a batch job filled with the pages under http:// takes all pages as a stream of
    four micro-batches, and all of them again from a second checkpoint."""
    store = Store(spark, scratch_path(spark, "store")).create()
    ingest(store, pages_of(spark, sf).filter(F.col("url").startswith("http://")), batch_id=0, config=CONFIG)
    files = _page_files(spark, sf)
    for per_batch in (1, 4):
        stream_ingest(store, stream_pages(spark, files, max_files=per_batch), scratch_path(spark, "stream")).awaitTermination()
    return store.read("webpages").select("hash")


def streamed_ingest_marked(spark: SparkSession, sf: str) -> DataFrame:
    """The same by keyed state: two files from a first start, the others from a restart, and all
    pages again from a second checkpoint."""
    store = Store(spark, scratch_path(spark, "store")).create()
    ingest(store, pages_of(spark, sf).filter(F.col("url").startswith("http://")), batch_id=0, config=CONFIG)
    first, later = scratch_path(spark, "arriving"), pages_of(spark, sf).repartition(4, "page_id")
    before = spark.conf.get(known_pages.STATE_STORE)
    spark.conf.set(known_pages.STATE_STORE, known_pages.ROCKSDB)
    try:
        checkpoints = [scratch_path(spark, "stream") for _ in range(2)]
        for half, checkpoint in ((0, checkpoints[0]), (1, checkpoints[0]), (None, checkpoints[1])):
            if half is not None:
                later.filter(F.col("page_id") % 2 == half).write.mode("append").parquet(first)
            query = stream_ingest_marked(store, stream_pages(spark, first, max_files=4), checkpoint)
            query.processAllAvailable()
            query.stop()
    finally:
        spark.conf.set(known_pages.STATE_STORE, before)
    return store.read("webpages").select("hash")


def streamed_frontier(spark: SparkSession, sf: str) -> DataFrame:
    store = Store(spark, scratch_path(spark, "store")).create()
    ingest(store, pages_of(spark, sf), batch_id=0, config=CONFIG)
    pages = stream_pages(spark, _page_files(spark, sf), max_files=1)
    stream_frontier(store, pages, scratch_path(spark, "stream")).awaitTermination()
    # A link counts as new when it is found; pages that the store skipped as copies came later.
    visited = pages_of(spark, sf).select(normalize_url(F.col("url")).alias("url"))
    return store.read("links").select("url").join(visited, "url", "left_anti")


# -- search --------------------------------------------------------------------------------

def _results(spark: SparkSession, sf: str) -> DataFrame:
    """Every page title is a query against all chunks."""
    pages = pages_of(spark, sf)
    embed = hashed_embedder(CONFIG.dims)
    fresh = _fresh(spark, sf)
    chunks = number_chunks(fresh)
    queries = extract_articles(pages).select(F.col("page_id").alias("qid"), F.col("title").alias("q"))
    return search(write_scratch(queries, "queries"), webpage_rows(fresh), chunks, vector_rows(chunks, embed), embed, SEARCH)


RANKED = ("qid", "pid", "url", "title", "score", "summary", "domain", "path", "url_ratio", "title_ratio", "base_rank", "rank")


def _ranked(spark: SparkSession, sf: str, matcher: str = "contains", snippets: str = "as_written") -> DataFrame:
    return score_results(dedup_results(_results(spark, sf)), matcher=matcher, snippets=snippets)


def _rank_query(matcher: str, snippets: str = "as_written"):
    return lambda spark, sf: _ranked(spark, sf, matcher, snippets).select(*RANKED)


def _grouped(spark: SparkSession, sf: str) -> DataFrame:
    return group_first_site(_ranked(spark, sf))


def result_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return dedup_results(_results(spark, sf)).select("qid", "pid", "url", "score", "base_rank")


def first_site_group(spark: SparkSession, sf: str) -> DataFrame:
    members = F.when(F.col("first_result"), F.col("search_results")).otherwise(
        F.array(F.struct("rank", "url", "title", "chunk", "score", "summary", "domain", "path"))
    )
    flat = _grouped(spark, sf).select("qid", "position", "first_result", F.explode(members).alias("r"))
    return flat.select("qid", "position", "first_result", "r.rank", "r.url", "r.score")


def site_links(spark: SparkSession, sf: str) -> DataFrame:
    heads = with_site_links(_grouped(spark, sf)).filter("first_result")
    return heads.select("qid", F.posexplode("search_results").alias("slot", "r")).select(
        "qid", (F.col("slot") + 1).alias("slot"), "r.url", "r.title"
    )


def result_pages(spark: SparkSession, sf: str) -> DataFrame:
    return number_pages(_grouped(spark, sf), SEARCH.per_page).select("qid", "position", "url", "page", "total", "total_pages")


def domain_results(spark: SparkSession, sf: str) -> DataFrame:
    return number_pages(filter_domain(_grouped(spark, sf), "www.example.com")).select("qid", "position", "url", "total")


def highlighted(spark: SparkSession, sf: str) -> DataFrame:
    from pagetrove.functions.highlight import highlight

    return _grouped(spark, sf).select("qid", "position", "url", highlight(F.col("summary"), F.col("q")).alias("summary"))


def served_page(spark: SparkSession, sf: str) -> DataFrame:
    served = serve_page(group_first_site(_ranked(spark, sf, "partial")), page=1)
    return served.select("qid", "position", "page", "total_pages", "first_result", "url", "title", "summary", "path")


def served_page_contains(spark: SparkSession, sf: str) -> DataFrame:
    """The first page with all that is served, by the matcher that SQL has too."""
    served = serve_page(_grouped(spark, sf), page=1)
    found = F.transform(F.coalesce("search_results", F.array().cast(served.schema["search_results"].dataType)), lambda r: r["url"])
    return served.select("qid", "position", "page", "total_pages", "first_result", "url", "title", "summary", "path",
                         F.array_join(found, " ").alias("site_links"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "page_titles_hosts": page_titles_hosts,
        "article_text": article_text,
        "dense_text": dense_text,
        "clean_paragraphs": clean_paragraphs,
        "merge_paragraphs": merge_paragraphs,
        "pack_chunks": pack,
        "chunk_rows": chunk_rows,
        "hashed_embedding": hashed_embedding,
        "model_embedding": model_embedding,
        "dedup_url": dedup_url,
        "dedup_hash": dedup_hash,
        "dedup_sequential": dedup_sequential,
        "new_pages_only": new_pages_only,
        "url_exists": url_exists,
        "stored_urls": stored_urls,
        "page_links": links,
        "link_deny": link_deny,
        "frontier": _frontier(100),
        "frontier_all": _frontier(-1),
        "crawl_counts": counts,
        "seed_urls": seed_urls,
        "sitemap_index": sitemap_index,
        "crawl_step": crawl_step,
        "crawl_reach": _reach(-1),
        "crawl_reach_capped": _reach(100),
        "ingest_rejects": ingest_rejects,
        "ingest_observed": ingest_observed,
        "site_key": site_keys,
        "breadcrumb": breadcrumbs,
        "vector_topk": _topk("cosine"),
        "vector_topk_dot": _topk("dot"),
        "vector_topk_euclidean": _topk("euclidean"),
        "vector_topk_lsh": vector_topk_lsh,
        "vector_topk_planes": vector_topk_planes,
        "vector_topk_lists": vector_topk_lists,
        "vector_topk_ivf": vector_topk_ivf,
        "vector_ivf_recall": vector_ivf_recall,
        "upsert_vectors": upsert_vectors,
        "delete_vectors": delete_vectors,
        "upsert_partitions": upsert_partitions,
        "delete_partitions": delete_partitions,
        "ingest_webpages": ingest_webpages,
        "ingest_chunks": ingest_chunks,
        "store_stats": store_stats,
        "reset_check": reset_check,
        "orphan_chunks": orphan_chunks,
        "stream_ingest": streamed_ingest,
        "stream_ingest_marked": streamed_ingest_marked,
        "stream_frontier": streamed_frontier,
        "search_join": _results,
        "result_dedup": result_dedup,
        "rank_rules": _rank_query("contains"),
        "rank_fuzzy": _rank_query("levenshtein"),
        "rank_partial_ratio": _rank_query("partial"),
        "rank_intended_snippets": _rank_query("partial", "intended"),
        "first_site_group": first_site_group,
        "site_links": site_links,
        "result_pages": result_pages,
        "domain_results": domain_results,
        "highlight": highlighted,
        "served_page": served_page,
        "served_page_contains": served_page_contains,
    }
