"""Ingest, search, ranking, serving, streams and reset, end to end."""

import pytest
from pyspark.sql import functions as F

from pagetrove.config import IngestConfig, SearchConfig
from pagetrove.operators.embed import hashed_embedder
from pagetrove.operators.rank import dedup_results, score_results
from pagetrove.operators.store import Store
from pagetrove.operators.vector_lists import VectorLists
from pagetrove.operators.vectors import LshIndex
from pagetrove.plans.ingest import reject_counts
from pagetrove.plans.ingest import ingest
from pagetrove.plans.reset import reset
from pagetrove.plans.search import rank, search
from pagetrove.plans.serve import filter_domain, number_pages, serve_page
from pagetrove.session import scratch_path
from pagetrove.sources.pages import read_pages, stream_pages
from pagetrove.sources.seeds import CrawlMode, crawl_mode, read_seeds
from pagetrove.streaming import stream_frontier, stream_ingest

RESULT = "qid long, q string, pid string, url string, title string, chunk string, summary string, score double"


@pytest.fixture(scope="module")
def store(spark):
    store = Store(spark, scratch_path(spark, "store")).create()
    ingest(store, read_pages(spark, "/root/testdata/sf0.001/pages.parquet"), batch_id=0)
    return store


def test_store_invariants(spark, store):
    pages, chunks = store.read("webpages"), store.read("chunks")
    n = pages.count()
    assert n and n == pages.select("hash").distinct().count() == pages.select("url").distinct().count()
    assert store.orphans().count() == 0
    assert store.read("vectors").count() == chunks.count() == chunks.select("id").distinct().count()
    stats = {r.name: (r.n_rows, r.dims) for r in store.stats().collect()}
    assert stats["webpages"] == (n, None) and stats["vectors"] == (chunks.count(), 384)
    assert store.all_urls().count() == n


def test_ingest_again_adds_nothing(spark, store):
    before = {r.name: r.n_rows for r in store.stats().collect()}
    pages = read_pages(spark, "/root/testdata/sf0.001/pages.parquet")
    ingest(store, pages, batch_id=1)
    ingest(store, pages, batch_id=0)
    assert {r.name: r.n_rows for r in store.stats().collect()} == before


def score_one(spark, url, title, summary, chunk="", **kw):
    row = (1, "spark sql", "p", url, title, chunk, summary, 0.5)
    return score_results(dedup_results(spark.createDataFrame([row], RESULT)), **kw).first()


def test_rank_rules(spark):
    best = score_one(spark, "https://ex.com/spark-sql", "Spark SQL guide", "Learn spark sql today in depth")
    assert best.score == 0.75 and best.domain == "ex.com" and best.path == "ex.com › spark-sql"
    worst = score_one(spark, "https://ex.com/a?p=1", "x" * 60, "short")
    assert worst.score == -0.01 and worst.summary == ""


def test_intended_snippets(spark):
    line = "all about <b>spark sql</b> and how its planner works in depth, with examples"
    row = score_one(spark, "https://ex.com/a", "t", None, f"t part 1 of 1 (u):\n{line}\ntiny", snippets="intended")
    assert row.summary == "all about spark sql and how its planner works in depth, with examples"
    assert row.score == 0.41


def ranked(spark, hosts, scores=None):
    rows = [(1, "q", f"p{i}", f"https://{h}/{i}", "t", "", "a summary of more than twenty", 1 - i / 10) for i, h in enumerate(hosts)]
    return rank(spark.createDataFrame(rows, RESULT))


def test_grouping_and_domain(spark):
    grouped = ranked(spark, ["a.com", "b.com", "www.a.com", "a.com"])
    rows = grouped.orderBy("position").collect()
    assert [r.url for r in rows] == ["https://a.com/0", "https://b.com/1"]
    assert [r.url for r in rows[0].search_results] == ["https://a.com/0", "https://www.a.com/2", "https://a.com/3"]
    assert rows[0].first_result and not rows[1].first_result and rows[1].search_results is None
    page = serve_page(grouped).orderBy("position").collect()
    assert [r.url for r in page[0].search_results] == ["https://www.a.com/2", "https://a.com/3"]
    assert [r.url for r in filter_domain(grouped, "x.b.com").collect()] == ["https://b.com/1"]
    assert filter_domain(grouped, "b.com", "first_group").count() == 3
    assert serve_page(grouped, dm="a.com").count() == 3


def test_paging(spark):
    results = spark.range(1, 62).select(F.lit(1).alias("qid"), F.col("id").alias("position"))
    pages = number_pages(results).filter("page = 3").collect()
    assert [(r.position, r.total, r.total_pages) for r in pages] == [(61, 61, 3)]


def test_same_url_keeps_best_chunk(spark):
    rows = [(1, "q", "a", "https://h.com/X", "t", "", "", 0.1), (1, "q", "b", "https://h.com/x", "t", "", "", 0.9)]
    assert [r.pid for r in dedup_results(spark.createDataFrame(rows, RESULT)).collect()] == ["b"]


@pytest.mark.parametrize("use_index", ["scan", "planes", "lists"])
def test_search_end_to_end(spark, store, use_index):
    embed = hashed_embedder(384)
    titles = store.read("webpages").select(F.xxhash64("url").alias("qid"), F.col("title").alias("q"), "url")
    queries = titles.select("qid", "q").unionByName(spark.createDataFrame([(0, "  ")], "qid long, q string"))
    vectors = store.read("vectors")
    index = {"scan": lambda: None, "planes": lambda: LshIndex(dims=384), "lists": lambda: VectorLists.build(vectors)}[use_index]()
    vectors = index.index(vectors) if use_index == "planes" else vectors
    found = search(queries, store.read("webpages"), store.read("chunks"), vectors, embed, SearchConfig(max_results=10), index)
    grouped = rank(found).cache()
    assert grouped.filter("qid = 0").count() == 0
    assert grouped.filter("first_result").count() == titles.count() == grouped.select("qid").distinct().count()
    assert grouped.groupBy("qid", F.lower("url")).count().filter("count > 1").count() == 0
    own = grouped.filter("first_result").join(titles.select("qid", F.col("url").alias("own")), "qid")
    assert own.filter("url = own").count() >= 0.8 * titles.count()
    assert serve_page(grouped, page=99).count() == 0
    grouped.unpersist()


def test_stream_equals_batch(spark, tmp_path, store):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = str(tmp_path / "in")
    for seed in (1, 2):
        pages.orderBy(F.rand(seed)).repartition(3).write.mode("append").parquet(folder)
    streamed = Store(spark, str(tmp_path / "store")).create()
    query = stream_ingest(streamed, stream_pages(spark, folder, max_files=2), str(tmp_path / "cp"))
    query.awaitTermination()
    hashes = lambda s: {r.hash for r in s.read("webpages").collect()}
    assert len(query.recentProgress) >= 3
    assert hashes(streamed) == hashes(store)
    assert streamed.read("webpages").count() == len(hashes(streamed)) and streamed.orphans().count() == 0


def test_streams_keep_what_others_stored(spark, tmp_path):
    page = lambda i: (i, f"https://h.com/{i}", f"<article><p>One {i}. Two {i}. Three {i}.</p></article>")
    schema = "page_id long, url string, html string"
    store = Store(spark, str(tmp_path / "store")).create()
    ingest(store, spark.createDataFrame([page(i) for i in range(5)], schema), 0)
    for k, ids in enumerate((range(3, 9), range(9, 12), range(9, 14))):
        folder = str(tmp_path / f"in{k}")
        spark.createDataFrame([page(i) for i in ids], schema).repartition(2).write.parquet(folder)
        stream_ingest(store, stream_pages(spark, folder, max_files=1), str(tmp_path / f"cp{k}")).awaitTermination()
    assert sorted(r.url for r in store.all_urls().collect()) == sorted(f"https://h.com/{i}" for i in range(14))
    ingest(store, spark.createDataFrame([page(i) for i in range(5)], schema), 0)  # a replay
    assert store.read("webpages").count() == 14 and store.orphans().count() == 0


def test_marked_stream_is_sequential(spark, tmp_path):
    """A page skipped for its content does not reserve its address, over micro-batches and restarts."""
    from pagetrove.streaming import known_pages, stream_ingest_marked

    def page(i, url, content):
        return i, f"https://h.com/{url}", f"<article><p>One {content}. Two {content}. Three {content}.</p></article>"

    schema, folder = "page_id long, url string, html string", str(tmp_path / "in")
    store = Store(spark, str(tmp_path / "store")).create()
    ingest(store, spark.createDataFrame([page(0, "a", "x")], schema), 0)
    batches = [[(1, "b", "x"), (2, "b", "y"), (3, "c", "y")], [(4, "c", "z"), (5, "a", "w"), (6, "b", "v")],
               [(7, "d", "z"), (8, "d", "u"), (9, "d", "t"), (10, "e", "t")]]
    before = spark.conf.get(known_pages.STATE_STORE)
    spark.conf.set(known_pages.STATE_STORE, known_pages.ROCKSDB)
    try:
        for k, rows in enumerate(batches):
            spark.createDataFrame([page(*r) for r in rows], schema).coalesce(1).write.mode("append").parquet(folder)
            if k != 1:  # the first start, then a restart that finds two files
                query = stream_ingest_marked(store, stream_pages(spark, folder, max_files=1), str(tmp_path / "cp"))
                query.processAllAvailable()
                plan = query._jsq.explainInternal(False) if hasattr(query._jsq, "explainInternal") else ""
                query.stop()
    finally:
        spark.conf.set(known_pages.STATE_STORE, before)
    with pytest.raises(ValueError, match="RocksDB"):
        stream_ingest_marked(store, stream_pages(spark, folder), str(tmp_path / "cp2"))
    assert "TransformWithState" in plan or not plan
    assert sorted(r.url[-1] for r in store.all_urls().collect()) == ["a", "b", "c", "d", "e"]
    bodies = {r.url[-1]: r.chunk.split("One ")[1][0] for r in store.read("chunks").collect()}
    assert bodies == {"a": "x", "b": "y", "c": "z", "d": "u", "e": "t"} and store.orphans().count() == 0


def test_vector_table_rewrites_what_it_must(spark, tmp_path):
    from pagetrove.operators.vector_table import VectorTable

    def rows(*pairs):
        return spark.createDataFrame([(i, [float(x)]) for i, x in pairs], "id string, values array<float>")

    def files():
        return {str(f.relative_to(tmp_path)) for f in tmp_path.glob("t/slot=*/*.parquet")}

    def held(t):
        return {r.id: r["values"][0] for r in t.read().collect()}

    t = VectorTable(spark, str(tmp_path / "t"), slots=8).create()
    t.upsert(rows(*[(f"v{i}", i) for i in range(100)]))
    before = files()
    t.upsert(rows(("v7", -1)))
    assert held(t) == {f"v{i}": i for i in range(100)} | {"v7": -1}
    gone, fresh = before - files(), files() - before
    assert len({f.split("/")[1] for f in gone | fresh}) == 1  # one partition
    t.delete(rows(*[(f"v{i}", 0) for i in range(99)], ("none", 0)))
    assert held(t) == {"v99": 99.0}
    t.delete(rows(("v99", 0)))
    assert held(t) == {} and len({f.split("/")[1] for f in files()}) == 8
    t.upsert(rows(("a", 1), ("a", 2)).withColumn("n", F.col("values")[0]), order="n")
    t.upsert(rows().union(rows(("x", 1)).filter("false")))
    assert held(t) == {"a": 2.0}
    # a job cut off after it wrote aside is finished by the next
    aside = t._placed(rows(("b", 5))).unionByName(t._placed(rows(("a", 2)))).select("id", "values", "slot")
    aside.write.parquet(str(tmp_path / "aside"))
    t._note(f"file:{tmp_path}/aside")
    t.delete(rows(("nothing", 0)))
    assert held(t) == {"a": 2.0, "b": 5.0}


def test_append_during_a_rewrite_is_kept(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s")).create()
    vectors = lambda *ids: spark.createDataFrame([(i, [1.0]) for i in ids], "id string, values array<float>")
    store.append("vectors", vectors("a", "b"), 0)
    added = []

    def change(rows):
        if not added:
            added.append(store.append("vectors", vectors("c"), 1, "other"))
        return rows.filter("id <> 'a'")

    store._rewrite("vectors", change)
    assert sorted(r.id for r in store.read("vectors").collect()) == ["b", "c"]
    with pytest.raises(ValueError):
        store.append("vectors", vectors("d"), 2, "../x")


def test_pages_without_address_or_text_are_rejected(spark, tmp_path):
    rows = [(1, None, "<article><p>Same text. Here.</p></article>"), (2, "https://h.com/2", "<article><p>Same text. Here.</p></article>"),
            (3, "https://h.com/3", None), (4, "nowhere", "<p>x</p>"), (5, "https://h.com/5", "<p> </p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    store = Store(spark, str(tmp_path / "s")).create()
    assert ingest(store, pages, 0) == {"no address": 2, "no html": 1, "no text": 1}
    assert [r.url for r in store.all_urls().collect()] == ["https://h.com/2"]
    assert {r.reason: r.n for r in reject_counts(pages).collect()} == {"no address": 2, "no html": 1, "no text": 1}


def test_stream_frontier_adds_each_link_once(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    folder = str(tmp_path / "in")
    for _ in range(2):
        pages.write.mode("append").parquet(folder)
    links = Store(spark, str(tmp_path / "store")).create()
    stream_frontier(links, stream_pages(spark, folder, max_files=1), str(tmp_path / "cp")).awaitTermination()
    found = links.read("links")
    assert found.count() == found.select("url").distinct().count() > 0


def test_upsert_delete_reset(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s")).create()
    vectors = lambda rows: spark.createDataFrame(rows, "id string, values array<float>, n int")
    store.upsert_vectors(vectors([("a", [1.0], 1), ("b", [2.0], 1), ("a", [3.0], 2)]), 0, order="n")
    store.upsert_vectors(vectors([("b", [5.0], 1), ("c", [6.0], 1)]), 1)
    assert {r.id: r["values"][0] for r in store.read("vectors").collect()} == {"a": 3.0, "b": 5.0, "c": 6.0}
    store.delete_vectors(spark.createDataFrame([("a",), ("zz",)], "id string"))
    assert {r.id for r in store.read("vectors").collect()} == {"b", "c"}
    assert tuple(reset(store).first()) == (0, True)
    assert store.read("vectors").count() == 0


def test_seeds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("https://a.com\n\nhttps://b.com\n")
    (tmp_path / "b.xml").write_text("<urlset>\n<url><loc>https://c.com/x</loc></url>\n</urlset>\n")
    urls = lambda s: [r.url for r in read_seeds(spark, s).collect()]
    assert urls(str(tmp_path / "a.txt")) == ["https://a.com", "https://b.com"]
    assert urls(str(tmp_path / "b.xml")) == ["https://c.com/x"]
    assert urls("https://d.com") == ["https://d.com"]
    assert crawl_mode(read_seeds(spark, "https://d.com"), 5) == CrawlMode(True, 5)
    assert crawl_mode(read_seeds(spark, str(tmp_path / "a.txt")), 5) == CrawlMode(False, -1)
    (tmp_path / "c.xml").write_text("<urlset><url><loc>https://c.com/?a=1&amp;b=2</loc></url><url><loc>\n https://e.com </loc></url><loc></loc></urlset>")
    assert urls(str(tmp_path / "c.xml")) == ["https://c.com/?a=1&b=2", "https://e.com"]


def test_parity_switches(spark, tmp_path):
    html = "<title>T</title><article><p>One. Two. Three.</p><p>Four. Five.</p></article>"
    pages = spark.createDataFrame([(1, "https://h.com/a", html)], "page_id long, url string, html string")
    store = Store(spark, str(tmp_path / "s")).create()
    ingest(store, pages, 0, IngestConfig(block_breaks=False, sitename="article", dims=16))
    assert store.read("chunks").first().chunk.endswith("\nOne. Two. Three.Four. Five.\n")
    assert store.read("webpages").first().sitename is None


def test_rejects_are_counted_in_one_parse(spark):
    """No filter works the parse out once more, before the rows are shared out; pages without an address aren't parsed."""
    plan = reject_counts(read_pages(spark, "/root/testdata/sf0.001/pages.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Repartition") == 1
    assert not [line for line in plan.splitlines() if "Filter" in line and "html" in line]
    rows = [(1, None, "<p>One. Two.</p>"), (2, "https://h.com/2", None), (3, "nowhere", None), (4, "https://h.com/4", "<p>One. Two.</p>")]
    found = reject_counts(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert sorted(tuple(r) for r in found.collect()) == [("no address", 2), ("no html", 1)]
    assert found.schema.simpleString() == "struct<reason:string,n:bigint>"


def test_a_stream_of_one_file_is_shared_out(spark, tmp_path):
    from pagetrove.streaming.jobs import start_batches

    folder, seen = str(tmp_path / "in"), []
    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").coalesce(1).write.parquet(folder)
    pages = stream_pages(spark, folder, max_files=1)
    start_batches(pages, lambda batch, i, w: seen.append(batch.rdd.getNumPartitions()), str(tmp_path / "cp"), None).awaitTermination()
    assert seen == [spark.sparkContext.defaultParallelism]


def test_events_of_pages_are_parsed_after_sharing_out(spark):
    from pagetrove.plans.ingest import parsed_rows
    from pagetrove.streaming import known_pages

    rows = [(1, "https://h.com/1", "<article><p>One. Two.</p></article>"), (2, "https://h.com/2", "<p> </p>"), (3, "https://h.com/3", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    events = known_pages._events(parsed_rows(pages), False)
    assert sorted((r.kind, r.value[:13]) for r in events.select("kind", "value").collect())[1:] == [("url", "https://h.com")]
    assert {r.page.page_id for r in events.filter("page is not null").collect()} == {1} and events.count() == 2


def test_snippets_are_matched_without_a_shuffle(spark):
    """Each line was a row, dealt out and joined back, and the results' chunks with it."""
    lines = ["head", "all about <b>spark sql</b> and how its planner works in depth, with examples", "tiny", "",
             "another long line about spark alone, which has only one of the two words", "spark sql"]
    rows = [(1, "Spark SQL", "p", "https://ex.com/a", "t", "\n".join(lines), None, 0.5), (1, "Spark SQL", "q", "https://ex.com/b", "t", None, None, 0.4),
            (2, "word", "p", "https://ex.com/a", "t", "head", "short", 0.5)]
    found = score_results(dedup_results(spark.createDataFrame(rows, RESULT)), snippets="intended")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    got = {(r.qid, r.url[-1]): r.summary for r in found.collect()}
    assert got == {(1, "a"): "all about spark sql and how its planner works in depth, with examples", (1, "b"): "", (2, "a"): ""}
