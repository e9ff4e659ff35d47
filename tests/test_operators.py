"""Operators against plain Python, on generated and hand-made rows."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pagetrove.operators import dedup, vectors
from pagetrove.operators.chunking import (
    clean_paragraph, content_hash, merge_single_sentences, number_chunks, pack_chunks, paragraphs,
)
from pagetrove.operators.embed import hashed_embedder, model_embedder, word_model
from pagetrove.operators.links import cap_frontier, page_links
from pagetrove.operators.vector_lists import ListConfig, Settings, VectorLists
from pagetrove.operators.vectors import LshIndex, vector_topk
from pagetrove.plans.frontier import frontier, reach


def one(spark, value, schema, column):
    return spark.createDataFrame([(value,)], f"x {schema}").select(column.alias("v")).first().v


def test_clean_paragraph(spark):
    assert one(spark, "  a\tb\tc  d  e ", "string", clean_paragraph(F.col("x"))) == "a b\tc d  e"
    assert one(spark, "  a\tb\tc  d  e ", "string", clean_paragraph(F.col("x"), "all")) == "a b c d e"


def test_merge(spark):
    merge = lambda ps: one(spark, ps, "array<string>", merge_single_sentences(F.col("x")))
    assert merge(["Heading", "One. Two.", "Tail"]) == ["Heading\nOne. Two.", "Tail"]
    assert merge(["A", "B", "C. D."]) == ["A\nB", "C. D."]
    assert merge([]) == []


def test_pack(spark):
    pack = lambda ps, **kw: one(spark, ps, "array<string>", pack_chunks(F.col("x"), 10, **kw))
    assert pack(["aaaaaaaaaaaa", "bb", "cc"]) == ["", "aaaaaaaaaaaa\n", "bb\ncc\n"]
    assert pack(["aaaaaaaaaaaa", "bb", "cc"], drop_empty=True) == ["aaaaaaaaaaaa\n", "bb\ncc\n"]
    assert pack(["aaaaaaaa", "bbb"]) == ["aaaaaaaa\n"]
    assert pack([]) == []


def test_chunks_keep_all_text(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    paras = paragraphs(F.col("text"), "\n")
    rows = docs.select(paras.alias("p"), pack_chunks(paras, min_tail=0).alias("c")).collect()
    assert all("".join(r.c) == "".join(p + "\n" for p in r.p) for r in rows)


def test_chunk_rows(spark):
    df = spark.createDataFrame([("u", "T", ["x", "y"])], "url string, title string, chunks array<string>")
    rows = sorted(number_chunks(df).collect(), key=lambda r: r.pid)
    assert [r.pid for r in rows] == ["u-1", "u-2"]
    assert rows[0].chunk == "T part 1 of 2 (u):\nx"
    assert rows[0].id == hashlib.sha256(b"u-1").hexdigest()
    expected = "7e18f737311b2dc3b2f269dd78396b0351f14fb66efa879f768cb23181883c78"
    assert one(spark, ["a", "b"], "array<string>", content_hash(F.col("x"))) == expected


def sequential(rows):
    urls, hashes, kept = set(), set(), []
    for order, url, content in sorted(rows):
        if url not in urls and content not in hashes:
            urls.add(url), hashes.add(content), kept.append(order)
    return kept


@pytest.mark.parametrize("rows", [
    [(1, "u1", "h1"), (2, "u2", "h1"), (3, "u2", "h2")],
    [(1, "u1", "h1"), (2, "u1", "h2"), (3, "u3", "h2")],
    [(i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(8)],
    [],
])
def test_first_wins_cases(spark, rows):
    keys = spark.createDataFrame(rows, "page_id long, url string, hash string")
    assert sorted(r.page_id for r in dedup.first_wins_pairs(keys).collect()) == sequential(rows)


@pytest.mark.parametrize("hot_keys, replay_rows, sweeps", [(1000, 200_000, 3), (3, 0, 3), (3, 20, 0), (1000, 40, 1)])
def test_first_wins_random_with_hot_keys(spark, monkeypatch, hot_keys, replay_rows, sweeps):
    monkeypatch.setattr(dedup, "HOT_KEYS", hot_keys)
    monkeypatch.setattr(dedup, "REPLAY_ROWS", replay_rows)
    monkeypatch.setattr(dedup, "SWEEPS", sweeps)
    rng = random.Random(7)
    pick = lambda n: 0 if rng.random() < 0.4 else rng.randrange(n)
    rows = [(i, f"u{pick(60)}", f"h{pick(60)}") for i in range(300)]
    rows += [(i, f"x{i // 2}", f"y{(i + 1) // 2}") for i in range(1000, 1010)]                                 # a chain
    rows += [(i, f"{i // 10}{rng.randrange(3)}", f"{i // 10}{rng.randrange(3)}") for i in range(2000, 2200)]  # small components
    keys = spark.createDataFrame(rows, "page_id long, url string, hash string")
    assert sorted(r.page_id for r in dedup.first_wins_pairs(keys).collect()) == sequential(rows)


def test_components(spark):
    rows = [(0, "a", "x"), (1, "a", "y"), (2, "b", "y"), (3, "c", "z"), (4, "d", "w"), (5, "d", "v")]
    rows += [(i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(100, 130)]
    rest = spark.createDataFrame(rows, "o long, u string, h string").repartition(3)
    from pagetrove.session import write_scratch

    small, large = dedup._by_component(rest, len(rows), write_scratch)
    groups = {}
    for r in small.collect():
        groups.setdefault(r.component, set()).add(r.o)
    assert sorted(map(sorted, groups.values())) == [[0, 1, 2], [3], [4, 5], list(range(100, 130))] and large.count() == 0


@pytest.mark.parametrize("order", ["page_id", ("batch", "page_id")])
def test_chain_of_pages_in_few_jobs(spark, order):
    rows = [(0, i, f"u{i // 2}", f"h{(i + 1) // 2}") for i in range(10_000)]
    keys = spark.createDataFrame(rows, "batch int, page_id long, url string, hash string")
    spark.sparkContext.setJobGroup("chain", "chain")
    kept = sorted(r.page_id for r in dedup.first_wins_pairs(keys, order).collect())
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert kept == sequential([r[1:] for r in rows]) and jobs < (10 if order == "page_id" else 20)


def brute(v, q, k, metric):
    out = {}
    for qi, qv in q.items():
        scored = []
        for vi, vv in v.items():
            a, b = np.array(qv, float), np.array(vv, float)
            if metric == "euclidean":
                s = -round(float(np.linalg.norm(a - b)), 6)
            else:
                s = float(a @ b)
                if metric == "cosine":
                    n = np.linalg.norm(a) * np.linalg.norm(b)
                    s = s / n if n else 0.0
                s = round(s, 6)
            scored.append((-s, vi))
        out[qi] = [vi for _, vi in sorted(scored)[:k]]
    return out


def vector_tables(spark, n=300, n_queries=40, same=100):
    rng = np.random.default_rng(3)
    rows = rng.integers(-2, 3, (n, 8)).astype(float)
    rows[:same] = rows[0]  # a third of all vectors are one vector
    v = {f"v{i:04d}": rows[i].tolist() for i in range(n)}
    q = {i: (rows[0] if i % 3 == 0 else rng.integers(-2, 3, 8)).astype(float).tolist() for i in range(n_queries)}
    vdf = spark.createDataFrame(list(v.items()), "id string, values array<float>").repartition(3)
    qdf = spark.createDataFrame(list(q.items()), "qid long, qvec array<float>")
    return v, q, vdf, qdf


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.qid, r["rank"])):
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("limit", [vectors.MAX_BROADCAST_BYTES, 900])
def test_topk_exact(spark, monkeypatch, metric, limit):
    monkeypatch.setattr(vectors, "_SCAN_ROWS", 25)
    v, q, vdf, qdf = vector_tables(spark)
    got = by_query(vector_topk(vdf, qdf, 7, metric, max_broadcast_bytes=limit))
    assert got == brute(v, q, 7, metric)


def test_topk_fewer_vectors_than_k(spark):
    v, q, vdf, qdf = vector_tables(spark, n=5, n_queries=3, same=1)
    assert by_query(vector_topk(vdf, qdf, 10)) == brute(v, q, 10, "cosine")


def test_lsh_recall_and_hot_bucket(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    vdf = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    qdf = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    exact = {(r.qid, r.id) for r in vector_topk(vdf, qdf, 10).collect()}
    index = LshIndex(dims=64)
    plain = index.topk(index.index(vdf), qdf, 10).collect()
    assert len(exact & {(r.qid, r.id) for r in plain}) / len(exact) >= 0.95  # one plane: nearly all are candidates
    cut = index.topk(index.index(vdf), qdf, 10, vectors_per_slot=40, queries_per_slot=30).collect()
    assert sorted(plain) == sorted(cut)


def clustered(spark, path, n=20_000, groups=200):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((groups, 64))
    rows = (centres[np.arange(n) % groups] + 0.25 * rng.standard_normal((n, 64))).astype(np.float32)
    pq.write_table(pa.table({"id": np.arange(n), "values": pa.array(list(rows), pa.list_(pa.float32()))}), path, row_group_size=5000)
    return spark.read.parquet(path)


def test_lsh_prunes_clustered_vectors(spark, tmp_path):
    vdf = clustered(spark, str(tmp_path / "v.parquet"))
    qdf = vdf.filter("id % 200 = 7").select(F.col("id").alias("qid"), F.col("values").alias("qvec"))
    index = LshIndex.tuned(vdf, qdf)
    exact = {(r.qid, r.id) for r in vector_topk(vdf, qdf, 10).collect()}
    found = {(r.qid, r.id) for r in index.topk(index.index(vdf), qdf, 10).collect()}
    assert len(exact & found) / len(exact) >= 0.9
    v = index.index(vdf).select("id", F.explode("buckets").alias("bucket"))
    q = index.index(qdf, "qvec", probe=True).select("qid", F.explode("buckets").alias("bucket"))
    assert v.join(q, "bucket").select("qid", "id").distinct().count() <= 0.1 * 20_000 * qdf.count()


def test_lsh_recall_of_the_registered_query(spark):
    import site_queries

    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").filter("vec_id % 10 = 0")
    exact = site_queries.vector_topk(*site_queries._vectors(spark, "/root/testdata/sf0.1"), k=10).join(
        rows.selectExpr("vec_id qid"), "qid")
    found = site_queries.vector_topk_lsh(spark, "/root/testdata/sf0.1").select("qid", "id")
    assert exact.join(found, ["qid", "id"], "left_semi").count() >= 0.9 * exact.count()


def scores_of(df):
    return {(r.qid, r.id): (r.score, r["rank"]) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
def test_lists_answer_as_the_scan_does(spark, metric):
    v, q, vdf, qdf = vector_tables(spark)  # a third of all vectors are one vector
    index = VectorLists.build(vdf, ListConfig(metric=metric))
    exact = scores_of(vector_topk(vdf, qdf, 7, metric))
    assert scores_of(index.topk_exact(qdf, 7)) == exact
    assert scores_of(index.topk_exact(qdf, 7, max_broadcast_bytes=900)) == exact
    if metric == "cosine":  # more than there are
        assert scores_of(index.topk_exact(qdf, 400)) == scores_of(vector_topk(vdf, qdf, 400, metric))
    everything = Settings(exact=False, probes=len(index.sizes), candidates=300)
    assert scores_of(index.topk(qdf, 7, everything)) == exact
    flat = Settings(exact=False, probes=len(index.sizes))
    assert scores_of(index.topk(qdf, 7, flat, max_broadcast_bytes=900)) == exact


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_lists_prune_clustered_vectors(spark, tmp_path, metric):
    vdf = clustered(spark, str(tmp_path / "v.parquet"))
    qdf = vdf.filter("id % 40 = 7").select(F.col("id").alias("qid"), F.col("values").alias("qvec"))
    pairs = vdf.count() * qdf.count()
    exact = scores_of(vector_topk(vdf, qdf, 10, metric))
    index = VectorLists.build(vdf, ListConfig(metric=metric))
    assert scores_of(index.topk_exact(qdf, 10)) == exact and index.scored["full"] < 0.3 * pairs
    settings = index.tune(qdf)
    assert not settings.exact and settings.share < 0.1 and settings.candidates < 500
    index.scored.update(full=0, code=0)
    found = scores_of(index.topk(qdf, 10, settings))
    assert len(exact.keys() & found.keys()) >= 0.9 * len(exact) and index.scored["code"] < 0.1 * pairs
    assert all(found[key][0] == exact[key][0] for key in exact.keys() & found.keys())  # scores are exact


def test_lists_read_only_what_they_need(spark, tmp_path):
    vdf = clustered(spark, str(tmp_path / "v.parquet"), 4000, 40)
    index = VectorLists.build(vdf, ListConfig(lists=20))
    plan = index.read(np.array([3]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "list_id" in plan
    files = index.read(np.array([3])).select(F.input_file_name().alias("f")).distinct().collect()
    assert files and all("list_id=3/" in r.f for r in files)


def test_lists_choose_the_exact_search(spark, sf_small):
    rows = spark.read.parquet(f"{sf_small}/embeddings.parquet")
    vdf = rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("values"))
    qdf = rows.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))
    assert VectorLists.build(vdf).tune(qdf).exact  # the test vectors have no clusters


def test_lists_of_few_and_no_vectors(spark):
    empty = spark.createDataFrame([], "id long, values array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0])], "qid long, qvec array<float>")
    assert VectorLists.build(empty).topk(asked, 5).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0])], "id long, values array<float>")
    index = VectorLists.build(few)
    assert by_query(index.topk(asked, 5)) == {1: [1, 2, 3]}
    assert index.topk(asked.filter("qid > 1"), 5).count() == 0


def test_vectors_of_two_lengths_are_refused(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0, 4.0, 5.0])], "id long, values array<float>")
    q = spark.createDataFrame([(1, [1.0, 2.0, 3.0, 4.0])], "qid long, qvec array<float>")
    with pytest.raises(Exception, match="different or no lengths"):
        vector_topk(v, q).collect()


def test_near_scores_are_told_apart(spark):
    v = spark.createDataFrame([(1, [1.0, 1e-7]), (2, [1.0, 0.0])], "id long, values array<double>")
    q = spark.createDataFrame([(1, [0.0, 1.0])], "qid long, qvec array<double>")
    assert [r.id for r in vector_topk(v, q, 1, "dot").collect()] == [1]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1e-7])], "id long, values array<double>")
    assert [r.id for r in vector_topk(v, q, 1, "dot").collect()] == [2]


def test_lookup_does_not_shuffle_the_store(spark, tmp_path):
    spark.range(100_000).selectExpr("concat('u', id) url").write.parquet(str(tmp_path / "stored"))
    stored = spark.read.parquet(str(tmp_path / "stored"))
    plans = []

    def save(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        from pagetrove.session import write_scratch
        return write_scratch(df, label)

    few = spark.createDataFrame([("u5",), ("x",)], "url string")
    assert sorted(map(tuple, dedup.exists_in(few, stored, "url", save=save).collect())) == [("u5", True), ("x", False)]
    assert "SortMergeJoin" not in plans[1] and "BroadcastHashJoin" in plans[1]


def test_embedding_is_unit_length(spark):
    df = spark.createDataFrame([("Spark SQL spark",), ("",), (None,)], "t string")
    rows = [np.array(r.v) for r in df.select(hashed_embedder(32)(F.col("t")).alias("v")).collect()]
    assert abs(np.linalg.norm(rows[0]) - 1) < 1e-6
    assert not rows[1].any() and not rows[2].any() and len(rows[1]) == 32


def test_model_embedder(spark):
    made = []

    def make():
        made.append(1)

        def predict(texts):
            assert len(texts) <= 3
            return np.array([[len(t), len(made)] for t in texts], np.float32)

        return predict

    df = spark.createDataFrame([("a" * i,) for i in range(10)] + [(None,)], "t string").coalesce(1)
    rows = [r.v for r in df.select(model_embedder(make, batch_size=3)(F.col("t")).alias("v")).collect()]
    assert sorted(rows) == sorted([[float(i), 1.0] for i in range(10)] + [[0.0, 1.0]])
    text = F.lit("Grüße, Spark SQL spark_2 été")
    both = spark.range(1).select(model_embedder(word_model(16))(text).alias("a"), hashed_embedder(16)(text).alias("b")).first()
    assert both.a == both.b


def test_links_and_frontier(spark):
    html = '<!-- <a href="/no"> --><a class=x href="/b">b</a><a href=\'c.pdf\'>c</a><a data-href="/no" href="/b#x">b</a><a href="https://o.com/">o</a>'
    pages = spark.createDataFrame([(1, "https://h.com/a", html), (2, "https://h.com/b", '<a href="/d">d</a>')], "page_id long, url string, html string")
    found = {(r.page_id, r.link) for r in page_links(pages).collect()}
    assert found == {(1, "https://h.com/b"), (1, "https://h.com/c.pdf"), (2, "https://h.com/d")}
    assert any(r.link == "https://o.com/" for r in page_links(pages, same_host=False).collect())
    known = spark.createDataFrame([("https://h.com/x",)], "url string")
    assert [tuple(r) for r in frontier(pages, known).collect()] == [("https://h.com/d", 1)]


@pytest.mark.parametrize("base, want", [
    ('<base href="https://h.com/docs/v2/">', "https://h.com/docs/v2/a"),
    ("<base target=x href='/docs/'>", "https://h.com/docs/a"),
    ("<base href=sub/page>", "https://h.com/x/sub/a"),
    ("<base href='https://other.org/'>", None),
    ("<base target='_blank'><basefont href='/no/'>", "https://h.com/x/a"),
    ("<!-- <base href='/no/'> --><base href=''>", "https://h.com/x/a"),
])
def test_links_are_relative_to_the_base(spark, base, want):
    pages = spark.createDataFrame([(1, "https://h.com/x/y?q=1", f"<head>{base}</head><a href='a'>a</a>")], "page_id long, url string, html string")
    assert [r.link for r in page_links(pages).collect()] == ([want] if want else [])


def test_reach(spark):
    edges = [("h/1", "h/2"), ("h/1", "h/3"), ("h/2", "h/1"), ("h/2", "h/4"), ("h/3", "h/4"), ("h/4", "h/5"), ("h/9", "h/8")]
    links = spark.createDataFrame([(f"https://{a}", f"https://{b}") for a, b in edges], "source string, link string")
    seeds = spark.createDataFrame([("https://h/1#top",), ("https://H/1",), (None,)], "url string")

    def found(**limits):
        return sorted((r.depth, r.url[-1]) for r in reach(links, seeds, **limits).collect())

    every = [(0, "1"), (1, "2"), (1, "3"), (2, "4"), (3, "5")]
    assert found() == every and found(max_depth=2) == every[:4] and found(max_depth=0) == every[:1]
    assert [found(max_pages=n) for n in (1, 2, 4, 9)] == [every[:1], every[:2], every[:4], every]
    assert reach(links, seeds.filter("url is null")).count() == 0


def test_cap(spark):
    links = spark.createDataFrame([("b", 1, "s"), ("a", 2, "s"), ("c", 1, "t")], "url string, depth int, site string")
    assert [r.url for r in cap_frontier(links, 2).collect()] == ["b", "c"]
    assert cap_frontier(links, -1).count() == 3
    assert {r.url for r in cap_frontier(links, 1, per="site").collect()} == {"b", "c"}


@pytest.mark.parametrize("hot_keys", [1000, 3])
def test_known_keys_with_hot_keys(spark, monkeypatch, hot_keys):
    monkeypatch.setattr(dedup, "HOT_KEYS", hot_keys)
    rows = [(i, "hot" if i % 3 == 0 else "hot2" if i % 3 == 1 else f"u{i}") for i in range(90)]
    stored = spark.createDataFrame([("hot",), ("hot",), ("u2",), ("u5",), ("other",)], "url string")
    df = spark.createDataFrame(rows, "page_id long, url string")
    known = {r[0] for r in stored.collect()}
    flagged = {r.page_id: r.known for r in dedup.exists_in(df, stored, "url").collect()}
    assert flagged == {i: u in known for i, u in rows}
    assert sorted(r.page_id for r in dedup.drop_known(df, stored, "url").collect()) == [i for i, u in rows if u not in known]


@pytest.mark.parametrize("n", [1, 137, 499, 500, 600])
def test_large_cap_by_range(spark, n):
    from pagetrove.operators import links as module

    rows = [(f"u{i * 7919 % 1000:04d}", i % 3) for i in range(500)]
    df = spark.createDataFrame(rows, "url string, depth int").repartition(4)
    got = sorted((r.depth, r.url) for r in module.cap_frontier(df, n).collect())
    assert got == sorted((d, u) for u, d in rows)[:n]


@pytest.mark.parametrize("metric", ["cosine", "dot", "euclidean"])
@pytest.mark.parametrize("sparse", [False, True])
def test_shortlist_scores_in_full_only_what_can_matter(monkeypatch, metric, sparse):
    rng = np.random.default_rng(5)
    rows, queries = rng.standard_normal((900, 64)).astype(np.float32).astype(float), rng.standard_normal((30, 64))
    rows[rng.integers(0, 900, 300)] = rows[0]                       # one vector with very many copies
    queries[0] = rows[0] + (metric == "euclidean")
    if sparse:
        queries *= rng.random(queries.shape) < 0.04
        queries[:, 0] = 1
    if metric == "cosine":
        rows, queries = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (rows, queries))
    cells = [0]
    whole = vectors.closeness
    monkeypatch.setattr(vectors, "closeness", lambda q, v, m: (cells.__setitem__(0, cells[0] + len(q) * len(v)), whole(q, v, m))[1])
    found = vectors.Shortlist(queries, 5, metric, pa.int64())
    ids = rng.permutation(900)
    for start in range(0, 900, 300):
        part = slice(start, start + 300)
        found.add(pa.table({"id": pa.array(ids[part]), "values": pa.array(rows[part].tolist(), pa.list_(pa.float64()))}))
    table = found.table(pa.array(np.arange(30)))
    scores = np.round(whole(queries, rows, metric), 9)
    for q in range(30):
        order = np.lexsort((ids, -scores[q]))[:5]
        mine = table.filter(pa.array(table["qid"].to_numpy() == q))
        assert mine["id"].to_pylist() == ids[order].tolist()
        np.testing.assert_allclose(mine["score"].to_numpy(), scores[q][order], atol=1e-7)
    assert cells[0] < 30 * 900 / 2


def test_topk_of_computed_vectors_computes_them_once(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_GROUP", 7)
    seen = spark.sparkContext.accumulator(0)

    def compute(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((200, 8)))]
    table = spark.createDataFrame(rows, "id long, values array<double>")
    queries = table.toDF("qid", "qvec")
    found = vector_topk(table.mapInArrow(compute, table.schema), queries, 3, "dot", max_broadcast_bytes=4096)
    whole = np.array([v for _, v in rows])
    scores = whole @ whole.T
    assert {(r.qid, r.id) for r in found.collect()} == {(q, int(i)) for q in range(200) for i in np.argsort(-scores[q])[:3]}
    assert seen.value == 200


def test_groups_of_queries_are_tasks_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERIES_PER_GROUP", 3)
    rows = [(i, [float(i), 1.0]) for i in range(60)]
    table = spark.createDataFrame(rows, "id long, values array<double>")
    asked = table.toDF("qid", "qvec").toArrow()
    schema = vectors.result_schema(table.schema["id"].dataType, table.schema["id"].dataType)
    assert vectors._scan_topk(table, asked, 2, "dot", schema).rdd.getNumPartitions() >= 20


def test_copies_at_no_distance_tie_by_id():
    rng = np.random.default_rng(7)
    rows = rng.standard_normal((9000, 64))
    rows[::50] = rows[3]
    found = vectors.Shortlist(rows[[3, 3]], 5, "euclidean", pa.int64())
    ids = rng.permutation(9000)
    found.add(pa.table({"id": pa.array(ids), "values": pa.array(rows.tolist(), pa.list_(pa.float64()))}))
    least = sorted([*ids[::50].tolist(), int(ids[3])])[:5]
    table = found.table(pa.array([0, 1]))
    assert table["id"].to_pylist() == [*least, *least] and set(table["score"].to_pylist()) == {0.0}


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
@pytest.mark.parametrize("planes", [1, 3])
def test_large_buckets_are_scanned(spark, monkeypatch, metric, planes):
    """The scan finds what the slots find, ids and queries that repeat included, and sends no vector to slots."""
    monkeypatch.setattr(vectors, "_SCAN_ROWS", 250)
    rng = np.random.default_rng(11)
    rows = rng.standard_normal((900, 8)).round(3)
    rows[100:300] = rows[:200]
    vdf = spark.createDataFrame([(f"v{i % 850:03d}", r.tolist()) for i, r in enumerate(rows)], "id string, values array<double>").repartition(2)
    qdf = spark.createDataFrame([(i % 55, r.tolist()) for i, r in enumerate(rows[80:140])], "qid long, qvec array<double>")
    index = LshIndex(dims=8, tables=4, planes=planes, probes=1)
    few = [index.topk(index.index(vdf), qdf, 7, metric, queries_per_slot=10, scan_share=s) for s in (0, 1e9)]
    assert sorted(few[0].collect()) == sorted(few[1].collect()) and few[0].count() == 55 * 7
    monkeypatch.setattr(vectors, "_slot_topk", None)
    again = index.topk(index.index(vdf), qdf, 7, metric, queries_per_slot=10)
    assert sorted(again.collect()) == sorted(few[0].collect())


def test_few_cells_are_scored_in_full(monkeypatch):
    """Of a block, about k cells of a query, and of a sparse query only the components that it has."""
    rng = np.random.default_rng(13)
    rows, queries = rng.random((6000, 384)), np.zeros((40, 384))
    for q in queries:
        q[rng.integers(0, 384, 9)] = rng.random(9) + 0.1
    queries[7, :60] = 1                                             # a wide one among them
    widths, whole = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda spec, a, b: (widths.append(a.shape), whole(spec, a, b))[1])
    found = vectors.Shortlist(queries, 10, "dot", pa.string())
    ids = [f"v{i:05d}" for i in rng.permutation(6000)]
    found.add(pa.table({"id": ids, "values": pa.array(rows.tolist(), pa.list_(pa.float32()))}))
    table, scores = found.table(pa.array(np.arange(40))), np.round(queries @ rows.astype(np.float32).astype(float).T, 9)
    for q in range(40):
        order = np.lexsort((ids, -scores[q]))[:10]
        assert table.filter(pa.array(table["qid"].to_numpy() == q))["id"].to_pylist() == [ids[i] for i in order]
    assert sum(n for n, _ in widths) <= 40 * 10 * 5 and sum(n * w for n, w in widths) < 40 * 10 * 5 * 60


@pytest.mark.parametrize("kind", ["float", "double"])
def test_packed_vectors_come_back(spark, kind):
    rng = np.random.default_rng(14)
    rows = [(f"v{i}", r.tolist()) for i, r in enumerate(rng.standard_normal((20, 3)))]
    table = spark.createDataFrame(rows, f"id string, values array<{kind}>")
    batch = vectors.packed(table).toArrow().combine_chunks().to_batches()[0].slice(4, 9)
    got = vectors._unpacked(batch, vectors._kind(table)).to_pydict()
    want = {r.id: list(r["values"]) for r in table.collect()}
    assert got["values"] == [want[i] for i in got["id"]] and len(got["id"]) == 9
    assert vectors.packed(table.limit(0)).count() == 0
