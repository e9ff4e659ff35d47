"""Token counts, hard negatives and centroid clusters against the public library, SQL and plain Python."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
import sentencepiece

from pagetrove.llm import centroids, hard_negatives, queries, sql, token_counts
from pagetrove.llm.common import documents

from .conftest import ROWS

MODEL = token_counts.default_model()
TABLE = token_counts.compile_merges(MODEL)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
EXTRA = "row string, x string, label2 string, cluster string, distance string, query string, anchor string, score string, id string, key string, rank string"


def library_counts(texts):
    return [len(t) for t in LIBRARY.encode([t or "" for t in texts], num_threads=1)]


def test_counts_equal_the_library(spark, sf_small):
    texts = {r.doc_id: r.text for r in documents(spark, sf_small).collect()}
    got = queries.op11_token_counts(spark, sf_small).collect()
    want = dict(zip(texts, library_counts(texts.values())))
    assert {r.doc_id: r.n_tokens for r in got} == want
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 4096) for r in got)


def test_counts_of_odd_texts():
    pick = random.Random(1)
    parts = [" ", "  ", "    ", "a", "b", "the", "ing", "▁", "\n", "\t", "\0", "é", "漢", "字", "😀", "<s>", "</s>", "<0x0A>", "==", "aaaa", "_"]
    texts = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 120))) for _ in range(3000)]
    texts += [c * n for c in (" ", "a", "ab", "=", "\n", "é") for n in (1, 2, 3, 7, 63, 64, 65, 200, 5000)] + [None, ""]
    texts.append("".join(pick.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)))
    assert token_counts.Counter(TABLE).count(texts)[1].tolist() == library_counts(texts)


def test_blocks_do_not_change_counts(monkeypatch):
    pick = random.Random(2)
    text = "".join(pick.choice(["word ", "x", "  ", "漢字", "été ", "1234 "]) for _ in range(5000))
    want = library_counts([text])
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", 500)
    monkeypatch.setattr(token_counts, "CACHE_BYTES", 1000)
    assert token_counts.Counter(TABLE).count([text, None, text])[1].tolist() == [*want, 0, *want]


def test_joins_that_make_equal_ranks():
    # joining both pairs "ab" at once would leave "ab" and "aba"; "aba" merges before the second "ab", which leaves three
    table = token_counts.merge_table({"a": -90.0, "b": -91.0, "ab": -5.0, "aba": -1.0}, prefix=False)
    symbols = table.char_ids[[ord(c) for c in "ababa"]]
    starts = np.array([0])
    assert token_counts.merged_together(table, symbols, starts).tolist() == [token_counts.merged_one_by_one(table, symbols)] == [3]


def test_token_counts_edges(edge_docs, no_docs):
    rows = token_counts.count(edge_docs, TABLE).collect()
    want = sorted(((r[0] is None, r[0] or 0), n) for r, n in zip(ROWS, library_counts([r[1] for r in ROWS])))
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.n_tokens) for r in rows) == want
    assert token_counts.count(no_docs, TABLE).count() == 0
    assert {r.over_limit for r in token_counts.count(edge_docs, TABLE, 10).filter("doc_id = 13").collect()} == {True}


def vectors_frame(spark, rows):
    width = len(EXTRA.split(","))
    full = [(i, v, label, *(["x"] * width)) for i, v, label in rows]
    return spark.createDataFrame(full, f"vec_id long, embedding array<float>, label int, {EXTRA}").repartition(3)


def made_vectors(n, width=64, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(5, width)) / 8
    rows = [(i, (centre[i % 5] + rng.normal(size=width) / 10).astype(np.float32).tolist(), int(rng.integers(0, 3))) for i in range(n)]
    rows += [(7, rows[7][1], rows[7][2]), (None, rows[3][1], 1), (200, rows[200][1], rows[200][2]),  # repeated rows, no id
             (n, None, 1), (n + 1, [float("nan")] * width, 1), (n + 2, [float("inf")] * width, 2),
             (n + 3, [None] * width, 0), (n + 4, [0.0] * width, 1), (n + 5, rows[5][1], None)]
    rows += [(1000 + i, rows[9][1], 2) for i in range(30)]   # ties
    return rows


def in_duckdb(statement, rows):
    import pyarrow as pa

    table = pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())),
                      "label": pa.array([r[2] for r in rows], pa.int32())})
    con = duckdb.connect()
    con.register("embeddings", table)
    rel = con.execute(statement)
    return [d[0] for d in rel.description], sorted(rel.fetchall(), key=repr)


@pytest.mark.parametrize("anchor_bytes", [hard_negatives.ANCHOR_BYTES, 900])
def test_hard_negatives_equal_sql(spark, anchor_bytes):
    rows = made_vectors(420) + [(2000, [0.5] * 30, 1), (2001, [], 1)]   # other lengths
    got = hard_negatives.mine(vectors_frame(spark, rows), hard_negatives.MiningConfig(anchor_bytes=anchor_bytes))
    names, want = in_duckdb(sql.OP12, rows)
    assert got.columns == names and len(want) > 30
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(vectors_frame(spark, [])).count() == 0
    assert hard_negatives.mine(vectors_frame(spark, [(1, [0.1, 0.2], 1), (None, [0.3], 2)])).count() == 0


@pytest.mark.parametrize("least, most", [(-300, 280), (-1, 0), (0, 0), (-2**20, 2**20)])
def test_table_scores_are_inner_products(least, most):
    rng = np.random.default_rng(5)
    a, c = rng.integers(least, most + 1, (2, 200, 24))
    shape = hard_negatives.Shape(21, least, most)
    assert shape.width == 24
    got = hard_negatives.scores(hard_negatives.subset_sums(a, shape.kind), hard_negatives.bit_planes(c, shape.planes))
    assert (got == c @ a.T).all()
    with pytest.raises(ValueError):
        hard_negatives.Shape(64, 0, 1 << 30)


def test_clusters_equal_sql(spark):
    rows = made_vectors(300) + [(2000, [0.5] * 30, 1), (2001, [], 1), (2002, [0.5] * 65, 1)]
    got = centroids.cluster(vectors_frame(spark, rows))
    names, want = in_duckdb(sql.op13(), rows)
    assert got.columns == names and len(want) == 300 + 4 + 1 + 30
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(3)]
    got = centroids.cluster(vectors_frame(spark, rows)).collect()
    assert len(got) == 3 and {r.inertia for r in got} == {0} and len({r.cluster for r in got}) == 2
    digest = hashlib.sha256(",".join(["1024"] * 64).encode()).hexdigest()
    assert next(r for r in got if r.vec_id == 1).centroid_sha256 == digest
    assert centroids.cluster(vectors_frame(spark, [])).count() == 0
    with pytest.raises(Exception, match="below"):
        centroids.cluster(vectors_frame(spark, [(1, [1e9] * 64, 0)])).count()


@pytest.mark.parametrize("size", [1, 3, 200])
def test_search_is_exact(size):
    rng = np.random.default_rng(size)
    centres = rng.integers(-40, 40, (size, 16))
    centres[size // 2] = centres[0]                     # equal centroids: the smaller number wins
    centres[-1] = -centres[0]
    rows = np.concatenate([rng.integers(-60, 60, (500, 16)), centres, np.full((1, 16), centroids.LARGEST - 1)])
    near = centroids.NearestCentroid(centres)
    number, distance = near.search(rows)
    full = ((rows[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (distance == full.min(axis=1)).all() and (number == full.argmin(axis=1)).all()
    if size == 200:
        assert near.finished < 0.9 * full.size          # the inequalities spare work


def test_queries_equal_sql(spark, sf_small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_small}/embeddings.parquet'")
    for name in ("op12_hard_negatives", "op13_centroid_clusters"):
        got = queries.registry()[name](spark, sf_small)
        rel = con.execute(sql.statements()[name])
        assert got.columns == [d[0] for d in rel.description]
        assert sorted(map(tuple, got.collect())) == sorted(rel.fetchall())
