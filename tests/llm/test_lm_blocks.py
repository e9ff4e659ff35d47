"""What the language model sends about: n-grams as sorted numbers in few rows, and texts as blocks of numbers."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pagetrove.llm import lm_scoring as lm
from pagetrove.session import write_scratch


def test_tokens_are_those_of_split():
    texts = [None, "", "  \t ", "A b\x1cc  \x0bd\x85e f İK a", "x", " x\n"]
    words, tokens = lm.tokenized(pa.array(texts))
    got, text = [], []
    for t in tokens.tolist():
        if t:
            text.append(words[t - 1])
        else:
            got.append(text)
            text = []
    assert got == [[b"", *lm.split(x), b""] for x in texts]


def test_numbers_come_back():
    for values in ([], [0], [5, 300, 70_000, 1 << 59]):
        assert lm.unpack(lm.pack(np.array(values, np.int64))).tolist() == values
    words = [b"w%d" % i for i in range(100_000)]
    coder = lm.Coder(words, np.ones(len(words), int), {w: i for i, w in enumerate(words)}, lm.hashes(words), 90_000)
    grams = ["w89999 w89998", "w5 w89999 w7", "w5 w90000", "q w1", "w1", " w1", "w3 w4 q"]
    codes = coder.codes(pa.array(grams))
    assert codes.tolist() == [coder.code(g.encode()) for g in grams]
    assert (codes >= 0).tolist() == [True, True] + [False] * 5
    assert coder.gram(codes[:1], 2) == [b"w89999 w89998"] and coder.gram(codes[1:2] - 90_000 ** 2, 3) == [b"w5 w89999 w7"]


def test_few_rows_of_few_bytes_are_shuffled(spark):
    """An n-gram was a row of text, and each of a document's n-grams one more."""
    rows = [(i, " ".join(f"word{(i * j * j) % 97}" for j in range(400))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    found = lm.score(docs, config=lm.LmConfig(arc_share=0.5))
    assert found.count() == 300
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "codes#" in plan
    blocks = lm.blocks(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.lit(True).alias("train"), "text"))
    counts = lm.count_words(blocks)
    n = sum(r.c for r in counts.collect())
    coder = lm.coder(counts, n, lm.LmConfig())
    t = lm.Texts(coder, blocks.collect()[0].asDict())
    ok = (t.a[:-1] >= 0) & (t.a[1:] >= 0)
    codes, seen = np.unique(t.codes(ok, 2)[1], return_counts=True)
    assert seen.sum() == n and len(lm.pack(np.diff(codes, prepend=0))) < 3 * len(codes) + 9


def test_traversal_of_arrays_is_that_of_the_automaton(spark, edge_docs):
    train = lm.narrow(edge_docs)
    counts = lm.count_words(train)
    n = sum(r.c for r in counts.collect())
    model = lm.build(train, counts, n, counts.count(), 0.5, lm.LmConfig(root_share=0, arc_share=0, least_count=1))
    rng = np.random.default_rng(0)
    words, want = [], []
    known = list(model.words)
    for text in [lm.split(r.text) for r in edge_docs.collect()] + [[known[i] for i in rng.integers(0, len(known), 30)] for _ in range(20)]:
        text = [w if rng.random() < 0.9 else b"not a word" for w in text[:200]] + [lm.END]
        state, total = model.start, 0.0
        words.append(model.words[lm.END])
        for w in text:
            at = model.words.get(w, -1)
            words.append(at)
            while state and (at < 0 or state * len(model.words) + at not in model.arcs):
                total += model.backoff[state]
                state = model.fail[state]
            if at >= 0:
                weight, state = model.arcs[state * len(model.words) + at]
                total += weight
        words.append(-2)
        want.append(total)
    words = np.array(words)
    got = np.add.reduceat(lm.traverse(lm.walk(model), words), np.concatenate([[0], np.flatnonzero(words == -2)[:-1] + 1]))
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(got, want)) and len(got) == len(want)


def test_shuffles_of_a_scratch_table_leave_the_disk(spark):
    shuffles = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    spark.sparkContext._jvm.System.gc()
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    first = spark.sparkContext._jsc.sc().newShuffleId()
    written = write_scratch(spark.range(1000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count(), "test")
    last = spark.sparkContext._jsc.sc().newShuffleId()
    assert last > first + 1 and not any(shuffles.containsShuffle(i) for i in range(first, last))
    assert written.count() == 7 and spark.conf.get(key) == before


def test_runs_do_not_change_what_is_found(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.5, size)) for size in (0, 1, 2, 300, 7, 40, 0)]
    words, tokens = lm.tokenized(pa.array(texts))
    common = words[:20]
    coder = lm.Coder(common, np.ones(20, int), {w: i for i, w in enumerate(common)}, lm.hashes(common), 15)
    block = {"words": lm.lines(words), "tokens": lm.pack(tokens), "texts": lm.to_bytes(pa.table({"train": [True] * len(texts)}))}
    marks = [lm.Bitmap(0, 12, rng.integers(0, 1 << 63, 64, dtype=np.uint64)) for _ in range(2)]

    def found():
        t = lm.Texts(coder, block)
        two, three = t.held(*marks)
        return [two, three, *t.codes(two, 2), *t.codes(three, 3)]

    whole = found()
    assert whole[0].any() and whole[1].any() and len(whole[2]) and len(whole[4])
    for run in (1, 50):
        monkeypatch.setattr(lm, "RUN", run)
        assert all((a == b).all() for a, b in zip(whole, found()))
