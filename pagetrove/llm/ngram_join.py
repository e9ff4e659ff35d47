"""Near-duplicate join: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. One pass over the texts gives narrow rows: a 128-bit hash of the word sequence and the MinHash
   band hashes. Texts of one word sequence form a class with a number of its own, and a text of its
   least id speaks for it, so copies cost one row each from here on.
2. Band and row counts are chosen for a target recall at the threshold. Representatives meet by
   band hash. A bucket is not expanded into pairs: each member is put with the bucket's leader
   (its least class), which is one row per member, and a member has few distinct leaders.
3. Members fetch their full shingle sets, and each leader's group is verified exactly, in blocks:
   large groups are cut into blocks and each pair of blocks is one task's work, so a group of any
   size meets no single task, and what leaves the task is a count per member and a spanning
   forest, not pairs. A pair that shares several leaders counts under the least of them.
4. Forests become classes by label propagation with pointer jumping on written tables.

Defined results: words are runs of anything but ASCII white space; a text of fewer than five
words has its word sequence as its only shingle; null and empty texts have the empty sequence and
are copies of one another. ``n_links`` counts classes of other word sequences at or above the
threshold, alike for all copies. ``class_id`` is the least id of a class. Classes hold texts, so an id
with several texts may be in several. A null id takes part as an id of its own below all others.
Rows repeated in full give one row each. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.session import write_scratch

from .common import map_batches, slices, worker_cache

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.999
MAX_HASHES = 128
BLOCK = 256  # members that are verified against as many others at a time
MAX_BITS = 28  # of a bitmap's places
_MOST_CACHED = 250_000  # words, about 32 MB


def bands_for(threshold: float, recall: float, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, hence fewest false candidates, that reach the recall."""
    best = (max_hashes, 1)
    for rows in range(1, max_hashes + 1):
        missed = 1 - threshold ** rows
        bands = 1 if missed <= 0 else math.ceil(math.log(1 - recall) / math.log(missed))
        if bands * rows > max_hashes:
            break
        best = (bands, rows)
    return best


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, width: int = SHINGLE) -> tuple[np.ndarray, bytes]:
    """Hashes of the text's shingles in order, with repeats, and the hash of its word sequence."""
    words = (text or "").encode().split()
    known = worker_cache("shingles")
    try:
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    except KeyError:
        if len(known) > _MOST_CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    whole = xxhash.xxh3_128_digest(b" ".join(words))
    if len(h) < width:
        return (np.array([xxhash.xxh3_64_intdigest(whole)], np.uint64) if len(h) else h), whole
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out = _mix(out) + h[k:k + n]
    return _mix(out), whole


def sketch(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(doc_id, mark, class_hash, n, bands): one narrow row per document; ``mark`` tells texts of one id apart."""
    draw = np.random.default_rng(20240511)
    factors = draw.integers(0, 2 ** 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def each(batch: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        sizes = np.array([len(s) for s, _ in found])
        full = np.flatnonzero(sizes)
        mins = np.zeros((bands, len(found)), np.uint64)
        if len(full):
            flat = np.concatenate([found[i][0] for i in full])
            at = np.r_[0, np.cumsum(sizes[full])[:-1]]
            for b in range(bands):
                key = np.full(len(full), b, np.uint64)
                for r in range(rows):
                    x = flat * factors[b * rows + r]
                    x ^= x >> np.uint64(32)
                    key = _mix(key) + np.minimum.reduceat(x * factors[b * rows + r], at)
                mins[b, full] = _mix(key)
        keys = pa.array(mins.T.reshape(-1).view(np.int64))
        ends = pa.array(np.arange(len(found) + 1, dtype=np.int32) * bands)
        return {"doc_id": batch.column("doc_id"), "mark": batch.column("mark"), "class_hash": [w for _, w in found],
                "n": sizes, "bands": pa.ListArray.from_arrays(ends, keys)}

    text = F.col("text").cast("string")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("mark"))
    return map_batches(narrow, "doc_id long, mark long, class_hash binary, n int, bands array<long>", each)


def may_hold(keys: DataFrame) -> Callable[..., Column]:
    """A test of columns like those of ``keys``: false only for what is not among them.

    The keys become a bitmap of about 16 places each, up to 32 MB of them; then more others pass. So the
    texts that a join by these keys can't concern needn't be shuffled for it, however many keys there are.
    """
    bits = min(MAX_BITS, max(10, (16 * keys.count()).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(*keys.columns), 64 - bits)
    marked = keys.select(place.alias("place")).selectExpr(
        "shiftright(place, 6) as slot", "shiftleft(1L, cast(place & 63 as int)) as mark").groupBy("slot").agg(F.bit_or("mark").alias("mark")).toArrow()
    marks = np.zeros(1 << (bits - 6), np.uint64)
    marks[marked["slot"].to_numpy()] = marked["mark"].to_numpy().view(np.uint64)
    sent = keys.sparkSession.sparkContext.broadcast(marks)

    @F.arrow_udf(T.BooleanType())
    def held(hashes: pa.Array) -> pa.Array:
        at = hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array((sent.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1)

    return lambda *columns: held(F.xxhash64(*columns))


def leader_groups(reps: DataFrame) -> DataFrame:
    """(leader, member): each class with the least class of each of its buckets, buckets of one left out."""
    keyed = reps.filter("n > 0").select("class", F.posexplode("bands").alias("band", "key"))
    leaders = keyed.groupBy("band", "key").agg(F.min("class").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    return keyed.join(leaders, ["band", "key"]).select("leader", F.col("class").alias("member")).distinct()


def verify(groups: DataFrame, classes: DataFrame, texts: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """Edges and counts of the groups: (id, to, links), numbers of classes.

    Rows with ``to`` are edges of a spanning forest; rows with ``links`` are counts to be summed.
    """
    of_member = groups.groupBy("member").agg(F.sort_array(F.collect_set("leader")).alias("leaders"))
    sized = groups.groupBy("leader").agg(F.count("*").alias("members"))
    speakers = write_scratch(
        classes.join(of_member, F.col("class") == F.col("member"), "left_semi").select(F.col("class").alias("member"), "id", "class_hash"),
        "speakers")
    # The ids alone meet the texts, and only texts that they may concern. An id may have several texts, and a
    # text several rows, so sets are named by their words from here on.
    wanted = write_scratch(speakers.select("id").distinct(), "wanted")
    concerned = texts.filter(may_hold(wanted)(F.col("id")))
    sets = shingle_sets(concerned.join(wanted, "id", "left_semi")).groupBy("class_hash").agg(F.first("shingles").alias("shingles"))
    named = groups.join(sized, "leader").join(of_member, "member").join(speakers.select("member", "class_hash"), "member")
    rows = named.join(sets, "class_hash")
    blocks = F.ceil(F.col("members") / block).cast("int")
    own = F.pmod(F.xxhash64("member"), F.greatest(blocks, F.lit(1))).cast("int")
    rows = rows.select("leader", "member", "leaders", "shingles", blocks.alias("blocks"), own.alias("own"))
    other = F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1))
    rows = rows.withColumn("other", other)
    rows = rows.select(
        "leader", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "member", "leaders", "shingles")
    # Groups are small as a rule, so a task takes many: they are sorted together and cut in Python.
    dealt = rows.repartition("leader", "a", "b").sortWithinPartitions("leader", "a", "b", "member")
    return dealt.mapInArrow(lambda batches: _verify_sorted(batches, threshold), "id long, to long, links long")


def shingle_sets(texts: DataFrame) -> DataFrame:
    def each(batch: pa.RecordBatch) -> dict:
        found = [shingles(t) for t in batch.column("text").to_pylist()]
        sets = [np.unique(s) for s, _ in found]
        ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
        return {"class_hash": [w for _, w in found], "shingles": pa.ListArray.from_arrays(ends, pa.array(flat))}

    return map_batches(texts.select("text"), "class_hash binary, shingles array<long>", each)


def _verify_sorted(batches, threshold):
    schema = pa.schema([("id", pa.int64()), ("to", pa.int64()), ("links", pa.int64())])
    key, held = None, []
    for batch in batches:
        for part in slices(batch):
            columns = [part.column(c).to_numpy(zero_copy_only=False) for c in ("leader", "a", "b", "own", "member")]
            leaders, sets = part.column("leaders"), part.column("shingles")
            for i in range(part.num_rows):
                k = (columns[0][i], columns[1][i], columns[2][i])
                if k != key:
                    if len(held) > 1:
                        yield _emit(held, key, threshold, schema)
                    key, held = k, []
                held.append((columns[3][i], columns[4][i], leaders[i].values.to_numpy(), sets[i].values.to_numpy()))
    if len(held) > 1:
        yield _emit(held, key, threshold, schema)


def _emit(held, key, threshold, schema):
    leader, a, b = key
    ids = np.array([m for _, m, _, _ in held])
    side = np.array([o for o, _, _, _ in held])
    linked = similar([s for _, _, _, s in held], threshold)
    if a != b:
        linked &= side[:, None] != side[None, :]
    np.fill_diagonal(linked, False)
    for i, j in zip(*np.nonzero(np.triu(linked))):  # another group counts it
        x, y = held[i][2], held[j][2]
        if len(x) > 1 and len(y) > 1 and np.intersect1d(x, y, assume_unique=True)[0] != leader:
            linked[i, j] = linked[j, i] = False
    links = linked.sum(1)
    edges, root = [], list(range(len(ids)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in np.flatnonzero(links):
        for j in np.flatnonzero(linked[i, i + 1:]) + i + 1:
            x, y = find(i), find(j)
            if x != y:
                root[max(x, y)] = min(x, y)
                edges.append((ids[i], ids[j]))
    full = np.flatnonzero(links)
    ids_out = [*ids[full], *[e[0] for e in edges]]
    return pa.RecordBatch.from_arrays([
        pa.array(ids_out, pa.int64()), pa.array([None] * len(full) + [e[1] for e in edges], pa.int64()),
        pa.array([*links[full], *[None] * len(edges)], pa.int64())], schema=schema)


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets reach the similarity, from exact common counts.

    Only shingles that two sets hold matter; a 0/1 matrix of those is multiplied with itself, in
    strips of shingles.
    """
    m, sizes = len(sets), np.array([len(s) for s in sets], float)
    flat = np.concatenate(sets)
    row = np.repeat(np.arange(m), sizes.astype(int))
    _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    row, column = row[shared], column[shared]
    _, column = np.unique(column, return_inverse=True)
    common = np.zeros((m, m))
    width = max(1, (4 << 20) // m)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for k in range(len(cuts) - 1):
        part = slice(cuts[k], cuts[k + 1])
        if cuts[k] == cuts[k + 1]:
            continue
        strip = np.zeros((m, width), np.float32)
        strip[row[part], column[part] - k * width] = 1
        common += strip @ strip.T
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union


def components(edges: DataFrame) -> DataFrame:
    """(id, label): the least id of the component, for ids with edges (a, b).

    Each round a vertex takes the least label among its own and its neighbours', then the label
    of its label; rounds end when no label changes. Tables are written in the shared folder.
    """
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    both = write_scratch(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = write_scratch(
        both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("near")).select("id", F.least("id", "near").alias("label")), "labels")
    while True:
        near = both.join(label, both.y == label.id).groupBy("x").agg(F.min("label").alias("near"))
        step = label.join(near, label.id == near.x).select("id", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = label.select(F.col("id").alias("up"), F.col("label").alias("of_up"))
        step = step.join(up, step.label == up.up, "left")
        step = write_scratch(step.select("id", "was", F.least("label", "of_up").alias("label")), "labels")
        label = step.select("id", "label")
        if step.filter("was <> label").isEmpty():
            return label


LOW = -(1 << 63)  # stands for a null id among ids


def classified(docs: DataFrame, threshold: float, recall: float) -> DataFrame:
    """(id, mark, class_hash, class_id, speaks, n_links, n_copies) of each document.

    The text that speaks for a class of near duplicates has the least id of it, and of that id's
    texts in the class the one of the least hash.
    """
    bands, rows = bands_for(threshold, recall)
    known = write_scratch(sketch(docs, bands, rows).withColumn("id", F.coalesce("doc_id", F.lit(LOW))), "sketch")
    classes = known.groupBy("class_hash").agg(
        F.min("id").alias("id"), F.count("*").alias("n_copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = write_scratch(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    groups = write_scratch(leader_groups(classes), "groups")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"), F.col("text").cast("string").alias("text"))
    found = write_scratch(verify(groups, classes, texts.filter(F.col("text").isNotNull()), threshold), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("n_links")).withColumnRenamed("id", "class")
    label = components(found.filter("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b")))
    linked = classes.select("class", "class_hash", "id").join(label.withColumnRenamed("id", "class"), "class")
    speakers = linked.groupBy("label").agg(F.min(F.struct("id", "class_hash")).alias("speaker"))
    speakers = linked.join(speakers, "label").select("class", "speaker")
    own = F.struct("id", "class_hash")
    of_class = classes.select("class", "class_hash", "n_copies", own.alias("own")).join(links, "class", "left").join(
        speakers, "class", "left").select(
        "class_hash", F.coalesce("speaker", "own").alias("speaker"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    out = known.select("id", "mark", "class_hash").join(of_class, "class_hash")
    return out.select(
        "id", "mark", "class_hash", F.col("speaker")["id"].alias("class_id"), (own == F.col("speaker")).alias("speaks"), "n_links", "n_copies")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its near-duplicate class), n_links, n_copies.

    ``n_copies`` is the number of documents of the same word sequence.
    """
    def shown(column: str):
        return F.when(F.col(column) != LOW, F.col(column))

    return classified(docs, threshold, recall).select(
        shown("id").alias("doc_id"), shown("class_id").alias("class_id"), "n_links", "n_copies")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents that speak for their class, with all columns. A repeated row stays repeated."""
    gone = classified(docs, threshold, recall).filter(~F.col("speaks")).select(
        F.col("id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    gone = write_scratch(gone, "gone")
    own_id, own_mark = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)), F.xxhash64(F.col("text").cast("string"))
    told = docs.withColumn("may_be_gone", may_hold(gone)(own_id, own_mark))
    maybe = told.filter("may_be_gone").join(gone, (own_id == gone.gone_id) & (own_mark == gone.gone_mark), "left_anti")
    return told.filter("not may_be_gone").unionByName(maybe).drop("may_be_gone")
