"""Vector top-k: exact, and approximate through locality-sensitive hashing.

Scores are computed as blocked matrix products inside Arrow batches, and each task keeps
only the best k per query before anything is shuffled. No query-vector pair is ever a row.

* Exact: the queries' matrix is broadcast in blocks of a bounded size, and the vector table is
  scanned for one block after the other; it is never shuffled. Each task scans a part of the table
  for a group of a block's queries, and there are only as many parts as keep all slots busy, so that
  what is shuffled grows with the queries and not with queries x tasks. If there are several
  blocks or groups, the table is written once, so that vectors that are computed are computed once,
  with the numbers of a vector as bytes, which Spark passes on to the tasks as they are.
* Approximate: both sides are cut into slots by a hash of their id inside the hash buckets that
  queries fall into. A bucket that holds a large share of all vectors is cut into as many slots as
  its count asks for. Each slot of vectors meets each slot of queries, so where buckets are that large
  and the candidates a large share of all pairs, the table is scanned as above and a match counts
  where it has a bucket of the query.

``operators.vector_lists`` searches vectors that were clustered beforehand.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.session import ship_package, write_scratch

MAX_BROADCAST_BYTES = 64 << 20
VECTORS_PER_SLOT = 50_000
QUERIES_PER_SLOT = 2_048
QUERIES_PER_GROUP = 4_096
_QUERY_STEP, _SPARSE_STEP = 256, 8
_SCAN_ROWS = 20_000
_SPARSE, _COLUMNS = 16, 2_048   # products of a few rows by so many columns stay in a core's cache
_CELL_NUMBERS = 1 << 16   # compared in full at once, few enough for a core's cache
SCAN_SHARE = 0.25         # of all pairs that are candidates, from which large buckets are scanned


def as_numbers(column: pa.Array | pa.ChunkedArray, kind: type = np.float64) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.unique(pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False))
    if len(sizes) > 1 or (len(sizes) and sizes[0] < 1):
        raise ValueError(f"vectors of different or no lengths: {sizes.tolist()}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def as_matrix(column: pa.Array | pa.ChunkedArray, metric: str) -> np.ndarray:
    rows = as_numbers(column)
    if metric == "cosine":
        norms = np.linalg.norm(rows, axis=1, keepdims=True)
        rows = np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)
    return rows


def closeness(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """Larger is closer; rounded to 12 digits so that equal inputs tie whatever the order of additions."""
    products = queries @ vectors.T
    if metric == "euclidean":
        squares = (queries * queries).sum(axis=1)[:, None] + (vectors * vectors).sum(axis=1)[None, :]
        products = _distance(squares, products)
    return np.round(products, 12) + 0.0


def _distance(squares: np.ndarray, products: np.ndarray) -> np.ndarray:
    """Less the distance; 0 for what only the rounding of the sums tells apart, so that copies tie."""
    gap = squares - 2 * products
    return -np.sqrt(np.where(gap > 1e-14 * squares, gap, 0))


def _best(scores: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k best cells, none below the row's floor.

    Columns are in id order, so on a tie the leftmost cells win.
    """
    if scores.shape[1] > k:
        kth = np.partition(scores, -k, axis=1)[:, -k]
        floor = np.maximum(floor, kth)
        above = scores > floor[:, None]
        level = scores == floor[:, None]
        room = np.maximum(k - above.sum(axis=1), 0)
        keep = above | (level & (np.cumsum(level, axis=1) <= room[:, None]))
    else:
        keep = scores >= floor[:, None]
    return np.nonzero(keep)


def pair_closeness(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    """``closeness`` of each query to the vector in the same row."""
    products = np.einsum("ij,ij->i", queries, vectors)
    if metric == "euclidean":
        squares = (queries * queries).sum(axis=1) + (vectors * vectors).sum(axis=1)
        products = _distance(squares, products)
    return np.round(products, 12) + 0.0


class _Rough:
    """Rows in single precision, so that most cells are ruled out by one product and one comparison.

    ``rows @ other.T`` orders the cells of a query as closeness does, but for ``margin``: for distances,
    half of a vector's square is taken off the product. ``usable`` is false where single precision
    can't hold the numbers. Queries with few components that are not zero, such as hashed words of a
    short text, are multiplied by those alone: a few queries at a time, by all components that any of
    them has. ``place`` puts queries with the same common components beside each other.
    """

    def __init__(self, matrix: np.ndarray, metric: str, query: bool):
        self.squares = (matrix * matrix).sum(axis=1)
        if metric == "euclidean":
            matrix = np.column_stack([matrix, np.ones(len(matrix)) if query else -self.squares / 2])
        self.rows = matrix.astype(np.float32) if len(matrix) and np.abs(matrix).max() < 1e15 else None
        self.usable = self.rows is not None
        self.lengths = np.sqrt((matrix * matrix).sum(axis=1)) if self.usable else None
        self.sparse, self.place = False, None
        if self.usable and query and np.count_nonzero(self.rows) * _SPARSE <= self.rows.size:
            self.sparse = True
            some = self.rows != 0
            bits = np.packbits(some[:, np.argsort(-some.sum(axis=0), kind="stable")], axis=1)
            self.place = np.empty(len(bits), np.int64)
            self.place[np.lexsort(bits.T[::-1])] = np.arange(len(bits))
        self.turned: list[np.ndarray] = []

    def products(self, part: np.ndarray, vectors: "_Rough") -> np.ndarray:
        rows = self.rows[part]
        if not self.sparse:
            return rows @ vectors.rows.T
        if not vectors.turned:
            vectors.turned = [np.ascontiguousarray(vectors.rows[i:i + _COLUMNS].T) for i in range(0, len(vectors.rows), _COLUMNS)]
        used = np.flatnonzero(rows.any(axis=0))
        rows, out = np.ascontiguousarray(rows[:, used]), np.empty((len(part), len(vectors.rows)), np.float32)
        room = np.empty(len(used) * _COLUMNS, np.float32)
        for i, columns in enumerate(vectors.turned):
            held = room[:len(used) * columns.shape[1]].reshape(len(used), -1)
            columns.take(used, axis=0, out=held, mode="clip")
            out[:, i * _COLUMNS:i * _COLUMNS + columns.shape[1]] = rows @ held
        return out

    def margins(self, part: np.ndarray, vectors: "_Rough") -> np.ndarray:
        """How far the product of a query with any of the vectors may be off."""
        error = (self.rows.shape[1] + 4) * 2.0 ** -23
        return error * self.lengths[part] * vectors.lengths.max() + 1e-12 * (self.squares[part] + vectors.squares.max()) + 1e-30


class Shortlist:
    """Best k (score, id) per query over the vector blocks seen so far.

    With ``floors``, scores below a query's floor are of no use from the start. With ``buckets`` (query,
    table, bucket), only vectors that share one count, and an id counts once, by its best score.
    """

    def __init__(self, queries: np.ndarray, k: int, metric: str, id_type: pa.DataType, floors: np.ndarray | None = None,
                 buckets: np.ndarray | None = None):
        self.queries, self.k, self.metric, self.buckets = queries, k, metric, buckets
        self.floor = np.full(len(queries), -np.inf) if floors is None else floors.copy()
        self.q, self.score, self.ids = np.zeros(0, np.int64), np.zeros(0), pa.chunked_array([], id_type)
        # Query, score, and where the id is in the column of that number, of rows not merged yet.
        self.waiting, self.columns, self.held = [], [], 0
        self.rough = _Rough(queries, metric, query=True)
        self.cells = None           # components and numbers of sparse queries, as wide as the widest
        if self.rough.sparse and metric != "euclidean":
            some = queries != 0
            self.widths = some.sum(axis=1)
            at = np.argsort(~some, axis=1, kind="stable")[:, :self.widths.max(initial=1)]
            self.cells = at, np.take_along_axis(queries, at, axis=1)

    def add(self, block: pa.Table, only: np.ndarray | None = None) -> None:
        """Score a block against all queries, or those numbered in ``only``."""
        if self.buckets is None:
            order = pc.sort_indices(block["id"])
            self.add_rows(as_matrix(block["values"], self.metric)[order.to_numpy()], block["id"].take(order), only)
            return
        block = block.sort_by("id")
        # Rows of one id go into blocks of their own, so that the k best of a block are k ids.
        number = block["id"].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.zeros(0, int)
        nth = np.arange(len(number)) - np.repeat(starts, np.diff(np.r_[starts, len(number)]))
        for i in range(nth.max(initial=-1) + 1):
            rows = block.filter(pa.array(nth == i))
            codes = rows["buckets"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            self.add_rows(as_matrix(rows["values"], self.metric), rows["id"], only, codes)

    def add_rows(
        self, vectors: np.ndarray, ids: pa.ChunkedArray, only: np.ndarray | None = None, codes: np.ndarray | None = None,
    ) -> None:
        """The same for vectors in id order. Queries without a floor get one from a few rows first.
        ``codes`` are the vectors' buckets, one of each table."""
        only = np.arange(len(self.queries)) if only is None else only
        if self.rough.sparse:
            only = only[np.argsort(self.rough.place[only])]
        start, size = 0, max(1024, 16 * self.k + 1)
        while start + size < len(vectors) and np.isneginf(self.floor[only]).any() or 0 < start < len(vectors) - size:
            self._add_part(vectors[start:start + size], ids.slice(start, size), only, None if codes is None else codes[start:start + size])
            self.settle()
            start, size = start + size, 4 * size
        self._add_part(vectors[start:], ids.slice(start), only, None if codes is None else codes[start:])

    def _meet(self, part: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which queries (rows) share a bucket with which vectors (columns)."""
        out = np.zeros((len(part), len(codes)), bool)
        for table in range(codes.shape[1]):
            own = np.ascontiguousarray(codes[:, table])
            for bucket in self.buckets[part, table].T:
                out |= bucket[:, None] == own
        return out

    def _add_part(self, vectors: np.ndarray, ids: pa.ChunkedArray, only: np.ndarray, codes: np.ndarray | None) -> None:
        if vectors.shape[1] != self.queries.shape[1]:
            raise ValueError(f"vectors of different or no lengths: {vectors.shape[1]} and {self.queries.shape[1]}")
        rough, step = _Rough(vectors, self.metric, query=False), _SPARSE_STEP if self.rough.sparse else _QUERY_STEP
        self.columns.append(ids)
        for start in range(0, len(only), step):
            part = only[start:start + step]
            pays = len(vectors) > 4 * self.k or (len(part) and np.isfinite(self.floor[part]).all())
            if self.rough.usable and rough.usable and pays:
                part = self._add_near(part, vectors, rough, codes)
            if len(part):
                scores = closeness(self.queries[part], vectors, self.metric)
                self.push(part, scores if codes is None else np.where(self._meet(part, codes), scores, -np.inf))
        self.merge()

    def _add_near(self, part: np.ndarray, vectors: np.ndarray, rough: _Rough, codes: np.ndarray | None = None) -> np.ndarray:
        """Score in full only the cells that can reach the queries' floors and, of so many that it
        matters, their k best in this block. Returns the queries left over: those with very many equal cells."""
        products = self.rough.products(part, rough)
        margin = self.rough.margins(part, rough)
        least = self.floor[part] - 1e-11
        if self.metric == "euclidean":
            with np.errstate(over="ignore"):
                least = (self.rough.squares[part] - np.square(np.minimum(least, 0))) / 2
        least = least - margin
        keep = products >= least[:, None].astype(np.float32)

        if codes is not None:
            many = np.nonzero(np.count_nonzero(keep, axis=1) > 8 * self.k)[0]
            if len(many):
                keep[many] &= (meet := self._meet(part[many], codes))
                products[many] = np.where(meet, products[many], -np.inf)
        at = np.flatnonzero(keep)
        q = at // keep.shape[1]
        col, counts = at - q * keep.shape[1], np.bincount(q, minlength=len(part))
        # Without codes every kept cell counts, so that the k best bound the others from 5 k / 4 cells on.
        many = np.nonzero(counts > (8 * self.k if codes is not None else self.k + self.k // 4))[0]
        if len(many):
            near, stays, ends = products[q, col], np.ones(len(q), bool), np.cumsum(counts)
            for i in many.tolist():
                own = slice(ends[i] - counts[i], ends[i])
                kth = np.partition(near[own], -self.k)[-self.k]
                stays[own] = near[own] >= (kth - 2 * margin[i]).astype(np.float32)
            q, col = q[stays], col[stays]
            counts = np.bincount(q, minlength=len(part))
        left = counts > 16 * self.k
        if left.any():
            stays = ~left[q]
            q, col = q[stays], col[stays]
        if codes is not None:
            meet = (self.buckets[part[q]] == codes[col][:, :, None]).any(axis=(1, 2))
            q, col = q[meet], col[meet]
        scores = self._closeness(part[q], vectors, col)
        reach = scores >= self.floor[part[q]]
        self._hold(part[q[reach]], scores[reach], col[reach])
        return part[left]

    def _closeness(self, q: np.ndarray, vectors: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Full scores of cells; of sparse queries by the components that are not zero."""
        scores = np.empty(len(q))
        width = vectors.shape[1] if self.cells is None else self.widths[q].max(initial=1)
        step = max(1, _CELL_NUMBERS // width)
        for start in range(0, len(q), step):
            cells = slice(start, start + step)
            if self.cells is None:
                scores[cells] = pair_closeness(self.queries[q[cells]], vectors[col[cells]], self.metric)
            else:
                at, numbers = (x[q[cells], :width] for x in self.cells)
                scores[cells] = np.round(np.einsum("ij,ij->i", numbers, vectors[col[cells, None], at]), 12) + 0.0
        return scores

    def push(self, part: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some queries (rows) and vectors (columns, in id order)."""
        q, col = _best(scores, self.floor[part], self.k)
        if self.buckets is not None:
            meet = scores[q, col] > -np.inf
            q, col = q[meet], col[meet]
        self._hold(part[q], scores[q, col], col)

    def _hold(self, q: np.ndarray, scores: np.ndarray, col: np.ndarray) -> None:
        self.waiting.append((q, scores, col, len(self.columns) - 1))
        self.held += len(q)

    def merge(self) -> None:
        if self.held > max(len(self.q), _SCAN_ROWS):
            self.settle()

    def settle(self) -> None:
        starts = np.cumsum([len(self.ids), *map(len, self.columns)])
        q = np.concatenate([self.q, *[w[0] for w in self.waiting]])
        score = np.concatenate([self.score, *[w[1] for w in self.waiting]])
        at = np.concatenate([np.arange(len(self.ids)), *[w[2] + starts[w[3]] for w in self.waiting]])
        ids = pa.chunked_array([c for column in (self.ids, *self.columns) for c in column.chunks], self.ids.type)
        self.waiting, self.columns, self.held = [], [], 0
        if self.buckets is not None:
            found = pa.table({"q": q, "score": score, "id": ids.take(pa.array(at))})
            found = found.group_by(["q", "id"]).aggregate([("score", "max")])
            ids, at = found["id"], np.arange(len(found))
            q, score = found["q"].to_numpy(), found["score_max"].to_numpy()
        order = np.argsort(-score)
        order = order[np.argsort(q[order].astype(np.uint16 if len(self.queries) <= 1 << 16 else np.int64), kind="stable")]
        q, score, at = q[order], score[order], at[order]
        first = np.searchsorted(q, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(first) >= self.k)
        least = np.full(len(self.queries), -np.inf)
        least[full] = score[first[full] + self.k - 1]
        self.floor = np.maximum(self.floor, least)
        keep = score >= least[q]
        # Of rows that tie for a query's last places, those with the least ids stay.
        over = np.bincount(q[keep], minlength=len(self.queries)) > self.k
        tied = np.flatnonzero(over[q] & (score == least[q]))
        if len(tied):
            by_id = pc.sort_indices(pa.table({"q": q[tied], "id": ids.take(pa.array(at[tied]))}),
                                    sort_keys=[("q", "ascending"), ("id", "ascending")])
            tied = tied[by_id.to_numpy()]
            place = np.arange(len(tied)) - np.searchsorted(q[tied], q[tied])
            above = np.bincount(q[score > least[q]], minlength=len(self.queries))
            keep[tied] = place < self.k - above[q[tied]]
        self.q, self.score, self.ids = q[keep], score[keep], pa.chunked_array([ids.take(pa.array(at[keep])).combine_chunks()], ids.type)

    def table(self, qids: pa.Array) -> pa.Table:
        self.settle()
        rows = pa.table({"q": self.q, "id": self.ids, "score": self.score})
        rows = rows.sort_by([("q", "ascending"), ("score", "descending"), ("id", "ascending")])
        return pa.table({"qid": qids.take(rows["q"].combine_chunks()), "id": rows["id"], "score": rows["score"]})


def result_schema(id_type: T.DataType, qid_type: T.DataType) -> T.StructType:
    return T.StructType([
        T.StructField("qid", qid_type), T.StructField("id", id_type), T.StructField("score", T.DoubleType()),
    ])


def rank_matches(matches: DataFrame, k: int, metric: str, rounded: bool = True) -> DataFrame:
    """The first k rows of each query; ``rounded`` turns closeness into the score that users see."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    ranked = matches.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if not rounded:
        return ranked
    score = -F.col("score") if metric == "euclidean" else F.col("score")
    return ranked.withColumn("score", F.round(score, 6) + 0.0)


def query_blocks(queries: DataFrame, max_bytes: int, extra: int = 0) -> Iterator[pa.Table]:
    """The queries in blocks of at most about ``max_bytes``, brought to the driver one at a time.

    A query counts with its vector, the text of its id, and ``extra`` bytes.
    """
    queries = queries.select("qid", "qvec")
    n, dims, names = queries.agg(
        F.count("*"), F.max(F.size("qvec")), F.sum(F.length(F.col("qid").cast("string")))).first()
    blocks = math.ceil((n * ((dims or 0) * 8 + extra) + (names or 0)) / max(max_bytes, 1))
    if not n:
        return
    if blocks <= 1:
        yield queries.toArrow()
        return
    blocks = min(blocks * 2, n)  # a hash deals them out only about evenly
    dealt = write_scratch(queries.withColumn("block", F.pmod(F.xxhash64("qid"), F.lit(blocks))), "queries")
    for i in range(blocks):
        block = dealt.filter(F.col("block") == i).select("qid", "qvec").toArrow()
        if len(block):
            yield block


def in_turn(spark, blocks: Iterator[DataFrame], schema: T.StructType, k: int, metric: str) -> DataFrame:
    """Ranked matches of all blocks of queries. Of several blocks, each is worked off and written before the next is begun."""
    first = next(blocks, None)
    if first is None:
        return rank_matches(spark.createDataFrame([], schema), k, metric)
    done, found = [], rank_matches(first, k, metric)
    for block in blocks:
        done.append(write_scratch(found, "matches"))
        found = rank_matches(block, k, metric)
    if not done:
        return found
    return functools.reduce(DataFrame.unionByName, [*done, write_scratch(found, "matches")])


def scan_parts(slots: int, groups: int) -> int:
    """Parts of the table that each group of queries scans. Spark takes a union of tables with one
    part each as one task, so there are two at least."""
    return max(2, slots // groups)


def packed(vectors: DataFrame) -> DataFrame:
    """``id, values`` with the numbers of each vector as bytes, in the table's own precision."""
    kind = _kind(vectors)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                rows = as_numbers(batch.column("values"), kind)
                ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1] * rows.itemsize, pa.int32())
                cells = pa.Array.from_buffers(pa.binary(), len(rows), [None, ends.buffers()[1], pa.py_buffer(rows)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), cells], ["id", "values"])

    return vectors.mapInArrow(pack, T.StructType([vectors.schema["id"], T.StructField("values", T.BinaryType())]))


def _kind(vectors: DataFrame) -> type:
    return np.float32 if vectors.schema["values"].dataType.elementType == T.FloatType() else np.float64


def _unpacked(batch: pa.RecordBatch, kind: type) -> pa.RecordBatch:
    cells = batch.column("values")
    ends = np.frombuffer(cells.buffers()[1], np.int32)[cells.offset:cells.offset + len(cells) + 1]
    flat = np.frombuffer(cells.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind)
    lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]) // flat.itemsize, pa.int32()), pa.array(flat))
    return pa.RecordBatch.from_arrays([batch.column("id"), lists], ["id", "values"])


def _scan_topk(
    vectors: DataFrame, query_rows: pa.Table, k: int, metric: str, schema: T.StructType, index: LshIndex | None = None,
    kind: type | None = None,
) -> DataFrame:
    """Each task's best k rows of each query of its group; with an index, of those that share a bucket.
    Packed vectors have numbers of ``kind``."""
    spark, n = vectors.sparkSession, len(query_rows)
    slots, groups = spark.sparkContext.defaultParallelism, math.ceil(n / QUERIES_PER_GROUP)
    if groups > 1:  # whole rounds of tasks that take equally long
        parts = scan_parts(slots, groups)
        groups = max(groups, math.ceil(groups * parts / slots) * slots // parts)
        vectors = vectors.coalesce(parts)
    size = math.ceil(n / groups)
    return functools.reduce(DataFrame.unionByName, (
        _scan_group(vectors, query_rows.slice(start, size), k, metric, schema, index, kind) for start in range(0, n, size)))


def _scan_group(
    vectors: DataFrame, query_rows: pa.Table, k: int, metric: str, schema: T.StructType, index: LshIndex | None,
    kind: type | None,
) -> DataFrame:
    buckets = index and index.codes(as_matrix(query_rows["qvec"], "cosine"), index.probes)
    shared = vectors.sparkSession.sparkContext.broadcast(
        (query_rows["qid"].combine_chunks(), as_matrix(query_rows["qvec"], metric), buckets)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, matrix, buckets = shared.value
        shortlist, waiting, rows = None, [], 0
        for batch in batches:
            shortlist = shortlist or Shortlist(matrix, k, metric, batch.schema.field("id").type, buckets=buckets)
            if len(batch):
                waiting.append(_unpacked(batch, kind) if kind else batch)
            rows += len(batch)
            if rows >= _SCAN_ROWS:
                shortlist.add(pa.Table.from_batches(waiting))
                waiting, rows = [], 0
        if rows:
            shortlist.add(pa.Table.from_batches(waiting))
        if shortlist is not None:
            yield from shortlist.table(qids).to_batches(max_chunksize=_SCAN_ROWS)

    return vectors.select("id", "values", *(["buckets"] if index else [])).mapInArrow(scan, schema)


def _slot(key: str, slots: str) -> Column:
    return F.pmod(F.xxhash64(key), slots).cast("int")


def _all_slots(slots: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(slots) - 1))


def _slot_topk(vectors: DataFrame, queries: DataFrame, k: int, metric: str) -> DataFrame:
    """Top-k inside each (bucket, vector slot, query slot).

    Both inputs carry ``bucket``, ``v_slots`` and ``q_slots``; slots hash the unique ids, so
    they are even however alike the vectors are.
    """
    ship_package(vectors.sparkSession)
    keys = ["bucket", "v_slot", "q_slot"]
    v = vectors.select(
        "id", "values", "bucket",
        _slot("id", "v_slots").alias("v_slot"), _all_slots("q_slots").alias("q_slot"),
    )
    q = queries.select(
        "qid", "qvec", "bucket",
        _slot("qid", "q_slots").alias("q_slot"), _all_slots("v_slots").alias("v_slot"),
    )

    def pair(vector_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        shortlist = Shortlist(as_matrix(query_rows["qvec"], metric), k, metric, vector_rows.schema.field("id").type)
        if len(query_rows) and len(vector_rows):
            shortlist.add(vector_rows.select(["id", "values"]))
        return shortlist.table(query_rows["qid"].combine_chunks())

    return v.groupBy(keys).cogroup(q.groupBy(keys)).applyInArrow(pair, result_schema(vectors.schema["id"].dataType, queries.schema["qid"].dataType))


def vector_topk(
    vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """Exact top-k of ``vectors(id, values)`` for each of ``queries(qid, qvec)``.

    Returns ``qid, id, score, rank``; ties go to the smaller id. For "euclidean" the score
    is the distance and the smallest comes first.
    """
    return in_turn(vectors.sparkSession, _scans(vectors.select("id", "values"), queries, k, metric, max_broadcast_bytes),
                   result_schema(vectors.schema["id"].dataType, queries.schema["qid"].dataType), k, metric)


def _scans(
    vectors: DataFrame, queries: DataFrame, k: int, metric: str, max_bytes: int, index: LshIndex | None = None,
) -> Iterator[DataFrame]:
    """Matches of one block of queries after the other."""
    ship_package(vectors.sparkSession)
    schema = result_schema(vectors.schema["id"].dataType, queries.schema["qid"].dataType)
    rows, scanned, kind = None, vectors, None
    blocks = query_blocks(queries, max_bytes, index.tables * (1 + index.probes) * 8 if index else 0)
    for following in itertools.chain(blocks, [None]):
        if rows is not None:
            if scanned is vectors and (following is not None or len(rows) > QUERIES_PER_GROUP):
                kind = None if index else _kind(vectors)
                scanned = write_scratch(packed(vectors) if kind else vectors, "vectors")
            yield _scan_topk(scanned, rows, k, metric, schema, index, kind)
        rows = following


@dataclass(frozen=True)
class LshIndex:
    """Hash tables of sign planes: a bucket is the side of each of ``planes`` random planes a vector is on.

    Two unrelated vectors share a bucket of one table with probability 2^-planes, whatever the
    dimension. A query also looks into the buckets across its ``probes`` nearest planes, one at
    a time. More planes mean fewer candidates, more tables and probes better recall. ``index``
    adds the bucket list once; store its result and pass it to ``topk``.
    """

    dims: int
    tables: int = 12
    planes: int = 1
    probes: int = 2
    seed: int = 42

    @classmethod
    def tuned(
        cls, vectors: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", recall: float = 0.95,
        max_share: float = 0.5, tables: int = 12, sample_queries: int = 200, sample_vectors: int = 5_000,
    ) -> "LshIndex | None":
        """The setting that looks at the smallest share of all vectors with at least ``recall`` of the true
        matches, both measured on bounded samples; None where no setting looks at less than
        ``max_share``, so that the exact search should be used."""
        def some(df: DataFrame, key: str, bound: int) -> DataFrame:
            share = min(1.0, bound / max(df.count(), 1))
            return df.filter(F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 40)) < int(share * (1 << 40))).limit(bound)

        asked = write_scratch(some(queries.select("qid", "qvec"), "qid", sample_queries), "query-sample")
        truth = vector_topk(vectors, asked, k, metric).select("qid", "id")
        pairs = vectors.select("id", "values").join(F.broadcast(truth), "id").join(F.broadcast(asked), "qid").toArrow()
        other = some(vectors.select("id", "values"), "id", sample_vectors).select("values").toArrow()
        if not len(pairs) or not len(other):
            return None
        q, v, rows = as_matrix(pairs["qvec"], "cosine"), as_matrix(pairs["values"], "cosine"), as_matrix(other["values"], "cosine")
        best = None
        for planes in range(1, math.ceil(math.log2(max(vectors.count(), 2))) + 1):
            for probes in range(min(planes, 3) + 1):
                index = cls(q.shape[1], tables, planes, probes)
                if index._meets(q, v).mean() >= recall:
                    share = float(np.mean([index._meets(x[None], rows).mean() for x in q[:: max(1, len(q) // 50)]]))
                    best = min(best or (max_share, None), (share, index), key=lambda s: s[0])
        return best and best[1]

    def _meets(self, queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """Whether the index looks at each vector for the query in the same row, or for the only query."""
        normals = self.normals()
        sides, other = ((rows @ normals).reshape(len(rows), self.tables, self.planes) for rows in (queries, vectors))
        differ = (sides > 0) != (other > 0)
        across = np.zeros(sides.shape, bool)
        np.put_along_axis(across, np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :min(self.probes, self.planes)], True, axis=2)
        n = differ.sum(axis=2)
        return ((n == 0) | ((n == 1) & (differ & across).any(axis=2))).any(axis=1)

    def normals(self) -> np.ndarray:
        """One column per plane, the planes of a table side by side."""
        return np.random.default_rng(self.seed).standard_normal((self.dims, self.tables * self.planes))

    def codes(self, rows: np.ndarray, probes: int) -> np.ndarray:
        """(row, table, bucket): a row's own bucket of each table, then those across its nearest planes."""
        sides = (rows @ self.normals()).reshape(len(rows), self.tables, self.planes)
        bits = np.int64(1) << np.arange(self.planes, dtype=np.int64)
        own = ((sides > 0) * bits).sum(axis=2) + (np.arange(self.tables, dtype=np.int64) << self.planes)
        near = np.argsort(np.abs(sides), axis=2, kind="stable")[:, :, :probes]
        return np.concatenate([own[:, :, None], own[:, :, None] ^ bits[near]], axis=2)

    def index(self, df: DataFrame, values: str = "values", probe: bool = False) -> DataFrame:
        """Add ``buckets``: one number per hash table, with ``probe`` those across the nearest planes too."""
        ship_package(df.sparkSession)
        probes = self.probes if probe else 0

        @F.arrow_udf(T.ArrayType(T.LongType()))
        def hash_rows(rows: pa.Array) -> pa.Array:
            if len(rows) == 0:
                return pa.array([], pa.list_(pa.int64()))
            codes = self.codes(as_matrix(rows, "cosine"), probes).reshape(len(rows), -1)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * codes.shape[1])
            return pa.ListArray.from_arrays(offsets, pa.array(codes.ravel()))

        return df.withColumn("buckets", hash_rows(F.col(values)))

    def topk(
        self, indexed: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine",
        vectors_per_slot: int = VECTORS_PER_SLOT, queries_per_slot: int = QUERIES_PER_SLOT, scan_share: float = SCAN_SHARE,
    ) -> DataFrame:
        """Top-k among the vectors that share at least one bucket with the query.

        Where a bucket has more rows than a slot, and candidates, counted once for each shared bucket, are
        at least ``scan_share`` of all pairs, the table is scanned instead of being sent to every slot of queries.
        """
        q = self.index(queries.select("qid", "qvec"), "qvec", probe=True).withColumn("bucket", F.explode("buckets"))
        v = indexed.select("id", "values", F.explode("buckets").alias("bucket"))

        # Slots of the large buckets, at most rows / slot size of them per side. Counts are written so
        # that the optimizer knows their size when it decides on a broadcast.
        def counted(df: DataFrame, name: str) -> DataFrame:
            return df.groupBy("bucket").agg(F.count("*").alias(name))

        counts = write_scratch(counted(v, "n_v").join(counted(q, "n_q"), "bucket", "full_outer"), "buckets")
        large = counts.filter((F.col("n_v") > vectors_per_slot) | (F.col("n_q") > queries_per_slot))
        met, n_v, n_q, cut = counts.agg(
            F.sum(F.col("n_v").cast("double") * F.col("n_q")), F.sum("n_v"), F.sum("n_q"),
            F.max((F.col("n_v") > vectors_per_slot) | (F.col("n_q") > queries_per_slot))).first()
        if cut and met and met >= scan_share * (n_v / self.tables) * n_q / (self.tables * (1 + min(self.probes, self.planes))):
            scans = _scans(indexed.select("id", "values", "buckets"), queries, k, metric, MAX_BROADCAST_BYTES, self)
            schema = result_schema(indexed.schema["id"].dataType, queries.schema["qid"].dataType)
            return in_turn(indexed.sparkSession, (f.groupBy("qid", "id").agg(F.max("score").alias("score")) for f in scans), schema, k, metric)
        slots = large.select(
            "bucket", *[F.greatest(F.ceil(F.col(n) / size), F.lit(1)).cast("int").alias(name) for n, size, name in (
                ("n_v", vectors_per_slot, "v_slots"), ("n_q", queries_per_slot, "q_slots"))])

        def with_slots(df: DataFrame) -> DataFrame:
            return df.join(slots, "bucket", "left").withColumns({
                "v_slots": F.coalesce("v_slots", F.lit(1)), "q_slots": F.coalesce("q_slots", F.lit(1)),
            })

        q = with_slots(q)
        v = with_slots(v).withColumn("v_slot", _slot("id", "v_slots"))
        reached = q.select("bucket", "v_slots").distinct().select("bucket", _all_slots("v_slots").alias("v_slot"))
        hit = v.join(reached, ["bucket", "v_slot"], "left_semi").drop("v_slot")
        found = _slot_topk(hit, q, k, metric)
        return rank_matches(found.groupBy("qid", "id").agg(F.max("score").alias("score")), k, metric)
