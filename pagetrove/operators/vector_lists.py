"""Vectors clustered once into lists: exact search that skips lists, and inverted-file search on codes.

``VectorLists.build`` fits centres on a bounded sample, gives every vector to its nearest centre and
writes the vectors as Parquet partitioned by list, with one shuffle that splits lists of many rows. Each
row carries its vector and a code of one byte per subspace: what is left of the vector after its
centre is taken off, cut into pieces, each named by the nearest entry of that piece's codebook. All
searches read only the partitions of the lists they need.

* ``topk_exact``: no vector of a list can be closer to a query than its centre and radius allow. The
  lists next to a query give its k-th score so far; of the others, only those are read and scored
  whose bound reaches that score. The answer equals the plain scan's.
* ``topk``: looks into the lists next to a query, scores the vectors that codes stand for, and compares the best
  of them with their full vectors. ``tune`` measures, on a bounded sample of queries, how many lists
  and candidates reach a recall, and chooses the exact search where no setting saves enough.

Queries are sent to all tasks in blocks of a bounded size, one block after the other. The vectors are
not copied or shuffled for them, however many there are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.functions.bind import bind
from pagetrove.operators.vectors import (
    MAX_BROADCAST_BYTES, QUERIES_PER_GROUP, Shortlist, as_matrix, closeness, in_turn, query_blocks, rank_matches, result_schema,
    scan_parts,
)
from pagetrove.session import scratch_path, ship_package, write_scratch

MOST_LISTS = 4096
ENTRIES = 256          # of a codebook: one byte
CANDIDATES_PER_TASK = 1 << 20
_QUERY_STEP = 256
_SLACK = 1e-9          # far above the rounding of a score


@dataclass(frozen=True)
class ListConfig:
    metric: str = "cosine"
    lists: int | None = None        # default: the square root of the number of rows, MOST_LISTS at most
    subspaces: int = 16             # bytes of a code
    sample_rows: int = 50_000       # centres and codebooks are fitted on at most so many rows
    rounds: int = 10
    seed: int = 42


@dataclass(frozen=True)
class Settings:
    """How to search, and what that reached on the sample it was measured on."""

    exact: bool
    probes: int = 0                 # lists per query
    candidates: int | None = None   # compared in full; None: all rows of the lists, without codes
    recall: float = 1.0
    share: float = 1.0              # of all vectors, scored by code or in full


def bounded_sample(rows: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """About ``bound`` rows at most, picked by a hash of their key."""
    share = bound / max(rows.count(), 1)
    if share >= 1:
        return rows
    return rows.filter(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) < int(share * (1 << 40))).limit(bound)


def unit(values: Column) -> Column:
    squares = F.aggregate(values, F.lit(0.0), lambda s, x: s + x * x)
    return bind(F.sqrt(squares), lambda norm: F.transform(values, lambda x: F.when(norm > 0, x / norm).otherwise(F.lit(0.0))))


def fit_centres(sample: DataFrame, config: ListConfig, lists: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    values = F.col("values").cast("array<double>")
    rows = sample.select(array_to_vector(unit(values) if config.metric == "cosine" else values).alias("features"))
    rows = write_scratch(rows, "features")  # read once a round
    return np.array(KMeans(k=max(lists, 2), seed=config.seed, maxIter=config.rounds).fit(rows).clusterCenters())


def lloyd(rows: np.ndarray, entries: int, rounds: int, seed: int) -> np.ndarray:
    """Codebook of at most ``entries`` rows; an entry without rows keeps its place."""
    distinct = np.unique(rows, axis=0)
    book = distinct[np.random.default_rng(seed).permutation(len(distinct))[:entries]]
    for _ in range(rounds):
        near = nearest(rows, book)[0]
        counts = np.bincount(near, minlength=len(book))
        sums = np.stack([np.bincount(near, weights=column, minlength=len(book)) for column in rows.T], axis=1)
        book = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], book)
    return book


def nearest(rows: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each row and the distance to it."""
    number, gap = np.zeros(len(rows), np.int64), np.zeros(len(rows))
    for start in range(0, len(rows), 4096):
        part = rows[start:start + 4096]
        squares = (centres * centres).sum(axis=1)[None] - 2 * part @ centres.T
        number[start:start + 4096] = squares.argmin(axis=1)
    for start in range(0, len(rows), 4096):
        part = slice(start, start + 4096)
        gap[part] = np.linalg.norm(rows[part] - centres[number[part]], axis=1)
    return number, gap


def pieces(rows: np.ndarray, subspaces: int) -> np.ndarray:
    """(subspaces, rows, width): the components cut into pieces, zeros after the last."""
    width = math.ceil(rows.shape[1] / subspaces)
    wide = np.zeros((len(rows), subspaces * width))
    wide[:, :rows.shape[1]] = rows
    return wide.reshape(len(rows), subspaces, width).transpose(1, 0, 2)


def fit_codebooks(sample: DataFrame, centres: np.ndarray, config: ListConfig, subspaces: int) -> np.ndarray:
    """(subspaces, entries, width). One task fits one subspace, on its piece of the bounded sample."""
    metric, rounds, seed = config.metric, config.rounds, config.seed
    shared = sample.sparkSession.sparkContext.broadcast(centres)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = as_matrix(batch.column("values"), metric)
            number, _ = nearest(rows, shared.value)
            for i, piece in enumerate(pieces(rows - shared.value[number], subspaces)):
                offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * piece.shape[1])
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(piece).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i, np.int32)), lists], ["space", "piece"])

    def fit(table: pa.Table) -> pa.Table:
        rows = np.array(table["piece"].to_pylist())
        book = lloyd(rows[np.lexsort(rows.T)], ENTRIES, rounds, seed)
        return pa.table({"space": pa.array(np.full(len(book), table["space"][0].as_py(), np.int32)),
                         "entry": pa.array(np.arange(len(book), dtype=np.int32)), "piece": pa.array(book.tolist(), pa.list_(pa.float64()))})

    cuts = sample.select("values").mapInArrow(cut, "space int, piece array<double>")
    books = cuts.groupBy("space").applyInArrow(fit, "space int, entry int, piece array<double>").collect()
    width = len(books[0]["piece"])
    out = np.full((subspaces, ENTRIES, width), 1e150)  # entries that are not there are never near
    for r in books:
        out[r["space"], r["entry"]] = r["piece"]
    return out


def list_runs(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one list after another."""
    table = pa.Table.from_batches([batch])
    lists = table["list_id"].to_numpy()
    begins = np.nonzero(np.diff(lists, prepend=-1))[0]
    for begin, end in zip(begins.tolist(), [*begins[1:].tolist(), len(lists)]):
        yield int(lists[begin]), table.slice(begin, end - begin)


@dataclass
class VectorLists:
    """Lists on disk, and what the driver needs to choose among them: a few numbers per list."""

    spark: SparkSession
    path: str
    config: ListConfig
    schema: T.StructType
    centres: np.ndarray
    codebooks: np.ndarray
    sizes: np.ndarray               # rows of each list
    radii: np.ndarray               # distance of its farthest row from its centre
    scored: dict = field(default_factory=lambda: {"full": 0, "code": 0})  # query-vector pairs of the searches so far

    @classmethod
    def build(cls, vectors: DataFrame, config: ListConfig = ListConfig(), path: str | None = None) -> "VectorLists":
        """Cluster ``vectors(id, values)``, whose ids are unique, and write them to ``path`` in the shared folder."""
        spark = vectors.sparkSession
        ship_package(spark)
        path = path or scratch_path(spark, "vector-lists")
        vectors = vectors.select("id", "values")
        rows, dims = vectors.agg(F.count("*"), F.max(F.size("values"))).first()
        schema = T.StructType([
            vectors.schema["id"], vectors.schema["values"], T.StructField("code", T.BinaryType()),
            T.StructField("gap", T.DoubleType()), T.StructField("list_id", T.IntegerType())])
        if not rows:
            spark.createDataFrame([], schema).write.parquet(path)
            return cls(spark, path, config, schema, *(np.zeros((0, 1)),) * 2, *(np.zeros(0),) * 2)
        lists = min(config.lists or max(1, round(math.sqrt(rows))), MOST_LISTS, rows)
        sample = write_scratch(bounded_sample(vectors, "id", config.sample_rows, config.seed), "vector-sample")
        centres = fit_centres(sample, config, lists)
        subspaces = min(config.subspaces, dims)
        codebooks = fit_codebooks(sample, centres, config, subspaces)
        shared, metric = spark.sparkContext.broadcast((centres, codebooks)), config.metric
        id_type, values_type = (f.dataType for f in schema.fields[:2])

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres, codebooks = shared.value
            for batch in batches:
                x = as_matrix(batch.column("values"), metric)
                number, gap = nearest(x, centres)
                codes = np.stack([nearest(p, b)[0] for p, b in zip(pieces(x - centres[number], subspaces), codebooks)], axis=1)
                code = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(subspaces), len(x), [None, pa.py_buffer(np.ascontiguousarray(codes.astype(np.uint8)).tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id"), batch.column("values"), code.cast(pa.binary()), pa.array(gap), pa.array(number, pa.int32())],
                    ["id", "values", "code", "gap", "list_id"])

        encoded = vectors.mapInArrow(encode, schema)
        encoded.hint("rebalance", "list_id").write.partitionBy("list_id").parquet(path)
        sizes, radii = np.zeros(len(centres), np.int64), np.zeros(len(centres))
        written = spark.read.schema(schema).parquet(path).groupBy("list_id").agg(F.count("*").alias("n"), F.max("gap").alias("r"))
        for r in written.collect():  # MOST_LISTS rows at most
            sizes[r["list_id"]], radii[r["list_id"]] = r["n"], r["r"]
        return cls(spark, path, config, schema, centres, codebooks, sizes, radii)

    def read(self, lists: np.ndarray | None = None) -> DataFrame:
        """The rows of some lists; other partitions are not opened."""
        rows = self.spark.read.schema(self.schema).parquet(self.path)
        return rows if lists is None else rows.filter(F.col("list_id").isin([int(x) for x in lists]))

    # -- choosing lists --------------------------------------------------------------------

    def _bounds(self, queries: np.ndarray) -> np.ndarray:
        """(queries, lists): no row of the list is closer than that."""
        if self.config.metric == "euclidean":
            return np.minimum(self.radii[None] + closeness(queries, self.centres, "euclidean"), 0)
        length = np.linalg.norm(queries, axis=1)[:, None]
        return queries @ self.centres.T + length * self.radii[None]

    def _order(self, queries: np.ndarray) -> np.ndarray:
        """Lists of each query, the nearest centre first, lists without rows last."""
        near = closeness(queries, self.centres, self.config.metric)
        return np.argsort(np.where(self.sizes[None] > 0, -near, np.inf), axis=1, kind="stable")

    def _steps(self, queries: np.ndarray) -> Iterator[slice]:
        for start in range(0, len(queries), _QUERY_STEP):
            yield slice(start, start + _QUERY_STEP)

    def _packed(self, queries: np.ndarray, choose) -> np.ndarray:
        """Which query needs which list, eight queries a byte; ``choose`` gets some queries at a time."""
        parts = [np.packbits(choose(step), axis=0) for step in self._steps(queries)]
        return np.concatenate(parts) if parts else np.zeros((0, len(self.sizes)), np.uint8)

    def _wanted(self, packed: np.ndarray) -> tuple[np.ndarray, int]:
        """Lists that any query needs, and how many pairs of query and row that makes."""
        per_list = np.array([int(np.bitwise_count(column).sum()) for column in packed.T], np.int64)
        return np.nonzero((per_list > 0) & (self.sizes > 0))[0], int((per_list * self.sizes).sum())

    def _query_blocks(self, queries: DataFrame, max_bytes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
        for rows in query_blocks(queries, max_bytes, extra=len(self.sizes) // 4) if len(self.sizes) else ():
            yield rows["qid"].combine_chunks(), as_matrix(rows["qvec"], self.config.metric)

    # -- exact -----------------------------------------------------------------------------

    def topk_exact(self, queries: DataFrame, k: int = 10, max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
        """``qid, id, score, rank`` as ``vector_topk`` has it, without reading lists that cannot matter."""
        schema = result_schema(self.schema["id"].dataType, queries.schema["qid"].dataType)
        blocks = (self._exact_block(qids, matrix, k, schema) for qids, matrix in self._query_blocks(queries, max_broadcast_bytes))
        return in_turn(self.spark, blocks, schema, k, self.config.metric)

    def _exact_block(self, qids: pa.Array, matrix: np.ndarray, k: int, schema: T.StructType) -> DataFrame:
        def next_to(step: slice) -> np.ndarray:
            """The first lists that hold k rows together."""
            order = self._order(matrix[step])
            before = np.cumsum(self.sizes[order], axis=1) - self.sizes[order]
            mask = np.zeros(order.shape, bool)
            np.put_along_axis(mask, order, before < k, axis=1)
            return mask

        near = self._packed(matrix, next_to)
        first = write_scratch(self._scan(qids, matrix, near, None, k, schema), "near-lists")
        kth = rank_matches(first, k, self.config.metric, rounded=False).filter(F.col("rank") == k).select("qid", "score").toArrow()
        place = {q: i for i, q in enumerate(qids.to_pylist())}
        floors = np.full(len(matrix), -np.inf)
        floors[[place[q] for q in kth["qid"].to_pylist()]] = kth["score"].to_numpy()

        def may_matter(step: slice) -> np.ndarray:
            done = np.unpackbits(near[step.start // 8:-(-step.stop // 8)], axis=0, count=len(matrix[step])).astype(bool)
            return ~done & (self._bounds(matrix[step]) >= floors[step][:, None] - _SLACK)

        rest = self._scan(qids, matrix, self._packed(matrix, may_matter), floors, k, schema)
        return first.unionByName(rest)

    def _scan(self, qids, matrix, packed, floors, k: int, schema: T.StructType) -> DataFrame:
        """Each task's best k rows of each query in the lists it needs, by full scores."""
        lists, pairs = self._wanted(packed)
        self.scored["full"] += pairs
        if not len(lists):
            return self.spark.createDataFrame([], schema)
        shared, metric = self.spark.sparkContext.broadcast((qids, matrix, packed, floors)), self.config.metric

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, packed, floors = shared.value
            shortlist = None
            for batch in batches:
                if shortlist is None:
                    shortlist = Shortlist(matrix, k, metric, batch.schema.field("id").type, floors)
                for number, rows in list_runs(batch):
                    shortlist.add(rows, np.nonzero(np.unpackbits(packed[:, number], count=len(matrix)))[0])
            if shortlist is not None:
                yield from shortlist.table(qids).to_batches(max_chunksize=20_000)

        return self.read(lists).select("id", "values", "list_id").mapInArrow(scan, schema)

    # -- approximate -----------------------------------------------------------------------

    def topk(
        self, queries: DataFrame, k: int = 10, settings: Settings | None = None, max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    ) -> DataFrame:
        """``qid, id, score, rank`` by the settings, tuned on these queries if there are none. Scores are exact."""
        settings = settings or self.tune(queries, k)
        if settings.exact:
            return self.topk_exact(queries, k, max_broadcast_bytes)
        schema = result_schema(self.schema["id"].dataType, queries.schema["qid"].dataType)
        blocks = (self._approximate_block(qids, matrix, k, settings, schema)
                  for qids, matrix in self._query_blocks(queries, max_broadcast_bytes))
        return in_turn(self.spark, blocks, schema, k, self.config.metric)

    def _probed(self, matrix: np.ndarray, probes: int) -> np.ndarray:
        def first(step: slice) -> np.ndarray:
            order = self._order(matrix[step])[:, :probes]
            mask = np.zeros((len(order), len(self.sizes)), bool)
            np.put_along_axis(mask, order, True, axis=1)
            return mask

        return self._packed(matrix, first)

    def _approximate_block(self, qids, matrix, k: int, settings: Settings, schema: T.StructType) -> DataFrame:
        packed = self._probed(matrix, settings.probes)
        if settings.candidates is None:
            return self._scan(qids, matrix, packed, None, k, schema)
        best = write_scratch(self._best_by_code(qids, matrix, packed, settings.candidates, schema), "candidates")
        return self._compared(best, qids, matrix, self._wanted(packed)[0], schema)

    def _best_by_code(self, qids, matrix, packed, candidates: int, schema: T.StructType) -> DataFrame:
        """``qid, id, score, rank`` of each query's best rows by code. A task holds the candidates of one
        group of queries, and what tasks pass on grows with the queries, not with queries x tasks."""
        slots, n = self.spark.sparkContext.defaultParallelism, len(matrix)
        size = max(8, min(QUERIES_PER_GROUP, CANDIDATES_PER_TASK // candidates) // 8 * 8)  # eight queries a byte
        groups = math.ceil(n / size)
        found = [self._group_by_code(qids.slice(i, size), matrix[i:i + size], packed[i // 8:(i + size) // 8], candidates, schema,
                                     scan_parts(slots, groups) if groups > 1 else None) for i in range(0, max(n, 1), size)]
        return rank_matches(functools.reduce(DataFrame.unionByName, found), candidates, self.config.metric, rounded=False)

    def _group_by_code(self, qids, matrix, packed, candidates: int, schema: T.StructType, parts: int | None) -> DataFrame:
        lists, pairs = self._wanted(packed)
        self.scored["code"] += pairs
        shared = self.spark.sparkContext.broadcast((qids, matrix, packed, self.centres, self.codebooks))
        metric = self.config.metric

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix, packed, centres, codebooks = shared.value
            shortlist = None
            for batch in batches:
                if shortlist is None:
                    shortlist = Shortlist(matrix, candidates, metric, batch.schema.field("id").type)
                for number, rows in list_runs(batch):
                    rows = rows.sort_by("id")
                    codes = np.frombuffer(b"".join(rows["code"].to_pylist()), np.uint8).reshape(len(rows), -1)
                    mine = np.nonzero(np.unpackbits(packed[:, number], count=len(matrix)))[0]
                    shortlist.add_rows(decoded(codes, centres[number], codebooks), rows["id"], mine)
            if shortlist is not None:
                yield from shortlist.table(qids).to_batches(max_chunksize=20_000)

        rows = self.read(lists).select("id", "code", "list_id")
        return (rows.coalesce(parts) if parts else rows).mapInArrow(scan, schema)

    def _compared(self, best: DataFrame, qids, matrix, lists, schema: T.StructType) -> DataFrame:
        """Full scores of the candidates."""
        shared, metric = self.spark.sparkContext.broadcast((qids, matrix)), self.config.metric

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, matrix = shared.value
            place = {q: i for i, q in enumerate(qids.to_pylist())}
            for batch in batches:
                queries = matrix[[place[q] for q in batch.column("qid").to_pylist()]]
                score = row_closeness(queries, as_matrix(batch.column("values"), metric), metric)
                yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("id"), pa.array(score)], ["qid", "id", "score"])

        full = self.read(lists).select("id", "values").join(best.select("qid", "id"), "id")
        return full.select("qid", "id", "values").mapInArrow(compare, schema)

    def tune(
        self, queries: DataFrame, k: int = 10, recall: float = 0.95, max_share: float = 0.3, sample_queries: int = 200,
    ) -> Settings:
        """The fewest lists, then the fewest candidates, that reach ``recall`` on a bounded sample of queries."""
        if not len(self.sizes):
            return Settings(exact=True)
        sample = write_scratch(bounded_sample(queries.select("qid", "qvec"), "qid", sample_queries, self.config.seed), "query-sample")
        truth = write_scratch(self.topk_exact(sample, k), "truth")
        of_list = self.read().select("id", "list_id").join(F.broadcast(truth.select("qid", "id")), "id").toArrow()
        rows = sample.toArrow()
        if not len(rows) or not len(of_list):
            return Settings(exact=True)
        qids, matrix = rows["qid"].combine_chunks(), as_matrix(rows["qvec"], self.config.metric)
        place = {q: i for i, q in enumerate(qids.to_pylist())}
        order = np.concatenate([self._order(matrix[step]) for step in self._steps(matrix)])
        turn = np.argsort(order, axis=1)
        needed = np.sort(turn[[place[q] for q in of_list["qid"].to_pylist()], of_list["list_id"].to_numpy()])
        # Half of what may be missed is left for the codes.
        probes = int(needed[math.ceil((1 + recall) / 2 * len(needed)) - 1]) + 1
        share = float(self.sizes[order[:, :probes]].sum() / (len(matrix) * self.sizes.sum()))
        if share > max_share:
            return Settings(exact=True)
        reached = float((needed < probes).mean())
        most = 50 * k
        schema = result_schema(self.schema["id"].dataType, queries.schema["qid"].dataType)
        best = self._best_by_code(qids, matrix, self._probed(matrix, probes), most, schema)
        hits = np.sort(best.join(F.broadcast(truth.select("qid", "id")), ["qid", "id"]).select("rank").toArrow()["rank"].to_numpy())
        enough = math.ceil(recall * len(of_list))
        if len(hits) < enough:  # codes too coarse for these vectors
            return Settings(False, probes, None, reached, share)
        return Settings(False, probes, max(k, int(hits[enough - 1])), enough / len(of_list), share)


def decoded(codes: np.ndarray, centre: np.ndarray, codebooks: np.ndarray) -> np.ndarray:
    """The vectors that the codes of a list's rows stand for."""
    pieces_ = [book[codes[:, m]] for m, book in enumerate(codebooks)]
    return centre + np.concatenate(pieces_, axis=1)[:, :len(centre)]


def row_closeness(queries: np.ndarray, vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        score = -np.linalg.norm(queries - vectors, axis=1)
    else:
        score = np.einsum("ij,ij->i", queries, vectors)
    return np.round(score, 12) + 0.0
