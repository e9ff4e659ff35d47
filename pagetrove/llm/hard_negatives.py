"""Hard-negative mining with Four-Russians scores.

Integer inner products come from tables. The components of an anchor are taken eight at a time, and
the sums of all 256 subsets of such a group are worked out once by doubling. A candidate's components
in two's complement are bit planes, packed so that eight components of one plane are one byte. Then

    score = sum over planes of +-2^plane * sum over groups of table[group][byte],

by shift and add from the highest plane (whose sign is negative) down: whole scores, no rounding.
Tables of a block of anchors lie side by side, so one byte fetches the sums for all of them.

The anchors are the stated query set. They are split into rounds of a bounded number of bytes; a
round's anchors are sent to all tasks, each of which goes through its candidates in blocks. No pair
of anchor and candidate is ever a row: a task keeps the best few per anchor. First the rows of an
anchor's own label are scored for its positives, then the rows of other labels for the negatives
inside each positive's window, so each pair is scored once.

Defined results: rows with a null label or vector, or with a null, NaN or infinite component take no
part. Vectors of different lengths are met with zeros for what is missing. A null id is no anchor and
comes after all others on ties. Repeated rows are rows of their own: a copy of an anchor is a positive
of it. An empty table gives no rows. Components that could make a score of over 55 bits are refused.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.session import ship_package, write_scratch

GROUP = 8                  # components in a table of 256 sums
ANCHOR_BYTES = 8 << 20     # of anchors sent to all tasks in one round
ANCHORS_AT_ONCE = 128      # their tables fit a core's cache
ROWS_AT_ONCE = 1024
_LEAST = np.iinfo(np.int64).min


@dataclass(frozen=True)
class MiningConfig:
    every: int = 100           # ids divisible by it are anchors
    positives: int = 5
    negatives: int = 10
    scale: int = 256
    lowest: tuple[int, int] = (30, 100)    # 30 * positive <= 100 * negative
    highest: tuple[int, int] = (100, 90)   # 100 * negative <= 90 * positive
    anchor_bytes: int = ANCHOR_BYTES


def integer_rows(embeddings: DataFrame, config: MiningConfig) -> DataFrame:
    """(row, vec_id, label, x): the rows that take part, their label as the rule has it, components as integers."""
    x = F.col("embedding")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * config.scale).cast("long"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) != float("inf")))
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return embeddings.filter(F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"),
        label.alias("label"), whole.alias("x"))


def padded(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of a matrix, zeros after their ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def bit_planes(rows: np.ndarray, planes: int) -> np.ndarray:
    """(planes, groups, rows) bytes: bit j of a byte is the plane's bit of component 8 * group + j."""
    bits = (rows[None] >> np.arange(planes)[:, None, None]) & 1
    return np.ascontiguousarray(np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").transpose(0, 2, 1))


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): the sum of each subset of each group of components."""
    n, d = anchors.shape
    table = np.zeros((d // GROUP, 1 << GROUP, n), kind)
    parts = anchors.astype(kind).reshape(n, d // GROUP, GROUP).transpose(1, 2, 0)
    for j in range(GROUP):
        table[:, 1 << j:2 << j] = table[:, :1 << j] + parts[:, j:j + 1]
    return table


def scores(tables: np.ndarray, bytes_: np.ndarray) -> np.ndarray:
    """(rows, anchors): exact inner products of candidates' bit planes with the tables' anchors."""
    planes, groups, rows = bytes_.shape
    total = np.zeros((rows, tables.shape[2]), tables.dtype)
    found = np.empty_like(total)
    for plane in range(planes - 1, -1, -1):
        total <<= 1
        add = np.subtract if plane == planes - 1 else np.add
        for g in range(groups):
            np.take(tables[g], bytes_[plane, g], axis=0, out=found, mode="clip")
            add(total, found, out=total)
    return total


class Shape:
    """Width and bit planes that hold all rows, and the integer type that holds all scores."""

    def __init__(self, longest: int, least: int, most: int):
        self.width = max(GROUP, -(-longest // GROUP) * GROUP)
        self.planes = max(int(most), -int(least) - 1, 1).bit_length() + 1
        largest = self.width << (2 * (self.planes - 1))
        if largest >= 1 << 55:  # scores times a hundred stay longs
            raise ValueError("components are too large for scores of 55 bits")
        self.kind = np.int32 if largest < 1 << 30 else np.int64


def ordered(ids: np.ndarray, null: np.ndarray) -> np.ndarray:
    """Places by id, rows without an id last."""
    return np.lexsort((ids, null))


class Block:
    """Some candidates in id order, so that the first of equal scores has the smaller id."""

    def __init__(self, batch: pa.Table, shape: Shape):
        ids = batch["vec_id"].combine_chunks()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        order = ordered(ids.fill_null(0).to_numpy(zero_copy_only=False), null)
        self.batch = batch.take(pa.array(order))
        self.ids = self.batch["vec_id"].combine_chunks()
        self.rows = self.batch["row"].to_numpy()
        self.labels = self.batch["label"].to_numpy()
        self.bytes = bit_planes(padded(self.batch["x"], shape.width), shape.planes)


class Best:
    """The first k (score, id) of each query over the blocks seen so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.floor = k, np.full(queries, _LEAST)
        self.table = None

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        found = pa.table({"query": pa.array(query, pa.int64()), "score": pa.array(score, pa.int64()), "id": ids})
        self.table = found if self.table is None else pa.concat_tables([self.table, found])
        if len(self.table) > 4 * self.k * len(self.floor):
            self.cut()

    def settle(self) -> None:
        """After a block: learn the floors as soon as there are enough rows for them."""
        if self.table is not None and len(self.table) > 2 * self.k * len(self.floor) or (self.floor == _LEAST).all():
            self.cut()

    def cut(self) -> None:
        if self.table is None:
            return
        t = self.table.combine_chunks().sort_by([("query", "ascending"), ("score", "descending"), ("id", "ascending")])
        query = t["query"].to_numpy()
        begins = np.nonzero(np.diff(query, prepend=-1))[0]
        place = np.arange(len(query)) - np.repeat(begins, np.diff(np.append(begins, len(query))))
        full = place == self.k - 1
        self.floor[query[full]] = t["score"].to_numpy()[full]
        self.table = t.filter(pa.array(place < self.k))


def highest(score: np.ndarray, floor: np.ndarray, k: int) -> np.ndarray:
    """Cells among which the first k of each column are, none below the column's floor."""
    keep = score >= floor[None]
    if score.shape[0] > k and np.count_nonzero(keep) > 4 * k * score.shape[1]:
        keep &= score >= np.partition(score, -k, axis=0)[-k][None]
    return keep


def chunked(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    waiting, held = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            waiting.append(part)
            held += part.num_rows
            if held >= rows:
                yield pa.Table.from_batches(waiting).combine_chunks()
                waiting, held = [], 0
    if held:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _by_label(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks of anchors of one label."""
    for label in np.unique(labels).tolist():
        places = np.nonzero(labels == label)[0]
        for start in range(0, len(places), ANCHORS_AT_ONCE):
            yield label, places[start:start + ANCHORS_AT_ONCE]


def _positives(candidates: DataFrame, anchors: pa.Table, shape: Shape, config: MiningConfig) -> DataFrame:
    """(anchor, score, id): each task's first rows of the anchor's label but itself."""
    shared = candidates.sparkSession.sparkContext.broadcast(anchors)
    k = config.positives

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = shared.value
        rows, labels, x = a["row"].to_numpy(), a["label"].to_numpy(), padded(a["x"], shape.width)
        best = Best(len(rows), k)
        for table in chunked(batches, ROWS_AT_ONCE):
            block = Block(table, shape)
            for label, at in _by_label(labels):
                mine = np.nonzero(block.labels == label)[0]
                if not len(mine):
                    continue
                s = scores(subset_sums(x[at], shape.kind), block.bytes[:, :, mine]).astype(np.int64)
                self_row, self_col = np.nonzero(block.rows[mine][:, None] == rows[at][None])
                s[self_row, self_col] = _LEAST
                keep = highest(s, best.floor[at], k)
                keep[self_row, self_col] = False
                r, c = np.nonzero(keep)
                best.add(at[c], s[r, c], block.ids.take(pa.array(mine[r])))
            best.settle()
        best.cut()
        if best.table is not None and len(best.table):
            t = best.table
            yield from pa.table({"anchor": pa.array(rows[t["query"].to_numpy()]), "score": t["score"], "id": t["id"]}).to_batches(
                max_chunksize=20_000)

    return candidates.mapInArrow(scan, "anchor long, score long, id long")


def _negatives(candidates: DataFrame, anchors: pa.Table, windows: pa.Table, shape: Shape, config: MiningConfig) -> DataFrame:
    """(query, score, id): each task's first rows of other labels in each positive's window.

    ``windows`` (query, anchor, lowest, highest) has one row per anchor and positive.
    """
    shared = candidates.sparkSession.sparkContext.broadcast((anchors, windows))
    k = config.negatives

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, w = shared.value
        labels, x = a["label"].to_numpy(), padded(a["x"], shape.width)
        place = {row: i for i, row in enumerate(a["row"].to_pylist())}
        low, high = w["lowest"].to_numpy(), w["highest"].to_numpy()
        best = Best(len(w), k)
        of_anchor: list[list[int]] = [[] for _ in labels]
        for q, anchor in enumerate(w["anchor"].to_pylist()):
            of_anchor[place[anchor]].append(q)
        turns = []   # the i-th window of each anchor of a block, side by side
        for label, at in _by_label(labels):
            own = [[(c, of_anchor[i][turn]) for c, i in enumerate(at.tolist()) if turn < len(of_anchor[i])]
                   for turn in range(max((len(of_anchor[i]) for i in at.tolist()), default=0))]
            turns.append((label, at, [tuple(np.array(pairs).T) for pairs in own]))
        for table in chunked(batches, ROWS_AT_ONCE):
            block = Block(table, shape)
            for label, at, own in turns:
                others = np.nonzero(block.labels != label)[0]
                if not len(others) or not own:
                    continue
                s = scores(subset_sums(x[at], shape.kind), block.bytes[:, :, others]).astype(np.int64)
                for columns, queries in own:
                    mine = s[:, columns] if len(columns) < s.shape[1] else s
                    inside = np.where(mine <= high[queries][None], mine, _LEAST)
                    keep = highest(inside, np.maximum(best.floor[queries], low[queries]), k)
                    r, c = np.nonzero(keep)
                    best.add(queries[c], inside[r, c], block.ids.take(pa.array(others[r])))
            best.settle()
        best.cut()
        if best.table is not None and len(best.table):
            t = best.table
            yield from pa.table({
                "query": w["query"].take(t["query"]), "score": t["score"], "id": t["id"]}).to_batches(max_chunksize=20_000)

    return candidates.mapInArrow(scan, "query long, score long, id long")


def _first(rows: DataFrame, key: str, k: int) -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _floored(product: str, by: int) -> str:
    """SQL for the floored quotient of a long and a positive whole number."""
    return f"(({product}) - pmod({product}, {by}L)) div {by}L"


def mine(embeddings: DataFrame, config: MiningConfig = MiningConfig()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) by the module's rules."""
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = write_scratch(integer_rows(embeddings, config), "integer-rows")
    longest, least, most = rows.agg(
        F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    shape = Shape(longest or 0, least or 0, most or 0)
    anchor = F.col("vec_id") % config.every == 0
    n_anchors = rows.filter(anchor).count()
    per_round = max(1, config.anchor_bytes // (8 * shape.width + 64 * config.positives))
    rounds = -(-n_anchors // per_round)
    found = []
    for i in range(rounds):
        turn = rows.filter(anchor & (F.pmod(F.xxhash64("row"), F.lit(rounds)) == i))
        anchors = turn.toArrow()
        first = write_scratch(_first(_positives(rows, anchors, shape, config), "anchor", config.positives), "positives")
        score, (lo_a, lo_b), (hi_a, hi_b) = F.col("score"), config.lowest, config.highest
        windows = write_scratch(first.select(
            F.monotonically_increasing_id().alias("query"), "anchor", F.col("id").alias("positive_id"), score.alias("positive_score"),
            F.expr(f"-({_floored(f'-{lo_a}L * score', lo_b)})").alias("lowest"),
            F.expr(_floored(f"{hi_b}L * score", hi_a)).alias("highest")), "windows")
        held = windows.filter("lowest <= highest").select("query", "anchor", "lowest", "highest").toArrow()
        negatives = _first(_negatives(rows, anchors, held, shape, config), "query", config.negatives)
        named = turn.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found.append(negatives.join(windows, "query").join(named, "anchor").select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
            "positive_score", F.col("score").alias("negative_score")))
    if not found:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result
