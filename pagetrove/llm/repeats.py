"""Repeated byte strings: remove what a document with a smaller id already holds.

Every suffix of every text is judged by its first ``width`` bytes (50): it goes if a smaller
document has a suffix with the same first bytes. Suffixes are put into buckets by a value that
equal strings share, the least hash of their inner strings of ``INNER`` bytes; neighbouring
suffixes mostly share it, so they travel as one segment of the text, and a bucket is sorted on its
own.

1. Each task sends the bucket values of its texts, 5 bytes each, once however often they occur.
2. A bucket's task finds the values that two documents or two tasks have, and returns them.
3. Only segments with such values travel. Within a slice of documents equal segments are one, for
   the smallest document; the others go at once. So a passage in a third of all documents arrives
   in its bucket at most once per slice.
4. A bucket's task names its suffixes by 128 bits of their first bytes, sorts the names and
   answers with the ranges that a smaller document holds; each text then drops their union.

Ties longer than a machine word are resolved by names made by doubling (1, 2, 4, ... bytes), in
place of ranks of a difference-cover sample: these need a comparison per pair of suffixes, which
array operations cannot express.

Defined results: null and empty texts are empty. Matches never cross documents, and repeats inside
one document stay. Rows of equal id don't count as smaller than one another; a null id is smaller
than all others. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.session import ship_package, write_scratch

from .common import slices

WIDTH = 50
INNER = 24
LONGEST_RUN = 64
_PIECE = 2 << 20
_ODD = [np.uint64(x) for x in np.random.default_rng(11).integers(1 << 62, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)]
_LOW = -(1 << 63)


def _join(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a * _ODD[k]
    x ^= x >> np.uint64(32)
    x += b
    x *= _ODD[k - 1]
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """64-bit names of all strings of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    level = (data.astype(np.uint64) + np.uint64(1 + 977 * seed)) * _ODD[0]
    size, k = 1, 1
    while size * 2 <= width:
        level = _join(level[:-size], level[size:], k)
        size, k = size * 2, k + 1
    return _join(level[:n], level[width - size:width - size + n], 7) if size < width else level[:n]


def least(values: np.ndarray, span: int) -> np.ndarray:
    size, out = 1, values
    while size * 2 <= span:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    n = len(values) - span + 1
    return np.minimum(out[:n], out[span - size:span - size + n]) if size < span else out


def runs(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(text, start, count, value) of the runs of suffixes that share a bucket value."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([0, *map(len, texts)])
    if len(data) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    value = least(names(data, INNER), width - INNER + 1)
    sizes = np.maximum(np.diff(ends) - width + 1, 0)
    text = np.repeat(np.arange(len(texts)), sizes)
    own = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    value = value[ends[:-1][text] + own]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    head = np.flatnonzero(new)
    since = np.arange(len(text)) - np.repeat(head, np.diff(np.r_[head, len(text)]))
    head = np.flatnonzero(since % LONGEST_RUN == 0)
    return text[head], own[head], np.diff(np.r_[head, len(text)]), value[head]


def _pieces(texts: list[bytes]):
    """Ranges of texts of about 4 MB."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _PIECE:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def _pack(values: np.ndarray) -> bytes:
    """40 bits of each value beside those that choose the bucket."""
    return (values >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    # The low bits pick the bucket, the 40 high bits tell values of a bucket apart.
    return ((values & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def bucket_values(texts: DataFrame, buckets: int, width: int) -> DataFrame:
    """A row per task and bucket: the packed values in it, by slice, and whether several documents have them."""
    schema = pa.schema([("bucket", pa.int32()), *[(c, pa.binary()) for c in ("slices", "counts", "many", "value")]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, _PIECE):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                at = np.array(part.column("slice").to_pylist())
                for a, b in _pieces(raw):
                    text, _, _, value = runs(raw[a:b], width)
                    if len(text):
                        yield _values(at[a:b][text], text, value, buckets, schema)

    return texts.select("slice", "text").mapInArrow(run, "bucket int, slices binary, counts binary, many binary, value binary")


def _values(at, text, value, buckets, schema):
    order = np.lexsort((text, value, at))
    at, text, value = at[order], text[order], value[order]
    new = np.r_[True, (value[1:] != value[:-1]) | (at[1:] != at[:-1])]
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(value)] - 1
    many = text[first] != text[last]
    at, value = at[first], value[first]
    bucket = _bucket(value, buckets)
    order = np.lexsort((at, bucket))
    at, value, many, bucket = at[order], value[order], many[order], bucket[order]
    cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    out: list[list] = [[], [], [], []]
    for a, b in zip(cut, np.r_[cut[1:], len(at)]):
        found, counts = np.unique(at[a:b], return_counts=True)
        for column, x in zip(out, (found.astype(np.int32), counts.astype(np.int32), np.packbits(many[a:b]))):
            column.append(x.tobytes())
        out[3].append(_pack(value[a:b]))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut].astype(np.int32)), *[pa.array(c, pa.binary()) for c in out]], schema=schema)


def shared_values(sent: DataFrame) -> DataFrame:
    """(slice, bucket, shared): the values of a slice that may occur in more than one document."""

    def each(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        value = [_unpack(x) for x in rows["value"]]
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8))[:len(v)] for m, v in zip(rows["many"], value)]).astype(bool)
        at = np.concatenate([np.repeat(np.frombuffer(x, np.int32), np.frombuffer(k, np.int32)) for x, k in zip(rows["slices"], rows["counts"])])
        value = np.concatenate(value)
        distinct, seen = np.unique(value, return_counts=True)
        hits = np.union1d(distinct[seen > 1], value[many])
        shared = np.isin(value, hits)
        order = np.lexsort((value[shared], at[shared]))
        at, value = at[shared][order], value[shared][order]
        cut = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
        packed = [np.unique(value[a:b]).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
                  for a, b in zip(cut, np.r_[cut[1:], len(at)])]
        return pa.table({"slice": pa.array(at[cut].astype(np.int32)), "bucket": pa.array([rows["bucket"][0]] * len(cut), pa.int32()),
                         "shared": pa.array(packed, pa.binary())})

    return sent.groupBy("bucket").applyInArrow(each, "slice int, bucket int, shared binary").filter(F.length("shared") > 0)


SEGMENTS = "bucket int, docs binary, keys binary, starts binary, counts binary, data binary"


def segments(texts: DataFrame, shared: DataFrame, buckets: int, width: int) -> DataFrame:
    """Segments to be compared, a row per bucket and slice, and ranges that go already, a row per slice without data."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        known = {}
        for b, blob in zip(right.column("bucket").to_pylist(), right.column("shared").to_pylist()):
            known.setdefault(b, []).append(_unpack(blob))
        known = np.unique(np.concatenate([_key(np.concatenate(v), b) for b, v in known.items()]))
        ids = np.array([_LOW if d is None else d for d in left.column("doc_id").to_pylist()], np.int64)
        keys = np.array(left.column("key").to_pylist(), np.int64)
        raw = [(t or "").encode() for t in left.column("text").to_pylist()]
        found, digest, kept = [], [], []
        for a, b in _pieces(raw):
            text, start, count, value = runs(raw[a:b], width)
            if not len(text):
                continue
            bucket = _bucket(value, buckets)
            look = _key(value >> np.uint64(24), bucket)
            at = np.minimum(np.searchsorted(known, look), len(known) - 1)
            hit = np.flatnonzero(known[at] == look)
            for i in hit:
                x = raw[a + text[i]][start[i]:start[i] + count[i] + width - 1]
                digest.append(hashlib.blake2b(x, digest_size=16).digest())
            found.append(np.stack([bucket[hit], text[hit] + a, start[hit], count[hit]], 1))
        if not found or not digest:
            return schema.empty_table()
        rows = np.concatenate(found)
        # Equal segments of a slice: the smallest document speaks for them.
        mark = np.frombuffer(b"".join(digest), np.uint64).reshape(-1, 2)
        doc = ids[rows[:, 1]]
        order = np.lexsort((rows[:, 2], rows[:, 1], doc, mark[:, 1], mark[:, 0]))
        rows, mark, doc = rows[order], mark[order], doc[order]
        new = np.r_[True, (mark[1:] != mark[:-1]).any(1)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        late = doc > doc[first]
        own = ~late  # repeats inside the smallest document are judged one by one
        out = {f.name: [] for f in schema}

        def add(bucket, part, docs, data):
            out["bucket"].append(int(bucket))
            out["docs"].append(docs.tobytes())
            out["keys"].append(keys[part[:, 1]].tobytes())
            out["starts"].append(part[:, 2].astype(np.int32).tobytes())
            out["counts"].append(part[:, 3].astype(np.int32).tobytes())
            out["data"].append(data)

        if late.any():
            add(left.column("slice")[0].as_py(), rows[late], doc[late], None)
        rows, doc = rows[own], doc[own]
        order = np.argsort(rows[:, 0], kind="stable")
        rows, doc = rows[order], doc[order]
        cut = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else []
        for x, y in zip(cut, np.r_[cut[1:], len(rows)] if len(rows) else []):
            part = rows[x:y]
            data = b"".join([raw[t][s:s + c + width - 1] for _, t, s, c in part.tolist()])
            add(part[0, 0], part, doc[x:y], zlib.compress(data, 1))
        return pa.table({f.name: pa.array(out[f.name], f.type) for f in schema}, schema=schema)

    pair = texts.groupBy("slice").cogroup(shared.groupBy("slice"))
    return pair.applyInArrow(each, SEGMENTS)


def _key(high: np.ndarray, bucket) -> np.ndarray:
    return (high << np.uint64(24)) | np.asarray(bucket).astype(np.uint64)


def compared(found: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, start, count): runs of suffixes whose first bytes a smaller document has, those
    that were found within a slice among them."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("count", pa.int32())])

    def each(table: pa.Table) -> pa.Table:
        given = table.filter(pc.is_null(table["data"])).to_pydict()
        rows = table.filter(pc.is_valid(table["data"])).to_pydict()

        def column(of, name, kind):
            return np.frombuffer(b"".join(of[name]), kind)

        gone = [column(given, "docs", np.int64), column(given, "keys", np.int64), column(given, "starts", np.int32), column(given, "counts", np.int32)]
        doc, key = column(rows, "docs", np.int64), column(rows, "keys", np.int64)
        start, count = column(rows, "starts", np.int32), column(rows, "counts", np.int32)
        if not len(doc):
            return pa.table(dict(zip(schema.names, gone)), schema=schema)
        # Names are made of about 1 MB at a time, and sorted a quarter of them at a time.
        one, two = [], []
        for packed, k in zip(rows["data"], rows["counts"]):
            data = np.frombuffer(zlib.decompress(packed), np.uint8)
            sizes = np.frombuffer(k, np.int32) + width - 1
            ends = np.cumsum(sizes)
            cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(1 << 20, ends[-1], 1 << 20)), len(sizes)])
            for x, y in zip(cuts, cuts[1:]):
                part = data[ends[x] - sizes[x]:ends[y - 1]]
                inside = np.ones(len(part) - width + 1, bool)
                for gap in range(1, width):
                    crossing = ends[x:y - 1] - (ends[x] - sizes[x]) - gap
                    inside[crossing[crossing >= 0]] = False
                one.append(names(part, width)[inside])
                two.append(names(part, width, 1)[inside])
        rows.clear()
        one, two = np.concatenate(one), np.concatenate(two)
        seg = np.repeat(np.arange(len(doc), dtype=np.int32), count)
        own = (np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
        late = np.zeros(len(seg), bool)
        for quarter in range(4):
            at = np.flatnonzero(one >> np.uint64(62) == quarter)
            if not len(at):
                continue
            order = at[np.lexsort((doc[seg[at]], two[at], one[at]))]
            a, b, d = one[order], two[order], doc[seg[order]]
            new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            late[order] = d > d[np.flatnonzero(new)[np.cumsum(new) - 1]]
        hit = np.flatnonzero(late)
        if not len(hit):
            return pa.table(dict(zip(schema.names, gone)), schema=schema)
        head = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (seg[hit[1:]] != seg[hit[:-1]])])
        first = hit[head]
        length = np.diff(np.r_[head, len(hit)])
        here = [doc[seg[first]], key[seg[first]], (start[seg[first]] + own[first]).astype(np.int32), length.astype(np.int32)]
        return pa.table({n: np.concatenate([a, b]) for n, a, b in zip(schema.names, gone, here)}, schema=schema)

    return found.groupBy("bucket").applyInArrow(each, "doc_id long, key long, start int, count int")


def spans(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts, runs): texts has (doc_id, key, text, slice); runs the late suffixes by (doc_id, key, slice).

    Both come from texts dealt by slice. Used in one query, Spark deals the texts once."""
    ship_package(docs.sparkSession)
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOW)).alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    texts = texts.withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))
    shared = write_scratch(shared_values(bucket_values(texts, buckets, width)), "repeat-values")
    late = compared(segments(texts, shared, buckets, width), width)
    return texts, late.withColumn("slice", F.pmod(F.xxhash64("doc_id", "key"), F.lit(buckets)).cast("int"))


def removed(docs: DataFrame, width: int = WIDTH, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; the remaining bytes if asked for."""
    texts, late = spans(docs, width)
    names_out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.binary()] * with_text]

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        runs_of: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, key, start, count in zip(*(right.column(c).to_pylist() for c in ("doc_id", "key", "start", "count"))):
            runs_of.setdefault((doc, key), []).append((start, count))
        rows = []
        for doc, key, text in zip(*(left.column(c).to_pylist() for c in ("doc_id", "key", "text"))):
            data = text.encode()
            kept, end, gone = [], 0, 0
            found = merged(runs_of.get((doc, key), []), width)
            for s, e in found:
                kept.append(data[end:s])
                gone, end = gone + e - s, e
            kept = b"".join([*kept, data[end:]])
            rows.append((None if doc == _LOW else doc, len(data), gone, len(found), hashlib.sha256(kept).hexdigest(), kept)[:len(kinds)])
        columns = list(zip(*rows)) or [[]] * len(kinds)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names_out)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    return texts.groupBy("slice").cogroup(late.groupBy("slice")).applyInArrow(each, schema)


def merged(found: list[tuple[int, int]], width: int) -> list[list[int]]:
    """Maximal byte ranges covered by the runs (start, count); ranges that touch are one."""
    out: list[list[int]] = []
    for first, count in sorted(found):
        start, end = first, first + count + width - 1
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return out
