"""What the operators of this folder share: the word rule, the hold-out rule, text scanning in Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetrove.session import ship_package

# Fixed value: a word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def bounded_sample(rows: DataFrame, bound: int, seed: str) -> DataFrame:
    """At most ``bound`` of the rows, the first by a hash of the row.

    A first cut by the hash leaves about four times the bound, so few rows are put in order
    however many there are.
    """
    place = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 40))
    share = min(1.0, 4 * bound / max(rows.count(), 1))
    return rows.filter(place < int(share * (1 << 40))).orderBy(place, *rows.columns).limit(bound)


_KEPT: dict = {}


def worker_cache(name: str, make: Callable = dict):
    """What a Python worker keeps between tasks. A worker serves one operator after another; the
    cache of the one before is dropped and its memory given back, so that their sizes don't add up."""
    if name not in _KEPT:
        _KEPT.clear()
        give_back()
        _KEPT[name] = make()
    return _KEPT[name]


def give_back() -> None:
    """Return freed memory to the system, which allocators otherwise keep for later."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def map_batches(
    df: DataFrame, schema: str, each: Callable[[pa.RecordBatch], dict[str, list]], max_bytes: int = 16 << 20,
) -> DataFrame:
    """``mapInArrow`` with a function from one batch to columns of the schema.

    Batches are as large as ``spark.sql.execution.arrow.maxRecordsPerBatch`` says and cut to about
    ``max_bytes``; the function must not depend on where one batch ends.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    ship_package(df.sparkSession)
    small_batches(df.sparkSession)
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, max_bytes):
                columns = each(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[f.name], type=f.type) for f in kind], schema=kind)
        give_back()

    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Send at most 2,000 rows or 16 MB to a Python worker at a time, unless the session names its own numbers:
    texts are long, and a batch is held by the executor and by the worker."""
    for key, default, value in (("maxRecordsPerBatch", "10000", 2000), ("maxBytesPerBatch", "67108864b", "16m")):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}") == default:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def slices(batch: pa.RecordBatch, max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a slice holds about ``max_bytes``, and one row at least."""
    rows = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)
