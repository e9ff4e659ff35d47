"""Snapshots of fetched pages, as a table or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagetrove.schemas import PAGES


def spread(scan: DataFrame) -> DataFrame:
    """Share out a small scan over all task slots, for heavy per-row work on few files.

    A table that fills every slot with a file partition by its size is passed through without a
    shuffle; the size is what the optimizer has from the files' list, so nothing is run or planned anew.
    """
    spark = scan.sparkSession
    slots = spark.sparkContext.defaultParallelism
    size = int(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    full = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return scan.repartition(slots) if size < slots * full else scan


def read_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    return spread(spark.read.schema(PAGES).format(format).load(path))


def stream_pages(
    spark: SparkSession, path: str, format: str = "parquet",
    max_files: int | None = None, name_filter: str | None = None,
) -> DataFrame:
    """Stream of the files that arrive in ``path``; ``max_files`` bounds one micro-batch.

    A micro-batch has few files as a rule, and how large it will be isn't known, so its rows are
    always shared out over all task slots.
    """
    reader = spark.readStream.schema(PAGES).format(format)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    return reader.load(path).repartition(spark.sparkContext.defaultParallelism)
