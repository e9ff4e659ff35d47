"""Reset: empty every table of a store and report what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetrove.operators.store import Store
from pagetrove.schemas import STORE_TABLES


def reset(store: Store) -> DataFrame:
    for table in STORE_TABLES:
        store.truncate(table)
    store.drop_old_versions()
    return left_over(store.stats())


def left_over(stats: DataFrame) -> DataFrame:
    """``n_left, is_empty`` over all tables."""
    return stats.agg(F.sum("n_rows").alias("n_left")).withColumn("is_empty", F.col("n_left") == 0)
