"""A table of vectors whose updates rewrite only the partitions that they meet.

The rows are partitioned by a hash of their id. An upsert or a delete reads the partitions of its ids,
writes what they shall hold aside, and puts that in place by Spark's dynamic partition overwrite; all
other files stay as they are. Each partition keeps one row without an id, so that one that loses all
its vectors is overwritten, too.

What was written aside is named by a note next to the table until it is in place. A job that
was cut off in between is finished by the next one, or by ``repair``. One job changes the table at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.operators.store import last_per_id
from pagetrove.schemas import VECTORS
from pagetrove.session import write_scratch

SLOT = T.StructField("slot", T.IntegerType())


class VectorTable:
    def __init__(self, spark: SparkSession, path: str, slots: int = 256):
        self.spark, self.path, self.slots = spark, path.rstrip("/"), slots

    def create(self) -> "VectorTable":
        """An empty table of ``slots`` partitions."""
        self._note(None)
        self._overwrite(self._empty([*range(self.slots)]))
        return self

    def read(self, slots: list[int] | None = None) -> DataFrame:
        return self._rows(slots).filter(F.col("id").isNotNull()).drop("slot")

    def upsert(self, updates: DataFrame, order: str | None = None) -> None:
        """Insert vectors, replacing those with the same id; of several updates the last by ``order`` wins."""
        new = write_scratch(self._placed(last_per_id(updates.filter(F.col("id").isNotNull()), order)), "updates")
        self._change(new, new)

    def delete(self, ids: DataFrame) -> None:
        gone = write_scratch(self._placed(ids.filter(F.col("id").isNotNull()).select("id").distinct()), "deletes")
        self._change(gone, None)

    def repair(self) -> None:
        """Put in place what a job that was cut off had written aside."""
        aside = self._noted()
        if aside:
            self._overwrite(self.spark.read.schema(T.StructType([*VECTORS.fields, SLOT])).parquet(aside))
            self._note(None)

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("slot", F.pmod(F.xxhash64("id"), F.lit(self.slots)).cast("int"))

    def _rows(self, slots: list[int] | None) -> DataFrame:
        rows = self.spark.read.schema(T.StructType([*VECTORS.fields, SLOT])).parquet(self.path)
        return rows if slots is None else rows.filter(F.col("slot").isin(slots))

    def _empty(self, slots: list[int]) -> DataFrame:
        return self.spark.createDataFrame([(None, None, s) for s in slots], T.StructType([*VECTORS.fields, SLOT]))

    def _change(self, ids: DataFrame, new: DataFrame | None) -> None:
        self.repair()
        touched = sorted(r.slot for r in ids.select("slot").distinct().collect())  # at most ``slots`` numbers
        if not touched:
            return
        kept = self._rows(touched).filter(F.col("id").isNotNull()).join(ids.select("id"), "id", "left_anti")
        after = kept.unionByName(self._empty(touched))
        if new is not None:
            after = after.unionByName(new.select("id", F.col("values").cast("array<float>").alias("values"), "slot"))
        aside = write_scratch(after, "vector-partitions")
        self._note(aside.inputFiles()[0].rpartition("/")[0])
        self._overwrite(aside)
        self._note(None)

    def _overwrite(self, rows: DataFrame) -> None:
        dealt = rows.repartition("slot")
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot").parquet(self.path)

    def _note(self, aside: str | None) -> None:
        self.spark.createDataFrame([(aside or "",)], "aside string").coalesce(1).write.mode("overwrite").text(f"{self.path}-note")

    def _noted(self) -> str:
        return "".join(r.value for r in self.spark.read.text(f"{self.path}-note").collect())
