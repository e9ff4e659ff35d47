"""The stored tables: webpages, chunks, vectors and links as versioned Parquet folders.

Layout: ``<root>/<table>/v=<n>/writer=<name>/batch_id=<id>/*.parquet``. A batch belongs to its
writer: batch numbers of different streams and batch jobs don't meet. Appends add a batch
folder to the current version; running a batch again replaces its own folder, so a replay
changes nothing. Everything is written aside first and put in place by a rename, so a reader
never sees half a batch. Rewrites (upsert, delete, truncate) make version n+1 of what version n
holds; one that finds batches added to n meanwhile starts again, and an append that finds a new
version moves its batch there.
"""

from __future__ import annotations

import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetrove.schemas import STORE_TABLES


BATCH_FIELDS = [T.StructField("writer", T.StringType()), T.StructField("batch_id", T.LongType())]
WRITER = re.compile(r"[A-Za-z0-9_-]+")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # -- folders ---------------------------------------------------------------------------

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()), jvm.org.apache.hadoop.fs.Path

    def _versions(self, table: str) -> list[int]:
        fs, Path = self._fs()
        folder = Path(f"{self.root}/{table}")
        if not fs.exists(folder):
            return []
        names = [status.getPath().getName() for status in fs.listStatus(folder)]
        versions = [int(n[2:]) for n in names if n.startswith("v=")]
        return sorted(v for v in versions if fs.exists(Path(f"{self._folder(table, v)}/_SUCCESS")))

    def _folder(self, table: str, version: int) -> str:
        return f"{self.root}/{table}/v={version}"

    def _staging(self) -> str:
        return f"{self.root}/_staging/{uuid.uuid4().hex}"

    def _move(self, source: str, target: str) -> bool:
        """Rename a folder unless the target is there already."""
        fs, Path = self._fs()
        fs.mkdirs(Path(target).getParent())
        return not fs.exists(Path(target)) and fs.rename(Path(source), Path(target))

    def _batches(self, table: str, version: int) -> set[tuple[str, int]]:
        """The batch folders of a version, with their time of change."""
        fs, Path = self._fs()
        found = fs.globStatus(Path(f"{self._folder(table, version)}/writer=*/batch_id=*"))
        return {(status.getPath().toString(), status.getModificationTime()) for status in found or []}

    def _current(self, table: str) -> int:
        versions = self._versions(table)
        if not versions:
            raise ValueError(f"no table {table} in {self.root}; call create() first")
        return versions[-1]

    # -- tables ----------------------------------------------------------------------------

    def create(self) -> "Store":
        """Create the tables that do not exist yet."""
        for table in STORE_TABLES:
            if not self._versions(table):
                self.truncate(table)
        return self

    def read(self, table: str, with_batch: bool = False) -> DataFrame:
        schema = STORE_TABLES[table]
        stored = T.StructType(schema.fields + BATCH_FIELDS)
        rows = self.spark.read.schema(stored).parquet(self._folder(table, self._current(table)))
        return rows if with_batch else rows.drop("writer", "batch_id")

    def read_others(self, table: str, batch_id: int, writer: str) -> DataFrame:
        """All rows but those of one batch of one writer."""
        own = (F.col("writer") == writer) & (F.col("batch_id") == batch_id)
        return self.read(table, with_batch=True).filter(~own).drop("writer", "batch_id")

    def stream(self, table: str) -> DataFrame:
        """A stream of what is and will be appended to the current version of a table."""
        stored = T.StructType(STORE_TABLES[table].fields + BATCH_FIELDS)
        rows = self.spark.readStream.schema(stored).parquet(self._folder(table, self._current(table)))
        return rows.drop("writer", "batch_id")

    def append(self, table: str, rows: DataFrame, batch_id: int, writer: str = "batch") -> None:
        """Write one batch; the same writer and ``batch_id`` again replace what they wrote before."""
        if not WRITER.fullmatch(writer):
            raise ValueError(f"a writer's name has letters, digits, '-' and '_' only: {writer!r}")
        staged = self._staging()
        rows.select(*STORE_TABLES[table].fieldNames()).write.parquet(staged)
        fs, Path = self._fs()
        while True:
            version = self._current(table)
            target = f"{self._folder(table, version)}/writer={writer}/batch_id={batch_id}"
            fs.delete(Path(target), True)
            if not self._move(staged, target):
                raise RuntimeError(f"{target} was written by another job")
            later = self._current(table)
            moved = f"{self._folder(table, later)}/writer={writer}/batch_id={batch_id}"
            if later == version or fs.exists(Path(moved)):
                return
            staged = target  # the table was rewritten without this batch meanwhile

    def _rewrite(self, table: str, change) -> None:
        """Publish ``change(rows)`` of the current version, rows with writer and batch, as the next one."""
        while True:
            version = self._current(table)
            before = self._batches(table, version)
            staged = self._staging()
            change(self.read(table, with_batch=True)).write.partitionBy("writer", "batch_id").parquet(staged)
            if self._current(table) == version and self._batches(table, version) == before:
                if self._move(staged, self._folder(table, version + 1)):
                    return
            fs, Path = self._fs()
            fs.delete(Path(staged), True)

    def upsert_vectors(
        self, updates: DataFrame, batch_id: int, order: str | None = None, writer: str = "batch",
    ) -> None:
        """Insert vectors, replacing those with the same id; among updates with one id the
        one with the largest ``order`` wins, without an order the one with the largest values."""
        latest = last_per_id(updates, order)
        new = latest.select("id", "values", F.lit(writer).alias("writer"), F.lit(batch_id).cast("long").alias("batch_id"))
        self._rewrite("vectors", lambda old: old.join(latest.select("id"), "id", "left_anti").unionByName(new))

    def delete_vectors(self, ids: DataFrame) -> None:
        self._rewrite("vectors", lambda old: old.join(ids.select("id"), "id", "left_anti"))

    def truncate(self, table: str) -> None:
        """Publish an empty version, whatever is added to the current one meanwhile."""
        staged = self._staging()
        self.spark.createDataFrame([], STORE_TABLES[table]).write.parquet(staged)
        while True:
            versions = self._versions(table)
            if self._move(staged, self._folder(table, versions[-1] + 1 if versions else 1)):
                return

    def drop_old_versions(self) -> None:
        """Delete all but the current version of each table."""
        fs, Path = self._fs()
        for table in STORE_TABLES:
            for version in self._versions(table)[:-1]:
                fs.delete(Path(self._folder(table, version)), True)

    # -- checks ----------------------------------------------------------------------------

    def all_urls(self) -> DataFrame:
        return self.read("webpages").select("url")

    def stats(self) -> DataFrame:
        return table_stats({name: self.read(name) for name in STORE_TABLES})

    def orphans(self) -> DataFrame:
        """Chunks without a page; an empty result means the store is consistent."""
        return self.read("chunks").join(self.read("webpages").select("url"), "url", "left_anti")


def last_per_id(updates: DataFrame, order: str | None = None) -> DataFrame:
    """One row per id, the last by ``order``, or else the one with the largest values."""
    last = F.struct(*([order] if order else []), "values")
    return updates.groupBy("id").agg(F.max(last)["values"].alias("values"))


def table_stats(tables: dict[str, DataFrame], vector_column: str = "values") -> DataFrame:
    """``name, n_rows, dims``: row counts, and the vector size where there are vectors."""
    def one(name: str, df: DataFrame) -> DataFrame:
        dims = F.max(F.size(vector_column)) if vector_column in df.columns else F.lit(None)
        return df.agg(F.count("*").alias("n_rows"), dims.cast("int").alias("dims")).select(
            F.lit(name).alias("name"), "n_rows", "dims"
        )

    return reduce(DataFrame.unionByName, [one(n, df) for n, df in tables.items()])
