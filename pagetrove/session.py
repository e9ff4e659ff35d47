"""Session helpers: a local session for tests, and the shared scratch folder."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pagetrove")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per Spark context.

    The driver serves the archive to the executors, so it may lie in the driver's own folder.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_pagetrove_shipped", False):
        here = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp(prefix='pagetrove-')}/pagetrove", "zip", here.parent, here.name)
        sc.addPyFile(archive)
        sc._pagetrove_shipped = True


def ship_to_active() -> None:
    """The same for the session at work, where a function is made from columns alone."""
    spark = SparkSession.getActiveSession()
    if spark is not None:
        ship_package(spark)


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share for intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="pagetrove-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/pagetrove/{label}-{uuid.uuid4().hex}"


def write_scratch(df: DataFrame, label: str, **options) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it back.

    The copy outlives lost executors, and its file sizes give the optimizer real statistics.
    What was shuffled for it leaves the disk as soon as it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    with dropped_shuffles(spark):
        df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def dropped_shuffles(spark: SparkSession) -> Iterator[None]:
    """Spark keeps the shuffle files of a query until the driver collects garbage; those of a query run here go at its end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


class Scratch:
    """Intermediate tables of one eager job, deleted when the job is over."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, scratch_path(spark, "job")
        self.count = 0

    def write(self, df: DataFrame, label: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}-{label}"
        with dropped_shuffles(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        conf = self.spark._jsparkSession.sessionState().newHadoopConf()
        path.getFileSystem(conf).delete(path, True)
