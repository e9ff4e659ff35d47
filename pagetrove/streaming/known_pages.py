"""Incremental ingest that remembers stored pages in the stream's own state.

``stream_ingest`` looks up each micro-batch in the stored pages. Here the stored pages are a stream, too:
every page that any job appends to the store arrives once, and its address and its content are
marked in keyed state on the executors' local disks (RocksDB, saved with the checkpoint). A new page
is two events, one under its address and one under its content, which meet those marks only. A
micro-batch so costs what it brings, whatever the store holds, and no plan scans the stored pages.

A page marks nothing by itself. Whether it is stored is decided in the batch, one by one in order, as
a page skipped for its content does not reserve its address; what is stored comes back as a stored
page in the next micro-batch. The micro-batch after a write therefore brings its marks before or
together with later pages, and stored pages of the same micro-batch are compared in the batch itself.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pagetrove.config import IngestConfig
from pagetrove.operators.dedup import first_wins_pairs
from pagetrove.operators.embed import Embedder
from pagetrove.operators.store import Store
from pagetrove.plans.ingest import parsed_rows, store_pages
from pagetrove.session import Scratch, ship_package
from pagetrove.streaming.jobs import start_batches

PAGE = "struct<page_id:bigint,url:string,title:string,summary:string,sitename:string,chunks:array<string>,hash:string>"
URL, CONTENT = "url", "content"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def marks() -> StatefulProcessor:
    """The processor; its class is made here, so that Spark's own processes get it without this package."""

    class Marks(StatefulProcessor):
        """Per address or content: whether a stored page has it.

        Of the events under one key it passes on the pages that are new by their address, one event for
        a content that is known, and the marks that arrive with this micro-batch.
        """

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.mark = handle.getValueState("stored", "stored boolean")

        def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
            kind, value = key
            known, told = self.mark.exists(), False
            for row in rows:
                if row.stored:
                    if not self.mark.exists():
                        self.mark.update((True,))
                    yield Row(kind=kind, value=value, page=None)
                elif kind == URL and not known:
                    yield Row(kind="page", value=value, page=row.page)
                elif kind == CONTENT and known and not told:
                    told = True
                    yield Row(kind=kind, value=value, page=None)

        def close(self) -> None:
            pass

    return Marks()


def _events(rows: DataFrame, stored: bool) -> DataFrame:
    """Two events a row: under its address, with the page if there is one, and under its content.

    Pages without text have none. They go once the events are made, as a filter on their chunks would
    be worked out before the rows are shared out, and the pages be parsed there as well.
    """
    none = F.lit(None).cast(PAGE)
    has_text = F.lit(True) if stored else F.size("chunks") > 0
    page = none if stored else F.struct("page_id", "url", "title", "summary", "sitename", "chunks", "hash").cast(PAGE)
    both = F.array(
        F.struct(F.lit(URL).alias("kind"), F.when(has_text, F.col("url")).alias("value"), page.alias("page")),
        F.struct(F.lit(CONTENT).alias("kind"), F.when(has_text, F.col("hash")).alias("value"), none.alias("page")))
    events = rows.select(F.explode(both).alias("e")).select("e.kind", "e.value", "e.page", F.lit(stored).alias("stored"))
    return events.filter(F.col("value").isNotNull())


def stream_ingest_marked(
    store: Store, pages: DataFrame, checkpoint: str, config: IngestConfig = IngestConfig(), embed: Embedder | None = None,
) -> StreamingQuery:
    """Ingest a stream of pages, told apart from stored ones by state. The query runs until it is stopped.

    The session must keep state in RocksDB (``STATE_STORE``). A store that was emptied needs a new
    checkpoint. A run that ends once all input is taken (``availableNow``) would not see its own
    pages again, so it isn't offered; ``processAllAvailable`` waits for the same.
    """
    spark = pages.sparkSession
    if spark.conf.get(STATE_STORE) != ROCKSDB:
        raise ValueError(f"set {STATE_STORE} to {ROCKSDB}")
    ship_package(spark)
    events = _events(parsed_rows(pages, config), False).unionByName(_events(store.stream("webpages"), True))
    told = events.groupBy("kind", "value").transformWithState(
        marks(), f"kind string, value string, page {PAGE}", "append", "none")

    def step(batch: DataFrame, batch_id: int, writer: str) -> None:
        with Scratch(batch.sparkSession) as scratch:
            rows = scratch.write(batch.withColumn("row_id", F.monotonically_increasing_id()), "told")
            found = rows.filter(F.col("kind") == "page").select("row_id", "page.*")
            for kind, column in ((URL, "url"), (CONTENT, "hash")):
                known = rows.filter(F.col("kind") == kind).select(F.col("value").alias(column)).distinct()
                found = found.join(known, column, "left_anti")
            kept = first_wins_pairs(found, ("page_id", "row_id"), save=scratch.write).select("row_id")
            new = scratch.write(found.join(kept, "row_id", "left_semi"), "fresh")
            if not new.isEmpty():
                store_pages(store, new, batch_id, config, embed, writer)

    return start_batches(told, step, checkpoint, {"processingTime": "0 seconds"})
