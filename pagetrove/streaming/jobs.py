"""Incremental ingest and link discovery over a stream of pages.

The state of both jobs is the stored table itself, so a stream may stop for a week and go
on, and a batch that is replayed after a failure replaces its own rows. Batches are stored
under the id that Spark keeps in the stream's checkpoint: a stream that starts afresh, or
another stream, numbers its batches from 0 again without touching what is stored.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagetrove.config import IngestConfig
from pagetrove.operators.embed import Embedder
from pagetrove.operators.store import Store
from pagetrove.plans.frontier import new_links
from pagetrove.plans.ingest import ingest


def start_batches(pages: DataFrame, step, checkpoint: str, trigger: dict | None) -> StreamingQuery:
    """Run ``step(batch, batch_id, writer)`` for each micro-batch."""
    known, writer = Event(), []

    def run(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        step(batch, batch_id, writer[0])

    started = pages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    query = started.trigger(**(trigger or {"availableNow": True})).start()
    writer.append(f"stream-{query.id}")
    known.set()
    return query


def stream_ingest(
    store: Store, pages: DataFrame, checkpoint: str, config: IngestConfig = IngestConfig(),
    embed: Embedder | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Ingest each micro-batch of ``pages``; pages already stored change nothing."""
    return start_batches(pages, lambda batch, i, writer: ingest(store, batch, i, config, embed, writer), checkpoint, trigger)


def stream_frontier(
    store: Store, pages: DataFrame, checkpoint: str, case_sensitive: bool = False, trigger: dict | None = None,
) -> StreamingQuery:
    """Append the links each micro-batch discovers to the store's link table."""

    def step(batch: DataFrame, batch_id: int, writer: str) -> None:
        earlier = store.read_others("links", batch_id, writer)
        known = earlier.select("url").unionByName(store.all_urls())
        links = new_links(batch, known, case_sensitive=case_sensitive)
        store.append("links", links.withColumn("depth", F.col("depth").cast("int")), batch_id, writer)

    return start_batches(pages, step, checkpoint, trigger)
