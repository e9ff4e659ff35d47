"""Streaming jobs: incremental ingest and link discovery."""

from pagetrove.streaming.jobs import stream_frontier, stream_ingest
from pagetrove.streaming.known_pages import stream_ingest_marked

__all__ = ["stream_frontier", "stream_ingest", "stream_ingest_marked"]
