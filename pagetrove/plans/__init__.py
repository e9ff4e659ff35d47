"""Whole jobs: ingest, search, serve, frontier, reset."""
