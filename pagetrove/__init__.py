"""Site search on Spark: page ingest, chunk and vector tables, query, ranking and paging."""

from pagetrove.config import IngestConfig, RankWeights, SearchConfig

__all__ = ["IngestConfig", "RankWeights", "SearchConfig"]
