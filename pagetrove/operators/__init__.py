"""DataFrame operators: chunking, dedup, links, embedding, vector search, ranking, store."""
