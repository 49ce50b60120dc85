"""Document knowledge base on Spark: ingest, gates, identity, search, retrieval."""
