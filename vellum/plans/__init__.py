"""Multi-operator jobs: batch import, retrieval facade, backfills."""
