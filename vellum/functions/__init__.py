"""Column-level building blocks (no shuffles, no Python UDFs)."""
