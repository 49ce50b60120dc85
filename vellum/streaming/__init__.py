"""Imports: batches of packages, and streams of changes."""
