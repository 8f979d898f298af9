"""Synthetic graphs as Spark jobs: every value is a hash of (seed, stream, row key)."""
