"""Traversal operators on DataFrames."""
