"""Composed pipelines, and the registry of queries."""
