"""Readers and writers."""
from aisle.sources.readers import read_catalog, read_processed, read_queries, read_vectors
from aisle.sources.writers import write_catalog, write_report, write_vectors

__all__ = [
    "read_catalog", "read_processed", "read_queries", "read_vectors",
    "write_catalog", "write_report", "write_vectors",
]
