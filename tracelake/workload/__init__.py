"""Queries over the driver tables: event tables derived from them and SQL for each result."""
