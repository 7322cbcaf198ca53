"""Readers, writers and text ingest for event tables."""
