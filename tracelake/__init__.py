"""Trace analytics on Spark: operators over typed system and network event tables."""

__version__ = "0.1.0"
