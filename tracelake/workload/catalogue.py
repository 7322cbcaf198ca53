"""Imports every query module, so that the registry is complete."""

from . import (  # noqa: F401
    cpu_queries, live_queries, network_queries, packet_queries, report_queries, scalar_queries, stack_queries,
    store_queries, text_queries,
)
from .registry import CHECKS, QUERIES  # noqa: F401
