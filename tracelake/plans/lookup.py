"""Joins against dimension tables that hold one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def lookup(facts: DataFrame, dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of facts to a one-row-per-key dimension.

    The sides are left to adaptive execution, which knows their bytes when it chooses: a dimension under
    the session's threshold is broadcast, also one that an aggregation has just made small, and beyond
    that a partition of facts that a heavy key has filled is split, with the few dimension rows of that
    partition read by every part. Nothing is counted beforehand and no dimension row is multiplied for
    keys that are not heavy. Facts with a null key keep null columns.
    """
    return facts.join(dimension, list(keys), "left")
