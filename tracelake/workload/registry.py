"""Registry of queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .derive import Tables, with_tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
DIGITS = 4


def tidy(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round floating columns, so that both engines print the same digits."""
    return df.select(*[
        (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() in ("double", "float") else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])


def query(name: str, check: str | None = None, *, digits: int = DIGITS):
    """Register ``fn(tables) -> DataFrame`` under a name with its check SQL.

    ``digits`` is what the check rounds floating columns to.
    """

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, folder: tidy(fn(Tables(spark, folder)), digits)
        if check is not None:
            CHECKS[name] = with_tables(check)
        return fn

    return register
