"""Grouping, percentiles, sorting and unions shared by the reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.quantiles import exact_quantiles, with_share


def group_and_sum(
    df: DataFrame, group: Sequence[str], value: str = "weight", *, per: Sequence[str] = ("trace_id",)
) -> DataFrame:
    """Sum per group with its percentage of the total; null groups are kept."""
    keys = [*[p for p in per if p not in group], *group]
    summed = df.groupBy(*keys).agg(F.sum(value).alias(value))
    return with_share(summed, list(per), value, "weight_pct")


def percentile_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """count, min, max, mean, p50, p95, p99 and p99.9 with linear interpolation."""
    return exact_quantiles(
        df, keys, value, {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999},
        count="count", minimum="min", maximum="max", mean="mean",
    )


def top(df: DataFrame, order: str, limit: int | None, tiebreak: Sequence[str]) -> DataFrame:
    """Largest first with a unique tie break, so the cut is the same on every run."""
    ordered = df.orderBy(F.col(order).desc(), *[F.col(t).asc() for t in tiebreak])
    return ordered if limit is None else ordered.limit(limit)


def sort_column(name: str | None, allowed: Sequence[str], default: str) -> str:
    """A sort column the report knows, else its default."""
    return name if name in allowed else default


def in_time_order(df: DataFrame) -> DataFrame:
    """Events by trace and time, ties by sequence number."""
    return df.orderBy("trace_id", "ts_us", "seq")


def union_classes(tables: Sequence[DataFrame]) -> DataFrame:
    """Rows of several event classes; columns a class lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, last: bool = False) -> DataFrame:
    """The first (or last) row per key as a partial aggregation rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    return (
        df.groupBy(*keys).agg(pick(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, "_row.*").select(*df.columns)
    )


def key_union(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys found on either side."""
    return left.select(*keys).union(right.select(*keys)).distinct()
