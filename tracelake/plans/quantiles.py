"""Exact quantiles and shares that never gather a group in one task.

``F.percentile`` keeps every distinct value of a group in one aggregation buffer. Here equal
values are counted first and binned on a logarithmic scale; running counts over the few bins of a
group tell which bins hold a wanted rank. Only the values of those go on. Each such bin is cut again
into ``PARTS`` parts between its own least and greatest value, so values that differ in their last
digits only spread as well, and the parts that hold a wanted rank are put in order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS_PER_DOUBLING = 256
PARTS = 1024


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Equi-join in which null keys match each other; keeps the left copies of the keys."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    condition = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    )
    return left.join(renamed, condition, how).drop(*[f"_r_{k}" for k in keys])


def log_bin(value: Column) -> Column:
    """A bin number that never decreases with ``value``."""
    scaled = F.floor(F.log2(F.abs(value) + 1.0) * F.lit(BINS_PER_DOUBLING))
    return F.when(value < 0, -scaled - 1).otherwise(scaled)


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: Mapping[str, float],
    *,
    kind: str = "linear",
    count: str | None = None,
    mean: str | None = None,
    minimum: str | None = None,
    maximum: str | None = None,
) -> DataFrame:
    """Quantiles of ``value`` per key, nulls ignored.

    ``kind`` is ``linear`` (interpolated at ``q*(n-1)``), ``nearest`` (rank ``ceil(q*n)``) or
    ``index`` (element ``round_half_even(q*(n-1))``). The other names ask for plain statistics
    of the same group.
    """
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    return quantiles_of_counts(
        counted, keys, quantiles, kind=kind, count=count, mean=mean, minimum=minimum, maximum=maximum
    )


def quantiles_of_counts(
    counted: DataFrame,
    keys: Sequence[str],
    quantiles: Mapping[str, float],
    *,
    kind: str = "linear",
    count: str | None = None,
    mean: str | None = None,
    minimum: str | None = None,
    maximum: str | None = None,
) -> DataFrame:
    """:func:`exact_quantiles` of values ``_v`` that occur ``_n`` times, one row per key and value."""
    keys = list(keys)
    n, ranks, result, aggs = F.col("_total"), [], [], []

    def at(rank: Column) -> Column:
        ranks.append(rank)
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_end")), F.col("_v")))

    for i, (name, q) in enumerate(quantiles.items()):
        if kind == "linear":
            position = F.lit(float(q)) * (n - 1)
            low = F.floor(position)
            aggs += [at(low).alias(f"_lo{i}"), at(low + 1).alias(f"_hi{i}")]
            fraction = F.lit(float(q)) * (F.col("_n") - 1) - F.floor(F.lit(float(q)) * (F.col("_n") - 1))
            result.append(
                (F.col(f"_lo{i}") + F.when(fraction > 0, (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * fraction)
                 .otherwise(F.lit(0.0))).alias(name)
            )
        elif kind == "nearest":
            aggs.append(at(F.greatest(F.ceil(F.lit(float(q)) * n), F.lit(1)) - 1).alias(f"_lo{i}"))
            result.append(F.col(f"_lo{i}").alias(name))
        elif kind == "index":
            aggs.append(at(F.bround(F.lit(float(q)) * (n - 1)).cast("long")).alias(f"_lo{i}"))
            result.append(F.col(f"_lo{i}").alias(name))
        else:
            raise ValueError(f"unknown quantile kind: {kind!r}")

    def holds(first: str, size: str) -> Column:
        wanted = F.array(*[r.cast("bigint") for r in ranks])
        return F.exists(wanted, lambda r: (r >= F.col(first)) & (r < F.col(first) + F.col(size)))

    group = Window.partitionBy(*keys)
    earlier = Window.unboundedPreceding, -1
    of_group = {"_total": F.sum("_bn").over(group)}
    for name, column in ((mean, F.sum("_weight").over(group)), (minimum, F.min("_least").over(group)), (maximum, F.max("_most").over(group))):
        if name:
            of_group[f"_x_{name}"] = column
    binned = counted.withColumn("_bin", log_bin(F.col("_v")))
    bins = binned.groupBy(*keys, "_bin").agg(
        F.sum("_n").alias("_bn"), F.min("_v").alias("_least"), F.max("_v").alias("_most"), F.sum(F.col("_v") * F.col("_n")).alias("_weight"),
    ).withColumns({"_base": F.coalesce(F.sum("_bn").over(group.orderBy("_bin").rowsBetween(*earlier)), F.lit(0)), **of_group})
    carried = list(of_group)
    wanted = bins.where(holds("_base", "_bn")).select(*keys, "_bin", "_base", "_least", "_most", *carried)

    share = (F.col("_v") - F.col("_least")) / F.nullif(F.col("_most") - F.col("_least"), F.lit(0.0))
    inner = null_safe_join(binned, wanted, [*keys, "_bin"], "inner").withColumn(
        "_part", F.coalesce(F.least(F.floor(share * PARTS), F.lit(PARTS - 1)), F.lit(0)).cast("int"))
    bin_ = [*keys, "_bin"]
    parts = inner.groupBy(*bin_, "_part").agg(F.sum("_n").alias("_pn"), F.max("_base").alias("_base"), F.max("_total").alias("_total")).withColumn(
        "_first", F.col("_base") + F.coalesce(F.sum("_pn").over(Window.partitionBy(*bin_).orderBy("_part").rowsBetween(*earlier)), F.lit(0)))
    chosen = parts.where(holds("_first", "_pn")).select(*bin_, "_part", "_first")
    inside = Window.partitionBy(*bin_, "_part").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = (
        null_safe_join(inner, chosen, [*bin_, "_part"], "inner")
        .withColumn("_end", F.col("_first") + F.sum("_n").over(inside))
        .withColumn("_start", F.col("_end") - F.col("_n"))
    )
    out = ranked.groupBy(*keys).agg(F.max("_total").alias("_n"), *aggs, *[F.max(c).alias(c) for c in carried if c != "_total"])
    if count:
        result.append(F.col("_n").alias(count))
    if mean:
        result.append((F.col(f"_x_{mean}") / F.col("_n")).alias(mean))
    result += [F.col(f"_x_{c}").alias(c) for c in (minimum, maximum) if c]
    return out.select(*keys, *result)


def with_share(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Add ``value`` as a percentage of its total per ``keys``.

    The total is an aggregation joined back, not an unpartitioned or hot-key window.
    """
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_whole"))
    joined = null_safe_join(df, totals, list(keys), "left")
    share = F.when(F.col("_whole") > 0, F.col(value) / F.col("_whole") * 100.0).otherwise(F.lit(0.0))
    return joined.withColumn(out, share).drop("_whole")
