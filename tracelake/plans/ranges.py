"""Point-in-interval joins without a cross product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BIN_BITS = 16
MOST_BINS = 1 << 20  # of one interval: 64 GB at the width above


def containing_interval(
    points: DataFrame,
    intervals: DataFrame,
    keys: Sequence[str],
    *,
    point: str,
    start: str,
    length: str,
    payload: Sequence[str],
    bin_bits: int = BIN_BITS,
) -> DataFrame:
    """The interval with the greatest start among those that contain each distinct point.

    Intervals are listed under every ``2**bin_bits`` wide bin they touch and meet the points in
    an equi-join on the bin, so a task holds the points of one bin only. ``points`` must be
    distinct on ``keys`` and ``point``; points outside every interval keep null payload. An interval of
    more than ``MOST_BINS`` bins, such as a damaged size makes, is an error, not a job without end.
    """
    keys = list(keys)
    width = 2**bin_bits

    first, last = F.expr(f"_start div {width}"), F.expr(f"(_start + _length - 1) div {width}")
    too_long = F.raise_error(F.format_string("an interval at %d is %d long", "_start", "_length")).cast("array<bigint>")
    listed = (
        intervals.where(F.col(length) > 0)
        .select(*keys, F.col(start).alias("_start"), F.col(length).alias("_length"), *payload)
        .withColumn("_bin", F.explode(F.when(F.col("_length") / width > MOST_BINS, too_long).otherwise(F.sequence(first, last))))
    )
    binned = points.withColumn("_bin", F.expr(f"`{point}` div {width}"))
    listed = listed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bin").alias("_k_bin"), "_start", "_length", *payload)
    matches = (F.col("_bin") == F.col("_k_bin")) & (F.col(point) >= F.col("_start"))
    matches = matches & (F.col(point) < F.col("_start") + F.col("_length"))
    for k in keys:
        matches = matches & (F.col(k) == F.col(f"_k_{k}"))
    hits = binned.select(*keys, point, "_bin").join(listed, matches, "left")
    best = F.max_by(
        F.struct(*payload, F.col("_start").alias("_found")),
        F.when(F.col("_start").isNotNull(), F.struct("_start", *payload)),
    )
    return (
        hits.groupBy(*keys, point)
        .agg(best.alias("_best"))
        .select(*keys, point, *[F.col("_best")[c].alias(c) for c in payload],
                F.col("_best")["_found"].alias("interval_start"))
    )
