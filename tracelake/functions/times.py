"""Clocks, tick conversion and duration text."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def ticks_to_us(ticks: Column, origin: Column, frequency: Column) -> Column:
    """Ticks as relative whole microseconds, rounded half to even."""
    return F.bround((ticks - origin).cast("double") * float(MICROS) / frequency).cast("bigint")


def tick_bounds(
    start_s: float | None, end_s: float | None, origin: int, frequency: int
) -> tuple[int | None, int | None]:
    """Inclusive tick range for a range in seconds, as literals a scan can push down."""
    low = None if start_s is None else origin + math.ceil(start_s * frequency)
    high = None if end_s is None else origin + math.floor(end_s * frequency)
    return low, high


def time_bucket(t: Column, width: float) -> Column:
    """Start of the bucket that holds ``t`` (times are not negative)."""
    return F.floor(t / F.lit(float(width))) * F.lit(float(width))


def duration_text_to_us(text: Column) -> Column:
    """``12.5us``, ``3 ms``, ``40ns``, ``1.5s`` or a bare number of microseconds."""
    clean = F.regexp_replace(F.lower(F.trim(text.cast("string"))), ",", "")
    number = F.regexp_extract(clean, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)\s*(us|µs|ms|ns|s)?$", 1)
    unit = F.regexp_extract(clean, r"^([-+]?[0-9]*\.?[0-9]+(?:e[-+]?[0-9]+)?)\s*(us|µs|ms|ns|s)?$", 2)
    value = F.when(number != "", number).try_cast("double")
    return (
        F.when(unit == "ms", value * 1000.0)
        .when(unit == "ns", value / 1000.0)
        .when(unit == "s", value * float(MICROS))
        .otherwise(value)
    )


def clock_text_to_seconds(text: Column) -> Column:
    """``H:MM:SS.f``, ``M:SS`` or ``12.3s`` as seconds."""
    clean = F.regexp_replace(F.lower(F.trim(text.cast("string"))), r",|\s*s$", "")
    parts = F.split(clean, ":")
    return F.aggregate(
        parts,
        F.lit(0.0),
        lambda acc, part: acc * 60.0 + part.try_cast("double"),
    )
