"""Deferred procedure calls and interrupts: durations, CPUs, dispatch quality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import bucket_high, bucket_low, duration_bucket
from ..functions.times import MICROS
from ..plans.quantiles import with_share
from .attribution import resolve_addresses
from .filters import (
    NETWORK_KERNEL_MODULES, NETWORK_MODULES, contains_text, in_modules, matches_module, receive_path,
)

ALL_MODULES = "(all)"


def duration_us(freq: Column | None = None) -> Column:
    """Duration of an interrupt row, from its start and end ticks where it is missing."""
    if freq is None:
        return F.col("duration_us")
    ticks = (F.col("qpc") - F.col("initial_qpc")) * float(MICROS) / freq
    return F.coalesce("duration_us", ticks)


def with_routine_module(sums: DataFrame, image: DataFrame) -> DataFrame:
    """Add the module of each routine to rows already summed by routine."""
    places = resolve_addresses(sums.select("trace_id", F.col("routine").alias("address")), image)
    return sums.join(
        places.select("trace_id", F.col("address").alias("routine"), "module"), ["trace_id", "routine"], "left"
    )


def duration_histogram(events: DataFrame) -> DataFrame:
    """Rows per module and log-2 duration bucket with the share within the module.

    ``(all)`` rows hold every module. ``events`` has ``trace_id, module, duration_us`` and may
    hold pre-counted rows in ``n``.
    """
    n = F.sum("n") if "n" in events.columns else F.count(F.lit(1))
    base = events.where(F.col("duration_us").isNotNull()).groupBy(
        "trace_id", F.coalesce("module", F.lit("<unknown>")).alias("module"),
        duration_bucket(F.col("duration_us")).alias("bucket"),
    ).agg(n.alias("events"))
    whole = base.groupBy("trace_id", F.lit(ALL_MODULES).alias("module"), "bucket").agg(F.sum("events").alias("events"))
    counts = base.unionByName(whole)
    shared = with_share(counts, ["trace_id", "module"], "events", "pct")
    return shared.select(
        "trace_id", "module", bucket_low(F.col("bucket")).alias("low_us"),
        bucket_high(F.col("bucket")).alias("high_us"), "events", "pct",
    )


def _share(flag: Column) -> Column:
    return F.sum(F.when(flag, F.col("events")).otherwise(F.lit(0))) / F.sum("events") * 100.0


def dpc_summary(histogram: DataFrame, *, module_filter: str | None = None) -> DataFrame:
    """Per module: count, shares of the short, middle and long buckets, largest bucket.

    ``mid_pct`` holds the 8 to 16 µs bucket only, as bucket bounds must lie in 5 to 20.
    """
    rows = histogram.where(F.col("module") != ALL_MODULES)
    if module_filter not in (None, ""):
        rows = rows.where(matches_module(F.col("module"), module_filter))
    return rows.groupBy("trace_id", "module").agg(
        F.sum("events").alias("events"),
        _share(F.col("high_us") <= 5).alias("short_pct"),
        _share((F.col("low_us") >= 5) & (F.col("high_us") <= 20)).alias("mid_pct"),
        _share(F.col("low_us") >= 16).alias("long_pct"),
        F.max(F.when(F.col("events") > 0, F.col("high_us"))).alias("max_bucket_us"),
    )


def dpc_health(histogram: DataFrame) -> DataFrame:
    """Whole-trace duration shares and the warning above 1 % at 16 µs or more."""
    shares = histogram.where(F.col("module") != ALL_MODULES).groupBy("trace_id").agg(
        F.sum("events").alias("events"),
        _share(F.col("high_us") <= 4).alias("healthy_pct"),
        _share((F.col("low_us") >= 4) & (F.col("high_us") <= 32)).alias("moderate_pct"),
        _share(F.col("low_us") >= 16).alias("elevated_pct"),
    )
    return shares.withColumn("warning", F.col("elevated_pct") > 1.0)


def dpc_exact_shares(events: DataFrame) -> DataFrame:
    """Shares below 5, 5 to 20 and above 20 µs from the durations themselves."""
    d = F.col("duration_us")

    def share(flag: Column) -> Column:
        return F.count(F.when(flag, True)) / F.count(F.lit(1)) * 100.0

    return events.where(d.isNotNull()).groupBy("trace_id", "module").agg(
        F.count(F.lit(1)).alias("events"), share(d < 5).alias("below_5_pct"),
        share((d >= 5) & (d <= 20)).alias("from_5_to_20_pct"), share(d > 20).alias("above_20_pct"),
    )


def dpc_per_cpu(events: DataFrame, meta: DataFrame) -> DataFrame:
    """Time, count and share of trace time per module and CPU; negative CPUs are dropped."""
    n = F.sum("n") if "n" in events.columns else F.count(F.lit(1))
    sums = events.where(F.col("cpu") >= 0).groupBy(
        "trace_id", F.coalesce("module", F.lit("<unknown>")).alias("module"), "cpu"
    ).agg(F.sum("duration_us").alias("dpc_us"), n.alias("events"))
    length = F.col("duration_s") * float(MICROS)
    return sums.join(meta.select("trace_id", "duration_s"), "trace_id", "left").withColumn(
        "pct", F.when(length > 0, F.col("dpc_us") / length * 100.0).otherwise(F.lit(0.0))
    ).drop("duration_s")


def dpc_cpu_report(per_cpu: DataFrame, *, module_filter: str | None = None) -> DataFrame:
    """Per module: total time, CPUs that served it and the busiest of them."""
    rows = per_cpu
    if module_filter not in (None, ""):
        rows = rows.where(matches_module(F.col("module"), module_filter))
    busiest = F.max_by(F.struct("cpu", "dpc_us"), F.struct(F.col("dpc_us"), -F.col("cpu")))
    return rows.groupBy("trace_id", "module").agg(
        F.sum("dpc_us").alias("dpc_us"), F.sum("events").alias("events"),
        F.count(F.when(F.col("dpc_us") > 0, True)).alias("active_cpus"), busiest.alias("_b"),
    ).select(
        "trace_id", "module", "dpc_us", "events", "active_cpus",
        F.col("_b.cpu").alias("top_cpu"), F.col("_b.dpc_us").alias("top_cpu_us"),
    )


def dpc_from_samples(sampling: DataFrame, *, module_filter: str | None = None) -> DataFrame:
    """Weight and share per module from CPU samples, for traces without interrupt events.

    An approximation: samples do not say whether a module ran as a deferred call.
    """
    rows = sampling
    if module_filter not in (None, ""):
        rows = rows.where(contains_text(F.col("module"), module_filter))
    sums = rows.groupBy("trace_id", "module").agg(F.sum("weight").alias("weight"))
    return with_share(sums, ["trace_id"], "weight", "pct")


def network_cpus(per_cpu: DataFrame, modules: Iterable[str] = NETWORK_KERNEL_MODULES) -> DataFrame:
    """CPUs on which a network module's calls ran."""
    return per_cpu.where(in_modules(F.col("module"), modules)).select("trace_id", "cpu").distinct()


def _by_process_and_cpu(samples: DataFrame, served: DataFrame, flag: Column) -> DataFrame:
    sums = samples.groupBy("trace_id", "process_name", "cpu").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("weight").alias("weight"),
        F.count(F.when(flag, True)).alias("flagged"),
    )
    return sums.join(served.withColumn("_served", F.lit(True)), ["trace_id", "cpu"], "left")


def _cpu_count(served: DataFrame) -> DataFrame:
    return served.groupBy("trace_id").agg(F.count(F.lit(1)).alias("served_cpus"))


def dispatch_quality(samples: DataFrame, served: DataFrame, *, min_samples: int = 100) -> DataFrame:
    """Per process with at least ``min_samples`` network samples: the share of its weight on CPUs
    that also served network calls, and the rest."""
    rows = _by_process_and_cpu(samples, served, in_modules(F.col("module"), NETWORK_MODULES))
    same = F.sum(F.when(F.col("_served"), F.col("weight")).otherwise(F.lit(0))) / F.sum("weight") * 100.0
    result = rows.groupBy("trace_id", "process_name").agg(
        F.sum("samples").alias("samples"), F.sum("flagged").alias("network_samples"),
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("recv_cpus"),
        F.array_join(F.array_sort(F.collect_set("cpu")), ",").alias("recv_cpu_list"),
        same.alias("same_cpu_pct"),
    )
    result = result.where((F.col("network_samples") >= min_samples) & (F.col("weight") > 0))
    return result.join(_cpu_count(served), "trace_id").withColumn("cross_cpu_pct", 100.0 - F.col("same_cpu_pct"))


def receive_dispatch_quality(samples: DataFrame, served: DataFrame, *, min_samples: int = 25) -> DataFrame:
    """As :func:`dispatch_quality`, over datagram receive-path samples only."""
    rows = samples.where(receive_path(F.col("module"), F.col("function")))
    rows = _by_process_and_cpu(rows, served, F.lit(True))
    cross = F.sum(F.when(F.col("_served").isNull(), F.col("weight")).otherwise(F.lit(0))) / F.sum("weight") * 100.0
    result = rows.groupBy("trace_id", "process_name").agg(
        F.sum("samples").alias("samples"), F.sum("weight").alias("weight"),
        F.count(F.lit(1)).alias("recv_cpus"),
        F.array_join(F.array_sort(F.collect_set("cpu")), ",").alias("recv_cpu_list"), cross.alias("_cross"),
    ).where((F.col("samples") >= min_samples) & (F.col("weight") > 0))
    result = result.join(_cpu_count(served), "trace_id", "left").fillna(0, ["served_cpus"])
    return result.withColumn("cross_cpu_pct", F.when(F.col("served_cpus") > 0, F.col("_cross"))).drop("_cross")


def queue_arrivals(per_cpu: DataFrame, meta: DataFrame, nic_module: str = "mlx5.sys") -> DataFrame:
    """Spread of one driver's calls over CPUs against an even spread."""
    rows = per_cpu.where(contains_text(F.col("module"), nic_module)).groupBy("trace_id", "cpu").agg(
        F.sum("dpc_us").alias("dpc_us")
    )
    totals = rows.groupBy("trace_id").agg(
        F.sum("dpc_us").alias("total_us"), F.count(F.when(F.col("dpc_us") > 0, True)).alias("active_cpus")
    ).join(meta.select("trace_id", F.col("cpu_count").alias("total_cpus")), "trace_id", "left")
    return rows.join(totals, "trace_id").where(F.col("total_us") > 0).withColumns({
        "pct": F.col("dpc_us") / F.col("total_us") * 100.0,
        "mean_active_us": F.col("total_us") / F.col("active_cpus"),
        "even_us": F.col("total_us") / F.col("total_cpus"),
    })
