"""CPU sampling: attribution table, reports, utilisation timeline and denominators.

``meta`` tables hold one row per trace: ``trace_id, origin, freq, duration_s, cpu_count``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import utilisation_role
from ..functions.times import MICROS, time_bucket
from ..plans.lookup import lookup
from ..plans.quantiles import exact_quantiles, with_share
from ..session import durable
from .attribution import resolve_addresses, with_owner, with_process_name
from .filters import any_module_substring, apply_filters, cpu_predicate
from .grouping import group_and_sum, top

IDLE = {"process_name": "Idle", "pid": 0, "module": "<Heuristic Low Power State>", "function": "<C3>"}
SAMPLING_KEYS = ("process_name", "pid", "module", "function", "symbol_source")


def sample_weight() -> Column:
    """Profile weight where positive, else the plain weight, else 1."""
    return (
        F.when(F.col("profile_weight") > 0, F.col("profile_weight"))
        .otherwise(F.coalesce("weight", F.lit(1)))
        .cast("bigint")
    )


def attributed_samples(
    samples: DataFrame,
    *,
    thread: DataFrame,
    process: DataFrame,
    image: DataFrame,
    symbols: DataFrame | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Weights by process, module and function, and by the columns in ``keep`` (such as CPU).

    Samples are summed by their raw identifiers first; names and ranges are looked up on the
    much smaller sums.
    """
    raw = samples.groupBy("trace_id", *keep, "pid", "tid", "payload_tid", "address").agg(
        F.sum(sample_weight()).alias("weight"), F.count(F.lit(1)).alias("samples")
    )
    # both the names and the places below start from these sums
    owned = durable(with_owner(raw, thread).groupBy("trace_id", *keep, "pid", "address").agg(
        F.sum("weight").alias("weight"), F.sum("samples").alias("samples")
    ))
    named = with_process_name(owned, process)
    places = resolve_addresses(owned, image, symbols)
    return (
        named.join(places, ["trace_id", "address"], "left")
        .groupBy("trace_id", *keep, *SAMPLING_KEYS)
        .agg(F.sum("weight").alias("weight"), F.sum("samples").alias("samples"))
    )


def cpu_sampling(samples: DataFrame, **dimensions: DataFrame) -> DataFrame:
    """The CPU sampling table: weight and share per process, module, function and source."""
    table = attributed_samples(samples, **dimensions).drop("samples")
    return with_share(table, ["trace_id"], "weight", "weight_pct")


def capacity_us(meta: DataFrame) -> DataFrame:
    return meta.select("trace_id", (F.col("duration_s") * F.col("cpu_count") * MICROS).alias("capacity"))


def _with_idle(table: DataFrame, idle: DataFrame) -> DataFrame:
    """Append ``idle(trace_id, weight)`` rows and recompute the shares."""
    rows = idle.where(F.col("weight") > 0).select(
        "trace_id", *[F.lit(v).alias(k) for k, v in IDLE.items()],
        F.lit("").alias("symbol_source"), F.col("weight").cast("bigint"),
    ).withColumn("pid", F.col("pid").cast("bigint"))
    columns = ["trace_id", *SAMPLING_KEYS, "weight"]
    return with_share(
        table.select(*columns).unionByName(rows.select(*columns)), ["trace_id"], "weight", "weight_pct"
    )


def idle_top_up(table: DataFrame, meta: DataFrame, *, time_scaled: bool = True) -> DataFrame:
    """Add the time no sample accounts for as an idle row, where weights are time."""
    totals = table.groupBy("trace_id").agg(F.sum("weight").alias("_total"))
    has_idle = table.where(
        (F.col("process_name") == IDLE["process_name"]) & (F.col("module") == IDLE["module"])
    ).select("trace_id").distinct()
    idle = (
        totals.join(capacity_us(meta), "trace_id").join(has_idle, "trace_id", "left_anti")
        .where(F.lit(time_scaled) & (F.col("_total") > 0) & (F.col("_total") < F.col("capacity")))
        .select("trace_id", F.bround(F.col("capacity") - F.col("_total")).alias("weight"))
    )
    return _with_idle(table, idle)


def normalise_capacity(
    table: DataFrame, timeline: DataFrame, meta: DataFrame, *, time_scaled: bool = False
) -> DataFrame:
    """Scale relative weights to time.

    A trace whose total exceeds 1.5 times its capacity is scaled to the busy time of its
    timeline; the rounding residue goes to the heaviest row and the rest becomes idle. Other
    traces get the idle top-up where their weights are time.
    """
    busy = timeline.groupBy("trace_id").agg(
        F.sum((F.col("end_us") - F.col("start_us")) * F.least(F.col("util_pct"), F.lit(100.0)) / 100.0).alias("busy")
    )
    totals = table.groupBy("trace_id").agg(F.sum("weight").cast("double").alias("_total"))
    plan = (
        totals.join(capacity_us(meta), "trace_id", "left").join(busy, "trace_id", "left")
        .withColumn("_over", F.coalesce(F.col("_total") > F.col("capacity") * 1.5, F.lit(False)))
        .withColumn(
            "_target",
            F.least(F.when(F.col("busy") > 0, F.col("busy")).otherwise(F.col("capacity")), F.col("capacity")),
        )
    )
    scaled = (
        table.join(plan.select("trace_id", "_over", "_target", "_total"), "trace_id")
        .withColumn(
            "weight",
            F.when(F.col("_over"), F.bround(F.col("weight") * F.col("_target") / F.col("_total")))
            .otherwise(F.col("weight")).cast("bigint"),
        )
    )
    keys = F.struct(*SAMPLING_KEYS)
    residue = scaled.where("_over").groupBy("trace_id").agg(
        F.max_by(keys, F.struct("weight", *SAMPLING_KEYS)).alias("_top"),
        (F.bround(F.first("_target")) - F.sum("weight")).cast("bigint").alias("_residue"),
    )
    settled = scaled.join(residue, "trace_id", "left").withColumn(
        "weight",
        F.col("weight") + F.when(F.coalesce(keys.eqNullSafe(F.col("_top")), F.lit(False)), F.col("_residue"))
        .otherwise(F.lit(0)),
    )
    has_idle = table.where(F.col("module") == IDLE["module"]).select("trace_id").distinct()
    topped = plan.where(
        ~F.col("_over") & F.lit(time_scaled) & (F.col("_total") < F.col("capacity"))
    ).join(has_idle, "trace_id", "left_anti")
    idle = plan.where(F.col("_over") & (F.col("capacity") - F.col("_target") >= 1)).select(
        "trace_id", F.bround(F.col("capacity") - F.col("_target")).alias("weight")
    ).unionByName(topped.select("trace_id", F.bround(F.col("capacity") - F.col("_total")).alias("weight")))
    return _with_idle(settled, idle)


# ---- timeline -----------------------------------------------------------------------------


def cpu_timeline(
    samples: DataFrame, meta: DataFrame, *, bucket_seconds: float = 1.0, sample_rate_hz: int = 1000
) -> DataFrame:
    """Utilisation per time bucket and CPU, every bucket and CPU present, at most 100 %."""
    width = int(bucket_seconds * MICROS)
    counted = (
        lookup(samples, meta.select("trace_id", "duration_s"), ["trace_id"])
        .where(F.col("cpu").isNotNull() & (F.col("ts_us") <= F.col("duration_s") * MICROS))
        .withColumn("bucket", F.floor(F.greatest(F.col("ts_us"), F.lit(0)) / F.lit(width)))
        .groupBy("trace_id", "bucket", "cpu").agg(F.count(F.lit(1)).alias("samples"))
    )
    last = counted.groupBy("trace_id").agg((F.max("bucket") + 1).alias("_seen"))
    spans = meta.join(last, "trace_id", "left").select(
        "trace_id", "duration_s",
        F.greatest(
            F.ceil(F.col("duration_s") * MICROS / F.lit(width)), F.coalesce("_seen", F.lit(1)), F.lit(1)
        ).cast("bigint").alias("_buckets"),
    )
    cpus = (
        meta.where(F.col("cpu_count") > 0)
        .select("trace_id", F.explode(F.sequence(F.lit(0), F.col("cpu_count").cast("int") - 1)).alias("cpu"))
        .union(counted.select("trace_id", "cpu")).distinct()
    )
    grid = spans.join(cpus, "trace_id").select(
        "trace_id", "duration_s", "cpu",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_buckets") - 1)).alias("bucket"),
    )
    start = (F.col("bucket") * width).cast("bigint")
    end = F.bround(F.least((F.col("bucket") + 1) * F.lit(float(width)), F.col("duration_s") * MICROS)).cast("bigint")
    joined = grid.join(counted, ["trace_id", "bucket", "cpu"], "left").withColumns(
        {"start_us": start, "end_us": end, "samples": F.coalesce("samples", F.lit(0))}
    )
    seconds = (F.col("end_us") - F.col("start_us")) / float(MICROS)
    seconds = F.when(seconds > 0, seconds).otherwise(F.lit(float(bucket_seconds)))
    util = F.least(F.col("samples") / (seconds * float(sample_rate_hz)) * 100.0, F.lit(100.0))
    return joined.select("trace_id", "start_us", "end_us", "cpu", "samples", F.round(util, 2).alias("util_pct"))


def _in_range(timeline: DataFrame, start_time: float | None, end_time: float | None) -> DataFrame:
    if start_time is not None:
        timeline = timeline.where(F.col("start_us") >= round(start_time * MICROS))
    if end_time is not None:
        timeline = timeline.where(F.col("end_us") <= round(end_time * MICROS))
    return timeline


def per_cpu_summary(
    timeline: DataFrame, *, start_time: float | None = None, end_time: float | None = None
) -> DataFrame:
    """Average and peak utilisation, role and activity (2 % or more) of each CPU."""
    return (
        _in_range(timeline, start_time, end_time).groupBy("trace_id", "cpu")
        .agg(F.avg("util_pct").alias("avg_util"), F.max("util_pct").alias("max_util"))
        .withColumns({"role": utilisation_role(F.col("avg_util")), "active": F.col("avg_util") >= 2.0})
    )


def timeline_report(
    timeline: DataFrame, *, cpu_filter: str | None = None,
    start_time: float | None = None, end_time: float | None = None,
) -> DataFrame:
    """The utilisation rows in range, with a mark on CPUs at 10 % or more in the first bucket."""
    rows = _in_range(timeline, start_time, end_time)
    if (wanted := cpu_predicate(cpu_filter)) is not None:
        rows = rows.where(wanted)
    first = rows.groupBy("trace_id", "cpu").agg(F.min_by("util_pct", "start_us").alias("_first"))
    return rows.join(first, ["trace_id", "cpu"]).select(
        *timeline.columns, (F.col("_first") >= 10.0).alias("hot_cpu")
    )


def timeline_matrix(timeline: DataFrame, cpus: Sequence[int]) -> DataFrame:
    """Wide form with one column per listed CPU."""
    return timeline.groupBy("trace_id", "start_us", "end_us").pivot("cpu", list(cpus)).agg(F.first("util_pct"))


def weight_timeline(
    samples: DataFrame, *, bucket_seconds: float = 1.0, cpu_filter: str | None = None,
    start_time: float | None = None, end_time: float | None = None,
) -> DataFrame:
    """Sample weight per time bucket (bucket start in seconds)."""
    rows = apply_filters(samples, cpu_filter=cpu_filter, start_time=start_time, end_time=end_time)
    return (
        rows.where(F.col("ts_us").isNotNull())
        .groupBy("trace_id", time_bucket(F.col("ts_us") / float(MICROS), bucket_seconds).alias("time_s"))
        .agg(F.sum("weight").alias("weight"))
    )


def steady_state(weights: DataFrame, *, bucket_seconds: float = 1.0) -> DataFrame:
    """First to last bucket within 20 % of the median weight, for traces of over 3 buckets."""
    middle = exact_quantiles(weights, ["trace_id"], "weight", {"median": 0.5}, count="buckets")
    return (
        weights.join(middle, "trace_id")
        .where((F.col("buckets") > 3) & (F.abs(F.col("weight") - F.col("median")) < F.col("median") * 0.2))
        .groupBy("trace_id")
        .agg(F.min("time_s").alias("steady_start_s"), (F.max("time_s") + bucket_seconds).alias("steady_end_s"))
    )


# ---- reports ------------------------------------------------------------------------------

GROUPINGS = {
    "process": ("process_name",),
    "module": ("module",),
    "function": ("module", "function"),
    "process+module": ("process_name", "module"),
    "cpu": ("cpu",),
    "cpu+process": ("cpu", "process_name"),
}


def cpu_samples(samples: DataFrame, *, group_by: str = "module", limit: int | None = None, **filters) -> DataFrame:
    """Weight and share by process, module, function, CPU or a pair of them."""
    group = GROUPINGS.get(group_by, GROUPINGS["module"])
    result = group_and_sum(apply_filters(samples, **filters), group)
    return result if limit is None else top(result, "weight", limit, ["trace_id", *group])


def cpu_usage_scalars(timeline: DataFrame, meta: DataFrame, *, cpu_filter: str | None = None) -> DataFrame:
    """Per trace: CPUs, active CPUs (2 % or more, or all asked for) and their mean utilisation."""
    per_cpu = timeline.groupBy("trace_id", "cpu").agg(F.avg("util_pct").alias("_avg"))
    asked = cpu_predicate(cpu_filter)
    active = asked if asked is not None else F.col("_avg") >= 2.0
    return (
        per_cpu.groupBy("trace_id")
        .agg(
            F.count(F.lit(1)).alias("total_lps"),
            F.count(F.when(active, True)).alias("active_lps"),
            F.avg(F.when(active, F.col("_avg"))).alias("active_avg"),
        )
        .join(meta.select("trace_id", "duration_s"), "trace_id", "left")
    )


def with_denominator(
    totals: DataFrame, usage: DataFrame | None, *, base: str, denominator: str = "trace",
    lps: int | None = None, seconds: float | None = None, out: str = "denominator",
) -> DataFrame:
    """Add the weight that stands for 100 %: whole trace, active CPUs, their busy time or custom."""
    kind = (denominator or "trace").lower()
    if kind == "trace":
        return totals.withColumn(out, F.col(base).cast("double"))
    if kind not in ("active_cpus", "active_busy", "custom"):
        raise ValueError("denominator must be one of: trace, active_cpus, active_busy, custom")
    if kind == "custom" and not (lps and seconds):
        raise ValueError("denominator 'custom' needs lps and seconds")
    if usage is None:
        return totals.withColumn(out, F.col(base).cast("double"))
    ratio = F.col("active_lps") / F.col("total_lps")
    if kind == "active_busy":
        ratio = ratio * F.col("active_avg") / 100.0
    if kind == "custom":
        ratio = F.lit(float(lps) * float(seconds)) / F.when(
            F.col("duration_s") > 0, F.col("total_lps") * F.col("duration_s")
        )
    usable = F.when(F.coalesce(ratio, F.lit(0.0)) > 0, ratio).otherwise(F.lit(1.0))
    extra = [c for c in usage.columns if c != "trace_id"]
    return totals.join(usage, "trace_id", "left").withColumn(out, F.col(base) * usable).drop(*extra)


def hot_functions(
    samples: DataFrame, *, modules: str | Sequence[str] | None = None, denominator: str = "trace",
    usage: DataFrame | None = None, lps: int | None = None, seconds: float | None = None,
    limit: int | None = None, **filters,
) -> DataFrame:
    """Weight by function of the chosen modules, as a share of all samples' denominator."""
    rows = apply_filters(samples, **filters)
    totals = with_denominator(
        rows.groupBy("trace_id").agg(F.sum("weight").alias("_all")), usage,
        base="_all", denominator=denominator, lps=lps, seconds=seconds,
    )
    wanted = any_module_substring(F.col("module"), modules)
    chosen = rows if wanted is None else rows.where(wanted)
    result = group_and_sum(chosen, ["module", "function"]).join(
        totals.select("trace_id", "denominator"), "trace_id"
    )
    result = result.withColumn("denominator_pct", F.col("weight") / F.col("denominator") * 100.0)
    return result if limit is None else top(result, "weight", limit, ["trace_id", "module", "function"])


# Function patterns of the threshold checks.
CHECK_PATTERNS = {
    "clone": "NdisAllocateClone|NdisFreeClone|CloneNetBuffer",
    "spinlock": "KeAcquireInStackQueuedSpinLock|KeAcquireSpinLock|SpinLock",
    "drain": "XdpCpuMapDrainDpc",
    "enqueue": "XdpCpuMapFlushBatch",
    "inspect": "XdpInspect|XdpParseFrame",
}


def threshold_checks(
    samples: DataFrame, *, patterns: dict[str, str] = CHECK_PATTERNS, base_module: str = "xdp",
    limits: dict[str, float] | None = None,
) -> DataFrame:
    """Weight shares of function classes against limits, one row per trace and check.

    ``clone`` is a share of the base module's weight, every other check of all weight.
    """
    limits = {"clone": 10.0, "spinlock": 10.0} if limits is None else limits
    sums = samples.groupBy("trace_id").agg(
        F.sum("weight").alias("_all"),
        F.sum(F.when(F.lower("module").contains(base_module), F.col("weight"))).alias("_base"),
        *[
            F.sum(F.when(F.col("function").rlike(f"(?i){p}"), F.col("weight")).otherwise(0)).alias(f"_{n}")
            for n, p in patterns.items()
        ],
    )
    rows = F.array(*[
        F.struct(
            F.lit(name).alias("check"),
            F.coalesce(
                F.col(f"_{name}") / F.when(F.col("_base" if name == "clone" else "_all") > 0,
                                           F.col("_base" if name == "clone" else "_all")) * 100.0,
                F.lit(0.0),
            ).alias("pct"),
            F.lit(limits.get(name)).cast("double").alias("limit_pct"),
        )
        for name in patterns
    ])
    return sums.select("trace_id", F.explode(rows).alias("_r")).select(
        "trace_id", "_r.*", F.coalesce(F.col("_r.pct") > F.col("_r.limit_pct"), F.lit(False)).alias("above")
    )
