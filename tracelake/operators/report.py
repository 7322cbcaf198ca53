"""Trace metadata, symbol quality, memory, disks, comparison and the combined report."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import basename
from ..plans.quantiles import with_share
from .cpu import hot_functions, per_cpu_summary
from .filters import any_module_substring, contains_text
from .grouping import first_per_key, top
from .interrupts import dpc_health

LOW_CONFIDENCE = ("EXPORT_ONLY", "MISMATCHED_PDB")


def disk_summary(disk_io: DataFrame) -> DataFrame:
    """Reads, writes and flushes per disk with their bytes."""
    kind = F.lower(F.regexp_replace("kind", "(?i)^diskio[/_]", ""))

    def count(name: str) -> Column:
        return F.count(F.when(kind == name, True))

    def size(name: str) -> Column:
        return F.sum(F.when(kind == name, F.col("transfer_size")).otherwise(F.lit(0)))

    return disk_io.groupBy("trace_id", "disk_number").agg(
        count("read").alias("reads"), size("read").alias("read_bytes"),
        count("write").alias("writes"), size("write").alias("write_bytes"),
        count("flushbuffers").alias("flushes"),
    )


def process_table(process: DataFrame, *, process_filter: str | None = None) -> DataFrame:
    """The last record of each process."""
    rows = first_per_key(process, ["trace_id", "pid"], ["qpc", "seq"], last=True)
    return rows.where(contains_text(F.col("image_file_name"), process_filter)) if process_filter else rows


def memory_pools(
    pools: DataFrame, *, tag_filter: str | None = None, module_filter: str | None = None,
    pool_type: str | None = None, sort_by: str = "bytes", limit: int | None = None,
) -> DataFrame:
    """Pool allocations with their share of the outstanding bytes of the filtered rows.

    ``pools`` has ``trace_id, pool_type, module, tag, allocs, alloc_kb, outstanding,
    outstanding_kb``.
    """
    rows = pools
    if tag_filter:
        rows = rows.where(contains_text(F.col("tag"), tag_filter))
    if module_filter:
        rows = rows.where(contains_text(F.col("module"), module_filter))
    if pool_type:
        kind = pool_type.lower()
        wanted = "NX" if "nx" in kind else "NonPaged" if "non" in kind else "Paged" if "paged" in kind else ""
        rows = rows.where(contains_text(F.col("pool_type"), wanted))
    shared = with_share(rows, ["trace_id"], "outstanding_kb", "outstanding_pct").withColumn(
        "frees", F.col("allocs") - F.col("outstanding")
    )
    order = {"bytes": "outstanding_kb", "allocs": "allocs", "total": "alloc_kb"}.get(sort_by, "outstanding_kb")
    return shared if limit is None else top(shared, order, limit, ["trace_id", "pool_type", "module", "tag"])


def trace_metadata(header: DataFrame) -> DataFrame:
    """One row per trace: the first positive value of each header field, lost events summed."""
    fields = ("perf_freq", "cpu_count", "timer_resolution", "start_time", "end_time", "boot_time",
              "cpu_mhz", "pointer_size", "buffers_written")
    rows = header.groupBy("trace_id").agg(
        *[F.min_by(f, F.when(F.col(f) > 0, F.struct("qpc", "seq"))).alias(f) for f in fields],
        F.sum("events_lost").alias("events_lost"), F.min("qpc").alias("origin"),
    )
    seconds = F.when(
        F.col("end_time") > F.col("start_time"), (F.col("end_time") - F.col("start_time")) / 1e7
    )
    return rows.withColumn("duration_s", seconds)


def infer_metadata(events: DataFrame, *, default_freq: int = 10_000_000) -> DataFrame:
    """Origin, frequency, duration and CPU count from the events of traces without a header."""
    spans = events.groupBy("trace_id").agg(
        F.min("qpc").alias("origin"), (F.max("qpc") - F.min("qpc")).alias("_span"),
        (F.max("cpu") + 1).cast("int").alias("cpu_count"),
    )
    return spans.select(
        "trace_id", "origin", F.lit(default_freq).cast("bigint").alias("freq"),
        (F.col("_span") / float(default_freq)).alias("duration_s"), "cpu_count",
    )


def class_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows, first and last tick per trace and event class."""
    parts = [
        t.groupBy("trace_id").agg(
            F.lit(name).alias("event_class"), F.count(F.lit(1)).alias("rows"),
            F.min("qpc").alias("first_qpc"), F.max("qpc").alias("last_qpc"),
        ).select("trace_id", "event_class", "rows", "first_qpc", "last_qpc")
        for name, t in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def provider_counts(events: DataFrame, *, provider: str = "provider", providers: Sequence[str] | None = None) -> DataFrame:
    """Events per provider."""
    rows = events.where(F.col(provider).isin(list(providers))) if providers else events
    return rows.groupBy("trace_id", F.col(provider).alias("provider")).agg(F.count(F.lit(1)).alias("events"))


def symbol_quality(sampling: DataFrame) -> DataFrame:
    """Weight per module by where its names come from, and the verdict on them."""
    source = F.lower(F.coalesce("symbol_source", F.lit("")))
    function = F.coalesce("function", F.lit(""))
    named = ~F.lower(function).isin("", "unknown", "***unknown***") & ~function.startswith("+0x")
    no_source = source.isin("", "unknown")

    def weight(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("weight")).otherwise(F.lit(0)))

    rows = sampling.groupBy("trace_id", "module").agg(
        F.count(F.lit(1)).alias("functions"), F.sum("weight").alias("weight"),
        weight(source == "pdb").alias("pdb"), weight(source == "mismatched").alias("mismatched"),
        weight(source == "export").alias("export"), weight(no_source & named).alias("pre_resolved"),
        weight(no_source & ~named).alias("unknown"),
    )
    whole = F.col("pdb") + F.col("mismatched") + F.col("export") + F.col("pre_resolved") + F.col("unknown")

    def pct(name: str) -> Column:
        return F.when(whole > 0, F.col(name) / whole * 100.0).otherwise(F.lit(0.0))

    rows = rows.withColumns({f"{n}_pct": pct(n) for n in ("pdb", "mismatched", "export", "pre_resolved")})
    p, m, e, r = (F.col(f"{n}_pct") for n in ("pdb", "mismatched", "export", "pre_resolved"))
    status = (
        F.when(p >= 90, F.lit("OK"))
        .when((m >= 50) & (p < 10), F.lit("MISMATCHED_PDB"))
        .when((e >= 90) & (p < 10), F.lit("EXPORT_ONLY"))
        .when((r >= 90) & (p < 10) & (e < 10) & (m < 10), F.lit("PRE_RESOLVED"))
        .when(whole - F.col("unknown") > 0, F.lit("PARTIAL"))
        .otherwise(F.lit("MISSING"))
    )
    return rows.withColumn("status", status)


def low_confidence_modules(sampling: DataFrame) -> DataFrame:
    """Modules whose names come almost only from exports, or from a mismatched build."""
    source = F.lower(F.coalesce("symbol_source", F.lit("")))

    def weight(*names: str) -> Column:
        return F.sum(F.when(source.isin(*names), F.col("weight")).otherwise(F.lit(0)))

    rows = sampling.where(F.trim("module") != "").groupBy("trace_id", F.lower("module").alias("module_key")).agg(
        weight("pdb").alias("_p"), weight("export").alias("_e"), weight("mismatched").alias("_m"),
        weight("pdb", "export", "mismatched", "unknown", "").alias("_all"),
    ).where(F.col("_all") > 0)
    no_pdb = F.col("_p") / F.col("_all") * 100.0 < 10
    doubtful = (F.col("_e") / F.col("_all") * 100.0 >= 90) | (F.col("_m") / F.col("_all") * 100.0 >= 50)
    return rows.where(no_pdb & doubtful).select("trace_id", "module_key")


def mark_low_confidence(df: DataFrame, doubtful: DataFrame) -> DataFrame:
    """Prefix ``*`` to function names of low-confidence modules."""
    flagged = doubtful.withColumn("_flag", F.lit(True))
    joined = df.withColumn("module_key", F.lower("module")).join(flagged, ["trace_id", "module_key"], "left")
    return joined.withColumn(
        "function", F.when(F.col("_flag"), F.concat(F.lit("*"), "function")).otherwise(F.col("function"))
    ).select(*df.columns)


def module_entities(image: DataFrame, *, name_filter: str | None = None) -> DataFrame:
    """Distinct loaded modules by name, version (stamp and size) and base, with a stable key."""
    version = F.concat(
        F.lit("tds="), F.lpad(F.lower(F.hex(F.coalesce("time_date_stamp", F.lit(0)))), 8, "0"),
        F.lit(";size="), F.coalesce("image_size", F.lit(0)).cast("string"),
    )
    rows = image.where(F.lower("type").isin("load", "dcstart")).select(
        "trace_id", basename(F.col("file_name")).alias("name"), version.alias("version"),
        F.col("file_name").alias("path"), "image_base", F.col("qpc").alias("load_qpc"), "image_size", "seq", "qpc",
    ).where(F.col("name") != "")
    first = first_per_key(rows, ["trace_id", "name", "version", "image_base"], ["qpc", "seq"]).drop("seq", "qpc")
    key = F.sha2(F.concat_ws("|", "trace_id", "name", "version"), 256)
    first = first.withColumn("entity_key", key)
    return first.where(contains_text(F.col("name"), name_filter)) if name_filter else first


def process_entities(process: DataFrame, *, name_filter: str | None = None) -> DataFrame:
    """Distinct processes by id and start, with a stable key."""
    rows = process.where(F.col("pid") > 0).select(
        "trace_id", "pid", F.col("qpc").alias("start_qpc"), "seq",
        F.nullif(F.trim("image_file_name"), F.lit("")).alias("image_name"),
        F.nullif(F.trim("command_line"), F.lit("")).alias("command_line"),
    )
    first = first_per_key(rows, ["trace_id", "pid", "start_qpc"], ["seq"]).drop("seq")
    first = first.withColumn(
        "entity_key", F.sha2(F.concat_ws("|", "trace_id", F.col("pid").cast("string"), F.col("start_qpc").cast("string")), 256)
    )
    return first.where(contains_text(F.col("image_name"), name_filter)) if name_filter else first


# ---- comparison ---------------------------------------------------------------------------


def outer_compare(
    baseline: DataFrame, test: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """Full outer join of two keyed tables; what one side lacks is 0."""
    left = baseline.select(*keys, *[F.col(v).alias(f"{v}_baseline") for v in values])
    right = test.select(*keys, *[F.col(v).alias(f"{v}_test") for v in values])
    joined = left.join(right, list(keys), "full")
    return joined.fillna(0, [f"{v}_{side}" for v in values for side in ("baseline", "test")])


def compare_sampling(
    baseline: DataFrame, test: DataFrame, *, mode: str = "hot_functions", modules: str | None = None
) -> DataFrame:
    """Change of weight and of share per function or module between two sampling tables."""
    keys = ["module"] if mode == "modules" else ["module", "function"]

    def shares(df: DataFrame) -> DataFrame:
        wanted = any_module_substring(F.col("module"), modules)
        rows = df if wanted is None else df.where(wanted)
        sums = rows.groupBy(*keys).agg(F.sum("weight").alias("weight")).withColumn("_one", F.lit(1))
        return with_share(sums, ["_one"], "weight", "pct").select(*keys, "weight", "pct")

    return outer_compare(shares(baseline), shares(test), keys, ["weight", "pct"]).withColumns({
        "delta_weight": F.col("weight_test") - F.col("weight_baseline"),
        "delta_pct": F.col("pct_test") - F.col("pct_baseline"),
    })


def compare_per_cpu(baseline: DataFrame, test: DataFrame) -> DataFrame:
    """Change of mean utilisation per CPU; idle CPUs without a change are left out."""

    def means(timeline: DataFrame) -> DataFrame:
        return timeline.groupBy("cpu").agg(F.avg("util_pct").alias("util"))

    joined = outer_compare(means(baseline), means(test), ["cpu"], ["util"]).withColumn(
        "delta", F.col("util_test") - F.col("util_baseline")
    )
    return joined.where(
        ~((F.abs("delta") < 0.5) & (F.col("util_baseline") < 1) & (F.col("util_test") < 1))
    )


def largest_changes(compared: DataFrame, delta: str, keys: Sequence[str], limit: int) -> DataFrame:
    """The rows that changed most, in either direction."""
    return compared.orderBy(F.abs(delta).desc(), *keys).limit(limit)


# ---- combined report ----------------------------------------------------------------------


def consolidated_report(
    *, meta: DataFrame, timeline: DataFrame, sampling: DataFrame, histogram: DataFrame,
    modules: str | None = None, functions: int | None = None,
    start_time: float | None = None, end_time: float | None = None,
) -> DataFrame:
    """System, CPU bands, hot functions, symbol gaps and interrupt health as
    ``trace_id, section, metric, value`` rows; ``functions`` keeps the hottest of each trace.

    A range in seconds holds for the CPU bands, by the buckets that lie within it; the other tables
    have no time.
    """
    if start_time is not None:
        timeline = timeline.where(F.col("start_us") >= F.lit(start_time * 1e6))
    if end_time is not None:
        timeline = timeline.where(F.col("end_us") <= F.lit(end_time * 1e6))

    def long(df: DataFrame, section: str, metrics: dict[str, Column]) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in metrics.items()])
        return df.select("trace_id", F.lit(section).alias("section"), F.explode(rows).alias("_m")).select(
            "trace_id", "section", "_m.*"
        )

    per_cpu = per_cpu_summary(timeline)
    avg = F.col("avg_util")

    def band(flag: Column) -> Column:
        return F.count(F.when(flag, True))

    bands = per_cpu.groupBy("trace_id").agg(
        band(avg >= 80).alias("saturated"), band((avg >= 10) & (avg < 80)).alias("active"),
        band((avg >= 2) & (avg < 10)).alias("low"), band(avg < 2).alias("idle"),
        F.count(F.lit(1)).alias("cpus"),
    )
    unresolved = F.coalesce("function", F.lit("")).isin("", "Unknown")
    gaps = sampling.groupBy("trace_id").agg(
        (F.sum(F.when(unresolved, F.col("weight")).otherwise(F.lit(0))) / F.sum("weight") * 100.0).alias("unresolved_pct")
    )
    rank = F.row_number().over(
        Window.partitionBy("trace_id").orderBy(F.col("weight").desc(), "module", "function")
    )
    ranked = hot_functions(sampling, modules=modules)
    if functions is not None:
        ranked = ranked.withColumn("_rank", rank).where(F.col("_rank") <= functions)
    hot_rows = ranked.select(
        "trace_id", F.lit("hot_functions").alias("section"),
        F.concat("module", F.lit("!"), "function").alias("metric"), F.col("denominator_pct").alias("value"),
    )
    health = dpc_health(histogram)
    parts = [
        long(meta, "system", {"cpus": F.col("cpu_count"), "duration_s": F.col("duration_s")}),
        long(bands, "cpu", {n: F.col(n) for n in ("saturated", "active", "low", "idle", "cpus")}),
        hot_rows,
        long(gaps, "symbols", {"unresolved_pct": F.col("unresolved_pct")}),
        long(health, "interrupts", {"above_16us_pct": F.col("elevated_pct"), "warning": F.col("warning").cast("int")}),
    ]
    return reduce(DataFrame.unionByName, parts)

