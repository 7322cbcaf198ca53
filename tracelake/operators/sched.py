"""Scheduler analyses over context switches and thread wake-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import PREEMPTION_REASONS, WAIT_STATES
from ..functions.labels import contention_site, mentions_lock
from ..functions.times import MICROS
from ..plans.lookup import lookup
from ..plans.quantiles import exact_quantiles, null_safe_join, quantiles_of_counts, with_share
from ..plans.sequence import DEFAULT_SLICE_US, slice_of, with_neighbours
from ..session import durable
from .attribution import with_process_name
from .filters import apply_filters, contains_text, cpu_predicate, matches_module
from .grouping import top

SORTABLE = (
    "running_ms", "running_pct", "waiting_ms", "waiting_pct", "other_ms", "switch_ins",
    "cswitch_per_s", "wait_to_run", "wait_to_run_per_s", "mean_wait_us", "p50_wait_us",
    "p90_wait_us", "p99_wait_us",
)
GROUPS = ("thread", "process", "process+thread")


def choose_time_unit(ticks: DataFrame, meta: DataFrame, *, column: str = "qpc") -> DataFrame:
    """Per trace, whether a time column holds ticks or microseconds.

    The reading whose span is nearer the known duration wins; without one, a smallest value
    above the tick frequency means ticks since boot.
    """
    spans = ticks.groupBy("trace_id").agg(F.min(column).alias("_min"), F.max(column).alias("_max"))
    joined = spans.join(meta.select("trace_id", "freq", "duration_s"), "trace_id", "left")
    span = (F.col("_max") - F.col("_min")).cast("double")
    nearer = F.abs(span / F.col("freq") - F.col("duration_s")) < F.abs(span / float(MICROS) - F.col("duration_s"))
    is_ticks = (
        F.when((F.coalesce(F.col("freq"), F.lit(0)) <= 0) | (span <= 0), F.lit(False))
        .when(F.col("duration_s") > 0, nearer)
        .otherwise(F.col("_min") > F.col("freq"))
    )
    return joined.select("trace_id", "_min", "_max", "freq", "duration_s", is_ticks.alias("is_ticks"))


def with_relative_time(df: DataFrame, meta: DataFrame, *, column: str = "qpc") -> DataFrame:
    """Add ``ts_us`` under the unit :func:`choose_time_unit` picks."""
    unit = choose_time_unit(df, meta, column=column).select("trace_id", "_min", "freq", "is_ticks")
    value = F.when(
        F.col("is_ticks"), (F.col(column) - F.col("_min")) * float(MICROS) / F.col("_freq")
    ).otherwise(F.col(column).cast("double"))
    joined = lookup(df, unit.withColumnRenamed("freq", "_freq"), ["trace_id"])
    return joined.withColumn("ts_us", F.bround(value).cast("bigint")).drop("_min", "_freq", "is_ticks")


def _thread_events(cswitch: DataFrame) -> DataFrame:
    """Two rows per switch: the thread that starts and the thread that stops."""
    blank = F.lit("")
    side = F.explode(F.array(
        F.struct(
            F.lit(0).alias("kind"), F.col("new_tid").alias("tid"), F.col("new_pid").alias("pid"),
            F.col("new_process").alias("process_name"), blank.alias("state"), blank.alias("reason"),
        ),
        F.struct(
            F.lit(1).alias("kind"), F.col("old_tid").alias("tid"), F.col("old_pid").alias("pid"),
            F.col("old_process").alias("process_name"), F.trim("old_state").alias("state"),
            F.trim("wait_reason").alias("reason"),
        ),
    ))
    return cswitch.select("trace_id", "ts_us", "seq", side.alias("_e")).select(
        "trace_id", "ts_us", "seq", "_e.*"
    ).where(F.col("tid") > 0)


def _ensure(df: DataFrame, **kinds: str) -> DataFrame:
    for name, kind in kinds.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def thread_intervals(
    cswitch: DataFrame, *, window_end: Column, slice_us: int = DEFAULT_SLICE_US
) -> DataFrame:
    """Each thread event with the time and kind of the next one and whether the previous was a
    wait. ``window_end`` (a column over ``cswitch``) closes the last interval of a thread."""
    switches = _ensure(
        cswitch, new_pid="bigint", old_pid="bigint", new_process="string", old_process="string",
        old_state="string", wait_reason="string",
    )
    has_state = switches.groupBy("trace_id").agg(
        F.max(F.coalesce(F.length(F.trim("old_state")) > 0, F.lit(False))).alias("has_state"),
        F.max(window_end).alias("window_end"),
    )
    events = lookup(_thread_events(switches), has_state, ["trace_id"])
    state, reason = F.lower(F.coalesce("state", F.lit(""))), F.lower(F.coalesce("reason", F.lit("")))
    is_wait = (F.col("kind") == 1) & F.when(F.col("has_state"), state.isin(*WAIT_STATES)).otherwise(
        (reason != "") & ~reason.isin(*PREEMPTION_REASONS)
    )
    events = events.withColumn("is_wait", is_wait)
    return with_neighbours(
        events, ["trace_id", "tid"], ["ts_us", "seq", "kind"],
        previous={"prev_wait": "is_wait"},
        following={"next_ts": "ts_us", "next_kind": "kind"},
        slice_us=slice_us,
    )


def thread_cpu_precise(
    cswitch: DataFrame,
    *,
    duration_us: Column | None = None,
    process_filter: str | None = None,
    tid: int | None = None,
    cpu_filter: str | None = None,
    start_time: float | None = None,
    end_time: float | None = None,
    group_by: str = "thread",
    slice_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Running, waiting and other off-CPU time per thread or process from context switches.

    ``cswitch`` has ``trace_id, ts_us, seq, cpu, new_tid, old_tid`` and, where known,
    ``new_pid, old_pid, new_process, old_process, old_state, wait_reason``. ``duration_us`` is
    a column over it with the length of its trace; the last switch ends the trace without it.
    A CPU filter applies before intervals are formed, so intervals that leave the CPU set are
    cut. ``process+thread`` means the same as ``thread``. ``lost_intervals`` counts dropped
    negative intervals.
    """
    if group_by not in GROUPS:
        raise ValueError(f"group_by must be one of: {', '.join(GROUPS)}")
    rows = cswitch
    if (on_cpu := cpu_predicate(cpu_filter)) is not None:
        rows = rows.where(on_cpu)
    start = F.lit(float(start_time or 0.0) * MICROS)
    length = duration_us if duration_us is not None else F.col("ts_us")
    intervals = thread_intervals(rows, window_end=length, slice_us=slice_us)
    end = F.lit(float(end_time) * MICROS) if end_time is not None else F.col("window_end").cast("double")
    end = F.when(end > start, end).otherwise(
        start + F.greatest(F.col("window_end").cast("double") - start, F.lit(1e-3))
    )
    if tid is not None:
        intervals = intervals.where(F.col("tid") == int(tid))
    e = intervals.withColumns({"_w0": start, "_w1": end})
    t = F.col("ts_us").cast("double")
    following = F.coalesce(F.col("next_ts").cast("double"), F.col("_w1"))

    def clip(x: Column) -> Column:
        return F.least(F.greatest(x, F.col("_w0")), F.col("_w1"))

    lost = following < t
    in_window = t.between(F.col("_w0"), F.col("_w1"))
    e = e.withColumns({
        "_lost": lost,
        "_dur": F.when(lost, F.lit(0.0)).otherwise(F.greatest(clip(following) - clip(t), F.lit(0.0))),
        "_run": F.col("kind") == 0,
        "_in": (F.col("kind") == 0) & in_window,
        "_whole_wait": F.col("is_wait") & F.coalesce(F.col("next_kind") == 0, F.lit(False))
        & (t >= F.col("_w0")) & (following <= F.col("_w1")),
    })
    keys = ["trace_id", "pid", "process_name"] if group_by == "process" else ["trace_id", "tid"]

    def total(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("_dur")).otherwise(F.lit(0.0)))

    # events become one row per thread, process named by the event and distinct length of a whole
    # wait, written once; identities, sums and quantiles all start from there
    at = F.struct("ts_us", "seq")
    started = F.col("kind") == 0
    reduced = durable(
        e.groupBy("trace_id", "tid", *(["pid", "process_name"] if group_by == "process" else []),
                  F.when(F.col("_whole_wait"), F.col("_dur")).alias("_v"))
        .agg(
            total(F.col("_run")).alias("_running"),
            total(F.col("is_wait")).alias("_waiting"),
            total((F.col("kind") == 1) & ~F.col("is_wait")).alias("_other"),
            F.count(F.when(F.col("_in"), True)).alias("switch_ins"),
            F.count(F.when(F.col("_in") & F.coalesce("prev_wait", F.lit(False)), True)).alias("wait_to_run"),
            F.count(F.when(F.col("_lost"), True)).alias("lost_intervals"),
            F.max(F.col("_w1") - F.col("_w0")).alias("_window"),
            F.count(F.lit(1)).alias("_n"),
            # a thread belongs to the process of its first switch-in that names one
            F.min(F.when(started & (F.col("pid") > 0), F.struct(at, F.col("pid").alias("id")))).alias("_own_pid"),
            F.min(F.when(started & (F.length("process_name") > 0), F.struct(at, F.col("process_name").alias("id")))).alias("_own_name"),
            *([] if group_by == "process" else [F.min(F.struct("ts_us", "seq", "kind", "pid", "process_name")).alias("_who")]),
        )
    )

    def owner(pid: Column, name: Column) -> dict[str, Column]:
        return {
            "pid": F.coalesce(F.col("_own_pid.id"), pid, F.lit(0).cast("bigint")),
            "process_name": F.coalesce(F.col("_own_name.id"), name, F.lit("")),
        }

    owned = [F.min("_own_pid").alias("_own_pid"), F.min("_own_name").alias("_own_name")]
    if group_by == "process":
        threads = reduced.groupBy("trace_id", "tid").agg(*owned)
        reduced = lookup(reduced.drop("_own_pid", "_own_name"), threads, ["trace_id", "tid"]).withColumns(
            owner(F.col("pid"), F.col("process_name")))
    summed = ("_running", "_waiting", "_other", "switch_ins", "wait_to_run", "lost_intervals")
    sums = [*[F.sum(c).alias(c) for c in summed], F.max("_window").alias("_window")]
    if group_by == "process":
        sums = reduced.groupBy(*keys, "tid").agg(*sums).groupBy(*keys).agg(
            *sums, F.count(F.lit(1)).alias("threads")
        )
    else:
        sums = reduced.groupBy(*keys).agg(*sums, *owned, F.min("_who").alias("_who")).withColumns(
            owner(F.col("_who.pid"), F.col("_who.process_name")))
    waited = reduced.where(F.col("_v").isNotNull()).groupBy(*keys, "_v").agg(F.sum("_n").alias("_n"))
    waits = quantiles_of_counts(
        waited, keys, {"p50_wait_us": 0.5, "p90_wait_us": 0.9, "p99_wait_us": 0.99}, mean="mean_wait_us",
    )
    result = null_safe_join(sums, waits, keys, "left")
    seconds = F.col("_window") / float(MICROS)
    result = result.withColumns({
        "running_ms": F.col("_running") / 1000.0,
        "waiting_ms": F.col("_waiting") / 1000.0,
        "other_ms": F.col("_other") / 1000.0,
        "running_pct": F.col("_running") / F.col("_window") * 100.0,
        "waiting_pct": F.col("_waiting") / F.col("_window") * 100.0,
        "cswitch_per_s": F.col("switch_ins") / seconds,
        "wait_to_run_per_s": F.col("wait_to_run") / seconds,
        **{c: F.coalesce(c, F.lit(0.0)) for c in
           ("mean_wait_us", "p50_wait_us", "p90_wait_us", "p99_wait_us")},
    })
    if process_filter:
        result = result.where(contains_text(F.col("process_name"), process_filter))
    identity = ["trace_id", "process_name", "pid", "threads" if group_by == "process" else "tid"]
    return result.select(*identity, *SORTABLE, "lost_intervals")


def precise_report(result: DataFrame, *, sort_by: str = "running_ms", limit: int | None = None) -> DataFrame:
    """The largest rows by a sortable column; an unknown name means running time."""
    order = sort_by if sort_by in SORTABLE else "running_ms"
    tie = ["trace_id", "pid", "process_name"] + (["tid"] if "tid" in result.columns else [])
    return top(result, order, limit, tie)


# ---- wake-ups -----------------------------------------------------------------------------


def ready_to_switch(
    ready: DataFrame,
    cswitch: DataFrame,
    *,
    max_window_us: int = 1_000_000,
    target_tid: int | None = None,
    start_time: float | None = None,
    end_time: float | None = None,
    cpu_filter: str | None = None,
) -> DataFrame:
    """Each wake-up with the next switch to its thread, at most ``max_window_us`` later.

    A switch at the very time of the wake-up counts. Several wake-ups may share a switch. Both
    sides are cut into slices as long as the window and switches are listed in their own and
    the previous slice, so no thread's whole history meets in one task. The end of the range
    is widened by the window on the switch side.
    """
    r, s = ready, cswitch
    if (on_cpu := cpu_predicate(cpu_filter)) is not None:
        r, s = r.where(on_cpu), s.where(on_cpu)
    low = None if start_time is None else round(start_time * MICROS)
    high = None if end_time is None else round(end_time * MICROS)
    if low is not None:
        r, s = r.where(F.col("ts_us") >= low), s.where(F.col("ts_us") >= low)
    if high is not None:
        r, s = r.where(F.col("ts_us") <= high), s.where(F.col("ts_us") <= high + max_window_us)
    woken = F.coalesce("readied_tid", "tid")
    r = r.withColumn("_tid", woken).where(F.col("_tid").isNotNull())
    s = s.where(F.col("new_tid").isNotNull())
    if target_tid is not None:
        r, s = r.where(F.col("_tid") == int(target_tid)), s.where(F.col("new_tid") == int(target_tid))
    width = max(int(max_window_us), 1)
    carried = [c for c in ("stack_text", "stack", "adjust_reason", "adjust_increment", "flag", "pid") if c in r.columns]
    switch_payload = F.struct(
        F.col("ts_us").alias("switch_us"), F.col("cpu").alias("switch_cpu"), "old_tid",
        *[F.col(c) for c in ("new_pid", "old_pid", "wait_reason") if c in s.columns],
        F.col("seq").alias("switch_seq"),
    )
    ready_rows = r.select(
        "trace_id", F.col("_tid").alias("tid"), "ts_us", "seq", F.lit(0).alias("_kind"),
        slice_of(F.col("ts_us"), width).alias("_slice"), F.col("cpu").alias("ready_cpu"),
        F.struct(*[F.col(c) for c in carried], F.lit(1).alias("_x")).alias("_ready"),
    )
    own = slice_of(F.col("ts_us"), width)
    switch_rows = s.select(
        "trace_id", F.col("new_tid").alias("tid"), "ts_us", "seq", F.lit(1).alias("_kind"),
        F.explode(F.array(own, own - 1)).alias("_slice"), switch_payload.alias("_switch"),
    )
    following = (
        Window.partitionBy("trace_id", "tid", "_slice").orderBy("ts_us", "_kind", "seq")
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    joined = (
        ready_rows.unionByName(switch_rows, allowMissingColumns=True)
        .withColumn("_hit", F.first("_switch", ignorenulls=True).over(following))
        .where((F.col("_kind") == 0) & (F.col("_hit.switch_us") - F.col("ts_us") <= max_window_us))
    )
    return joined.select(
        "trace_id", "tid", F.col("ts_us").alias("ready_us"), F.col("seq").alias("ready_seq"), "ready_cpu",
        *[F.col(f"_ready.{c}").alias(c) for c in carried], "_hit.*",
        (F.col("_hit.switch_us") - F.col("ts_us")).alias("wait_us"),
    )


def switches_of_thread(cswitch: DataFrame, tid: int, **filters) -> DataFrame:
    """Switch-ins of one thread."""
    return apply_filters(cswitch.where(F.col("new_tid") == int(tid)), **filters)


def threads_of_process(process: DataFrame, thread: DataFrame, cswitch: DataFrame, text: str) -> DataFrame:
    """Threads of the processes whose image name contains ``text``, with their switch-ins."""
    pids = process.where(contains_text(F.col("image_file_name"), text)).select("trace_id", "pid").distinct()
    owned = thread.join(pids, ["trace_id", "pid"], "left_semi").select("trace_id", "tid", "pid")
    owned = owned.where(F.col("tid") > 0).groupBy("trace_id", "tid").agg(F.min("pid").alias("pid"))
    counts = cswitch.groupBy("trace_id", F.col("new_tid").alias("tid")).agg(F.count(F.lit(1)).alias("switch_ins"))
    return owned.join(counts, ["trace_id", "tid"])


def wait_reasons(cswitch: DataFrame, **filters) -> DataFrame:
    """Switches per wait reason with their share; blanks are ``(unknown)``."""
    reason = F.coalesce(F.when(F.col("wait_reason") != "", F.col("wait_reason")), F.lit("(unknown)"))
    counts = apply_filters(cswitch, **filters).groupBy("trace_id", reason.alias("wait_reason")).agg(
        F.count(F.lit(1)).alias("switches")
    )
    return with_share(counts, ["trace_id"], "switches", "pct")


def with_switch_names(cswitch: DataFrame, process: DataFrame) -> DataFrame:
    """Names of both processes of a switch."""
    named = with_process_name(cswitch, process, pid="new_pid", out="new_process")
    return with_process_name(named, process, pid="old_pid", out="old_process")


def wait_chain(
    cswitch: DataFrame, ready: DataFrame, threads: DataFrame, *, busiest: int | None = None,
    max_window_us: int = 1_000_000,
) -> dict[str, DataFrame]:
    """Wait picture of the threads of a process, of the ``busiest`` ones where a number is given.

    ``threads`` comes from :func:`threads_of_process` (or names one thread). Returns the chosen
    threads, their wait reasons and their wake-up waits.
    """
    chosen = threads
    if busiest is not None:
        # one row per thread of the matching processes, ranked per trace
        ranked = Window.partitionBy("trace_id").orderBy(F.col("switch_ins").desc(), F.col("tid"))
        chosen = threads.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= busiest).drop("_rank")
    keys = chosen.select("trace_id", "tid")
    switched = cswitch.join(keys.withColumnRenamed("tid", "new_tid"), ["trace_id", "new_tid"], "left_semi")
    woken = ready.withColumn("tid", F.coalesce("readied_tid", "tid")).join(keys, ["trace_id", "tid"], "left_semi")
    return {
        "threads": chosen,
        "wait_reasons": wait_reasons(switched),
        "waits": ready_to_switch(woken, switched, max_window_us=max_window_us),
    }


# ---- lock contention ----------------------------------------------------------------------


def lock_events(
    waits: DataFrame, *, module_filter: str | None = None, function_filter: str | None = None,
    cpu_filter: str | None = None, start_time: float | None = None, end_time: float | None = None,
) -> DataFrame:
    """Wake-up waits with ``is_lock`` set from their waking stack text."""
    rows = apply_filters(
        waits, cpu_filter=cpu_filter, cpu="ready_cpu", start_time=start_time, end_time=end_time,
        ts="ready_us",
    )
    if module_filter not in (None, ""):
        rows = rows.where(matches_module(F.col("stack_text"), module_filter))
    if function_filter:
        rows = rows.where(contains_text(F.col("stack_text"), function_filter))
    return rows.withColumn("is_lock", mentions_lock(F.col("stack_text")))


def lock_contention(events: DataFrame) -> DataFrame:
    """Share of lock waits, their median, p99 and longest, and the level of concern."""
    counts = events.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("switches"), F.count(F.when(F.col("is_lock"), True)).alias("lock_switches")
    )
    waits = exact_quantiles(
        events.where("is_lock"), ["trace_id"], "wait_us",
        {"median_wait_us": 0.5, "p99_wait_us": 0.99}, maximum="max_wait_us",
    )
    pct = F.col("lock_switches") / F.col("switches") * 100.0
    level = F.when(pct > 10, F.lit("alert")).when(pct > 5, F.lit("moderate")).otherwise(F.lit("healthy"))
    return counts.join(waits, "trace_id", "left").withColumns({"lock_pct": pct, "level": level})


def contention_sites(events: DataFrame) -> DataFrame:
    """Lock waits per contention site."""
    sites = events.where("is_lock").groupBy("trace_id", contention_site(F.col("stack_text")).alias("site")).agg(
        F.count(F.lit(1)).alias("waits")
    )
    return with_share(sites, ["trace_id"], "waits", "pct")


def switches_by_process(cswitch: DataFrame, **filters) -> DataFrame:
    """Switch-ins per process, for traces whose wake-ups carry no stacks."""
    name = F.coalesce(F.when(F.col("new_process") != "", F.col("new_process")), F.lit("(unknown)"))
    return apply_filters(cswitch, **filters).groupBy("trace_id", name.alias("process_name")).agg(
        F.count(F.lit(1)).alias("switches")
    )
