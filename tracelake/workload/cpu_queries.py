"""Queries of the CPU, scheduler and interrupt operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cpu, filters, interrupts, sched
from ..operators.attribution import (
    orphan_stacks, pair_stacks, resolve_addresses, with_debug_identity, with_owner, with_process_name,
)
from .derive import DAY
from .registry import query

RATE = 0.0005  # samples per second that count as a full CPU on these sparse events
DAY_S = 86_400.0

WEIGHT = "CASE WHEN profile_weight > 0 THEN profile_weight ELSE coalesce(weight, 1) END"

OWNED = """owned AS (
    SELECT s.*, CASE WHEN s.pid > 0 AND s.pid <> 4294967295 THEN s.pid
                     ELSE coalesce(p.owner, h.owner, -1) END AS own_pid
    FROM samples s
    LEFT JOIN (SELECT trace_id, tid, arg_min(pid, seq) AS owner FROM thread GROUP BY ALL) p
           ON p.trace_id = s.trace_id AND p.tid = s.payload_tid
    LEFT JOIN (SELECT trace_id, tid, arg_min(pid, seq) AS owner FROM thread GROUP BY ALL) h
           ON h.trace_id = s.trace_id AND h.tid = s.tid)"""
NAMES = """pnames AS (
    SELECT trace_id, pid, arg_max(image_file_name, seq) AS pname FROM process
    WHERE image_file_name <> '' GROUP BY ALL)"""
PLACED = """placed AS (
    SELECT a.trace_id, a.address, coalesce(a.file, '<unknown>') AS module,
           CASE WHEN a.rva IS NULL THEN '' ELSE coalesce(y.name, '+0x' || lower(to_hex(a.rva))) END AS function,
           coalesce(y.source, 'unknown') AS symbol_source
    FROM (SELECT d.trace_id, d.address, regexp_extract(lower(i.file_name), '([^/]+)$', 1) AS file, d.address - i.image_base AS rva
          FROM (SELECT DISTINCT trace_id, address FROM samples) d
          LEFT JOIN image i ON i.trace_id = d.trace_id AND i.image_base = d.address - d.address % 4096) a
    ASOF LEFT JOIN symbols y ON y.module = a.file AND a.rva >= y.start)"""
SAMPLING = f"""{OWNED}, {NAMES}, {PLACED}, table_ AS (
    SELECT o.trace_id, coalesce(n.pname, '<unknown>') AS process_name, o.own_pid AS pid, p.module, p.function,
           p.symbol_source, CAST(sum({WEIGHT}) AS BIGINT) AS weight
    FROM owned o LEFT JOIN pnames n ON n.trace_id = o.trace_id AND n.pid = o.own_pid
    JOIN placed p ON p.trace_id = o.trace_id AND p.address = o.address GROUP BY ALL)"""


def _dimensions(t):
    return {"thread": t["thread"], "process": t["process"], "image": t["image"], "symbols": t["symbols"]}


@query("sample_owners", f"""
WITH {OWNED} SELECT trace_id, seq, own_pid AS pid FROM owned""")
def _(t):
    return with_owner(t["samples"], t["thread"]).select("trace_id", "seq", "pid")


@query("process_names", f"""
WITH {NAMES} SELECT b.trace_id, b.seq, b.pid, coalesce(n.pname, '<unknown>') AS process_name
FROM base b LEFT JOIN pnames n ON n.trace_id = b.trace_id AND n.pid = b.pid""")
def _(t):
    return with_process_name(t["base"].select("trace_id", "seq", "pid"), t["process"])


@query("address_modules", """
SELECT a.trace_id, a.address, coalesce(regexp_extract(lower(i.file_name), '([^/]+)$', 1), '<unknown>') AS module
FROM (SELECT DISTINCT trace_id, address FROM samples) a
LEFT JOIN image i ON i.trace_id = a.trace_id AND i.image_base <= a.address AND a.address < i.image_base + i.image_size""")
def _(t):
    places = resolve_addresses(t["samples"], t["image"])
    return places.select("trace_id", "address", "module")


@query("address_modules_of_overlapping_images", """
SELECT a.trace_id, a.address, coalesce(regexp_extract(lower(arg_max(i.file_name, i.image_base)), '([^/]+)$', 1), '<unknown>') AS module
FROM (SELECT DISTINCT trace_id, address FROM samples) a
LEFT JOIN image i ON i.trace_id = a.trace_id AND i.image_base <= a.address AND a.address < i.image_base + CASE WHEN i.seq % 6 = 1 THEN 12288 ELSE 4096 END GROUP BY ALL""")
def _(t):
    # every sixth image reaches over the two that follow it: the one that begins last counts
    image = t["image"].withColumn("image_size", F.expr("CAST(CASE WHEN seq % 6 = 1 THEN 12288 ELSE 4096 END AS BIGINT)"))
    return resolve_addresses(t["samples"], image).select("trace_id", "address", "module")


@query("dpc_from_samples", """
WITH s AS (SELECT trace_id, module, CAST(sum(weight) AS BIGINT) AS weight FROM sampling WHERE module ILIKE '%.sys%' GROUP BY ALL)
SELECT *, round(weight * 100.0 / sum(weight) OVER (PARTITION BY trace_id), 4) AS pct FROM s""")
def _(t):
    return interrupts.dpc_from_samples(t["sampling"], module_filter=".SYS")


@query("address_functions", f"""
WITH {PLACED} SELECT trace_id, address, module, function, symbol_source FROM placed""")
def _(t):
    return resolve_addresses(t["samples"], t["image"], t["symbols"])


@query("debug_identity", """
WITH rsds AS (SELECT trace_id, seq, qpc, pid, image_base, 'g' || seq AS g, seq % 5 AS a, 'n' || seq % 7 AS n
              FROM image WHERE seq % 4 <> 1 AND (seq % 4 <> 2 OR pid <> 0)),
shifted AS (SELECT trace_id, seq, qpc, CASE WHEN seq % 4 = 0 THEN pid ELSE pid + 10 END AS pid, image_base, g, a, n FROM rsds)
SELECT i.trace_id, i.seq, s.g AS pdb_guid, s.a AS pdb_age, s.n AS pdb_name
FROM image i LEFT JOIN shifted s ON s.trace_id = i.trace_id AND s.image_base = i.image_base""")
def _(t):
    image = t["image"]
    # records of no image lie one byte further
    lone = "seq % 4 = 1 OR (seq % 4 = 2 AND pid = 0)"
    rsds = image.select(
        "trace_id", "seq", "qpc", F.expr("CASE WHEN seq % 4 = 0 THEN pid ELSE pid + 10 END").alias("pid"),
        F.expr(f"image_base + CASE WHEN {lone} THEN 1 ELSE 0 END").alias("image_base"),
        F.concat(F.lit("g"), "seq").alias("pdb_guid"), (F.col("seq") % 5).alias("pdb_age"),
        F.concat(F.lit("n"), F.col("seq") % 7).alias("pdb_name"),
    )
    return with_debug_identity(image, rsds).select("trace_id", "seq", "pdb_guid", "pdb_age", "pdb_name")


@query("stack_pairing", """
SELECT b.trace_id, b.seq, CASE WHEN seq % 3 = 0 THEN 'thread' WHEN seq % 3 = 1 THEN 'time' END AS stack_match,
       CASE WHEN seq % 3 < 2 THEN CAST(k AS BIGINT) END AS leaf
FROM base b""")
def _(t):
    # a third of the stacks come from another thread, a third also at a time of no event
    stacks = t["base"].select(
        "trace_id", "seq", F.expr("qpc + CASE WHEN seq % 3 = 2 THEN 3 ELSE 0 END").alias("qpc"),
        F.expr("CASE WHEN seq % 3 = 0 THEN tid ELSE tid + 100000 END").alias("tid"),
        F.array("k", F.col("k") + 1).alias("stack"),
    )
    paired = pair_stacks(t["base"], stacks)
    return paired.select("trace_id", "seq", "stack_match", F.get("stack", F.lit(0)).alias("leaf"))


@query("orphan_stacks", """
SELECT trace_id, count(*) AS orphan_stacks FROM base WHERE event_type = 'error' GROUP BY trace_id""")
def _(t):
    base = t["base"]
    events = base.withColumn("qpc", F.expr("qpc + CASE WHEN event_type = 'error' THEN 3 ELSE 0 END"))
    return orphan_stacks(events, base.select("trace_id", "seq", "qpc", "tid", F.array("k").alias("stack")))


@query("cpu_sampling_table", f"""
WITH {SAMPLING}
SELECT trace_id, process_name, pid, module, function, symbol_source, weight,
       round(weight * 100.0 / sum(weight) OVER (PARTITION BY trace_id), 4) AS weight_pct FROM table_""")
def _(t):
    return cpu.cpu_sampling(t["samples"], **_dimensions(t))


IDLE_SQL = """SELECT trace_id, process_name, pid, module, function, symbol_source, weight,
  round(weight * 100.0 / sum(weight) OVER (PARTITION BY trace_id), 4) AS weight_pct FROM all_rows"""


@query("idle_top_up", f"""
WITH caps AS (SELECT trace_id, CAST(round_even(4136800 - sum(weight), 0) AS BIGINT) AS idle FROM sampling GROUP BY trace_id),
all_rows AS (SELECT * FROM sampling UNION ALL
  SELECT trace_id, 'Idle', 0, '<Heuristic Low Power State>', '<C3>', '', idle FROM caps WHERE idle > 0)
{IDLE_SQL}""")
def _(t):
    meta = t["meta"].withColumn("duration_s", F.lit(0.5171))
    return cpu.idle_top_up(t["sampling"], meta)


@query("capacity_normalisation", f"""
WITH tl AS (SELECT trace_id, least(ts_us // {DAY}, 29) AS b, cpu, count(*) AS n FROM base GROUP BY ALL),
busy AS (SELECT trace_id, sum({DAY}.0 * least(round(least(n / ({DAY_S} * {RATE}) * 100.0, 100.0), 2), 100.0) / 100.0) / 1e9 AS busy FROM tl GROUP BY trace_id),
tot AS (SELECT trace_id, CAST(sum(weight) AS DOUBLE) AS total FROM sampling GROUP BY trace_id),
plan_ AS (SELECT trace_id, total, least(busy, 20736.0) AS target FROM tot JOIN busy USING (trace_id)),
scaled AS (SELECT s.* EXCLUDE (weight), CASE WHEN total > 20736.0 * 1.5 THEN CAST(round_even(weight * target / total, 0) AS BIGINT) ELSE weight END AS weight,
                  target, total > 20736.0 * 1.5 AS over_ FROM sampling s JOIN plan_ USING (trace_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY weight DESC, process_name DESC, pid DESC, module DESC, function DESC, symbol_source DESC) AS rk,
                  sum(weight) OVER (PARTITION BY trace_id) AS got FROM scaled),
settled AS (SELECT trace_id, process_name, pid, module, function, symbol_source,
                   CAST(weight + CASE WHEN over_ AND rk = 1 THEN round_even(target, 0) - got ELSE 0 END AS BIGINT) AS weight FROM ranked),
all_rows AS (SELECT * FROM settled UNION ALL
  SELECT trace_id, 'Idle', 0, '<Heuristic Low Power State>', '<C3>', '', CAST(round_even(20736.0 - target, 0) AS BIGINT)
  FROM plan_ WHERE total > 20736.0 * 1.5 AND 20736.0 - target >= 1)
{IDLE_SQL}""")
def _(t):
    # a capacity far below the summed weights, so that they are scaled down
    meta = t["meta"]
    timeline = cpu.cpu_timeline(t["base"], meta, bucket_seconds=DAY_S, sample_rate_hz=RATE)
    small = timeline.withColumns({"start_us": F.col("start_us") / 1e9, "end_us": F.col("end_us") / 1e9})
    scaled = meta.withColumn("duration_s", F.lit(0.002592))
    return cpu.normalise_capacity(t["sampling"], small, scaled)


TIMELINE = f"""tl AS (
  SELECT g.trace_id, g.b * {DAY} AS start_us, (g.b + 1) * {DAY} AS end_us, g.cpu, coalesce(c.n, 0) AS samples,
         round(least(coalesce(c.n, 0) / ({DAY_S} * {RATE}) * 100.0, 100.0), 2) AS util_pct
  FROM (SELECT trace_id, unnest(range(30)) AS b, cpu FROM (SELECT trace_id, unnest(range(8)) AS cpu FROM meta)) g
  LEFT JOIN (SELECT trace_id, ts_us // {DAY} AS b, cpu, count(*) AS n FROM base GROUP BY ALL) c
    ON c.trace_id = g.trace_id AND c.b = g.b AND c.cpu = g.cpu)"""


def _timeline(t, table="base"):
    return cpu.cpu_timeline(t[table], t["meta"], bucket_seconds=DAY_S, sample_rate_hz=RATE)


@query("cpu_timeline", f"""WITH {TIMELINE} SELECT * FROM tl""")
def _(t):
    return _timeline(t)


@query("per_cpu_summary", f"""
WITH {TIMELINE}, a AS (SELECT trace_id, cpu, avg(util_pct) AS avg_util, max(util_pct) AS max_util FROM tl WHERE start_us >= 2 * {DAY} GROUP BY ALL)
SELECT trace_id, cpu, round(avg_util, 4) AS avg_util, max_util,
  CASE WHEN avg_util >= 80 THEN 'Saturated' WHEN avg_util >= 20 THEN 'Active' WHEN avg_util >= 2 THEN 'Low activity' ELSE 'Idle' END AS role,
  avg_util >= 2 AS active FROM a""")
def _(t):
    return cpu.per_cpu_summary(_timeline(t), start_time=2 * DAY_S)


@query("timeline_report", f"""
WITH {TIMELINE} SELECT tl.*, first_value(util_pct) OVER (PARTITION BY trace_id, cpu ORDER BY start_us) >= 10 AS hot_cpu
FROM tl WHERE cpu BETWEEN 2 AND 5 AND end_us <= 20 * {DAY}""")
def _(t):
    return cpu.timeline_report(_timeline(t), cpu_filter="2-5", end_time=20 * DAY_S)


@query("timeline_matrix", f"""
WITH {TIMELINE} SELECT trace_id, start_us, end_us, {", ".join(f'max(CASE WHEN cpu = {c} THEN util_pct END) AS "{c}"' for c in range(8))}
FROM tl GROUP BY trace_id, start_us, end_us""")
def _(t):
    return cpu.timeline_matrix(_timeline(t), range(8))


WEIGHTS = f"""w AS (SELECT trace_id, floor(ts_us / 1e6 / {DAY_S}) * {DAY_S} AS time_s, CAST(sum(weight) AS BIGINT) AS weight FROM labelled GROUP BY ALL)"""


@query("weight_timeline", f"""WITH {WEIGHTS} SELECT * FROM w""")
def _(t):
    return cpu.weight_timeline(t["labelled"], bucket_seconds=DAY_S)


@query("steady_state", f"""
WITH {WEIGHTS}, m AS (SELECT trace_id, quantile_cont(weight, 0.5) AS med, count(*) AS n FROM w GROUP BY trace_id)
SELECT w.trace_id, min(time_s) AS steady_start_s, max(time_s) + {DAY_S} AS steady_end_s
FROM w JOIN m USING (trace_id) WHERE n > 3 AND abs(weight - med) < med * 0.2 GROUP BY w.trace_id""")
def _(t):
    return cpu.steady_state(cpu.weight_timeline(t["labelled"], bucket_seconds=DAY_S), bucket_seconds=DAY_S)


def _share_sql(keys, source="labelled", where="true"):
    return f"""SELECT trace_id, {keys}, CAST(sum(weight) AS BIGINT) AS weight,
      round(sum(weight) * 100.0 / sum(sum(weight)) OVER (PARTITION BY trace_id), 4) AS weight_pct
      FROM {source} WHERE {where} GROUP BY trace_id, {keys}"""


for _name, _keys in cpu.GROUPINGS.items():
    query(f"cpu_samples_by_{_name.replace('+', '_and_')}", _share_sql(", ".join(_keys)))(
        lambda t, g=_name: cpu.cpu_samples(t["labelled"], group_by=g)
    )


@query("cpu_samples_filtered", _share_sql(
    "module, function", where=f"cpu IN (1,2,3,6) AND ts_us >= 3 * {DAY} AND ts_us <= 25 * {DAY} AND process_name ILIKE '%PROC1%' AND module ILIKE '%.SYS%' AND function ILIKE '%e%'"))
def _(t):
    return cpu.cpu_samples(
        t["labelled"], group_by="function", cpu_filter="1-3,6", start_time=3 * DAY_S, end_time=25 * DAY_S,
        process_filter="PROC1", module_filter=".SYS", function_filter="e",
    )


@query("cpu_samples_top", """
SELECT trace_id, module, CAST(sum(weight) AS BIGINT) AS weight,
  round(sum(weight) * 100.0 / sum(sum(weight)) OVER (PARTITION BY trace_id), 4) AS weight_pct
FROM labelled GROUP BY trace_id, module ORDER BY weight DESC, trace_id, module LIMIT 7""")
def _(t):
    return cpu.cpu_samples(t["labelled"], group_by="module", limit=7)


HOT = "regexp_matches(lower(module), 'xdp.sys|xdplwf.sys|tcpip.sys|ndis.sys|netio.sys|afd.sys|pacer.sys|http.sys|ntoskrnl.exe|hal.dll')"


def _hot_sql(ratio="1.0", where=HOT, extra=""):
    return f"""{extra}
SELECT l.trace_id, module, function, CAST(sum(weight) AS BIGINT) AS weight,
  round(sum(weight) * 100.0 / sum(sum(weight)) OVER (PARTITION BY l.trace_id), 4) AS weight_pct,
  round(any_value(w.total) * {ratio}, 4) AS denominator,
  round(sum(weight) / (any_value(w.total) * {ratio}) * 100.0, 4) AS denominator_pct
FROM labelled l JOIN (SELECT trace_id, CAST(sum(weight) AS DOUBLE) AS total FROM labelled GROUP BY trace_id) w ON w.trace_id = l.trace_id
{"JOIN use_ u ON u.trace_id = l.trace_id" if extra else ""}
WHERE {where} GROUP BY l.trace_id, module, function{", u.total_lps, u.active_lps, u.active_avg" if extra else ""}"""


USE = f"""WITH {TIMELINE}, pc AS (SELECT trace_id, cpu, avg(util_pct) AS a FROM tl GROUP BY ALL),
use_ AS (SELECT trace_id, count(*) AS total_lps, count(CASE WHEN a >= 2 THEN 1 END) AS active_lps, avg(CASE WHEN a >= 2 THEN a END) AS active_avg FROM pc GROUP BY trace_id)"""


@query("hot_functions", _hot_sql())
def _(t):
    return cpu.hot_functions(t["labelled"])


@query("hot_functions_all_modules", _hot_sql(where="true"))
def _(t):
    return cpu.hot_functions(t["labelled"], modules="all")


def _usage(t):
    return cpu.cpu_usage_scalars(_timeline(t), t["meta"])


@query("cpu_usage_scalars", USE + " SELECT trace_id, total_lps, active_lps, round(active_avg, 6) AS active_avg, 2592000.0 AS duration_s FROM use_", digits=6)
def _(t):
    return _usage(t)


@query("hot_functions_active_cpus", _hot_sql("u.active_lps / u.total_lps", extra=USE))
def _(t):
    return cpu.hot_functions(t["labelled"], denominator="active_cpus", usage=_usage(t))


@query("hot_functions_active_busy", _hot_sql("u.active_lps / u.total_lps * u.active_avg / 100.0", extra=USE))
def _(t):
    return cpu.hot_functions(t["labelled"], denominator="active_busy", usage=_usage(t))


@query("hot_functions_custom", _hot_sql("(4 * 1000000.0 / (u.total_lps * 2592000.0))", extra=USE))
def _(t):
    return cpu.hot_functions(t["labelled"], denominator="custom", usage=_usage(t), lps=4, seconds=1_000_000.0)


@query("network_hot_functions", _hot_sql(where="lower(module) IN ('tcpip.sys','ndis.sys','xdp.sys','afd.sys','ws2_32.dll')"))
def _(t):
    modules = sorted(filters.module_set())
    return cpu.hot_functions(t["labelled"], modules=modules)


@query("threshold_checks", """
WITH s AS (SELECT trace_id, sum(weight) AS w, sum(CASE WHEN module LIKE '%xdp%' THEN weight END) AS b,
  sum(CASE WHEN function = 'NdisAllocateClone' THEN weight ELSE 0 END) AS c, sum(CASE WHEN function = 'KeAcquireSpinLock' THEN weight ELSE 0 END) AS l,
  sum(CASE WHEN function = 'XdpInspect' THEN weight ELSE 0 END) AS i FROM labelled GROUP BY trace_id),
r AS (SELECT trace_id, 'clone' AS "check", c / b * 100.0 AS pct, 10.0 AS limit_pct FROM s
  UNION ALL SELECT trace_id, 'spinlock', l / w * 100.0, 10.0 FROM s UNION ALL SELECT trace_id, 'drain', 0.0, NULL FROM s
  UNION ALL SELECT trace_id, 'enqueue', 0.0, NULL FROM s UNION ALL SELECT trace_id, 'inspect', i / w * 100.0, NULL FROM s)
SELECT trace_id, "check", round(pct, 4) AS pct, limit_pct, coalesce(pct > limit_pct, false) AS above FROM r""")
def _(t):
    return cpu.threshold_checks(t["labelled"])


# ---- scheduler ----------------------------------------------------------------------------

EVENTS = """ev AS (
  SELECT trace_id, ts_us, seq, 0 AS kind, new_tid AS tid, new_pid AS pid, new_process AS pn, '' AS st, '' AS rs FROM cswitch
  UNION ALL SELECT trace_id, ts_us, seq, 1, old_tid, old_pid, old_process, old_state, wait_reason FROM cswitch)"""


def _precise_sql(group, w0=0.0, w1=30.0 * DAY, wait="st = 'Waiting'", where="true"):
    keys = "trace_id, tid" if group == "thread" else "trace_id, pid, process_name"
    identity = "arg_min(process_name, (ts_us, seq, kind)) AS process_name, arg_min(pid, (ts_us, seq, kind)) AS pid" if group == "thread" else "count(DISTINCT tid) AS threads"
    return f"""
WITH {EVENTS}, own AS (SELECT trace_id, new_tid AS tid, arg_min(new_pid, (ts_us, seq)) AS own_pid, arg_min(new_process, (ts_us, seq)) AS own_process FROM cswitch GROUP BY ALL),
e AS (SELECT ev.trace_id, ev.tid, ts_us, seq, kind, coalesce(own_pid, pid) AS pid, coalesce(own_process, pn) AS process_name,
  kind = 1 AND {wait} AS is_wait, coalesce(CAST(lead(ts_us) OVER w AS DOUBLE), {w1}) AS nt, lead(kind) OVER w AS nk
  FROM ev LEFT JOIN own ON own.trace_id = ev.trace_id AND own.tid = ev.tid WHERE ev.tid > 0
  WINDOW w AS (PARTITION BY ev.trace_id, ev.tid ORDER BY ts_us, seq, kind)),
d AS (SELECT *, coalesce(lag(is_wait) OVER (PARTITION BY trace_id, tid ORDER BY ts_us, seq, kind), false) AS pw,
  CASE WHEN nt < ts_us THEN 0.0 ELSE greatest(least(greatest(nt, {w0}), {w1}) - least(greatest(CAST(ts_us AS DOUBLE), {w0}), {w1}), 0.0) END AS dur,
  ts_us BETWEEN {w0} AND {w1} AS inw FROM e),
g AS (SELECT {keys}, {identity}, sum(CASE WHEN kind = 0 THEN dur ELSE 0 END) AS r, sum(CASE WHEN is_wait THEN dur ELSE 0 END) AS wt,
  sum(CASE WHEN kind = 1 AND NOT is_wait THEN dur ELSE 0 END) AS o,
  count(CASE WHEN kind = 0 AND inw THEN 1 END) AS switch_ins, count(CASE WHEN kind = 0 AND inw AND pw THEN 1 END) AS wait_to_run,
  count(CASE WHEN nt < ts_us THEN 1 END) AS lost_intervals FROM d GROUP BY {keys}),
p AS (SELECT {keys}, avg(dur) AS mean_wait_us, quantile_cont(dur, 0.5) AS p50_wait_us, quantile_cont(dur, 0.9) AS p90_wait_us, quantile_cont(dur, 0.99) AS p99_wait_us
  FROM d WHERE is_wait AND nk = 0 AND ts_us >= {w0} AND nt <= {w1} GROUP BY {keys})
SELECT g.trace_id, g.process_name, g.pid, {"g.tid" if group == "thread" else "threads"}, round(r / 1000.0, 3) AS running_ms, round(r / {w1 - w0} * 100.0, 3) AS running_pct,
  round(wt / 1000.0, 3) AS waiting_ms, round(wt / {w1 - w0} * 100.0, 3) AS waiting_pct, round(o / 1000.0, 3) AS other_ms,
  switch_ins, round(switch_ins / ({w1 - w0} / 1000000.0), 3) AS cswitch_per_s, wait_to_run, round(wait_to_run / ({w1 - w0} / 1000000.0), 3) AS wait_to_run_per_s,
  round(coalesce(mean_wait_us, 0), 2) AS mean_wait_us, round(coalesce(p50_wait_us, 0), 2) AS p50_wait_us,
  round(coalesce(p90_wait_us, 0), 2) AS p90_wait_us, round(coalesce(p99_wait_us, 0), 2) AS p99_wait_us, lost_intervals
FROM g LEFT JOIN p USING ({keys}) WHERE {where}"""


def _precise(t, table=None, **options):
    rows = t["cswitch"] if table is None else table
    result = sched.thread_cpu_precise(rows, duration_us=F.lit(30 * DAY), slice_us=DAY, **options)
    # waits of days in microseconds: interpolated values carry two exact decimals
    return result.withColumns({
        c: F.round(c, 2) for c in ("mean_wait_us", "p50_wait_us", "p90_wait_us", "p99_wait_us")
    })


@query("thread_cpu_precise", _precise_sql("thread"), digits=3)
def thread_cpu_precise_query(t):
    return _precise(t)


@query("process_cpu_precise", _precise_sql("process"), digits=3)
def _(t):
    return _precise(t, group_by="process")


@query("thread_cpu_precise_window", _precise_sql("thread", 5.0 * DAY, 12.0 * DAY, where="g.process_name ILIKE '%proc1%'"), digits=3)
def _(t):
    return _precise(t, start_time=5 * DAY_S, end_time=12 * DAY_S, process_filter="proc1")


@query("thread_cpu_precise_by_reason", _precise_sql("thread", wait="rs <> '' AND rs <> 'WrPreempted'"), digits=3)
def _(t):
    return _precise(t, t["cswitch"].drop("old_state"))


@query("thread_cpu_precise_top", _precise_sql("thread") + " ORDER BY g.switch_ins DESC, g.trace_id, g.pid, g.process_name, g.tid LIMIT 10", digits=3)
def _(t):
    return sched.precise_report(_precise(t), sort_by="switch_ins", limit=10)


WINDOW = 2 * DAY
WAITS = f"""w AS (
  SELECT r.trace_id, r.tid, r.ts_us AS ready_us, r.seq AS ready_seq, r.cpu AS ready_cpu, r.stack_text, r.pid,
    s.ts_us AS switch_us, s.cpu AS switch_cpu, s.old_tid, s.new_pid, s.old_pid, s.wait_reason, s.seq AS switch_seq,
    s.ts_us - r.ts_us AS wait_us
  FROM ready r ASOF JOIN switch_in s ON s.trace_id = r.trace_id AND s.new_tid = r.tid AND s.ts_us >= r.ts_us
  WHERE s.ts_us - r.ts_us <= {WINDOW})"""


def _waits(t, **options):
    return sched.ready_to_switch(t["ready"], t["switch_in"], max_window_us=WINDOW, **options)


@query("ready_to_switch", f"WITH {WAITS} SELECT * FROM w")
def _(t):
    return _waits(t)


LOCKS = "regexp_matches(stack_text, '(?i)KeAcquireSpinLock|ExAcquireFastMutex')"


@query("lock_contention", f"""
WITH {WAITS}, x AS (SELECT trace_id, count(*) AS switches, count(CASE WHEN {LOCKS} THEN 1 END) AS lock_switches,
  round(quantile_cont(CASE WHEN {LOCKS} THEN wait_us END, 0.5), 4) AS median_wait_us, round(quantile_cont(CASE WHEN {LOCKS} THEN wait_us END, 0.99), 4) AS p99_wait_us,
  CAST(max(CASE WHEN {LOCKS} THEN wait_us END) AS DOUBLE) AS max_wait_us FROM w GROUP BY trace_id)
SELECT *, round(lock_switches * 100.0 / switches, 4) AS lock_pct, CASE WHEN lock_switches * 100.0 / switches > 10 THEN 'alert' WHEN lock_switches * 100.0 / switches > 5 THEN 'moderate' ELSE 'healthy' END AS level FROM x""")
def _(t):
    return sched.lock_contention(sched.lock_events(_waits(t)))


@query("network_lock_contention", f"""
WITH {WAITS}, x AS (SELECT trace_id, count(*) AS switches, count(CASE WHEN {LOCKS} THEN 1 END) AS lock_switches,
  round(quantile_cont(CASE WHEN {LOCKS} THEN wait_us END, 0.5), 4) AS median_wait_us, round(quantile_cont(CASE WHEN {LOCKS} THEN wait_us END, 0.99), 4) AS p99_wait_us,
  CAST(max(CASE WHEN {LOCKS} THEN wait_us END) AS DOUBLE) AS max_wait_us FROM w WHERE stack_text LIKE '%drv!%' OR stack_text LIKE '%fs!%' GROUP BY trace_id)
SELECT *, round(lock_switches * 100.0 / switches, 4) AS lock_pct, CASE WHEN lock_switches * 100.0 / switches > 10 THEN 'alert' WHEN lock_switches * 100.0 / switches > 5 THEN 'moderate' ELSE 'healthy' END AS level FROM x""")
def _(t):
    modules = filters.module_set(instead=["drv!", "fs!"])
    return sched.lock_contention(sched.lock_events(_waits(t), module_filter=modules))


@query("contention_sites", f"""
WITH {WAITS}, x AS (SELECT trace_id, CASE WHEN stack_text LIKE '%SpinLock%' THEN 'ntos!KeAcquireSpinLock <- ' || split_part(stack_text, ' / ', 3)
  ELSE split_part(stack_text, ' / ', 1) || ' <- ' || split_part(stack_text, ' / ', 2) END AS site, count(*) AS waits FROM w WHERE {LOCKS} GROUP BY ALL)
SELECT *, round(waits * 100.0 / sum(waits) OVER (PARTITION BY trace_id), 4) AS pct FROM x""")
def _(t):
    return sched.contention_sites(sched.lock_events(_waits(t)))


@query("wait_reasons", """
SELECT trace_id, reason AS wait_reason, count(*) AS switches, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY trace_id), 4) AS pct
FROM (SELECT trace_id, CASE WHEN wait_reason = '' THEN '(unknown)' ELSE wait_reason END AS reason FROM switch_in) GROUP BY trace_id, reason""")
def _(t):
    return sched.wait_reasons(t["switch_in"])


@query("switches_by_process", """SELECT trace_id, new_process AS process_name, count(*) AS switches FROM switch_in GROUP BY ALL""")
def _(t):
    return sched.switches_by_process(t["switch_in"])


@query("switch_names", f"""
WITH {NAMES} SELECT c.trace_id, c.seq, coalesce(a.pname, '<unknown>') AS new_process, coalesce(b.pname, '<unknown>') AS old_process
FROM cswitch c LEFT JOIN pnames a ON a.trace_id = c.trace_id AND a.pid = c.new_pid LEFT JOIN pnames b ON b.trace_id = c.trace_id AND b.pid = c.old_pid""")
def _(t):
    rows = t["cswitch"].drop("new_process", "old_process")
    return sched.with_switch_names(rows, t["process"]).select("trace_id", "seq", "new_process", "old_process")


THREADS = """th AS (
  SELECT o.trace_id, o.tid, o.pid, c.switch_ins FROM (SELECT trace_id, tid, min(pid) AS pid FROM thread
     WHERE (trace_id, pid) IN (SELECT (trace_id, pid) FROM process WHERE image_file_name ILIKE '%proc1%') GROUP BY ALL) o
  JOIN (SELECT trace_id, new_tid AS tid, count(*) AS switch_ins FROM switch_in GROUP BY ALL) c USING (trace_id, tid))"""


@query("threads_of_process", f"WITH {THREADS} SELECT * FROM th")
def _(t):
    return sched.threads_of_process(t["process"], t["thread"], t["switch_in"], "proc1")


def _chain(t):
    return sched.wait_chain(
        t["switch_in"], t["ready"], sched.threads_of_process(t["process"], t["thread"], t["switch_in"], "proc1"),
        busiest=5, max_window_us=WINDOW,
    )


CHOSEN = f"""{THREADS}, ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY switch_ins DESC, tid) AS rk FROM th) WHERE rk <= 5)"""


@query("wait_chain_threads", f"WITH {CHOSEN} SELECT trace_id, tid, pid, switch_ins FROM ch")
def _(t):
    return _chain(t)["threads"]


@query("wait_chain_reasons", f"""
WITH {CHOSEN} SELECT trace_id, reason AS wait_reason, count(*) AS switches, round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY trace_id), 4) AS pct
FROM (SELECT s.trace_id, CASE WHEN wait_reason = '' THEN '(unknown)' ELSE wait_reason END AS reason
      FROM switch_in s JOIN ch ON ch.trace_id = s.trace_id AND ch.tid = s.new_tid) GROUP BY trace_id, reason""")
def _(t):
    return _chain(t)["wait_reasons"]


@query("wait_chain_waits", f"""
WITH {CHOSEN}, {WAITS} SELECT w.* FROM w JOIN ch ON ch.trace_id = w.trace_id AND ch.tid = w.tid""")
def _(t):
    return _chain(t)["waits"]


# ---- interrupts ---------------------------------------------------------------------------

BUCKETS = """hb AS (
  SELECT trace_id, module, CASE WHEN duration_us < 1 THEN 0 ELSE least(CAST(floor(log2(duration_us)) AS INT) + 1, 16) END AS b, count(*) AS events FROM dpc GROUP BY ALL),
hu AS (SELECT * FROM hb UNION ALL SELECT trace_id, '(all)', b, CAST(sum(events) AS BIGINT) FROM hb GROUP BY trace_id, b),
hist AS (SELECT trace_id, module, CASE WHEN b = 0 THEN 0 ELSE CAST(1 AS BIGINT) << (b - 1) END AS low_us,
  CASE WHEN b = 16 THEN 99999999 ELSE CAST(1 AS BIGINT) << b END AS high_us, events,
  round(events * 100.0 / sum(events) OVER (PARTITION BY trace_id, module), 4) AS pct FROM hu)"""


@query("duration_histogram", f"WITH {BUCKETS} SELECT * FROM hist")
def _(t):
    return interrupts.duration_histogram(t["dpc"])


def _pct(flag):
    return f"round(sum(CASE WHEN {flag} THEN events ELSE 0 END) * 100.0 / sum(events), 4)"


def _dpc_sql(where="true"):
    return f"""WITH {BUCKETS} SELECT trace_id, module, CAST(sum(events) AS BIGINT) AS events, {_pct('high_us <= 5')} AS short_pct,
  {_pct('low_us >= 5 AND high_us <= 20')} AS mid_pct, {_pct('low_us >= 16')} AS long_pct, max(high_us) AS max_bucket_us
FROM hist WHERE module <> '(all)' AND {where} GROUP BY ALL"""


@query("dpc_summary", _dpc_sql())
def _(t):
    return interrupts.dpc_summary(interrupts.duration_histogram(t["dpc"]))


@query("network_dpc_summary", _dpc_sql("module IN ('mlx5.sys', 'NDIS.SYS', 'tcpip.sys')"))
def _(t):
    names = filters.module_set()
    return interrupts.dpc_summary(interrupts.duration_histogram(t["dpc"]), module_filter=names)


@query("dpc_health", f"""
WITH {BUCKETS} SELECT trace_id, CAST(sum(events) AS BIGINT) AS events, {_pct('high_us <= 4')} AS healthy_pct, {_pct('low_us >= 4 AND high_us <= 32')} AS moderate_pct,
  {_pct('low_us >= 16')} AS elevated_pct, sum(CASE WHEN low_us >= 16 THEN events ELSE 0 END) * 100.0 / sum(events) > 1 AS warning
FROM hist WHERE module <> '(all)' GROUP BY trace_id""")
def _(t):
    return interrupts.dpc_health(interrupts.duration_histogram(t["dpc"]))


@query("dpc_exact_shares", """
SELECT trace_id, module, count(*) AS events, round(count(CASE WHEN duration_us < 5 THEN 1 END) * 100.0 / count(*), 4) AS below_5_pct,
  round(count(CASE WHEN duration_us BETWEEN 5 AND 20 THEN 1 END) * 100.0 / count(*), 4) AS from_5_to_20_pct,
  round(count(CASE WHEN duration_us > 20 THEN 1 END) * 100.0 / count(*), 4) AS above_20_pct FROM dpc GROUP BY ALL""")
def _(t):
    return interrupts.dpc_exact_shares(t["dpc"])


PER_CPU = """pc AS (SELECT trace_id, module, cpu, sum(duration_us) AS dpc_us, count(*) AS events FROM dpc GROUP BY ALL)"""


def _per_cpu(t):
    return interrupts.dpc_per_cpu(t["dpc"], t["meta"])


@query("dpc_per_cpu", f"WITH {PER_CPU} SELECT *, round(dpc_us / 2592000000000.0 * 100.0, 4) AS pct FROM pc")
def _(t):
    return _per_cpu(t)


@query("dpc_cpu_report", f"""
WITH {PER_CPU} SELECT trace_id, module, sum(dpc_us) AS dpc_us, CAST(sum(events) AS BIGINT) AS events, count(CASE WHEN dpc_us > 0 THEN 1 END) AS active_cpus,
  arg_max(cpu, (dpc_us, -cpu)) AS top_cpu, max(dpc_us) AS top_cpu_us FROM pc GROUP BY trace_id, module""")
def _(t):
    return interrupts.dpc_cpu_report(_per_cpu(t))


@query("routine_modules", """
WITH s AS (SELECT trace_id, routine, count(*) AS n FROM dpc GROUP BY ALL)
SELECT s.*, coalesce(regexp_extract(lower(i.file_name), '([^/]+)$', 1), '<unknown>') AS module
FROM s LEFT JOIN image i ON i.trace_id = s.trace_id AND i.image_base = s.routine""")
def _(t):
    sums = t["dpc"].groupBy("trace_id", "routine").agg(F.count(F.lit(1)).alias("n"))
    return interrupts.with_routine_module(sums, t["image"])


SERVED = """sv AS (SELECT DISTINCT trace_id, cpu FROM dpc WHERE lower(module) IN ('mlx5.sys','ndis.sys','tcpip.sys') AND seq % 2 = 0 AND cpu < 5)"""
NET = "lower(module) IN ('tcpip.sys','ndis.sys','xdp.sys','afd.sys','ws2_32.dll')"


def _served(t):
    # on the other CPUs, and half of the time, no network module runs
    module = F.expr("CASE WHEN seq % 2 = 0 AND cpu < 5 THEN module ELSE 'storport.sys' END")
    return interrupts.network_cpus(interrupts.dpc_per_cpu(t["dpc"].withColumn("module", module), t["meta"]))


@query("network_cpus", f"WITH {SERVED} SELECT * FROM sv")
def _(t):
    return _served(t)


@query("dispatch_quality", f"""
WITH {SERVED}, x AS (SELECT l.trace_id, process_name, count(*) AS samples, count(CASE WHEN {NET} THEN 1 END) AS network_samples, CAST(sum(weight) AS BIGINT) AS weight,
  count(DISTINCT l.cpu) AS recv_cpus, string_agg(DISTINCT CAST(l.cpu AS VARCHAR), ',' ORDER BY CAST(l.cpu AS VARCHAR)) AS recv_cpu_list,
  round(sum(CASE WHEN sv.cpu IS NOT NULL THEN weight ELSE 0 END) * 100.0 / sum(weight), 4) AS same_cpu_pct
  FROM labelled l LEFT JOIN sv ON sv.trace_id = l.trace_id AND sv.cpu = l.cpu GROUP BY ALL)
SELECT x.*, n.served_cpus, round(100.0 - same_cpu_pct, 4) AS cross_cpu_pct FROM x JOIN (SELECT trace_id, count(*) AS served_cpus FROM sv GROUP BY trace_id) n USING (trace_id)
WHERE network_samples >= 20 AND weight > 0""")
def _(t):
    return interrupts.dispatch_quality(t["labelled"], _served(t), min_samples=20)


@query("receive_dispatch_quality", f"""
WITH {SERVED}, x AS (SELECT l.trace_id, process_name, count(*) AS samples, CAST(sum(weight) AS BIGINT) AS weight,
  count(DISTINCT l.cpu) AS recv_cpus, string_agg(DISTINCT CAST(l.cpu AS VARCHAR), ',' ORDER BY CAST(l.cpu AS VARCHAR)) AS recv_cpu_list,
  round(sum(CASE WHEN sv.cpu IS NULL THEN weight ELSE 0 END) * 100.0 / sum(weight), 4) AS cross_cpu_pct
  FROM labelled l LEFT JOIN sv ON sv.trace_id = l.trace_id AND sv.cpu = l.cpu
  WHERE module IN ('tcpip.sys','afd.sys','ws2_32.dll') AND function = 'UdpReceive' GROUP BY ALL)
SELECT trace_id, process_name, samples, weight, recv_cpus, recv_cpu_list, n.served_cpus, cross_cpu_pct FROM x
JOIN (SELECT trace_id, count(*) AS served_cpus FROM sv GROUP BY trace_id) n USING (trace_id) WHERE samples >= 3 AND weight > 0""")
def _(t):
    return interrupts.receive_dispatch_quality(t["labelled"], _served(t), min_samples=3)


@query("queue_arrivals", f"""
WITH {PER_CPU}, x AS (SELECT trace_id, cpu, sum(dpc_us) AS dpc_us FROM pc WHERE module ILIKE '%mlx5.sys%' GROUP BY ALL),
tt AS (SELECT trace_id, sum(dpc_us) AS total_us, count(CASE WHEN dpc_us > 0 THEN 1 END) AS active_cpus FROM x GROUP BY trace_id)
SELECT trace_id, cpu, dpc_us, total_us, active_cpus, CAST(8 AS INT) AS total_cpus, round(dpc_us / total_us * 100.0, 4) AS pct,
  round(total_us / active_cpus, 4) AS mean_active_us, round(total_us / 8, 4) AS even_us FROM x JOIN tt USING (trace_id) WHERE total_us > 0""")
def _(t):
    return interrupts.queue_arrivals(_per_cpu(t), t["meta"])
