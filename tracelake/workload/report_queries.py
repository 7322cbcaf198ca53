"""Queries of metadata, symbol quality, memory, comparison and the combined report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.classes import number_text, percent_text
from ..operators import filters, grouping, interrupts, report, sched
from ..plans.quantiles import exact_quantiles
from ..sources.normalise import class_of, normalise, union_opcodes, with_start_tick
from ..sources.store import select_events
from .cpu_queries import BUCKETS, DAY_S, TIMELINE, _timeline
from .derive import DAY
from .registry import query


@query("event_scan", f"""
SELECT trace_id, seq, cpu, qpc, ts_us FROM base WHERE cpu IN (1, 2, 3, 6) AND ts_us >= {3 * DAY} AND ts_us <= {9 * DAY} AND trace_id IN ('t0', 't2')""")
def _(t):
    return select_events(
        t["base"].drop("ts_us"), columns=["trace_id", "seq", "cpu", "qpc"], cpu_filter="1-3,6", start_time=3 * DAY_S, end_time=9 * DAY_S,
        timebase=(5000, 10_000_000), traces=["t0", "t2"],
    )


@query("event_scan_by_trace_clock", f"""
SELECT trace_id, seq, ts_us - CASE trace_id WHEN 't1' THEN {DAY} ELSE 0 END AS ts_us FROM base
WHERE ts_us - CASE trace_id WHEN 't1' THEN {DAY} ELSE 0 END BETWEEN {2 * DAY} AND {5 * DAY}""")
def _(t):
    shift = F.when(F.col("trace_id") == "t1", F.lit(DAY * 10)).otherwise(F.lit(0))
    meta = t["meta"].withColumn("origin", F.col("origin") + shift)
    return select_events(t["base"].drop("ts_us"), meta=meta, start_time=2 * DAY_S, end_time=5 * DAY_S).select("trace_id", "seq", "ts_us")


@query("relative_time", """
SELECT trace_id, seq, CASE trace_id WHEN 't0' THEN ts_us ELSE CAST(round_even((qpc - min(qpc) OVER (PARTITION BY trace_id)) / 10.0, 0) AS BIGINT) END AS ts_us FROM base""")
def _(t):
    # one trace delivers microseconds, the others ticks
    mixed = t["base"].withColumn("qpc", F.when(F.col("trace_id") == "t0", F.col("ts_us")).otherwise(F.col("qpc")))
    return sched.with_relative_time(mixed.drop("ts_us"), t["meta"]).select("trace_id", "seq", "ts_us")


SPELLED = {"view": "TcpIp/Recv", "signup": "udpip_send_df", "error": "Thread/DCStart", "click": "MsQuic/AckReceived"}


@query("class_names", """
SELECT event_type, CASE event_type WHEN 'view' THEN 'tcpip_recv' WHEN 'signup' THEN 'udp_send' WHEN 'error' THEN 'thread' WHEN 'click' THEN 'quic_ack_recv' END AS event_class, count(*) AS events
FROM base GROUP BY ALL""")
def _(t):
    spelled = F.lit("no such class")
    for kind, name in SPELLED.items():
        spelled = F.when(F.col("event_type") == kind, F.lit(name)).otherwise(spelled)
    return t["base"].groupBy("event_type", class_of(spelled).alias("event_class")).agg(F.count(F.lit(1)).alias("events"))


@query("normalised_rows", """
SELECT trace_id, seq, qpc, cpu, CASE WHEN seq % 2 = 0 THEN -1 - k ELSE k END AS address, weight, 7 AS pid, CAST(NULL AS BIGINT) AS profile_weight, CASE WHEN seq % 2 = 0 THEN -1 - k ELSE k END AS top FROM samples JOIN (SELECT seq, k FROM base) b USING (seq)""")
def _(t):
    s = t["samples"].join(t["base"].select("seq", "k"), "seq")
    wide = F.when(F.col("seq") % 2 == 0, F.lit("18446744073709551615").cast("decimal(20,0)") - F.col("k")).otherwise(F.col("k").cast("decimal(20,0)"))
    raw = s.select(
        "trace_id", F.col("seq").alias("EventSequence"), F.col("qpc").alias("TimeStamp"), F.col("cpu").cast("string").alias("CPU"),
        wide.cast("decimal(20,0)").alias("InstructionPointer"), F.col("weight").alias("Count"), F.lit("7").alias("ProcessId"),
        F.array(wide.cast("decimal(20,0)")).alias("Stack"), F.lit("x").alias("Unknown Field"),
    )
    return normalise(raw, "SampledProfile").select(
        "trace_id", "seq", "qpc", "cpu", "address", "weight", "pid", "profile_weight", F.get("stack", F.lit(0)).alias("top")
    )


@query("opcode_union", """
SELECT trace_id, CASE event_type WHEN 'signup' THEN 'Start' ELSE 'End' END AS type, count(*) AS n, min(seq) AS first_seq FROM base WHERE event_type IN ('signup', 'error') GROUP BY ALL""")
def _(t):
    def part(kind):
        return t["base"].where(F.col("event_type") == kind).select("trace_id", F.col("seq").alias("EventSequence"), F.col("pid").alias("ProcessId"))

    rows = union_opcodes({"Process/Start": part("signup"), "Process/End": part("error")}, "process")
    return rows.groupBy("trace_id", "type").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))


@query("start_ticks", "SELECT trace_id, seq, qpc - CAST(duration_us * 10 AS BIGINT) AS initial_qpc FROM dpc")
def _(t):
    rows = t["dpc"].withColumn("initial_qpc", F.lit(None).cast("bigint"))
    return with_start_tick(rows, F.lit(10_000_000)).select("trace_id", "seq", "initial_qpc")


@query("class_counts", """
SELECT trace_id, 'cswitch' AS event_class, count(*) AS rows, min(qpc) AS first_qpc, max(qpc) AS last_qpc FROM cswitch GROUP BY trace_id
UNION ALL SELECT trace_id, 'dpc', count(*), min(qpc), max(qpc) FROM dpc GROUP BY trace_id""")
def _(t):
    return report.class_counts({"cswitch": t["cswitch"], "dpc": t["dpc"]})


@query("provider_counts", "SELECT trace_id, event_type AS provider, count(*) AS events FROM base WHERE event_type IN ('view', 'error') GROUP BY ALL")
def _(t):
    return report.provider_counts(t["base"], provider="event_type", providers=["view", "error"])


FIELDS = ("perf_freq", "cpu_count", "timer_resolution", "start_time", "end_time", "boot_time", "cpu_mhz", "pointer_size", "buffers_written")


@query("trace_metadata", f"""
WITH m AS (SELECT trace_id, {", ".join(f"arg_min({f}, CASE WHEN {f} > 0 THEN (qpc, seq) END) AS {f}" for f in FIELDS)}, CAST(sum(events_lost) AS BIGINT) AS events_lost, min(qpc) AS origin FROM header GROUP BY trace_id)
SELECT *, CASE WHEN end_time > start_time THEN (end_time - start_time) / 1e7 END AS duration_s FROM m""")
def _(t):
    return report.trace_metadata(t["header"])


@query("inferred_metadata", "SELECT trace_id, min(qpc) AS origin, 10000000 AS freq, round((max(qpc) - min(qpc)) / 1e7, 4) AS duration_s, max(cpu) + 1 AS cpu_count FROM base GROUP BY trace_id")
def _(t):
    return report.infer_metadata(t["base"])


@query("process_table", """
SELECT trace_id, pid, max(seq) AS seq, arg_max(image_file_name, (qpc, seq)) AS image_file_name, arg_max(command_line, (qpc, seq)) AS command_line FROM process GROUP BY trace_id, pid""")
def _(t):
    return report.process_table(t["process"]).select("trace_id", "pid", "seq", "image_file_name", "command_line")


@query("disk_summary", """
SELECT trace_id, disk_number, count(CASE WHEN kind = 'Read' THEN 1 END) AS reads, CAST(sum(CASE WHEN kind = 'Read' THEN transfer_size ELSE 0 END) AS BIGINT) AS read_bytes,
  count(CASE WHEN kind = 'DiskIo_Write' THEN 1 END) AS writes, CAST(sum(CASE WHEN kind = 'DiskIo_Write' THEN transfer_size ELSE 0 END) AS BIGINT) AS write_bytes,
  count(CASE WHEN kind = 'FlushBuffers' THEN 1 END) AS flushes FROM disk_io GROUP BY ALL""")
def _(t):
    return report.disk_summary(t["disk_io"])


@query("memory_pools", """
SELECT *, round(outstanding_kb * 100.0 / sum(outstanding_kb) OVER (PARTITION BY trace_id), 4) AS outstanding_pct, allocs - outstanding AS frees FROM pools
WHERE pool_type LIKE '%NonPaged%' AND module ILIKE '%brand#1%' AND tag ILIKE '%1%'""")
def _(t):
    return report.memory_pools(t["pools"], pool_type="nonpaged", module_filter="brand#1", tag_filter="1")


@query("memory_pools_top", """
SELECT *, round(outstanding_kb * 100.0 / sum(outstanding_kb) OVER (PARTITION BY trace_id), 4) AS outstanding_pct, allocs - outstanding AS frees FROM pools
ORDER BY allocs DESC, trace_id, pool_type, module, tag LIMIT 15""")
def _(t):
    return report.memory_pools(t["pools"], sort_by="allocs", limit=15)


QUALITY = """q AS (SELECT trace_id, module, count(*) AS functions, CAST(sum(weight) AS BIGINT) AS weight, CAST(sum(CASE WHEN symbol_source = 'pdb' THEN weight ELSE 0 END) AS BIGINT) AS pdb,
  CAST(sum(CASE WHEN symbol_source = 'mismatched' THEN weight ELSE 0 END) AS BIGINT) AS mismatched, CAST(sum(CASE WHEN symbol_source = 'export' THEN weight ELSE 0 END) AS BIGINT) AS export,
  CAST(sum(CASE WHEN symbol_source = 'unknown' AND function NOT IN ('', 'Unknown') THEN weight ELSE 0 END) AS BIGINT) AS pre_resolved,
  CAST(sum(CASE WHEN symbol_source = 'unknown' AND function IN ('', 'Unknown') THEN weight ELSE 0 END) AS BIGINT) AS unknown FROM lowq GROUP BY ALL),
qq AS (SELECT *, pdb * 100.0 / weight AS p, mismatched * 100.0 / weight AS m, export * 100.0 / weight AS e, pre_resolved * 100.0 / weight AS r FROM q)"""
# sources that differ enough between modules to meet every verdict
SOURCE = "CASE module WHEN 'tcpip.sys' THEN 'pdb' WHEN 'ndis.sys' THEN 'export' WHEN 'xdp.sys' THEN 'mismatched' WHEN 'app.exe' THEN 'unknown' ELSE symbol_source END"
LOWQ = f"lowq AS (SELECT trace_id, process_name, pid, module, function, {SOURCE} AS symbol_source, weight FROM sampling)"


def _doubtful(t):
    return t["sampling"].withColumn("symbol_source", F.expr(SOURCE))


@query("symbol_quality", f"""
WITH {LOWQ}, {QUALITY} SELECT trace_id, module, functions, weight, pdb, mismatched, export, pre_resolved, unknown, round(p, 4) AS pdb_pct, round(m, 4) AS mismatched_pct, round(e, 4) AS export_pct, round(r, 4) AS pre_resolved_pct,
  CASE WHEN p >= 90 THEN 'OK' WHEN m >= 50 AND p < 10 THEN 'MISMATCHED_PDB' WHEN e >= 90 AND p < 10 THEN 'EXPORT_ONLY' WHEN r >= 90 AND p < 10 AND e < 10 AND m < 10 THEN 'PRE_RESOLVED'
       WHEN pdb + mismatched + export + pre_resolved > 0 THEN 'PARTIAL' ELSE 'MISSING' END AS status FROM qq""")
def _(t):
    return report.symbol_quality(_doubtful(t))


@query("marked_functions", f"""
WITH {LOWQ}, {QUALITY} SELECT s.trace_id, s.module, CASE WHEN (e >= 90 OR m >= 50) AND p < 10 THEN '*' || function ELSE function END AS function, CAST(sum(s.weight) AS BIGINT) AS weight
FROM lowq s JOIN qq ON qq.trace_id = s.trace_id AND qq.module = s.module GROUP BY ALL""")
def _(t):
    rows = _doubtful(t)
    sums = rows.groupBy("trace_id", "module", "function").agg(F.sum("weight").alias("weight"))
    return report.mark_low_confidence(sums, report.low_confidence_modules(rows))


@query("module_entities", """
SELECT trace_id, regexp_extract(lower(file_name), '([^/]+)$', 1) AS name, 'tds=' || lpad(lower(to_hex(time_date_stamp)), 8, '0') || ';size=' || image_size AS version, file_name AS path, image_base,
  qpc AS load_qpc, image_size, sha256(trace_id || '|' || regexp_extract(lower(file_name), '([^/]+)$', 1) || '|' || 'tds=' || lpad(lower(to_hex(time_date_stamp)), 8, '0') || ';size=' || image_size) AS entity_key
FROM image WHERE file_name ILIKE '%RED%'""")
def _(t):
    return report.module_entities(t["image"], name_filter="RED")


@query("process_entities", """
SELECT trace_id, pid, qpc AS start_qpc, nullif(trim(image_file_name), '') AS image_name, nullif(trim(command_line), '') AS command_line, sha256(trace_id || '|' || pid || '|' || qpc) AS entity_key FROM process""")
def _(t):
    return report.process_entities(t["process"])


HOT = "regexp_matches(lower(module), 'tcpip.sys|ndis.sys|xdp.sys|afd.sys|ntoskrnl.exe')"


def _compare_sql(keys, where):
    side = "SELECT {k}, CAST(sum(weight) AS BIGINT) AS w, sum(weight) * 100.0 / sum(sum(weight)) OVER () AS p FROM ab WHERE side = '{s}' AND {c} GROUP BY {k}"
    b, o = side.format(k=keys, s="even", c=where), side.format(k=keys, s="odd", c=where)
    return f"""WITH b AS ({b}), o AS ({o})
SELECT {keys}, coalesce(b.w, 0) AS weight_baseline, round(coalesce(b.p, 0), 4) AS pct_baseline, coalesce(o.w, 0) AS weight_test, round(coalesce(o.p, 0), 4) AS pct_test,
  coalesce(o.w, 0) - coalesce(b.w, 0) AS delta_weight, round(coalesce(o.p, 0) - coalesce(b.p, 0), 4) AS delta_pct FROM b FULL JOIN o USING ({keys})"""


def _sides(t):
    return t["ab"].where("side = 'even'"), t["ab"].where("side = 'odd'")


@query("compare_functions", _compare_sql("module, function", HOT))
def _(t):
    return report.compare_sampling(*_sides(t))


@query("compare_modules", _compare_sql("module", "true"))
def _(t):
    return report.compare_sampling(*_sides(t), mode="modules", modules="all")


@query("compare_functions_top", _compare_sql("module, function", HOT) + " ORDER BY abs(coalesce(o.p, 0) - coalesce(b.p, 0)) DESC, module, function LIMIT 5")
def _(t):
    return report.largest_changes(report.compare_sampling(*_sides(t)), "delta_pct", ["module", "function"], 5)


@query("compare_per_cpu", f"""
WITH {TIMELINE}, a AS (SELECT cpu, avg(CASE WHEN trace_id = 't0' THEN util_pct END) AS b, avg(CASE WHEN trace_id = 't1' THEN util_pct END) AS o FROM tl GROUP BY cpu)
SELECT cpu, round(b, 4) AS util_baseline, round(o, 4) AS util_test, round(o - b, 4) AS delta FROM a WHERE NOT (abs(o - b) < 0.5 AND b < 1 AND o < 1)""")
def _(t):
    timeline = _timeline(t)
    return report.compare_per_cpu(timeline.where("trace_id = 't0'"), timeline.where("trace_id = 't1'"))


@query("key_union", "SELECT DISTINCT module, function FROM ab WHERE side = 'even' OR side = 'odd'")
def _(t):
    return grouping.key_union(*_sides(t), ["module", "function"])


REPORT = f"""
WITH {TIMELINE}, {BUCKETS}, pc AS (SELECT trace_id, cpu, avg(util_pct) AS a FROM tl GROUP BY ALL),
bands AS (SELECT trace_id, count(CASE WHEN a >= 80 THEN 1 END) AS saturated, count(CASE WHEN a >= 10 AND a < 80 THEN 1 END) AS active, count(CASE WHEN a >= 2 AND a < 10 THEN 1 END) AS low, count(CASE WHEN a < 2 THEN 1 END) AS idle, count(*) AS cpus FROM pc GROUP BY trace_id),
hf AS (SELECT trace_id, module || '!' || function AS metric, sum(weight) AS w, row_number() OVER (PARTITION BY trace_id ORDER BY sum(weight) DESC, module, function) AS rk FROM sampling WHERE {HOT} GROUP BY trace_id, module, function),
tw AS (SELECT trace_id, sum(weight) AS total, sum(CASE WHEN function IN ('', 'Unknown') THEN weight ELSE 0 END) AS gap FROM sampling GROUP BY trace_id),
hl AS (SELECT trace_id, sum(CASE WHEN low_us >= 16 THEN events ELSE 0 END) * 100.0 / sum(events) AS e FROM hist WHERE module <> '(all)' GROUP BY trace_id)
SELECT trace_id, 'system' AS section, 'cpus' AS metric, 8.0 AS value FROM meta UNION ALL SELECT trace_id, 'system', 'duration_s', 2592000.0 FROM meta
UNION ALL SELECT trace_id, 'cpu', 'saturated', saturated FROM bands UNION ALL SELECT trace_id, 'cpu', 'active', active FROM bands UNION ALL SELECT trace_id, 'cpu', 'low', low FROM bands
UNION ALL SELECT trace_id, 'cpu', 'idle', idle FROM bands UNION ALL SELECT trace_id, 'cpu', 'cpus', cpus FROM bands
UNION ALL SELECT hf.trace_id, 'hot_functions', metric, round(w * 100.0 / total, 4) FROM hf JOIN tw ON tw.trace_id = hf.trace_id WHERE rk <= 15
UNION ALL SELECT trace_id, 'symbols', 'unresolved_pct', round(gap * 100.0 / total, 4) FROM tw
UNION ALL SELECT trace_id, 'interrupts', 'above_16us_pct', round(e, 4) FROM hl UNION ALL SELECT trace_id, 'interrupts', 'warning', CASE WHEN e > 1 THEN 1.0 ELSE 0.0 END FROM hl"""


@query("consolidated_report", REPORT)
def _(t):
    return report.consolidated_report(
        meta=t["meta"], timeline=_timeline(t), sampling=t["sampling"], histogram=interrupts.duration_histogram(t["dpc"]), functions=15,
    )


@query("consolidated_report_of_range", REPORT.replace("FROM tl GROUP BY ALL)", f"FROM tl WHERE start_us >= {2 * DAY} AND end_us <= {9 * DAY} GROUP BY ALL)", 1))
def _(t):
    return report.consolidated_report(
        meta=t["meta"], timeline=_timeline(t), sampling=t["sampling"], histogram=interrupts.duration_histogram(t["dpc"]), functions=15,
        start_time=2 * DAY_S, end_time=9 * DAY_S,
    )


@query("percentile_summary", """
SELECT trace_id, cpu, count(*) AS count, CAST(min(value) AS DOUBLE) AS min, max(value) AS max, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(quantile_cont(value, 0.999), 4) AS p999 FROM base GROUP BY ALL""")
def _(t):
    return grouping.percentile_summary(t["base"], ["trace_id", "cpu"], "value")


@query("quantile_kinds", """
WITH l AS (SELECT trace_id, list_sort(list(k)) AS l FROM base GROUP BY trace_id)
SELECT trace_id, CAST(l[greatest(CAST(ceil(0.9 * len(l)) AS INT), 1)] AS DOUBLE) AS nearest, CAST(l[CAST(round_even(0.9 * (len(l) - 1), 0) AS INT) + 1] AS DOUBLE) AS by_index FROM l""")
def _(t):
    nearest = exact_quantiles(t["base"], ["trace_id"], "k", {"nearest": 0.9}, kind="nearest")
    return nearest.join(exact_quantiles(t["base"], ["trace_id"], "k", {"by_index": 0.9}, kind="index"), "trace_id")


@query("first_records", "SELECT trace_id, tid, min(seq) AS seq, arg_min(event_type, (ts_us, seq)) AS event_type FROM base GROUP BY ALL")
def _(t):
    return grouping.first_per_key(t["base"].select("trace_id", "tid", "ts_us", "seq", "event_type"), ["trace_id", "tid"], ["ts_us", "seq"]).drop("ts_us")


@query("class_union", "SELECT trace_id, count(*) AS n, count(module) AS with_module, count(stack_text) AS with_stack FROM (SELECT trace_id, module, NULL AS stack_text FROM dpc UNION ALL SELECT trace_id, NULL, stack_text FROM ready) GROUP BY trace_id")
def _(t):
    rows = grouping.union_classes([t["dpc"], t["ready"]])
    return rows.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.count("module").alias("with_module"), F.count("stack_text").alias("with_stack"))


@query("time_ordered_events", "SELECT trace_id, ts_us, seq FROM base ORDER BY trace_id, ts_us, seq")
def _(t):
    return grouping.in_time_order(t["base"].select("trace_id", "ts_us", "seq"))


@query("module_filters", """
SELECT module, regexp_matches(lower(module), 'tcpip|xdp') AS as_pattern, contains(lower(module), '.sys') AS as_text, lower(module) IN ('tcpip.sys','ndis.sys','xdp.sys','afd.sys','ws2_32.dll','net.sys') AS in_set,
  module IN ('tcpip.sys','afd.sys','ws2_32.dll') AND function = 'UdpReceive' AS receive_path, count(*) AS n FROM labelled GROUP BY ALL""")
def _(t):
    m = F.col("module")
    return t["labelled"].groupBy(
        "module", filters.matches_module(m, "TCPIP|XDP").alias("as_pattern"), filters.matches_module(m, ".SYS").alias("as_text"),
        filters.in_modules(m, filters.module_set(extra=["net.sys"])).alias("in_set"),
        filters.receive_path(m, F.col("function")).alias("receive_path"),
    ).agg(F.count(F.lit(1)).alias("n"))


@query("minimum_share", """
WITH s AS (SELECT trace_id, module, CAST(sum(weight) AS BIGINT) AS weight, sum(sum(weight)) OVER (PARTITION BY trace_id) AS total FROM labelled GROUP BY trace_id, module)
SELECT trace_id, module, weight FROM s WHERE weight >= total * 12.5 / 100""")
def _(t):
    sums = grouping.group_and_sum(t["labelled"], ["module"])
    totals = t["labelled"].groupBy("trace_id").agg(F.sum("weight").alias("total"))
    return filters.minimum_share(sums.join(totals, "trace_id"), "weight", "total", 12.5).select("trace_id", "module", "weight")


@query("display_text", """
SELECT trace_id, module, CASE WHEN p >= 10 THEN printf('%.1f%%', p) WHEN p >= 0.01 THEN printf('%.2f%%', p) ELSE printf('%.4f%%', p) END AS pct_text, format('{:,}', w) AS weight_text
FROM (SELECT trace_id, module, CAST(sum(weight) AS BIGINT) AS w, sum(weight) * 100.0 / sum(sum(weight)) OVER (PARTITION BY trace_id) AS p FROM labelled GROUP BY trace_id, module)""")
def _(t):
    sums = grouping.group_and_sum(t["labelled"], ["module"])
    return sums.select("trace_id", "module", percent_text(F.col("weight_pct")).alias("pct_text"), number_text(F.col("weight")).alias("weight_text"))
