"""Queries of the event store and of files read back: derived tables are written, then scanned, listed and checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import interrupts, report
from ..session import folder_of, scratch
from ..sources import export, store
from ..sources.text_reports import load_csv
from .cpu_queries import DAY_S, _timeline
from .derive import DAY
from .registry import query
from .report_queries import REPORT

FILE_BYTES = 100_000
SAMPLE = ("trace_id", "seq", "qpc", "cpu", "pid", "tid", "payload_tid", "address", "weight", "profile_weight")


def _stored(t, *names: str) -> str:
    """A store of the derived tables; samples come in two generations, by the parity of their number."""
    root = scratch(t.spark, "store")
    for name in names:
        if name == "sampled_profile":
            even = F.col("seq") % 2 == 0
            for part in (t["samples"].where(even), t["samples"].where(~even)):
                store.write_events(part, root, "SampledProfile", file_bytes=FILE_BYTES)
        else:
            store.write_events(t[name], root, name, file_bytes=FILE_BYTES)
    return root


@query("store_round_trip", f"SELECT {', '.join(SAMPLE)} FROM samples")
def _(t):
    return store.scan(t.spark, _stored(t, "sampled_profile"), "PerfInfo/SampledProfile", columns=list(SAMPLE), include_time=False)


@query("store_scan_by_trace_clock", f"""
SELECT trace_id, seq, ts_us - CASE trace_id WHEN 't1' THEN {DAY} ELSE 0 END AS ts_us, weight FROM samples
WHERE ts_us - CASE trace_id WHEN 't1' THEN {DAY} ELSE 0 END BETWEEN {2 * DAY} AND {5 * DAY} AND trace_id <> 't2'""")
def _(t):
    shift = F.when(F.col("trace_id") == "t1", F.lit(DAY * 10)).otherwise(F.lit(0))
    meta = t["meta"].withColumn("origin", F.col("origin") + shift)
    return store.scan(
        t.spark, _stored(t, "sampled_profile"), "sampled_profile", meta=meta, start_time=2 * DAY_S, end_time=5 * DAY_S,
        traces=["t0", "t1"], columns=["trace_id", "seq", "weight"])


@query("store_scan_by_cpu", f"SELECT trace_id, seq, cpu, ts_us FROM samples WHERE cpu IN (0, 5) AND ts_us <= {9 * DAY}")
def _(t):
    return store.scan(
        t.spark, _stored(t, "sampled_profile"), "sampled_profile", timebase=(5000, 10_000_000), end_time=9 * DAY_S, cpu_filter="0,5",
        columns=["trace_id", "seq", "cpu"])


@query("store_statistics", """
SELECT trace_id, count(*) AS rows, min(qpc) AS first_qpc, max(qpc) AS last_qpc FROM samples GROUP BY trace_id""")
def _(t):
    return store.dataset_statistics(t.spark, _stored(t, "sampled_profile"), "sampled_profile").drop("files")


@query("stored_traces", """
SELECT trace_id, 'sampled_profile' AS event_class, count(*) AS rows, min(qpc) AS first_qpc, max(qpc) AS last_qpc FROM samples GROUP BY trace_id
UNION ALL SELECT trace_id, 'cswitch', count(*), min(qpc), max(qpc) FROM cswitch GROUP BY trace_id
UNION ALL SELECT trace_id, 'process', count(*), min(qpc), max(qpc) FROM process GROUP BY trace_id""")
def _(t):
    return store.stored_traces(t.spark, _stored(t, "sampled_profile", "cswitch", "process")).drop("files")


@query("store_overwrite", "SELECT trace_id, seq, qpc, new_tid, wait_reason FROM cswitch WHERE wait_reason <> ''")
def _(t):
    root = _stored(t, "cswitch")
    store.write_events(t["cswitch"].where("wait_reason <> ''"), root, "cswitch", mode="overwrite", file_bytes=FILE_BYTES)
    return store.scan(t.spark, root, "cswitch", columns=["trace_id", "seq", "qpc", "new_tid", "wait_reason"], include_time=False)


@query("store_validation", """
SELECT * FROM (VALUES ('sampled_profile', 'missing or damaged file', 1), ('sampled_profile', 'stray file', 1)) v(event_class, problem, files)
WHERE (SELECT count(*) FROM samples) > 0""")
def _(t):
    # one file of each generation is replaced under a new name: that one is stray, the old one missing
    root = _stored(t, "sampled_profile")
    name = store.zones(t.spark, root, "sampled_profile").agg(F.min("file")).first()[0]
    files, old = folder_of(t.spark, f"{store.class_path(root, 'sampled_profile')}/{name}")
    files.rename(old, old.suffix("-copy.parquet"))
    found = store.validate(t.spark, root, "sampled_profile")
    return found.groupBy("event_class", "problem").agg(F.count(F.lit(1)).alias("files"))


@query("table_before_store", """
SELECT 'sampled_profile' AS event_class, count(*) AS rows FROM samples WHERE seq % 3 = 0 UNION ALL SELECT 'cswitch', count(*) FROM cswitch UNION ALL SELECT 'dpc', 0""")
def _(t):
    # samples are given as a table, which goes before the store; switches are stored; nobody has the third
    root = _stored(t, "sampled_profile", "cswitch")
    tables = {"PerfInfo/SampledProfile": t["samples"].where("seq % 3 = 0")}

    def rows(name: str) -> DataFrame:
        found = store.open_events(t.spark, name, tables=tables, root=root)
        return found.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("event_class"), "rows")

    return rows("sampled_profile").union(rows("cswitch")).union(rows("dpc"))


@query("loose_csv", """
SELECT CAST(seq AS DOUBLE) AS seq, trace_id AS "trace id", round(value * 1000, 4) AS amount, CASE WHEN k % 3 = 0 THEN 'n/a' ELSE CAST(k AS VARCHAR) END AS grade_text, CASE WHEN k % 3 <> 0 THEN CAST(k AS DOUBLE) END AS grade FROM base""")
def _(t):
    # a third of the grades are words; amounts have thousands separators; the last column has no name
    path = scratch(t.spark, "csv")
    b = t["base"]
    grade = F.when(F.col("k") % 3 == 0, F.lit("n/a")).otherwise(F.col("k").cast("string"))
    export.write_csv(b.select(
        F.format_string("%,d", "seq").alias("seq"), F.col("trace_id").alias("trace id"), (F.col("value") * 1000).cast("string").alias("amount"),
        F.concat(F.lit("'"), grade).alias("grade_text"), grade.alias("grade"), F.lit("x").alias("Unnamed: 5")), path)
    return load_csv(t.spark, path).withColumn("grade_text", F.ltrim(F.col("grade_text"), F.lit("'")))


@query("exported_report", REPORT)
def _(t):
    path = scratch(t.spark, "report")
    whole = report.consolidated_report(
        meta=t["meta"], timeline=_timeline(t), sampling=t["sampling"], histogram=interrupts.duration_histogram(t["dpc"]), functions=15)
    export.write_report(whole, path)
    return t.spark.read.option("header", "true").schema("section string, metric string, value double, trace_id string").csv(path)
