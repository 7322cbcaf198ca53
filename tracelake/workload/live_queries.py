"""Queries of the streaming operators: the driver's events as a file stream in append mode, run to its end.

Events arrive in four batches: those in time; a tick; one event in twenty that comes late, from all
times; and a row far in the future, after which every window is final. Late events that the watermark has
passed must not count, and the check leaves them out by the same rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..streaming import live
from .derive import DAY
from .packet_queries import _fifo
from .registry import query

DELAY_MS = 3_600_000
FILES = 4  # of each batch
HOURS_6 = 21_600_000_000
_END = 400 * DAY  # beyond all events
_RANGE = "qpc, trace_id, seq, ts_us, cpu, pid, tid, event_type, value, k"


def _stream(t, *, again: bool = False) -> DataFrame:
    """The event stream; with ``again`` events in time come twice and one in twenty once more, late."""
    base = t["base"]
    late = F.col("seq") % 20 == 7
    twice = base.where(~late).withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy") if again else base.where(~late)
    repeated = base.where(late | (F.col("seq") % 20 == 9)) if again else base.where(late)

    def lone(at: int) -> DataFrame:
        # one row per kind of event, of a trace that no query reports
        kinds = F.element_at(F.array(*map(F.lit, ("click", "view"))), (F.col("id") % 2 + 1).cast("int"))
        row = {f.name: F.lit(0).cast(f.dataType) for f in base.schema.fields} | {"trace_id": F.lit("z"), "ts_us": F.lit(at).cast("bigint"), "event_type": kinds}
        return t.spark.range(0, FILES, 1, FILES).select(*[row[c].alias(c) for c in base.columns])

    folder = scratch(t.spark, "arrivals")
    # the source takes files in order of their time, FILES at once: each batch has as many
    for batch in (twice.repartition(FILES), lone(0), repeated.repartition(FILES), lone(_END)):
        batch.write.mode("append").parquet(folder)
    raw = t.spark.readStream.schema(base.schema).option("maxFilesPerTrigger", FILES).parquet(folder)
    return live.with_event_time(raw.select(
        "trace_id", "seq", "ts_us", "cpu", "pid", "tid", F.concat(F.lit("proc"), "pid").alias("process_name"), "event_type",
        F.ceil("value").alias("size"), F.floor("value").cast("double").alias("duration_us"),
    ))


def _reported(rows: DataFrame, **options) -> DataFrame:
    return live.run_available(rows, **options).where("trace_id <> 'z'")


# the watermark after the batches in time, and the events with their lateness
ARRIVED = f"""wm AS (SELECT (max(ts_us) // 1000 - {DELAY_MS}) * 1000 AS w FROM base WHERE seq % 20 <> 7),
ev AS (SELECT base.*, seq % 20 = 7 AS late, w FROM base, wm)"""


def _windowed(width: int, slide: int) -> str:
    """CTE ``win``: the windows of each event that take it, by their start."""
    starts = ", ".join(f"(ts_us // {slide} - {i}) * {slide}" for i in range(width // slide))
    return f"{ARRIVED}, win AS (SELECT * FROM (SELECT *, unnest([{starts}]) AS start_us FROM ev) WHERE NOT late OR start_us + {width} > w)"


@query("live_timeline", f"""
WITH {_windowed(DAY, DAY)} SELECT trace_id, cpu, start_us, count(*) AS samples, round(least(count(*) / 43.2 * 100.0, 100.0), 2) AS util_pct FROM win GROUP BY ALL""")
def _(t):
    return _reported(live.live_timeline(_stream(t), bucket="1 day", bucket_seconds=86_400.0, sample_rate_hz=0.0005, delay="1 hour"))


@query("live_traffic", f"""
WITH {_windowed(2 * DAY, DAY)} SELECT trace_id, 'proc' || pid AS process_name, pid, event_type AS kind, start_us, count(*) AS packets, CAST(sum(ceil(value)) AS BIGINT) AS bytes,
  round(count(*) / 172800.0, 4) AS pps, round(sum(ceil(value)) / 172800.0, 4) AS bytes_per_s FROM win GROUP BY trace_id, pid, event_type, start_us""")
def _(t):
    rows = _stream(t).withColumnRenamed("event_type", "kind")
    return _reported(live.live_traffic(rows, width="2 days", slide="1 day", seconds=172_800.0, delay="1 hour"))


HISTOGRAM = f"""
WITH {_windowed(DAY, DAY)}
SELECT trace_id, event_type AS module, CASE WHEN value < 1 THEN 0 ELSE CAST(1 AS BIGINT) << least(CAST(floor(log2(floor(value))) AS INT), 15) END AS low_us,
  CASE WHEN value < 1 THEN 1 WHEN value >= 32768 THEN 99999999 ELSE CAST(1 AS BIGINT) << (CAST(floor(log2(floor(value))) AS INT) + 1) END AS high_us, start_us, count(*) AS events FROM win GROUP BY ALL"""


def _histogram(t) -> DataFrame:
    return live.live_histogram(_stream(t).withColumnRenamed("event_type", "module"), width="1 day", delay="1 hour")


@query("live_histogram", HISTOGRAM)
def _(t):
    return _reported(_histogram(t))


@query("live_histogram_updates", HISTOGRAM)
def _(t):
    return _reported(_histogram(t), mode="update", keys=("trace_id", "module", "low_us", "high_us", "start_us"))


@query("live_drops", f"""
WITH {_windowed(DAY, DAY)} SELECT trace_id, event_type AS miniport, 'cpu' || cpu AS reason, start_us, count(*) AS drops, CAST(sum(ceil(value)) AS BIGINT) AS bytes FROM win GROUP BY ALL""")
def _(t):
    rows = _stream(t).withColumnRenamed("event_type", "miniport").withColumn("reason", F.concat(F.lit("cpu"), "cpu"))
    return _reported(live.live_drops(rows, width="1 day", delay="1 hour"))


def _sessions(rows: str, name: str, more: str = "") -> str:
    return f"""{name}_g AS (SELECT *, CASE WHEN ts_us - lag(ts_us) OVER o <= {DAY} THEN 0 ELSE 1 END AS f FROM {rows} WINDOW o AS (PARTITION BY trace_id, pid, tid ORDER BY ts_us)),
{name}_i AS (SELECT *, sum(f) OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_us) AS b FROM {name}_g),
{name} AS (SELECT *, max(ts_us) OVER (PARTITION BY trace_id, pid, tid, b) AS ends FROM {name}_i)"""


# sessions that the watermark has passed are closed; late events meet the open ones only
@query("live_batches", f"""
WITH {ARRIVED}, intime AS (SELECT trace_id, pid, tid, ts_us, w FROM ev WHERE NOT late),
{_sessions("intime", "first")},
rest AS (SELECT trace_id, pid, tid, ts_us, w FROM first WHERE ends + {DAY} > w UNION ALL SELECT trace_id, pid, tid, ts_us, w FROM ev WHERE late AND ts_us + {DAY} > w),
{_sessions("rest", "second")},
every AS (SELECT trace_id, pid, tid, ts_us, 1 AS part, b FROM first WHERE ends + {DAY} <= w UNION ALL SELECT trace_id, pid, tid, ts_us, 2, b FROM second)
SELECT trace_id, pid AS socket_handle, tid, count(*) AS events, min(ts_us) AS first_us, max(ts_us) AS last_us FROM every GROUP BY trace_id, pid, tid, part, b""")
def _(t):
    rows = _stream(t).withColumn("socket_handle", F.col("pid"))
    return _reported(live.live_batches(rows, gap="1 day", delay="1 hour"))


@query("live_deduplicated", f"WITH {ARRIVED} SELECT trace_id, seq, ts_us FROM ev WHERE NOT late OR ts_us > w")
def _(t):
    return _reported(live.deduplicated(_stream(t, again=True), delay="1 hour").select("trace_id", "seq", "ts_us"))


@query("live_send_recv", f"""
WITH RECURSIVE {ARRIVED.replace("ev AS", "all_ev AS")},
{_fifo("SELECT trace_id, 'p' || pid AS key, ts_us, seq, event_type AS flow, event_type IN ('view', 'click') AS sent FROM all_ev WHERE NOT late OR ts_us > w", HOURS_6)}
SELECT trace_id, key AS match, s_us AS opened_us, r_us AS closed_us, s_seq AS opened_seq, r_seq AS closed_seq, r_us - s_us AS latency_us
FROM (SELECT f.trace_id, f.key, s.ts_us AS s_us, r.ts_us AS r_us, s.seq AS s_seq, r.seq AS r_seq FROM fifo f
  JOIN nb s ON s.trace_id = f.trace_id AND s.key = f.key AND s.sent AND s.num = f.pick JOIN nb r ON r.trace_id = f.trace_id AND r.key = f.key AND NOT r.sent AND r.num = f.num)""")
def _(t):
    way = F.when(F.col("event_type").isin("view", "click"), F.lit("Send")).otherwise(F.lit("Recv"))
    rows = _stream(t).withColumns({"match": F.concat(F.lit("p"), "pid"), "direction": way})
    return _reported(live.live_send_recv(rows, window_us=HOURS_6, delay="1 hour"), pairs=True)


@query("live_ready_waits", f"""
WITH {ARRIVED}, kept AS (SELECT * FROM ev WHERE NOT late OR ts_us > w), r AS (SELECT * FROM kept WHERE event_type = 'click'), s AS (SELECT * FROM kept WHERE event_type <> 'click')
SELECT r.trace_id, r.tid, r.ts_us AS opened_us, s.ts_us AS closed_us, r.seq AS opened_seq, s.seq AS closed_seq, s.ts_us - r.ts_us AS wait_us
FROM r ASOF JOIN s ON r.trace_id = s.trace_id AND r.tid = s.tid AND s.ts_us >= r.ts_us WHERE s.ts_us - r.ts_us <= {DAY}""")
def _(t):
    rows = _stream(t)
    ready = rows.where("event_type = 'click'").withColumn("readied_tid", F.col("tid"))
    switches = rows.where("event_type <> 'click'").withColumn("new_tid", F.col("tid"))
    return _reported(live.live_ready_waits(ready, switches, window_us=DAY, delay="1 hour"), pairs=True)


@query("live_ready_wait_candidates", f"""
WITH {ARRIVED}, ends AS (SELECT (least(max(ts_us) FILTER (event_type = 'click'), max(ts_us) FILTER (event_type <> 'click')) // 1000 - {DELAY_MS}) * 1000 AS w FROM base WHERE seq % 20 <> 7),
kept AS (SELECT ev.* EXCLUDE (w) FROM ev, ends WHERE NOT late OR ts_us > ends.w), r AS (SELECT * FROM kept WHERE event_type = 'click'), s AS (SELECT * FROM kept WHERE event_type <> 'click')
SELECT r.trace_id, r.tid, r.seq AS ready_seq, s.seq AS switch_seq FROM r JOIN s ON r.trace_id = s.trace_id AND r.tid = s.tid AND s.ts_us BETWEEN r.ts_us AND r.ts_us + {HOURS_6}""")
def _(t):
    rows = _stream(t)
    found = live.ready_wait_candidates(
        rows.where("event_type = 'click'").withColumn("readied_tid", F.col("tid")),
        rows.where("event_type <> 'click'").withColumn("new_tid", F.col("tid")), window="6 hours", delay="1 hour")
    return _reported(found.select("trace_id", "tid", "ready_seq", "switch_seq"))
