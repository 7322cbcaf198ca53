"""Queries of the flow, socket, request and connection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import app, attribution, flows
from .derive import DAY
from .registry import query

ENDS = "local_addr, local_port, remote_addr, remote_port"
SLICE = 60 * DAY


def _tcp(t, table="wire"):
    wire = t[table]
    return {
        "recv": wire.where("flag = 'A' AND status = 'F'"),
        "send": wire.where("flag = 'N' AND status = 'F'"),
        "rtx": wire.where("flag = 'R' AND status = 'F'").withColumn("retransmit_count", F.col("n")),
    }


def _flows(t):
    return flows.traffic(_tcp(t))


@query("connection_summary", f"""
SELECT trace_id, {ENDS}, any_value(process_name) AS process_name,
  CAST(sum(CASE WHEN flag = 'A' THEN size ELSE 0 END) AS BIGINT) AS recv_bytes, CAST(sum(CASE WHEN flag = 'N' THEN size ELSE 0 END) AS BIGINT) AS send_bytes,
  count(CASE WHEN flag <> 'R' THEN 1 END) AS packets, CAST(sum(CASE WHEN flag = 'R' THEN n ELSE 0 END) AS BIGINT) AS retransmits,
  CAST(sum(CASE WHEN flag <> 'R' THEN size ELSE 0 END) AS BIGINT) AS total_bytes, round((max(ts_us) - min(ts_us)) / 1e6, 4) AS duration_s
FROM wire WHERE status = 'F' GROUP BY ALL""")
def _(t):
    return flows.connection_summary(_flows(t))


@query("connection_summary_of_process", f"""
SELECT trace_id, {ENDS}, any_value(process_name) AS process_name,
  CAST(sum(CASE WHEN flag = 'A' THEN size ELSE 0 END) AS BIGINT) AS recv_bytes, CAST(sum(CASE WHEN flag = 'N' THEN size ELSE 0 END) AS BIGINT) AS send_bytes,
  count(CASE WHEN flag <> 'R' THEN 1 END) AS packets, CAST(sum(CASE WHEN flag = 'R' THEN n ELSE 0 END) AS BIGINT) AS retransmits,
  CAST(sum(CASE WHEN flag <> 'R' THEN size ELSE 0 END) AS BIGINT) AS total_bytes, round((max(ts_us) - min(ts_us)) / 1e6, 4) AS duration_s
FROM wire WHERE status = 'F' AND process_name ILIKE '%SVC1%' GROUP BY ALL""")
def _(t):
    return flows.connection_summary(_flows(t), process_filter="SVC1")


DIM = """dim AS (SELECT trace_id, conn_id, arg_max(local_addr, (ts_us, seq)) AS la, arg_max(local_port, (ts_us, seq)) AS lp, arg_max(remote_addr, (ts_us, seq)) AS ra,
   arg_max(remote_port, (ts_us, seq)) AS rp, arg_max(pid, (ts_us, seq)) AS dp, arg_max(process_name, (ts_us, seq)) AS dn FROM connects GROUP BY ALL)"""
FILLED = f"""{DIM}, filled AS (SELECT w.trace_id, w.seq, w.ts_us, w.conn_id, w.size, w.n, w.flag, w.status,
   CASE WHEN w.pid = 0 THEN coalesce(dp, 0) ELSE w.pid END AS pid, CASE WHEN w.process_name = '' THEN coalesce(dn, '<unknown>') ELSE w.process_name END AS process_name,
   CASE WHEN w.local_addr = '' THEN coalesce(la, '<unknown>') ELSE w.local_addr END AS local_addr, CASE WHEN w.local_port = 0 THEN coalesce(lp, 0) ELSE w.local_port END AS local_port,
   CASE WHEN w.remote_addr = '' THEN coalesce(ra, '<unknown>') ELSE w.remote_addr END AS remote_addr, CASE WHEN w.remote_port = 0 THEN coalesce(rp, 0) ELSE w.remote_port END AS remote_port
   FROM wire_gaps w LEFT JOIN dim ON dim.trace_id = w.trace_id AND dim.conn_id = w.conn_id)"""


def _dimension(t):
    c = t["connects"]
    none = c.where("false")
    return flows.connections(c, none, none)


@query("connection_dimension", f"""
WITH {DIM} SELECT trace_id, conn_id, la AS dim_local_addr, ra AS dim_remote_addr, lp AS dim_local_port, rp AS dim_remote_port, dp AS dim_pid, dn AS dim_process_name FROM dim""")
def _(t):
    return _dimension(t)


@query("enriched_packets", f"WITH {FILLED} SELECT trace_id, seq, conn_id, pid, process_name, {ENDS} FROM filled")
def _(t):
    rows = t["wire_gaps"].select("trace_id", "seq", "conn_id", "pid", "process_name", *attribution.ENDS)
    return attribution.enrich_by_connection(rows, _dimension(t), "conn_id", None)


@query("enriched_connection_summary", f"""
WITH {FILLED} SELECT trace_id, {ENDS}, arg_min(process_name, CASE WHEN process_name <> '<unknown>' THEN ts_us END) AS process_name,
  CAST(sum(CASE WHEN flag = 'A' THEN size ELSE 0 END) AS BIGINT) AS recv_bytes, CAST(sum(CASE WHEN flag = 'N' THEN size ELSE 0 END) AS BIGINT) AS send_bytes,
  count(CASE WHEN flag <> 'R' THEN 1 END) AS packets, CAST(sum(CASE WHEN flag = 'R' THEN n ELSE 0 END) AS BIGINT) AS retransmits,
  CAST(sum(CASE WHEN flag <> 'R' THEN size ELSE 0 END) AS BIGINT) AS total_bytes, round((max(ts_us) - min(ts_us)) / 1e6, 4) AS duration_s
FROM filled WHERE status = 'F' AND local_addr <> '<unknown>' GROUP BY ALL""")
def _(t):
    rows = flows.traffic(_tcp(t, "wire_gaps"), dimension=_dimension(t))
    return flows.connection_summary(rows.where("local_addr <> '<unknown>'"))


@query("enriched_sockets", """
SELECT s.trace_id, s.seq, s.socket_handle, c.local_addr, c.local_port, c.remote_addr, c.remote_port, c.process_name FROM connects s JOIN connects c ON c.trace_id = s.trace_id AND c.socket_handle = s.socket_handle""")
def _(t):
    c = t["connects"]
    io = c.select("trace_id", "ts_us", "seq", "pid", "process_name", "socket_handle")
    dimension = flows.sockets(c.where("priority LIKE '1%'"), c.where("priority NOT LIKE '1%'"), io, io)
    rows = c.select(
        "trace_id", "seq", "socket_handle", F.lit(0).cast("bigint").alias("pid"), F.lit("").alias("process_name"),
        F.lit("").alias("local_addr"), F.lit(0).cast("bigint").alias("local_port"), F.lit("").alias("remote_addr"), F.lit(0).cast("bigint").alias("remote_port"),
    )
    return attribution.enrich_by_connection(rows, dimension, "socket_handle", None).drop("pid")


def _udp(t):
    wire = t["wire"].drop("conn_id")
    return {"recv": wire.where("flag = 'A' AND status = 'O'"), "send": wire.where("flag = 'N' AND status = 'O'")}


@query("datagram_summary", f"""
SELECT trace_id, {ENDS}, any_value(process_name) AS process_name, count(CASE WHEN flag = 'A' THEN 1 END) AS recv_packets, count(CASE WHEN flag = 'N' THEN 1 END) AS send_packets,
  count(*) AS packets, CAST(sum(size) AS BIGINT) AS bytes, round((max(ts_us) - min(ts_us)) / 1e6, 4) AS duration_s,
  round(CASE WHEN max(ts_us) > min(ts_us) THEN count(*) / ((max(ts_us) - min(ts_us)) / 1e6) ELSE 0 END, 4) AS pps
FROM wire WHERE status = 'O' AND flag <> 'R' GROUP BY ALL""")
def _(t):
    return flows.datagram_summary(flows.traffic(_udp(t)))


@query("retransmit_summary", f"""
WITH x AS (SELECT trace_id, {ENDS}, any_value(process_name) AS process_name, CAST(sum(CASE WHEN flag = 'R' THEN n ELSE 0 END) AS BIGINT) AS retransmits,
  count(CASE WHEN flag <> 'R' THEN 1 END) AS p FROM wire WHERE status = 'F' GROUP BY ALL HAVING count(CASE WHEN flag = 'R' THEN 1 END) > 0)
SELECT trace_id, {ENDS}, process_name, retransmits, p + retransmits AS packets, round(retransmits / (p + retransmits), 4) AS rate, retransmits / (p + retransmits) > 0.001 AS high FROM x""")
def _(t):
    return flows.retransmit_summary(_flows(t))


def _rate(proto, flag):
    span = "nullif(max(CASE WHEN {c} THEN ts_us END) - min(CASE WHEN {c} THEN ts_us END), 0) / 1e6"
    c = f"status = '{proto}' AND flag = '{flag}'"
    return (
        f"coalesce(count(CASE WHEN {c} THEN 1 END) / ({span.format(c=c)}), 0)",
        f"coalesce(sum(CASE WHEN {c} THEN size END) / ({span.format(c=c)}), 0)",
    )


_R = {f"{p}_{d}": _rate(s, f) for p, s in (("tcp", "F"), ("udp", "O")) for d, f in (("recv", "A"), ("send", "N"))}


@query("process_throughput", f"""
SELECT trace_id, process_name, pid, {", ".join(f"round({a}, 4) AS {k}_pps, round({b} / 1048576.0, 4) AS {k}_mib_s" for k, (a, b) in _R.items())},
  round({" + ".join(b for _, b in _R.values())}, 4) AS total_bytes_s
FROM wire WHERE flag <> 'R' GROUP BY trace_id, process_name, pid""")
def _(t):
    tcp, udp = _tcp(t), _udp(t)
    return flows.process_throughput(flows.traffic({
        "tcp_recv": tcp["recv"].drop("conn_id"), "tcp_send": tcp["send"].drop("conn_id"),
        "udp_recv": udp["recv"], "udp_send": udp["send"],
    }))


@query("packet_drops", """
SELECT trace_id, 'nic' || tid % 3 AS miniport, 'reason' || n AS reason, count(*) AS drops, CAST(sum(size) AS BIGINT) AS bytes,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY trace_id), 4) AS pct FROM wire WHERE flag = 'R' GROUP BY trace_id, tid % 3, n""")
def _(t):
    return flows.packet_drops(t["wire"].where("flag = 'R'").select(
        "trace_id", F.concat(F.lit("nic"), F.col("tid") % 3).alias("miniport"), F.concat(F.lit("reason"), "n").alias("reason"), "size"
    ))


def _latency_sql(where="true", source="connects"):
    return f"""
WITH g AS (SELECT trace_id, process_name, pid, ts_us - lag(ts_us) OVER (PARTITION BY trace_id, pid, tid ORDER BY ts_us, seq) AS d FROM {source} WHERE {where})
SELECT trace_id, process_name, pid, round(quantile_cont(d, 0.5), 4) AS p50_us, round(quantile_cont(d, 0.95), 4) AS p95_us, round(quantile_cont(d, 0.99), 4) AS p99_us,
  round(quantile_cont(d, 0.999), 4) AS p999_us, count(d) AS samples FROM g WHERE d IS NOT NULL GROUP BY ALL"""


@query("connect_latency", _latency_sql().replace(", 4) AS p", ", 0) AS p"), digits=0)
def _(t):
    return flows.operation_latency(t["connects"], slice_us=SLICE)


@query("accept_latency", _latency_sql("priority LIKE '1%'").replace(", 4) AS p", ", 0) AS p"), digits=0)
def _(t):
    accepts = t["connects"].where("priority LIKE '1%'")
    return flows.operation_latency(accepts.where("false"), fallback=accepts, slice_us=SLICE)


@query("completion_batches", f"""
WITH g AS (SELECT *, ts_us - lag(ts_us) OVER (PARTITION BY trace_id, conn_id, tid ORDER BY ts_us, seq) AS d FROM (SELECT trace_id, o_custkey AS conn_id, tid % 5 AS tid, ts_us, seq, process_name, pid FROM wire WHERE flag = 'A'))
SELECT trace_id, conn_id AS socket_handle, tid, any_value(process_name) AS process_name, any_value(pid) AS pid, count(*) AS events,
  count(CASE WHEN d IS NULL OR d > {20 * DAY} THEN 1 END) AS batches, round(count(*) / count(CASE WHEN d IS NULL OR d > {20 * DAY} THEN 1 END), 4) AS events_per_batch FROM g GROUP BY trace_id, conn_id, tid""")
def _(t):
    recv = t["wire"].where("flag = 'A'").select(
        "trace_id", F.col("o_custkey").alias("socket_handle"), (F.col("tid") % 5).alias("tid"), "ts_us", "seq", "process_name", "pid"
    )
    return flows.completion_batches(recv, window_us=20 * DAY, slice_us=SLICE)


@query("socket_lifecycle", f"""
WITH c AS (SELECT trace_id, pid, socket_handle, min(ts_us) AS created_us FROM connects GROUP BY ALL),
z AS (SELECT trace_id, pid, socket_handle, max(ts_us + seq % 100 * {DAY} - 10 * {DAY}) AS closed_us FROM connects WHERE status = 'F' GROUP BY ALL),
p AS (SELECT trace_id, pid, conn_id AS socket_handle, count(CASE WHEN flag = 'A' THEN 1 END) AS r, count(CASE WHEN flag = 'N' THEN 1 END) AS s, sum(size) AS b FROM wire WHERE flag <> 'R' GROUP BY ALL),
k AS (SELECT trace_id, pid, socket_handle FROM c UNION SELECT trace_id, pid, socket_handle FROM p)
SELECT trace_id, pid, socket_handle, 'svc' || pid AS process_name, created_us, closed_us, coalesce(r, 0) AS recv_count, coalesce(s, 0) AS send_count, CAST(coalesce(b, 0) AS BIGINT) AS bytes,
  CASE WHEN closed_us >= created_us THEN (closed_us - created_us) / 1e6 END AS duration_s,
  CASE WHEN closed_us >= created_us THEN 'closed' WHEN closed_us IS NULL THEN 'open' ELSE '?' END AS state
FROM k LEFT JOIN c USING (trace_id, pid, socket_handle) LEFT JOIN z USING (trace_id, pid, socket_handle) LEFT JOIN p USING (trace_id, pid, socket_handle)""")
def _(t):
    c, wire = t["connects"], t["wire"].withColumn("socket_handle", F.col("conn_id"))
    return flows.socket_lifecycle({
        "connect": c.where("priority NOT LIKE '1%'"), "accept": c.where("priority LIKE '1%'"),
        "close": c.where("status = 'F'").withColumn("ts_us", F.expr(f"ts_us + seq % 100 * {DAY} - 10 * {DAY}")),
        "recv": wire.where("flag = 'A'"), "send": wire.where("flag = 'N'"),
    })


@query("socket_affinity", """
WITH c AS (SELECT trace_id, tid AS h, CASE WHEN tid % 2 = 0 AND n < 7 THEN 1 ELSE cpu END AS cpu, count(*) AS n, min((ts_us, seq)) AS f, arg_min(process_name, (ts_us, seq)) AS pn, arg_min(pid, (ts_us, seq)) AS pd
  FROM wire WHERE flag = 'A' AND tid <> 0 GROUP BY ALL),
x AS (SELECT trace_id, h, arg_min(pn, f) AS process_name, arg_min(pd, f) AS pid, CAST(sum(n) AS BIGINT) AS events, arg_max(cpu, (n, -cpu)) AS top_cpu, max(n) AS top_n, count(*) AS distinct_cpus FROM c GROUP BY ALL)
SELECT trace_id, h AS socket_handle, process_name, pid, events, top_cpu, round(top_n * 100.0 / events, 4) AS top_cpu_pct, distinct_cpus,
  CASE WHEN events < 10 THEN 'low confidence' WHEN top_n * 100.0 / events >= 90 THEN 'affinity working' ELSE 'affinity not working' END AS status FROM x""")
def _(t):
    recv = t["wire"].where("flag = 'A'").select(
        "trace_id", "ts_us", "seq", F.col("tid").alias("socket_handle"), "process_name", "pid",
        F.expr("CASE WHEN tid % 2 = 0 AND n < 7 THEN 1 ELSE cpu END").alias("cpu"),
    )
    return flows.socket_affinity(recv)


# ---- requests -----------------------------------------------------------------------------

REQUESTS = """rq AS (
  SELECT r.trace_id, r.request_id, verb, url, r.ts_us AS recv_us, s.status_code, s.content_length,
    greatest(s.ts - r.ts_us, 0) AS recv_to_send_us, CASE WHEN s.ts IS NOT NULL AND d.ts IS NOT NULL THEN greatest(s.ts - d.ts, 0) END AS deliver_to_send_us,
    CASE WHEN c.ts IS NOT NULL THEN greatest(c.ts - r.ts_us, 0) END AS recv_to_close_us, s.ts IS NULL AS nosend
  FROM http_recv r
  LEFT JOIN (SELECT trace_id, request_id, min(ts_us) AS ts, arg_min(status_code, (ts_us, seq)) AS status_code, arg_min(content_length, (ts_us, seq)) AS content_length FROM http_send GROUP BY ALL) s USING (trace_id, request_id)
  LEFT JOIN (SELECT trace_id, request_id, min(ts_us) AS ts FROM http_deliver GROUP BY ALL) d USING (trace_id, request_id)
  LEFT JOIN (SELECT trace_id, request_id, min(ts_us) AS ts FROM http_close GROUP BY ALL) c USING (trace_id, request_id)),
rr AS (SELECT trace_id, request_id, verb, url, recv_us, status_code, content_length, CASE WHEN NOT nosend THEN recv_to_send_us END AS recv_to_send_us,
  deliver_to_send_us, recv_to_close_us, nosend AND coalesce(recv_to_close_us, 0) = 0 AS in_flight FROM rq)"""


def _requests(t, **options):
    return app.request_lifecycle(t["http_recv"], t["http_send"], t["http_deliver"], t["http_close"], **options)


@query("request_lifecycle", f"WITH {REQUESTS} SELECT * FROM rr")
def _(t):
    return _requests(t)


@query("request_lifecycle_of_url", f"WITH {REQUESTS} SELECT * FROM rr WHERE url ILIKE '%URGENT/3%'")
def _(t):
    return _requests(t, url_filter="urgent/3")


@query("request_report", f"""
WITH {REQUESTS} SELECT trace_id, count(*) AS requests, count(recv_to_send_us) AS completed, count(CASE WHEN in_flight THEN 1 END) AS in_flight,
  {", ".join(f"CAST(quantile_disc({s}_us, {q}) AS DOUBLE) AS {s}_{n}_us" for s in ("recv_to_send", "deliver_to_send") for n, q in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99), ("p999", 0.999)))}
FROM rr GROUP BY trace_id""")
def _(t):
    return app.request_report(_requests(t))


@query("queue_depth", """
WITH dn AS (SELECT coalesce(s.trace_id, c.trace_id) AS trace_id, coalesce(s.request_id, c.request_id) AS request_id, coalesce(s.ts, c.ts) AS ts FROM
   (SELECT trace_id, request_id, min(ts_us) AS ts FROM http_send GROUP BY ALL) s FULL JOIN (SELECT trace_id, request_id, min(ts_us) AS ts FROM http_close GROUP BY ALL) c ON s.trace_id = c.trace_id AND s.request_id = c.request_id),
cp AS (SELECT dn.*, d.url_group_id, d.ts_us AS dts FROM dn JOIN http_deliver d ON d.trace_id = dn.trace_id AND d.request_id = dn.request_id WHERE d.url_group_id <> 0),
st AS (SELECT trace_id, url_group_id, ts_us, request_id, 0 AS kind, 1 AS step FROM http_deliver WHERE url_group_id <> 0
   UNION ALL SELECT trace_id, url_group_id, ts, request_id, 1, -1 FROM cp),
r AS (SELECT *, sum(step) OVER w AS s FROM st WINDOW w AS (PARTITION BY trace_id, url_group_id ORDER BY ts_us, kind, request_id ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, s - least(0, min(s) OVER w) AS depth, lead(ts_us) OVER (PARTITION BY trace_id, url_group_id ORDER BY ts_us, kind, request_id) AS nts FROM r
   WINDOW w AS (PARTITION BY trace_id, url_group_id ORDER BY ts_us, kind, request_id ROWS UNBOUNDED PRECEDING)),
g AS (SELECT trace_id, url_group_id, CAST(max(depth) AS BIGINT) AS peak_depth, round(sum(depth * coalesce(nts - ts_us, 0)) / (max(ts_us) - min(ts_us)), 4) AS avg_depth,
   count(CASE WHEN kind = 0 THEN 1 END) AS deliveries, count(CASE WHEN kind = 1 THEN 1 END) AS completions FROM d GROUP BY ALL)
SELECT g.*, p50_us, p99_us FROM g LEFT JOIN (SELECT trace_id, url_group_id, CAST(quantile_disc(ts - dts, 0.5) AS DOUBLE) AS p50_us, CAST(quantile_disc(ts - dts, 0.99) AS DOUBLE) AS p99_us
  FROM cp WHERE ts >= dts GROUP BY ALL) l USING (trace_id, url_group_id)""")
def _(t):
    return app.queue_depth(t["http_deliver"], t["http_send"], t["http_close"], slice_us=SLICE)


# ---- QUIC ---------------------------------------------------------------------------------

QUIC = """qc AS (
  SELECT coalesce(c.trace_id, z.trace_id, r.trace_id, s.trace_id) AS trace_id, coalesce(c.connection_id, z.connection_id, r.connection_id, s.connection_id) AS connection_id,
    coalesce(c.process_name, z.process_name, '') AS process_name, coalesce(c.remote_addr, '') AS remote_addr, coalesce(c.cid, '') AS cid,
    coalesce(greatest(z.ts_us - c.ts_us, 0), 0) AS lifetime_us, coalesce(rp, 0) AS recv_packets, coalesce(sp, 0) AS send_packets,
    CAST(coalesce(rb, 0) AS BIGINT) AS recv_bytes, CAST(coalesce(sb, 0) AS BIGINT) AS send_bytes, coalesce(greatest(rng - dst, 0), 0) AS lost_packets, c.process_name AS created_by
  FROM quic_created c FULL JOIN quic_closed z ON z.trace_id = c.trace_id AND z.connection_id = c.connection_id
  FULL JOIN (SELECT trace_id, connection_id, count(*) AS rp, sum(size) AS rb, max(packet_number) - min(packet_number) + 1 AS rng, count(DISTINCT packet_number) AS dst FROM quic_packets WHERE flag = 'A' GROUP BY ALL) r
    ON r.trace_id = coalesce(c.trace_id, z.trace_id) AND r.connection_id = coalesce(c.connection_id, z.connection_id)
  FULL JOIN (SELECT trace_id, connection_id, count(*) AS sp, sum(size) AS sb FROM quic_packets WHERE flag = 'N' GROUP BY ALL) s
    ON s.trace_id = coalesce(c.trace_id, z.trace_id, r.trace_id) AND s.connection_id = coalesce(c.connection_id, z.connection_id, r.connection_id))"""


def _quic(t, **options):
    p = t["quic_packets"]
    return app.quic_connections(t["quic_created"], t["quic_closed"], p.where("flag = 'A'"), p.where("flag = 'N'"), **options)


@query("quic_connections", f"WITH {QUIC} SELECT * EXCLUDE (created_by) FROM qc")
def _(t):
    return _quic(t)


@query("quic_connections_of_process", f"WITH {QUIC} SELECT * EXCLUDE (created_by) FROM qc WHERE created_by ILIKE '%APP2%'")
def _(t):
    return _quic(t, process_filter="APP2")


@query("quic_ack_delays", """
SELECT a.trace_id, a.connection_id, CAST(quantile_disc(ack_delay, 0.5) AS DOUBLE) AS p50_us, CAST(quantile_disc(ack_delay, 0.99) AS DOUBLE) AS p99_us, CAST(quantile_disc(ack_delay, 0.999) AS DOUBLE) AS p999_us,
  count(*) AS acks, coalesce(any_value(c.process_name), '') AS process_name, quantile_disc(ack_delay, 0.99) >= 25000 AS high
FROM quic_packets a LEFT JOIN quic_created c ON c.trace_id = a.trace_id AND c.connection_id = a.connection_id WHERE flag = 'R' GROUP BY a.trace_id, a.connection_id""")
def _(t):
    return app.ack_delays(t["quic_packets"].where("flag = 'R'"), t["quic_created"])


# FNV-1a in the check runs over the eight bytes of an id, one list step per byte
FNV = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, 8), lambda i: CAST(('0x' || substr(cid, i * 2 + 1, 2)) AS BIGINT))), lambda h, x: xor(h, x) * 16777619 % 4294967296)"


@query("cid_distribution", f"""
WITH cpus AS (SELECT trace_id, max(cpu) + 1 AS m FROM quic_packets WHERE flag = 'A' GROUP BY trace_id),
pk AS (SELECT DISTINCT trace_id, connection_id, cpu FROM quic_packets WHERE flag = 'A'),
ids AS (SELECT trace_id, connection_id, cid FROM quic_created WHERE cid <> ''),
al AS (SELECT trace_id, connection_id FROM pk UNION SELECT trace_id, connection_id FROM ids),
b AS (SELECT al.trace_id, al.connection_id, CASE WHEN cid IS NULL THEN -1 ELSE {FNV} % m END AS bucket FROM al LEFT JOIN ids USING (trace_id, connection_id) LEFT JOIN cpus ON cpus.trace_id = al.trace_id)
SELECT b.trace_id, bucket, count(DISTINCT b.connection_id) AS connections, CAST(count(DISTINCT cpu) AS INT) AS actual_cpus, coalesce(string_agg(DISTINCT CAST(cpu AS VARCHAR), ',' ORDER BY CAST(cpu AS VARCHAR)), '') AS cpu_list
FROM b LEFT JOIN pk ON pk.trace_id = b.trace_id AND pk.connection_id = b.connection_id GROUP BY b.trace_id, bucket""")
def _(t):
    return app.cid_distribution(t["quic_created"], t["quic_packets"].where("flag = 'A'"))
