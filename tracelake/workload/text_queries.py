"""Queries of the text ingest. Lines are written from derived tables by Spark and parsed back, so
the check can state the typed rows they must give."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from ..sources import text_events, text_reports
from .registry import query


def _line(df: DataFrame, *cells: Column) -> DataFrame:
    text = F.concat_ws(", ", *[c.cast("string") for c in cells])
    return df.select("trace_id", F.col("seq").alias("line_no"), F.concat(F.lit("   "), text).alias("value"))


def _with_noise(lines: DataFrame, name: str) -> DataFrame:
    """Add header, malformed and foreign lines, which must not get through."""
    noise = lines.select("trace_id", F.lit(-1).cast("bigint").alias("line_no"), F.explode(F.array(
        F.lit(f"{name}, TimeStamp, Process Name ( PID), ThreadID, CPU"), F.lit(f"{name}, not a number, x"),
        F.lit("SampledProfileNmi, 5, a ( 1), 1, 0, 0, x, y!z, 1"), F.lit("NoSuchEvent, 5, 6"), F.lit(""),
    )).alias("value")).distinct()
    return lines.unionByName(noise)


def _parsed(lines: DataFrame, name: str, spelled: str, **options) -> DataFrame:
    return text_events.parse_events(_with_noise(lines, spelled), [name], **options)[name]


def _who(name: str = "process_name", pid: str = "pid") -> Column:
    return F.concat(F.lit('"'), F.col(name), F.lit('" ( '), F.col(pid), F.lit(")"))


@query("text_sampled_profile", """
SELECT trace_id, seq, ts_us, cpu, process_name, pid, module, CASE WHEN seq % 3 = 0 THEN 'Unknown' ELSE function END AS function, CASE WHEN seq % 5 = 0 THEN 1 ELSE weight END AS weight
FROM labelled WHERE cpu BETWEEN 2 AND 6""")
def _(t):
    s = t["labelled"]
    place = F.when(F.col("seq") % 3 == 0, F.col("module")).otherwise(F.concat("module", F.lit("!"), "function"))
    weight = F.when(F.col("seq") % 5 == 0, F.lit("bad")).otherwise(F.col("weight").cast("string"))
    lines = _line(s, F.lit("SampledProfile"), F.col("ts_us"), _who(), F.lit("77"), F.lit("0x1"), F.col("cpu"), F.lit("a!b"), place, weight, F.lit("Normal"))
    return _parsed(lines, "sampled_profile", "SampledProfile", cpu_filter="2-6")


@query("text_cswitch", """
SELECT trace_id, seq, ts_us, cpu, new_process, new_pid, new_tid, CAST(9 AS INT) AS new_priority, old_process, old_pid, old_tid, CAST(8 AS INT) AS old_priority, old_state, wait_reason, '' AS wait_mode FROM cswitch""")
def _(t):
    c = t["cswitch"]
    # every other line has no number at the usual place of the CPU
    at16 = F.when(F.col("seq") % 2 == 0, F.col("cpu").cast("string")).otherwise(F.lit("n/a"))
    at17 = F.when(F.col("seq") % 2 == 0, F.lit("3")).otherwise(F.col("cpu").cast("string"))
    lines = _line(
        c, F.lit("CSwitch"), F.col("ts_us"), _who("new_process", "new_pid"), F.col("new_tid"), F.lit("9"), F.lit("1"), F.lit("2"), F.lit("3"),
        _who("old_process", "old_pid"), F.col("old_tid"), F.lit("8"), F.lit("0"), F.col("old_state"), F.col("wait_reason"), F.lit("Swapable"), F.lit("99999"), at16, at17,
    )
    return _parsed(lines, "cswitch", "CSwitch")


def _packet_line(w: DataFrame, name: str, inbound: bool, *more: Column) -> DataFrame:
    near, far = ("local", "remote") if inbound else ("remote", "local")
    return _line(
        w, F.lit(name), F.col("ts_us"), _who(), F.col("tid"), F.col("cpu"), F.col("size"), F.col(f"{near}_addr"), F.col(f"{far}_addr"),
        F.col(f"{near}_port"), F.col(f"{far}_port"), *more,
    )


WIRE = "trace_id, seq, ts_us, cpu, process_name, pid, tid, local_addr, local_port, remote_addr, remote_port, size"


@query("text_tcp_recv", f"SELECT {WIRE}, seq_no, conn_id FROM wire WHERE flag = 'A'")
def _(t):
    w = t["wire"].where("flag = 'A'")
    return _parsed(_packet_line(w, "TcpIp/Recv", True, F.col("seq_no"), F.col("conn_id")), "tcpip_recv", "TcpIp/Recv")


@query("text_tcp_send", f"SELECT {WIRE}, seq_no, 0 AS conn_id FROM wire WHERE flag = 'N'")
def _(t):
    w = t["wire"].where("flag = 'N'")
    return _parsed(_packet_line(w, "TcpIp_Send", False, F.col("seq_no")), "tcpip_send", "TcpIp_Send")


@query("text_tcp_retransmit", f"SELECT {WIRE}, seq_no, conn_id, CASE WHEN n > 3 THEN n ELSE 1 END AS retransmit_count FROM wire WHERE flag = 'R'")
def _(t):
    w = t["wire"].where("flag = 'R'")
    count = F.when(F.col("n") > 3, F.col("n")).otherwise(F.lit(0))
    return _parsed(_packet_line(w, "TcpIpRetransmit", False, F.col("seq_no"), F.col("conn_id"), count), "tcpip_retransmit", "TcpIpRetransmit")


@query("text_tcp_handshake", """
SELECT trace_id, seq, ts_us, cpu, process_name, pid, tid, local_addr, local_port, remote_addr, remote_port, 0 AS size, 1460 AS mss, 65535 AS rcv_win, seq AS seq_no, conn_id, priority LIKE '1%' AS accepted FROM connects""")
def _(t):
    c = t["connects"].withColumn("size", F.lit(0))
    options = [F.lit(x) for x in ("1460", "1", "1", "1", "65535", "0", "0")]
    out = None
    for name, inbound, rows in (("TcpIp/Connect", False, c.where("priority NOT LIKE '1%'")), ("TcpIp/Accept", True, c.where("priority LIKE '1%'"))):
        lines = _packet_line(rows, name, inbound, *options, F.col("seq"), F.col("conn_id"))
        typed = _parsed(lines, "tcpip_accept" if inbound else "tcpip_connect", name).withColumn("accepted", F.lit(inbound))
        out = typed if out is None else out.unionByName(typed)
    return out


@query("text_udp", f"SELECT {WIRE}, flag = 'A' AS inbound FROM wire WHERE flag <> 'R'")
def _(t):
    recv = _parsed(_packet_line(t["wire"].where("flag = 'A'"), "UdpIp/Recv", True), "udp_recv", "UdpIp/Recv").withColumn("inbound", F.lit(True))
    send = _parsed(_packet_line(t["wire"].where("flag = 'N'"), "UdpIp/Send", False), "udp_send", "UdpIp/Send").withColumn("inbound", F.lit(False))
    return recv.unionByName(send)


HEAD = "trace_id, seq, ts_us, cpu, process_name, pid, tid"


def _head_line(df: DataFrame, name: str, *more: Column) -> DataFrame:
    return _line(df, F.lit(name), F.col("ts_us"), _who(), F.col("tid"), F.col("cpu"), *more)


@query("text_socket_io", f"SELECT {HEAD}, conn_id AS socket_handle, size, n AS completion_status FROM wire WHERE flag = 'A'")
def _(t):
    handle = F.when(F.col("n") % 3 == 0, F.concat(F.lit("0x"), F.hex("conn_id"))).otherwise(F.col("conn_id").cast("string"))
    return _parsed(_head_line(t["wire"].where("flag = 'A'"), "AFD/Recv", handle, F.col("size"), F.col("n")), "afd_recv", "AFD/Recv")


@query("text_socket_ends", f"SELECT {HEAD}, socket_handle, local_addr, local_port, remote_addr, remote_port FROM connects")
def _(t):
    lines = _head_line(t["connects"], "Afd/Connect", *[F.col(c) for c in ("socket_handle", "local_addr", "local_port", "remote_addr", "remote_port")])
    return _parsed(lines, "afd_connect", "Afd/Connect")


@query("text_socket_close", f"SELECT {HEAD}, socket_handle FROM connects")
def _(t):
    return _parsed(_head_line(t["connects"], "AFDClose", F.col("socket_handle")), "afd_close", "AFDClose")


@query("text_drops", f"SELECT {HEAD}, 'nic' || n AS miniport, 'why' AS reason, size FROM wire WHERE flag = 'R'")
def _(t):
    return _parsed(_head_line(t["wire"].where("flag = 'R'"), "NdisDrop", F.concat(F.lit("nic"), "n"), F.lit("why"), F.col("size")), "ndis_drops", "NdisDrop")


@query("text_capture", f"""
SELECT {HEAD}, CASE WHEN n % 2 = 0 THEN 'Recv' ELSE 'Send' END AS direction, CASE WHEN n > 2 THEN 'nic one' ELSE '' END AS miniport, lower(lpad(to_hex(seq), 28, '0')) AS packet_hex,
  CASE WHEN n > 4 THEN size ELSE 14 END AS size FROM wire WHERE n <> 1""")
def _(t):
    w = t["wire"]
    packet = F.lpad(F.lower(F.hex("seq")), 28, "0")
    dressed = F.when(F.col("n") % 3 == 0, F.concat(F.lit('"0x'), packet, F.lit('"'))).otherwise(packet)
    cells = F.array_compact(F.array(
        F.when(F.col("n") > 2, F.lit('"nic one"')), F.when(F.col("n") > 4, F.col("size").cast("string")),
        F.when(F.col("n") == 1, F.lit("abc")).otherwise(dressed),
    ))
    name = F.when(F.col("n") % 2 == 0, F.lit("NdisPacketCapture/Recv")).otherwise(F.lit("PacketCapture/Send"))
    lines = _line(w, name, F.col("ts_us"), _who(), F.col("tid"), F.col("cpu"), F.array_join(cells, ", "))
    return _parsed(lines, "packet_capture", "NdisPacketCapture")


@query("text_http", """
SELECT trace_id, seq, ts_us, request_id, seq AS connection_id, verb, url || ',q=' || seq AS url FROM http_recv""")
def _(t):
    r = t["http_recv"]
    lines = _line(r, F.lit("HttpService/Recv"), F.col("ts_us"), F.lit("svc ( 4)"), F.lit("1"), F.lit("0"), F.concat(F.lit("0x"), F.hex("request_id")), F.col("seq"),
                  F.concat(F.lit('"'), "verb", F.lit('"')), F.concat(F.lit('"'), "url", F.lit(",q="), "seq", F.lit('"')))
    return _parsed(lines, "http_recv", "HttpService/Recv").drop("cpu", "process_name", "pid", "tid")


@query("text_http_steps", """
SELECT trace_id, seq, ts_us, request_id, url_group_id, NULL AS status_code, NULL AS content_length, 'deliver' AS step FROM http_deliver
UNION ALL SELECT trace_id, seq, ts_us, request_id, NULL, status_code, content_length, 'send' FROM http_send
UNION ALL SELECT trace_id, seq, ts_us, request_id, NULL, NULL, NULL, 'close' FROM http_close""")
def _(t):
    out = None
    for step, name, table, cells in (
        ("deliver", "HTTPRequestTraceTask/Deliver", "http_deliver", ["request_id", "url_group_id"]),
        ("send", "HttpService/FastResponse", "http_send", ["request_id", "status_code", "content_length"]),
        ("close", "HttpService_Close", "http_close", ["request_id"]),
    ):
        lines = _line(t[table], F.lit(name), F.col("ts_us"), F.lit("svc ( 4)"), F.lit("1"), F.lit("0"), *[F.col(c) for c in cells])
        typed = _parsed(lines, f"http_{step}", name).drop("cpu", "process_name", "pid", "tid").withColumn("step", F.lit(step))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


@query("text_quic", """
SELECT trace_id, seq, ts_us, connection_id, cid, local_addr, remote_addr, NULL AS packet_number, NULL AS size, NULL AS ack_delay, NULL AS largest_acknowledged, 'created' AS step FROM quic_created
UNION ALL SELECT trace_id, seq, ts_us, connection_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'closed' FROM quic_closed
UNION ALL SELECT trace_id, seq, ts_us, connection_id, NULL, NULL, NULL, packet_number, size, NULL, NULL, 'recv' FROM quic_packets WHERE flag = 'A'
UNION ALL SELECT trace_id, seq, ts_us, connection_id, NULL, NULL, NULL, packet_number, size, NULL, NULL, 'send' FROM quic_packets WHERE flag = 'N'
UNION ALL SELECT trace_id, seq, ts_us, connection_id, NULL, NULL, NULL, NULL, NULL, ack_delay, packet_number, 'ack' FROM quic_packets WHERE flag = 'R'""")
def _(t):
    p = t["quic_packets"]
    out = None
    for step, key, name, table, cells in (
        ("created", "quic_conn_created", "Quic/ConnectionCreated", t["quic_created"], ["connection_id", "cid", "local_addr", "remote_addr"]),
        ("closed", "quic_conn_closed", "MsQuic/ConnectionClosed", t["quic_closed"], ["connection_id"]),
        ("recv", "quic_packet_recv", "Quic_PacketRecv", p.where("flag = 'A'"), ["connection_id", "packet_number", "size"]),
        ("send", "quic_packet_send", "QuicPacketSend", p.where("flag = 'N'"), ["connection_id", "packet_number", "size"]),
        ("ack", "quic_ack_recv", "Quic/AckProcessed", p.where("flag = 'R'"), ["connection_id", "ack_delay", "packet_number"]),
    ):
        lines = _line(table, F.lit(name), F.col("ts_us"), F.lit("svc ( 4)"), F.lit("1"), F.lit("0"), *[F.col(c) for c in cells])
        typed = _parsed(lines, key, name).drop("cpu", "process_name", "pid", "tid").withColumn("step", F.lit(step))
        out = typed if out is None else out.unionByName(typed, allowMissingColumns=True)
    return out


# ---- ordered reports ----------------------------------------------------------------------


def _ordered(df: DataFrame, order: Column, *parts: Column) -> DataFrame:
    """Lines of a report: ``order`` numbers the rows, each of which may have several lines."""
    rows = df.select("trace_id", order.cast("bigint").alias("_o"), F.posexplode(F.array(*parts)).alias("_i", "value"))
    rows = rows.where(F.col("value").isNotNull()).select("trace_id", (F.col("_o") * 16 + F.col("_i")).alias("line_no"), "value")
    return rows.withColumn("block", F.expr("line_no div 4096"))


@query("profile_detail_text", """
SELECT trace_id, process_name, pid, weight, CAST(1.5 AS DOUBLE) AS weight_pct, module, CASE WHEN seq % 4 = 0 THEN '' ELSE function || '<a,b>' END AS function FROM labelled""")
def _(t):
    s = t["labelled"]
    place = F.when(F.col("seq") % 4 == 0, F.col("module")).otherwise(F.concat("module", F.lit("!"), "function", F.lit("<a,b>")))
    line = F.concat(F.lit("  "), F.col("process_name"), F.lit(" ( "), F.col("pid"), F.lit("),  "), F.col("weight"), F.lit(",  1.5,   "), place)
    return text_reports.profile_detail(s.select("trace_id", line.alias("value")))


def _histogram_lines(t) -> DataFrame:
    # one order's lines under its header; every fifth order's block was closed before
    one = t["wire"].groupBy("trace_id", "l_orderkey", "n").agg(F.min_by("size", F.struct("l_partkey", "size")).alias("size"))
    head = F.when(F.col("l_orderkey") % 5 == 0, F.lit("Total, 5")).when(F.col("l_orderkey") % 7 == 0, F.lit("Total = 12")).otherwise(
        F.concat(F.lit("Total = 12 for module m"), "l_orderkey"))
    heads = one.select("trace_id", (F.col("l_orderkey") * 16).alias("line_no"), head.alias("value")).distinct()
    lines = one.select("trace_id", (F.col("l_orderkey") * 16 + F.col("n")).alias("line_no"), F.concat(
        F.lit(" Elapsed Time, >  "), "n", F.lit(" usecs AND <=  "), F.col("n") + 1, F.lit(" usecs, "), "size", F.lit(", or 0.25%")).alias("value"))
    return heads.unionByName(lines).withColumn("block", F.expr("line_no div 4096"))


def _ready_stack_lines(t) -> DataFrame:
    r = t["ready"]
    head = F.concat(F.lit("ReadyThread, "), "ts_us", F.lit(', "p'), "pid", F.lit('" ( '), "pid", F.lit("), "), "tid", F.lit(', "r'), "cpu", F.lit('" ( '), "cpu", F.lit("), 5, 0, 0, 1"))
    one = F.when(F.col("seq") % 3 > 0, F.lit("    Stack, 1, 2, 1, 0x0, a!f,x"))
    two = F.when(F.col("seq") % 3 > 1, F.concat(F.lit("    Stack, 1, 2, 2, 0x0, b!g"), "cpu"))
    return _ordered(r, F.col("seq"), head, F.when(F.col("seq") % 3 == 1, F.lit("")), one, two)


def _utilisation_lines(t) -> DataFrame:
    b = t["base"]
    rows = _ordered(b, F.col("seq") + 1, F.concat_ws(", ", F.col("seq") * 10, F.col("seq") * 10 + 10, F.col("k"), F.col("pid")))
    heads = b.select("trace_id").distinct().select("trace_id", F.lit(1).cast("bigint").alias("line_no"), F.lit("StartTime, EndTime, Cpu 0, Cpu  1").alias("value"))
    return rows.unionByName(heads.withColumn("block", F.lit(0).cast("bigint")))


def _pool_lines(t) -> DataFrame:
    kind = F.expr("seq div 9 % 3")
    head = F.when(kind == 0, F.lit("Paged Pool:")).when(kind == 1, F.lit("Non-Paged Pool:")).otherwise(F.lit("NX Non-Paged Pool:"))
    # the section line heads every run of nine rows, of which a trace has three
    first = F.when(F.col("seq") % 9 < 3, head)
    row = F.concat(F.lit(" m"), "seq", F.lit(", T"), "k", F.lit(", "), "k", F.lit(", "), "pid", F.lit(", "), "pid", F.lit(", 0.5"))
    return _ordered(t["base"], F.col("seq"), first, F.lit("Image, Tag, ..."), row, F.lit("---"))


def _monitor_lines(t) -> DataFrame:
    b = t["base"]
    drop = F.when(F.col("k") % 5 == 0, F.lit("Drop: ")).otherwise(F.lit(""))
    head = F.concat(
        F.lit("10:00:00.5 "), drop, F.lit("PktGroupId "), "k", F.lit(", PktNumber "), "seq", F.lit(", Appearance 1, Direction "),
        F.when(F.col("k") % 2 == 0, F.lit("Tx , Type Ethernet , Component 12, Edge 1")).otherwise(F.lit("Rx , Type Ethernet , Component 9, Edge 1")),
        F.lit(", Filter 1, OriginalSize "), "pid", F.lit(", LoggedSize "), "pid",
    )
    below = F.concat(F.when(F.col("k") % 7 == 0, F.lit("")).otherwise(F.lit("\t")), F.lit("IPv4, length "), "k", F.lit(": 1.2.3.4.80 > 5.6.7.8.9: tcp"))
    return _ordered(b, F.col("seq"), head, below)


def _monitor_boundary_lines(t) -> DataFrame:
    head = F.concat(F.lit("10:00:00.5 PktGroupId 1, PktNumber 2, Appearance 1, Direction Tx , Type Ethernet , Component 12, Edge 1, OriginalSize "), "k", F.lit(", LoggedSize 9"))
    below = F.concat(F.lit("\tIPv4, length 9: 1.2.3.4.80 > 5.6.7.8."), "pid", F.lit(": UDP, more"))
    return _ordered(t["base"], F.col("seq"), head, below)


# name: the lines, the parser and the rows expected; ``seq`` is the number of a line, which a file does not keep
REPORTS = {
    "histogram_text": (_histogram_lines, text_reports.duration_histogram_text, """
SELECT trace_id, CASE WHEN l_orderkey % 7 = 0 THEN '(all)' ELSE 'm' || l_orderkey END AS module, n AS low_us, n + 1 AS high_us, size AS events, CAST(0.25 AS DOUBLE) AS pct
FROM (SELECT trace_id, l_orderkey, n, size, row_number() OVER (PARTITION BY l_orderkey, n ORDER BY l_partkey, size) AS rk FROM wire) WHERE rk = 1 AND l_orderkey % 5 <> 0"""),
    "ready_stack_text": (_ready_stack_lines, text_reports.ready_thread_stacks, """
SELECT trace_id, seq * 16 AS seq, ts_us, 'p' || pid AS process_name, pid, tid, 'r' || cpu AS readying_process, cpu AS readying_pid, 5 AS readying_tid, '0' AS adjust_reason, '1' AS in_dpc,
  CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 3 = 1 THEN 'a!f,x' ELSE 'a!f,x / b!g' || cpu END AS stack_text FROM ready"""),
    "utilisation_text": (_utilisation_lines, text_reports.utilisation_text, """
SELECT trace_id, seq * 10 AS start_us, seq * 10 + 10 AS end_us, unnest([0, 1]) AS cpu, unnest([CAST(k AS DOUBLE), CAST(pid AS DOUBLE)]) AS util_pct FROM base"""),
    "pool_text": (_pool_lines, text_reports.pool_text, """
SELECT trace_id, CASE p_type_ WHEN 0 THEN 'Paged' WHEN 1 THEN 'NonPaged' ELSE 'NX NonPaged' END AS pool_type, 'm' || seq AS module, 'T' || k AS tag, k AS allocs, CAST(pid AS DOUBLE) AS alloc_kb, pid AS outstanding, CAST(0.5 AS DOUBLE) AS outstanding_kb
FROM (SELECT *, seq // 9 % 3 AS p_type_ FROM base)"""),
    "monitor_text": (_monitor_lines, text_reports.packet_monitor_text, """
SELECT trace_id, seq * 16 AS seq, '10:00:00.5' AS clock, CASE WHEN k % 2 = 0 THEN 'Send' ELSE 'Recv' END AS direction, CAST(CASE WHEN k % 2 = 0 THEN 12 ELSE 9 END AS INT) AS component, CAST(1 AS INT) AS edge,
  k AS packet_group, seq AS packet_number, 1 AS appearance, pid AS size, pid AS captured_size, 'IPv4, length ' || k || ': 1.2.3.4.80 > 5.6.7.8.9: tcp' AS detail, k % 2 = 0 AS boundary, CAST(CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS INT) AS path_index
FROM base WHERE k % 5 <> 0 AND k % 7 <> 0"""),
    "monitor_boundary_text": (_monitor_boundary_lines, partial(text_reports.packet_monitor_text, boundary_only=True), """
SELECT trace_id, seq * 16 AS seq, 'Send' AS direction, '1.2.3.4:80 -> 5.6.7.8:' || pid || '/udp' AS flow, k AS size FROM base"""),
}


def _register(name: str, lines, parse, check: str) -> None:
    @query(name, check)
    def of_table(t):
        return parse(lines(t))

    @query(f"{name}_files", f"SELECT * EXCLUDE (seq) FROM ({check})" if " AS seq" in check else check)
    def of_files(t):
        folder = scratch(t.spark, "reports")
        text_reports.write_ordered_lines(lines(t), folder)
        return parse(text_reports.read_ordered_lines(t.spark, folder)).drop("seq")


for _name, (_lines, _parse, _rows) in REPORTS.items():
    _register(_name, _lines, _parse, _rows)
