"""Comma-separated event text: lines to typed event rows.

A ``lines`` table has ``trace_id`` and ``value`` and may have ``line_no``. The class of a line is
its first field. Header lines (no number in field 1) and malformed lines are dropped. Lines need
no order.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import parse_id
from ..functions.labels import process_field_name, process_field_pid
from ..functions.packet import clean_hex
from .normalise import class_of

DEFAULT_CLASSES = ("sampled_profile", "cswitch")


def read_lines(spark: SparkSession, path: str, trace_id: str | Column | None = None) -> DataFrame:
    """Text files as lines; the trace id is the file path unless one is given."""
    df = spark.read.text(path)
    trace = F.col("_metadata.file_path") if trace_id is None else (
        F.lit(trace_id) if isinstance(trace_id, str) else trace_id
    )
    return df.select(trace.alias("trace_id"), "value")


def _part(i: int) -> Column:
    return F.trim(F.get(F.col("_f"), F.lit(i)))


def _text(i: int) -> Column:
    return F.coalesce(_part(i), F.lit(""))


def _bare(i: int) -> Column:
    return F.coalesce(F.regexp_replace(_part(i), '^"+|"+$', ""), F.lit(""))


def _int(i: int, default: int | None = 0) -> Column:
    number = _part(i).try_cast("bigint")
    return number if default is None else F.coalesce(number, F.lit(default).cast("bigint"))


def _id(i: int) -> Column:
    return F.coalesce(parse_id(_part(i)), F.lit(0).cast("bigint"))


def split_events(lines: DataFrame) -> DataFrame:
    """Add ``event_class`` and the field array; keep lines with a numeric time."""
    fields = F.split(F.ltrim("value"), ",")
    seq = F.col("line_no").cast("bigint") if "line_no" in lines.columns else F.monotonically_increasing_id()
    return (
        lines.select("trace_id", seq.alias("seq"), fields.alias("_f"))
        .withColumn("event_class", class_of(F.get("_f", F.lit(0))))
        .where(F.col("event_class").isNotNull() & F.coalesce(_part(1).rlike("^-*[0-9]+$"), F.lit(False)))
    )


def _header() -> list[Column]:
    return [
        "trace_id", "seq", _int(1, None).alias("ts_us"), _int(4, -1).cast("int").alias("cpu"),
        process_field_name(_part(2)).alias("process_name"), process_field_pid(_part(2)).alias("pid"),
        _int(3, -1).alias("tid"),
    ]


def _ends(inbound: bool | Column) -> list[Column]:
    """Local and remote endpoint of destination (6, 8) and source (7, 9) fields."""
    inbound = F.lit(inbound) if isinstance(inbound, bool) else inbound
    return [
        F.when(inbound, _text(6)).otherwise(_text(7)).alias("local_addr"),
        F.when(inbound, _int(8)).otherwise(_int(9)).alias("local_port"),
        F.when(inbound, _text(7)).otherwise(_text(6)).alias("remote_addr"),
        F.when(inbound, _int(9)).otherwise(_int(8)).alias("remote_port"),
    ]


def _sampled_profile(e: DataFrame) -> DataFrame:
    place = _part(7)
    named = place.contains("!")
    return e.where((F.size("_f") >= 8) & _int(5, None).isNotNull()).select(
        "trace_id", "seq", _int(1, None).alias("ts_us"), _int(5, None).cast("int").alias("cpu"),
        process_field_name(_part(2)).alias("process_name"), process_field_pid(_part(2)).alias("pid"),
        F.when(named, F.trim(F.split_part(place, F.lit("!"), F.lit(1)))).otherwise(place).alias("module"),
        F.when(named, F.trim(F.regexp_extract(place, "^[^!]*!(.*)$", 1))).otherwise(F.lit("Unknown")).alias("function"),
        _int(8, 1).alias("weight"),
    )


def _cswitch(e: DataFrame) -> DataFrame:
    def plausible(x: Column) -> Column:
        return F.coalesce(x.between(0, 4095), F.lit(False))

    nearby = F.filter(
        F.transform(F.slice(F.col("_f"), 16, 5), lambda x: F.trim(x).try_cast("bigint")), plausible
    )
    cpu = F.when(plausible(_int(16, None)), _int(16, None)).otherwise(F.coalesce(F.get(nearby, F.lit(0)), F.lit(-1)))
    rows = e.where((F.size("_f") >= 14) & _int(3, None).isNotNull() & _int(9, None).isNotNull())
    return rows.select(
        "trace_id", "seq", _int(1, None).alias("ts_us"), cpu.cast("int").alias("cpu"),
        process_field_name(_part(2)).alias("new_process"), process_field_pid(_part(2)).alias("new_pid"),
        _int(3, None).alias("new_tid"), _int(4, -1).cast("int").alias("new_priority"),
        process_field_name(_part(8)).alias("old_process"), process_field_pid(_part(8)).alias("old_pid"),
        _int(9, None).alias("old_tid"), _int(10, -1).cast("int").alias("old_priority"),
        _part(12).alias("old_state"), _part(13).alias("wait_reason"), F.lit("").alias("wait_mode"),
    )


def _tcp(inbound: bool, *more: Column):
    return lambda e: e.select(
        *_header(), *_ends(inbound), _int(5).alias("size"), _int(10).alias("seq_no"), _int(11).alias("conn_id"), *more
    )


def _retransmit(e: DataFrame) -> DataFrame:
    count = F.when(_int(12, None) > 0, _int(12, None)).otherwise(F.lit(1).cast("bigint"))
    return _tcp(False, count.alias("retransmit_count"))(e)


def _handshake(inbound: bool):
    return lambda e: e.select(
        *_header(), *_ends(inbound), _int(5).alias("size"), _int(10).alias("mss"), _int(14).alias("rcv_win"),
        _int(17).alias("seq_no"), _int(18).alias("conn_id"),
    )


def _udp(inbound: bool):
    return lambda e: e.select(*_header(), *_ends(inbound), _int(5).alias("size"))


def _socket_io(e: DataFrame) -> DataFrame:
    return e.select(*_header(), _id(5).alias("socket_handle"), _int(6).alias("size"), _int(7).alias("completion_status"))


def _socket_end(e: DataFrame) -> DataFrame:
    return e.select(
        *_header(), _id(5).alias("socket_handle"), _text(6).alias("local_addr"), _int(7).alias("local_port"),
        _text(8).alias("remote_addr"), _int(9).alias("remote_port"),
    )


def _drop(e: DataFrame) -> DataFrame:
    return e.select(*_header(), _text(5).alias("miniport"), _text(6).alias("reason"), _int(7).alias("size"))


def _capture(e: DataFrame) -> DataFrame:
    event = F.lower(_part(0))
    way = (
        F.when(event.rlike("recv|receive|[/_]rx"), F.lit("Recv"))
        .when(event.rlike("send|transmit|[/_]tx"), F.lit("Send")).otherwise(F.lit("Unknown"))
    )
    numbered = F.transform(
        F.slice(F.col("_f"), 6, F.size("_f")),
        lambda x, i: F.struct(i.alias("i"), F.trim(x).alias("raw"), clean_hex(x).alias("hex")),
    )
    frames = F.filter(F.col("_t"), lambda x: F.length(x["hex"]) >= 24)
    found = (
        e.where(F.size("_f") > 5).withColumn("_t", numbered)
        .withColumn("_frame", F.try_element_at(frames, F.lit(-1)))
        .where(F.col("_frame").isNotNull())
    )
    plain = F.transform(
        F.filter(F.col("_t"), lambda x: x["i"] < F.col("_frame.i")),
        lambda x: F.regexp_replace(x["raw"], '^"+|"+$', ""),
    )
    found = found.withColumn("_before", F.filter(plain, lambda x: x != ""))
    names = F.filter("_before", lambda x: x.try_cast("bigint").isNull())
    numbers = F.filter("_before", lambda x: x.try_cast("bigint").isNotNull())
    size = F.try_element_at(numbers, F.lit(-1)).try_cast("bigint")
    return found.select(
        *_header(), way.alias("direction"), F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("miniport"),
        F.col("_frame.hex").alias("packet_hex"),
        F.coalesce(size, (F.length("_frame.hex") / 2).cast("bigint")).alias("size"),
    )


def _http_recv(e: DataFrame) -> DataFrame:
    tail = F.array_join(F.slice(F.col("_f"), 9, F.size("_f")), ",")
    url = F.when(F.size("_f") > 8, F.regexp_replace(F.trim(tail), '^"+|"+$', "")).otherwise(F.lit(""))
    return e.select(
        *_header(), _id(5).alias("request_id"), _id(6).alias("connection_id"), _bare(7).alias("verb"), url.alias("url")
    )


def _ids(*names: str):
    return lambda e: e.select(*_header(), *[_id(5 + i).alias(n) for i, n in enumerate(names)])


def _http_send(e: DataFrame) -> DataFrame:
    return e.select(*_header(), _id(5).alias("request_id"), _int(6).alias("status_code"), _int(7).alias("content_length"))


def _quic_created(e: DataFrame) -> DataFrame:
    return e.select(
        *_header(), _id(5).alias("connection_id"), _bare(6).alias("cid"), _bare(7).alias("local_addr"),
        _bare(8).alias("remote_addr"),
    )


def _quic_packet(e: DataFrame) -> DataFrame:
    return e.select(*_header(), _id(5).alias("connection_id"), _int(6).alias("packet_number"), _int(7).alias("size"))


def _quic_ack(e: DataFrame) -> DataFrame:
    return e.select(
        *_header(), _id(5).alias("connection_id"), _int(6).alias("ack_delay"), _int(7).alias("largest_acknowledged")
    )


PARSERS = {
    "sampled_profile": _sampled_profile,
    "cswitch": _cswitch,
    "tcpip_recv": _tcp(True),
    "tcpip_send": _tcp(False),
    "tcpip_retransmit": _retransmit,
    "tcpip_connect": _handshake(False),
    "tcpip_accept": _handshake(True),
    "udp_recv": _udp(True),
    "udp_send": _udp(False),
    "afd_recv": _socket_io,
    "afd_send": _socket_io,
    "afd_connect": _socket_end,
    "afd_accept": _socket_end,
    "afd_close": _ids("socket_handle"),
    "ndis_drops": _drop,
    "packet_capture": _capture,
    "http_recv": _http_recv,
    "http_deliver": _ids("request_id", "url_group_id"),
    "http_send": _http_send,
    "http_close": _ids("request_id"),
    "quic_conn_created": _quic_created,
    "quic_conn_closed": _ids("connection_id"),
    "quic_packet_recv": _quic_packet,
    "quic_packet_send": _quic_packet,
    "quic_ack_recv": _quic_ack,
}


def parse_events(
    lines: DataFrame, classes: Iterable[str] = DEFAULT_CLASSES, *, cpu_filter: str | None = None,
    start_time: float | None = None, end_time: float | None = None,
) -> dict[str, DataFrame]:
    """Typed rows per requested class; the CPU filter applies to samples."""
    from ..operators.filters import apply_filters
    from ..schemas import canonical_event_class

    events = split_events(lines)
    out = {}
    for name in classes:
        key = canonical_event_class(name)
        rows = PARSERS[key](events.where(F.col("event_class") == key))
        out[key] = apply_filters(
            rows, cpu_filter=cpu_filter if key == "sampled_profile" else None,
            start_time=start_time, end_time=end_time,
        )
    return out
