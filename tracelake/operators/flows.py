"""Network flows and sockets: traffic, retransmits, drops, latency, batching, lifecycles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classes import affinity_status
from ..functions.labels import is_blank_name
from ..functions.times import MICROS
from ..plans.quantiles import exact_quantiles, with_share
from ..plans.sequence import DEFAULT_SLICE_US, with_neighbours
from .attribution import ENDS, connection_dimension, enrich_by_connection
from .filters import contains_text

MIB = 1024.0 * 1024.0


def connections(connect: DataFrame, accept: DataFrame, retransmit: DataFrame) -> DataFrame:
    """Endpoints, process and name per TCP connection id."""
    return connection_dimension([connect, accept, retransmit], "conn_id", need_endpoint=True)


def sockets(accept: DataFrame, connect: DataFrame, recv: DataFrame, send: DataFrame) -> DataFrame:
    """Endpoints, process and name per socket handle."""
    return connection_dimension([accept, connect, recv, send], "socket_handle", need_endpoint=False)


def _tagged(tables: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """One table of all classes with ``kind``; columns a class lacks are null."""
    parts = [
        table.select(*[c for c in columns if c in table.columns], F.lit(kind).alias("kind"))
        for kind, table in tables.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _seconds(first: str, last: str) -> Column:
    return (F.col(last) - F.col(first)) / float(MICROS)


def _rate(amount: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, amount / seconds).otherwise(F.lit(0.0))


def _first_name() -> Column:
    """Name on the earliest row that has one."""
    named = F.when(~is_blank_name(F.col("process_name")), F.struct("first_us", "process_name"))
    return F.coalesce(F.min_by("process_name", named), F.min_by("process_name", F.struct("first_us", "process_name")))


def traffic(
    tables: dict[str, DataFrame], *, dimension: DataFrame | None = None, process: DataFrame | None = None
) -> DataFrame:
    """Packets, bytes and time span per flow, process and kind.

    Packets are summed by what they carry themselves before blanks are filled from the
    connection records, so a busy connection is reduced on the map side.
    """
    columns = ["trace_id", "ts_us", "seq", "process_name", "pid", *ENDS, "size", "conn_id", "retransmit_count"]
    rows = _tagged(tables, columns)
    key = ["conn_id"] if dimension is not None else []
    present = [c for c in ("process_name", "pid", *ENDS) if c in rows.columns]
    count = F.coalesce("retransmit_count", F.lit(1)) if "retransmit_count" in rows.columns else F.lit(1)
    sums = rows.groupBy("trace_id", "kind", *key, *present).agg(
        F.count(F.lit(1)).alias("packets"), F.sum(F.coalesce("size", F.lit(0))).alias("bytes"),
        F.sum(count).alias("retransmits"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"),
    )
    if dimension is not None or process is not None:
        sums = enrich_by_connection(sums, dimension, "conn_id" if dimension is not None else None, process)
    return sums


def _only(rows: DataFrame, process_filter: str | None) -> DataFrame:
    return rows.where(contains_text(F.col("process_name"), process_filter)) if process_filter else rows


def _of(kind: str, value: str) -> Column:
    return F.sum(F.when(F.col("kind") == kind, F.col(value)).otherwise(F.lit(0)))


def connection_summary(flows: DataFrame, *, process_filter: str | None = None) -> DataFrame:
    """Bytes, packets, retransmits and span per TCP connection.

    ``flows`` is :func:`traffic` over kinds ``recv``, ``send`` and ``rtx``.
    """
    return _only(flows, process_filter).groupBy("trace_id", *ENDS).agg(
        _first_name().alias("process_name"),
        _of("recv", "bytes").alias("recv_bytes"), _of("send", "bytes").alias("send_bytes"),
        F.sum(F.when(F.col("kind") != "rtx", F.col("packets")).otherwise(F.lit(0))).alias("packets"),
        _of("rtx", "retransmits").alias("retransmits"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    ).withColumns({
        "total_bytes": F.col("recv_bytes") + F.col("send_bytes"),
        "duration_s": F.coalesce(_seconds("first_us", "last_us"), F.lit(0.0)),
    }).drop("first_us", "last_us")


def datagram_summary(flows: DataFrame, *, process_filter: str | None = None) -> DataFrame:
    """Packets, bytes, span and packet rate per UDP flow; the rate of a zero span is 0."""
    sums = _only(flows, process_filter).groupBy("trace_id", *ENDS).agg(
        _first_name().alias("process_name"),
        _of("recv", "packets").alias("recv_packets"), _of("send", "packets").alias("send_packets"),
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"),
    )
    return sums.withColumn("duration_s", F.coalesce(_seconds("first_us", "last_us"), F.lit(0.0))).withColumn(
        "pps", _rate(F.col("packets"), F.col("duration_s"))
    ).drop("first_us", "last_us")


def retransmit_summary(flows: DataFrame, *, flag_rate: float = 0.001) -> DataFrame:
    """Retransmits against packets per connection that has any, flagged above 0.1 %."""
    counts = flows.groupBy("trace_id", *ENDS).agg(
        F.min_by("process_name", F.when(F.col("kind") == "rtx", F.struct("first_us", "process_name"))).alias("process_name"),
        _of("rtx", "retransmits").alias("retransmits"),
        F.sum(F.when(F.col("kind") != "rtx", F.col("packets")).otherwise(F.lit(0))).alias("_packets"),
        F.count(F.when(F.col("kind") == "rtx", True)).alias("_rtx_rows"),
    ).where(F.col("_rtx_rows") > 0)
    whole = F.col("_packets") + F.col("retransmits")
    rate = F.when(whole > 0, F.col("retransmits") / whole).otherwise(F.lit(0.0))
    return counts.select(
        "trace_id", *ENDS, "process_name", "retransmits", whole.alias("packets"),
        rate.alias("rate"), (rate > flag_rate).alias("high"),
    )


def process_throughput(flows: DataFrame) -> DataFrame:
    """Packet and MiB rates per process for each protocol and direction over its own span.

    ``flows`` is :func:`traffic` over kinds ``tcp_recv``, ``tcp_send``, ``udp_recv``, ``udp_send``.
    """
    kinds = ("tcp_recv", "tcp_send", "udp_recv", "udp_send")
    spans = flows.groupBy("trace_id", "process_name", "pid", "kind").agg(
        F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"),
        ((F.max("last_us") - F.min("first_us")) / float(MICROS)).alias("seconds"),
    )
    rates = spans.withColumns({
        "pps": _rate(F.col("packets"), F.col("seconds")),
        "bps": _rate(F.col("bytes"), F.col("seconds")),
    })
    def of(kind: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col(value))), F.lit(0.0))

    return rates.groupBy("trace_id", "process_name", "pid").agg(
        *[of(k, "pps").alias(f"{k}_pps") for k in kinds],
        *[(of(k, "bps") / MIB).alias(f"{k}_mib_s") for k in kinds],
        F.sum("bps").alias("total_bytes_s"),
    )


def packet_drops(drops: DataFrame) -> DataFrame:
    """Dropped packets and bytes per miniport and reason with the share of packets."""
    sums = drops.groupBy("trace_id", "miniport", "reason").agg(
        F.count(F.lit(1)).alias("drops"), F.sum("size").alias("bytes")
    )
    return with_share(sums, ["trace_id"], "drops", "pct")


def event_gaps(events: DataFrame, *, slice_us: int = DEFAULT_SLICE_US) -> DataFrame:
    """Time since the previous event of the same thread, where there is one."""
    rows = events.where(F.col("ts_us").isNotNull())
    gaps = with_neighbours(
        rows, ["trace_id", "pid", "tid"], ["ts_us", "seq"], previous={"prev_us": "ts_us"}, slice_us=slice_us
    )
    return gaps.where(F.col("prev_us").isNotNull()).withColumn("latency_us", F.col("ts_us") - F.col("prev_us"))


def operation_latency(
    events: DataFrame, fallback: DataFrame | None = None, *, process_filter: str | None = None,
    slice_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Exact latency percentiles per process of connect or accept operations.

    The gap to the previous operation of the thread stands for the latency. Traces without
    gaps in ``events`` use ``fallback``.
    """
    gaps = event_gaps(events, slice_us=slice_us).select("trace_id", "process_name", "pid", "latency_us")
    if fallback is not None:
        other = event_gaps(fallback, slice_us=slice_us).select("trace_id", "process_name", "pid", "latency_us")
        gaps = gaps.unionByName(other.join(gaps.select("trace_id").distinct(), "trace_id", "left_anti"))
    return exact_quantiles(
        _only(gaps, process_filter), ["trace_id", "process_name", "pid"], "latency_us",
        {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99, "p999_us": 0.999}, count="samples",
    )


def completion_batches(
    recv: DataFrame, *, window_us: int = 10, process_filter: str | None = None,
    slice_us: int = DEFAULT_SLICE_US,
) -> DataFrame:
    """Receive events and batches per socket and thread; a longer gap than the window starts a
    new batch."""
    rows = _only(recv, process_filter).where(F.col("ts_us").isNotNull())
    gaps = with_neighbours(
        rows, ["trace_id", "socket_handle", "tid"], ["ts_us", "seq"], previous={"prev_us": "ts_us"},
        slice_us=slice_us,
    )
    starts = F.col("prev_us").isNull() | (F.col("ts_us") - F.col("prev_us") > window_us)
    return gaps.groupBy("trace_id", "socket_handle", "tid").agg(
        F.min_by("process_name", F.struct("ts_us", "seq")).alias("process_name"),
        F.min_by("pid", F.struct("ts_us", "seq")).alias("pid"),
        F.count(F.lit(1)).alias("events"), F.count(F.when(starts, True)).alias("batches"),
    ).withColumn("events_per_batch", F.col("events") / F.col("batches"))


def socket_lifecycle(tables: dict[str, DataFrame], *, process_filter: str | None = None) -> DataFrame:
    """Creation, close, duration, counts and bytes per process and socket.

    ``tables`` holds kinds ``connect``, ``accept``, ``close``, ``recv`` and ``send``. ``state`` is
    ``closed``, ``open`` or ``?`` where the creation is unknown or later than the close.
    """
    rows = _tagged(tables, ["trace_id", "ts_us", "seq", "process_name", "pid", "socket_handle", "size"])
    rows = _only(rows, process_filter).where(F.coalesce("socket_handle", F.lit(0)) != 0)
    made, io = F.col("kind").isin("connect", "accept"), F.col("kind").isin("recv", "send")
    sums = rows.groupBy("trace_id", "pid", "socket_handle").agg(
        F.min_by("process_name", F.when(~is_blank_name(F.col("process_name")), F.struct("ts_us", "seq"))).alias("process_name"),
        F.min(F.when(made, F.col("ts_us"))).alias("created_us"),
        F.max(F.when(F.col("kind") == "close", F.col("ts_us"))).alias("closed_us"),
        F.count(F.when(F.col("kind") == "recv", True)).alias("recv_count"),
        F.count(F.when(F.col("kind") == "send", True)).alias("send_count"),
        F.sum(F.when(io, F.coalesce("size", F.lit(0))).otherwise(F.lit(0))).alias("bytes"),
    )
    whole = F.coalesce(F.col("closed_us") >= F.col("created_us"), F.lit(False))
    return sums.withColumns({
        "duration_s": F.when(whole, _seconds("created_us", "closed_us")),
        "state": F.when(whole, F.lit("closed")).when(F.col("closed_us").isNull(), F.lit("open")).otherwise(F.lit("?")),
    })


def socket_affinity(recv: DataFrame) -> DataFrame:
    """Share of the busiest CPU among a socket's receive events."""
    rows = recv.where((F.coalesce("socket_handle", F.lit(0)) != 0) & (F.coalesce("cpu", F.lit(-1)) >= 0))
    per_cpu = rows.groupBy("trace_id", "socket_handle", "cpu").agg(
        F.count(F.lit(1)).alias("n"),
        F.min_by(F.struct("process_name", "pid"), F.struct("ts_us", "seq")).alias("_who"),
        F.min(F.struct("ts_us", "seq")).alias("_first"),
    )
    result = per_cpu.groupBy("trace_id", "socket_handle").agg(
        F.min_by("_who", "_first").alias("_who"), F.sum("n").alias("events"),
        F.max_by(F.struct("cpu", "n"), F.struct(F.col("n"), -F.col("cpu"))).alias("_top"),
        F.count(F.lit(1)).alias("distinct_cpus"),
    )
    top_pct = F.col("_top.n") / F.col("events") * 100.0
    return result.select(
        "trace_id", "socket_handle", F.col("_who.process_name").alias("process_name"), F.col("_who.pid").alias("pid"),
        "events", F.col("_top.cpu").alias("top_cpu"), top_pct.alias("top_cpu_pct"), "distinct_cpus",
        affinity_status(F.col("events"), top_pct).alias("status"),
    )
