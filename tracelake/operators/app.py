"""Requests and QUIC connections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cid_bytes, fnv1a_32
from ..plans.quantiles import exact_quantiles, null_safe_join
from ..plans.sequence import DEFAULT_SLICE_US, with_neighbours, with_running
from .filters import contains_text

REQUEST = ["trace_id", "request_id"]
CONNECTION = ["trace_id", "connection_id"]
ACK_FLAG_US = 25_000


def _valid(df: DataFrame, key: str) -> DataFrame:
    return df.where(F.coalesce(F.col(key), F.lit(0)) != 0)


def request_lifecycle(
    recv: DataFrame, send: DataFrame, deliver: DataFrame, close: DataFrame, *, url_filter: str | None = None
) -> DataFrame:
    """Each received request with its earliest send, delivery and close.

    Latencies that would be negative are 0; a missing step leaves null.
    """
    order = F.struct("ts_us", "seq")
    first_send = _valid(send, "request_id").groupBy(*REQUEST).agg(
        F.min("ts_us").alias("send_us"),
        F.min_by(F.struct("status_code", "content_length"), order).alias("_response"),
    )
    first_deliver = _valid(deliver, "request_id").groupBy(*REQUEST).agg(F.min("ts_us").alias("deliver_us"))
    first_close = _valid(close, "request_id").groupBy(*REQUEST).agg(F.min("ts_us").alias("close_us"))
    rows = _valid(recv, "request_id")
    if url_filter:
        rows = rows.where(contains_text(F.col("url"), url_filter))
    joined = rows.join(first_send, REQUEST, "left").join(first_deliver, REQUEST, "left").join(first_close, REQUEST, "left")

    def gap(later: str, earlier: str) -> Column:
        return F.greatest(F.col(later) - F.col(earlier), F.lit(0))

    def both(a: str, b: str, value: Column) -> Column:
        return F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), value)

    status = F.col("_response.status_code")
    return joined.select(
        "trace_id", "request_id", "verb", "url", F.col("ts_us").alias("recv_us"),
        F.nullif(status, F.lit(0)).alias("status_code"),
        F.col("_response.content_length").alias("content_length"),
        both("send_us", "ts_us", gap("send_us", "ts_us")).alias("recv_to_send_us"),
        both("deliver_us", "send_us", gap("send_us", "deliver_us")).alias("deliver_to_send_us"),
        both("close_us", "ts_us", gap("close_us", "ts_us")).alias("recv_to_close_us"),
        (F.coalesce(status, F.lit(0)) == 0).alias("_no_status"),
    ).withColumn(
        "in_flight", F.col("_no_status") & (F.coalesce("recv_to_close_us", F.lit(0)) == 0)
    ).drop("_no_status")


def request_report(requests: DataFrame) -> DataFrame:
    """Requests, completed and in flight, with nearest-rank latency percentiles per trace."""
    quantiles = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p999": 0.999}
    counts = requests.groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("requests"), F.count("recv_to_send_us").alias("completed"),
        F.count(F.when(F.col("in_flight"), True)).alias("in_flight"),
    )
    for step in ("recv_to_send", "deliver_to_send"):
        tail = exact_quantiles(
            requests, ["trace_id"], f"{step}_us",
            {f"{step}_{name}_us": q for name, q in quantiles.items()}, kind="nearest",
        )
        counts = counts.join(tail, "trace_id", "left")
    return counts


def queue_depth(
    deliver: DataFrame, send: DataFrame, close: DataFrame, *, slice_us: int = DEFAULT_SLICE_US
) -> DataFrame:
    """Requests waiting per URL group: peak, time-weighted mean, latency percentiles.

    A delivery adds one, the earliest send (or the close, without a send) takes one away; depth
    never falls below zero. A delivery comes before a completion at the same time.
    """
    order = F.struct("ts_us", "seq")
    entries = _valid(deliver, "request_id")
    group_of = entries.groupBy(*REQUEST).agg(
        F.max_by(F.struct("url_group_id", F.col("ts_us").alias("deliver_us")), order).alias("_d")
    ).select(*REQUEST, "_d.*")
    sent = _valid(send, "request_id").groupBy(*REQUEST).agg(F.min("ts_us").alias("sent_us"))
    closed = _valid(close, "request_id").groupBy(*REQUEST).agg(
        F.min_by("ts_us", order).alias("closed_us")
    )
    done = sent.join(closed, REQUEST, "full").select(*REQUEST, F.coalesce("sent_us", "closed_us").alias("ts_us"))
    completed = done.join(group_of.where(F.col("url_group_id") != 0), REQUEST)
    keys = ["trace_id", "url_group_id"]
    steps = entries.where(F.coalesce("url_group_id", F.lit(0)) != 0).select(
        *keys, "ts_us", "request_id", F.lit(0).alias("kind"), F.lit(1).alias("step")
    ).unionByName(completed.select(*keys, "ts_us", "request_id", F.lit(1).alias("kind"), F.lit(-1).alias("step")))
    arrangement = ["ts_us", "kind", "request_id"]
    depth = with_running(steps, keys, arrangement, {}, floor_at_zero={"depth": "step"}, slice_us=slice_us)
    timed = with_neighbours(depth, keys, arrangement, following={"next_us": "ts_us"}, slice_us=slice_us)
    # beyond a bigint where very many requests wait for years
    wide = [c.cast("decimal(19,0)") for c in (F.col("depth"), F.coalesce(F.col("next_us") - F.col("ts_us"), F.lit(0)))]
    area = F.sum(wide[0] * wide[1]).cast("double")
    span = F.max("ts_us") - F.min("ts_us")
    result = timed.groupBy(*keys).agg(
        F.max("depth").alias("peak_depth"),
        F.when(span > 0, area / span).otherwise(F.lit(0.0)).alias("avg_depth"),
        F.count(F.when(F.col("kind") == 0, True)).alias("deliveries"),
        F.count(F.when(F.col("kind") == 1, True)).alias("completions"),
    )
    latency = completed.where(F.col("ts_us") >= F.col("deliver_us")).withColumn(
        "latency_us", F.col("ts_us") - F.col("deliver_us")
    )
    tail = exact_quantiles(latency, keys, "latency_us", {"p50_us": 0.5, "p99_us": 0.99}, kind="nearest")
    return null_safe_join(result, tail, keys, "left")


def quic_connections(
    created: DataFrame, closed: DataFrame, recv: DataFrame, send: DataFrame, *, process_filter: str | None = None
) -> DataFrame:
    """Lifetime, packets, bytes and packets lost per connection.

    Loss is the size of the received packet-number range less the distinct numbers in it.
    With a process filter, only connections created by a matching process are listed.
    """
    created, closed = _valid(created, "connection_id"), _valid(closed, "connection_id")
    recv, send = _valid(recv, "connection_id"), _valid(send, "connection_id")
    if process_filter:
        created = created.where(contains_text(F.col("process_name"), process_filter))
        wanted = created.select(*CONNECTION).distinct()
        closed, recv, send = (t.join(wanted, CONNECTION, "left_semi") for t in (closed, recv, send))
    order = F.struct("ts_us", "seq")
    opened = created.groupBy(*CONNECTION).agg(
        F.max_by(F.struct("process_name", "remote_addr", "cid", F.col("ts_us").alias("created_us")), order).alias("_c")
    )
    ended = closed.groupBy(*CONNECTION).agg(
        F.max_by(F.struct("process_name", F.col("ts_us").alias("closed_us")), order).alias("_e")
    )
    # packets of one number are merged before the connection is, so a busy connection spreads
    received = recv.groupBy(*CONNECTION, "packet_number").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")
    ).groupBy(*CONNECTION).agg(
        F.sum("n").alias("recv_packets"), F.sum("bytes").alias("recv_bytes"),
        F.count("packet_number").alias("_distinct"),
        (F.max("packet_number") - F.min("packet_number") + 1).alias("_range"),
    )
    sent = send.groupBy(*CONNECTION).agg(
        F.count(F.lit(1)).alias("send_packets"), F.sum("size").alias("send_bytes")
    )
    joined = reduce(lambda a, b: a.join(b, CONNECTION, "full"), [opened, ended, received, sent])
    life = F.col("_e.closed_us") - F.col("_c.created_us")
    return joined.select(
        *CONNECTION,
        F.coalesce(F.nullif("_c.process_name", F.lit("")), "_e.process_name", F.lit("")).alias("process_name"),
        F.coalesce("_c.remote_addr", F.lit("")).alias("remote_addr"), F.coalesce("_c.cid", F.lit("")).alias("cid"),
        F.coalesce(F.greatest(life, F.lit(0)), F.lit(0)).alias("lifetime_us"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("recv_packets", "send_packets", "recv_bytes", "send_bytes")],
        F.coalesce(F.greatest(F.col("_range") - F.col("_distinct"), F.lit(0)), F.lit(0)).alias("lost_packets"),
    )


def cid_distribution(created: DataFrame, recv: DataFrame) -> DataFrame:
    """Connections and CPUs per connection-id hash bucket; connections without an id are -1.

    The bucket is the hash modulo the number of CPUs seen receiving.
    """
    ids = _valid(created, "connection_id").where(F.col("cid") != "").groupBy(*CONNECTION).agg(
        F.min_by("cid", F.struct("ts_us", "seq")).alias("cid")
    )
    on_cpu = _valid(recv, "connection_id").where(F.col("cpu") >= 0).select(*CONNECTION, "cpu").distinct()
    cpus = on_cpu.groupBy("trace_id").agg(F.greatest(F.max("cpu") + 1, F.lit(1)).alias("_cpus"))
    known = ids.join(on_cpu, CONNECTION, "full").join(cpus, "trace_id", "left")
    bucket = F.when(F.col("cid").isNull(), F.lit(-1)).otherwise(
        F.pmod(fnv1a_32(cid_bytes(F.col("cid"))), F.coalesce("_cpus", F.lit(1)))
    )
    per_connection = known.withColumn("bucket", bucket)
    spread = per_connection.groupBy("trace_id", "bucket", "connection_id").agg(
        F.collect_set("cpu").alias("_set")
    )
    return spread.groupBy("trace_id", "bucket").agg(
        F.count(F.lit(1)).alias("connections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_set")))).alias("_all"),
    ).select(
        "trace_id", "bucket", "connections", F.size("_all").alias("actual_cpus"),
        F.array_join("_all", ",").alias("cpu_list"),
    )


def ack_delays(acks: DataFrame, created: DataFrame, *, process_filter: str | None = None) -> DataFrame:
    """Nearest-rank acknowledgement delays per connection, flagged from 25 ms at p99."""
    names = _valid(created, "connection_id").groupBy(*CONNECTION).agg(
        F.max_by("process_name", F.struct("ts_us", "seq")).alias("process_name")
    )
    rows = _valid(acks, "connection_id")
    if process_filter:
        rows = rows.join(names.where(contains_text(F.col("process_name"), process_filter)), CONNECTION, "left_semi")
    tail = exact_quantiles(
        rows, CONNECTION, "ack_delay", {"p50_us": 0.5, "p99_us": 0.99, "p999_us": 0.999},
        kind="nearest", count="acks",
    )
    return tail.join(names, CONNECTION, "left").withColumns({
        "process_name": F.coalesce("process_name", F.lit("")),
        "high": F.col("p99_us") >= ACK_FLAG_US,
    })
