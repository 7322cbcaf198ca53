"""Captured packets: flows, timelines, send-receive pairing and journeys through a network stack."""

from __future__ import annotations

import json
from collections import deque
from functools import reduce
from itertools import takewhile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.classes import journey_confidence
from ..functions.packet import DECODED, decode_packets, tcp_flag_names
from ..plans.quantiles import exact_quantiles
from ..plans.replay import Rows, key_runs, scan_sorted, settle
from ..plans.scan import FAR, compose, states_before
from ..plans.sequence import SLICE, slice_of
from ..session import durable
from .filters import contains_text, flow_predicate, nearest_event

MATCH_WINDOW_US = 10_000
JOURNEY_WINDOW_US = 50_000
# Fixed values: (component, edge) of each stage a packet passes, by direction.
SEND_PATH = ((12, 1), (4, 1), (4, 2), (6, 1), (6, 2), (2, 1), (9, 1), (1, 1))
RECV_PATH = ((1, 1), (9, 1), (2, 1), (6, 2), (6, 1), (4, 2), (4, 1), (12, 1))
LAST_STAGE = len(SEND_PATH) - 1


def path_index(direction: Column, component: Column, edge: Column) -> Column:
    """Position of a stage on the path of its direction, -1 off the path."""
    found = F.lit(-1)
    for name, path in (("Send", SEND_PATH), ("Recv", RECV_PATH)):
        for i, (c, e) in enumerate(path):
            found = F.when((direction == name) & (component == c) & (edge == e), F.lit(i)).otherwise(found)
    return found


ENDS = ("ip_src", "src_port", "ip_dst", "dst_port", "proto")  # what a flow selector looks at


def decoded_flows(packets: DataFrame, *fields: str) -> DataFrame:
    """Packets with the wanted ``fields``, by default all of the headers, and ``proto`` and ``flow``."""
    return decode_packets(packets, fields=list(dict.fromkeys([*(fields or DECODED), "proto", "flow"])))


def capture_summary(packets: DataFrame, *, process_filter: str | None = None) -> DataFrame:
    """Packets and bytes per flow and direction."""
    rows = packets
    if process_filter and "process_name" in rows.columns:
        rows = rows.where(contains_text(F.col("process_name"), process_filter))
    way = F.lower("direction")

    def of(name: str, value: Column) -> Column:
        return F.sum(F.when(way == name, value).otherwise(F.lit(0)))

    return decode_packets(rows, fields=["flow"]).groupBy("trace_id", "flow").agg(
        of("recv", F.lit(1)).alias("recv_packets"), of("send", F.lit(1)).alias("send_packets"),
        of("recv", F.col("size")).alias("recv_bytes"), of("send", F.col("size")).alias("send_bytes"),
        F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"),
    )


def packet_timeline(packets: DataFrame, selector: str, *, limit: int | None = None) -> DataFrame:
    """Packets of one flow, both directions, in time order with their transport fields."""
    predicate = flow_predicate(selector)
    if predicate is None:
        raise ValueError(f"not a flow selector: {selector!r}")
    fields = (*ENDS, "flow", "ip_id", "tcp_seq", "tcp_ack", "tcp_flags", "tcp_window", "udp_length")
    rows = decode_packets(packets, fields=fields).where(predicate).select(
        "trace_id", "ts_us", "seq", "direction", "flow", "size", "ip_id", "tcp_seq", "tcp_ack",
        F.array_join(tcp_flag_names(F.coalesce("tcp_flags", F.lit(0))), "+").alias("tcp_flag_names"),
        "tcp_window", "udp_length",
    ).orderBy("trace_id", "ts_us", "seq")
    return rows if limit is None else rows.limit(limit)


def packet_at(packets: DataFrame, target_us: int) -> DataFrame:
    """The decoded packet nearest to a time, per trace."""
    return decoded_flows(nearest_event(packets, target_us))


# ---- send -> receive pairing ---------------------------------------------------------------
#
# Receipts take the oldest pending send of their key, and sends expire after the window. With
# S = sends so far, E = sends already expired and C = sends taken or skipped so far, a receipt
# moves C to min(max(C, E) + 1, S) and is paired with send number max(C, E) if there is one.
# Such steps compose (plans.scan), so a slice of a busy key is summarised by three numbers, the
# states between slices come from a scan over those, and every slice is replayed on its own from
# the right state. Within a slice sends count from its first own one; those of the slice before
# have negative numbers.


def _moves(ts: list[int], is_send: list[bool], guest: list[bool], window: int):
    """Per receipt in a slice: row, number of the first send not expired, sends seen, rows of the sends and the number of the first."""
    rows = [i for i, g in enumerate(guest) if g]
    first = -len(rows)
    expired = 0
    for i in range(len(rows), len(ts)):
        if is_send[i]:
            rows.append(i)
            continue
        while expired < len(rows) and ts[rows[expired]] < ts[i] - window:
            expired += 1
        yield i, first + expired, first + len(rows), rows, first


def pair_sends_with_receipts(
    packets: DataFrame, *, window_us: int = MATCH_WINDOW_US, slice_us: int | None = None,
    key: str = "match", keep: tuple[str, ...] = ("flow",),
) -> DataFrame:
    """First-in first-out pairs of sent and received packets with equal ``key``.

    A gap of exactly the window pairs; each packet is used once; a send at the time of the
    receipt counts if its ``seq`` is lower. ``packets`` has ``trace_id, ts_us, seq, direction``,
    the key and the columns to ``keep``, which are those of the send. Other directions, and rows
    without a key or a time, pair with nothing.

    Keys with one send and one receipt, nearly all in a capture, are paired by aggregation; only
    the packets of other keys with both are put in order and replayed.
    """
    width = slice_us or max(window_us * 100, 1_000_000)
    if width < window_us:
        raise ValueError("slice_us must not be below window_us")
    rows = packets.where(F.col(key).isNotNull() & F.col("ts_us").isNotNull()).select(
        "trace_id", F.col(key).alias("_key"), F.col("ts_us").cast("bigint").alias("ts_us"),
        F.col("seq").cast("bigint").alias("seq"), F.lower("direction").alias("_way"), *keep,
    ).where(F.col("_way").isin("send", "recv")).withColumn("_send", F.col("_way") == "send").drop("_way")
    # read twice below; what decoding and key building cost is paid once
    rows = durable(rows)
    carried = list(keep)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    by_key = rows.groupBy("trace_id", "_key").agg(
        F.count_if("_send").alias("_sends"), F.count_if(~F.col("_send")).alias("_receipts"),
        F.min(F.when(F.col("_send"), F.struct("ts_us", "seq", *carried))).alias("_s"),
        F.min(F.when(~F.col("_send"), F.struct("ts_us", "seq"))).alias("_r"),
    ).where("_sends > 0 AND _receipts > 0")
    by_key = durable(by_key)
    gap = F.col("_r.ts_us") - F.col("_s.ts_us")
    before = (gap > 0) | ((gap == 0) & (F.col("_s.seq") < F.col("_r.seq")))
    single = by_key.where("_sends = 1 AND _receipts = 1").where(before & (gap <= window_us)).select(
        "trace_id", *[F.col(f"_s.{c}").alias(c) for c in carried], F.col("_s.ts_us").alias("send_us"), F.col("_r.ts_us").alias("recv_us"),
        F.col("_s.seq").alias("send_seq"), F.col("_r.seq").alias("recv_seq"),
    )
    several = rows.join(by_key.where("_sends + _receipts > 2"), ["trace_id", "_key"], "left_semi")
    replayed = _replayed(several, window_us, width, carried, kinds)
    return single.unionByName(replayed).withColumn("latency_us", F.col("recv_us") - F.col("send_us"))


def _replayed(rows: DataFrame, window_us: int, width: int, carried: list[str], kinds: dict[str, str]) -> DataFrame:
    """Pairs of keys with several packets, slice by slice."""
    part = ["trace_id", "_key", SLICE]
    own = slice_of(F.col("ts_us"), width)
    local = rows.withColumn(SLICE, own).withColumn("_guest", F.lit(False))
    # sends are repeated in the next slice, which may still pair with them
    guests = rows.where("_send").withColumn(SLICE, own + 1).withColumn("_guest", F.lit(True))
    placed = durable(local.unionByName(guests).withColumn("_guest_last", ~F.col("_guest")))
    order = ["_guest_last", "ts_us", "seq"]
    fields = ["ts_us", "seq", "_send", "_guest"]

    def summaries(batches):
        out = Rows([*part, "_n", "_k", "_low", "_high"])
        for found, run in key_runs(batches, part, fields):
            sent = sum(s and not g for s, g in zip(run["_send"], run["_guest"], strict=True))
            step = (0, -FAR, FAR)
            for _, expired, seen, _, _ in _moves(run["ts_us"], run["_send"], run["_guest"], window_us):
                step = compose(step, (1, expired + 1, seen))
            for name, value in zip(out.columns, (*found, sent, *step), strict=True):
                out.lists[name].append(value)
            if out.full():
                yield out.take()
        yield out.take()

    slice_kind = dict(placed.dtypes)[SLICE]
    part_schema = f"trace_id {kinds['trace_id']}, _key {kinds['_key']}, {SLICE} {slice_kind}"
    steps = durable(scan_sorted(placed, part, order, summaries, f"{part_schema}, _n bigint, _k bigint, _low bigint, _high bigint"))
    keys = ["trace_id", "_key"]
    unbound = F.lit(None).cast("bigint")
    sent = states_before(steps.select(*part, F.col("_n").alias("_k"), unbound.alias("_low"), unbound.alias("_high")), keys, SLICE)
    # numbers within a slice become numbers within the key
    moved = steps.join(sent.withColumnRenamed("_state", "_sent"), part).select(
        *part, "_sent", "_k", F.when(F.col("_low") > -FAR, F.col("_low") + F.col("_sent")).alias("_low"),
        F.when(F.col("_high") < FAR, F.col("_high") + F.col("_sent")).alias("_high"))
    moved = durable(moved)
    starts = moved.select(*part, "_sent").join(states_before(moved, keys, SLICE), part).select(
        *part, (F.col("_state") - F.col("_sent")).alias("_start"))

    def pairs(batches):
        out = Rows(["trace_id", *carried, "send_us", "recv_us", "send_seq", "recv_seq"])
        for found, run in key_runs(batches, part, [*fields, "_start", *carried]):
            at, ts, seq = run["_start"][0], run["ts_us"], run["seq"]
            for i, expired, seen, rows_of, first in _moves(ts, run["_send"], run["_guest"], window_us):
                at = max(at, expired)
                if at < seen:
                    j = rows_of[at - first]
                    at += 1
                    row = (found[0], *[run[c][j] for c in carried], ts[j], ts[i], seq[j], seq[i])
                    for name, value in zip(out.columns, row, strict=True):
                        out.lists[name].append(value)
            if out.full():
                yield out.take()
        yield out.take()

    keep_schema = "".join(f"`{c}` {kinds[c]}, " for c in carried)
    return scan_sorted(
        placed.join(starts, part), part, order, pairs,
        f"trace_id {kinds['trace_id']}, {keep_schema}send_us bigint, recv_us bigint, send_seq bigint, recv_seq bigint",
    )


def send_recv_pairs(packets: DataFrame, *, window_us: int = MATCH_WINDOW_US, slice_us: int | None = None) -> DataFrame:
    """Pairs of captured sends and receipts of the same packet."""
    rows = decode_packets(packets, fields=["flow", "match"])
    return pair_sends_with_receipts(rows, window_us=window_us, slice_us=slice_us)


def send_recv_latency(pairs: DataFrame) -> DataFrame:
    """Latency percentiles of matched pairs per flow."""
    return exact_quantiles(
        pairs, ["trace_id", "flow"], "latency_us",
        {"p50_us": 0.5, "p99_us": 0.99, "p999_us": 0.999},
        count="pairs", minimum="min_us", maximum="max_us",
    )


# ---- journeys ------------------------------------------------------------------------------


def _follow(window: int, last_stage: int):
    """Greedy assignment of one packet's sightings to journeys."""

    def step(entry: str | None, columns: dict[str, list]):
        # open journeys by last stage, in order of their last time: [last, first time, first seq]
        levels = [deque() for _ in range(last_stage + 1)]
        for level, journeys in zip(levels, json.loads(entry) if entry else []):
            level.extend(journeys)
        ids = []
        for ts, seq, index in zip(columns["ts_us"], columns["seq"], columns["path_index"]):
            journey = None
            at = index
            while at:
                at -= 1
                level = levels[at]
                while level and ts - level[0][0] > window:
                    level.popleft()
                if not level:
                    continue
                last = level[-1][0]
                if len(level) == 1 or level[-2][0] != last:
                    journey = level.pop()
                else:
                    # of those seen last, the journey that began first
                    journey = min(takewhile(lambda j: j[0] == last, reversed(level)), key=lambda j: (j[1], j[2]))
                    level.remove(journey)
                break
            if journey is None:
                journey = (ts, ts, seq)
            ids.append(journey[2])
            if index < last_stage:
                levels[index].append((ts, journey[1], journey[2]))
        out = {**columns, "journey": ids}
        last = columns["ts_us"][-1]
        live = [[j for j in level if last - j[0] <= window] for level in levels]
        return out, json.dumps(live) if any(live) else None

    return step


def packet_journeys(
    layers: DataFrame, *, flow: str | None = None, direction: str | None = None,
    window_us: int = JOURNEY_WINDOW_US, slice_us: int | None = None,
) -> DataFrame:
    """Sightings of packets at capture points, grouped into journeys.

    A sighting joins the open journey of the same packet that got furthest below its own path
    position within the window, else it starts one. A journey closes at its last stage and is
    named by the ``seq`` of its first sighting. ``layers`` has ``trace_id, ts_us, seq, direction,
    packet_hex, size, component, edge, path_index``.
    """
    wanted = {"tx": "Send", "send": "Send", "rx": "Recv", "recv": "Recv", "receive": "Recv"}.get(
        (direction or "").strip().lower()
    )
    rows = layers.where(F.col("path_index") >= 0)
    if wanted:
        rows = rows.where(F.col("direction") == wanted)
    predicate = flow_predicate(flow) if flow else None
    fields = dict.fromkeys([*(ENDS if predicate is not None else ()), "ip_proto", "proto", "flow", "fingerprint"])
    rows = decode_packets(rows, fields=list(fields), size=F.coalesce("size", F.lit(0)))
    if predicate is not None:
        rows = rows.where(predicate)
    rows = rows.where(F.col("fingerprint").isNotNull())
    # protocol label: the transport's name only where its ports were decoded
    label = F.when(F.col("fingerprint").startswith("ip|"), F.concat(F.lit("proto-"), F.col("ip_proto").cast("string"))).otherwise(F.col("proto"))
    rows = rows.withColumn("proto", label)
    return settle(
        rows, ["trace_id", "direction", "fingerprint"], ["ts_us", "seq"],
        _follow(window_us, LAST_STAGE),
        values=["ts_us", "seq", "path_index", "component", "edge", "flow", "proto"],
        output="ts_us bigint, seq bigint, path_index int, component int, edge int, flow string, proto string, journey bigint",
        tolerance_us=window_us, slice_us=slice_us or max(20 * window_us, 1_000_000), reads=["ts_us", "seq", "path_index"],
    )


JOURNEY = ["trace_id", "direction", "fingerprint", "journey"]


def journey_summary(sightings: DataFrame) -> DataFrame:
    """One row per journey: completeness, confidence, total latency and the path taken.

    A journey has at most one sighting per stage of the path.
    """
    stage = F.struct("ts_us", "seq", "component", "edge")
    stages = F.array_sort(F.collect_list(stage))
    name = F.transform(stages, lambda s: F.concat(s["component"].cast("string"), F.lit("/"), s["edge"].cast("string")))
    first, last = F.min("path_index"), F.max("path_index")
    complete = (first == 0) & (last == LAST_STAGE)
    rows = sightings.groupBy(*JOURNEY).agg(
        F.min_by("flow", F.struct("ts_us", "seq")).alias("flow"),
        F.min_by("proto", F.struct("ts_us", "seq")).alias("proto"),
        F.count(F.lit(1)).alias("stages"), complete.alias("complete"),
        (F.max("ts_us") - F.min("ts_us")).alias("total_us"), F.array_join(name, " -> ").alias("path"),
    )
    return rows.withColumn("confidence", journey_confidence(F.col("proto"), F.col("complete")))


def hop_latency(sightings: DataFrame, journeys: DataFrame | None = None) -> DataFrame:
    """Latency per hop between consecutive stages: p50, p95, p99 (by index) and the longest."""
    whole = Window.partitionBy(*JOURNEY)
    inside = whole.orderBy("ts_us", "seq")
    before = F.lag(F.struct("ts_us", "component", "edge", "path_index")).over(inside)
    hops = sightings.withColumn("_before", before)
    if journeys is None:
        # as the summary of journeys has them, from the same pass
        complete = (F.min("path_index").over(whole) == 0) & (F.max("path_index").over(whole) == LAST_STAGE)
        first = F.first("proto").over(inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        hops = hops.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in JOURNEY)))
        hops = hops.withColumns({"proto": first, "confidence": journey_confidence(first, complete)})
    hops = hops.where(F.col("path_index") > F.col("_before.path_index"))
    label = F.concat(
        F.col("_before.component").cast("string"), F.lit("/"), F.col("_before.edge").cast("string"), F.lit(" -> "),
        F.col("component").cast("string"), F.lit("/"), F.col("edge").cast("string"),
    )
    told = ["proto", "confidence"] if journeys is None else []
    hops = hops.select(*JOURNEY, label.alias("hop"), (F.col("ts_us") - F.col("_before.ts_us")).alias("hop_us"), *told)
    if journeys is not None:
        hops = hops.join(journeys.select(*JOURNEY, "proto", "confidence"), JOURNEY)
    return exact_quantiles(
        hops, ["trace_id", "direction", "proto", "hop", "confidence"], "hop_us",
        {"p50_us": 0.5, "p95_us": 0.95, "p99_us": 0.99}, kind="index", count="samples", maximum="max_us",
    )


def slowest_journeys(journeys: DataFrame, *, limit: int | None = None) -> DataFrame:
    """The journeys with the longest total latency among those of several stages."""
    ordered = journeys.where(F.col("stages") > 1).orderBy(
        F.col("total_us").desc(), "trace_id", "direction", "journey"
    )
    return ordered if limit is None else ordered.limit(limit)
