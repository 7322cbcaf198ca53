"""Exact results on small inputs."""

import re

import pytest
from pyspark.sql import functions as F

from tracelake.functions import classes, ids, labels, packet
from tracelake.operators import app, attribution, cpu, filters, flows, interrupts, packets, report, sched, stacks
from tracelake.schemas import EVENT_CLASSES, canonical_event_class, event_schema
from tracelake.sources import export, normalise, store, text_events, text_reports

MS = 1000


def switches(spark, rows, state="Waiting"):
    """Rows of (ms, new tid, old tid); ``state`` is that of the thread switched out."""
    data = [("t", ms * MS, i, 0, new, old, 7, 7, "app", "app", state, "WrQueue") for i, (ms, new, old) in enumerate(rows)]
    return spark.createDataFrame(
        data, "trace_id string, ts_us long, seq long, cpu int, new_tid long, old_tid long, new_pid long, old_pid long, new_process string, old_process string, old_state string, wait_reason string"
    )


BASIC = [(0, 10, 0), (10, 0, 10), (40, 10, 0), (70, 0, 10)]


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


@pytest.mark.parametrize("slice_us", [5 * MS, 10_000_000])
def test_precise_cpu(spark, slice_us):
    r = one(sched.thread_cpu_precise(switches(spark, BASIC), duration_us=F.lit(100 * MS), slice_us=slice_us))
    assert (r.running_ms, r.running_pct, r.waiting_ms, r.waiting_pct, r.other_ms) == (40, 40, 60, 60, 0)
    assert (r.switch_ins, r.cswitch_per_s, r.wait_to_run) == (2, 20, 1)
    assert r.mean_wait_us == r.p50_wait_us == 30_000


def test_precise_cpu_window_and_edges(spark):
    rows = switches(spark, [(0, 10, 0), (5, 0, 10), (50, 10, 0), (80, 0, 10)])
    r = one(sched.thread_cpu_precise(rows, duration_us=F.lit(100 * MS), start_time=0.02))
    assert (r.running_ms, r.waiting_ms, r.wait_to_run, r.p50_wait_us) == (30, 50, 1, 0)
    rows = switches(spark, [(30, 0, 10), (60, 10, 0), (90, 0, 10)])
    r = one(sched.thread_cpu_precise(rows, duration_us=F.lit(100 * MS)))
    assert (r.running_ms, r.waiting_ms, r.switch_ins, r.wait_to_run, r.mean_wait_us) == (30, 40, 1, 1, 30_000)
    rows = switches(spark, [(10, 10, 0), (30, 0, 10), (60, 10, 0), (90, 0, 10)])
    r = one(sched.thread_cpu_precise(rows, duration_us=F.lit(100 * MS), start_time=0.02))
    assert (r.switch_ins, r.cswitch_per_s) == (1, 12.5)


def test_precise_cpu_by_process_and_reason(spark):
    rows = switches(spark, BASIC + [(5, 11, 0), (25, 0, 11)])
    r = one(sched.thread_cpu_precise(rows, duration_us=F.lit(100 * MS), group_by="process"))
    assert (r.threads, r.running_ms) == (2, 60)
    data = [("t", 0, 0, 10, 0, ""), ("t", 3 * MS, 1, 0, 10, "WrQueue"), ("t", 6 * MS, 2, 10, 0, ""), ("t", 9 * MS, 3, 0, 10, "WrPreempted"), ("t", 10 * MS, 4, 10, 0, "")]
    rows = spark.createDataFrame(data, "trace_id string, ts_us long, seq long, new_tid long, old_tid long, wait_reason string")
    r = one(sched.thread_cpu_precise(rows, duration_us=F.lit(10 * MS)))
    assert (r.waiting_ms, r.other_ms) == (3, 1)
    r = one(sched.thread_cpu_precise(rows.replace("WrPreempted", "32", ["wait_reason"]), duration_us=F.lit(10 * MS)))
    assert r.other_ms == 1


def test_ready_to_switch_matches_loop(spark):
    import random

    rng = random.Random(9)
    ready = [("t", rng.randrange(1, 4), rng.randrange(0, 3000), i, 0) for i in range(150)]
    runs = [("t", rng.randrange(1, 4), rng.randrange(0, 3000), 1000 + i, 0, 0) for i in range(150)]
    r = spark.createDataFrame(ready, "trace_id string, tid long, ts_us long, seq long, cpu int").withColumn("readied_tid", F.col("tid"))
    s = spark.createDataFrame(runs, "trace_id string, new_tid long, ts_us long, seq long, cpu int, old_tid long")
    found = {x.ready_seq: x.wait_us for x in sched.ready_to_switch(r, s, max_window_us=40).collect()}
    expected = {}
    for _, tid, ts, seq, _ in ready:
        later = [x[2] - ts for x in runs if x[1] == tid and x[2] >= ts]
        if later and min(later) <= 40:
            expected[seq] = min(later)
    assert found == expected


def names_of(spark, pairs):
    return spark.createDataFrame([("t", a, m, f) for a, (m, f) in pairs.items()], "trace_id string, address long, module string, function string")


def test_stack_weights_and_edges(spark):
    names = names_of(spark, {1: ("m", "A"), 2: ("m", "B"), 3: ("m", "C")})
    samples = spark.createDataFrame([("t", 1, [1, 2]), ("t", 1, [3, 2])], "trace_id string, weight long, stack array<long>")
    found = {r.function: (r.inclusive, r.exclusive) for r in stacks.stack_weights(samples, names).collect()}
    assert found == {"A": (1, 1), "B": (2, 0), "C": (1, 1)}
    samples = spark.createDataFrame([("t", 2, [1, 2, 3])], "trace_id string, weight long, stack array<long>")
    edges = {(r.target_function, r.direction, r.caller_function): r.weight for r in stacks.call_edges(samples, names).collect()}
    assert edges == {
        ("A", "caller", "B"): 2, ("B", "caller", "C"): 2, ("B", "callee", "A"): 2, ("C", "callee", "B"): 2,
        ("A", "self", "A"): 2, ("B", "self", "B"): 2, ("C", "self", "C"): 2,
    }


@pytest.fixture(scope="module")
def butterfly(spark):
    weights = spark.createDataFrame([
        ("t", "n", "lock", 1000, 1000), ("t", "n", "resolve", 700, 0), ("t", "n", "recv", 300, 0), ("t", "n", "interrupt", 630, 0), ("t", "n", "send", 70, 0),
    ], "trace_id string, module string, function string, inclusive long, exclusive long")
    edges = spark.createDataFrame([
        ("t", "n", "lock", "caller", "n", "resolve", 700, 70.0), ("t", "n", "lock", "caller", "n", "recv", 300, 30.0),
        ("t", "n", "resolve", "caller", "n", "interrupt", 630, 90.0), ("t", "n", "resolve", "caller", "n", "send", 70, 10.0),
    ], "trace_id string, target_module string, target_function string, direction string, caller_module string, caller_function string, weight long, parent_pct double")
    return weights, edges


def test_walks(spark, butterfly):
    weights, edges = butterfly
    walk = stacks.walk_stack(weights, edges, "lock").orderBy("depth").collect()
    assert [(r.function, r.chain_hits) for r in walk] == [("lock", 1000), ("resolve", 700), ("interrupt", 630)]
    wide = stacks.walk_stack(weights, edges, "lock", branch_policy="threshold", branch_threshold_pct=20)
    assert {r.function for r in wide.collect()} == {"lock", "resolve", "recv", "interrupt"}
    with pytest.raises(ValueError, match="more than 2 rows"):
        stacks.walk_stack(weights, edges, "lock", branch_policy="threshold", branch_threshold_pct=20, max_rows=2)
    assert one(stacks.count_stacks(weights, edges, ["lock", "resolve"])).matching == 700
    table = export.chain_table(stacks.walk_stack(weights, edges, "lock", max_depth=1), dialect="wpa")
    assert table.columns == ["trace_id", "Level", "Function", "Inclusive Hits", "Parent %", "Chain Hits", "Branch"]


def test_buckets_and_labels(spark):
    d = spark.createDataFrame([(0,), (3,), (100,), (10**9,)], "d long")
    b = classes.duration_bucket(F.col("d"))
    assert [tuple(r) for r in d.select(classes.bucket_low(b), classes.bucket_high(b)).collect()] == [(0, 1), (2, 4), (64, 128), (32768, 99999999)]
    s = spark.createDataFrame([("a.sys!Foo+0xabc",), ("a.sys!Foo",), ("a.sys+0x42",)], "s string")
    assert [tuple(r) for r in s.select(labels.symbol_module(F.col("s")), labels.symbol_function(F.col("s"))).collect()] == [("a.sys", "Foo"), ("a.sys", "Foo"), ("a.sys", "")]


def test_ipv6_text(spark):
    import socket

    texts = ["fe80::abcd", "::1", "::", "2001:db8:1::1:0:1", "2001:db8::1:0:0:a", "::ffff:1.2.3.4", "1:2:3:4:5:6:7:f", "1::", "1:0:0:2:0:0:0:3", "0:1:2:3:4:5:6:7"]
    rows = [(socket.inet_pton(socket.AF_INET6, x).hex(),) for x in texts]
    got = [r.t for r in spark.createDataFrame(rows, "h string").select(labels.ipv6_text(F.col("h")).alias("t")).collect()]
    assert got == [socket.inet_ntop(socket.AF_INET6, bytes.fromhex(h)) for (h,) in rows]


def test_packet_truncation(spark):
    eth = "00112233445566778899aabb"
    cases = {
        "": "eth", "0011": "eth", eth + "8100": "vlan", eth + "0800" + "45": "ip", eth + "0800" + "65" + "00" * 19: "ip",
        eth + "0800" + "4500002800010000400600000102030405060708" + "0050": "tcp",
        eth + "0800" + "4500002800010000401100000102030405060708" + "0050": "udp",
        eth + "0800" + "4500002800010000400100000102030405060708": "icmp",
        eth + "86dd" + "60000000000a3a40" + "00" * 32: "icmpv6", eth + "0806": None,
    }
    rows = packet.decode_packets(spark.createDataFrame([(h,) for h in cases], "packet_hex string")).collect()
    assert {r.packet_hex: r.truncated_at for r in rows} == cases


def test_attribution_of_samples(spark):
    base = "trace_id string, seq long, qpc long, "
    samples = spark.createDataFrame(
        [("t", i, 1000 + i, 4294967295, 5, 5, 0x1010, 0, w) for i, w in enumerate((3, 2, 1))],
        base + "pid long, tid long, payload_tid long, address long, weight long, profile_weight long")
    table = cpu.cpu_sampling(
        samples,
        thread=spark.createDataFrame([("t", 0, 1, 42, 5)], base + "pid long, tid long"),
        process=spark.createDataFrame([("t", 0, 1, 42, "app.exe"), ("t", 1, 2, 42, "")], base + "pid long, image_file_name string"),
        image=spark.createDataFrame([("t", 0, 1, 42, 0x1000, 0x1000, "\\dir\\App.exe", "Load")], base + "pid long, image_base long, image_size long, file_name string, type string"),
    )
    r = one(table)
    assert (r.process_name, r.pid, r.module, r.weight, r.weight_pct) == ("app.exe", 42, "app.exe", 6, 100.0)


def test_kernel_addresses_keep_their_order(spark):
    high = -(2**63) + 0x5010  # bits of 0x8000000000005010
    images = spark.createDataFrame([("t", -(2**63) + 0x5000, 0x100, "k.sys", "Load"), ("t", 0x5000, 0x100, "u.dll", "Load")], "trace_id string, image_base long, image_size long, file_name string, type string")
    places = attribution.resolve_addresses(spark.createDataFrame([("t", high), ("t", 0x5010), ("t", 0x9999)], "trace_id string, address long"), images)
    assert {r.address: r.module for r in places.collect()} == {high: "k.sys", 0x5010: "u.dll", 0x9999: "<unknown>"}


def test_idle_row(spark):
    table = spark.createDataFrame([("t", "p", 1, "m", "f", "pdb", 250_000)], "trace_id string, process_name string, pid long, module string, function string, symbol_source string, weight long")
    meta = spark.createDataFrame([("t", 1.0, 1)], "trace_id string, duration_s double, cpu_count int")
    assert {r.process_name: r.weight for r in cpu.idle_top_up(table, meta).collect()} == {"p": 250_000, "Idle": 750_000}
    assert cpu.idle_top_up(table, meta, time_scaled=False).count() == 1


def test_latency_batches_sockets(spark):
    times, t = [], 0
    for gap in range(0, 110, 10):
        t += gap
        times.append(t)
    schema = "trace_id string, process_name string, pid long, tid long, ts_us long, seq long"
    rows = spark.createDataFrame([("t", "p", 1, 1, x, i) for i, x in enumerate(times)], schema)
    r = one(flows.operation_latency(rows, slice_us=35))
    assert (r.samples, r.p50_us, round(r.p99_us, 6)) == (10, 55, 99.1)
    recv = spark.createDataFrame([("t", "p", 1, 1, x, i) for i, x in enumerate((5, 6, 7, 1005, 1006, 1007))], schema).withColumn("socket_handle", F.lit(9))
    r = one(flows.completion_batches(recv, slice_us=2))
    assert (r.events, r.batches, r.events_per_batch) == (6, 2, 3.0)
    counts = [(1, 0, 95), (1, 1, 5), *[(2, c, 10) for c in range(8)], (3, 0, 5)]
    hits = [("t", "p", 1, h, c, i, i) for h, c, n in counts for i in range(n)]
    found = flows.socket_affinity(spark.createDataFrame(hits, "trace_id string, process_name string, pid long, socket_handle long, cpu int, ts_us long, seq long"))
    assert {r.socket_handle: r.status for r in found.collect()} == {1: "affinity working", 2: "affinity not working", 3: "low confidence"}


def test_requests_and_queue(spark):
    recv = spark.createDataFrame([("t", 1000, 0, 1, "GET", "/"), ("t", 1500, 1, 2, "GET", "/"), ("t", 1600, 2, 3, "GET", "/")], "trace_id string, ts_us long, seq long, request_id long, verb string, url string")
    send = spark.createDataFrame([("t", 1200, 0, 1, 200, 5), ("t", 2000, 1, 2, 200, 5)], "trace_id string, ts_us long, seq long, request_id long, status_code long, content_length long")
    deliver = spark.createDataFrame([], "trace_id string, ts_us long, seq long, request_id long, url_group_id long")
    close = spark.createDataFrame([], "trace_id string, ts_us long, seq long, request_id long")
    rows = {r.request_id: (r.recv_to_send_us, r.in_flight) for r in app.request_lifecycle(recv, send, deliver, close).collect()}
    assert rows == {1: (200, False), 2: (500, False), 3: (None, True)}
    d = [("t", 10_000_000 + i, i, i + 1, 7) for i in range(5)] + [("t", 21_000_000, 9, 9, 7)]
    s = [("t", 20_000_000 + i, i, i + 1, 200, 1) for i in range(5)] + [("t", 21_500_000, 9, 9, 200, 1)]
    depth = one(app.queue_depth(spark.createDataFrame(d, deliver.schema), spark.createDataFrame(s, send.schema), close, slice_us=1_000_000))
    assert (depth.peak_depth, depth.deliveries, depth.completions) == (5, 6, 6)


def test_quic(spark):
    p = "trace_id string, connection_id long, packet_number long, size long, cpu int"
    sent = spark.createDataFrame([("t", 1, n, 10, 0) for n in range(1, 11)], p)
    got = spark.createDataFrame([("t", 1, n, 10, 0) for n in (1, 2, 4, 5, 6, 7, 9, 10)], p)
    life = "trace_id string, connection_id long, process_name string, remote_addr string, cid string, ts_us long, seq long"
    r = one(app.quic_connections(spark.createDataFrame([("t", 1, "a", "", "", 1000, 0)], life), spark.createDataFrame([("t", 1, "a", "", "", 5000, 0)], life), got, sent))
    assert (r.recv_packets, r.send_packets, r.lost_packets, r.lifetime_us) == (8, 10, 2, 4000)
    acks = [("t", 1, 500, i) for i in range(95)] + [("t", 1, 40_000, i) for i in range(5)] + [("t", 2, 5000, i) for i in range(50)]
    rows = app.ack_delays(spark.createDataFrame(acks, "trace_id string, connection_id long, ack_delay long, seq long"), spark.createDataFrame([], life))
    assert {r.connection_id: (r.p99_us, r.high) for r in rows.collect()} == {1: (40_000, True), 2: (5000, False)}


def test_pairing_window_edge(spark):
    schema = "trace_id string, match string, ts_us long, seq long, direction string, flow string"
    apart = spark.createDataFrame([("t", "k", 0, 0, "Send", "f"), ("t", "k", 10_001, 1, "Recv", "f")], schema)
    assert packets.pair_sends_with_receipts(apart).count() == 0
    edge = spark.createDataFrame([("t", "k", 0, 0, "Send", "f"), ("t", "k", 5, 1, "Send", "f"), ("t", "k", 10_005, 2, "Recv", "f")], schema)
    assert one(packets.pair_sends_with_receipts(edge)).latency_us == 10_000


def test_class_names():
    for spelled, name in {
        "TcpIp/Recv": "tcpip_recv", "UdpIp_Send": "udp_send", "AFDClose": "afd_close", "PacketDrop": "ndis_drops", "HTTPRequestTraceTask/SrvdReq": "http_close",
        "MsQuic/ConnectionCreated": "quic_conn_created", "PerfInfo/ThreadedDPC": "dpc", "Thread/ReadyThread": "readythread", "ready_thread": "readythread",
        "ImageID/DbgID_RSDS": "imageid_rsds", "cswitch_events_df": "cswitch", "Process/Defunct": "process", "NDIS-PacketCapture/Recv": "packet_capture",
    }.items():
        assert canonical_event_class(spelled) == name
    for name in EVENT_CLASSES:
        assert canonical_event_class(name) == name and event_schema(name).fieldNames()[0] == "trace_id"
    with pytest.raises(KeyError):
        canonical_event_class("bogus")


def test_filters():
    assert filters.parse_cpu_filter("18-20, 4") == [4, 18, 19, 20] and filters.parse_cpu_filter(" ") is None
    assert filters.parse_flow_selector("1.2.3.4:5 -> [fe80::1]:9/TCP") == {"src": "1.2.3.4", "src_port": 5, "dst": "fe80::1", "dst_port": 9, "proto": "tcp"}
    assert filters.parse_flow_selector("10.0.0.1:1 <-> 10.0.0.2:2/tcp") == {"src": "10.0.0.1", "src_port": 1, "dst": "10.0.0.2", "dst_port": 2, "proto": "tcp"}
    assert filters.parse_flow_selector("fe80::1 <- :443")["src"] == "fe80::1" and filters.parse_flow_selector("x") is None
    assert filters.parse_flow_selector("a:1-b:2")["dst_port"] == 2 and filters.parse_flow_selector("a:1 b")["dst"] == "b"
    assert filters.module_set(instead=["x", " "]) == {"x"} and "ndis.sys" in filters.module_set(extra=["y"]) >= {"y"}


def test_several_modules(spark):
    df = spark.createDataFrame([("a.SYS",), ("b.sys",), (None,)], "module string")
    kept = lambda names: sorted(r[0] for r in df.where(filters.matches_module(F.col("module"), names)).collect())
    assert kept({"a.sys", "zz"}) == ["a.SYS"] and kept([]) == [] and kept("a.sys|B") == ["a.SYS", "b.sys"]


def test_store_round_trip(spark, tmp_path):
    root = str(tmp_path / "store")
    raw = spark.createDataFrame([(i, 1000 + i * 10, i % 4, 1, 2, 3, i, 1) for i in range(100)], "EventSequence long, TimeStampQpc long, CPU int, ProcessId long, ThreadId long, PayloadThreadId long, InstructionPointer long, Weight long")
    rows = normalise.normalise(raw, "SampledProfile").withColumn("trace_id", F.lit("a"))
    store.write_events(rows, root, "SampledProfile")
    assert store.validate(spark, root, "sampled_profile").count() == 0
    # frequency 1 MHz: microseconds since tick 1000
    got = store.scan(spark, root, "sampled_profile", timebase=(1000, 1_000_000), start_time=0.0001, end_time=0.0002, columns=["seq"])
    assert sorted((r.seq, r.ts_us) for r in got.collect()) == [(i, i * 10) for i in range(10, 21)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(qpc,1100)" in plan
    meta = spark.createDataFrame([("a", 1000, 1_000_000)], "trace_id string, origin long, freq long")
    assert store.scan(spark, root, "sampled_profile", meta=meta, start_time=0.0001, end_time=0.0002).count() == 11
    assert store.open_events(spark, "cswitch", root=root).count() == 0
    assert store.open_events(spark, "cswitch", tables={"CSwitch": rows}).count() == 100
    assert store.open_events(spark, "cswitch", tables={"CSwitch": rows}, columns=["seq"], include_time=False).columns == ["seq"]
    store.write_events(rows, root, "SampledProfile")
    assert store.validate(spark, root, "sampled_profile").count() == 0 and store.scan(spark, root, "sampled_profile").count() == 200
    store.write_events(rows, root, "SampledProfile", mode="overwrite")
    assert store.scan(spark, root, "sampled_profile").count() == 100
    assert [tuple(r)[:2] + tuple(r)[3:] for r in store.stored_traces(spark, root).collect()] == [("a", "sampled_profile", 100, 1000, 1990)]
    listed = store.list_traces(spark, root + "/sampled_profile/*", "*.parquet").collect()
    assert listed and all(r.trace_id.startswith("trace_") and r.bytes > 0 for r in listed)


def test_zones_choose_files(spark, tmp_path):
    root = str(tmp_path / "store")
    # trace b runs a day later on its own clock
    rows = spark.range(4000).select(F.when(F.col("id") % 4 == 0, "b").otherwise("a").alias("trace_id"), F.col("id").alias("seq"), (F.col("id") * 10 + F.when(F.col("id") % 4 == 0, 10**9).otherwise(0)).alias("qpc"), F.lit(1).alias("cpu"))
    zones = store.write_events(rows, root, "cswitch", file_bytes=4000)
    assert zones.select("file").distinct().count() > 5
    meta = spark.createDataFrame([("a", 0, 1000), ("b", 10**9, 1000)], "trace_id string, origin long, freq long")
    got = store.scan(spark, root, "cswitch", meta=meta, start_time=10.0, end_time=11.0, columns=["trace_id", "seq"])
    assert sorted(r.seq for r in got.collect()) == list(range(1000, 1101))
    assert 0 < len(got.inputFiles()) < zones.select("file").distinct().count() / 2
    one = store.scan(spark, root, "cswitch", meta=meta, start_time=10.0, end_time=11.0, traces=["b"])
    assert one.count() == 26 and len(one.inputFiles()) < len(got.inputFiles())
    assert store.scan(spark, root, "cswitch", meta=meta, start_time=500.0).count() == 0
    assert "GreaterThanOrEqual(qpc,1000010000)" in one._jdf.queryExecution().executedPlan().toString()


def test_damaged_missing_and_stray_files_are_reported(spark, tmp_path):
    import glob
    import os

    root = str(tmp_path / "store")
    rows = spark.range(5000).select(F.lit("a").alias("trace_id"), F.col("id").alias("seq"), F.col("id").alias("qpc"))
    store.write_events(rows, root, "cswitch", file_bytes=8000)
    data = sorted(glob.glob(root + "/cswitch/*/*.parquet"))
    assert len(data) > 3

    def problems():
        spark.catalog.refreshByPath(root)
        return sorted((r.problem, r.detail.split("/")[-1]) for r in store.validate(spark, root, "cswitch").collect())

    assert problems() == []
    with open(data[0], "r+b") as f:
        f.truncate(20)
    os.remove(data[1])
    with open(data[2], "rb") as f, open(os.path.dirname(data[2]) + "/stray.parquet", "wb") as g:
        g.write(f.read())
    with open(data[2], "rb") as f, open(data[3], "wb") as g:
        g.write(f.read())
    for crc in glob.glob(root + "/cswitch/*/.*.crc"):
        os.remove(crc)
    name = os.path.basename
    assert problems() == sorted([
        ("missing or damaged file", name(data[0])), ("missing or damaged file", name(data[1])), ("stray file", "stray.parquet"), ("rows or ticks", name(data[3]))])


def test_text_files(spark, tmp_path):
    path = tmp_path / "events.txt"
    path.write_text(
        "TcpIp/Recv, TimeStamp, Process Name ( PID), ThreadID, CPU\n"
        'TcpIp/Recv, 100, "svc.exe" ( 12), 7, 3, 1460, 10.0.0.1, 10.0.0.2, 80, 5000, 77, 9\n'
        "TcpIp_Recv, 200, svc.exe ( 12), bad, x, 10\nSampledProfileNmi, 5, a ( 1), 1, 0, 0, x, y!z, 1\nnoise\n"
    )
    rows = text_events.parse_events(text_events.read_lines(spark, str(path), "t"), ["TcpIp/Recv"])["tcpip_recv"].orderBy("ts_us").collect()
    assert [(r.ts_us, r.pid, r.tid, r.cpu, r.local_addr, r.remote_port, r.size, r.conn_id) for r in rows] == [
        (100, 12, 7, 3, "10.0.0.1", 5000, 1460, 9), (200, 12, -1, -1, "", 0, 10, 0)]
    pool = tmp_path / "pool.txt"
    pool.write_text("Paged Pool:\nImage, Tag\nndis.sys, NDnd, 5, 6.5, 1, 0.5\nNX Non-Paged Pool\nx.sys, T, 1, 1, 1, 1\nbad, T, x, 1, 1, 1\n")
    got = text_reports.pool_text(text_reports.read_ordered_lines(spark, str(pool)))
    assert sorted((r.pool_type, r.module, r.allocs) for r in got.collect()) == [("NX NonPaged", "x.sys", 1), ("Paged", "ndis.sys", 5)]


def test_loose_csv_and_export(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿Name,Count,Unnamed: 2\na,"1,234",\nb,5,\nc,n/a,\n')
    df = text_reports.load_csv(spark, str(path))
    assert df.columns == ["Name", "Count"] and dict(df.dtypes)["Count"] == "double"
    assert [r.Count for r in df.orderBy("Name").collect()] == [1234.0, 5.0, None]
    export.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 3
    export.write_report(df.withColumnRenamed("Name", "trace_id"), str(tmp_path / "report"))
    assert (tmp_path / "report" / "trace_id=a").exists()


def test_symbol_verdicts(spark):
    rows = [("ok", "pdb", "f", 95), ("ok", "export", "g", 5), ("ex", "export", "f", 1), ("mm", "mismatched", "f", 1), ("pre", "unknown", "f", 1), ("none", "unknown", "", 1), ("mix", "pdb", "f", 5), ("mix", "export", "f", 5)]
    df = spark.createDataFrame([("t", *r) for r in rows], "trace_id string, module string, symbol_source string, function string, weight long")
    assert {r.module: r.status for r in report.symbol_quality(df).collect()} == {
        "ok": "OK", "ex": "EXPORT_ONLY", "mm": "MISMATCHED_PDB", "pre": "PRE_RESOLVED", "none": "MISSING", "mix": "PARTIAL"}


def test_interrupt_histogram_has_totals(spark):
    df = spark.createDataFrame([("t", "a", 0.5), ("t", "b", 100.0)], "trace_id string, module string, duration_us double")
    found = {(r.module, r.low_us): r.events for r in interrupts.duration_histogram(df).collect()}
    assert found == {("a", 0): 1, ("b", 64): 1, ("(all)", 0): 1, ("(all)", 64): 1}


def test_fnv(spark):
    def fnv(data):
        h = 2166136261
        for b in data:
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h

    cases = {"deadbeef": bytes.fromhex("deadbeef"), "0xCAFE-BABE": bytes.fromhex("cafebabe"), "xyz": b"xyz", "abc": b"abc"}
    rows = spark.createDataFrame([(c,) for c in cases], "c string").select("c", ids.fnv1a_32(ids.cid_bytes(F.col("c"))).alias("h")).collect()
    assert {r.c: r.h for r in rows} == {c: fnv(b) for c, b in cases.items()}


def test_call_chain_walks_over_all_frame_names(spark, tmp_path):
    from tracelake.workload.catalogue import QUERIES

    write = lambda rows, columns, name: spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/{name}.parquet")
    write([(i, i, f"{'bolt' if i == 1 else 'gear'} {i}", "Brand#1") for i in range(1, 10)], "i int, p_partkey long, p_name string, p_brand string", "part")
    write([(3, i, i, 1.0, 1.0) for i in range(1, 10)], "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double", "lineitem")
    sample = spark.sql("SELECT 0L AS event_id, timestamp_micros(1704067201000000) AS ts, 1L AS user_id, 'view' AS event_type, 1.0D AS value, '{\"k\": 1}' AS props")
    sample.write.parquet(f"{tmp_path}/events.parquet")
    rows = QUERIES["call_chain"](spark, str(tmp_path)).orderBy("depth").collect()
    assert [r["function"] for r in rows] == ["bolt_1", *(f"gear_{i}" for i in range(2, 10))]
    assert [r["depth"] for r in rows] == list(range(9)) and {r["chain_hits"] for r in rows} == {4}


def test_debug_identity_is_not_broadcast(spark):
    image = spark.createDataFrame(
        [("t", 1, 10, 100, None), ("t", 2, 11, 100, None), ("t", 3, 10, 200, "own"), ("t", 4, None, 300, "")],
        "trace_id string, seq long, pid long, image_base long, pdb_guid string",
    ).withColumns({"pdb_age": F.lit(None).cast("bigint"), "pdb_name": F.lit(None).cast("string")})
    rsds = spark.createDataFrame(
        [("t", 2, 2, 10, 100, "late"), ("t", 1, 2, 10, 100, "exact"), ("t", 3, 1, 12, 100, "loose"), ("t", 4, 1, 10, 200, "other")],
        "trace_id string, seq long, qpc long, pid long, image_base long, pdb_guid string",
    ).withColumns({"pdb_age": F.lit(1).cast("bigint"), "pdb_name": F.lit("n")})
    found = attribution.with_debug_identity(image, rsds)
    assert {r.seq: r.pdb_guid for r in found.collect()} == {1: "exact", 2: "loose", 3: "own", 4: ""}
    # bytes of well packed files say little about rows: no plan may put those into the driver
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_waits_beyond_a_bigint(spark):
    # three requests wait for 4e18 us each
    long = 4_000_000_000_000_000_000
    deliver = spark.createDataFrame([("t", i, i, i + 1, 7) for i in range(3)] + [("t", long, 3, 4, 7)], "trace_id string, ts_us long, seq long, request_id long, url_group_id long")
    send = spark.createDataFrame([], "trace_id string, ts_us long, seq long, request_id long, status_code long, content_length long")
    close = spark.createDataFrame([("t", long + 1, 0, 1)], "trace_id string, ts_us long, seq long, request_id long")
    depth = one(app.queue_depth(deliver, send, close, slice_us=long))
    assert (depth.peak_depth, depth.deliveries, depth.completions) == (4, 4, 1)
    assert depth.avg_depth == pytest.approx(3)


def test_stack_weights_per_function_carry_no_stacks(spark, monkeypatch):
    names = spark.createDataFrame(
        [("t", 1, "m", "A"), ("t", 2, "m", "A"), ("t", 3, "m", "B"), ("t", 3, "m", "A"), ("t", 4, "<unknown>", ""), ("t", 5, None, "C"), ("u", 1, "m", "A")],
        "trace_id string, address long, module string, function string")
    samples = spark.createDataFrame(
        [("t", 1, [1, 2, 1]), ("t", 2, [3, 1]), ("t", 4, [4, 9, 8]), ("t", 8, [5, 5]), ("t", 1, [1, 2, 1]), ("u", 3, [1, 7]), ("u", 5, []), (None, 9, [1])],
        "trace_id string, weight long, stack array<long>")
    plans = []
    read = stacks.durable
    monkeypatch.setattr(stacks, "durable", lambda df: plans.append(df) or read(df))
    found = stacks.stack_weights(samples, names, distinct="function")
    rows = {(r.trace_id, r.module, r.function): (r.inclusive, r.exclusive) for r in found.collect()}
    assert rows == {
        ("t", "m", "A"): (4, 4), ("t", "m", "B"): (2, 2), ("t", "<unknown>", ""): (4, 4), ("t", "<unknown>", "C"): (8, 8),
        ("u", "m", "A"): (3, 3), ("u", "<unknown>", ""): (3, 0),
    }
    # beyond the stacks themselves, no step sends arrays of addresses: they are summed once and read twice
    assert "stack" in plans[0].columns
    shuffled = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line or "Join " in line]
    assert shuffled and not any(re.search(r"\bstack#", line.split("], [")[0]) for line in shuffled)
