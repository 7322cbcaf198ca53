"""Sliced sequences, exact quantiles, pairing and journeys against plain loops."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.operators import packets
from tracelake.operators.packets import _follow, pair_sends_with_receipts
from tracelake.plans import replay, scan
from tracelake.plans.quantiles import exact_quantiles, log_bin
from tracelake.plans.ranges import containing_interval
from tracelake.plans.replay import settle
from tracelake.plans.sequence import with_neighbours, with_running


def sequence_rows(seed, n=300):
    rng = random.Random(seed)
    # one key holds a third of the rows
    return [
        ("t", rng.choice([0, 0, 0, 1, 2, 3, 4]), rng.randrange(0, 5000), i, rng.choice([1, 1, -1]))
        for i in range(n)
    ]


@pytest.mark.parametrize("slice_us", [7, 100, 100_000])
def test_neighbours_cross_slices(spark, slice_us):
    rows = sequence_rows(1)
    df = spark.createDataFrame(rows, "trace_id string, k int, ts_us long, seq long, step int")
    got = with_neighbours(
        df, ["trace_id", "k"], ["ts_us", "seq"], previous={"p": "seq"}, following={"n": "seq"}, slice_us=slice_us
    )
    found = {r.seq: (r.p, r.n) for r in got.collect()}
    for key in range(5):
        order = [r[3] for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[3]))]
        for i, seq in enumerate(order):
            assert found[seq] == (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None)


@pytest.mark.parametrize("slice_us", [7, 100, 100_000])
def test_running_sums_and_floor(spark, slice_us):
    rows = sequence_rows(2)
    df = spark.createDataFrame(rows, "trace_id string, k int, ts_us long, seq long, step int")
    got = with_running(
        df, ["trace_id", "k"], ["ts_us", "seq"], {"total": "step"}, floor_at_zero={"depth": "step"}, slice_us=slice_us
    )
    found = {r.seq: (r.total, r.depth) for r in got.collect()}
    for key in range(5):
        total = depth = 0
        for r in sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[3])):
            total += r[4]
            depth = max(0, depth + r[4])
            assert found[r[3]] == (total, depth)


def test_log_bin_is_monotone(spark):
    values = sorted([-1e9, -5.0, -1.0, -0.5, 0.0, 0.25, 1.0, 2.0, 3.0, 1000.0, 1001.0, 1e6, 1e12, 1e15])
    bins = [r.b for r in spark.createDataFrame([(v,) for v in values], "v double").select(log_bin(F.col("v")).alias("b")).collect()]
    assert bins == sorted(bins)


def test_exact_quantiles_kinds(spark):
    rng = np.random.default_rng(3)
    rows = [("a", float(v)) for v in rng.integers(0, 5000, 801)] + [("b", float(v)) for v in rng.normal(0, 50, 400)]
    rows += [(None, 4.0), (None, 9.0), ("a", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    qs = {"q1": 0.1, "q5": 0.5, "q99": 0.99}
    linear = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs, count="n", minimum="lo", maximum="hi", mean="m").collect()}
    nearest = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs, kind="nearest").collect()}
    index = {r.k: r for r in exact_quantiles(df, ["k"], "v", qs, kind="index").collect()}
    for key in ("a", "b", None):
        values = sorted(v for k, v in rows if k == key and v is not None)
        n = len(values)
        assert linear[key].n == n and linear[key].lo == values[0] and linear[key].hi == values[-1]
        assert linear[key].m == pytest.approx(sum(values) / n)
        for name, q in qs.items():
            assert linear[key][name] == pytest.approx(np.quantile(values, q))
            assert nearest[key][name] == values[max(int(np.ceil(q * n)), 1) - 1]
            assert index[key][name] == values[int(round(q * (n - 1)))]


def test_interval_join_matches_loop(spark):
    rng = random.Random(5)
    images = [("t", rng.randrange(0, 2**24), rng.randrange(1, 2**22), f"m{i}") for i in range(40)]
    points = [("t", rng.randrange(0, 2**25)) for _ in range(500)]
    got = containing_interval(
        spark.createDataFrame(points, "trace_id string, a long").distinct(),
        spark.createDataFrame(images, "trace_id string, base long, size long, module string"),
        ["trace_id"], point="a", start="base", length="size", payload=["module"],
    )
    found = {r.a: r.module for r in got.collect()}
    for _, a in points:
        inside = [i for i in images if i[1] <= a < i[1] + i[2]]
        assert found[a] == (max(inside, key=lambda i: (i[1], i[3]))[3] if inside else None)


def test_damaged_intervals_are_an_error(spark):
    points = spark.createDataFrame([("t", 5)], "trace_id string, a long")
    images = spark.createDataFrame([("t", 0, 1 << 50, "x")], "trace_id string, base long, size long, module string")
    with pytest.raises(Exception, match="is 1125899906842624 long"):
        containing_interval(points, images, ["trace_id"], point="a", start="base", length="size", payload=["module"]).collect()


def fifo(rows, window):
    """The pairing rule as a loop."""
    pairs, pending = [], {}
    for _, key, ts, seq, way in sorted(rows, key=lambda r: (r[2], r[3])):
        queue = pending.setdefault(key, [])
        if way == "Send":
            queue.append((ts, seq))
            continue
        while queue and ts - queue[0][0] > window:
            queue.pop(0)
        if queue:
            sent = queue.pop(0)
            pairs.append((sent[1], seq, ts - sent[0]))
    return sorted(pairs)


@pytest.mark.parametrize("block", [2, 5, 1024])
def test_states_before_match_a_loop(spark, block):
    rng = random.Random(block)
    rows, found = [], {}
    for key in "abc":
        state = 0
        for at in sorted(rng.sample(range(-40, 60), 37)):
            k, low = rng.randrange(-3, 5), rng.choice([None, rng.randrange(-5, 20)])
            high = rng.choice([None, rng.randrange(low if low is not None else 0, 30)])
            rows.append((key, at, k, low, high))
            found[key, at] = state
            state = min(max(state + k, -1000 if low is None else low), 1000 if high is None else high)
    df = spark.createDataFrame(rows, "key string, at long, _k long, _low long, _high long")
    assert {(r.key, r["at"]): r._state for r in scan.states_before(df, ["key"], "at", block=block).collect()} == found


@pytest.mark.parametrize("seed,slice_us,block", [(1, 50, 3), (2, 60, 1024), (3, 1000, 1024), (4, 50, 16)])
def test_pairing_matches_fifo_loop(spark, seed, slice_us, block, monkeypatch):
    monkeypatch.setattr(scan, "BLOCK", block)
    rng = random.Random(seed)
    rows = [
        ("t", rng.choice("aaab"), rng.randrange(0, 4000), i, rng.choice(["Send", "Recv"])) for i in range(600)
    ]
    df = spark.createDataFrame(rows, "trace_id string, match string, ts_us long, seq long, direction string")
    got = pair_sends_with_receipts(df.withColumn("flow", F.col("match")), window_us=50, slice_us=slice_us)
    found = sorted((r.send_seq, r.recv_seq, r.latency_us) for r in got.collect())
    assert found == fifo(rows, 50)


def greedy(rows, window):
    """The journey rule as a loop over a list of open journeys."""
    found, active = {}, {}
    for _, way, key, ts, seq, index, *_ in rows:
        journeys = active.setdefault(key, [])
        fits = [j for j in journeys if index > j["index"] and ts - j["ts"] <= window]
        if fits:
            journey = max(fits, key=lambda j: (j["index"], j["ts"]))
        else:
            journey = {"id": seq}
            journeys.append(journey)
        journey.update(index=index, ts=ts)
        found[seq] = journey["id"]
        if index == 7:
            active[key] = [j for j in journeys if j is not journey]
    return found


@pytest.mark.parametrize("seed,slice_us,fan", [(1, 60, 2), (2, 200, 16), (3, 10_000, 16), (4, 51, 3)])
def test_settled_slices_match_one_pass(spark, seed, slice_us, fan, monkeypatch):
    monkeypatch.setattr(replay, "FAN", fan)
    rng = random.Random(seed)
    rows = sorted(
        [("t", "Send", rng.choice("aab"), rng.randrange(0, 3000), i, rng.randrange(0, 8), 1, 1, "f", "tcp") for i in range(400)],
        key=lambda r: (r[3], r[4]),
    )
    df = spark.createDataFrame(
        rows, "trace_id string, direction string, fingerprint string, ts_us long, seq long, path_index int, component int, edge int, flow string, proto string"
    )
    step = _follow(50, 7)
    values = ["ts_us", "seq", "path_index", "component", "edge", "flow", "proto"]
    got = settle(
        df, ["trace_id", "direction", "fingerprint"], ["ts_us", "seq"], step, values=values,
        output="ts_us bigint, seq bigint, path_index int, component int, edge int, flow string, proto string, journey bigint",
        tolerance_us=50, slice_us=slice_us,
    )
    found = {r.seq: r.journey for r in got.collect()}
    assert found == greedy(rows, 50)
    frame = pd.DataFrame(rows, columns=["trace_id", "direction", "fingerprint", *values])
    expected = {}
    for _, part in frame.groupby("fingerprint", sort=False):
        out, _ = step(None, {v: part[v].tolist() for v in values})
        expected.update(zip(out["seq"], out["journey"]))
    assert found == expected


@pytest.mark.parametrize("whole", [0, 150, 1 << 18])
def test_short_keys_pass_whole_and_long_ones_in_slices(spark, whole, monkeypatch):
    monkeypatch.setattr(replay, "WHOLE", whole)
    if whole > 400:
        # nothing is sliced, run again or joined for keys that a task can pass through
        monkeypatch.setattr(replay, "_agreed", None)
    rng = random.Random(whole)
    rows = sorted(
        [(rng.choice(["t", None]), "Send", rng.choice("aaab"), rng.randrange(0, 3000), i, rng.randrange(0, 8), 1, 1, "f", rng.choice(["tcp", None])) for i in range(400)],
        key=lambda r: (r[3], r[4]),
    )
    df = spark.createDataFrame(
        rows, "trace_id string, direction string, fingerprint string, ts_us long, seq long, path_index int, component int, edge int, flow string, proto string"
    )
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "7")  # keys go on from batch to batch
    try:
        got = settle(
            df, ["trace_id", "direction", "fingerprint"], ["ts_us", "seq"], _follow(50, 7),
            values=["ts_us", "seq", "path_index", "component", "edge", "flow", "proto"],
            output="ts_us bigint, seq bigint, path_index int, component int, edge int, flow string, proto string, journey bigint",
            tolerance_us=50, slice_us=60, reads=["ts_us", "seq", "path_index"],
        ).collect()
    finally:
        spark.conf.set(name, before)
    expected = {}
    for trace in ("t", None):
        expected |= greedy([r for r in rows if r[0] == trace], 50)
    assert {r.seq: r.journey for r in got} == expected
    assert sorted(((r.seq, str(r.trace_id), r.fingerprint, str(r.proto)) for r in got)) == sorted((r[4], str(r[0]), r[2], str(r[9])) for r in rows)


def test_hop_latency_reads_sightings_once(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["t", None]), "Send", "a", j, 100 * j + 10 * i, 8 * j + i, i, i, 1, "f", rng.choice(["tcp", "udp"])) for j in range(30) for i in range(8) if rng.random() < 0.9]
    sightings = spark.createDataFrame(
        rows, "trace_id string, direction string, fingerprint string, journey long, ts_us long, seq long, path_index int, component int, edge int, flow string, proto string")
    alone = packets.hop_latency(sightings)
    joined = packets.hop_latency(sightings, packets.journey_summary(sightings))
    assert sorted(map(tuple, alone.collect())) == sorted(map(tuple, joined.collect())) and alone.count() > 10
    assert alone._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") < joined._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD")
