"""Live pairing agrees with the batch operators."""

import random
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tracelake.operators.packets import pair_sends_with_receipts
from tracelake.operators.sched import ready_to_switch
from tracelake.streaming import live

SECOND = 1_000_000


def stream_of(spark, folder, df, last=None):
    # several files, so that several micro-batches are run
    df.repartition(3).write.mode("overwrite").parquet(folder)
    if last is not None:
        # a stranger that comes last pushes the watermark past every row
        time.sleep(1.1)
        last.write.mode("append").parquet(folder)
    return live.with_event_time(
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    )


def test_live_pairs_match_batch(spark, tmp_path):
    rng = random.Random(4)
    rows = [("t", rng.choice("ab"), rng.randrange(0, 2 * SECOND), i, rng.choice(["Send", "Recv"])) for i in range(120)]
    schema = "trace_id string, match string, ts_us long, seq long, direction string"
    df = spark.createDataFrame(rows, schema)
    flush = spark.createDataFrame([("z", "z", 10_000 * SECOND, 9999, "Send")], schema)
    stream = stream_of(spark, str(tmp_path / "p"), df, flush)
    got = live.run_available(live.live_send_recv(stream, window_us=50_000, delay="2000 seconds"), pairs=True)
    found = sorted((r.opened_seq, r.closed_seq, r.latency_us) for r in got.collect())
    batch = pair_sends_with_receipts(df.withColumn("flow", F.col("match")), window_us=50_000)
    assert found == sorted((r.send_seq, r.recv_seq, r.latency_us) for r in batch.collect())
    assert found


def test_live_waits_match_batch(spark, tmp_path):
    rng = random.Random(5)
    schema = "trace_id string, tid long, ts_us long, seq long, is_ready boolean"
    rows = [("t", rng.randrange(1, 4), rng.randrange(0, 3 * SECOND), i, rng.random() < 0.5) for i in range(100)]
    df = spark.createDataFrame(rows, schema)
    stream = stream_of(spark, str(tmp_path / "w"), df, spark.createDataFrame([("z", 9, 10_000 * SECOND, 9999, True)], schema))
    ready = stream.where("is_ready").withColumn("readied_tid", F.col("tid"))
    switches = stream.where("NOT is_ready").withColumn("new_tid", F.col("tid"))
    got = live.run_available(live.live_ready_waits(ready, switches, window_us=100_000, delay="4000 seconds"), pairs=True)
    found = sorted((r.opened_seq, r.closed_seq, r.wait_us) for r in got.collect())
    r = df.where("is_ready").select("trace_id", "ts_us", "seq", F.lit(0).alias("cpu"), "tid", F.col("tid").alias("readied_tid"))
    s = df.where("NOT is_ready").select("trace_id", "ts_us", "seq", F.lit(0).alias("cpu"), F.col("tid").alias("new_tid"), F.lit(0).alias("old_tid"))
    batch = ready_to_switch(r, s, max_window_us=100_000)
    assert found == sorted((x.ready_seq, x.switch_seq, x.wait_us) for x in batch.collect())
    assert found


def test_candidates_hold_every_switch_in_window(spark, tmp_path):
    schema = "trace_id string, tid long, ts_us long, seq long, is_ready boolean"
    rows = [("t", 1, 0, 0, True), ("t", 1, SECOND // 2, 1, False), ("t", 1, SECOND, 2, False), ("t", 1, SECOND + 1, 3, False)]
    df = spark.createDataFrame(rows, schema)
    stream = stream_of(spark, str(tmp_path / "c"), df)
    got = live.run_available(live.ready_wait_candidates(
        stream.where("is_ready").withColumn("readied_tid", F.col("tid")),
        stream.where("NOT is_ready").withColumn("new_tid", F.col("tid")),
    ))
    assert sorted((r.ready_seq, r.switch_seq) for r in got.collect()) == [(0, 1), (0, 2)]


def test_batches_seen_again_count_once(spark, tmp_path):
    write = live.write_batch(str(tmp_path / "t"), "append")
    for number, rows in ((0, [1, 2]), (1, [3]), (0, [1, 2]), (1, [3])):
        write(spark.createDataFrame([(x,) for x in rows], "x long"), number)
    assert sorted(r.x for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 2, 3]


def test_state_store_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    with live.state_store(spark):
        assert spark.conf.get(name) == live.ROCKSDB
    assert spark.conf.get(name) == before


def test_updates_replace_earlier_ones(spark, tmp_path):
    schema = "trace_id string, module string, duration_us double, ts_us long"
    for part in ([("t", "a", 3.0, 0)], [("t", "a", 3.0, 1), ("t", "b", 3.0, 2)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "u"))
        time.sleep(1.1)
    stream = live.with_event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "u")))
    got = live.run_available(live.live_histogram(stream), mode="update", keys=("trace_id", "module", "low_us", "high_us", "start_us"))
    assert sorted((r.module, r.events) for r in got.collect()) == [("a", 2), ("b", 1)]


class _CountedState:
    """State of one key in memory; counts the accesses, each of which is a call to another process in a stream."""

    def __init__(self):
        self.map, self.list, self.accesses, self.timer = {}, [], 0, None

    def getMapState(self, *_):
        return self

    def getListState(self, *_):
        state = _CountedState()
        state.put = lambda rows: setattr(state, "list", list(rows))
        state.get, state.exists, state.clear = lambda: iter(state.list), lambda: bool(state.list), state.list.clear
        return state

    def registerTimer(self, at):
        self.timer = at

    def keys(self):
        return list(self.map)

    def containsKey(self, key):
        self.accesses += 1
        return key in self.map

    def getValue(self, key):
        self.accesses += 1
        return self.map[key]

    def updateValue(self, key, value):
        self.accesses += 1
        self.map[key] = value

    def removeKey(self, key):
        self.accesses += 1
        del self.map[key]


@pytest.mark.parametrize("piece", [7, 4096])
def test_pairing_takes_few_accesses_to_state(piece, monkeypatch):
    monkeypatch.setattr(live._InOrder, "PIECE", piece, raising=False)
    rng = random.Random(piece)
    rows = [(rng.randrange(0, 2000) * 100, i, rng.random() < 0.4) for i in range(600)]
    state, found = _CountedState(), []
    worker = live._InOrder(500, True)
    worker.init(state)
    frame = lambda part: iter([pd.DataFrame([r for r in part], columns=list(live._InOrder.FIELDS))])
    expiry = lambda us: type("E", (), {"getExpiryTimeInMs": lambda _: (us + live.ZERO_US) // 1000})()
    for part, until in ((rows[:300], 60_000), (rows[300:], 120_000), ([], 300_000)):
        # rows that the watermark has passed do not arrive
        part = [r for r in part if r[0] >= (60_000 if part and part[0][1] else 0)]
        list(worker.handleInputRows(("t",), frame(part), None))
        for out in worker.handleExpiredTimer(("t",), None, expiry(until)):
            found += list(zip(out["opened_seq"], out["closed_seq"]))
    kept = rows[:300] + [r for r in rows[300:] if r[0] >= 60_000]
    want, pending = [], []
    for ts, seq, closes in sorted(kept, key=lambda r: (r[0], r[2], r[1])):
        pending = [p for p in pending if ts - p[0] <= 500]
        if closes:
            want += [(p[1], seq) for p in pending]
            pending = []
        else:
            pending.append((ts, seq))
    assert sorted(found) == sorted(want) and len(found) > 50
    if piece > 600:
        assert state.accesses < 20  # 600 rows lie in some 300 stretches of a window
