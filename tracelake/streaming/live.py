"""Live forms of the operators on Structured Streaming.

Every function takes a streaming DataFrame with ``event_time`` (timestamp) beside the columns of
its batch form and returns a streaming DataFrame; ``delay`` is how late rows may come.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.classes import bucket_high, bucket_low, duration_bucket
from ..session import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Trace time zero as an event time. Rows at or before 1970 count as late from the start, so zero
# lies 1001 days later: a whole number of days, hours, minutes and of 1 to 16 seconds.
ZERO_US = 86_486_400_000_000


def with_event_time(df: DataFrame, ts: str = "ts_us") -> DataFrame:
    """Add ``event_time`` for a time in microseconds since the start of the trace."""
    return df.withColumn("event_time", F.timestamp_micros(F.col(ts) + ZERO_US))


def _start_us():
    return (F.unix_micros("window.start") - ZERO_US).alias("start_us")


def live_timeline(
    samples: DataFrame, *, bucket: str = "1 second", bucket_seconds: float = 1.0,
    sample_rate_hz: float = 1000, delay: str = "10 seconds",
) -> DataFrame:
    """Utilisation per tumbling bucket and CPU; buckets without samples have no row."""
    counts = samples.withWatermark("event_time", delay).groupBy(
        "trace_id", "cpu", F.window("event_time", bucket)
    ).agg(F.count(F.lit(1)).alias("samples"))
    util = F.least(F.col("samples") / F.lit(bucket_seconds * sample_rate_hz) * 100.0, F.lit(100.0))
    return counts.select(
        "trace_id", "cpu", _start_us(), "samples", F.round(util, 2).alias("util_pct")
    )


def live_traffic(
    packets: DataFrame, *, width: str = "10 seconds", slide: str = "1 second", seconds: float = 10.0,
    delay: str = "10 seconds", by: tuple[str, ...] = ("process_name", "pid", "kind"),
) -> DataFrame:
    """Packets, bytes and rates over a sliding window, per process and direction or per flow."""
    sums = packets.withWatermark("event_time", delay).groupBy(
        "trace_id", *by, F.window("event_time", width, slide)
    ).agg(F.count(F.lit(1)).alias("packets"), F.sum("size").alias("bytes"))
    return sums.select(
        "trace_id", *by, _start_us(), "packets", "bytes",
        (F.col("packets") / seconds).alias("pps"), (F.col("bytes") / seconds).alias("bytes_per_s"),
    )


def live_batches(recv: DataFrame, *, gap: str = "10 microseconds", delay: str = "10 seconds") -> DataFrame:
    """One row per completion batch: receive events of a socket and thread no further apart than
    the gap."""
    return recv.withWatermark("event_time", delay).groupBy(
        "trace_id", "socket_handle", "tid", F.session_window("event_time", gap)
    ).agg(F.count(F.lit(1)).alias("events"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")).drop("session_window")


def live_histogram(interrupts: DataFrame, *, width: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Interrupts per module and log-2 duration bucket over tumbling windows, for update mode."""
    bucket = duration_bucket(F.col("duration_us"))
    return interrupts.withWatermark("event_time", delay).groupBy(
        "trace_id", "module", bucket_low(bucket).alias("low_us"), bucket_high(bucket).alias("high_us"),
        F.window("event_time", width),
    ).agg(F.count(F.lit(1)).alias("events")).select(
        "trace_id", "module", "low_us", "high_us", _start_us(), "events"
    )


def live_drops(drops: DataFrame, *, width: str = "10 seconds", delay: str = "10 seconds") -> DataFrame:
    """Dropped packets and bytes per miniport and reason over tumbling windows."""
    return drops.withWatermark("event_time", delay).groupBy(
        "trace_id", "miniport", "reason", F.window("event_time", width)
    ).agg(F.count(F.lit(1)).alias("drops"), F.sum("size").alias("bytes")).select(
        "trace_id", "miniport", "reason", _start_us(), "drops", "bytes"
    )


def deduplicated(events: DataFrame, *, delay: str = "10 seconds") -> DataFrame:
    """Each event once, however often its producer sends it within the delay."""
    return events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["trace_id", "seq"])


class _InOrder(StatefulProcessor):
    """Holds rows of a key until the watermark has passed them, then works them off in order.

    State is what the watermark delay and the pairing window let in: rows not yet due, packed in pieces of at
    most ``PIECE`` rows that each came in one batch, in order, and openers not yet paired or expired. Each access
    to state costs as much as a thousand rows, so a batch writes few pieces and sets one timer per key, for its
    last row; a timer reads only the pieces that have due rows.
    """

    FIELDS = ("ts_us", "seq", "closes")
    OUT = ("opened_us", "closed_us", "opened_seq", "closed_seq")
    PIECE = 4096

    def __init__(self, window_us: int, shared_close: bool):
        self.window_us, self.shared_close = window_us, shared_close

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "first bigint, name string", "rows binary")
        self.open = handle.getListState("open", "ts_us bigint, seq bigint")

    def _hold(self, rows: list[tuple[int, int, bool]]) -> None:
        """Keep rows in order of time for later."""
        for i in range(0, len(rows), self.PIECE):
            piece = rows[i:i + self.PIECE]
            packed = array("q", [number for row in piece for number in row]).tobytes()
            self.waiting.updateValue((piece[0][0], uuid.uuid4().hex), (packed,))

    def _held(self, piece: tuple[int, str]) -> Iterator[tuple[int, int, bool]]:
        numbers = array("q")
        numbers.frombytes(bytes(self.waiting.getValue(piece)[0]))
        return ((ts, seq, bool(closes)) for ts, seq, closes in zip(numbers[0::3], numbers[1::3], numbers[2::3], strict=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        arrived = sorted(
            (int(t), int(s), bool(c)) for frame in rows for t, s, c in zip(*[frame[f].tolist() for f in self.FIELDS])
        )
        if arrived:
            self._hold(arrived)
            self.handle.registerTimer((arrived[-1][0] + ZERO_US) // 1000 + 1)
        return iter(())

    @staticmethod
    def _frame(columns: dict[str, list]) -> pd.DataFrame:
        return pd.DataFrame(columns, dtype="int64")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        limit = expiredTimerInfo.getExpiryTimeInMs() * 1000 - ZERO_US
        due = [tuple(k) for k in self.waiting.keys() if k[0] < limit]
        pending = [tuple(p) for p in self.open.get()] if due and self.open.exists() else []
        out = {n: [] for n in self.OUT}
        # openers come before closers at the same time only where one closer serves them all
        order = (lambda r: (r[0], r[2], r[1])) if self.shared_close else (lambda r: (r[0], r[1]))
        rows = []
        for piece in due:
            rows.extend(self._held(piece))
            self.waiting.removeKey(piece)
        self._hold(sorted(r for r in rows if r[0] >= limit))
        oldest = min((p[0] for p in pending), default=limit)
        for ts, seq, closes in sorted((r for r in rows if r[0] < limit), key=order):
            if ts - oldest > self.window_us:
                pending = [p for p in pending if ts - p[0] <= self.window_us]
                oldest = min((p[0] for p in pending), default=limit)
            if not closes:
                oldest = min(oldest, ts)
                pending.append((ts, seq))
                continue
            taken, pending = (pending, []) if self.shared_close else (pending[:1], pending[1:])
            for opened in taken:
                for name, value in zip(out, (opened[0], ts, opened[1], seq)):
                    out[name].append(value)
        if pending:
            self.open.put(pending)
        elif due:
            self.open.clear()
        if out["opened_us"]:
            yield self._frame(out)

    def close(self) -> None:
        pass


def _paired(rows: DataFrame, keys: list[str], window_us: int, shared_close: bool, delay: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    class Keyed(_InOrder):
        def _named(self, key, frames):
            for frame in frames:
                for i, (name, value) in enumerate(zip(keys, key)):
                    frame.insert(i, name, value)
                yield frame

        def handleInputRows(self, key, rows, timerValues):
            return self._named(key, super().handleInputRows(key, rows, timerValues))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            return self._named(key, super().handleExpiredTimer(key, timerValues, expiredTimerInfo))

    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", opened_us bigint, closed_us bigint, opened_seq bigint, closed_seq bigint"
    return rows.withWatermark("event_time", delay).groupBy(*keys).transformWithStateInPandas(
        Keyed(window_us, shared_close), schema, "Append", "EventTime"
    )


def live_send_recv(packets: DataFrame, *, window_us: int = 10_000, delay: str = "1 second") -> DataFrame:
    """First-in first-out send and receive pairs per ``match`` key (see ``operators.packets``)."""
    rows = packets.where(F.col("match").isNotNull() & F.lower("direction").isin("send", "recv")).select(
        "trace_id", "match", "event_time", "ts_us", "seq", (F.lower("direction") == "recv").alias("closes")
    )
    pairs = _paired(rows, ["trace_id", "match"], window_us, False, delay)
    return pairs.withColumn("latency_us", F.col("closed_us") - F.col("opened_us"))


def live_ready_waits(
    ready: DataFrame, switches: DataFrame, *, window_us: int = 1_000_000, delay: str = "2 seconds"
) -> DataFrame:
    """Wake-ups with the next switch to their thread (see ``operators.sched``)."""
    woken = ready.select("trace_id", F.coalesce("readied_tid", "tid").alias("tid"), "event_time", "ts_us", "seq", F.lit(False).alias("closes"))
    ran = switches.select("trace_id", F.col("new_tid").alias("tid"), "event_time", "ts_us", "seq", F.lit(True).alias("closes"))
    pairs = _paired(woken.unionByName(ran), ["trace_id", "tid"], window_us, True, delay)
    return pairs.withColumn("wait_us", F.col("closed_us") - F.col("opened_us"))


def ready_wait_candidates(
    ready: DataFrame, switches: DataFrame, *, window: str = "1 second", delay: str = "2 seconds"
) -> DataFrame:
    """Stream-stream interval join: every switch to a woken thread within the window."""
    r = ready.withWatermark("event_time", delay).select(
        "trace_id", F.coalesce("readied_tid", "tid").alias("tid"), F.col("event_time").alias("ready_time"), F.col("seq").alias("ready_seq")
    )
    s = switches.withWatermark("event_time", delay).select(
        F.col("trace_id").alias("_t"), F.col("new_tid"), F.col("event_time").alias("switch_time"), F.col("seq").alias("switch_seq")
    )
    return r.join(s, F.expr(
        f"trace_id = _t AND tid = new_tid AND switch_time >= ready_time AND switch_time <= ready_time + INTERVAL {window}"
    )).drop("_t", "new_tid")


@contextmanager
def state_store(spark: SparkSession, provider: str = ROCKSDB) -> Iterator[None]:
    """Streams that start inside keep their state in ``provider``; pairing needs RocksDB."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, provider)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def write_batch(table: str, mode: str):
    """A sink that may see a batch again: a batch has a folder of its own, which a replay replaces.

    Results of ``complete`` mode replace all earlier ones.
    """

    def write(batch: DataFrame, number: int) -> None:
        target = table if mode == "complete" else f"{table}/_batch={number}"
        batch.write.mode("overwrite").parquet(target)

    return write


def run_available(stream: DataFrame, *, mode: str = "append", keys: tuple[str, ...] = (), pairs: bool = False) -> DataFrame:
    """Run a stream over the data there is and read back what it wrote.

    ``append`` rows are final. Of ``update`` results the last one per ``keys`` counts. ``pairs`` is for
    the pairing operators, whose state is in RocksDB.
    """
    spark: SparkSession = stream.sparkSession
    root = scratch(spark, "streams")
    table = f"{root}/table"
    with state_store(spark) if pairs else nullcontext():
        query = (
            stream.writeStream.outputMode(mode).foreachBatch(write_batch(table, mode))
            .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
        )
    query.awaitTermination()
    batch = [] if mode == "complete" else [T.StructField("_batch", T.LongType())]
    rows = spark.read.schema(T.StructType([*stream.schema.fields, *batch])).parquet(table)
    if mode != "update":
        return rows.select(*stream.columns)
    if not keys:
        raise ValueError("update results need the keys that an update replaces")
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("_last"))
    return last.select(*keys, "_last.*").select(*stream.columns)
