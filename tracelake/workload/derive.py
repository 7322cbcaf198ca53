"""Event tables derived from the driver tables by plain projections.

Each derivation is one SELECT that Spark and the checking database both run; ``@us(x)`` is
microseconds since 1970, ``@div(a, b)`` whole division and ``@each(a, b)`` one row per value. The few tables that need an
ordered step are built with the sliced plans in Spark and with window functions in the check. All rows
of a table are used: records without a partner have a key that is shifted, none are left out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.sequence import with_neighbours
from ..session import durable

DAY = 86_400_000_000
START = 1_704_067_200_000_000  # 2024-01-01, before the first event
EPOCH_95 = 788_918_400_000_000  # 1995-01-01, before the first order
SOURCES = ("events", "orders", "lineitem", "part", "customer", "supplier", "nation")

DERIVED: dict[str, str] = {
    # one row per event, in three traces of eight CPUs
    "base": f"""
        SELECT concat('t', event_id % 3) AS trace_id, event_id AS seq,
               @us(ts) - {START} AS ts_us, (@us(ts) - {START}) * 10 + 5000 AS qpc,
               CAST(@div(event_id, 3) % 8 AS INT) AS cpu, user_id % 16 + 1 AS pid, user_id + 1 AS tid,
               event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k
        FROM events""",
    "meta": """
        SELECT trace_id, CAST(5000 AS BIGINT) AS origin, CAST(10000000 AS BIGINT) AS freq,
               CAST(2592000.0 AS DOUBLE) AS duration_s, CAST(8 AS INT) AS cpu_count
        FROM base GROUP BY trace_id""",
    # samples: every fifth has no process id, some have no profile weight
    "samples": """
        SELECT trace_id, seq, ts_us, qpc, cpu,
               CASE WHEN seq % 5 = 0 THEN CAST(4294967295 AS BIGINT) ELSE pid END AS pid,
               tid, CASE WHEN seq % 2 = 0 THEN tid ELSE CAST(0 AS BIGINT) END AS payload_tid,
               k * 4096 + seq % 4096 AS address,
               CAST(ceil(value) AS BIGINT) AS weight,
               CASE WHEN event_type = 'view' THEN CAST(0 AS BIGINT) ELSE CAST(ceil(value * 2) AS BIGINT) END AS profile_weight
        FROM base""",
    "thread": """
        SELECT trace_id, seq, qpc, pid, CASE WHEN tid % 7 = 0 THEN tid + 1000000 ELSE tid END AS tid, 'Start' AS type FROM base""",
    "process": """
        SELECT trace_id, seq, qpc, CASE WHEN pid = 9 THEN pid + 1000 ELSE pid END AS pid, CAST(0 AS BIGINT) AS parent_pid,
               CASE WHEN event_type = 'signup' THEN concat('proc', pid, '-', seq % 4, '.exe') ELSE '' END AS image_file_name,
               concat('run ', k) AS command_line, 'Start' AS type
        FROM base WHERE event_type IN ('signup', 'purchase')""",
    "image": """
        SELECT @each('t0', 't1', 't2') AS trace_id, p_partkey AS seq, p_partkey AS qpc, p_partkey * 4096 + CASE WHEN p_partkey % 10 = 3 THEN 1000000000000 ELSE 0 END AS image_base,
               CAST(4096 AS BIGINT) AS image_size, p_partkey % 3 AS pid,
               concat('/drivers/', replace(p_name, ' ', '_'), '.sys') AS file_name,
               CASE WHEN p_partkey % 2 = 0 THEN 'Load' ELSE 'DCStart' END AS type,
               p_partkey * 7 AS time_date_stamp,
               CAST(NULL AS STRING) AS pdb_guid, CAST(NULL AS BIGINT) AS pdb_age, CAST(NULL AS STRING) AS pdb_name
        FROM part""",
    "module_parts": """
        SELECT concat(replace(p_name, ' ', '_'), '.sys') AS module, @each(0, 1, 2) AS i FROM part""",
    "symbols": """
        SELECT DISTINCT module, CAST(512 + i * 1024 AS BIGINT) AS start, CAST(CASE i WHEN 1 THEN 0 ELSE 512 END AS BIGINT) AS size, concat('fn', i) AS name,
               CASE i WHEN 0 THEN 'pdb' WHEN 1 THEN 'export' ELSE 'mismatched' END AS source
        FROM module_parts""",
    # labelled samples for the reports that start from names
    "labelled": """
        SELECT trace_id, seq, ts_us, cpu, concat('proc', pid) AS process_name, pid,
               CASE k % 8 WHEN 0 THEN 'tcpip.sys' WHEN 1 THEN 'ndis.sys' WHEN 2 THEN 'xdp.sys' WHEN 3 THEN 'afd.sys'
                    WHEN 4 THEN 'ntoskrnl.exe' WHEN 5 THEN 'app.exe' WHEN 6 THEN 'ws2_32.dll' ELSE 'other.dll' END AS module,
               CASE seq % 7 WHEN 0 THEN 'UdpReceive' WHEN 1 THEN 'KeAcquireSpinLock' WHEN 2 THEN 'NdisAllocateClone'
                    WHEN 3 THEN 'XdpInspect' WHEN 4 THEN '' WHEN 5 THEN 'Unknown' ELSE 'Work' END AS function,
               CASE k % 5 WHEN 0 THEN 'pdb' WHEN 1 THEN 'export' WHEN 2 THEN 'mismatched' ELSE 'unknown' END AS symbol_source,
               CAST(ceil(value) AS BIGINT) AS weight
        FROM base""",
    "sampling": """
        SELECT trace_id, process_name, pid, module, function, symbol_source, CAST(sum(weight) AS BIGINT) AS weight
        FROM labelled GROUP BY trace_id, process_name, pid, module, function, symbol_source""",
    "dpc": """
        SELECT trace_id, seq, qpc, ts_us, cpu, k * 4096 AS routine, CAST(floor(value) AS DOUBLE) AS duration_us,
               CASE k % 5 WHEN 0 THEN 'mlx5.sys' WHEN 1 THEN 'NDIS.SYS' WHEN 2 THEN 'tcpip.sys'
                    WHEN 3 THEN 'storport.sys' ELSE 'usbport.sys' END AS module
        FROM base WHERE event_type <> 'view'""",
    "ready": """
        SELECT trace_id, seq, ts_us, qpc, cpu, pid, tid, tid AS readied_tid,
               CASE k % 4 WHEN 0 THEN concat('ntos!KiWake / ntos!KeAcquireSpinLock / drv!Call', k % 3, ' / app!main')
                    WHEN 1 THEN concat('ntos!ExAcquireFastMutex / fs!Open', k % 5)
                    WHEN 2 THEN 'ntos!KeSetEvent / app!work' ELSE 'app!idle' END AS stack_text
        FROM base WHERE event_type = 'click'""",
    "switch_in": """
        SELECT trace_id, seq, ts_us, qpc, cpu, tid AS new_tid, pid AS new_pid, CAST(0 AS BIGINT) AS old_tid,
               CAST(0 AS BIGINT) AS old_pid, concat('proc', pid) AS new_process,
               CASE event_type WHEN 'error' THEN 'WrQueue' WHEN 'view' THEN '' ELSE 'UserRequest' END AS wait_reason
        FROM base WHERE event_type <> 'click'""",
    # call stacks: the parts of an order as frames
    "frames": """
        SELECT concat('t', l_orderkey % 3) AS trace_id, l_orderkey, l_linenumber, l_partkey,
               CAST(l_quantity AS BIGINT) AS q, l_extendedprice,
               l_partkey * 4096 AS address, l_orderkey % 10 + 1 AS weight
        FROM lineitem""",
    "frame_names": """
        SELECT @each('t0', 't1', 't2') AS trace_id, p_partkey * 4096 AS address, p_brand AS module,
               replace(p_name, ' ', '_') AS function
        FROM part""",
    # the same frames under six names only: walks over all of them end
    "few_names": """
        SELECT trace_id, address, 'core' AS module, concat('fn', @div(address, 4096) % 6) AS function
        FROM frame_names""",
    # network: order = connection, line item = packet
    "wire": f"""
        SELECT concat('n', l_orderkey % 2) AS trace_id,
               l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS seq,
               @us(l_shipdate) - {EPOCH_95} + l_linenumber * 1000 AS ts_us, CAST(l_partkey % 8 AS INT) AS cpu,
               concat('svc', o_custkey % 16 + 1) AS process_name, o_custkey % 16 + 1 AS pid, l_suppkey AS tid,
               concat('10.0.', @div(o_custkey, 250), '.', o_custkey % 250 + 1) AS local_addr,
               1024 + o_custkey % 1000 AS local_port,
               concat('192.168.0.', o_orderkey % 50 + 1) AS remote_addr, CAST(443 AS BIGINT) AS remote_port,
               CAST(l_quantity AS BIGINT) AS size, l_partkey AS seq_no, o_orderkey + 1 AS conn_id,
               CAST(l_linenumber AS BIGINT) AS n, l_returnflag AS flag, l_linestatus AS status, o_custkey, l_orderkey,
               l_partkey
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    # packets of line 7 lost their endpoints and process
    "wire_gaps": """
        SELECT trace_id, seq, ts_us, cpu, CASE WHEN n = 7 THEN '' ELSE process_name END AS process_name,
               CASE WHEN n = 7 THEN CAST(0 AS BIGINT) ELSE pid END AS pid, tid,
               CASE WHEN n = 7 THEN '' ELSE local_addr END AS local_addr,
               CASE WHEN n = 7 THEN CAST(0 AS BIGINT) ELSE local_port END AS local_port,
               CASE WHEN n = 7 THEN '' ELSE remote_addr END AS remote_addr,
               CASE WHEN n = 7 THEN CAST(0 AS BIGINT) ELSE remote_port END AS remote_port,
               size, seq_no, conn_id, n, flag, status
        FROM wire""",
    "connects": f"""
        SELECT concat('n', o_orderkey % 2) AS trace_id, o_orderkey AS seq, @us(o_orderdate) - {EPOCH_95} AS ts_us,
               CAST(o_orderkey % 8 AS INT) AS cpu,
               concat('svc', o_custkey % 16 + 1) AS process_name, o_custkey % 16 + 1 AS pid, o_custkey % 100 + 1 AS tid,
               concat('10.0.', @div(o_custkey, 250), '.', o_custkey % 250 + 1) AS local_addr,
               1024 + o_custkey % 1000 AS local_port,
               concat('192.168.0.', o_orderkey % 50 + 1) AS remote_addr, CAST(443 AS BIGINT) AS remote_port,
               o_orderkey + 1 + CASE WHEN o_orderkey % 11 = 0 THEN 1000000000 ELSE 0 END AS conn_id,
               o_orderkey + 1 + CASE WHEN o_orderkey % 11 = 0 THEN 1000000000 ELSE 0 END AS socket_handle, o_orderpriority AS priority,
               o_orderstatus AS status
        FROM orders""",
    "http_recv": f"""
        SELECT concat('h', o_orderkey % 2) AS trace_id, o_orderkey AS seq, @us(o_orderdate) - {EPOCH_95} AS ts_us,
               o_orderkey + 1 AS request_id, CASE WHEN o_orderstatus = 'P' THEN 'POST' ELSE 'GET' END AS verb,
               concat('/shop/', o_orderpriority, '/', o_custkey % 10) AS url
        FROM orders""",
    "http_deliver": f"""
        SELECT concat('h', o_orderkey % 2) AS trace_id, o_orderkey AS seq,
               @us(o_orderdate) - {EPOCH_95} + o_orderkey % 50 * 3600000000 AS ts_us,
               o_orderkey + 1 + CASE WHEN o_orderkey % 4 = 0 THEN 1000000000 ELSE 0 END AS request_id, o_custkey % 5 AS url_group_id
        FROM orders""",
    "http_send": f"""
        SELECT concat('h', l_orderkey % 2) AS trace_id,
               l_linenumber * 100000 + CAST(l_quantity AS BIGINT) AS seq,
               @us(l_shipdate) - {EPOCH_95} AS ts_us, l_orderkey + 1 AS request_id,
               CAST(200 + l_linenumber AS BIGINT) AS status_code, CAST(l_quantity AS BIGINT) AS content_length
        FROM lineitem WHERE l_linenumber <= 3""",
    "http_close": f"""
        SELECT concat('h', l_orderkey % 2) AS trace_id, l_partkey AS seq,
               @us(l_shipdate) - {EPOCH_95} + {DAY} AS ts_us, l_orderkey + 1 AS request_id
        FROM lineitem WHERE l_linenumber > 3""",
    "quic_created": """
        SELECT concat('q', c_custkey % 2) AS trace_id, c_custkey AS seq, CAST(1000 AS BIGINT) + c_custkey AS ts_us,
               c_custkey + 1 + CASE WHEN c_custkey % 13 = 0 THEN 1000000000 ELSE 0 END AS connection_id, concat('app', c_nationkey % 4) AS process_name,
               CASE WHEN c_custkey % 9 = 0 THEN '' ELSE substr(md5(c_name), 1, 16) END AS cid,
               concat('192.168.1.', c_custkey % 200) AS remote_addr, concat('10.1.1.', c_custkey % 100) AS local_addr
        FROM customer""",
    "quic_closed": """
        SELECT concat('q', c_custkey % 2) AS trace_id, c_custkey AS seq,
               CAST(5000 AS BIGINT) + c_custkey * 3 AS ts_us,
               c_custkey + 1 + CASE WHEN c_custkey % 4 = 0 THEN 2000000000 ELSE 0 END AS connection_id,
               concat('app', c_nationkey % 4) AS process_name
        FROM customer""",
    "quic_packets": """
        SELECT concat('q', o_custkey % 2) AS trace_id, seq, ts_us, cpu, o_custkey + 1 AS connection_id,
               n + 10 * (l_orderkey % 40) AS packet_number, size, flag, size * 1000 AS ack_delay
        FROM wire""",
    "pools": """
        SELECT concat('m', p_partkey % 2) AS trace_id,
               CASE p_size % 3 WHEN 0 THEN 'Paged' WHEN 1 THEN 'NonPaged' ELSE 'NX NonPaged' END AS pool_type,
               p_brand AS module, concat(substr(p_type, 1, 3), p_partkey) AS tag,
               count(*) AS allocs, CAST(sum(l_linenumber) AS DOUBLE) AS alloc_kb,
               CAST(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS BIGINT) AS outstanding,
               sum(l_quantity) AS outstanding_kb
        FROM part JOIN lineitem ON l_partkey = p_partkey
        GROUP BY p_partkey, p_size, p_brand, p_type""",
    "disk_io": """
        SELECT concat('d', l_orderkey % 2) AS trace_id, l_suppkey % 4 AS disk_number,
               CASE l_returnflag WHEN 'A' THEN 'Read' WHEN 'N' THEN 'DiskIo_Write' ELSE 'FlushBuffers' END AS kind,
               CAST(l_quantity AS BIGINT) AS transfer_size
        FROM lineitem""",
    "header": f"""
        SELECT concat('n', o_orderkey % 2) AS trace_id, o_orderkey AS seq, @us(o_orderdate) AS qpc,
               CASE WHEN o_orderkey % 3 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(10000000 AS BIGINT) END AS perf_freq,
               CAST(o_custkey % 64 AS INT) AS cpu_count, CAST(156250 AS INT) AS timer_resolution,
               CAST(1000000 AS BIGINT) AS start_time, CAST(1000000 AS BIGINT) + o_custkey * 10000000 AS end_time,
               CAST(1 AS BIGINT) AS boot_time, CAST(o_custkey % 4000 AS INT) AS cpu_mhz, CAST(8 AS INT) AS pointer_size,
               CAST(o_orderkey % 100 AS INT) AS buffers_written, CAST(o_orderkey % 5 AS INT) AS events_lost
        FROM orders""",
    # three days in four become the baseline and test traces
    "ab": f"""
        SELECT CASE WHEN @div(ts_us, {DAY}) % 2 = 0 THEN 'even' ELSE 'odd' END AS side, labelled.*
        FROM labelled""",
}

# Tables with an ordered step, as the check computes them.
ORDERED: dict[str, str] = {
    "cswitch": """
        SELECT trace_id, seq, ts_us, qpc, cpu, tid AS new_tid, pid AS new_pid, concat('proc', pid) AS new_process,
               coalesce(lag(tid) OVER w, 0) AS old_tid, coalesce(lag(pid) OVER w, 0) AS old_pid,
               concat('proc', coalesce(lag(pid) OVER w, 0)) AS old_process,
               CASE WHEN event_type = 'error' THEN 'Waiting' ELSE 'Ready' END AS old_state,
               CASE event_type WHEN 'error' THEN 'WrQueue' WHEN 'signup' THEN 'WrPreempted' WHEN 'view' THEN '' ELSE 'UserRequest' END AS wait_reason
        FROM base WINDOW w AS (PARTITION BY trace_id, cpu ORDER BY ts_us, seq)""",
    "stacks": """
        SELECT trace_id, l_orderkey, any_value(weight) AS weight,
               list(address ORDER BY l_linenumber, l_partkey, q, l_extendedprice) AS stack
        FROM frames GROUP BY trace_id, l_orderkey""",
}


def _expand(text: str, us: str, div: str, each: str) -> str:
    text = re.sub(r"@us\(([^()]*)\)", us, text)
    text = re.sub(r"@each\(([^()]*)\)", each, text)
    return re.sub(r"@div\(([^,()]*), ([^()]*)\)", div, text)


def spark_text(name: str) -> str:
    return _expand(DERIVED[name], r"unix_micros(CAST(\1 AS TIMESTAMP))", r"(\1 div \2)", r"explode(array(\1))")


def check_text(name: str) -> str:
    text = ORDERED.get(name) or DERIVED[name]
    return _expand(text, r"epoch_us(\1)", r"(\1 // \2)", r"unnest([\1])").replace("AS STRING", "AS VARCHAR")


def _needs(text: str) -> list[str]:
    names = [*DERIVED, *ORDERED]
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text, re.I)]


def with_tables(body: str) -> str:
    """Check SQL: ``body`` with the derived tables it reads put in front."""
    done: dict[str, str] = {}

    def add(text: str) -> None:
        for name in _needs(text):
            if name not in done:
                add(check_text(name))
                done.setdefault(name, check_text(name))

    add(body)
    if not done:
        return body
    ctes = ",\n".join(f"{name} AS ({text})" for name, text in done.items())
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


class Tables:
    """Derived event tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in ORDERED:
            return getattr(self, f"_{name}")()
        if name not in DERIVED:
            return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        text = spark_text(name)
        sources = [n for n in (*SOURCES, *DERIVED) if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", text, re.I)]
        for source in sources:
            text = re.sub(rf"\b(FROM|JOIN)\s+{source}\b", rf"\1 {{{source}}}", text, flags=re.I)
            text = text.replace(f"{source}.*", "*")
        return self.spark.sql(text, **{s: self[s] for s in sources})

    def _cswitch(self) -> DataFrame:
        linked = with_neighbours(
            self["base"], ["trace_id", "cpu"], ["ts_us", "seq"],
            previous={"_tid": "tid", "_pid": "pid"}, slice_us=DAY,
        )
        kind = F.col("event_type")
        return durable(linked.select(
            "trace_id", "seq", "ts_us", "qpc", "cpu", F.col("tid").alias("new_tid"), F.col("pid").alias("new_pid"),
            F.concat(F.lit("proc"), "pid").alias("new_process"),
            F.coalesce("_tid", F.lit(0)).alias("old_tid"), F.coalesce("_pid", F.lit(0)).alias("old_pid"),
            F.concat(F.lit("proc"), F.coalesce("_pid", F.lit(0))).alias("old_process"),
            F.when(kind == "error", "Waiting").otherwise("Ready").alias("old_state"),
            F.when(kind == "error", "WrQueue").when(kind == "signup", "WrPreempted").when(kind == "view", "")
            .otherwise("UserRequest").alias("wait_reason"),
        ))

    def _stacks(self) -> DataFrame:
        # the lines of one order: at most some dozen frames
        frame = F.struct("l_linenumber", "l_partkey", "q", "l_extendedprice", "address")
        return self["frames"].groupBy("trace_id", "l_orderkey").agg(
            F.first("weight").alias("weight"),
            F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["address"]).alias("stack"),
        )
