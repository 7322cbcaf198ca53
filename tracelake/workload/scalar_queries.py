"""Queries of the column functions, over columns of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classes, ids, labels, times
from ..operators import filters
from .registry import query


@query("tick_conversion", "SELECT seq, CAST(round_even((qpc - 5000) * 1e6 / 30000000.0, 0) AS BIGINT) AS us FROM base")
def _(t):
    return t["base"].select("seq", times.ticks_to_us(F.col("qpc"), F.lit(5000), F.lit(30_000_000)).alias("us"))


@query("time_buckets", "SELECT seq, floor(ts_us / 250000.0) * 250000.0 AS bucket FROM base")
def _(t):
    return t["base"].select("seq", times.time_bucket(F.col("ts_us"), 250_000).alias("bucket"))


@query("symbol_labels", """
SELECT seq, CASE seq % 3 WHEN 0 THEN module WHEN 1 THEN module ELSE 'bare' || k END AS module, CASE seq % 3 WHEN 2 THEN '' ELSE 'F' || k END AS function FROM (SELECT b.seq, b.k, l.module FROM base b JOIN labelled l USING (seq))""")
def _(t):
    rows = t["base"].select("seq", "k").join(t["labelled"].select("seq", "module"), "seq")
    label = F.when(F.col("seq") % 3 == 0, F.concat("module", F.lit("!F"), "k", F.lit("+0xAb"))).when(
        F.col("seq") % 3 == 1, F.concat("module", F.lit("!F"), "k")).otherwise(F.concat(F.lit("bare"), "k", F.lit("+0x42")))
    return rows.select("seq", labels.symbol_module(label).alias("module"), labels.symbol_function(label).alias("function"))


@query("basenames", "SELECT seq, 'img' || k || '.sys' AS name FROM base")
def _(t):
    path = F.when(F.col("seq") % 2 == 0, F.concat(F.lit("\\Device\\X\\IMG"), "k", F.lit(".SYS"))).otherwise(F.concat(F.lit("/a/b/Img"), "k", F.lit(".sys")))
    return t["base"].select("seq", labels.basename(path).alias("name"))


@query("duration_text", """
SELECT seq, CASE seq % 6 WHEN 0 THEN k * 1000 + 234 WHEN 1 THEN k * 1000.0 WHEN 2 THEN k / 1000.0 WHEN 3 THEN k * 1000000.0 WHEN 4 THEN k END AS us FROM base""")
def _(t):
    k = F.col("k").cast("string")
    text = (
        F.when(F.col("seq") % 6 == 0, F.concat(k, F.lit(",234 us"))).when(F.col("seq") % 6 == 1, F.concat(k, F.lit(" ms")))
        .when(F.col("seq") % 6 == 2, F.concat(k, F.lit("ns"))).when(F.col("seq") % 6 == 3, F.concat(k, F.lit("s")))
        .when(F.col("seq") % 6 == 4, k).otherwise(F.lit("soon"))
    )
    return t["base"].select("seq", times.duration_text_to_us(text).alias("us"))


@query("clock_text", "SELECT seq, CASE seq % 3 WHEN 0 THEN pid * 3600 + 62.5 WHEN 1 THEN pid * 60 + 7.0 ELSE pid + 0.25 END AS seconds FROM base")
def _(t):
    p = F.col("pid").cast("string")
    text = F.when(F.col("seq") % 3 == 0, F.concat(p, F.lit(":01:02.5"))).when(F.col("seq") % 3 == 1, F.concat(p, F.lit(":07"))).otherwise(F.concat(p, F.lit(".25s")))
    return t["base"].select("seq", times.clock_text_to_seconds(text).alias("seconds"))


@query("process_fields", "SELECT seq, CASE WHEN seq % 3 = 0 THEN 'odd field' ELSE 'svc host' || k END AS name, CASE WHEN seq % 3 = 0 THEN 0 WHEN seq % 3 = 1 THEN pid ELSE -1 END AS pid FROM base")
def _(t):
    text = F.when(F.col("seq") % 3 == 0, F.lit("odd field")).when(F.col("seq") % 3 == 1, F.concat(F.lit('"svc host'), "k", F.lit('" ( '), "pid", F.lit(")"))).otherwise(
        F.concat(F.lit("svc host"), "k", F.lit(" (-1)")))
    return t["base"].select("seq", labels.process_field_name(text).alias("name"), labels.process_field_pid(text).alias("pid"))


@query("endpoint_text", "SELECT seq, CASE seq % 3 WHEN 0 THEN '10.0.0.' || pid WHEN 1 THEN 'fe80::' || pid ELSE '10.9.9.9' END AS address, CASE seq % 3 WHEN 2 THEN 0 ELSE k END AS port FROM base")
def _(t):
    text = F.when(F.col("seq") % 3 == 0, F.concat(F.lit("10.0.0."), "pid", F.lit(":"), "k")).when(
        F.col("seq") % 3 == 1, F.concat(F.lit("[fe80::"), "pid", F.lit("]:"), "k")).otherwise(F.lit("10.9.9.9"))
    return t["base"].select("seq", labels.endpoint_address(text).alias("address"), labels.endpoint_port(text).alias("port"))


@query("socket_addresses", "SELECT seq, '10.' || pid || '.1.' || k AS address, CAST(k * 3 AS INT) AS port FROM base")
def _(t):
    raw = F.unhex(F.concat(F.lit("0200"), F.lpad(F.hex(F.col("k") * 3), 4, "0"), F.lit("0A"), F.lpad(F.hex("pid"), 2, "0"), F.lit("01"), F.lpad(F.hex("k"), 2, "0"), F.lit("0000000000000000")))
    return t["base"].select("seq", labels.socket_address(raw).alias("address"), labels.socket_port(raw).alias("port"))


@query("handle_text", "SELECT seq, CASE seq % 5 WHEN 0 THEN seq WHEN 1 THEN seq WHEN 2 THEN 4294900000 + k % 10 WHEN 3 THEN 0 ELSE -1 END AS handle FROM base")
def _(t):
    s = F.col("seq")
    text = (
        F.when(s % 5 == 0, F.concat(F.lit("0x"), F.hex("seq"))).when(s % 5 == 1, F.concat(F.lit('"'), s.cast("string"), F.lit('"')))
        .when(s % 5 == 2, F.hex(F.lit(4294900000) + F.col("k") % 10)).when(s % 5 == 3, F.lit("none")).otherwise(F.lit("0xFFFFFFFFFFFFFFFF"))
    )
    return t["base"].select("seq", ids.parse_id(text).alias("handle"))


@query("cid_hashes", """
SELECT connection_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(0, 8), lambda i: CAST(('0x' || substr(cid, i * 2 + 1, 2)) AS BIGINT))), lambda h, x: xor(h, x) * 16777619 % 4294967296) AS hash
FROM quic_created WHERE cid <> ''""")
def _(t):
    dressed = F.concat(F.lit("0x"), F.substring("cid", 1, 4), F.lit("-"), F.expr("substring(cid, 5)"))
    return t["quic_created"].where("cid <> ''").select("connection_id", ids.fnv1a_32(ids.cid_bytes(dressed)).alias("hash"))


# numbers are names up to the last one known
REASONS = ", ".join(f"'{name}'" for name in classes.WAIT_REASONS)


@query("enum_names", f"""
SELECT seq, coalesce(list_extract([{REASONS}], k + 1), CAST(k AS VARCHAR)) AS reason, CASE k % 3 WHEN 0 THEN 'KernelMode' WHEN 1 THEN 'UserMode' ELSE '2' END AS mode FROM base""")
def _(t):
    return t["base"].select(
        "seq", classes.enum_name(F.col("k"), classes.WAIT_REASONS).alias("reason"), classes.enum_name(F.col("k") % 3, classes.WAIT_MODES).alias("mode"))


@query("duration_buckets", """
SELECT seq, CASE WHEN d < 1 THEN 0 ELSE CAST(1 AS BIGINT) << least(CAST(floor(log2(d)) AS INT), 15) END AS low, CASE WHEN d < 1 THEN 1 WHEN d >= 32768 THEN 99999999 ELSE CAST(1 AS BIGINT) << (CAST(floor(log2(d)) AS INT) + 1) END AS high
FROM (SELECT seq, k * k * 11 AS d FROM base)""")
def _(t):
    bucket = classes.duration_bucket(F.col("k") * F.col("k") * 11)
    return t["base"].select("seq", classes.bucket_low(bucket).alias("low"), classes.bucket_high(bucket).alias("high"))


@query("nearest_event", """
SELECT trace_id, arg_min(seq, (abs(ts_us - 1000000000000), seq)) AS seq FROM base GROUP BY trace_id""")
def _(t):
    return filters.nearest_event(t["base"].select("trace_id", "ts_us", "seq"), 1_000_000_000_000).select("trace_id", "seq")


@query("lock_frames", "SELECT seq, stack_text LIKE '%SpinLock%' OR stack_text LIKE '%FastMutex%' AS locked FROM ready")
def _(t):
    return t["ready"].select("seq", labels.mentions_lock(F.col("stack_text")).alias("locked"))
