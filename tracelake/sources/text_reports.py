"""Text reports whose lines depend on the lines before them, and loose CSV.

An ordered lines table has ``trace_id, block, line_no, value``: ``block`` cuts a report into stretches
that are processed in parallel, in ascending order, and ``line_no`` increases along a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import process_field_name, process_field_pid
from ..operators.packets import path_index
from ..plans.lookup import lookup
from ..plans.sequence import fill_forward, with_neighbours, with_running

FILE = ["trace_id"]
ORDER = ["block", "line_no"]


def read_ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their order.

    The reader splits files; a split is a block, and lines within it stand as the reader met them. The
    trace id is the ``trace_id=...`` folder of a file, whose part files follow each other by number, or else
    the path of the file. A part may have up to 16 TB.
    """
    lines = spark.read.text(path)
    part = F.coalesce(F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("bigint"), F.lit(0))
    trace = F.col("trace_id").cast("string") if "trace_id" in lines.columns else F.col("_metadata.file_path")
    number = part if "trace_id" in lines.columns else F.lit(0).cast("bigint")
    return lines.select(
        trace.alias("trace_id"), (F.shiftleft(number, 44) + F.col("_metadata.file_block_start")).alias("block"),
        F.monotonically_increasing_id().alias("line_no"), "value",
    )


def write_ordered_lines(lines: DataFrame, path: str) -> None:
    """Write an ordered lines table as text that :func:`read_ordered_lines` reads back, in parts by range."""
    (
        lines.repartitionByRange("trace_id", *ORDER).sortWithinPartitions("trace_id", *ORDER)
        .select("trace_id", "value").write.partitionBy("trace_id").text(path)
    )


def profile_detail(lines: DataFrame) -> DataFrame:
    """``name (pid), weight, percent, module!function`` lines; needs no order."""
    parts = F.split(F.trim("value"), ",")
    rows = lines.where(~F.ltrim("value").startswith("Process Name")).withColumn("_f", parts)
    weight, pct = F.trim(F.get("_f", F.lit(1))).try_cast("bigint"), F.trim(F.get("_f", F.lit(2))).try_cast("double")
    rows = rows.where((F.size("_f") >= 4) & weight.isNotNull() & pct.isNotNull())
    place = F.trim(F.array_join(F.slice("_f", 4, F.size("_f")), ","))
    named = place.contains("!")

    def bare(x: Column) -> Column:
        return F.regexp_replace(F.trim(x), '^"+|"+$', "")

    who = F.get("_f", F.lit(0))
    return rows.select(
        "trace_id", process_field_name(who).alias("process_name"), process_field_pid(who).alias("pid"),
        weight.alias("weight"), pct.alias("weight_pct"),
        bare(F.when(named, F.split_part(place, F.lit("!"), F.lit(1))).otherwise(place)).alias("module"),
        F.when(named, bare(F.regexp_extract(place, "^[^!]*!(.*)$", 1))).otherwise(F.lit("")).alias("function"),
    )


def duration_histogram_text(lines: DataFrame) -> DataFrame:
    """Bucket lines under ``Total = n for module X`` headers; a bare total heads ``(all)``."""
    text = F.trim("value")
    owner = F.regexp_extract(text, r"^Total\s*=\s*\d+\s+for\s+module\s+(\S+)", 1)
    mark = (
        F.when(owner != "", owner)
        .when(text.rlike(r"^Total\s*=\s*\d+$"), F.lit("(all)"))
        .when(text.startswith("Total,"), F.lit(""))
    )
    filled = fill_forward(lines.withColumn("_mark", mark), FILE, ORDER, {"module": "_mark"}, slice_by="block")
    form = r"^Elapsed Time,\s*>\s*(\d+)\s*usecs\s+AND\s*<=\s*(\d+)\s*usecs,\s*(\d+),\s*or\s*([\d.]+)%"

    def group(i: int, kind: str) -> Column:
        return F.regexp_extract(text, form, i).try_cast(kind)

    return filled.where(text.rlike(form) & (F.coalesce("module", F.lit("")) != "")).select(
        "trace_id", "module", group(1, "bigint").alias("low_us"), group(2, "bigint").alias("high_us"),
        group(3, "bigint").alias("events"), group(4, "double").alias("pct"),
    )


def ready_thread_stacks(lines: DataFrame) -> DataFrame:
    """Wake-up lines with the frames of the stack lines below them, joined by `` / ``."""
    text = F.trim("value")
    is_event = text.startswith("ReadyThread,") & ~(text.contains("TimeStamp") & text.contains("Process Name"))
    marked = lines.withColumn("_event", is_event.cast("int"))
    grouped = with_running(marked, FILE, ORDER, {"_group": "_event"}, slice_by="block")
    frame = F.when(text.startswith("Stack,"), F.trim(F.regexp_extract(text, r"^(?:[^,]*,){5}(.*)$", 1)))
    full_frame = text.startswith("Stack,") & (F.size(F.split(text, ",")) >= 6)
    rows = grouped.where(F.col("_group") > 0).select(
        *FILE, "_group", F.struct(*ORDER).alias("_at"), F.when(F.col("_event") == 1, text).alias("_head"),
        F.when(full_frame, frame).alias("_frame"),
    )
    # the lines of one event: its own line and as many as its stack is deep
    events = rows.groupBy(*FILE, "_group").agg(
        F.max("_head").alias("_head"), F.min("_at")["line_no"].alias("line_no"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("_frame").isNotNull(), F.struct("_at", "_frame")))),
                lambda x: x["_frame"],
            ), " / ",
        ).alias("stack_text"),
    ).withColumn("_f", F.split("_head", ","))

    def part(i: int) -> Column:
        return F.trim(F.get("_f", F.lit(i)))

    def pid(i: int) -> Column:
        return F.when(part(i).rlike(r"\(\s*-?\d+\s*\)"), process_field_pid(part(i))).otherwise(F.lit(-1))

    return events.where(F.size("_f") >= 8).select(
        "trace_id", F.col("line_no").alias("seq"), part(1).try_cast("bigint").alias("ts_us"),
        process_field_name(part(2)).alias("process_name"), pid(2).cast("bigint").alias("pid"),
        part(3).try_cast("bigint").alias("tid"), process_field_name(part(4)).alias("readying_process"),
        pid(4).cast("bigint").alias("readying_pid"), part(5).try_cast("bigint").alias("readying_tid"),
        part(6).alias("adjust_reason"),
        F.when(F.size("_f") > 8, F.trim(F.element_at("_f", -1))).otherwise(F.lit("")).alias("in_dpc"),
        "stack_text",
    )


def utilisation_text(lines: DataFrame) -> DataFrame:
    """``StartTime, EndTime, Cpu 0, Cpu 1, ...`` tables as long rows; the header may come late."""
    is_header = F.col("value").contains("StartTime") & F.col("value").contains("Cpu")
    header = lines.where(is_header).groupBy(*FILE).agg(
        F.min_by("value", F.struct(*ORDER)).alias("_head"), F.min(F.struct(*ORDER)).alias("_at")
    )
    names = F.transform(F.split("_head", ","), lambda x: F.trim(x))
    fields = F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("double"))
    rows = lookup(lines, header, FILE).where(F.struct(*ORDER) > F.col("_at"))
    rows = rows.withColumns({"_n": names, "_v": fields})

    def named(name: str) -> Column:
        return F.get("_v", F.array_position("_n", name).cast("int") - 1).cast("bigint")

    cells = F.explode(F.filter(F.arrays_zip("_n", "_v"), lambda c: c["_n"].rlike("(?i)^cpu +[0-9]+$")))
    return rows.select(
        "trace_id", named("StartTime").alias("start_us"), named("EndTime").alias("end_us"), cells.alias("_c")
    ).select(
        "trace_id", "start_us", "end_us",
        F.regexp_extract("_c._n", "([0-9]+)$", 1).cast("int").alias("cpu"), F.col("_c._v").alias("util_pct"),
    ).where(F.col("start_us").isNotNull())


def pool_text(lines: DataFrame) -> DataFrame:
    """Pool rows under lines that name a pool type."""
    text, low = F.trim("value"), F.lower(F.trim("value"))
    is_section = low.contains("non-paged pool") | low.contains("paged pool")
    mark = F.when(
        is_section,
        F.when(low.contains("nx non-paged"), F.lit("NX NonPaged"))
        .when(low.contains("ex non-paged"), F.lit("EX NonPaged"))
        .when(low.contains("non-paged"), F.lit("NonPaged"))
        .otherwise(F.lit("Paged")),
    )
    filled = fill_forward(lines.withColumn("_mark", mark), FILE, ORDER, {"pool_type": "_mark"}, slice_by="block")
    rows = filled.where(
        F.col("_mark").isNull() & ~text.startswith("Image") & ~text.startswith("---") & (text != "")
    ).withColumn("_f", F.transform(F.split(text, ","), lambda x: F.trim(x)))
    columns = {
        "allocs": (2, "bigint"), "alloc_kb": (3, "double"), "outstanding": (4, "bigint"), "outstanding_kb": (5, "double"),
    }
    rows = rows.where(F.size("_f") >= 6).select(
        "trace_id", F.coalesce("pool_type", F.lit("Unknown")).alias("pool_type"),
        F.get("_f", F.lit(0)).alias("module"), F.get("_f", F.lit(1)).alias("tag"),
        *[F.get("_f", F.lit(i)).try_cast(k).alias(n) for n, (i, k) in columns.items()],
    )
    return rows.dropna(subset=list(columns))


# The two line forms of packet-monitor text.
_MONITOR_HEAD = (
    r"^(\d\d:\d\d:\d\d\.\d+) (Drop: )?PktGroupId (\d+), PktNumber (\d+), Appearance (\d+), "
    r"Direction\s+(Tx|Rx)\s*, Type\s+(\w+)\s*, Component\s+(\d+)(?:,\s*Edge\s+(\d+))?.*?"
    r"OriginalSize\s+(\d+),\s*LoggedSize\s+(\d+)"
)
_MONITOR_FLOW = r"(?i)(?:IPv4|IPv6), length \d+: (.+)\.(\d+) > (.+)\.(\d+): (tcp|udp)\b"


def packet_monitor_text(lines: DataFrame, *, boundary_only: bool = False) -> DataFrame:
    """Packet sightings: a header line and the tab-indented line below it; drops are skipped.

    With ``boundary_only``, the sightings where a packet enters or leaves the stack, with the
    flow in ``flow``; otherwise every Ethernet sighting with its path index.
    """
    paired = with_neighbours(lines, FILE, ORDER, following={"_below": "value"}, slice_by="block")

    def group(i: int) -> Column:
        return F.regexp_extract("value", _MONITOR_HEAD, i)

    rows = paired.where(
        F.col("value").rlike(_MONITOR_HEAD) & (group(2) == "") & (group(7) == "Ethernet")
        & F.coalesce(F.col("_below").startswith("\t"), F.lit(False)) & ~F.col("_below").rlike(_MONITOR_HEAD)
    ).select(
        "trace_id", F.col("line_no").alias("seq"), group(1).alias("clock"),
        F.when(group(6) == "Tx", F.lit("Send")).otherwise(F.lit("Recv")).alias("direction"),
        group(8).cast("int").alias("component"),
        F.coalesce(F.nullif(group(9), F.lit("")).cast("int"), F.lit(-1)).alias("edge"),
        group(3).cast("bigint").alias("packet_group"), group(4).cast("bigint").alias("packet_number"),
        group(5).cast("bigint").alias("appearance"), group(10).cast("bigint").alias("size"),
        group(11).cast("bigint").alias("captured_size"), F.trim(F.ltrim(F.translate("_below", "\t", " "))).alias("detail"),
        F.col("_below"),
    )
    boundary = (F.col("edge") == 1) & (
        ((F.col("direction") == "Send") & (F.col("component") == 12))
        | ((F.col("direction") == "Recv") & (F.col("component") == 1))
    )
    rows = rows.withColumns({
        "boundary": boundary, "path_index": path_index(F.col("direction"), F.col("component"), F.col("edge")),
    })
    if not boundary_only:
        return rows.drop("_below")

    def flow(i: int) -> Column:
        return F.regexp_extract("_below", _MONITOR_FLOW, i)

    label = F.concat(flow(1), F.lit(":"), flow(2), F.lit(" -> "), flow(3), F.lit(":"), flow(4), F.lit("/"), F.lower(flow(5)))
    return rows.where("boundary").where(F.col("_below").rlike(_MONITOR_FLOW)).select(
        "trace_id", "seq", "direction", label.alias("flow"), "size"
    )


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header: byte-order mark and unnamed columns dropped, a column numeric where
    over half of its filled rows convert (thousands separators allowed)."""
    raw = spark.read.option("header", "true").option("mode", "PERMISSIVE").csv(path)
    names = [c for c in raw.columns if c and not c.startswith(("Unnamed", "_c"))]
    df = raw.select(*[F.col(f"`{c}`").alias(c.strip().lstrip("\ufeff").strip('"')) for c in names])

    def number(c: str) -> Column:
        return F.regexp_replace(F.trim(F.col(f"`{c}`")), ",", "").try_cast("double")

    # one pass over the data, one row to the driver
    shares = df.agg(*[F.avg(number(c).isNotNull().cast("int")).alias(f"s{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[
        number(c).alias(c) if (shares[i] or 0) > 0.5 else F.col(f"`{c}`") for i, c in enumerate(df.columns)
    ])
