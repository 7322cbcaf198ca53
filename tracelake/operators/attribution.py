"""Attribution joins: names, processes, modules, symbols, stacks, connections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import unsigned
from ..functions.labels import (
    UNKNOWN, basename, is_blank_name, is_known_pid, known_name, symbol_function, symbol_module,
)
from ..plans.lookup import lookup
from ..plans.ranges import containing_interval
from ..session import durable

ENDS = ("local_addr", "local_port", "remote_addr", "remote_port")


def process_names(process: DataFrame) -> DataFrame:
    """One name per process id: the last one that is not blank."""
    return (
        process.where(~is_blank_name(F.col("image_file_name")))
        .groupBy("trace_id", "pid")
        .agg(F.max_by("image_file_name", F.struct("qpc", "seq")).alias("known_process"))
    )


def with_process_name(df: DataFrame, process: DataFrame, *, pid: str = "pid", out: str = "process_name") -> DataFrame:
    """Name each row's process; ``<unknown>`` where no record names it.

    Join pre-aggregated rows where the facts are large.
    """
    names = process_names(process).withColumnRenamed("pid", pid)
    joined = lookup(df, names, ["trace_id", pid])
    return joined.withColumn(out, F.coalesce("known_process", F.lit(UNKNOWN))).drop("known_process")


def thread_owners(thread: DataFrame) -> DataFrame:
    """One process id per thread id: the first start or rundown record."""
    return (
        thread.where((F.col("tid") > 0) & is_known_pid(F.col("pid")))
        .groupBy("trace_id", "tid")
        .agg(F.min_by("pid", F.struct("qpc", "seq")).alias("owner_pid"))
    )


def with_owner(df: DataFrame, thread: DataFrame) -> DataFrame:
    """Replace an unknown process id by the owner of the payload thread, else of the header
    thread; what stays unresolved becomes -1."""
    owners = thread_owners(thread)
    payload = owners.select("trace_id", F.col("tid").alias("payload_tid"), F.col("owner_pid").alias("_payload_pid"))
    header = owners.select("trace_id", "tid", F.col("owner_pid").alias("_header_pid"))
    joined = lookup(lookup(df, payload, ["trace_id", "payload_tid"]), header, ["trace_id", "tid"])
    pid = F.col("pid")
    missing = pid.isNull() | (pid <= 0) | (pid == 4294967295)
    resolved = F.coalesce("_payload_pid", "_header_pid")
    final = (
        F.when(~missing, pid)
        .when(resolved.isNotNull(), resolved)
        .when(pid == 4294967295, F.lit(-1).cast("bigint"))
        .otherwise(pid)
    )
    return joined.withColumn("pid", final).drop("_payload_pid", "_header_pid")


def modules_of(addresses: DataFrame, image: DataFrame) -> DataFrame:
    """Module per distinct ``(trace_id, address)``: the loaded image with the greatest base that
    contains the address."""
    points = addresses.select("trace_id", unsigned(F.col("address")).alias("_at")).distinct()
    loads = (
        image.where(~F.coalesce(F.lower("type").isin("unload", "dcend", "end"), F.lit(False)))
        .select(
            "trace_id",
            unsigned(F.col("image_base")).alias("_base"),
            F.col("image_size").cast("decimal(20,0)").alias("_size"),
            basename(F.col("file_name")).alias("module"),
        )
        .distinct()
    )
    found = containing_interval(
        points, loads, ["trace_id"], point="_at", start="_base", length="_size", payload=["module"]
    )
    return found.select("trace_id", "_at", "module", F.col("interval_start").alias("image_start"))


def symbols_of(located: DataFrame, symbols: DataFrame) -> DataFrame:
    """Function per distinct located address from ``symbols(module, start, size, name, source)``.

    ``start`` is relative to the image. The symbol with the greatest start up to an address names
    it, as export symbols have no size; of symbols that start together the longest does. Addresses
    before the first symbol keep ``+0x<offset>`` as function.
    """
    rva = (F.col("_at") - F.col("image_start")).cast("bigint")
    points = located.where(F.col("module").isNotNull()).select(
        "module", rva.alias("_rva"), F.lit(1).alias("_asks"), F.lit(None).cast("struct<name:string,source:string>").alias("_s"))
    marks = symbols.where("start is not null").groupBy(F.lower("module").alias("module"), F.col("start").cast("bigint").alias("_rva")).agg(
        F.min(F.struct((-F.coalesce("size", F.lit(0))).alias("z"), "name", "source")).alias("_m")
    ).select("module", "_rva", F.lit(0).alias("_asks"), F.struct("_m.name", "_m.source").alias("_s"))
    # distinct addresses and symbol starts of one image: bounded by the image, not by the trace
    upto = Window.partitionBy("module").orderBy("_rva", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        points.distinct().unionByName(marks)
        .withColumn("_s", F.last("_s", ignorenulls=True).over(upto)).where("_asks = 1").select("module", "_rva", "_s.name", "_s.source")
    )
    joined = located.withColumn("_rva", rva).join(found, ["module", "_rva"], "left")
    fallback = F.concat(F.lit("+0x"), F.lower(F.hex("_rva")))
    return joined.select(
        "trace_id", "_at", "module",
        F.when(F.col("module").isNotNull(), F.coalesce("name", fallback)).otherwise(F.lit("")).alias("function"),
        F.coalesce("source", F.lit("unknown")).alias("symbol_source"),
    )


def resolve_addresses(addresses: DataFrame, image: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """``(trace_id, address) -> module, function, symbol_source`` for the distinct addresses."""
    located = modules_of(addresses, image)
    if symbols is not None:
        named = symbols_of(durable(located), symbols)
    else:
        named = located.select(
            "trace_id", "_at", "module", F.lit("").alias("function"), F.lit("unknown").alias("symbol_source")
        )
    keys = addresses.select("trace_id", "address").distinct().withColumn("_at", unsigned(F.col("address")))
    return keys.join(named, ["trace_id", "_at"], "left").select(
        "trace_id", "address",
        F.coalesce("module", F.lit(UNKNOWN)).alias("module"),
        F.coalesce("function", F.lit("")).alias("function"),
        F.coalesce("symbol_source", F.lit("unknown")).alias("symbol_source"),
    )


def with_symbol_label(df: DataFrame, label: str = "symbol") -> DataFrame:
    """Split a ready-made ``module!function+0x..`` label."""
    return df.withColumns({
        "module": symbol_module(F.col(label)), "function": symbol_function(F.col(label)),
    })


def with_debug_identity(image: DataFrame, rsds: DataFrame) -> DataFrame:
    """Fill missing debug identity of images: by process and base, else by base alone.

    The joins are merge joins at any size: a broadcast that is planned from the bytes of well packed files is not
    taken back at run time, however many rows there are.
    """
    fields = ("pdb_guid", "pdb_age", "pdb_name")

    def first(keys: list[str], prefix: str) -> DataFrame:
        return rsds.groupBy(*keys).agg(
            F.min_by(F.struct(*fields), F.struct("qpc", "seq")).alias(prefix)
        )

    exact = first(["trace_id", "pid", "image_base"], "_exact")
    loose = first(["trace_id", "image_base"], "_loose")
    joined = image.join(exact.hint("merge"), ["trace_id", "pid", "image_base"], "left").join(
        loose.hint("merge"), ["trace_id", "image_base"], "left"
    )
    found = F.coalesce("_exact", "_loose")
    blank = F.coalesce(F.col("pdb_guid"), F.lit("")) == ""
    filled = {f: F.when(blank, F.coalesce(found[f], F.col(f))).otherwise(F.col(f)) for f in fields}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in image.columns])


def pair_stacks(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """Attach walked stacks to events by time and thread, else by time alone.

    ``stacks`` has ``trace_id, qpc, tid, stack``. ``stack_match`` is ``thread``, ``time`` or null.
    """
    exact = stacks.groupBy("trace_id", "qpc", "tid").agg(F.min_by("stack", "seq").alias("_by_thread"))
    loose = stacks.groupBy("trace_id", "qpc").agg(F.min_by("stack", "seq").alias("_by_time"))
    joined = events.drop("stack").join(exact, ["trace_id", "qpc", "tid"], "left")
    joined = joined.join(loose, ["trace_id", "qpc"], "left")
    return joined.withColumns({
        "stack": F.coalesce("_by_thread", "_by_time"),
        "stack_match": F.when(F.col("_by_thread").isNotNull(), F.lit("thread"))
        .when(F.col("_by_time").isNotNull(), F.lit("time")),
    }).drop("_by_thread", "_by_time")


def orphan_stacks(events: DataFrame, stacks: DataFrame) -> DataFrame:
    """Stacks that belong to no event, counted per trace."""
    times = events.select("trace_id", "qpc").distinct()
    return stacks.join(times, ["trace_id", "qpc"], "left_anti").groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("orphan_stacks")
    )


def _last_known(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.struct("_class_order", "ts_us", "seq")))


def connection_dimension(tables: list[DataFrame], key: str, *, need_endpoint: bool) -> DataFrame:
    """One row per connection or socket with the last known endpoints, process id and name.

    ``tables`` are ordered: a later table overrides an earlier one.
    """
    columns = ["trace_id", key, "ts_us", "seq", "pid", "process_name", *ENDS]
    rows = None
    for rank, table in enumerate(tables):
        part = table
        for end in ENDS:
            if end not in part.columns:
                part = part.withColumn(end, F.lit(None).cast("bigint" if end.endswith("port") else "string"))
        part = part.select(*columns).withColumn("_class_order", F.lit(rank))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.where(F.coalesce(F.col(key), F.lit(0)) != 0)
    if need_endpoint:
        whole = (
            (F.trim("local_addr") != "") & (F.trim("remote_addr") != "")
            & (F.col("local_port") > 0) & (F.col("remote_port") > 0)
        )
        rows = rows.where(F.coalesce(whole, F.lit(False)))
    known = {
        "local_addr": F.when(F.col("local_addr") != "", F.col("local_addr")),
        "remote_addr": F.when(F.col("remote_addr") != "", F.col("remote_addr")),
        "local_port": F.when(F.col("local_port") != 0, F.col("local_port")),
        "remote_port": F.when(F.col("remote_port") != 0, F.col("remote_port")),
        "pid": F.when(is_known_pid(F.col("pid")), F.col("pid")),
        "process_name": known_name(F.col("process_name")),
    }
    return rows.groupBy("trace_id", key).agg(
        *[_last_known(column).alias(f"dim_{name}") for name, column in known.items()]
    )


def enrich_by_connection(
    df: DataFrame, dimension: DataFrame | None, key: str | None, process: DataFrame | None,
) -> DataFrame:
    """Fill blank endpoints, process ids and names from the connection and process records.

    Only blanks are filled.
    """
    out = df
    if dimension is not None and key is not None:
        out = lookup(out, dimension, ["trace_id", key])
    else:
        for name in ("pid", "process_name", *ENDS):
            kind = "bigint" if name == "pid" or name.endswith("port") else "string"
            out = out.withColumn(f"dim_{name}", F.lit(None).cast(kind))
    filled = {}
    for end in ENDS:
        if end not in df.columns:
            continue
        if end.endswith("port"):
            filled[end] = F.when(
                F.coalesce(F.col(end), F.lit(0)).isin(0, -1, 4294967295), F.coalesce(f"dim_{end}", end)
            ).otherwise(F.col(end))
        else:
            own = F.when(F.trim(F.coalesce(F.col(end), F.lit(""))).isin("", "nan", "None"), F.lit(None)).otherwise(F.col(end))
            filled[end] = F.coalesce(own, F.col(f"dim_{end}"), F.lit(UNKNOWN))
    filled["pid"] = F.when(is_known_pid(F.col("pid")), F.col("pid")).otherwise(F.coalesce("dim_pid", "pid"))
    out = out.withColumns(filled)
    if process is not None:
        out = lookup(out, process_names(process), ["trace_id", "pid"])
    else:
        out = out.withColumn("known_process", F.lit(None).cast("string"))
    name = F.coalesce(
        known_name(F.col("process_name")), F.col("known_process"), F.col("dim_process_name"), F.lit(UNKNOWN)
    )
    return out.withColumn("process_name", name).select(*df.columns)
