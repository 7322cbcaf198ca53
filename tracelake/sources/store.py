"""Event store on Parquet: committed generations of each event class, and a zone map of their files.

::

    <root>/<class>/<run>/part-*.parquet      rows in order of (trace_id, qpc, seq)
    <root>/_zones/<class>/<run>/             one row per file and trace: rows, first and last tick, bytes
    <root>/_staging/<run>/                   what has not been committed yet

A write stages its files, reads their statistics back as zones, moves the files in place and then the
zones, so a generation counts from the moment its zones are there. Files that no zone names do not
count. Reads ask the zones first: a range of time and a set of traces become a list of files and tick
literals, and nothing else is opened.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import tick_bounds, ticks_to_us
from ..operators.filters import cpu_predicate
from ..plans.lookup import lookup
from ..schemas import canonical_event_class, event_schema
from ..session import folder_of

FILE_BYTES = 128 << 20
ZONES, STAGING = "_zones", "_staging"
ZONE_SCHEMA = "file string, trace_id string, rows bigint, first_qpc bigint, last_qpc bigint, bytes bigint"


def trace_identity(path: str, size: str, modified: str):
    """Trace id of a file from its lower-case path, size and time of change (column names)."""
    text = F.concat_ws("|", F.lower(path), F.col(size).cast("string"), F.col(modified).cast("string"))
    return F.concat(F.lit("trace_"), F.substring(F.sha2(text, 256), 1, 12))


def class_path(root: str, event_class: str) -> str:
    return f"{root.rstrip('/')}/{canonical_event_class(event_class)}"


def zone_path(root: str, event_class: str) -> str:
    return f"{root.rstrip('/')}/{ZONES}/{canonical_event_class(event_class)}"


def _zones_of(df: DataFrame, file: Column) -> DataFrame:
    """Rows, tick range and size per file and trace of a scan."""
    return df.groupBy(file.alias("file"), "trace_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("qpc").alias("first_qpc"), F.max("qpc").alias("last_qpc"),
        F.first("_metadata.file_size").alias("bytes"),
    )


def _short_name() -> Column:
    """Run and file name, which stay when a staged folder is moved."""
    return F.regexp_extract("_metadata.file_path", r"([^/]+/[^/]+)$", 1)


def write_events(
    df: DataFrame, root: str, event_class: str, *, mode: str = "append", file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Commit a generation of a class and return its zones.

    Rows are dealt by range of trace and tick into files of about ``file_bytes``, measured on the
    staged rows, so a trace with a third of all rows takes a third of the files and each file holds a
    short range of ticks. ``overwrite`` replaces earlier generations, ``append`` adds to them.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"a write appends or overwrites: {mode!r}")
    spark, name, run = df.sparkSession, canonical_event_class(event_class), uuid.uuid4().hex
    schema = event_schema(name)
    typed = df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ])
    stage = f"{root.rstrip('/')}/{STAGING}/{run}"
    earlier = _runs(spark, root, name) if mode == "overwrite" else []
    # the rows as they come: tells their size, and what made them is not run twice for the ranges
    typed.write.option("compression", "zstd").parquet(f"{stage}/rows")
    files, place = folder_of(spark, f"{stage}/rows")
    size = files.getContentSummary(place).getLength()
    (
        spark.read.schema(schema).parquet(f"{stage}/rows")
        .repartitionByRange(max(1, math.ceil(size / file_bytes)), "trace_id", "qpc", "seq")
        .sortWithinPartitions("trace_id", "qpc", "seq")
        .write.option("compression", "zstd").parquet(f"{stage}/files/{run}")
    )
    written = spark.read.schema(schema).parquet(f"{stage}/files/{run}")
    _zones_of(written, _short_name()).coalesce(1).write.parquet(f"{stage}/zones")
    _move(spark, f"{stage}/files/{run}", f"{class_path(root, name)}/{run}")
    _move(spark, f"{stage}/zones", f"{zone_path(root, name)}/{run}")
    for old in earlier:  # their zones first, so that no zone names a file that is gone
        for folder in (zone_path(root, name), class_path(root, name)):
            files, place = folder_of(spark, f"{folder}/{old}")
            files.delete(place, True)
    files, place = folder_of(spark, stage)
    files.delete(place, True)
    return spark.read.schema(ZONE_SCHEMA).parquet(f"{zone_path(root, name)}/{run}")


def _move(spark: SparkSession, source: str, target: str) -> None:
    files, to = folder_of(spark, target)
    files.mkdirs(to.getParent())
    if not files.rename(folder_of(spark, source)[1], to):
        raise OSError(f"cannot move {source} to {target}")


def _runs(spark: SparkSession, root: str, event_class: str) -> list[str]:
    """Names of the committed generations of a class."""
    files, place = folder_of(spark, zone_path(root, event_class))
    return sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []


def zones(spark: SparkSession, root: str, event_class: str) -> DataFrame:
    """The zone map of a class: one row per committed file and trace; empty if nothing is stored."""
    name = canonical_event_class(event_class)
    paths = [f"{zone_path(root, name)}/{run}" for run in _runs(spark, root, name)]
    return spark.read.schema(ZONE_SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], ZONE_SCHEMA)


def _clock(meta: DataFrame) -> DataFrame:
    return meta.select("trace_id", F.col("origin").alias("_origin"), F.col("freq").alias("_freq"))


def _tick(rounded, seconds: float) -> Column:
    return F.col("_origin") + rounded(F.lit(float(seconds)) * F.col("_freq"))


def select_events(
    df: DataFrame, *, columns: Sequence[str] | None = None, cpu_filter: str | None = None,
    start_time: float | None = None, end_time: float | None = None,
    timebase: tuple[int, int] | None = None, meta: DataFrame | None = None, include_time: bool = True,
    traces: Sequence[str] | None = None,
) -> DataFrame:
    """Project and filter an event table by trace, CPU set and inclusive time range.

    With ``timebase`` (origin, frequency) a range in seconds becomes tick literals the Parquet
    reader can push down. With ``meta`` each trace uses its own clock. ``ts_us`` is added where
    a clock is known.
    """
    if traces is not None:
        df = df.where(F.col("trace_id").isin(list(traces)))
    if "cpu" in df.columns and (on_cpu := cpu_predicate(cpu_filter)) is not None:
        df = df.where(on_cpu)
    if timebase is not None:
        low, high = tick_bounds(start_time, end_time, *timebase)
        if low is not None:
            df = df.where(F.col("qpc") >= low)
        if high is not None:
            df = df.where(F.col("qpc") <= high)
        if include_time:
            df = df.withColumn("ts_us", ticks_to_us(F.col("qpc"), F.lit(timebase[0]), F.lit(timebase[1])))
    elif meta is not None:
        df = lookup(df, _clock(meta), ["trace_id"])
        if start_time is not None:
            df = df.where(F.col("qpc") >= _tick(F.ceil, start_time))
        if end_time is not None:
            df = df.where(F.col("qpc") <= _tick(F.floor, end_time))
        if include_time:
            df = df.withColumn("ts_us", ticks_to_us(F.col("qpc"), F.col("_origin"), F.col("_freq")))
        df = df.drop("_origin", "_freq")
    if columns is not None:
        time = ["ts_us"] if include_time and "ts_us" in df.columns and "ts_us" not in columns else []
        df = df.select(*columns, *time)
    return df


def scan(
    spark: SparkSession, root: str, event_class: str, *, start_time: float | None = None, end_time: float | None = None,
    timebase: tuple[int, int] | None = None, meta: DataFrame | None = None, traces: Sequence[str] | None = None, **selection,
) -> DataFrame:
    """Read a class from the store with the options of :func:`select_events`.

    The zones say which files can hold wanted rows, by trace and by each trace's own clock; only those
    are opened, and the widest tick range is a literal that the reader can push down. The list of
    files, like any listing, is held by the driver. A trace without a clock has no rows in a range.
    """
    name, found = canonical_event_class(event_class), zones(spark, root, event_class)
    options = {"start_time": start_time, "end_time": end_time, "timebase": timebase, "meta": meta, "traces": traces, **selection}
    if traces is not None:
        found = found.where(F.col("trace_id").isin(list(traces)))
    low = high = None
    if timebase is not None:
        low, high = tick_bounds(start_time, end_time, *timebase)
    elif meta is not None and (start_time is not None or end_time is not None):
        found = found.join(_clock(meta), "trace_id")
        if start_time is not None:
            found = found.where(F.col("last_qpc") >= _tick(F.ceil, start_time))
        if end_time is not None:
            found = found.where(F.col("first_qpc") <= _tick(F.floor, end_time))
        bounds = found.agg(
            F.min(_tick(F.ceil, start_time or 0)).alias("low"), F.max(_tick(F.floor, end_time or 0)).alias("high")).first()
        low, high = bounds["low"] if start_time is not None else None, bounds["high"] if end_time is not None else None
    if low is not None:
        found = found.where(F.col("last_qpc") >= low)
    if high is not None:
        found = found.where(F.col("first_qpc") <= high)
    paths = [f"{class_path(root, name)}/{r['file']}" for r in found.select("file").distinct().collect()]
    if not paths:
        return select_events(empty_events(spark, name), **options)
    df = spark.read.schema(event_schema(name)).parquet(*sorted(paths))
    if low is not None and timebase is None:
        df = df.where(F.col("qpc") >= low)
    if high is not None and timebase is None:
        df = df.where(F.col("qpc") <= high)
    return select_events(df, **options)


def empty_events(spark: SparkSession, event_class: str) -> DataFrame:
    return spark.createDataFrame([], event_schema(event_class))


def open_events(
    spark: SparkSession, event_class: str, *, tables: Mapping[str, DataFrame] | None = None,
    root: str | None = None, **options,
) -> DataFrame:
    """A class from the given tables, else from the store, else an empty typed table."""
    name = canonical_event_class(event_class)
    for key, table in (tables or {}).items():
        if canonical_event_class(key) == name:
            return select_events(table, **options)
    if root is not None:
        return scan(spark, root, name, **options)
    return select_events(empty_events(spark, name), **options)


def dataset_statistics(spark: SparkSession, root: str, event_class: str) -> DataFrame:
    """Files, rows and tick range per trace of a stored class, from its zones."""
    return zones(spark, root, event_class).groupBy("trace_id").agg(
        F.countDistinct("file").alias("files"), F.sum("rows").alias("rows"),
        F.min("first_qpc").alias("first_qpc"), F.max("last_qpc").alias("last_qpc"),
    )


def validate(spark: SparkSession, root: str, event_class: str) -> DataFrame:
    """Violations of a stored class: columns, types, missing, damaged or stray files, rows and ticks unlike the zones."""
    name = canonical_event_class(event_class)
    path = class_path(root, name)
    problems = []
    try:
        # damaged files have no say here; the file check names them
        lenient = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
        found = {f.name: f.dataType.simpleString() for f in lenient.parquet(path).schema}
    except AnalysisException as error:  # no readable file at all: they are reported as missing
        if (error.getCondition() or "").split(".")[0] not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        found = None
    for field in event_schema(name).fields if found is not None else []:
        kind = found.get(field.name)
        if kind is None:
            problems.append((name, "missing column", field.name))
        elif kind != field.dataType.simpleString():
            problems.append((name, "column type", f"{field.name}: {kind}"))
    schema = spark.createDataFrame(problems, "event_class string, problem string, detail string")
    zone = zones(spark, root, name).select("file", "trace_id", F.struct("rows", "first_qpc", "last_qpc").alias("said"))
    listed = _listed(spark, path)
    if listed is None:
        return schema.union(zone.select("file").distinct().select(F.lit(name), F.lit("missing or damaged file"), "file"))
    # the reader skips a damaged file, so it shows up as missing
    readable = spark.read.schema(event_schema(name)).option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").parquet(path)
    current = _zones_of(readable, _short_name()).select("file", "trace_id", F.struct("rows", "first_qpc", "last_qpc").alias("is"))
    named = zone.select("file").distinct().withColumn("_named", F.lit(True))
    stray = listed.join(named, "file", "left").where("_named IS NULL").select("file", F.lit("stray file").alias("problem"))
    held = current.select("file").distinct().withColumn("_held", F.lit(True))
    gone = named.join(held, "file", "left").where("_held IS NULL").select("file", F.lit("missing or damaged file").alias("problem"))
    both = zone.join(current, ["file", "trace_id"], "full").join(named, "file").join(held, "file")
    unlike = both.where(~F.col("said").eqNullSafe(F.col("is"))).select("file", F.lit("rows or ticks").alias("problem")).distinct()
    files = reduce(DataFrame.union, [stray, gone, unlike])
    return schema.union(files.select(F.lit(name), "problem", "file"))


def _listed(spark: SparkSession, path: str) -> DataFrame | None:
    """Run and name of every data file below a path; contents are not read."""
    try:
        found = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in (error.getCondition() or ""):
            raise
        return None
    return found.select(F.regexp_extract("path", r"([^/]+/[^/]+)$", 1).alias("file"))


def stored_traces(spark: SparkSession, root: str) -> DataFrame:
    """Traces of a store with the files, rows and tick range of each class."""
    files, place = folder_of(spark, f"{root.rstrip('/')}/{ZONES}")
    names = sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []
    parts = [dataset_statistics(spark, root, n).select("trace_id", F.lit(n).alias("event_class"), "files", "rows", "first_qpc", "last_qpc") for n in names]
    empty = spark.createDataFrame([], "trace_id string, event_class string, files bigint, rows bigint, first_qpc bigint, last_qpc bigint")
    return reduce(DataFrame.union, parts, empty)


def list_traces(spark: SparkSession, folder: str, pattern: str = "*.etl") -> DataFrame:
    """Trace files in a folder with size, time of change and trace id; contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        .select("path", "length", "modificationTime")
    )
    return files.select(
        trace_identity("path", "length", "modificationTime").alias("trace_id"),
        "path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def trace_info(tables: Mapping[str, DataFrame], meta: DataFrame) -> DataFrame:
    """Loaded traces with their clock and the rows of each event class."""
    from ..operators.report import class_counts

    return class_counts(dict(tables)).join(meta, "trace_id", "left")
