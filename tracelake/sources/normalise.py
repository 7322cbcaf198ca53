"""Bring producer tables into the event schemas."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import to_bits
from ..schemas import CLASS_SPELLINGS, FIELD_SPELLINGS, canonical_event_class, event_schema


def class_of(name: Column) -> Column:
    """Event class of a spelling column; null for spellings that are not known."""
    table = F.create_map(*[F.lit(x) for pair in CLASS_SPELLINGS.items() for x in pair])
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "_df$", ""), "[^a-z0-9]", "")
    return F.try_element_at(table, plain)


def _coerce(value: Column, source: T.DataType, target: T.DataType) -> Column:
    if isinstance(target, T.ArrayType):
        if not isinstance(source, T.ArrayType):
            return F.lit(None).cast(target)
        if isinstance(source.elementType, T.DecimalType):
            return F.transform(value, to_bits)
        return F.transform(value, lambda x: x.cast("bigint"))
    if isinstance(target, T.LongType) and isinstance(source, T.DecimalType):
        return to_bits(value)
    if isinstance(target, T.LongType) and isinstance(source, T.StringType):
        return to_bits(value.try_cast("decimal(20,0)"))
    if isinstance(source, T.StringType) and not isinstance(target, T.StringType):
        return value.try_cast(target)
    return value.cast(target)


def normalise(df: DataFrame, event_class: str) -> DataFrame:
    """Map field spellings, coerce types and wrap unsigned values; other columns are dropped.

    The first spelling present wins, missing fields are null.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    fields = []
    for field in event_schema(event_class).fields:
        names = [field.name, *FIELD_SPELLINGS.get(field.name, ())]
        found = next((n for n in names if n in kinds), None)
        if found is None:
            fields.append(F.lit(None).cast(field.dataType).alias(field.name))
        else:
            fields.append(_coerce(F.col(f"`{found}`"), kinds[found], field.dataType).alias(field.name))
    return df.select(*fields)


def union_opcodes(tables: Mapping[str, DataFrame], event_class: str) -> DataFrame:
    """Per-opcode tables (``Process/Start``, ``Process/End``, ...) as one class with ``type``."""
    name = canonical_event_class(event_class)
    out = None
    for spelling, table in tables.items():
        opcode = spelling.rsplit("/", 1)[-1]
        rows = normalise(table, name)
        if "type" in rows.columns:
            rows = rows.withColumn("type", F.coalesce("type", F.lit(opcode)))
        if "kind" in rows.columns:
            rows = rows.withColumn("kind", F.coalesce("kind", F.lit(opcode)))
        out = rows if out is None else out.unionByName(rows)
    return out


def with_start_tick(interrupts: DataFrame, freq: Column) -> DataFrame:
    """Fill the start tick of interrupts from end tick and duration in microseconds."""
    start = (F.col("qpc") - F.bround(F.col("duration_us") * freq / 1e6)).cast("bigint")
    return interrupts.withColumn("initial_qpc", F.coalesce("initial_qpc", start))
