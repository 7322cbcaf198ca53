"""Prefix scan of clamped steps over the slices of many keys, in blocks of blocks.

A step moves a number: ``x -> min(max(x + k, low), high)``. Two steps in a row are again such a step, so
the state before every slice follows from a tree: slices fold into blocks of ``BLOCK``, blocks into blocks
of blocks, and states come down again through the prefixes that each level kept. No task sees more than
one block of a key, and the number of levels is the logarithm of the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .replay import Rows, key_runs, scan_sorted

BLOCK = 1024
FAR = 1 << 61  # a bound that no count reaches
STEP = ("_k", "_low", "_high")


def compose(first: tuple[int, int, int], then: tuple[int, int, int]) -> tuple[int, int, int]:
    """The step that does ``first`` and ``then`` in a row."""
    k, low, high = then

    def clamp(x: int) -> int:
        return min(max(x + k, low), high)

    return first[0] + k, clamp(first[1]), clamp(first[2])


def _applied(x: Column) -> Column:
    return F.least(F.greatest(x + F.col("_pk"), F.col("_plow")), F.col("_phigh"))


def states_before(steps: DataFrame, keys: Sequence[str], position: str, *, block: int | None = None) -> DataFrame:
    """``keys``, ``position`` and ``_state``, the state before each step of a key that starts at 0.

    ``steps`` has one row per key and whole-number ``position``, with ``_k``, ``_low`` and ``_high``; null
    bounds do not bind. Keys are not null.
    """
    block = block or BLOCK
    kinds = {f.name: f.dataType.simpleString() for f in steps.schema.fields}
    key_schema = "".join(f"`{k}` {kinds[k]}, " for k in keys)
    part = [*keys, "_block"]

    def prefixes(batches):
        out = Rows([*keys, "_at", "_block", "_pk", "_plow", "_phigh", *STEP, "_last"])
        for found, run in key_runs(batches, part, ["_at", *STEP]):
            done = (0, -FAR, FAR)
            last = len(run["_at"]) - 1
            for i, (at, *step) in enumerate(zip(run["_at"], *[run[c] for c in STEP], strict=True)):
                after = compose(done, tuple(step))
                for name, value in zip(out.columns, (*found[:-1], at, found[-1], *done, *after, i == last), strict=True):
                    out.lists[name].append(value)
                done = after
            if out.full():
                yield out.take()
        yield out.take()

    schema = f"{key_schema}_at bigint, _block bigint, _pk bigint, _plow bigint, _phigh bigint, _k bigint, _low bigint, _high bigint, _last boolean"
    low, high = F.coalesce("_low", F.lit(-FAR)), F.coalesce("_high", F.lit(FAR))
    current = durable(steps.select(*keys, F.col(position).cast("bigint").alias("_at"), F.col("_k").cast("bigint").alias("_k"), low.alias("_low"), high.alias("_high")))
    first, last = current.agg(F.min("_at"), F.max("_at")).first()
    first, span = first or 0, (last or 0) - (first or 0) + 1
    levels = []
    while True:
        inside = current.withColumn("_block", F.floor((F.col("_at") - first) / block))
        level = scan_sorted(inside, part, ["_at"], prefixes, schema)
        levels.append(level := durable(level))
        if span <= block:
            break
        current = level.where("_last").select(*keys, F.col("_block").alias("_at"), *STEP)
        first, span = 0, -(-span // block)
    states = levels[-1].select(*keys, "_at", _applied(F.lit(0)).alias("_state"))
    for level in reversed(levels[:-1]):
        above = states.select(*keys, F.col("_at").alias("_block"), F.col("_state").alias("_above"))
        states = level.join(above, part).select(*keys, "_at", _applied(F.col("_above")).alias("_state"))
    return states.withColumnRenamed("_at", position)
