"""Ordered computations over long key sequences, cut into time slices.

A plain ``Window.partitionBy(key)`` sends a whole key to one task. Event sequences of one key
(a busy thread, a busy flow) can hold a large share of all rows, so the functions here
partition by ``(key, time slice)`` instead and carry what crosses a slice border through a
small table with one row per key and slice. The result is the same as that of the plain
window; the size of a task is bounded by the event rate times the slice length.

Null keys are equal to each other, as in the plain window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = "_slice"
DEFAULT_SLICE_US = 10_000_000


def slice_of(ts: Column, slice_us: int) -> Column:
    return F.floor(ts / F.lit(slice_us))


def join_slices(left: DataFrame, right: DataFrame, part: Sequence[str]) -> DataFrame:
    """Left join on the slice columns; null keys are equal."""
    renamed = right.withColumnsRenamed({c: f"_on_{c}" for c in part})
    same = [F.col(c).eqNullSafe(F.col(f"_on_{c}")) for c in part]
    return left.join(renamed, same, "left").drop(*[f"_on_{c}" for c in part])


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    previous: Mapping[str, str] | None = None,
    following: Mapping[str, str] | None = None,
    ts: str = "ts_us",
    slice_us: int = DEFAULT_SLICE_US,
    slice_by: str | None = None,
) -> DataFrame:
    """Add columns of the previous / following row of the same key.

    ``previous`` and ``following`` map output names to source columns. ``order`` must be unique
    within a key and start with ``ts``, or agree with the slice column named by ``slice_by``.
    """
    previous, following = dict(previous or {}), dict(following or {})
    cut = F.col(slice_by) if slice_by else slice_of(F.col(ts), slice_us)
    inside = Window.partitionBy(*keys, SLICE).orderBy(*order)

    def packed(names: Mapping[str, str]) -> Column:
        return F.struct(*[F.col(source).alias(out) for out, source in names.items()])

    # first and last rows of a slice are those that lack a neighbour inside it
    wanted = {"_prev": F.lag(packed(previous)).over(inside)} if previous else {}
    wanted |= {"_next": F.lead(packed(following)).over(inside)} if following else {}
    sliced = df.withColumn(SLICE, cut).withColumns({
        **wanted, "_border": F.lag(F.lit(1)).over(inside).isNull() | F.lead(F.lit(1)).over(inside).isNull()})
    # both parts read one shuffle; the few border rows find their neighbours among themselves
    across = Window.partitionBy(*keys).orderBy(SLICE, *order)
    border = sliced.where("_border").withColumns({
        **({"_prev": F.coalesce("_prev", F.lag(packed(previous)).over(across))} if previous else {}),
        **({"_next": F.coalesce("_next", F.lead(packed(following)).over(across))} if following else {}),
    })
    joined = sliced.where("NOT _border").unionByName(border)
    out = [F.col(name) for name in df.columns]
    out += [F.col("_prev")[name].alias(name) for name in previous]
    out += [F.col("_next")[name].alias(name) for name in following]
    return joined.select(*out)


def with_running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, str],
    *,
    ts: str = "ts_us",
    slice_us: int = DEFAULT_SLICE_US,
    slice_by: str | None = None,
    floor_at_zero: Mapping[str, str] | None = None,
) -> DataFrame:
    """Add running sums up to and including each row.

    ``floor_at_zero`` maps output names to step columns whose running sum is held at zero
    whenever it would go below: ``S - least(0, running minimum of S)``.
    """
    floored = dict(floor_at_zero or {})
    steps = {**{f"_s_{o}": c for o, c in sums.items()}, **{f"_s_{o}": c for o, c in floored.items()}}
    sliced = df.withColumn(SLICE, F.col(slice_by) if slice_by else slice_of(F.col(ts), slice_us))
    part = [*keys, SLICE]
    inside = (
        Window.partitionBy(*part).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.select("*", *[F.sum(c).over(inside).alias(n) for n, c in steps.items()])
    local = local.select(
        "*", *[F.min(f"_s_{o}").over(inside).alias(f"_m_{o}") for o in floored]
    )
    totals = local.groupBy(*part).agg(
        *[F.sum(c).alias(f"_t{n}") for n, c in steps.items()],
        *[F.min(f"_s_{o}").alias(f"_l_{o}") for o in floored],
    )
    totals = totals.select(
        "*", *[F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)).alias(f"_b{n}") for n in steps]
    )
    totals = totals.select(
        *part,
        *[f"_b{n}" for n in steps],
        *[F.min(F.col(f"_b_s_{o}") + F.col(f"_l_{o}")).over(before).alias(f"_lo_{o}") for o in floored],
    )
    joined = join_slices(local, totals, part)
    out = [F.col(name) for name in df.columns]
    out += [(F.col(f"_b_s_{o}") + F.col(f"_s_{o}")).alias(o) for o in sums]
    for o in floored:
        running = F.col(f"_b_s_{o}") + F.col(f"_s_{o}")
        lowest = F.least(F.lit(0), F.col(f"_lo_{o}"), F.col(f"_b_s_{o}") + F.col(f"_m_{o}"))
        out.append((running - lowest).alias(o))
    return joined.select(*out)


def fill_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    fills: Mapping[str, str],
    *,
    slice_by: str,
) -> DataFrame:
    """Add, per output name, the last value of the source column that is not null so far."""
    sliced = df.withColumn(SLICE, F.col(slice_by))
    part = [*keys, SLICE]
    inside = (
        Window.partitionBy(*part).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    before = (
        Window.partitionBy(*keys).orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    position = F.struct(*order)
    ends = sliced.groupBy(*part).agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_e_{o}") for o, c in fills.items()]
    ).select(*part, *[F.last(f"_e_{o}", ignorenulls=True).over(before).alias(f"_c_{o}") for o in fills])
    filled = sliced.select(
        "*", *[F.last(c, ignorenulls=True).over(inside).alias(f"_f_{o}") for o, c in fills.items()]
    )
    return join_slices(filled, ends, part).select(
        *df.columns, *[F.coalesce(f"_f_{o}", f"_c_{o}").alias(o) for o in fills]
    )
