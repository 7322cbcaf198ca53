"""Call stacks: inclusive and exclusive weights, call edges and walks over them.

Stacks are arrays of addresses, leaf first. ``names`` maps ``(trace_id, address)`` to
``module, function`` (see ``attribution.resolve_addresses``).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import drop_shuffles, durable
from .cpu import with_denominator
from .filters import contains_text, matches_module, minimum_share
from .grouping import top

UNNAMED = ("<unknown>", "")  # module and function of an address without a name
POLICIES = ("dominant", "all", "threshold")


def _whole_stacks(samples: DataFrame, weight: str) -> DataFrame:
    """Equal stacks summed before any frame is exploded."""
    return (
        samples.where(F.size("stack") > 0)
        .groupBy("trace_id", "stack").agg(F.sum(weight).alias("weight"))
    )


def _named(df: DataFrame, names: DataFrame, address: str, prefix: str = "") -> DataFrame:
    renamed = names.select(
        "trace_id", F.col("address").alias(address),
        F.col("module").alias(f"{prefix}module"), F.col("function").alias(f"{prefix}function"),
    )
    return df.join(renamed, ["trace_id", address], "left").withColumns({
        f"{prefix}module": F.coalesce(f"{prefix}module", F.lit(UNNAMED[0])),
        f"{prefix}function": F.coalesce(f"{prefix}function", F.lit(UNNAMED[1])),
    })


def _numbered(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Functions with a number each, and the number of the function at each address: null for what has no name."""
    named = names.select("trace_id", "address", F.coalesce("module", F.lit(UNNAMED[0])).alias("module"), F.coalesce("function", F.lit(UNNAMED[1])).alias("function"))
    function = ["trace_id", "module", "function"]
    unnamed = (F.col("module") == UNNAMED[0]) & (F.col("function") == UNNAMED[1])
    functions = durable(named.where(~unnamed).select(*function).distinct().withColumn("_function", F.monotonically_increasing_id()))
    return functions, durable(named.join(functions, function, "left").select("trace_id", "address", "_function"))


def stack_weights(
    samples: DataFrame, names: DataFrame, *, weight: str = "weight", distinct: str = "address"
) -> DataFrame:
    """Inclusive and exclusive weight per function, with its exclusive share of the trace.

    Each distinct address of a stack counts once, so two addresses of one function count twice;
    ``distinct='function'`` counts each function of a stack once.
    """
    stacks = _whole_stacks(samples, weight)
    if distinct == "function":
        # stacks and functions go by number: whole stacks and names with every frame would fill the disk
        stacks = durable(stacks.withColumn("_stack", F.monotonically_increasing_id()))
        functions, numbers = _numbered(names)
        drop_shuffles(stacks.sparkSession)
        frames = stacks.select("trace_id", "_stack", "weight", F.explode(F.array_distinct("stack")).alias("address"))
        once = frames.join(numbers, ["trace_id", "address"], "left").select("trace_id", "_stack", "_function", "weight").distinct()
        per_function = once.groupBy("trace_id", "_function").agg(F.sum("weight").alias("inclusive"))
        inclusive = per_function.join(functions.drop("trace_id"), "_function", "left").select(
            "trace_id", F.coalesce("module", F.lit(UNNAMED[0])).alias("module"), F.coalesce("function", F.lit(UNNAMED[1])).alias("function"),
            "inclusive", F.lit(0).cast("bigint").alias("exclusive"),
        )
        leaves = stacks.groupBy("trace_id", F.get("stack", F.lit(0)).alias("address")).agg(F.sum("weight").alias("exclusive"))
        exclusive = _named(leaves, names, "address").select(
            "trace_id", "module", "function", F.lit(0).cast("bigint").alias("inclusive"), "exclusive"
        )
        rows = inclusive.unionByName(exclusive)
    else:
        # one pass: a frame carries its weight inclusively, the leaf exclusively as well
        frames = stacks.select(
            "trace_id", "weight", F.get("stack", F.lit(0)).alias("_leaf"),
            F.explode(F.array_distinct("stack")).alias("address"),
        )
        per_address = frames.groupBy("trace_id", "address").agg(
            F.sum("weight").alias("inclusive"),
            F.sum(F.when(F.col("address") == F.col("_leaf"), F.col("weight")).otherwise(F.lit(0))).alias("exclusive"),
        )
        rows = _named(per_address, names, "address")
    sums = rows.groupBy("trace_id", "module", "function").agg(
        F.sum("inclusive").alias("inclusive"), F.sum("exclusive").alias("exclusive")
    )
    totals = sums.groupBy("trace_id").agg(F.sum("exclusive").alias("_all"))
    return sums.join(totals, "trace_id").withColumn(
        "total_pct", F.round(F.col("exclusive") / F.col("_all") * 100.0, 2)
    ).drop("_all")


def call_edges(
    samples: DataFrame, names: DataFrame, *, weight: str = "weight", weights: DataFrame | None = None
) -> DataFrame:
    """Self, caller and callee rows between functions.

    Adjacent frames are counted as often as they occur. ``total_pct`` is of the trace's
    exclusive weight, ``parent_pct`` of the target's inclusive weight.
    """
    stacks = _whole_stacks(samples, weight).where(F.size("stack") > 1)
    n = F.size("stack")
    pairs = F.explode(F.arrays_zip(
        F.slice("stack", F.lit(1), n - 1).alias("callee"), F.slice("stack", F.lit(2), n - 1).alias("caller")
    ))
    by_address = (
        stacks.select("trace_id", "weight", pairs.alias("_p"))
        .groupBy("trace_id", F.col("_p.callee").alias("_callee"), F.col("_p.caller").alias("_caller"))
        .agg(F.sum("weight").alias("weight"))
    )
    ends = _named(_named(by_address, names, "_callee", "t_"), names, "_caller", "c_")
    edges = ends.groupBy("trace_id", "t_module", "t_function", "c_module", "c_function").agg(
        F.sum("weight").alias("weight")
    )
    if weights is None:
        weights = stack_weights(samples, names, weight=weight)
    totals = weights.groupBy("trace_id").agg(F.sum("exclusive").alias("_all"))

    def rows(df: DataFrame, target: tuple[str, str], other: tuple[str, str], direction: str) -> DataFrame:
        return df.select(
            "trace_id",
            F.col(target[0]).alias("target_module"), F.col(target[1]).alias("target_function"),
            F.lit(direction).alias("direction"),
            F.col(other[0]).alias("caller_module"), F.col(other[1]).alias("caller_function"), "weight",
        )

    caller = rows(edges, ("t_module", "t_function"), ("c_module", "c_function"), "caller")
    callee = rows(edges, ("c_module", "c_function"), ("t_module", "t_function"), "callee")
    own = rows(
        weights.withColumn("weight", F.col("inclusive")), ("module", "function"), ("module", "function"), "self"
    )
    nodes = weights.select(
        "trace_id", F.col("module").alias("target_module"), F.col("function").alias("target_function"),
        F.col("inclusive").alias("_inclusive"), "exclusive",
    )
    joined = (
        caller.unionByName(callee).unionByName(own)
        .join(nodes, ["trace_id", "target_module", "target_function"], "left")
        .join(totals, "trace_id", "left")
    )
    parent = F.when(F.coalesce(F.col("_inclusive"), F.lit(0)) > 0, F.col("_inclusive")).otherwise(F.col("weight"))
    return joined.withColumns({
        "total_pct": F.round(F.col("weight") / F.col("_all") * 100.0, 2),
        "parent_pct": F.when(F.col("direction") == "self", F.lit(100.0))
        .otherwise(F.round(F.col("weight") / parent * 100.0, 2)),
        "exclusive": F.coalesce("exclusive", F.lit(0)),
    }).drop("_inclusive", "_all")


def stack_aggregates(
    samples: DataFrame, names: DataFrame, *, weight: str = "weight", keep: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Function weights and call edges; ``keep`` writes them once for many queries."""
    weights = stack_weights(samples, names, weight=weight)
    weights = durable(weights) if keep else weights
    edges = call_edges(samples, names, weight=weight, weights=weights)
    return weights, durable(edges) if keep else edges


def hot_stacks(
    weights: DataFrame, *, module_filter: str | None = None, function_filter: str | None = None,
    min_weight_pct: float = 1.0, denominator: str = "trace", usage: DataFrame | None = None,
    lps: int | None = None, seconds: float | None = None, limit: int | None = None,
) -> DataFrame:
    """Functions by inclusive weight, pruned below a share of the denominator.

    The denominator is the sum of exclusive weight of the trace.
    """
    totals = with_denominator(
        weights.groupBy("trace_id").agg(F.sum("exclusive").alias("_all")), usage,
        base="_all", denominator=denominator, lps=lps, seconds=seconds,
    ).select("trace_id", "denominator")
    rows = weights
    if module_filter not in (None, ""):
        rows = rows.where(matches_module(F.col("module"), module_filter))
    if function_filter:
        rows = rows.where(contains_text(F.col("function"), function_filter))
    rows = minimum_share(rows.join(totals, "trace_id"), "inclusive", "denominator", min_weight_pct)
    rows = rows.withColumns({
        "inclusive_pct": F.col("inclusive") / F.col("denominator") * 100.0,
        "exclusive_pct": F.col("exclusive") / F.col("denominator") * 100.0,
    })
    return rows if limit is None else top(rows, "inclusive", limit, ["trace_id", "module", "function"])


def flat_stacks(
    samples: DataFrame, *, module_filter: str | None = None, function_filter: str | None = None,
    min_weight_pct: float = 1.0,
) -> DataFrame:
    """Exclusive weights from plain samples, for traces without stacks."""
    totals = samples.groupBy("trace_id").agg(F.sum("weight").cast("double").alias("denominator"))
    rows = samples
    if module_filter not in (None, ""):
        rows = rows.where(contains_text(F.col("module"), module_filter))
    if function_filter:
        rows = rows.where(contains_text(F.col("function"), function_filter))
    sums = rows.groupBy("trace_id", "module", "function").agg(F.sum("weight").alias("weight"))
    sums = minimum_share(sums.join(totals, "trace_id"), "weight", "denominator", min_weight_pct)
    return sums.withColumn("pct", F.col("weight") / F.col("denominator") * 100.0)


def best_node(weights: DataFrame, function_filter: str, module_filter: str | None = None) -> DataFrame:
    """Per trace, the function with the highest inclusive weight that matches the text."""
    rows = weights.where(contains_text(F.col("function"), function_filter))
    if module_filter not in (None, ""):
        rows = rows.where(matches_module(F.col("module"), module_filter))
    return rows.groupBy("trace_id").agg(
        F.max_by(F.struct("module", "function", "inclusive"), F.struct("inclusive", "module", "function")).alias("_n")
    ).select("trace_id", "_n.*")


def function_relations(
    edges: DataFrame, function_filter: str, *, module_filter: str | None = None, direction: str = "callers",
    weights: DataFrame | None = None, denominator: str = "trace", usage: DataFrame | None = None,
    lps: int | None = None, seconds: float | None = None,
) -> DataFrame:
    """Callers or callees of the matching functions, as shares of the relation's total.

    Functions that match as a target are used; a trace without one is searched for the text on
    the other end of its edges (``matched_as`` tells which). With the ``weights`` of the functions each
    edge also has its share of a ``denominator``; a CPU filter enters through ``usage``.
    """
    kinds = {"callers": ["caller"], "callees": ["callee"], "both": ["caller", "callee"]}[direction]

    def matching(module: str, function: str) -> Column:
        found = contains_text(F.col(function), function_filter)
        return found & matches_module(F.col(module), module_filter) if module_filter else found

    centre = edges.where(matching("target_module", "target_function"))
    related = edges.where(matching("caller_module", "caller_function")).join(
        centre.select("trace_id").distinct(), "trace_id", "left_anti"
    )
    rows = (
        centre.withColumn("matched_as", F.lit("target"))
        .unionByName(related.withColumn("matched_as", F.lit("other")))
        .where(F.col("direction").isin(kinds))
    )
    totals = rows.groupBy("trace_id").agg(F.sum("weight").alias("relation_weight"))
    shared = rows.join(totals, "trace_id").withColumn("relation_pct", F.col("weight") / F.col("relation_weight") * 100.0).select(
        "trace_id", "target_module", "target_function", "direction", "caller_module",
        "caller_function", "weight", "relation_weight", "relation_pct", "matched_as",
    )
    if weights is None:
        return shared
    whole = with_denominator(
        weights.groupBy("trace_id").agg(F.sum("exclusive").alias("_all")), usage,
        base="_all", denominator=denominator, lps=lps, seconds=seconds,
    ).select("trace_id", "denominator")
    return shared.join(whole, "trace_id").withColumn("denominator_pct", F.col("weight") / F.col("denominator") * 100.0)


def _key(module: str, function: str) -> Column:
    return F.concat(F.lower(module), F.lit("!"), F.lower(function))


WALK_ROWS = 10_000_000


def walk_stack(
    weights: DataFrame, edges: DataFrame, function_filter: str, *, module_filter: str | None = None,
    direction: str = "callers", branch_policy: str = "dominant", branch_threshold_pct: float = 5.0,
    max_depth: int | None = None, max_rows: int | None = WALK_ROWS, stop_at_modules: Sequence[str] = (),
) -> DataFrame:
    """Breadth-first walk over call edges from the best matching function.

    A frame is not visited twice on one path. ``dominant`` follows the heaviest edge, ``threshold``
    the edges with at least the given share, ``all`` every edge. One distributed join per level;
    each level is written so that a lost executor costs no more than that level. The walk ends
    when a level has no row, or at ``max_depth`` where one is given. Paths of ``dominant`` are at most as
    long as there are functions; those of the other policies may be as many as there are orders of
    them, so a walk of more than ``max_rows`` rows is an error.
    """
    if branch_policy not in POLICIES:
        raise ValueError("branch_policy must be one of: " + ", ".join(POLICIES))
    if direction not in ("callers", "callees"):
        raise ValueError("direction must be one of: callers, callees")
    node = ["trace_id", "_key"]
    fan = Window.partitionBy(*node)
    # the edges of one function: at most one row per function it is adjacent to
    links = (
        edges.where(F.col("direction") == direction[:-1])
        .withColumn("_key", _key("target_module", "target_function"))
        .select(
            *node, F.col("caller_module").alias("module"), F.col("caller_function").alias("function"),
            F.col("weight").alias("frame_hits"), "parent_pct",
            F.count(F.lit(1)).over(fan).alias("siblings"),
            (F.col("weight") / F.sum("weight").over(fan) * 100.0).alias("_share"),
            F.row_number().over(
                fan.orderBy(F.col("weight").desc(), "caller_module", "caller_function")
            ).alias("_rank"),
        )
    )
    if branch_policy == "dominant":
        links = links.where(F.col("_rank") == 1)
    elif branch_policy == "threshold":
        links = links.where(F.col("_share") >= branch_threshold_pct)
    links = durable(links.select(  # read by every level
        *node, "module", "function", "frame_hits", "siblings",
        F.when(F.col("parent_pct") > 0, F.col("parent_pct")).otherwise(F.col("_share")).alias("parent_pct"),
    ))
    root = best_node(weights, function_filter, module_filter).select(
        "trace_id", F.lit(0).alias("depth"), "module", "function",
        F.col("inclusive").cast("bigint").alias("frame_hits"), F.lit(100.0).alias("parent_pct"),
        F.col("inclusive").cast("double").alias("_hits"), F.lit(0).cast("bigint").alias("siblings"),
        F.array(_key("module", "function")).alias("_path"),
    )
    columns = root.columns
    level, levels, seen = root, [root], 0
    stops = [m.lower() for m in stop_at_modules]
    for depth in count() if max_depth is None else range(max_depth):
        at = level
        if depth > 0 and stops:
            at = at.where(~F.lower("module").isin(stops))
        at = at.select("trace_id", F.element_at("_path", -1).alias("_key"), F.col("_hits").alias("_from"), "_path")
        level = (
            at.join(links, node)
            .withColumn("_next", _key("module", "function"))
            .where(~F.array_contains("_path", F.col("_next")))
            .select(
                "trace_id", F.lit(depth + 1).alias("depth"), "module", "function",
                F.col("frame_hits").cast("bigint").alias("frame_hits"), "parent_pct",
                F.when(F.col("_from") != 0, F.col("_from") * F.col("parent_pct") / 100.0)
                .otherwise(F.col("frame_hits").cast("double")).alias("_hits"),
                F.col("siblings").cast("bigint").alias("siblings"),
                F.concat("_path", F.array("_next")).alias("_path"),
            )
        ).select(*columns)
        level = durable(level)
        found = level.count()
        if found == 0:
            break
        levels.append(level)
        seen += found
        if max_rows is not None and seen > max_rows:
            raise ValueError(f"the walk has more than {max_rows} rows; raise max_rows or the threshold, or give max_depth")
    rows = reduce(DataFrame.unionByName, levels)
    return rows.select(
        "trace_id", "depth", "module", "function", "frame_hits", "parent_pct",
        F.bround("_hits").cast("bigint").alias("chain_hits"), "siblings",
        F.array_join("_path", " < ").alias("path"),
    )


def call_chain(
    weights: DataFrame, edges: DataFrame, function_filter: str, *, direction: str = "callers",
    denominator: str = "active_cpus", usage: DataFrame | None = None, lps: int | None = None,
    seconds: float | None = None, **walk,
) -> DataFrame:
    """Walks in one or both directions with each frame's share of a denominator."""
    directions = ("callers", "callees") if direction == "both" else (direction,)
    rows = reduce(DataFrame.unionByName, [
        walk_stack(weights, edges, function_filter, direction=d, **walk).withColumn("direction", F.lit(d))
        for d in directions
    ])
    totals = with_denominator(
        weights.groupBy("trace_id").agg(F.sum("exclusive").alias("_all")), usage,
        base="_all", denominator=denominator, lps=lps, seconds=seconds,
    ).select("trace_id", "denominator")
    return rows.join(totals, "trace_id").withColumn(
        "denominator_pct", F.col("frame_hits") / F.col("denominator") * 100.0
    )


def split_frame_ref(ref: str | Sequence[str]) -> tuple[str | None, str]:
    """``module!function``, a bare function or a pair."""
    if isinstance(ref, str):
        module, bang, function = ref.partition("!")
        return (module.strip() or None, function.strip()) if bang else (None, ref.strip())
    module, function = ref
    return module.strip() or None, function.strip()


def _frame_weight(weights: DataFrame, ref: tuple[str | None, str], out: str) -> DataFrame:
    rows = weights.where(contains_text(F.col("function"), ref[1]))
    if ref[0]:
        rows = rows.where(matches_module(F.col("module"), ref[0]))
    return rows.groupBy("trace_id").agg(F.max("inclusive").cast("double").alias(out))


def _best_edge(edges: DataFrame, source, target, out: str) -> DataFrame:
    rows = edges.where(
        (F.col("direction") == "caller")
        & contains_text(F.col("target_function"), source[1])
        & contains_text(F.col("caller_function"), target[1])
    )
    for module, ref in (("target_module", source), ("caller_module", target)):
        if ref[0]:
            rows = rows.where(matches_module(F.col(module), ref[0]))
    return rows.groupBy("trace_id").agg(
        F.max_by(F.struct("weight", "parent_pct"), F.struct("weight", "parent_pct")).alias(out)
    )


def _ordered_estimate(weights: DataFrame, edges: DataFrame, refs, out: str) -> DataFrame:
    traces = weights.select("trace_id").distinct()
    if len(refs) == 1:
        return traces.join(_frame_weight(weights, refs[0], out), "trace_id", "left").fillna(0.0, [out])
    rows, product = traces, None
    for i, (source, target) in enumerate(zip(refs, refs[1:])):
        rows = rows.join(_best_edge(edges, source, target, f"_e{i}"), "trace_id", "left")
        edge = F.col(f"_e{i}")
        product = edge["weight"].cast("double") if product is None else product * edge["parent_pct"] / 100.0
    return rows.select("trace_id", F.coalesce(product, F.lit(0.0)).alias(out))


def count_stacks(
    weights: DataFrame, edges: DataFrame, contains: Sequence, *, in_order: bool = True,
    excludes: Sequence = (),
) -> DataFrame:
    """Estimated weight of stacks with the given frames, from aggregate edges.

    In order: the product of parent shares along caller edges. Otherwise the smallest inclusive
    weight of the frames. The chains that end in an excluded frame are subtracted.
    """
    refs = [split_frame_ref(r) for r in contains]
    if not refs:
        raise ValueError("contains must include at least one frame")
    if in_order:
        rows = _ordered_estimate(weights, edges, refs, "_match")
    else:
        rows = weights.select("trace_id").distinct()
        for i, ref in enumerate(refs):
            rows = rows.join(_frame_weight(weights, ref, f"_f{i}"), "trace_id", "left")
        found = [F.coalesce(f"_f{i}", F.lit(0.0)) for i in range(len(refs))]
        least = F.least(*found) if len(found) > 1 else found[0]
        rows = rows.select("trace_id", least.alias("_match"))
    rows = rows.withColumn("_excluded", F.lit(0.0))
    for i, ref in enumerate(map(split_frame_ref, excludes)):
        extra = _ordered_estimate(weights, edges, [*refs, ref], f"_x{i}")
        rows = rows.join(extra, "trace_id", "left").withColumn(
            "_excluded", F.col("_excluded") + F.coalesce(f"_x{i}", F.lit(0.0))
        ).drop(f"_x{i}")
    totals = weights.groupBy("trace_id").agg(F.sum("exclusive").alias("_all"))
    matched = F.greatest(F.col("_match") - F.col("_excluded"), F.lit(0.0))
    return rows.join(totals, "trace_id").select(
        "trace_id",
        F.bround(matched).cast("bigint").alias("matching"),
        (matched / F.col("_all") * 100.0).alias("pct"),
        F.bround("_excluded").cast("bigint").alias("excluded"),
    )


def labelled_stacks(samples: DataFrame, names: DataFrame, *, weight: str = "weight") -> DataFrame:
    """Distinct stacks with ``frames``, an array of ``module!function`` labels, and their weight."""
    stacks = _whole_stacks(samples, weight)
    frames = stacks.select("trace_id", "stack", "weight", F.posexplode("stack").alias("_at", "address"))
    named = _named(frames, names, "address")
    # a stack's frames meet again: as many rows as the stack is deep
    label = F.concat("module", F.lit("!"), "function")
    return named.groupBy("trace_id", "stack").agg(
        F.first("weight").alias("weight"),
        F.transform(F.array_sort(F.collect_list(F.struct("_at", label.alias("label")))), lambda x: x["label"]).alias("frames"),
    )


def count_stacks_exact(
    stacks: DataFrame, contains: Sequence, *, in_order: bool = True, excludes: Sequence = ()
) -> DataFrame:
    """Exact weight of labelled stacks with the given frames (adjacent where in order)."""

    def hit(label: Column, ref: tuple[str | None, str]) -> Column:
        module, function = F.split_part(label, F.lit("!"), F.lit(1)), F.regexp_extract(label, "^[^!]*!(.*)$", 1)
        found = contains_text(function, ref[1])
        return found & contains_text(module, ref[0]) if ref[0] else found

    refs = [split_frame_ref(r) for r in contains]
    frames = F.col("frames")

    def has(ref: tuple[str | None, str]) -> Column:
        return F.exists(frames, lambda label: hit(label, ref))

    if in_order:
        starts = F.sequence(F.lit(0), F.size(frames) - len(refs))
        chain = F.exists(starts, lambda i: reduce(
            lambda a, b: a & b, [hit(F.get(frames, i + k), ref) for k, ref in enumerate(refs)]
        ))
        matched = (F.size(frames) >= len(refs)) & F.when(F.size(frames) >= len(refs), chain).otherwise(F.lit(False))
    else:
        matched = reduce(lambda a, b: a & b, [has(ref) for ref in refs])
    barred = reduce(lambda a, b: a | b, [has(split_frame_ref(r)) for r in excludes], F.lit(False))
    return stacks.groupBy("trace_id").agg(
        F.sum(F.when(matched & ~barred, F.col("weight")).otherwise(F.lit(0))).alias("matching"),
        F.sum(F.when(matched & barred, F.col("weight")).otherwise(F.lit(0))).alias("excluded"),
        F.sum("weight").alias("total"),
    )
