"""Queries of the call-stack operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cpu, filters, stacks
from ..sources.export import chain_table
from .cpu_queries import DAY_S, RATE
from .registry import query

WEIGHTS = """ex AS (SELECT trace_id, l_orderkey, weight, unnest(stack) AS address, generate_subscripts(stack, 1) AS i FROM stacks),
sw AS (
  SELECT d.trace_id, n.module, n.function, CAST(sum(d.weight) AS BIGINT) AS inclusive,
         CAST(sum(CASE WHEN d.leaf THEN d.weight ELSE 0 END) AS BIGINT) AS exclusive
  FROM (SELECT trace_id, l_orderkey, address, any_value(weight) AS weight, min(i) = 1 AS leaf FROM ex GROUP BY trace_id, l_orderkey, address) d
  JOIN frame_names n ON n.trace_id = d.trace_id AND n.address = d.address GROUP BY ALL),
tot AS (SELECT trace_id, sum(exclusive) AS total FROM sw GROUP BY trace_id)"""
EDGES = f"""{WEIGHTS}, pair_ AS (
  SELECT a.trace_id, n.module AS tm, n.function AS tf, m.module AS cm, m.function AS cf, CAST(sum(a.weight) AS BIGINT) AS weight
  FROM ex a JOIN ex b ON b.trace_id = a.trace_id AND b.l_orderkey = a.l_orderkey AND b.i = a.i + 1
  JOIN frame_names n ON n.trace_id = a.trace_id AND n.address = a.address
  JOIN frame_names m ON m.trace_id = b.trace_id AND m.address = b.address GROUP BY ALL),
rows_ AS (
  SELECT trace_id, tm, tf, 'caller' AS direction, cm, cf, weight FROM pair_
  UNION ALL SELECT trace_id, cm, cf, 'callee', tm, tf, weight FROM pair_
  UNION ALL SELECT trace_id, module, function, 'self', module, function, inclusive FROM sw),
edges_ AS (
  SELECT r.trace_id, tm AS target_module, tf AS target_function, direction, cm AS caller_module, cf AS caller_function, weight,
         round(weight * 100.0 / total, 2) AS total_pct, CASE WHEN direction = 'self' THEN 100.0 ELSE round(weight * 100.0 / inclusive, 2) END AS parent_pct, exclusive
  FROM rows_ r JOIN sw ON sw.trace_id = r.trace_id AND sw.module = tm AND sw.function = tf JOIN tot ON tot.trace_id = r.trace_id)"""


def _samples(t):
    return t["stacks"].select("trace_id", "weight", "stack")


def _aggregates(t):
    return stacks.stack_aggregates(_samples(t), t["frame_names"])


@query("stack_weights", f"""
WITH {WEIGHTS} SELECT sw.*, round(exclusive * 100.0 / total, 2) AS total_pct FROM sw JOIN tot USING (trace_id)""")
def _(t):
    return stacks.stack_weights(_samples(t), t["frame_names"])


@query("stack_weights_per_function", f"""
WITH {WEIGHTS}, f AS (
  SELECT trace_id, module, function, CAST(sum(weight) AS BIGINT) AS inclusive, CAST(sum(CASE WHEN leaf THEN weight ELSE 0 END) AS BIGINT) AS exclusive
  FROM (SELECT e.trace_id, l_orderkey, n.module, n.function, any_value(weight) AS weight, min(i) = 1 AS leaf
        FROM ex e JOIN frame_names n ON n.trace_id = e.trace_id AND n.address = e.address GROUP BY ALL) GROUP BY ALL)
SELECT f.*, round(exclusive * 100.0 / total, 2) AS total_pct FROM f JOIN tot USING (trace_id)""")
def _(t):
    return stacks.stack_weights(_samples(t), t["frame_names"], distinct="function")


@query("call_edges", f"WITH {EDGES} SELECT * FROM edges_")
def _(t):
    return _aggregates(t)[1]


HOT = """SELECT sw.trace_id, module, function, inclusive, exclusive, round(exclusive * 100.0 / total, 2) AS total_pct, CAST(total AS DOUBLE) AS denominator,
  round(inclusive * 100.0 / total, 4) AS inclusive_pct, round(exclusive * 100.0 / total, 4) AS exclusive_pct FROM sw JOIN tot ON tot.trace_id = sw.trace_id"""


@query("hot_stacks", f"WITH {WEIGHTS} {HOT} WHERE function ILIKE '%BOLT%' AND module ILIKE '%brand#1%' AND inclusive >= total * 0.2 / 100")
def _(t):
    weights = stacks.stack_weights(_samples(t), t["frame_names"])
    return stacks.hot_stacks(weights, function_filter="BOLT", module_filter="brand#1", min_weight_pct=0.2)


@query("network_hot_stacks", f"WITH {WEIGHTS} {HOT} WHERE (module ILIKE '%brand#2%' OR module ILIKE '%brand#7%') AND inclusive >= total * 0.3 / 100")
def _(t):
    weights = stacks.stack_weights(_samples(t), t["frame_names"])
    names = filters.module_set(instead=["brand#2", "brand#7"])
    return stacks.hot_stacks(weights, module_filter=names, min_weight_pct=0.3)


@query("hot_stacks_top", f"WITH {WEIGHTS} {HOT} ORDER BY inclusive DESC, sw.trace_id, module, function LIMIT 12")
def _(t):
    weights = stacks.stack_weights(_samples(t), t["frame_names"])
    return stacks.hot_stacks(weights, min_weight_pct=0, limit=12)


@query("flat_stacks", """
WITH w AS (SELECT trace_id, CAST(sum(weight) AS DOUBLE) AS total FROM labelled GROUP BY trace_id),
s AS (SELECT trace_id, module, function, CAST(sum(weight) AS BIGINT) AS weight FROM labelled WHERE module ILIKE '%.sys%' GROUP BY ALL)
SELECT s.*, total AS denominator, round(weight / total * 100.0, 4) AS pct FROM s JOIN w USING (trace_id) WHERE weight >= total * 0.5 / 100""")
def _(t):
    return stacks.flat_stacks(t["labelled"], module_filter=".sys", min_weight_pct=0.5)


@query("best_node", f"""
WITH {WEIGHTS} SELECT trace_id, arg_max(module, (inclusive, module, function)) AS module, arg_max(function, (inclusive, module, function)) AS function,
  max(inclusive) AS inclusive FROM sw WHERE function ILIKE '%widget%' AND module ILIKE '%#2%' GROUP BY trace_id""")
def _(t):
    return stacks.best_node(stacks.stack_weights(_samples(t), t["frame_names"]), "Widget", "#2")


def _relations(direction):
    return f"""
WITH {EDGES}, m AS (SELECT * FROM edges_ WHERE target_function ILIKE '%red%' AND target_module ILIKE '%brand#1%' AND direction = '{direction}')
SELECT trace_id, target_module, target_function, direction, caller_module, caller_function, weight,
  CAST(sum(weight) OVER (PARTITION BY trace_id) AS BIGINT) AS relation_weight, round(weight * 100.0 / sum(weight) OVER (PARTITION BY trace_id), 4) AS relation_pct, 'target' AS matched_as FROM m"""


@query("function_callers", _relations("caller"))
def _(t):
    return stacks.function_relations(_aggregates(t)[1], "red", module_filter="Brand#1")


@query("function_callees", _relations("callee"))
def _(t):
    return stacks.function_relations(_aggregates(t)[1], "red", module_filter="Brand#1", direction="callees")


@query("function_relations_of_active_cpus", f"""SELECT m.*, round(total / 2.0, 4) AS denominator, round(weight / (total / 2.0) * 100.0, 4) AS denominator_pct
FROM ({_relations('caller').replace("AND direction = 'caller'", "AND direction IN ('caller', 'callee')")}) m JOIN (WITH {WEIGHTS} SELECT * FROM tot) t ON t.trace_id = m.trace_id""")
def _(t):
    weights, edges = _aggregates(t)
    # twice as many CPUs as had samples: half of them idle throughout
    meta = t["meta"].withColumn("cpu_count", F.col("cpu_count") * 2)
    usage = cpu.cpu_usage_scalars(cpu.cpu_timeline(t["base"], meta, bucket_seconds=DAY_S, sample_rate_hz=RATE), meta)
    return stacks.function_relations(
        edges, "red", module_filter="Brand#1", direction="both", weights=weights, denominator="active_cpus", usage=usage)


WALK = f"""
WITH RECURSIVE {EDGES}, root AS (SELECT trace_id, arg_max(module, (inclusive, module, function)) AS module, arg_max(function, (inclusive, module, function)) AS function, max(inclusive) AS inclusive
   FROM sw WHERE function ILIKE '%bolt%' GROUP BY trace_id),
links AS (SELECT trace_id, target_module, target_function, caller_module, caller_function, weight, parent_pct,
   count(*) OVER (PARTITION BY trace_id, target_module, target_function) AS siblings,
   row_number() OVER (PARTITION BY trace_id, target_module, target_function ORDER BY weight DESC, caller_module, caller_function) AS rk
   FROM edges_ WHERE direction = 'caller'),
walk AS (
  SELECT trace_id, 0 AS depth, module, function, inclusive AS frame_hits, CAST(100.0 AS DOUBLE) AS parent_pct, CAST(inclusive AS DOUBLE) AS hits, CAST(0 AS BIGINT) AS siblings,
         [lower(module) || '!' || lower(function)] AS path FROM root
  UNION ALL
  SELECT w.trace_id, depth + 1, caller_module, caller_function, weight, l.parent_pct, hits * l.parent_pct / 100.0, l.siblings,
         list_append(path, lower(caller_module) || '!' || lower(caller_function))
  FROM walk w JOIN links l ON l.trace_id = w.trace_id AND l.target_module = w.module AND l.target_function = w.function
  WHERE l.rk <= {{rank}} AND depth < {{depth}} AND NOT list_contains(path, lower(caller_module) || '!' || lower(caller_function)))
"""
WALKED = "SELECT trace_id, depth, module, function, frame_hits, parent_pct, CAST(round_even(hits, 0) AS BIGINT) AS chain_hits, siblings, array_to_string(path, ' < ') AS path FROM walk"


# walks without a limit of depth; the names of the second form are few
ALL_DEPTHS = 1_000_000
FEW = WALK.replace("frame_names", "few_names").replace("%bolt%", "%fn3%")
THRESHOLD = FEW.replace(
    "row_number() OVER (PARTITION BY trace_id, target_module, target_function ORDER BY weight DESC, caller_module, caller_function) AS rk",
    "CASE WHEN weight * 100.0 / sum(weight) OVER (PARTITION BY trace_id, target_module, target_function) >= 16.0 THEN 1 ELSE 2 END AS rk")


def _few(t):
    return stacks.stack_aggregates(_samples(t), t["few_names"], keep=True)


@query("walk_stack_dominant", WALK.format(rank=1, depth=ALL_DEPTHS) + WALKED)
def _(t):
    weights, edges = stacks.stack_aggregates(_samples(t), t["frame_names"], keep=True)
    return stacks.walk_stack(weights, edges, "bolt")


@query("walk_stack_all", FEW.format(rank=1000000, depth=ALL_DEPTHS) + WALKED)
def _(t):
    return stacks.walk_stack(*_few(t), "fn3", branch_policy="all", max_rows=100_000)


@query("walk_stack_threshold", THRESHOLD.format(rank=1, depth=ALL_DEPTHS) + WALKED)
def _(t):
    return stacks.walk_stack(*_few(t), "fn3", branch_policy="threshold", branch_threshold_pct=16.0, max_rows=100_000)


@query("call_chain", WALK.format(rank=1, depth=ALL_DEPTHS) + """
SELECT w.trace_id, depth, module, function, frame_hits, parent_pct, CAST(round_even(hits, 0) AS BIGINT) AS chain_hits, siblings, array_to_string(path, ' < ') AS path,
  'callers' AS direction, round(total / 2.0, 4) AS denominator, round(frame_hits / (total / 2.0) * 100.0, 4) AS denominator_pct FROM walk w JOIN tot ON tot.trace_id = w.trace_id""")
def _(t):
    # twice as many CPUs as had samples: half of them idle throughout
    meta = t["meta"].withColumn("cpu_count", F.col("cpu_count") * 2)
    timeline = cpu.cpu_timeline(t["base"], meta, bucket_seconds=DAY_S, sample_rate_hz=RATE)
    weights, edges = stacks.stack_aggregates(_samples(t), t["frame_names"], keep=True)
    return stacks.call_chain(weights, edges, "bolt", usage=cpu.cpu_usage_scalars(timeline, meta))


@query("call_chain_table", FEW.format(rank=1, depth=ALL_DEPTHS) + """
SELECT trace_id, depth AS "Depth", module || '!' || function AS "Frame", frame_hits AS "Frame Hits",
  CASE WHEN parent_pct >= 10 THEN printf('%.1f%%', parent_pct) WHEN parent_pct >= 0.01 THEN printf('%.2f%%', parent_pct) ELSE printf('%.4f%%', parent_pct) END AS "% Parent",
  CAST(round_even(hits, 0) AS BIGINT) AS "Chain Hits",
  CASE WHEN depth = 0 THEN 'root' WHEN siblings > 1 THEN 'dominant; ' || siblings || ' siblings' ELSE 'dominant' END AS "Branch" FROM walk""")
def _(t):
    return chain_table(stacks.walk_stack(*_few(t), "fn3"))


EDGE = """(SELECT trace_id, max(weight) AS w, arg_max(parent_pct, (weight, parent_pct)) AS p FROM edges_ WHERE direction = 'caller'
  AND target_function ILIKE '%{0}%' AND caller_function ILIKE '%{1}%' GROUP BY trace_id)"""


@query("count_stacks_in_order", f"""
WITH {EDGES}, m AS (SELECT t.trace_id, t.total, coalesce(a.w * b.p / 100.0, 0) AS hit, coalesce(a.w * b.p / 100.0 * c.p / 100.0, 0) AS ex
  FROM tot t LEFT JOIN {EDGE.format('bolt', 'widget')} a USING (trace_id) LEFT JOIN {EDGE.format('widget', 'ring')} b USING (trace_id) LEFT JOIN {EDGE.format('ring', 'bolt')} c USING (trace_id))
SELECT trace_id, CAST(round_even(greatest(hit - ex, 0), 0) AS BIGINT) AS matching, round(greatest(hit - ex, 0) * 100.0 / total, 4) AS pct, CAST(round_even(ex, 0) AS BIGINT) AS excluded FROM m""")
def _(t):
    weights, edges = _aggregates(t)
    return stacks.count_stacks(weights, edges, ["bolt", "widget", "ring"], excludes=["bolt"])


@query("count_stacks_any_order", f"""
WITH {WEIGHTS}, m AS (SELECT t.trace_id, any_value(total) AS total, least(coalesce(max(CASE WHEN function ILIKE '%bolt%' AND module ILIKE '%#1%' THEN inclusive END), 0),
   coalesce(max(CASE WHEN function ILIKE '%ring%' THEN inclusive END), 0)) AS hit FROM tot t JOIN sw USING (trace_id) GROUP BY t.trace_id)
SELECT trace_id, hit AS matching, round(hit * 100.0 / total, 4) AS pct, 0 AS excluded FROM m""")
def _(t):
    weights, edges = _aggregates(t)
    return stacks.count_stacks(weights, edges, ["#1!bolt", "ring"], in_order=False)


@query("count_stacks_exact", f"""
WITH {WEIGHTS}, lab AS (SELECT e.trace_id, l_orderkey, any_value(weight) AS weight, list(n.function ORDER BY i) AS f FROM ex e JOIN frame_names n ON n.trace_id = e.trace_id AND n.address = e.address GROUP BY ALL),
hit AS (SELECT trace_id, weight, len(f) >= 2 AND list_bool_or(list_transform(range(1, greatest(len(f), 1)), lambda x: f[x] LIKE '%bolt%' AND f[x + 1] LIKE '%widget%')) AS m,
   list_bool_or(list_transform(f, lambda x: x LIKE '%ring%')) AS x FROM lab)
SELECT trace_id, CAST(sum(CASE WHEN m AND NOT x THEN weight ELSE 0 END) AS BIGINT) AS matching, CAST(sum(CASE WHEN m AND x THEN weight ELSE 0 END) AS BIGINT) AS excluded,
  CAST(sum(weight) AS BIGINT) AS total FROM hit GROUP BY trace_id""")
def _(t):
    labelled = stacks.labelled_stacks(_samples(t), t["frame_names"])
    return stacks.count_stacks_exact(labelled, ["bolt", "widget"], excludes=["ring"])
