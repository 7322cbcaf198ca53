"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

1. Each document's size is its number of words; sources get a share of all words by weight, and
   no more than ``most`` times their own words. Excess is shared again by weight until no source
   is above its limit (computed in closed form over sources in order of limit by weight).
2. A schedule of slots walks a golden-ratio sequence through the cumulative shares; the source
   whose interval holds the slot's point is drawn. Slots are ranked per source. A source that the walk
   draws too seldom, as its share is a few blocks or its passes end in short ones, gets the slots that
   are missing at the end of the schedule.
3. The documents of a source, shuffled by a digest of their id, form a stream of words that is cut
   into blocks of equal size. A slot takes the block of its rank, starting over after the last
   one; the slot that reaches the source's target takes only the rest.

Running sums and ranks are taken within slices of a source and carried on through a table with
one row per source and slice, so that a source with a third of all rows is no single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, keep, query, table

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCKS_PER_DOCUMENT = 4
SLICES, ROWS_PER_SLICE = 256, 50_000
CELLS = 1024
GOLDEN = 1_327_217_885  # odd number next to 2^31 divided by the golden ratio
TURN = 1 << 31
SLOT_SLICE = 1 << 14


def source_targets(sized: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, rank, source_size, weight, target, goal`` per source of ``sized(source, size)``.

    ``goal`` is the target in whole words. One row per source: the ranking runs in one task, over
    rows that are already summed.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = ranked.withColumn(
        "weight", F.element_at(cycle, ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("ratio", F.col("source_size") * most / F.col("weight"))
    before = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spread = ranked.withColumn(
        "level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    )
    # the first source, in order of ratio, that stays below its limit sets the level of the rest
    level = F.min_by(
        F.when(F.col("level") <= F.col("ratio"), F.col("level")),
        F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank")),
    ).over(everything)
    target = F.when(F.col("ratio") < F.col("level_all"), F.col("source_size").cast("double") * most).otherwise(
        F.least(F.col("level_all") * F.col("weight"), F.col("source_size").cast("double") * most))
    return (
        spread.withColumn("level_all", level)
        .select("source", "rank", "source_size", "weight", target.alias("target"))
        .withColumn("goal", F.round("target").cast("long"))
    )


def _carried(df: DataFrame, key: str, cut: str, amount: str, order: Sequence[str], out: str) -> DataFrame:
    """Exclusive running sum of ``amount`` per ``key`` in order of (``cut``, ``order``), slice by slice."""
    sums = df.groupBy(key, cut).agg(F.sum(amount).alias("_sum"))
    past = Window.partitionBy(key).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, cut, F.coalesce(F.sum("_sum").over(past), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(key, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    run = F.coalesce(F.sum(amount).over(inside), F.lit(0))
    return df.withColumn("_run", run).join(base, [key, cut]).withColumn(out, F.col("_run") + F.col("_base")).drop("_run", "_base")


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """``rank, slot, turn`` per slot: the source it draws, and how many slots drew that source before.

    ``targets`` has ``rank`` and ``goal``. Each source's interval is listed in the cells it
    covers, so that a slot meets its source by an equi-join on its cell.
    """
    upto = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    shares = (
        targets.where("goal > 0")
        .select("rank", "goal", F.sum("goal").over(upto).alias("high"), F.sum("goal").over(whole).alias("all"))
        .select("rank", F.floor((F.col("high") - F.col("goal")) / F.col("all") * TURN).alias("low"),
                F.floor(F.col("high") / F.col("all") * TURN).alias("high"))
        .where("high > low")
    )
    wide = TURN // CELLS
    cells = shares.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / wide), F.floor((F.col("high") - 1) / wide))))
    points = targets.sparkSession.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") % TURN) * GOLDEN % TURN).alias("point"))
    drawn = (
        points.withColumn("cell", F.floor(F.col("point") / wide))
        .join(cells, "cell").where("point >= low AND point < high")
        .select("rank", "slot", F.floor(F.col("slot") / SLOT_SLICE).alias("cut"), F.lit(1).alias("one"))
    )
    return _carried(drawn, "rank", "cut", "one", ["slot"], "turn").select("rank", "slot", "turn")


def completed(drawn: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """``rank, turn`` of the schedule, with the turns added that a source needs to reach its goal.

    Whole passes have ``ceil(source_size / block)`` blocks each, the last pass as many as its rest takes.
    """
    per_pass = F.ceil(F.col("source_size") / block)
    needed = F.floor(F.col("goal") / F.col("source_size")) * per_pass + F.ceil((F.col("goal") % F.col("source_size")) / block)
    had = drawn.groupBy("rank").agg(F.count("*").alias("had"))
    short = (
        targets.where("source_size > 0").select("rank", needed.alias("needed")).join(had, "rank", "left")
        .withColumn("had", F.coalesce("had", F.lit(0))).where("needed > had")
    )
    # in two steps, so that no row lists more than a slice
    cuts = short.withColumn("cut", F.explode(F.sequence(F.floor(F.col("had") / SLOT_SLICE), F.floor((F.col("needed") - 1) / SLOT_SLICE))))
    first, last = F.greatest("had", F.col("cut") * SLOT_SLICE), F.least("needed", (F.col("cut") + 1) * SLOT_SLICE) - 1
    return drawn.select("rank", "turn").union(cuts.select("rank", F.explode(F.sequence(first, last)).alias("turn")))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per document of ``docs``.

    ``taken`` counts the words the mix takes from the document, repeats included. Over a source it is
    the target in whole words, and it never exceeds ``most`` times a document's size. A null text has size 0 and
    takes nothing; null sources form one source, ranked last. Rows with the same doc_id and size
    share their place in the stream's order, which only decides among equals. Other columns are
    ignored. An empty table gives an empty result.
    """
    sized = keep(docs.select(
        "doc_id", "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size")))
    targets = keep(source_targets(sized, weights, most))
    total = sized.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("words")).first()
    block = max(1, total["words"] // max(1, total["n"] * BLOCKS_PER_DOCUMENT))
    # a quarter more slots than words ask for: what exceeds a source's goal is cut by rank
    slots = 64 + (total["words"] // block) * 5 // 4
    # rows without an id spread by their size
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size")))
    slices = SLICES
    while slices < 1 << 16 and total["n"] > slices * ROWS_PER_SLICE:
        slices *= 2
    streamed = sized.join(targets.select("source", "rank", "source_size", "target"),
                          sized["source"].eqNullSafe(targets["source"])).drop("source")
    streamed = streamed.withColumn("digest", digest).withColumn(
        "cut", F.conv(F.substring("digest", 1, 4), 16, 10).cast("int") % slices)
    placed = _carried(streamed, "rank", "cut", "size", ["digest", "doc_id", "size"], "start")
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
        .withColumn("lo", F.greatest("start", F.col("block") * block))
        .withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block))
    )
    per_pass = F.floor((F.col("source_size") + (block - 1)) / block)
    taken_slots = (
        completed(schedule(targets, slots), targets, block).join(targets.where("source_size > 0"), "rank")
        .withColumn("block", F.col("turn") % per_pass)
        .withColumn("length", F.least(F.lit(block).cast("long"), F.col("source_size") - F.col("block") * block))
        .withColumn("got", F.col("goal") - (F.floor(F.col("turn") / per_pass) * F.col("source_size") + F.col("block") * block))
        .where("got > 0")
        .groupBy("rank", "block").agg(
            F.sum((F.col("got") >= F.col("length")).cast("long")).alias("full"),
            F.max(F.when(F.col("got") < F.col("length"), F.col("got")).otherwise(0)).alias("part"))
    )
    from_blocks = pieces.join(taken_slots, ["rank", "block"]).select(
        "doc_id", "size", "rank", "source_size", "target", "start",
        (F.col("full") * (F.col("hi") - F.col("lo"))
         + F.greatest(F.lit(0), F.least("hi", F.col("block") * block + F.col("part")) - F.col("lo"))).alias("words"))
    everyone = placed.select("doc_id", "size", "rank", "source_size", "target", "start", F.lit(0).cast("long").alias("words"))
    # one row per place in the stream; equal empty rows share a place, so they are counted and listed again
    summed = everyone.union(from_blocks).groupBy("doc_id", "size", "rank", "source_size", "target", "start").agg(
        F.sum("words").alias("taken"), F.sum((F.col("words") == 0).cast("long")).alias("n"))
    repeated = summed.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.when(F.col("size") == 0, F.col("n")).otherwise(1).cast("int"))))
    return repeated.select("doc_id", "size", "source_size", "target", "taken")


CHECK = f"""
WITH sized AS (SELECT doc_id, source, size, md5(coalesce(doc_id::VARCHAR, '') || ':' || size) AS digest FROM (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents)),
totals AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sized GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM totals),
ratios AS (SELECT *, (source_size * {MOST}) / weight AS ratio FROM weighed),
levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(source_size * {MOST}) OVER w, 0))::BIGINT
    / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::BIGINT AS level
    FROM ratios WINDOW w AS (ORDER BY ratio, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
set_by AS (SELECT level AS l FROM levels WHERE level <= ratio ORDER BY ratio, rank LIMIT 1),
targets AS (SELECT *, CASE WHEN ratio < l THEN source_size::DOUBLE * {MOST}
    ELSE least(l * weight, source_size::DOUBLE * {MOST}) END AS target FROM levels, set_by),
goals AS (SELECT *, round(target)::BIGINT AS goal FROM targets),
sums AS (SELECT sum(size)::BIGINT AS words, count(*) AS n FROM sized),
plan AS (SELECT greatest(1, words // greatest(1, n * {BLOCKS_PER_DOCUMENT})) AS block FROM sums),
slots AS (SELECT block, 64 + (words // block) * 5 // 4 AS slots FROM plan, sums),
shares AS (SELECT rank, floor((high - goal) / everything * {TURN})::BIGINT AS low, floor(high / everything * {TURN})::BIGINT AS high FROM (
    SELECT rank, goal, sum(goal) OVER (ORDER BY rank)::BIGINT AS high, sum(goal) OVER ()::BIGINT AS everything FROM goals WHERE goal > 0)),
points AS (SELECT slot, slot % {TURN} * {GOLDEN} % {TURN} AS point FROM (SELECT unnest(range(slots)) AS slot FROM slots)),
walked AS (SELECT rank, row_number() OVER (PARTITION BY rank ORDER BY slot) - 1 AS turn
    FROM points JOIN shares ON point >= low AND point < high),
needs AS (SELECT g.rank, any_value(goal // source_size * ((source_size + block - 1) // block) + (goal % source_size + block - 1) // block) AS needed, count(w.rank) AS had
    FROM goals g CROSS JOIN plan LEFT JOIN walked w ON w.rank = g.rank WHERE source_size > 0 GROUP BY g.rank),
drawn AS (SELECT rank, turn FROM walked UNION ALL SELECT rank, unnest(range(had, needed)) FROM needs WHERE needed > had),
placed AS (SELECT s.doc_id, s.size, t.rank, t.source_size, t.target, s.digest,
    coalesce(sum(s.size) OVER (PARTITION BY t.rank ORDER BY ('0x' || s.digest[1:4])::INTEGER % {SLICES}, s.digest, s.doc_id, s.size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM sized s JOIN goals t ON s.source IS NOT DISTINCT FROM t.source),
pieces AS (SELECT *, greatest(start, b * block) AS lo, least(start + size, (b + 1) * block) AS hi FROM (
    SELECT placed.*, block, unnest(range(start // block, (start + size - 1) // block + 1)) AS b FROM placed, plan WHERE size > 0)),
got AS (SELECT d.rank, turn % per AS b, least(block, source_size - turn % per * block) AS length,
    goal - (turn // per * source_size + turn % per * block) AS got
    FROM drawn d JOIN (SELECT goals.*, block, (source_size + block - 1) // block AS per FROM goals, plan WHERE source_size > 0) g ON d.rank = g.rank),
taken AS (SELECT rank, b, count(*) FILTER (got >= length) AS full_turns, coalesce(max(got) FILTER (got < length), 0) AS part
    FROM got WHERE got > 0 GROUP BY rank, b),
words AS (SELECT p.rank, p.start, p.digest, p.doc_id, p.size,
    sum(full_turns * (hi - lo) + greatest(0, least(hi, p.b * block + part) - lo))::BIGINT AS taken
    FROM pieces p JOIN taken t ON p.rank = t.rank AND p.b = t.b GROUP BY ALL)
SELECT p.doc_id, p.size, p.source_size, p.target, coalesce(w.taken, 0)::BIGINT AS taken
FROM placed p LEFT JOIN words w ON p.rank = w.rank AND p.start = w.start AND p.size = w.size AND p.doc_id IS NOT DISTINCT FROM w.doc_id
"""


@query("op1_mix_to_weights", CHECK)
def op1(spark, folder):
    return mix(table(spark, folder, "documents"))
