"""Benchmark decontamination: SimHash windows of item size, Hamming blocks, exact weighted shingle similarity.

1. Words of items and documents are A-Z lower-cased and cut at ASCII white space; a shingle is five
   words (a shorter item is one shingle). A window of a document is as long as an item, and can only
   reach the similarity if it shares shingles with it: a document meets the items of its shingles,
   and is dropped for an item if fewer of its places hold the item's shingles than a match has.
2. Windows are laid where a shared shingle stands at the same place in window and item. If words
   were added or left out, shared shingles ask for several places; then a window is also laid with
   each shared shingle as its first and as its last one, if enough others fit into it. The shared
   count of any other window of full length is reached by one of these, so none needs a look.
3. Each window gets a 64-bit SimHash of its words, as items do. Fingerprints within ``RADIUS`` bits agree on
   at least one of ``RADIUS + 1`` blocks: windows meet items of their length on (block number, block
   bits), which guarantees all fingerprints within the radius, whatever shingles they share.
4. What a window was laid for but lies beyond the radius is met exactly, on the shingles that they share.
   A tenth of the words changed at one end moves a fingerprint by more than the radius in one case of
   ten, and those are matches too.
5. All pairs of 3 and 4 are verified by the weighted Jaccard similarity of their shingle counts, so the
   result is that of all windows at every length and similarity.

A row is told from others by its doc_id and a hash of its text. All counts and joins are DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filtered_joins, fresh, keep, lower_ascii, query, table, words_of

SHINGLE = 5
RADIUS = 12
THRESHOLD = 0.8
LAST = (1 << 63) - 1


ROW = ("doc", "mark")  # what a row is told by


def _row() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark")]


def _zipped(words: Column) -> Column:
    """Runs of five words; the last ones are short of words."""
    return F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))).alias(f"w{i}") for i in range(SHINGLE)])


def _shingles(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, at, shingle`` per shingle of ``words``, ``at`` from 0."""
    runs = df.where(F.size("words") > 0).select(*keys, F.size("words").alias("_n"), F.posexplode(_zipped(F.col("words"))).alias("at", "run"))
    full = F.col("run.w4").isNotNull() | ((F.col("_n") < SHINGLE) & (F.col("at") == 0))
    return runs.where(full).select(*keys, "at", F.xxhash64(*[f"run.w{i}" for i in range(SHINGLE)]).alias("shingle"))


def _bag(words: Column) -> Column:
    """Distinct (shingle, occurrence) hashes, so that set operations count repeats."""
    n = F.greatest(F.size(words) - (SHINGLE - 1), F.lit(1))
    hashes = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, SHINGLE)))
    return F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))))


def _spots(hits: DataFrame, threshold: float) -> DataFrame:
    """``doc, mark, start, length, item_key`` per window to verify, of ``hits`` of shingles."""
    keys = ["doc", "mark", "n", "item_key", "length"]
    places, m = F.col("places"), F.greatest(F.col("length") - (SHINGLE - 1), F.lit(1))
    met = keep(
        hits.groupBy(*keys).agg(F.sort_array(F.collect_set("at")).alias("places"), F.collect_set(F.col("at") - F.col("offset")).alias("starts"))
        .where(F.size("places") >= F.ceil(threshold * m - 1e-9))
    )
    aligned = met.select(*keys, F.explode("starts").alias("start")).withColumn("start", F.greatest("start", F.lit(0)))
    # a window of full length has as many shingles as the item, and shares at least so many of them
    least = F.ceil(2 * threshold / (1 + threshold) * m - 1e-9).cast("int")
    moved = met.where(F.size("starts") > 1).withColumn("m", m).withColumn("least", least)
    as_first = F.transform(places, lambda p, i: F.when(F.get(F.col("places"), i + F.col("least") - 1) < p + F.col("m"), p))
    as_last = F.transform(places, lambda p, i: F.when(F.get(F.col("places"), i - F.col("least") + 1) > p - F.col("m"), F.greatest(p - F.col("m") + 1, F.lit(0))))
    moved = moved.select(*keys, F.explode(F.concat(as_first, as_last)).alias("start")).where(F.col("start") + F.col("length") <= F.col("n"))
    return aligned.union(moved).select("doc", "mark", "start", "length", "item_key").distinct()


def _fingerprinted(df: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, length, fp`` of ``words``: bits that over half of the word hashes have set."""
    hashed = df.select(*keys, F.explode("words").alias("word")).withColumn("h", F.xxhash64("word"))
    sums = [F.sum(F.getbit("h", F.lit(i)).cast("int")).alias(f"b{i}") for i in range(64)]
    counted = hashed.groupBy(*keys).agg(F.count("*").alias("n"), *sums)
    bits = F.lit(0).cast("long")
    for i in range(64):
        value = (1 << i) if i < 63 else -(1 << 63)
        bits = bits.bitwiseOR(F.when(F.col(f"b{i}") * 2 > F.col("n"), F.lit(value).cast("long")).otherwise(F.lit(0).cast("long")))
    return counted.select(*keys, bits.alias("fp"))


def _blocks(fp: Column, radius: int) -> Column:
    edges = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << (high - low)) - 1)) for low, high in zip(edges, edges[1:], strict=False)])


def _candidates(spots: DataFrame, windows: DataFrame, items: DataFrame, radius: int) -> DataFrame:
    """Pairs of window and item to verify: all within the radius, and beyond it those that a window was laid for."""
    window = [*ROW, "start", "length"]
    prints = keep(_fingerprinted(windows, window))
    known = keep(_fingerprinted(items, ["item_key", "length"]).withColumnRenamed("fp", "item_fp"))
    differing = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    near = (
        prints.select(*window, "fp", F.posexplode(_blocks(F.col("fp"), radius)).alias("block", "bits"))
        .join(known.select("item_key", "length", "item_fp", F.posexplode(_blocks(F.col("item_fp"), radius)).alias("block", "bits")), ["length", "block", "bits"])
        .where(differing <= radius).select(*window, "item_key").distinct()
    )
    far = spots.join(prints, window).join(known, ["item_key", "length"]).where(differing > radius).select(*window, "item_key")
    return near.union(far)


def _contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float, radius: int = RADIUS) -> DataFrame:
    """``doc, mark, item, start, similarity`` of the best window per row and item."""
    items = keep(
        benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(LAST)).alias("item"), words_of(lower_ascii(F.col("text"))).alias("words"))
        .where(F.size("words") > 0).withColumn("length", F.size("words")).withColumn("item_key", F.xxhash64("item", "words"))
        .dropDuplicates(["item_key"]))
    known = keep(_shingles(items, ["item_key", "length"]).select("shingle", "item_key", "length", F.col("at").alias("offset")))
    placed = docs.select(*_row(), words_of(lower_ascii(F.col("text"))).alias("words")).withColumn("n", F.size("words"))
    # short items can be found at any place only by their own, shorter run of words
    short = items.where(F.col("length") < SHINGLE)
    # by its size the benchmark is broadcast, or else filters the documents' shingles before they are shuffled
    with filtered_joins(docs.sparkSession):
        hits = keep(_shingles(placed, [*ROW, "n"]).join(known.where("length > 0"), "shingle").select(*ROW, "n", "item_key", "length", "at", "offset"))
    spots = _spots(hits, threshold)
    if not short.isEmpty():
        for size in range(1, SHINGLE):
            same = short.where(F.col("length") == size).select(F.xxhash64("words").alias("run"), "length", "item_key").distinct()
            runs = placed.where(F.size("words") >= size).select(
                *ROW, F.posexplode(F.transform(F.sequence(F.lit(1), F.size("words") - (size - 1)), lambda i, size=size: F.xxhash64(F.slice("words", i, size)))).alias("start", "run"))
            spots = spots.union(runs.join(same, "run").select(*ROW, "start", "length", "item_key"))
    spots = keep(spots.distinct())
    window = [*ROW, "start", "length"]
    with filtered_joins(docs.sparkSession):
        windows = keep(
            placed.join(spots.where("start > -1").select(*window).distinct(), [*ROW])
            .select(*window, F.slice("words", F.col("start") + 1, F.col("length")).alias("words"))
            .where(F.size("words") > 0).dropDuplicates(window)  # copies of one row
        )
    shared = F.size(F.array_intersect("a", "b"))
    verified = (
        _candidates(spots, windows, items, radius).join(windows.select(*window, _bag(F.col("words")).alias("a")), window)
        .join(items.select("item_key", "item", _bag(F.col("words")).alias("b")), "item_key")
        .withColumn("similarity", shared / (F.size("a") + F.size("b") - shared))
        .where(F.col("similarity") >= threshold)
    )
    best = verified.groupBy(*ROW, "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
    return best.select(*ROW, "item", (-F.col("best.s")).alias("start"), F.col("best.similarity").alias("similarity"))


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, item_id, at_word, similarity``: the best window per document and benchmark item.

    ``at_word`` is the window's first word, from 0; of equally similar windows the first counts.
    Items and documents without a word match nothing. Rows that share a doc_id, or have none, are judged
    each by its own text, equal ones once; equal items each get a row. Null ids are kept as such. Other
    columns are ignored.
    """
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return _contaminated(docs, benchmark, threshold).select(
        named("doc").alias("doc_id"), named("item").alias("item_id"), F.col("start").alias("at_word"), "similarity")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a benchmark passage; other rows of the same doc_id, or of none, stay."""
    names = fresh(docs, *ROW)
    hit = _contaminated(docs, benchmark, THRESHOLD).select(*ROW).distinct().toDF(*names)
    marked = docs.withColumns(dict(zip(names, _row(), strict=True)))
    return marked.join(hit, names, "left_anti").select(*docs.columns)


@query("op6_decontaminate")
def op6(spark, folder):
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
