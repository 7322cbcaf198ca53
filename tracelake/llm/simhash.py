"""SimHash fingerprints and near-duplicate links through tables of distances to reference fingerprints.

Fingerprints within ``radius`` bits are found without comparing all pairs:

1. Reference fingerprints are laid out in blocks. A reference of a block differs from the zero
   reference inside that block only, so the distance to it, less the distance to the zero
   reference, is a coordinate that only bits of that block can move. ``radius`` flipped bits
   touch at most ``radius`` blocks; on all others the coordinates of both fingerprints agree.
   Rows are dealt by the coordinates of every choice of ``blocks - radius`` blocks, so each
   linked pair meets under at least one key.
2. Rows that meet are compared in the pivot table of ``PIVOTS`` random references: a pair whose
   largest coordinate difference exceeds the radius is discarded (triangle inequality).
3. Survivors are verified bit by bit.

Rows of a key stream through a task in order, so no key is held beyond ``WHOLE`` rows. Longer
runs go to a finer layout of blocks, where a key holds fewer distinct fingerprints; in the
finest one it fixes all but 12 bits, so that a run cannot exceed 4096. Runs up to ``SMALL`` rows
give all their links, longer ones the links of a spanning forest; components need no more.

Near copies by five-word shingles (``one_of_each_group``) are found by fingerprints of these shingles in the
same way and verified on the shingles. Pairs close to the threshold lie beyond the radius; they meet in an
exact prefix join of what fingerprints have not put into one group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BooleanType, LongType

from .common import discard, filtered_joins, fresh, keep, lower_words, query, table
from .graph import components

RADIUS = 3
LAYOUTS = (5, 8, 16)
PIVOTS = 24
SMALL = 32
WHOLE = 4096
SHINGLE = 5
SAMPLED = 16  # one text in so many tells which shingles are frequent
COMMON = 1 << 17
_HASHES = 1 << 15


def bit_majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set; 0 for no hash."""
    n, count = len(hashes), np.zeros(64, np.int64)
    for at in range(0, n, _HASHES):
        bits = np.unpackbits(hashes[at:at + _HASHES].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        count += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view(np.uint64)[0]) if n else 0


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of the whole sequence if shorter."""
    if not words:
        return np.empty(0, np.uint64)
    joined, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]])
    last = max(len(words) - size + 1, 1)
    stops = (ends[size - 1:] - 1 if len(words) >= size else ends[-1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:last].tolist(), stops, strict=True)), np.uint64, last)


def fingerprint(text: str | None, size: int = 3) -> int:
    """SimHash of a whole text over its word shingles."""
    return bit_majority(shingle_hashes(lower_words(text), size))


@pandas_udf(LongType())
def fingerprint_3(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), dtype="int64")


@lru_cache
def _references(blocks: int) -> list[tuple[int, list[int]]]:
    """Per block its mask and its references: patterns inside the block, fixed by a seed."""
    rng, edges, out = np.random.default_rng(blocks), np.linspace(0, 64, blocks + 1).round().astype(int), []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        patterns = {1 << i for i in range(high - low)} | {int(rng.integers(1 << (high - low))) for _ in range(4)}
        out.append((((1 << (high - low)) - 1) << low, [p << low for p in sorted(patterns)]))
    return out


@lru_cache
def _pivots() -> np.ndarray:
    return np.random.default_rng(64).integers(0, 1 << 63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the random references, one row each."""
    return np.bitwise_count(prints[:, None] ^ _pivots()[None, :]).astype(np.int8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def block_keys(prints: np.ndarray, space: np.ndarray, blocks: int, radius: int = RADIUS) -> np.ndarray:
    """One key per fingerprint and choice of ``blocks - radius`` blocks, from their coordinates."""
    zero = np.bitwise_count(prints).astype(np.int64)
    rows = []
    for number, (_, patterns) in enumerate(_references(blocks)):
        coded = np.full(len(prints), number + 1, np.uint64)
        for pattern in patterns:
            step = np.bitwise_count(prints ^ np.uint64(pattern)).astype(np.int64) - zero
            coded = coded * np.uint64(131) + (step + 64).astype(np.uint64)
        rows.append(_mixed(coded))
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = space.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(number)
        for b in chosen:
            key = _mixed(key ^ rows[b])
        keys.append(key)
    return np.stack(keys, axis=1)


def linked(x: np.ndarray, y: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which pairs lie within ``radius``: pivot coordinates first, bits for the survivors."""
    near = np.abs(pivot_table(x) - pivot_table(y)).max(axis=1) <= radius
    near[near] = np.bitwise_count(x[near] ^ y[near]) <= radius
    return near


def spanning_links(prints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest of the links among ``prints``."""
    coordinates, left, out = pivot_table(prints), np.arange(len(prints)), []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = left[np.abs(coordinates[left] - coordinates[at]).max(axis=1) <= radius]
            near = near[np.bitwise_count(prints[near] ^ prints[at]) <= radius]
            if len(near):
                out += [(at, int(i)) for i in near]
                frontier += near.tolist()
                left = np.setdiff1d(left, near, assume_unique=True)
    return out


def _dealt(blocks: int, radius: int):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            prints, space = rows["fp"].to_numpy(np.int64).view(np.uint64), rows["space"].to_numpy(np.int64)
            keys = block_keys(prints, space, blocks, radius)
            wide = keys.shape[1]
            yield pd.DataFrame({
                "key": keys.reshape(-1).view(np.int64), "space": np.repeat(space, wide),
                "fp": np.repeat(prints, wide).view(np.int64),
            })

    return deal


def _met(radius: int):
    """Links within runs of equal keys; a run over ``WHOLE`` rows is passed on with no partner."""

    def runs(keys: np.ndarray, space: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(cuts, len(keys)))
        left, right = [], []
        for gap in range(1, SMALL):
            start = np.repeat(cuts, np.where(sizes <= SMALL, np.maximum(sizes - gap, 0), 0))
            if not len(start):
                break
            counts = np.where(sizes <= SMALL, np.maximum(sizes - gap, 0), 0)
            offset = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
            i = start + offset
            good = linked(prints[i], prints[i + gap], radius)
            left.append(i[good])
            right.append(i[good] + gap)
        for at, size in zip(cuts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
            pairs = np.array(spanning_links(prints[at:at + size], radius), np.int64).reshape(-1, 2) + at
            left.append(pairs[:, 0])
            right.append(pairs[:, 1])
        a = np.concatenate(left) if left else np.empty(0, np.int64)
        b = np.concatenate(right) if right else np.empty(0, np.int64)
        return pd.DataFrame({"space": space[a], "a": prints[a].view(np.int64), "b": pd.array(prints[b].view(np.int64), "Int64")})

    def over(space: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"space": space, "a": prints.view(np.int64), "b": pd.array([None] * len(space), "Int64")})

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)]
        long_key = None
        for rows in batches:
            new = [rows["key"].to_numpy(), rows["space"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)]
            if long_key is not None:
                same = new[0] == long_key
                if same.any():
                    yield over(new[1][same], new[2][same])
                    new = [x[~same] for x in new]
                if not len(new[0]):
                    continue
                long_key = None
            keys, space, prints = (np.concatenate(x) for x in zip(held, new, strict=True))
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(cuts, len(keys)))
            long = np.repeat(sizes > WHOLE, sizes)
            if long.any():
                yield over(space[long], prints[long])
                if long[-1]:
                    long_key = keys[-1]
            tail = np.arange(len(keys)) >= cuts[-1]
            ready = ~long & ~tail
            if ready.any():
                yield runs(keys[ready], space[ready], prints[ready])
            held = [x[tail & ~long] for x in (keys, space, prints)]
        if len(held[0]):
            yield runs(*held)

    return meet


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``(space, a, b)`` between the distinct fingerprints ``(space, fp)`` of one space.

    ``fp`` and ``space`` are not null and rows are distinct. All links within small runs and a
    spanning forest of the others, so that components are exact.
    """
    found, todo = [], prints.select("space", "fp")
    for blocks in LAYOUTS:
        met = keep(
            todo.mapInPandas(_dealt(blocks, radius), "key long, space long, fp long")
            .repartition("key").sortWithinPartitions("key", "fp")
            .mapInPandas(_met(radius), "space long, a long, b long")
        )
        found.append(met.where("b is not null"))
        todo = met.where("b is null").select("space", F.col("a").alias("fp")).distinct()
        if todo.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` per document.

    Equal fingerprints are one node. ``component_id`` is the smallest doc_id reachable over links;
    a null or empty text has the fingerprint zero and links like any other. Repeated rows each get
    a row; rows with a null doc_id take part, but never name a component unless all its rows are
    null. Other columns of ``docs`` are ignored. An empty table gives an empty result.
    """
    marked = keep(docs.select("doc_id", fingerprint_3(F.coalesce("text", F.lit(""))).alias("fp")))
    nodes = keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    links = fingerprint_links(nodes.select(F.lit(0).cast("long").alias("space"), "fp"), radius)
    labels = components(links.select("a", "b"))
    named = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = named.join(smallest, "label").select("fp", "component_id")
    return marked.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _shingles(text: str | None) -> tuple[bytes, np.ndarray]:
    """Digest of the word sequence of a text, and its distinct five-word shingles."""
    words = lower_words(text)
    return xxhash.xxh3_128_digest(b" ".join(words)), np.unique(shingle_hashes(words, SHINGLE))


def _listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield pd.DataFrame({"shingles": [_shingles(text)[1].view(np.int64) for text in rows["text"]]})


def _common(plain: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample have, in order of their hash, and their place in order of frequency.

    They only move frequent shingles to the end of the order of all shingles; any order keeps the join exact.
    """
    sample = plain.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counts = (
        sample.mapInPandas(_listed, "shingles array<long>").select(F.explode("shingles").alias("shingle"))
        .groupBy("shingle").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "shingle").limit(COMMON)
    )
    # cut to the fixed number of rows by executors before the driver sees them
    known = np.array([r["shingle"] for r in keep(counts).collect()], np.int64).view(np.uint64)
    order = np.argsort(known)
    return known[order], len(known) - order


def parity(shingles: np.ndarray) -> bytes:
    """A bit for every slot, some two a shingle, that an odd number of shingles falls into."""
    slots = 256
    while slots < 2 * len(shingles):
        slots *= 2
    return np.packbits(np.bincount((shingles & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1, bitorder="little").tobytes()


def _close(threshold: float):
    """Whether two parity maps leave it open that sets of such sizes reach the threshold.

    Maps differ in no more bits than the sets in members, which are at most ``(1 - t) / (1 + t)`` of both sizes.
    The larger map is folded to the size of the smaller one.
    """
    most = (1 - threshold) / (1 + threshold)

    def folded(a: np.ndarray, size: int) -> np.ndarray:
        while len(a) > size:
            a = a[:len(a) // 2] ^ a[len(a) // 2:]
        return a

    @pandas_udf(BooleanType())
    def close(p: pd.Series, q: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        out = []
        for a, b, total in zip(p, q, n + m, strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            size = min(len(a), len(b))
            out.append(int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum()) <= total * most + 1e-6)
        return pd.Series(out, dtype=bool)

    return close


def _prefixed(common: tuple[np.ndarray, np.ndarray], threshold: float):
    """Per text its digest, the number, parity map and fingerprint of its shingles and the rarest of them, the prefix that a match must share."""
    known, place = common

    def prefix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            node, size, bits, prints, keys = [], [], [], [], []
            for text in rows["text"]:
                digest, shingles = _shingles(text)
                late = np.zeros(len(shingles), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
                    late = np.where(known[at] == shingles, place[at], 0)
                wanted = len(shingles) - math.ceil(threshold * len(shingles) - 1e-9) + 1
                node.append(digest)
                size.append(len(shingles))
                bits.append(parity(shingles))
                prints.append(bit_majority(shingles))
                keys.append(shingles[np.argsort(late, kind="stable")[:wanted]].view(np.int64))
            yield pd.DataFrame({"doc": rows["doc"], "mark": rows["mark"], "node": node, "size": np.array(size, np.int32), "bits": bits, "fp": np.array(prints, np.uint64).view(np.int64), "keys": keys})

    return prefix


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distinct five-word shingles of the texts whose word sequence is the wanted one."""
    for rows in batches:
        out = []
        for node, text in zip(rows["node"], rows["text"], strict=True):
            digest, shingles = _shingles(text)
            if digest == bytes(node):
                out.append((digest, shingles.view(np.int64)))
        yield pd.DataFrame(out, columns=["node", "shingles"])


def _may_match(x: str, y: str, threshold: float) -> Column:
    """Length and positional filter of two nodes at a key: what stands before it in one may be missing in the other."""
    nx, ny, ax, ay = (F.col(c) for c in (f"{x}.size", f"{y}.size", f"{x}.at", f"{y}.at"))
    shared = F.least(ax, ay) + F.least(nx - ax, ny - ay)
    return shared * (1 + threshold) >= (nx + ny) * threshold - 1e-6


def _shingles_of(pairs: DataFrame, nodes: DataFrame, plain: DataFrame) -> DataFrame:
    """``num, shingles`` of the nodes in pairs ``x, y``, read again from one text of each."""
    both = pairs.select(F.col("x").alias("num")).union(pairs.select(F.col("y").alias("num"))).distinct()
    wanted = keep(both.join(nodes.select("num", "node", "doc", "mark"), "num"))
    with filtered_joins(plain.sparkSession):
        found = keep(
            plain.join(wanted.where("doc > -9223372036854775808").select("doc", "mark", "node"), ["doc", "mark"]).select("node", "text")
            .mapInPandas(_shingled, "node binary, shingles array<long>").dropDuplicates(["node"]).select(F.xxhash64("node").alias("num"), "shingles"))
    discard(wanted)
    return found


def _verified(candidates: DataFrame, nodes: DataFrame, plain: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` of the candidates ``x, y`` whose shingles reach the threshold.

    Parity maps, a few bytes a shingle less, leave few but true pairs; only their shingles are read again.
    """
    of_x = nodes.select(F.col("num").alias("x"), F.col("size").alias("n"), F.col("bits").alias("p"))
    of_y = nodes.select(F.col("num").alias("y"), F.col("size").alias("m"), F.col("bits").alias("q"))
    open_ = keep(candidates.join(of_x, "x").join(of_y, "y").where(_close(threshold)("p", "q", "n", "m")).select("x", "y"))
    shingles = _shingles_of(open_, nodes, plain)
    both = F.size(F.array_intersect("p", "q"))
    near = keep(
        open_.join(shingles.select(F.col("num").alias("x"), F.col("shingles").alias("p")), "x")
        .join(shingles.select(F.col("num").alias("y"), F.col("shingles").alias("q")), "y")
        .where(both >= threshold * (F.size("p") + F.size("q") - both))
        .select(F.col("x").alias("a"), F.col("y").alias("b")))
    discard(shingles)
    discard(open_)
    return near


def _by_fingerprint(nodes: DataFrame) -> DataFrame:
    """Pairs ``x, y`` of nodes whose fingerprints lie within the radius: heads of linked ones, and the others of an equal one with its head."""
    heads = keep(nodes.groupBy("fp").agg(F.min("num").alias("head")))
    links = fingerprint_links(heads.select(F.lit(0).cast("long").alias("space"), "fp"))
    of_a = heads.select(F.col("fp").alias("a"), F.col("head").alias("x"))
    of_b = heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    equal = nodes.select("fp", "num").join(heads, "fp").where("num <> head").select(F.col("head").alias("x"), F.col("num").alias("y"))
    pairs = keep(_paired(equal.union(links.join(of_a, "a").join(of_b, "b").select("x", "y"))))
    discard(heads)
    return pairs


def _paired(candidates: DataFrame) -> DataFrame:
    return candidates.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs ``x, y`` that do not lie in one group yet."""
    of_x = labels.select(F.col("node").alias("x"), F.col("label").alias("p"))
    of_y = labels.select(F.col("node").alias("y"), F.col("label").alias("q"))
    return pairs.join(of_x, "x", "left").join(of_y, "y", "left").where(F.coalesce("p", "x") != F.coalesce("q", "y")).select("x", "y")


def near_copy_groups(plain: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, nodes, labels)`` of ``plain(doc, mark, text)``: one node per word sequence, one label per group.

    Nodes whose fingerprints are linked come first, verified on their shingles. Then an exact prefix join
    finds what lies beyond the radius. Shingles are ordered by rarity; two nodes that reach the threshold share
    one of the first ``n - ceil(threshold n) + 1`` of either. Keys alone are counted first, and only those of
    several nodes carry more. At each key, nodes are first compared with the one that meets most
    others; then all pairs of a key that do not lie in one group yet, so that groups are those of all
    pairs. Nodes of one group need no comparison. Past the grouping of equal word sequences, nodes go by a
    64-bit hash of their digest.
    """
    wide = keep(plain.mapInPandas(_prefixed(_common(plain), threshold), "doc long, mark long, node binary, size int, bits binary, fp long, keys array<long>"))
    first = F.min(F.struct("doc", "mark")).alias("first")
    keyed = wide.groupBy("node").agg(first, F.first("size").alias("size"), F.first("bits").alias("bits"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    keyed = keep(keyed.select(F.xxhash64("node").alias("num"), "node", "first.doc", "first.mark", "size", "bits", "fp", "keys"))
    rows = keep(wide.select("doc", "mark"))
    discard(wide)
    alike = _by_fingerprint(keyed)
    by_print = _verified(alike, keyed, plain, threshold)
    discard(alike)
    grouped = components(by_print)
    often = keep(keyed.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("met")).where("met > 1"))
    with filtered_joins(plain.sparkSession):
        shared = keep(keyed.select("num", "size", F.posexplode("keys").alias("at", "key")).join(often.where("met > 1"), "key"))
    discard(often)
    nodes = keep(keyed.drop("fp", "keys"))
    discard(keyed)

    # most keys have two nodes, which meet in their key's aggregate; only the others need a join
    node, more = F.struct("num", "size", "at"), shared.where("met > 2")
    twos = shared.where("met = 2").groupBy("key").agg(F.min(node).alias("m"), F.max(node).alias("h")).select("m", "h")
    central = shared.groupBy("num").agg(F.sum("met").alias("central"))
    heads = more.join(central, "num").groupBy("key").agg(F.max(F.struct("central", "num", "size", "at")).alias("h"))
    several = more.select("key", node.alias("m")).join(heads.select("key", F.struct("h.num", "h.size", "h.at").alias("h")), "key").select("m", "h")
    stars = keep(_apart(_paired(
        twos.union(several).where((F.col("m.num") != F.col("h.num")) & _may_match("m", "h", threshold))
        .select(F.col("m.num").alias("x"), F.col("h.num").alias("y"))
    ), grouped))
    near = by_print.union(_verified(stars, nodes, plain, threshold))
    labels = components(near)
    placed = more.select("key", "num", "size", "at").join(labels.withColumnsRenamed({"node": "num"}), "num", "left").withColumn("label", F.coalesce("label", "num"))
    # keys whose nodes lie in several groups, and the group that has most of them
    several = (
        placed.groupBy("key", "label").agg(F.count("*").alias("n"))
        .groupBy("key").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("groups")).where("groups > 1").select("key", "main"))
    apart = keep(placed.join(several, "key").select("num", "size", "at", "key", "label", (F.col("label") == F.col("main")).alias("inside")))
    discard(shared)
    x, y = apart.where("not inside").alias("u"), apart.alias("v")
    once = F.col("v.inside") | (F.col("u.num") < F.col("v.num"))
    rest = keep(
        _paired(
            x.join(y, (F.col("u.key") == F.col("v.key")) & (F.col("u.label") != F.col("v.label")) & once & _may_match("u", "v", threshold))
            .select(F.col("u.num").alias("x"), F.col("v.num").alias("y"))
        ).join(stars, ["x", "y"], "left_anti")
    )
    discard(apart)
    discard(stars)
    return rows, nodes, components(near.union(_verified(rest, nodes, plain, threshold)))


def one_of_each_group(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id.

    Near copies share ``threshold`` of their five-word shingles (Jaccard); groups are connected. Equal
    word sequences are one node. Texts without a word are equal to each other. Rows with a null
    doc_id come last; of rows that share the kept doc_id and word sequence one stays.
    """
    last = F.lit((1 << 63) - 1)
    doc = F.coalesce(F.col("doc_id").cast("long"), last)
    mark = F.xxhash64(F.coalesce("text", F.lit("")))  # tells rows of one doc_id, or of none, apart
    plain = docs.select(doc.alias("doc"), mark.alias("mark"), F.coalesce("text", F.lit("")).alias("text"))
    rows, nodes, labels = near_copy_groups(plain, threshold)
    grouped = nodes.select("num", "doc", "mark").join(labels.withColumnsRenamed({"node": "num"}), "num", "left").withColumn("label", F.coalesce("label", "num"))
    winners = grouped.groupBy("label").agg(F.min(F.struct("doc", "mark")).alias("w")).select("w.doc", "w.mark")
    repeated = rows.groupBy("doc", "mark").agg(F.count("*").alias("n")).where("n > 1").select("doc", "mark", F.lit(True).alias("repeated"))
    chosen = keep(winners.join(repeated, ["doc", "mark"], "left"))
    at, its_mark, again = fresh(docs, "doc", "mark", "again")
    kept = docs.withColumn(at, doc).withColumn(its_mark, mark).join(chosen.toDF(at, its_mark, again), [at, its_mark])
    single = kept.where(F.col(again).isNull()).select(*docs.columns)
    if chosen.where("repeated").isEmpty():
        return single
    return single.union(kept.where(again).dropDuplicates([at, its_mark]).select(*docs.columns))


@query("op2_simhash_near_duplicates")
def op2(spark, folder):
    return near_duplicates(table(spark, folder, "documents"))
