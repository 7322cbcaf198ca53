"""Prefix trie of conversations from padded matrices of turn ids.

A node is a distinct sequence of first turns; the root is the empty one. Conversations are dealt over
the cluster by range of (turn ids, conv_id) and sorted, so a node's members are neighbours, and a group of
equal conversations may lie across tasks. A task cuts its range into blocks of at most ``CELLS`` cells.

In a block the ids are a matrix, one row per conversation, padded by zeros. ``numpy.lexsort`` orders it;
a column's change mask says where a row differs from the one above, and masks OR-accumulated from left to
right mark where the nodes of each depth start; ``reduceat`` sums every depth, deepest first. Nodes of
which neither the first nor the last row of the block is a member are whole.

The other nodes, at most two per depth and block, recombine: their parts are summed by node; subtree sums
climb to ancestors 1, 2, 4, ... levels up, so rounds grow with the logarithm of the depth; and their lists
of ended conversations are hashed piece by piece in order of block, without holding a list.

A turn's id is the first 16 bytes of SHA-256 of its role and text. Texts stop there: what moves is 16 bytes
(32 hex digits) and a length per turn. A conversation is one row of those, as its path is the sort key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, query, sql_crc32, table

CELLS = 1 << 20
HEX = 32
_FAR = np.iinfo(np.int64).max
_NOTHING = hashlib.sha256().hexdigest()
_PARTS = (
    "whole boolean, block long, side int, depth long, conv_id long, parent_conv_id long, parent_side int, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, ends string, key binary, up array<binary>, chars long"
)
_COLUMNS = [c.split()[0] for c in _PARTS.split(", ")]
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turn_lists(rows: DataFrame) -> DataFrame:
    """``conv_id, turns`` with turns an array of ``(id, chars)`` in order of turn, nulls first.

    Turns of equal number stand in order of their ids. Null role or text is empty. Rows with a null
    conv_id take no part. Further columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    fed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.substring(F.sha2(fed, 256), 1, HEX).alias("id"), F.length(text).alias("chars"))
    sorted_ = F.sort_array(F.collect_list(turn))
    return (
        rows.where("conv_id is not null").groupBy(F.col("conv_id").cast("long").alias("conv_id"))
        .agg(F.transform(sorted_, lambda t: F.struct(t["id"].alias("id"), t["chars"].alias("chars"))).alias("turns"))
    )


def with_shared_heads(lists: DataFrame, family: int = 100, heads: Column | None = None, longest: int = 5) -> DataFrame:
    """Each conversation c with its first ``heads`` turns taken from conversation ``c - c % family``.

    ``heads`` is at most ``longest``, by default crc32(c) % 6; it takes all turns of a shorter one and none of one
    that is not there. c's own turns after its first ``heads`` follow.
    """
    n = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6 if heads is None else heads
    first = lists.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, longest).alias("head"))
    return (
        lists.withColumn("n", n.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(first, "base", "left")
        .select("conv_id", F.concat(
            F.coalesce(F.slice("head", F.lit(1), F.col("n")), F.slice("turns", 1, 0)),
            F.slice("turns", F.col("n") + 1, F.greatest(F.size("turns") - F.col("n"), F.lit(0)))).alias("turns"))
    )


def _prefix_keys(path: str) -> list[bytes]:
    """A 16-byte key of every prefix of a path, the empty one first."""
    running = hashlib.blake2b(digest_size=16)
    keys = [running.digest()]
    for at in range(0, len(path), HEX):
        running.update(path[at:at + HEX].encode())
        keys.append(running.copy().digest())
    return keys


def block_nodes(conv: np.ndarray, paths: list[str], chars: list, block: int) -> pd.DataFrame:
    """The nodes of one block: whole ones, and the parts of those on the path of its first or last row."""
    n = len(conv)
    lens = np.array([len(p) // HEX for p in paths])
    width = int(lens.max())
    ids = np.frombuffer(bytes.fromhex("".join(paths)), ">u8").reshape(-1, 2)
    mask = np.arange(width) < lens[:, None]
    high, low, size = (np.zeros((n, width), t) for t in (np.uint64, np.uint64, np.int64))
    if width:
        high[mask], low[mask] = ids[:, 0], ids[:, 1]
        size[mask] = np.concatenate([np.asarray(c, np.int64) for c in chars])
    order = np.lexsort([conv, *(m[:, d] for d in reversed(range(width)) for m in (low, high))])
    conv, lens, mask, high, low, size = (x[order] for x in (conv, lens, mask, high, low, size))
    changed = np.ones((n, width), bool)
    changed[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
    begins = np.logical_or.accumulate(changed, axis=1) & mask

    first, last = _prefix_keys(paths[order[0]]), _prefix_keys(paths[order[-1]])
    leaves, saved, frames = np.zeros(n, np.int64), np.zeros(n, np.int64), []
    for depth in range(width, -1, -1):
        inside = mask[:, depth - 1] if depth else np.ones(n, bool)
        starts = np.flatnonzero(begins[:, depth - 1]) if depth else np.zeros(1, np.int64)
        members = np.add.reduceat(inside.astype(np.int64), starts)
        children = np.add.reduceat((begins[:, depth] if depth < width else np.zeros(n, bool)).astype(np.int64), starts)
        ended = np.add.reduceat((lens == depth).astype(np.int64), starts)
        smallest = np.minimum.reduceat(np.where(inside, conv, _FAR), starts)
        below, kept = np.add.reduceat(leaves, starts), np.add.reduceat(saved, starts)
        chars_of = size[starts, depth - 1] if depth else np.zeros(1, np.int64)
        # the node of the first row, and that of the last row where it is another one
        edge = np.full(len(starts), -1)
        if lens[-1] >= depth:
            edge[-1] = 1
        if lens[0] >= depth:
            edge[0] = 0
        whole = edge < 0
        leaf = whole & (children == 0)
        below, kept = below + leaf, kept + np.where(whole, (members - 1) * chars_of, 0)
        leaves[:], saved[:] = 0, 0
        leaves[starts[whole]], saved[starts[whole]] = below[whole], kept[whole]
        lists = [",".join(map(str, conv[s:s + e])) if e else None for s, e in zip(starts, ended, strict=True)]
        frame = pd.DataFrame({
            "whole": whole, "block": block, "side": edge, "depth": depth, "conv_id": smallest, "n_convs": members,
            "n_children": children, "n_leaves": below, "saved_tokens": kept, "ends": lists, "chars": chars_of, "start": starts})
        keys = [None if w else (first if s == 0 else last) for w, s in zip(whole, edge, strict=True)]
        frame["key"] = [k and k[depth] for k in keys]
        frame["up"] = [k and [k[depth - (1 << i)] for i in range(depth.bit_length())] for k in keys]
        frames.append(frame)
    for frame, above in zip(frames, frames[1:], strict=False):
        at = np.searchsorted(above["start"].to_numpy(), frame["start"].to_numpy(), "right") - 1
        parent_whole, parent_side = above["whole"].to_numpy()[at], above["side"].to_numpy()[at]
        frame["parent_conv_id"] = pd.array(np.where(parent_whole, above["conv_id"].to_numpy()[at], 0), "Int64")
        frame.loc[~parent_whole, "parent_conv_id"] = pd.NA
        frame["parent_side"] = parent_side
        # children that are parts themselves are counted when all parts are known
        parts = np.bincount(at[~frame["whole"].to_numpy()], minlength=len(above))
        above["n_children"] -= parts
    frames[-1]["parent_conv_id"], frames[-1]["parent_side"] = pd.array([pd.NA], "Int64"), -1
    out = pd.concat(frames, ignore_index=True)
    ends = out.loc[out["whole"], "ends"]
    out.loc[out["whole"], "ends"] = [_NOTHING if e is None else hashlib.sha256(e.encode()).hexdigest() for e in ends]
    return out[_COLUMNS]


def _blocks(cells: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        partition, number = TaskContext.get().partitionId(), 0
        conv, paths, chars, width = [], [], [], 0
        for batch in batches:
            for c, path, sizes in zip(batch["conv_id"], batch["path"], batch["chars"], strict=True):
                wider = max(width, len(path) // HEX)
                if conv and (len(conv) + 1) * wider > cells:
                    yield block_nodes(np.array(conv, np.int64), paths, chars, partition << 32 | number)
                    conv, paths, chars, wider = [], [], [], len(path) // HEX
                    number += 1
                conv.append(c)
                paths.append(path)
                chars.append(sizes)
                width = wider
        if conv:
            yield block_nodes(np.array(conv, np.int64), paths, chars, partition << 32 | number)

    return cut


def _hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the pieces of each node, which come together and in order."""
    now, running = None, None
    for batch in batches:
        out = []
        for key, piece in zip(batch["key"], batch["ends"], strict=True):
            if key != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = key, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(now, running.hexdigest())], columns=["key", "ends_sha256"])


def _recombined(parts: DataFrame) -> DataFrame:
    """The nodes that lie across blocks, one row each, with ``key``."""
    summed = parts.groupBy("key").agg(
        F.first("up").alias("up"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    summed = keep(summed)
    kids = summed.where("depth > 0").groupBy(F.col("up")[0].alias("key")).agg(F.count("*").alias("kids"))
    nodes = keep(
        summed.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0))).drop("kids")
        .withColumn("n_leaves", F.col("n_leaves") + (F.col("n_children") == 0).cast("long"))
        .withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    for step in range(int(deepest).bit_length()):
        # a node's sums so far are of its subtree less than 2 ** step levels down
        lower = nodes.where(F.size("up") > step).groupBy(F.col("up")[step].alias("key")).agg(
            F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        nodes = keep(
            nodes.join(lower, "key", "left")
            .withColumn("n_leaves", F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0)))
            .withColumn("saved_tokens", F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0)))
            .drop("more_leaves", "more_saved"))
    ends = (
        parts.where("ends is not null").select("key", "block", "ends").repartition("key").sortWithinPartitions("key", "block")
        .mapInPandas(_hashed, "key binary, ends_sha256 string"))
    above = nodes.select(F.col("key").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.withColumn("above", F.when(F.size("up") > 0, F.col("up")[0])).join(above, "above", "left").join(ends, "key", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_NOTHING)))
    )


def prefix_trie(lists: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of ``conv_id, turns``, conv_id being unique and turns arrays of ``(id, chars)``.

    ``conv_id`` smallest member, ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` members,
    ``n_children``, ``n_leaves`` childless nodes of the subtree, ``saved_tokens`` code points that its nodes
    need not repeat, ``ends_sha256`` of the comma-joined ids that end here. A conversation without
    turns ends at the root. No conversations, no nodes. A block has at most ``cells`` cells, or one row.
    """
    paths = keep(lists.select(
        "conv_id", F.array_join(F.transform("turns", lambda t: t["id"]), "").alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars")))
    found = keep(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id").mapInPandas(_blocks(cells), _PARTS))
    parts = found.where(~F.col("whole"))
    across = keep(_recombined(parts))
    places = parts.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), "key").join(
        across.select("key", F.col("conv_id").alias("above")), "key").drop("key")
    whole = found.where("whole").withColumnRenamed("ends", "ends_sha256")
    under_part = (
        whole.where("parent_conv_id is null").join(places, ["block", "parent_side", "depth"])
        .withColumn("parent_conv_id", F.col("above")))
    return whole.where("parent_conv_id is not null").select(*NODE).union(under_part.select(*NODE)).union(across.select(*NODE))


CHECK = f"""
WITH lists AS (
    SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own,
        {sql_crc32("conv_id::VARCHAR")} % 6 AS h FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (
    SELECT c.conv_id, list_concat(coalesce(list_slice(b.own, 1, c.h), []), list_slice(c.own, c.h + 1, len(c.own))) AS path
    FROM lists c LEFT JOIN lists b ON b.conv_id = c.conv_id - c.conv_id % 100),
steps AS (SELECT conv_id, path, unnest(range(0, len(path) + 1)) AS depth FROM rebuilt),
members AS (SELECT conv_id, depth, list_slice(path, 1, depth) AS prefix, len(path) = depth AS ends FROM steps),
nodes AS (
    SELECT min(conv_id) AS conv_id, depth, prefix, count(*) AS n_convs, CASE WHEN depth > 0 THEN length(prefix[depth].t) ELSE 0 END AS chars,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM members GROUP BY depth, prefix),
belongs AS (SELECT m.conv_id AS member, depth, n.conv_id AS node FROM members m JOIN nodes n USING (depth, prefix)),
linked AS (SELECT n.*, b.node AS parent_conv_id FROM nodes n LEFT JOIN belongs b ON b.member = n.conv_id AND b.depth = n.depth - 1),
children AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY 1, 2),
counted AS (SELECT l.*, coalesce(n_children, 0) AS n_children FROM linked l LEFT JOIN children c USING (conv_id, depth)),
sums AS (
    SELECT b.node AS conv_id, b.depth, count(*) FILTER (c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.chars) AS saved_tokens
    FROM counted c JOIN belongs b ON b.member = c.conv_id AND b.depth <= c.depth GROUP BY 1, 2)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves,
    saved_tokens::BIGINT AS saved_tokens, ends_sha256 FROM counted JOIN sums USING (conv_id, depth)
"""


@query("op11_conversation_trie", CHECK)
def op11(spark, folder):
    return prefix_trie(with_shared_heads(turn_lists(table(spark, folder, "conversations"))))
