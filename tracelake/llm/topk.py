"""Exact top-k inner products by MaxScore over shards of integer vectors.

A vector's components are its terms; a shard's list of one component is a posting list. For a query
and a shard, each term has a score bound: the most that its component can add over all vectors of
the shard. Terms are walked in order of bound. The essential ones, whose bounds could still lift a
vector above the query's threshold, are added for all vectors; the others are probed only for
vectors that their remaining bounds leave competitive. The threshold starts from the first vectors
and rises with every block. Each shard gives its best k per query; the lists are merged.

Queries are a stated part of the rows. They meet all others in blocks: shards of at most
``SHARD`` vectors against blocks of ``BLOCK`` queries, each pair a task-sized group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, query, table

SHARD = 8192
BLOCK = 2048
STEP = 8
_FOUND = "query_id long, vec_id long, score long"


def best_of_shard(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """Rows ``(query index, vector index, score)``: the k best of the shard per query, ties to the smaller id."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    most, least = vectors.max(axis=0), vectors.min(axis=0)
    by_term = np.ascontiguousarray(vectors.T)
    found = []
    for q, (x, own) in enumerate(zip(queries, query_ids, strict=True)):
        bound = np.maximum(x * most, x * least)
        spread = bound - np.minimum(x * most, x * least)
        terms = np.argsort(-spread, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0)
        # a threshold from the vectors at hand: the k-th best of the first few rows
        sample = vectors[:4 * k] @ x
        sample = sample[ids[:4 * k] != own]
        floor = np.partition(sample, len(sample) - k)[len(sample) - k] if len(sample) >= k else None
        live, scores = None, np.zeros(len(ids), np.int64)
        for at in range(0, len(terms), STEP):
            part = terms[at:at + STEP]
            if live is None:
                scores += x[part] @ by_term[part]
            else:
                scores += (vectors[live][:, part] @ x[part])
            if floor is None:
                continue
            left = rest[min(at + STEP, len(terms))]
            good = scores + left >= floor
            if live is None and good.sum() * 2 > len(scores):
                continue  # most vectors are still competitive: the next terms are essential too
            live = np.flatnonzero(good) if live is None else live[good]
            scores = scores[good]
        at = np.arange(len(ids)) if live is None else live
        other = ids[at] != own
        at, scores = at[other], scores[other]
        if len(at) > k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            keep_ = scores >= cut
            at, scores = at[keep_], scores[keep_]
        top = np.lexsort((ids[at], -scores))[:k]
        found.append((np.full(len(top), q), order[at[top]], scores[top]))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, int),) * 3


def _stacked(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, :len(r)] = r
    return out


def _searched(k: int):
    def search(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or vectors.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        width = max(queries["vec"].map(len).max(), vectors["vec"].map(len).max())
        own, ids = queries["vec_id"].to_numpy(np.int64), vectors["vec_id"].to_numpy(np.int64)
        q, v, score = best_of_shard(_stacked(queries["vec"], width), own, _stacked(vectors["vec"], width), ids, k)
        return pd.DataFrame({"query_id": own[q], "vec_id": ids[v], "score": score})

    return search


def top_inner_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """``query_id, rank, vec_id, score``: per query the k highest integer inner products.

    Components become ``floor(scale * x)``. Rows with a null id, a null vector, or a null or
    non-finite component take no part. A shorter vector counts as padded by zeros. Rows that share
    the query's id are its own and no candidates; a repeated query id is searched once, with the least of its
    vectors, repeated candidate rows each count, and are dealt over shards like others. With fewer candidates than k, all are returned.
    """
    x = F.col("embedding")
    whole = keep(
        vectors.where(x.isNotNull() & F.col("vec_id").isNotNull())
        .select(F.col("vec_id").cast("long").alias("vec_id"), is_query.alias("asks"), x.cast("array<double>").alias("x"))
        .where(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))
        .select("vec_id", "asks", F.transform("x", lambda v: F.floor(v * scale)).alias("vec"), F.monotonically_increasing_id().alias("row"))
    )
    asking = whole.where("asks").groupBy("vec_id").agg(F.min("vec").alias("vec"))
    n, n_queries = whole.count(), asking.count()
    shards, blocks = max(1, -(-n // SHARD)), max(1, -(-n_queries // BLOCK))
    pairs = [F.sequence(F.lit(0), F.lit(blocks - 1)), F.sequence(F.lit(0), F.lit(shards - 1))]
    ours = whole.select("vec_id", "vec", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.explode(pairs[0]).alias("block"))
    theirs = asking.select("vec_id", "vec", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), F.explode(pairs[1]).alias("shard"))
    found = theirs.groupBy("block", "shard").cogroup(ours.groupBy("block", "shard")).applyInPandas(_searched(k), _FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


CHECK = """
WITH whole AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
    FROM whole q JOIN whole c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20
"""


@query("op10_exact_top_k", CHECK)
def op10(spark, folder):
    return top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)
