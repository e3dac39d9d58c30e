"""Exact nearest neighbours by inner product: a block matrix join over int8 tiles.

Queries and candidates are dealt to blocks by a hash of their id; each pair of blocks is one task. In it, vectors
are rounded to int8 with a scale of their own, and a tile's products come from one matrix product of small integers.
For a vector x with steps of s and rounded form x', |q.x - q'.x'| <= (|q|_1 s_x + |x'|_1 s_q) / 2. A candidate whose
upper bound lies under the k-th best lower bound is dropped; the others are computed again in double precision,
each as the same sum over its own components, so equal vectors score alike. Each query keeps a heap of its k best
as tiles pass; the blocks' heaps are merged by rank. The bounds are sure, so the result is exact.

Equal candidate vectors of a block are multiplied once and hold their k + 1 smallest ids, which is all that k
neighbours can need. Vectors that are null, zero or hold null or non-finite components, and rows of a null id, take
no part. Rows that share an id are one vector (the largest as an array); vectors of different lengths never meet.
Fewer candidates than k: all of them. No rows: none. Extra columns: ignored, whatever their names.

Every query block meets every candidate block, so what is shuffled grows with the square of the table, divided by the block
size; that is the price of an exact search, and of no vector being left out of an index.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.llm.common import stored, table

K, EVERY = 20, 20
QUERY_BLOCK, CANDIDATE_BLOCK, TILE, SLICE = 16_384, 16_384, 4_096, 512
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v of the vectors that take part, in double precision, one a id."""
    v = F.col(embedding).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    kept = vectors.where(F.col(vec_id).isNotNull() & F.col(embedding).isNotNull()).where(fine)
    return kept.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.max(v).alias("v"))


def rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    step = np.abs(x).max(axis=1) / 127
    step[step == 0] = 1  # subnormal
    return np.rint(x / step[:, None]).astype(np.int8), step


def tile_bounds(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Approximate products of all pairs and how far they may be off."""
    (a, s), (b, t) = rounded(q), rounded(x)
    wide = np.float32 if q.shape[1] * 127**2 < 2**24 else np.float64  # small integers: the product is exact
    with np.errstate(all="ignore"):
        near = (a.astype(wide) @ b.astype(wide).T).astype(np.float64) * s[:, None] * t
        off = (np.abs(q).sum(1)[:, None] * t + s[:, None] * (np.abs(b.astype(np.float64)).sum(1) * t)) / 2
        return near, off * (1 + 1e-9) + np.abs(near) * 1e-9


def search(queries: pd.DataFrame, candidates: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of these candidates for each of these queries."""
    out: list[tuple] = []
    for d, group in queries.groupby(queries["v"].map(len)):
        own = candidates[candidates["v"].map(len) == d].sort_values("vec_id")
        if own.empty:
            continue
        q, x = np.stack(group["v"].to_list()), np.stack(own["v"].to_list())
        x = np.ascontiguousarray(x + 0.0)  # -0.0 equals 0.0
        _, first, which = np.unique(x.view([("", x.dtype)] * d).ravel(), return_index=True, return_inverse=True)
        ids: list[list[int]] = [[] for _ in first]
        for i, u in zip(own["vec_id"], which.ravel()):
            if len(ids[u]) <= k:
                ids[u].append(int(i))
        x = x[first]
        heaps: list[list] = [[] for _ in range(len(q))]
        ids_asked = group["vec_id"].tolist()
        for at in range(0, len(x), TILE):
            tile = x[at : at + TILE]
            for top in range(0, len(q), SLICE):  # bounds of a slice are held, not of all queries
                near, off = tile_bounds(q[top : top + SLICE], tile)
                low, high = near - off, near + off
                least = np.partition(low, len(tile) - k - 1, axis=1)[:, len(tile) - k - 1] if len(tile) > k else np.full(len(low), -np.inf)
                for r, me in enumerate(ids_asked[top : top + SLICE], top):
                    bar = max(least[r - top], heaps[r][0][0]) if len(heaps[r]) == k else least[r - top]
                    live = np.flatnonzero(~(high[r - top] < bar))
                    with np.errstate(all="ignore"):
                        exact = np.cumsum(tile[live] * q[r], axis=1)[:, -1]  # summed from left to right
                    for score, u in zip(exact.tolist(), live.tolist()):
                        for i in ids[at + u]:
                            if i == me:
                                continue
                            if len(heaps[r]) < k:
                                heapq.heappush(heaps[r], (score, -i))
                            elif (score, -i) > heaps[r][0]:
                                heapq.heapreplace(heaps[r], (score, -i))
                            else:
                                break  # larger ids of the same vector rank lower
        out += [(me, -i, score) for me, heap in zip(ids_asked, heaps) for score, i in heap]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row whose id is divisible by `every`."""
    kept = stored(usable(vectors, vec_id, embedding), "vectors")
    asked = kept.where(F.col("vec_id") % every == 0)
    n, m = kept.count(), asked.count()
    rows, columns = max(1, math.ceil(m / QUERY_BLOCK)), max(1, math.ceil(n / CANDIDATE_BLOCK))
    block = lambda count: F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int")
    q = asked.withColumn("i", block(rows)).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
    c = kept.withColumn("j", block(columns)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))
    found = q.groupBy("i", "j").cogroup(c.groupBy("i", "j")).applyInPandas(lambda a, b: search(a, b, k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


ORACLE_OP9 = f"""
WITH p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= {K}
"""
