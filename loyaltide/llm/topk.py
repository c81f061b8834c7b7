"""Exact top-k by inner product: columnar branch and bound.

Vectors lie in vertical layout, one contiguous row per dimension.  A query adds up its inner
product with all candidates of a block a few dimensions at a time, those of largest spread first.
What the dimensions still to come can add is at most the product of both remaining norms (their
remaining mass), so every candidate has a lower and an upper bound; candidates whose upper bound
lies below the k-th best lower bound go, and the survivors are compacted.  The scores of those that
are left at the end are complete, so the result is exact, ties included.

Spark pairs blocks of queries with blocks of candidates by their block numbers; every pair of
blocks gives at most k rows per query, and a window picks the best k of those.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = 8                       # dimensions added at a time
QUERY_BLOCK = 4096
CANDIDATE_BLOCK = 4096
SCALE = 1024


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x)
                               & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    """floor(SCALE * x) with rows padded by zeros; floats while sums of products stay exact."""
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return np.floor(out * SCALE)


def search_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray,
                 ids: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """``(query_id, id, score)`` of each query's best k points of this block."""
    if not len(queries) or not len(points):
        return []
    width = points.shape[1]
    largest = max(np.abs(points).max(initial=0), np.abs(queries).max(initial=0))
    if width * largest * largest >= 2.0 ** 53:
        return _search_large(queries, query_ids, points, ids, k)
    order = np.argsort(-points.var(axis=0), kind="stable")
    columns = np.ascontiguousarray(points[:, order].T)             # one row per dimension
    asked = queries[:, order]
    cuts = [*range(0, width, STEP), width]
    rest = np.zeros((len(cuts), len(points)))                      # squared mass from a cut on
    asked_rest = np.zeros((len(cuts), len(asked)))
    for c in range(len(cuts) - 2, -1, -1):
        part = slice(cuts[c], cuts[c + 1])
        rest[c] = rest[c + 1] + (columns[part] ** 2).sum(axis=0)
        asked_rest[c] = asked_rest[c + 1] + (asked[:, part] ** 2).sum(axis=1)
    rest, asked_rest = np.sqrt(rest), np.sqrt(asked_rest)
    out: list[tuple[int, int, int]] = []
    for q in range(len(asked)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = np.zeros(len(alive))
        for c in range(len(cuts) - 1):
            part = slice(cuts[c], cuts[c + 1])
            score += asked[q, part] @ columns[part][:, alive]
            if len(alive) <= k:
                continue
            reach = asked_rest[c + 1, q] * rest[c + 1][alive]
            low = score - reach
            bar = np.partition(low, len(low) - k)[len(low) - k]    # k-th best lower bound
            keep = score + reach >= bar - 1e-9 * (1.0 + np.abs(bar))
            if not keep.all():
                alive, score = alive[keep], score[keep]
        best = np.lexsort((ids[alive], -score))[:k]
        out += [(int(query_ids[q]), int(ids[alive[b]]), int(score[b])) for b in best]
    return out


def _search_large(queries, query_ids, points, ids, k):
    """The same with whole numbers of any size, for components beyond the exact range of doubles;
    scores end at the limits of a 64-bit integer."""
    whole = [[int(x) for x in p] for p in points]
    top = 2 ** 63 - 1
    out = []
    for query, qid in zip(queries, query_ids, strict=True):
        q = [int(x) for x in query]
        scored = sorted(((-max(-top - 1, min(top, sum(a * b for a, b in zip(q, p, strict=True)))),
                          int(i)) for p, i in zip(whole, ids, strict=True) if i != qid))[:k]
        out += [(int(qid), i, -s) for s, i in scored]
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
          vector_col: str = "embedding", candidate_block: int = CANDIDATE_BLOCK,
          query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's best k rows of ``vectors``, its own id apart.

    Rows with a null id or a vector that is null or holds null or non-finite components take no
    part; shorter vectors count as padded with zeros; a query id that occurs repeatedly is asked
    once (its smallest vector), repeated candidates are candidates each; ties go to the smaller id;
    fewer candidates than k give fewer rows; empty tables give an empty result; other columns are
    not read.
    """
    pick = [F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v")]
    points = vectors.select(*pick).filter(F.col("id").isNotNull() & usable(F.col("v")))
    asked = (queries.select(*pick).filter(F.col("id").isNotNull() & usable(F.col("v")))
             .groupBy("id").agg(F.min("v").alias("v")))
    n, m = points.count(), asked.count()
    blocks = max(1, math.ceil(n / candidate_block), min(64, math.ceil(n / 256)))
    query_blocks = max(1, math.ceil(m / query_block))
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    points = points.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)).cast("int"))
    points = points.withColumn("query_block", every(query_blocks))
    asked = asked.withColumn("query_block", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
    asked = asked.withColumn("block", every(blocks))

    def pair(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.array([], "int64") for c in names})
        width = max(left["v"].map(len).max(), right["v"].map(len).max(), 1)
        rows = search_block(_matrix(left["v"], width), left["id"].to_numpy(),
                            _matrix(right["v"], width), right["id"].to_numpy(), k)
        return pd.DataFrame(rows, columns=names).astype("int64")

    by = ["block", "query_block"]
    found = (asked.groupBy(*by).cogroup(points.groupBy(*by))
             .applyInPandas(pair, "query_id bigint, vec_id bigint, score bigint"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM q JOIN v ON v.vec_id <> q.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)
                            AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
