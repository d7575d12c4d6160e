"""Exact top-k inner products by Fagin's threshold algorithm.

Components are floor(64 x). Each shard keeps, per dimension, its rows sorted by component. Queries of a block go down all
lists together, from the top where a query's component is positive and from the bottom where it is negative, in steps of
growing depth. Rows that a step shows first under sorted access are scored exactly for the whole block at once (a superset
of what each query alone would look up, so no query misses any). A query stops as soon as its threshold, the inner product
of itself with the components last seen on its lists, cannot beat its kth score; equal scores go to smaller ids, so it
stops only strictly below the kth, its own or the one that seed rows show (``search_shards``). Scores are integers and exact:
products run in doubles where no sum can pass 2**53, else in Python's integers, and a score beyond 64 bits raises.

Defined cases: an empty table gives no rows; vectors null, empty (no component to score), or with null or non-finite components take no part, nor do null ids; queries with
fewer candidates return all; repeated vec_ids are candidates each, one of them is the query, and a row never matches its own vec_id; extra columns
play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from spatiarc.llm.common import table
from spatiarc.llm.vectors import packed, search_shards, usable

K, EVERY, SCALE, FIRST_DEPTH, SAFE, LEAST = 20, 20, 64.0, 64, 2.0**53, -(1 << 63)


def whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exactly: in doubles where no sum can pass 2**53, else in Python's integers; a score beyond
    64 bits raises."""
    largest = np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1]
    if largest <= SAFE:
        return (q @ x.T).astype(np.int64)
    if not np.isfinite(q).all() or not np.isfinite(x).all():
        raise OverflowError("a scaled component is beyond the range of doubles")
    a, b = (np.array([[int(v) for v in row] for row in m], object).reshape(m.shape) for m in (q, x))
    out = a @ b.T
    if out.size and max(-out.min(), out.max()) >= 1 << 63:
        raise OverflowError("an inner product is beyond 64 bits")
    return out.astype(np.int64)


class ThresholdLists:
    """Sorted per-dimension lists of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int = K):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.k = ids[order], x[order], k
        self.lists = np.argsort(-self.x, axis=0, kind="stable").astype(np.int32)  # by dimension: rows from the largest component down
        self.sorted = np.take_along_axis(self.x, self.lists, axis=0)
        self.looked_up = self.rounds = 0

    def search(self, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray | None = None):
        """``bounds``: scores that k rows elsewhere reach, NaN where unknown; what is below can't be among the best."""
        n, k = len(self.ids), self.k
        floor = np.full(len(q), -np.inf) if bounds is None else np.where(np.isnan(bounds), -np.inf, bounds)
        top = np.full((len(q), k + 1), LEAST, np.int64)  # one more, for the query's own row
        where = np.full((len(q), k + 1), -1, np.int64)
        seen, on = np.zeros(n, bool), np.arange(len(q))
        depth, at = FIRST_DEPTH, 0
        while at < n and len(on):
            to = min(n, at + depth)
            pos, neg = (q[on] > 0).any(0), (q[on] < 0).any(0)  # a list is read only from ends that some query wants
            shown = np.unique(np.concatenate([self.lists[at:to, pos].ravel(), self.lists[n - to : n - at, neg].ravel()]))
            fresh = shown[~seen[shown]]
            seen[fresh] = True
            self.looked_up, self.rounds = self.looked_up + len(fresh), self.rounds + 1
            for a in range(0, len(fresh), 8192):
                rows = fresh[a : a + 8192]
                scores = whole_scores(q[on], self.x[rows])
                allowed = (query_ids[on][:, None] != self.ids[rows][None, :]) & (scores >= floor[on][:, None])
                self._keep(top, where, on, scores, allowed, rows)
            edge = np.where(q[on] > 0, self.sorted[to - 1], self.sorted[n - to])
            threshold = (q[on] * edge).sum(1)
            slack = 1e-9 * (np.abs(q[on]) * np.abs(edge)).sum(1)  # for sums that doubles round
            done = threshold + slack < np.maximum(np.where(where[on, k - 1] >= 0, top[on, k - 1], -np.inf), floor[on])
            on = on[~done] if not seen.all() else on[:0]
            at, depth = to, depth * 2
        r, c = np.nonzero(where[:, :k] >= 0)
        return query_ids[r], self.ids[where[r, c]], top[r, c]

    def _keep(self, top, where, on, scores, allowed, fresh):
        """Merge new scores into the best, equal ones by smaller id (rows lie in order of id)."""
        k = self.k
        kth = top[on, k - 1]
        if scores.shape[1] > k:  # what is below a row's own kth new score can't stay either
            kth = np.maximum(kth, np.partition(np.where(allowed, scores, LEAST), -k, axis=1)[:, -k])
        r, c = np.nonzero(allowed & (scores >= kth[:, None]))
        for i in np.unique(r):
            a, b = np.searchsorted(r, [i, i + 1])
            row = on[i]
            old = where[row] >= 0
            s = np.concatenate([top[row][old], scores[i, c[a:b]]])
            w = np.concatenate([where[row][old], fresh[c[a:b]]])
            keep = np.lexsort((w, ~s))[: k + 1]  # ~s falls as s rises, without the overflow of -s
            top[row, : len(keep)], where[row, : len(keep)] = s[keep], w[keep]


def seed_bounds(k: int):
    """For queries, the kth best score among some rows; NaN if there are fewer or if doubles can't hold it exactly."""

    def bound(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(ids) <= k or not np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] <= SAFE:
            return np.full(len(q), np.nan)
        scores = np.where(query_ids[:, None] == ids[None, :], -np.inf, q @ x.T)
        kth = np.partition(scores, -k, axis=1)[:, -k]
        return np.where(np.isfinite(kth), kth, np.nan)

    return bound


def exact_top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: float = SCALE) -> DataFrame:
    def shard(ids, x):
        return ThresholdLists(ids, x, k).search

    return search_shards(packed(usable(vectors, nonzero=False), scale), every, k, shard, seed_bounds(k), "desc")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""
