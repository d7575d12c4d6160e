"""Approximate nearest neighbours with vantage-point trees, one per shard.

A node splits its points at the median distance to a vantage point. A query skips a child when the triangle inequality says
that nothing there can be nearer than its kth neighbour so far; the bound is relaxed by ``factor``: a child is visited only
if its least possible distance is below kth / factor. Factor one restores exact search, larger ones skip more. Queries
walk the tree together, nearer child first. Distances are Euclidean in double precision; what is returned is computed from
differences of the original vectors.

Every row is indexed, in the tree of its shard. Queries start from the kth distance that seed rows show (``search_shards``).
Defined cases: an empty table gives no rows; vectors null, empty, zero, or with null or non-finite
components take no part; queries with fewer candidates return all found; repeated vec_ids are candidates each, one of them is the query, and a row
never matches its own vec_id; ties go to smaller ids; extra columns play no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from spatiarc.llm.common import table
from spatiarc.llm.vectors import packed, search_shards, usable

K, EVERY, FACTOR, LEAF = 10, 100, 5.0, 128


class VPTree:
    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int = K, factor: float = FACTOR, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.k, self.factor = ids[order], x[order], k, factor
        self.norm = (self.x**2).sum(1)
        self.measured = 0
        self.root = self._build(np.arange(len(ids)), leaf)

    def _build(self, at: np.ndarray, leaf: int):
        if len(at) <= leaf:
            return at
        center = self.x[at].mean(0)
        vantage = at[np.argmax(((self.x[at] - center) ** 2).sum(1))]  # an outlying point splits best
        far = np.sqrt(((self.x[at] - self.x[vantage]) ** 2).sum(1))
        middle = np.median(far)
        inside, outside = at[far <= middle], at[far > middle]
        if not len(outside):
            return at  # all equally far: a leaf, however large
        split = lambda part, d: (self._build(part, leaf), d.min(), d.max())
        return vantage, split(inside, far[far <= middle]), split(outside, far[far > middle])

    def search(self, query_ids: np.ndarray, q: np.ndarray, bounds: np.ndarray | None = None):
        """``bounds``: distances within which k rows elsewhere lie, NaN where unknown; what is farther can't be among the nearest."""
        self.q, self.q_ids, self.q_norm = q, query_ids, (q**2).sum(1)
        self.bounds = np.full(len(q), np.inf) if bounds is None else np.where(np.isnan(bounds), np.inf, bounds)
        self.dist = np.full((len(q), self.k), np.inf)
        self.where = np.full((len(q), self.k), -1, np.int64)
        self._visit(self.root, np.arange(len(q)))
        r, c = np.nonzero(self.where >= 0)
        found = self.where[r, c]
        return query_ids[r], self.ids[found], np.sqrt(((q[r] - self.x[found]) ** 2).sum(1))

    def _kth(self, on: np.ndarray) -> np.ndarray:
        return np.minimum(self.dist[on, -1], self.bounds[on])

    def _visit(self, node, on: np.ndarray) -> None:
        if isinstance(node, np.ndarray):
            for a in range(0, len(node), 4096):
                self._measure(node[a : a + 4096], on)
            return
        vantage, *kids = node
        d = np.sqrt(((self.q[on] - self.x[vantage]) ** 2).sum(1))
        least = np.stack([np.maximum(0, np.maximum(low - d, d - high)) for _, low, high in kids])
        first = np.where(least[0] == least[1], d > (kids[0][2] + kids[1][1]) / 2, least[1] < least[0]).astype(int)
        for turn in (0, 1):
            for k, (kid, _, _) in enumerate(kids):
                some = ((first == k) if turn == 0 else (first != k)) & (least[k] * self.factor <= self._kth(on))
                if some.any():
                    self._visit(kid, on[some])

    def _measure(self, points: np.ndarray, on: np.ndarray) -> None:
        self.measured += len(points) * len(on)
        square = self.q_norm[on][:, None] + self.norm[points][None, :] - 2 * (self.q[on] @ self.x[points].T)
        near = square <= (self._kth(on)[:, None] * (1 + 1e-9) + 1e-7) ** 2 + 1e-9 * self.q_norm[on][:, None]
        near &= self.q_ids[on][:, None] != self.ids[points][None, :]
        rows = np.flatnonzero(near.any(1))
        r, c = np.nonzero(near[rows])
        row, point = on[rows], points[c]
        fresh = np.full((len(rows), len(points)), np.inf)
        fresh[r, c] = np.sqrt(((self.q[row[r]] - self.x[point]) ** 2).sum(1))
        d = np.concatenate([self.dist[row], fresh], 1)
        w = np.concatenate([self.where[row], np.where(np.isfinite(fresh), points, -1)], 1)
        keep = np.lexsort((np.where(w < 0, np.iinfo(np.int64).max, w), d), axis=1)[:, : self.k]
        self.dist[row], self.where[row] = np.take_along_axis(d, keep, 1), np.take_along_axis(w, keep, 1)


def seed_bounds(k: int):
    """For queries, the distance of the kth nearest of some rows; NaN if there are fewer."""

    def bound(query_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        if len(ids) <= k:
            return np.full(len(q), np.nan)
        square = (q**2).sum(1)[:, None] + (x**2).sum(1)[None, :] - 2 * (q @ x.T)
        square[query_ids[:, None] == ids[None, :]] = np.inf
        near = np.argpartition(square, k, axis=1)[:, : k + 1]
        far = np.sqrt(((q[:, None, :] - x[near]) ** 2).sum(2))
        far[query_ids[:, None] == ids[near]] = np.inf
        kth = np.sort(far, axis=1)[:, k - 1]
        return np.where(np.isfinite(kth), kth, np.nan)

    return bound


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, factor: float = FACTOR) -> DataFrame:
    def shard(ids, x):
        return VPTree(ids, x, k, factor).search

    return search_shards(packed(usable(vectors, nonzero=True)), every, k, shard, seed_bounds(k), "asc")


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
