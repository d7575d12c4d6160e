"""Linear maps of coordinates, and fractions above a cutoff in a fixed number of bins."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc.functions.statistics import mann_whitney
from spatiarc.operators.raster import explicit_cutoffs
from spatiarc.plans.lookup import Lookup
from spatiarc.sources.points import PointSet


def transform_matrix(rotate: float = 0, mirror: str | None = None, operator=None) -> list[list[float]]:
    """Mirror (N: not, X: negate x, Y: negate y) first, then a clockwise rotation; or the given 2 x 2 matrix. Quarter turns are exact."""
    if operator is not None:
        m = [[float(v) for v in row] for row in operator]
        if len(m) != 2 or any(len(row) != 2 for row in m):
            raise ValueError("operator must be 2 x 2")
        return m
    quarter = {0: (1.0, 0.0), 90: (0.0, 1.0), 180: (-1.0, 0.0), 270: (0.0, -1.0)}
    if rotate not in quarter:
        raise ValueError("rotate is 0, 90, 180 or 270")
    side = str(mirror or "N").upper()
    if side not in ("N", "X", "Y"):
        raise ValueError("mirror is N, X or Y")
    c, s = quarter[rotate]
    mx, my = (-1.0 if side == "X" else 1.0), (-1.0 if side == "Y" else 1.0)
    return [[c * mx + 0.0, s * my + 0.0], [-s * mx + 0.0, c * my + 0.0]]  # no negative zeros


def adjust(points: PointSet, feature: str | None = None, sample=None, rotate: float = 0, mirror: str | None = None, operator=None) -> DataFrame:
    """``obs_idx, sample, x, y`` after the map, and ``value`` of the feature if one is named."""
    (a, b), (c, d) = transform_matrix(rotate, mirror, operator)
    chosen = points.where(sample)
    rows = chosen.values(feature) if feature else chosen.cells
    turn = lambda p, q: F.col("x") * F.lit(p) + F.col("y") * F.lit(q)
    return rows.select("obs_idx", "sample", turn(a, b).alias("x"), turn(c, d).alias("y"), *(["value"] if feature else []))


def bin_statistics(adjusted: DataFrame, bins=(8, 8), cutoff: float | None = 0.0, min_count: int = 10, pct_cutoff: float = 0.5, mask: DataFrame | None = None) -> DataFrame:
    """``sample, row, col, n, pct, mask`` of every bin of each sample; rows count from the greatest y down.

    A bin is the number of inner edges at or below a coordinate. ``pct`` is the share of values above the cutoff (None:
    the sample's mean) where more than ``min_count`` points have one; ``mask`` is pct > ``pct_cutoff`` unless a table
    (row, col, mask) gives it.
    """
    ny, nx = map(int, bins)
    if ny < 1 or nx < 1:
        raise ValueError("bins must be positive")
    span = adjusted.groupBy("sample").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.avg("value").alias("mean"))

    def place(c, low, high, n):
        """Inner edges ``low + i * step`` at or below a coordinate: a quotient, put right by the edges beside it."""
        step = (F.col(high) - F.col(low)) / n
        edge = lambda i: F.col(low) + i * step
        guess = F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor((F.col(c) - F.col(low)) / F.when(step > 0, step)))).cast("int")
        more = ((guess + 1 < n) & (F.col(c) >= edge(guess + 1))).cast("int")
        less = ((guess > 0) & (F.col(c) < edge(guess))).cast("int")
        return F.when(step > 0, guess + more - less).otherwise(F.lit(n - 1))

    spans = Lookup(span, ["sample"])
    at = spans.join(adjusted)
    at = at.withColumn("col", place("x", "x0", "x1", nx)).withColumn("row", F.lit(ny - 1) - place("y", "y0", "y1", ny))
    level = F.col("mean") if cutoff is None else F.lit(float(cutoff))
    by = at.groupBy("sample", "row", "col").agg(F.count("value").alias("n"), F.avg((F.col("value") > level).cast("double")).alias("share"))
    frame = spans.table.select("sample", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))).alias("row")).select("sample", "row", F.explode(F.sequence(F.lit(0), F.lit(nx - 1))).alias("col"))
    out = frame.join(by, ["sample", "row", "col"], "left").na.fill(0, ["n"]).withColumn("pct", F.when(F.col("n") > min_count, F.col("share"))).drop("share")
    if mask is None:
        return out.withColumn("mask", F.coalesce(F.col("pct") > pct_cutoff, F.lit(False)).cast("int"))
    given = F.broadcast(whole_mask(mask, ny, nx))  # as many rows as bins
    return out.join(given, ["row", "col"], "left").select("sample", "row", "col", "n", "pct", "mask")


def whole_mask(mask: DataFrame, ny: int, nx: int) -> DataFrame:
    """A table (row, col, mask) that holds each of the ny x nx bins once; others raise."""
    rows = mask.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), F.col("mask").cast("int").alias("mask"))
    inside = F.col("row").between(0, ny - 1) & F.col("col").between(0, nx - 1) & F.col("mask").isNotNull()
    seen = rows.agg(F.count("*").alias("n"), F.count_if(inside).alias("inside"), F.count_distinct("row", "col").alias("bins")).first()
    if not seen.n == seen.inside == seen.bins == ny * nx:
        raise ValueError(f"the mask must have one value for each of {ny} x {nx} bins")
    return rows


def bin_test(stats: DataFrame) -> DataFrame:
    """Per sample: means of pct where mask is 1 and 0, and the two-sided Mann-Whitney test between them."""
    return mann_whitney(stats.select("sample", F.col("pct").alias("value"), F.col("mask").alias("grp")), "sample")


def resolve_bin_cutoff(cutoff, feature: str) -> float | None:
    """A number, None, or the feature's own in a mapping, which must have it."""
    if cutoff is None or isinstance(cutoff, (int, float)):
        return None if cutoff is None or math.isnan(cutoff) else float(cutoff)
    given = explicit_cutoffs(cutoff)
    if feature not in given:
        raise KeyError(f"no cutoff for {feature!r}")
    return given[feature]


def bin_edges(adjusted: DataFrame, bins=(8, 8)) -> DataFrame:
    """Per sample, all edges along x and y."""
    ny, nx = map(int, bins)
    span = adjusted.groupBy("sample").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    line = lambda a, b, n: F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.col(a) + i * ((F.col(b) - F.col(a)) / n))
    return span.select("sample", line("x0", "x1", nx).alias("x_edges"), line("y0", "y1", ny).alias("y_edges"))


