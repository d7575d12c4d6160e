"""Rasters of point streams.

A grid needs an origin that no later point can move, so each sample's origin is given, not found. State is one row per
(sample, grid cell): counts and sums that later points are added to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc.functions.expressions import finite


def stream_raster(points: DataFrame, feature: str, origin: tuple[float, float] = (0.0, 0.0), grid_size: float = 20.0, time_col: str | None = None, watermark: str = "10 minutes", window: str | None = None) -> DataFrame:
    """``sample, gx, gy, n_cells, value`` (mean of finite values), of a streaming or static table (sample, x, y, feature). With
    ``time_col`` and ``window``, one raster per window; points later than the watermark are dropped."""
    if not grid_size > 0:
        raise ValueError("grid_size must be positive")
    at = lambda c, o: F.floor((F.col(c) - F.lit(float(o))) / F.lit(float(grid_size)) + F.lit(1e-12)).cast("bigint")
    keys = ["sample", at("x", origin[0]).alias("gx"), at("y", origin[1]).alias("gy")]
    if time_col is not None:
        points = points.withWatermark(time_col, watermark)
        if window is not None:
            keys.append(F.window(time_col, window).alias("window"))
    return points.groupBy(*keys).agg(F.count("*").alias("n_cells"), F.avg(finite(F.col(f"`{feature}`"))).alias("value"))
