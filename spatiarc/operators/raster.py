"""Points to grid cells of each sample, and features to values of grid cells.

Only the first aggregation sees points, and partial aggregation makes it small before the shuffle, so a sample with most
of the points is no hot key. Features stay columns until then and turn long afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiarc.functions.expressions import finite, names_of
from spatiarc.functions.quantiles import group_quantiles
from spatiarc.plans.lookup import Lookup
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet, column_of, unpivot

AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max}
KEYS = ("sample", "gx", "gy", "n_cells")


def place(rows: DataFrame, origins: Lookup, grid_size: float) -> DataFrame:
    """Rows (sample, x, y, ...) with ``gx, gy``: whole grid steps from the least coordinates of their sample."""
    if not grid_size > 0:
        raise ValueError("grid_size must be positive")
    at = lambda c, o: F.floor((F.col(c) - F.col(o)) / F.lit(float(grid_size)) + F.lit(1e-12)).cast("bigint")
    return origins.join(rows).withColumn("gx", at("x", "x0")).withColumn("gy", at("y", "y0"))


def occupancy(points: PointSet, grid_size: float, min_cells: int = 1) -> DataFrame:
    """``sample, gx, gy, n_cells`` of grid cells with at least ``min_cells`` points, whatever their values."""
    placed = place(points.cells.select("sample", "x", "y"), points.origins, grid_size)
    return placed.groupBy("sample", "gx", "gy").agg(F.count("*").alias("n_cells")).where(F.col("n_cells") >= min_cells)


def raster_columns(points: PointSet, features, grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1) -> DataFrame:
    """``sample, gx, gy, n_cells`` and a value per feature, ``v0, v1, ...``; NULL where no point of an occupied cell has one."""
    if agg not in AGGREGATES:
        raise ValueError(f"agg must be one of {sorted(AGGREGATES)}")
    names = names_of(features)
    placed = place(points.columns(names), points.origins, grid_size)
    by = placed.groupBy("sample", "gx", "gy").agg(F.count("*").alias("n_cells"), *[AGGREGATES[agg](f"v{i}").alias(f"v{i}") for i in range(len(names))])
    return by.where(F.col("n_cells") >= min_cells)


def raster(points: PointSet, features, grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1) -> DataFrame:
    """The same with columns by the features' names (``column_of``)."""
    names = names_of(features)
    return raster_columns(points, names, grid_size, agg, min_cells).withColumnsRenamed({f"v{i}": column_of(n, KEYS) for i, n in enumerate(names)})


def grid_values(points: PointSet, features, grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1) -> DataFrame:
    """Long: ``sample, gx, gy, n_cells, feature, value``."""
    return unpivot(raster_columns(points, features, grid_size, agg, min_cells), list(KEYS), names_of(features))


def edges(points: PointSet, grid_size: float = 20.0) -> DataFrame:
    """Per sample, the edges of the grid along x and y."""
    placed = place(points.cells.select("sample", "x", "y"), points.origins, grid_size)
    by = placed.groupBy("sample").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("gx").alias("nx"), F.max("gy").alias("ny"))
    line = lambda o, n: F.transform(F.sequence(F.lit(0).cast("bigint"), F.col(n) + 1), lambda i: F.col(o) + i * F.lit(float(grid_size)))
    return by.select("sample", line("x0", "nx").alias("x_edges"), line("y0", "ny").alias("y_edges"))


def above(value: Column, cutoff: Column) -> Column:
    """Strictly above; a missing value or cutoff is not."""
    return F.coalesce(value > cutoff, F.lit(False))


def local_cutoffs(units: DataFrame, quantiles=None, explicit=None) -> DataFrame:
    """``sample, feature, cutoff`` of long units. Precedence: quantile (a number or by feature), explicit (by feature), mean."""
    keys, table = ["sample", "feature"], quantiles if isinstance(quantiles, dict) else None
    for q in (table.values() if table is not None else [] if quantiles is None else [quantiles]):
        if not 0 <= float(q) <= 1:
            raise ValueError("quantiles lie in [0, 1]")
    if quantiles is not None and table is None:
        return group_quantiles(units, keys, float(quantiles), "cutoff")
    found = units.groupBy(*keys).agg(F.avg("value").alias("cutoff"))
    if table:
        named = F.col("feature").isin(list(table))
        found = found.where(~named)
        for q in sorted(set(map(float, table.values()))):
            found = found.unionByName(group_quantiles(units.where(F.col("feature").isin([f for f, x in table.items() if float(x) == q])), keys, q, "cutoff"))
    given = {f: c for f, c in explicit_cutoffs(explicit).items() if table is None or f not in table}
    for f, c in given.items():
        found = found.withColumn("cutoff", F.when(F.col("feature") == f, F.lit(c)).otherwise(F.col("cutoff")))
    return found


def explicit_cutoffs(given) -> dict[str, float]:
    """A mapping of finite cutoffs by feature from a mapping or a (feature, cutoff) table; others raise."""
    if given is None:
        return {}
    if isinstance(given, DataFrame):  # one row for each feature that was asked for
        given = {r.feature: r.cutoff for r in given.select("feature", finite(F.col("cutoff")).alias("cutoff")).collect()}
    if not hasattr(given, "items"):
        raise TypeError("cutoffs must be a mapping or a table of feature and cutoff")
    ok = lambda v: v is not None and float(v) == float(v) and abs(float(v)) != float("inf")
    return {str(k): float(v) for k, v in given.items() if ok(v)}


def masks(values: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Long values with ``cutoff, active, source``."""
    return Lookup(cutoffs, ["sample", "feature"]).join(values, "left").withColumn("active", above(F.col("value"), F.col("cutoff"))).withColumn("source", F.lit("positive"))


def feature_map(points: PointSet, feature: str, grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1, quantile: float | None = None, cutoff: float | None = None) -> DataFrame:
    """Raster of one feature with its cutoff: ``sample, gx, gy, n_cells, value, cutoff, positive``."""
    values = once(grid_values(points, feature, grid_size, agg, min_cells), "raster")
    cut = local_cutoffs(values, quantile, None if cutoff is None else {feature: cutoff})
    return masks(values, cut).select("sample", "gx", "gy", "n_cells", "value", "cutoff", F.col("active").alias("positive"))
