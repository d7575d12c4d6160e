"""Niches: connected groups of positive grid cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.functions.expressions import names_of, ratio
from spatiarc.operators.cutoffs import merged_cutoffs
from spatiarc.operators.raster import above, grid_values, place
from spatiarc.plans.components import connected_components
from spatiarc.plans.lookup import Lookup
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet, sanitized, write_back


#: Active cells of a sample and feature that one task labels at most (about 100 bytes each).
TASK_CELLS = 4_000_000


def neighbour_offsets(connectivity: int) -> list[tuple[int, int]]:
    if connectivity not in (4, 8):
        raise ValueError("connectivity is 4 or 8")
    return [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0) and (connectivity == 8 or 0 in (dx, dy))]


def label_grid(gx: np.ndarray, gy: np.ndarray, offsets) -> np.ndarray:
    """For each cell, the place of the first cell (in order of gy, gx) of its component: least labels, with jumps."""
    order = np.lexsort((gx, gy))
    x, y = gx[order] - gx.min(), gy[order] - gy.min()
    width = int(x.max()) + 3
    key = (y + 1) * width + x + 1
    pairs = []
    for dx, dy in offsets:
        want = key + dy * width + dx
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        on = np.flatnonzero(key[at] == want)
        pairs.append(np.stack([on, at[on]]))
    a, b = np.concatenate(pairs, axis=1)
    label = np.arange(len(key))
    while True:
        new = label.copy()
        np.minimum.at(new, label[a], label[b])
        while not np.array_equal(jump := new[new], new):
            new = jump
        if np.array_equal(new, label):
            break
        label = new
    out = np.empty_like(label)
    out[order] = label
    return out


def components(active: DataFrame, connectivity: int = 8, distributed: bool | None = None) -> DataFrame:
    """``sample, feature, gx, gy, root_gx, root_gy`` of active cells (one row each); the root is the first cell of the component in order of
    gy, gx. A (sample, feature) with at most ``TASK_CELLS`` active cells is labelled in one task; if one has more (they are counted),
    the neighbour graph is contracted over the cluster instead. ``distributed`` names the way; the labels are the same."""
    offsets, keys = neighbour_offsets(connectivity), ["sample", "feature"]
    cells = active.select(*keys, "gx", "gy")
    if distributed is None:
        most = cells.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first().n
        distributed = (most or 0) > TASK_CELLS
    if not distributed:

        def label(pdf: pd.DataFrame) -> pd.DataFrame:
            gx, gy = pdf["gx"].to_numpy(), pdf["gy"].to_numpy()
            order = np.lexsort((gx, gy))
            root = order[label_grid(gx, gy, offsets)]
            return pdf.assign(root_gx=gx[root], root_gy=gy[root])

        return cells.groupBy(*keys).applyInPandas(label, "sample string, feature string, gx bigint, gy bigint, root_gx bigint, root_gy bigint")
    nodes = cells.withColumn("node", F.struct(*keys, "gy", "gx"))
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in offsets if (dy, dx) > (0, 0)])
    moved = nodes.select("sample", "feature", F.col("node").alias("v"), "gx", "gy", F.explode(steps).alias("s"))
    moved = moved.select("sample", "feature", (F.col("gx") + F.col("s.dx")).alias("gx"), (F.col("gy") + F.col("s.dy")).alias("gy"), "v")
    edges = nodes.join(moved, [*keys, "gx", "gy"]).select(F.col("node").alias("u"), "v")
    roots = connected_components(edges, "niches").withColumnRenamed("root", "r")
    found = nodes.join(roots, "node", "left").withColumn("r", F.coalesce("r", "node"))
    return found.select(*keys, "gx", "gy", F.col("r.gx").alias("root_gx"), F.col("r.gy").alias("root_gy"))


@dataclass(frozen=True)
class Niches:
    """``grids`` (sample, feature, gx, gy, n_cells, value, cutoff, positive, niche, niche_id), ``cells`` (obs_idx, sample,
    feature, positive_grid, in_niche, niche_id), ``components`` (sample, feature, root_gx, root_gy, n_grids, niche_id) and
    ``summary``, with the geometry by which later calls check that masks fit together."""

    features: tuple[str, ...]
    grids: DataFrame
    cells: DataFrame
    components: DataFrame
    summary: DataFrame
    grid_size: float
    min_cells: int
    origins: Lookup

    def geometry(self) -> DataFrame:
        """``sample, n, fingerprint, x0, y0`` of the occupied grid."""
        one = self.grids.where(F.col("feature") == self.features[0])
        return one.groupBy("sample").agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(gx, gy))").alias("fingerprint")).join(self.origins.table, "sample")

    def check_geometry(self, occupied: DataFrame, grid_size: float, min_cells: int, origins: Lookup) -> None:
        """Raise unless the niches were found on this grid: size, least points of a cell, origins, and occupied cells."""
        if grid_size != self.grid_size:
            raise ValueError(f"niches have grid size {self.grid_size}, not {grid_size}")
        if min_cells != self.min_cells:
            raise ValueError(f"niches count grid cells of {self.min_cells} points, not {min_cells}")
        other = occupied.groupBy("sample").agg(F.count("*").alias("m"), F.expr("bit_xor(xxhash64(gx, gy))").alias("other"))
        other = other.join(origins.table.select("sample", F.col("x0").alias("x1"), F.col("y0").alias("y1")), "sample")
        moved = (F.abs(F.col("x0") - F.col("x1")) > 1e-8) | (F.abs(F.col("y0") - F.col("y1")) > 1e-8)
        bad = other.join(self.geometry(), "sample", "left").where((F.expr("n IS NULL OR n <> m OR fingerprint <> other")) | moved).select("sample").limit(3).collect()
        if bad:
            raise ValueError(f"niches have another grid in samples such as {[r['sample'] for r in bad]}")


def find_niches(
    points: PointSet, features, cutoff=None, method: str | None = "balanced_global_mean", samples=None, cutoff_samples=None, grid_size: float = 20.0, agg: str = "mean",
    min_cells: int = 1, min_grids: int = 3, connectivity: int = 8, level: str = "grid", distributed: bool | None = None, **how,
) -> Niches:
    """Niches of all features in one plan. Cutoffs: a number (one feature only) or those given by feature, else the cohort
    method; without either it raises. Components of at least ``min_grids`` cells are niches, numbered by their first cell."""
    names = names_of(features)
    if min_grids < 1:
        raise ValueError("min_grids must be positive")
    if isinstance(cutoff, (int, float)):
        if len(names) > 1:
            raise ValueError("one number can't be the cutoff of several features")
        if cutoff != cutoff or abs(cutoff) == float("inf"):
            raise ValueError("the cutoff must be finite")
        cutoff = {names[0]: cutoff}
    if cutoff is None and method is None:
        raise ValueError("give cutoffs or a method")
    chosen = points.where(samples)
    how = {"level": level, "grid_size": grid_size, "agg": agg, "min_cells": min_cells, "samples": cutoff_samples} | how
    cut = merged_cutoffs(points, names, cutoff, **how, **({"method": method} if method else {}))
    values = grid_values(chosen, names, grid_size, agg, min_cells).join(F.broadcast(cut), "feature", "left")  # one row for each named feature
    values = once(values.withColumn("positive", above(F.col("value"), F.col("cutoff"))), "niche-values")
    keys = ["sample", "feature"]
    labelled = once(components(values.where("positive"), connectivity, distributed), "niche-labels")
    sizes = labelled.groupBy(*keys, "root_gx", "root_gy").agg(F.count("*").alias("n_grids"))
    kept = sizes.where(F.col("n_grids") >= min_grids).withColumn("niche_id", F.row_number().over(Window.partitionBy(*keys).orderBy("root_gy", "root_gx")))
    sizes = sizes.join(kept.select(*keys, "root_gx", "root_gy", "niche_id"), [*keys, "root_gx", "root_gy"], "left")
    member = labelled.join(kept.select(*keys, "root_gx", "root_gy", "niche_id"), [*keys, "root_gx", "root_gy"]).select(*keys, "gx", "gy", "niche_id")
    grids = values.join(member, [*keys, "gx", "gy"], "left").select(
        *keys, "gx", "gy", "n_cells", "value", "cutoff", "positive", F.col("niche_id").isNotNull().alias("niche"), F.coalesce("niche_id", F.lit(0)).alias("niche_id")
    )
    placed = place(chosen.cells.select("obs_idx", "sample", "x", "y"), chosen.origins, grid_size).select("obs_idx", "sample", "gx", "gy")
    listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")
    cells = placed.select("*", listed).join(grids.select(*keys, "gx", "gy", "positive", "niche", "niche_id"), [*keys, "gx", "gy"], "left")
    cells = cells.select(
        "obs_idx", "sample", "feature", F.coalesce("positive", F.lit(False)).alias("positive_grid"), F.coalesce("niche", F.lit(False)).alias("in_niche"),
        F.coalesce("niche_id", F.lit(0)).alias("niche_id"),
    )
    per_grid = grids.groupBy(*keys).agg(
        F.first("cutoff").alias("cutoff"), F.count("*").alias("n_occupied_grids"), F.count_if("positive").alias("n_positive_grids"), F.count_if("niche").alias("n_niche_grids"),
        F.sum(F.when(F.col("positive"), F.col("n_cells")).otherwise(0)).alias("n_cells_in_positive_grid"), F.sum(F.when(F.col("niche"), F.col("n_cells")).otherwise(0)).alias("n_niche_cells"),
    )
    per_component = sizes.groupBy(*keys).agg(
        F.count("*").alias("n_positive_components"), F.count("niche_id").alias("n_niches"), F.max(F.when(F.col("niche_id").isNotNull(), F.col("n_grids"))).alias("largest")
    )
    n_cells = chosen.cells.groupBy("sample").agg(F.count("*").alias("n_cells"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    summary = per_grid.join(per_component, keys, "left").join(n_cells, "sample").select(
        *keys, "cutoff", "n_occupied_grids", "n_positive_grids", ratio("n_positive_grids", "n_occupied_grids").alias("positive_grid_fraction"), "n_niche_grids",
        ratio("n_niche_grids", "n_occupied_grids").alias("niche_grid_fraction"), zero("n_positive_components").alias("n_positive_components"), zero("n_niches").alias("n_niches"),
        zero("largest").alias("largest_niche_grids"), "n_cells", "n_cells_in_positive_grid", ratio("n_cells_in_positive_grid", "n_cells").alias("positive_grid_cell_fraction"),
        "n_niche_cells", ratio("n_niche_cells", "n_cells").alias("niche_cell_fraction"), (F.col("n_niche_grids") * F.lit(float(grid_size) ** 2)).alias("niche_area"),
    )
    return Niches(tuple(names), grids, cells, sizes, summary, float(grid_size), min_cells, chosen.origins)


def annotate(points: PointSet, niches: Niches, feature: str | None = None, prefix: str | None = None) -> DataFrame:
    """The points with ``<prefix>_positive_grid``, ``<prefix>_niche`` and ``<prefix>_niche_id``; points of samples that were not analysed get False and 0."""
    feature = feature or niches.features[0]
    prefix = prefix or sanitized(feature)
    one = niches.cells.where(F.col("feature") == feature).select("obs_idx", "positive_grid", "in_niche", F.col("niche_id").alias("__niche_id"))
    new = {
        f"{prefix}_positive_grid": F.coalesce("positive_grid", F.lit(False)),
        f"{prefix}_niche": F.coalesce("in_niche", F.lit(False)),
        f"{prefix}_niche_id": F.coalesce("__niche_id", F.lit(0)),
    }
    return write_back(points.cells, one, new)
