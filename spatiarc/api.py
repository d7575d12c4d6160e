"""Functions by the names that users of displacement analytics know, over ``PointSet`` and DataFrames.

Results are tables on small handles; what several of them read (rasters, labels, active points) is written when a function is
called, the rest is lazy. ``workers`` is accepted and means nothing here.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc.functions.expressions import grid_steps, names_of, radius_steps
from spatiarc.functions.statistics import proportion_test
from spatiarc.operators import adjust as _adjust
from spatiarc.operators import displace as _displace
from spatiarc.operators import radius as _radius
from spatiarc.operators.cutoffs import METHODS, Cutoffs, cohort_cutoffs, merged_cutoffs
from spatiarc.operators.cutoffs import positive_proportions as positive_proportions
from spatiarc.operators.module_scores import add_module_scores as add_module_scores
from spatiarc.operators.niches import Niches, annotate, find_niches
from spatiarc.operators.raster import edges, feature_map
from spatiarc.sources.points import PointSet

CUTOFF_METHODS = tuple(METHODS)
one_sided_proportion_test = proportion_test


@dataclass(frozen=True)
class VectorResult:
    vectors: DataFrame
    target: str
    features: list[str]
    projected_score: DataFrame
    vector_len: DataFrame
    pool_raw: DataFrame
    sample_projected_score: DataFrame
    sample_vector_len: DataFrame
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class PairwiseResult:
    matrix: DataFrame
    sample_scores: DataFrame
    settings: dict = field(default_factory=dict)


@dataclass(frozen=True)
class BinStatistics:
    bins: DataFrame
    summary: DataFrame
    edges: DataFrame
    cutoff: float | None


@dataclass(frozen=True)
class DisplacementResult:
    mov_stat: DataFrame
    mov_summary: DataFrame


@dataclass(frozen=True)
class FeatureMap:
    grid: DataFrame
    edges: DataFrame


spatial_adjust = _adjust.adjust
calculate_cutoffs = calculate_global_cutoffs = cohort_cutoffs


def spatial_binstat(adjusted: DataFrame, bins=(8, 8), min_cutoff=0.0, min_count: int = 10, pct_cutoff: float = 0.5, mask: DataFrame | None = None, feature: str | None = None) -> BinStatistics:
    level = _adjust.resolve_bin_cutoff(min_cutoff.cutoffs if isinstance(min_cutoff, Cutoffs) else min_cutoff, feature)
    table = _adjust.bin_statistics(adjusted, bins, level, min_count, pct_cutoff, mask)
    return BinStatistics(table, _adjust.bin_test(table), _adjust.bin_edges(adjusted, bins), level)


def spatial_cordstat(first: PointSet | DataFrame, second: str | DataFrame, feature: str | None = None, **how) -> DisplacementResult:
    """Of points, ``second`` is the target and ``feature`` is displaced. Or both are results of ``spatial_adjust`` over the same
    points at the same places, target first (in mappings of cutoffs they are called "first" and "second")."""
    if isinstance(first, DataFrame):
        points, target, feature = _displace.adjusted_points(first, second), "first", "second"
    else:
        points, target = first, second
    table = _displace.displacement_table(points, target, feature, **how)
    return DisplacementResult(table, _displace.displacement_summary(table))


def grid_feature_map(points: PointSet, feature: str, sample=None, grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1, quantile=None, cutoff=None, cutoff_method: str | None = None, **how) -> FeatureMap:
    """Precedence of cutoffs: quantile, explicit, cohort method, the sample's mean; a quantile with a method raises."""
    if quantile is not None and cutoff_method is not None:
        raise ValueError("quantile and cutoff_method exclude each other")
    if quantile is None and cutoff is None and cutoff_method is not None:
        found = cohort_cutoffs(points, feature, level="grid", method=cutoff_method, grid_size=grid_size, agg=agg, min_cells=min_cells, **how)
        cutoff = found.cutoffs.first().cutoff
    chosen = points.where(sample)
    return FeatureMap(feature_map(chosen, feature, grid_size, agg, min_cells, quantile, cutoff), edges(chosen, grid_size))


def define_niches(points: PointSet, features, cutoffs=None, **how) -> Niches:
    if isinstance(cutoffs, (int, float)):
        raise ValueError("give cutoffs by feature")
    return find_niches(points, features, cutoffs, **how)


def define_niche(points: PointSet, feature: str, cutoff=None, annotate_obs: bool = False, obs_prefix: str | None = None, **how):
    """Niches of one feature; with ``annotate_obs``, (niches, points with the annotation columns)."""
    found = find_niches(points, feature, cutoff, **how)
    if not annotate_obs:
        return found
    return found, replace(points, cells=annotate(points, found, feature, obs_prefix))


def kdtree_domain_map(points: PointSet, target: str, feature: str, sample=None, cutoff_method: str | None = None, cutoffs=None, quantile_cutoffs=None, niche_features=None, cutoff_samples=None, **how) -> DataFrame:
    if cutoff_method is not None and quantile_cutoffs is not None:
        raise ValueError("quantile_cutoffs and cutoff_method exclude each other")
    plain = [n for n in names_of([target, feature]) if n not in (niche_features or {})]
    if cutoff_method is not None and plain:
        cutoffs = merged_cutoffs(points, plain, cutoffs, level="cell", method=cutoff_method, samples=cutoff_samples)
    return _radius.domain_map(points.where(sample), target, feature, quantiles=quantile_cutoffs, cutoffs=cutoffs, niches=niche_features, **how)


def _vectors(points, cohort, target, features, backend, steps, cutoffs, quantile_cutoffs, cutoff_method, cutoff_samples, niche_features, cutoff_options, options):
    backend = str(backend).lower()
    if backend not in ("grid", "kdtree"):
        raise ValueError("backend is grid or kdtree")
    if cutoff_method is not None and quantile_cutoffs is not None:
        raise ValueError("quantile_cutoffs and cutoff_method exclude each other")
    niches = _displace.niche_map(niche_features)
    plain = [n for n in names_of([target, *features]) if n not in niches]
    grid = {k: options[k] for k in ("grid_size", "agg", "min_cells") if k in options}
    if cutoff_method is not None and plain:  # an unknown feature raises here, as its cutoff can't be found
        cutoffs = merged_cutoffs(cohort, plain, cutoffs, level="grid" if backend == "grid" else "cell", method=cutoff_method, samples=cutoff_samples, **grid, **cutoff_options)
    common = {"quantiles": quantile_cutoffs, "cutoffs": cutoffs, "niches": niches or None}
    if backend == "grid":
        keep = {k: v for k, v in options.items() if k in ("grid_size", "agg", "min_cells", "digits")}
        return _displace.grid_vectors(points, target, features, steps, **keep, **common)
    keep = {k: v for k, v in options.items() if k in ("radius", "direction_mode", "min_coverage", "digits")}
    return _radius.radius_vectors(points, target, features, steps, **keep, **common)


_CUTOFF_OPTIONS = ("n_repeats", "round_to", "balance_n", "seed")


def _split(options: dict) -> tuple[dict, dict]:
    options.pop("workers", None)
    allowed = {"grid_size", "agg", "min_cells", "digits", "radius", "direction_mode", "min_coverage", *_CUTOFF_OPTIONS}
    if bad := sorted(set(options) - allowed):
        raise TypeError(f"unknown options {bad}")
    return {k: v for k, v in options.items() if k in _CUTOFF_OPTIONS}, {k: v for k, v in options.items() if k not in _CUTOFF_OPTIONS}


def _result(rows: DataFrame, pooled: DataFrame, target, features, settings) -> VectorResult:
    ends = ("min_djaccard", "max_djaccard")
    by_sample = _displace.projected_score(rows, ["sample"], ends), _displace.vector_length(rows, ["sample"])
    return VectorResult(pooled, target, features, _displace.projected_score(pooled), _displace.vector_length(pooled), rows, *by_sample, settings)


def spatial_vector(points: PointSet, target: str, features, sample=None, steps=None, backend="grid", cutoffs=None, quantile_cutoffs=None, cutoff_method=None, cutoff_samples=None, niche_features=None, **options) -> VectorResult:
    """One sample, or all points as the sample "obj". A cohort method looks at every sample unless ``cutoff_samples`` are named."""
    features, (cut, rest) = names_of(features), _split(dict(options))
    chosen = replace(points, cells=points.cells.withColumn("sample", F.lit("obj"))) if sample is None else points.where(sample)
    rows = _vectors(chosen, points, target, features, backend, steps, cutoffs, quantile_cutoffs, cutoff_method, cutoff_samples, niche_features, cut, rest)
    return _result(rows, rows, target, features, {"backend": backend, "steps": steps, "cutoff_method": cutoff_method or "sample_mean", **options})


def spatial_vector_x(points: PointSet, target: str, features, samples=None, steps=None, backend="grid", cutoffs=None, quantile_cutoffs=None, cutoff_method=None, cutoff_samples=None, niche_features=None, **options) -> VectorResult:
    """A cohort: rows of every sample and their means. Named samples without points are left out with a warning."""
    features, (cut, rest) = names_of(features), _split(dict(options))
    if samples is not None:
        samples = [str(s) for s in samples]
        there = {r["sample"] for r in points.cells.where(F.col("sample").isin(samples)).select("sample").distinct().collect()}  # as many as named
        if gone := [s for s in samples if s not in there]:
            warnings.warn(f"no points of samples {gone}", stacklevel=2)
        samples = [s for s in samples if s in there]
    chosen = points.where(samples)
    rows = _vectors(chosen, points, target, features, backend, steps, cutoffs, quantile_cutoffs, cutoff_method, cutoff_samples or samples, niche_features, cut, rest)
    return _result(rows, _displace.cohort_vectors(rows).withColumn("sample", F.lit("obj")), target, features, {"backend": backend, "steps": steps, "samples": samples, "cutoff_method": cutoff_method or "sample_mean", **options})


def pairwise_projected_scores(points: PointSet, features, samples=None, final_step=None, backend="grid", cutoffs=None, quantile_cutoffs=None, cutoff_method=None, cutoff_samples=None, niche_features=None, **options) -> PairwiseResult:
    """All ordered pairs at one step (12 on a grid, 150 by radius). An unknown feature raises."""
    names, (cut, rest) = names_of(features), _split(dict(options))
    if cutoff_method is not None and quantile_cutoffs is not None:
        raise ValueError("quantile_cutoffs and cutoff_method exclude each other")
    niches = _displace.niche_map(niche_features)
    plain = [n for n in names if n not in niches]
    if plain and (missing := sorted(set(plain) - set(points.known(plain)))):
        raise KeyError(f"unknown features {missing}")
    chosen = points.where(samples)
    grid = {k: rest[k] for k in ("grid_size", "agg", "min_cells") if k in rest}
    if cutoff_method is not None and plain:
        cutoffs = merged_cutoffs(points, plain, cutoffs, level="grid" if backend == "grid" else "cell", method=cutoff_method, samples=cutoff_samples or samples, **grid, **cut)
    if backend == "grid":
        step = grid_steps([12 if final_step is None else final_step])[0]
        masks, _ = _displace.wide_masks(chosen, names, **grid, quantiles=quantile_cutoffs, cutoffs=cutoffs, niches=niches or None)
        scores = _displace.pairwise_scores(masks, names, step, rest.get("digits", 4))
    else:
        step = radius_steps([150 if final_step is None else final_step])[0]
        keep = {k: v for k, v in rest.items() if k in ("radius", "direction_mode", "min_coverage", "digits")}
        scores = _radius.pairwise_radius_scores(chosen, names, step, quantiles=quantile_cutoffs, cutoffs=cutoffs, niches=niches or None, **keep)
    return PairwiseResult(_displace.pairwise_matrix(scores, names), scores, {"backend": backend, "final_step": step, "samples": samples, **options})


def spatial_vector_kdtree(*args, **how) -> VectorResult:
    return spatial_vector(*args, backend="kdtree", **how)


def spatial_vector_x_kdtree(*args, **how) -> VectorResult:
    return spatial_vector_x(*args, backend="kdtree", **how)


def pairwise_projected_scores_kdtree(*args, **how) -> PairwiseResult:
    return pairwise_projected_scores(*args, backend="kdtree", **how)


spatial_vec_proj, spatial_vec_magnitude = _displace.projected_score, _displace.vector_length
spatial_vectorX, spatial_vectorX_kdtree, spatial_vecProj, spatial_vecMagnitude = spatial_vector_x, spatial_vector_x_kdtree, spatial_vec_proj, spatial_vec_magnitude

#: The result types under the names that users know.
SpatialVectorResult, BinStatResult, CordStatResult, GridFeatureMap, CutoffResult, NicheResult = VectorResult, BinStatistics, DisplacementResult, FeatureMap, Cutoffs, Niches
SpatialAdjusted = KDTreeDomainResult = NicheSampleResult = DataFrame
