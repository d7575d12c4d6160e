"""Named queries over the fixture, one per operator. Averages are rounded where engines sum in different orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc import api
from spatiarc.functions.expressions import radius_steps, shift_rows, shift_table
from spatiarc.functions.statistics import density, proportion_test
from spatiarc.operators import adjust as A
from spatiarc.operators import cutoffs as C
from spatiarc.operators import displace as D
from spatiarc.operators import module_scores as M
from spatiarc.operators import niches as N
from spatiarc.operators import plotdata as P
from spatiarc.operators import radius as R
from spatiarc.operators import raster as G
from spatiarc.plans.scratch import Scratch
from spatiarc.sources.fixtures import SETS, fixture
from spatiarc.sources.points import PointSet
from spatiarc.streaming.raster_stream import stream_raster

T, F1, F2 = "hypoxia_score", "inflammation_score", "noise_score"
FEATURES = [F1, F2]
RADIUS = 15.1


def rounded(df: DataFrame, *names: str, digits: int = 9) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _raster(agg):
    return lambda s, d: rounded(G.raster(fixture(s, d), [T, F1], agg=agg), T, F1)


def _map(s, d):
    return rounded(G.feature_map(fixture(s, d), T, quantile=0.75), "value", "cutoff")


def _adjust(**how):
    return lambda s, d: A.adjust(fixture(s, d), T, sample="view", **how).select("obs_idx", "sample", "x", "y", F.round("value", 9).alias("value"))


def _bins(s, d):
    return rounded(A.bin_statistics(A.adjust(fixture(s, d), T), bins=(6, 8), cutoff=2.0, min_count=3, pct_cutoff=0.4), "pct")


def _bin_test(s, d):
    return A.bin_test(A.bin_statistics(A.adjust(fixture(s, d), T), bins=(6, 8), cutoff=2.0, min_count=3, pct_cutoff=0.4))


def _cohort(level, method, part="cutoffs", **how):
    def run(s, d):
        got = getattr(C.cohort_cutoffs(fixture(s, d), [T, F1], level=level, method=method, round_to=100, check=False, **how), part)
        return rounded(got, *[c for c in ("cutoff", "sample_mean", "sample_median") if c in got.columns])

    return run


def _proportions(level):
    return lambda s, d: rounded(C.positive_proportions(fixture(s, d), {T: 1.5, F1: 2.5}, level=level), "positive_fraction")


def _niches(s, d, features=(T,), connectivity=8, **how) -> N.Niches:
    given = {T: 1.5, F1: 2.5}
    return N.find_niches(fixture(s, d), list(features), {f: given[f] for f in features}, min_grids=3, connectivity=connectivity, **how)


def _niche_grids(connectivity, **how):
    return lambda s, d: _niches(s, d, connectivity=connectivity, **how).grids.select("sample", "feature", "gx", "gy", "n_cells", "positive", "niche", "niche_id")


def _niche_summary(s, d):
    found = _niches(s, d).summary
    return rounded(found, *[c for c, t in found.dtypes if t == "double"])


def _annotated(s, d):
    points = fixture(s, d)
    return N.annotate(points, _niches(s, d)).select("obs_idx", "sample", "hypoxia_score_positive_grid", "hypoxia_score_niche", "hypoxia_score_niche_id")


def _cordstat(steps):
    def run(s, d):
        return D.displacement_table(fixture(s, d), T, F1, steps, grid_size=20.0)

    return run


def _cordstat_summary(s, d):
    return rounded(D.displacement_summary(_cordstat((4, 4, 4, 4))(s, d)), *D.STAT_COLUMNS)


def _vectors(s, d, **how):
    return D.grid_vectors(fixture(s, d), T, FEATURES, **how)


def _vector_rows(df: DataFrame) -> DataFrame:
    doubles = [c for c, t in df.dtypes if t == "double" and c != "step"]
    return rounded(df, *doubles)


def _sample_vectors(s, d):
    return _vector_rows(D.grid_vectors(fixture(s, d).where("view"), T, FEATURES))


def _cohort_vectors(s, d):
    return rounded(D.cohort_vectors(_vectors(s, d)), "min_djaccard", "max_djaccard")


def _niche_vectors(s, d):
    return _vector_rows(_vectors(s, d, niches=_niches(s, d)))


def _projected(s, d):
    return rounded(D.projected_score(D.cohort_vectors(_vectors(s, d))), "projected_score")


def _lengths(s, d):
    return rounded(D.vector_length(D.cohort_vectors(_vectors(s, d))), "vector_len")


def _sample_projected(s, d):
    v = _vectors(s, d)
    return rounded(D.projected_score(v, ["sample"]).join(D.vector_length(v, ["sample"]), ["sample", "feature"]), "projected_score", "vector_len")


def _pairs(s, d):
    masks, _ = D.wide_masks(fixture(s, d), [T, F1, F2])
    return D.pairwise_scores(masks, [T, F1, F2], 12)


def _matrix(s, d):
    return rounded(D.pairwise_matrix(_pairs(s, d), [T, F1, F2]), T, F1, F2)


def _radius_domain(s, d):
    return R.domain_map(fixture(s, d), T, F1, RADIUS, (20.0, -10.0)).select("obs_idx", "sample", "target_positive", "feature_positive", "target_domain", "feature_domain")


def _radius_coverage(s, d):
    points = fixture(s, d)
    actives, _ = R.active_points(points, [F1])
    return rounded(R.shift_coverage(points, actives, shift_table(s, shift_rows(radius_steps())), RADIUS), "coverage")


def _radius_vectors(**how):
    return lambda s, d: _vector_rows(R.radius_vectors(fixture(s, d), T, [F1], None, RADIUS, **how))


def _radius_pairs(s, d):
    return R.pairwise_radius_scores(fixture(s, d), [T, F1, F2], 75, RADIUS)


def _sets(s):
    return s.createDataFrame([(n, g) for n, gs in SETS.items() for g in gs], "set_name string, gene string")


def _module_scores(s, d):
    return rounded(M.module_scores(fixture(s, d), _sets(s), nbin=5, ctrl=3), "score")


def _gene_vectors(s, d):
    return _vector_rows(D.grid_vectors(fixture(s, d), "G00", ["G05"]))


def _overlay(space):
    return lambda s, d: rounded(P.overlay_counts(P.overlay(fixture(s, d), T, F1, space)), "fraction_a", "fraction_b", "fraction_overlap")


def _niche_overlay(s, d):
    found = _niches(s, d, (T, F1))
    return P.category_counts(P.niche_overlay(found, found, T, F1))


def _boundary(s, d):
    return P.boundary_segments(_niches(s, d).grids.where("niche").select("sample", "gx", "gy"), grid_size=20.0)


def _coloc(s, d):
    return rounded(P.colocalization_counts(D.projected_score(_vectors(s, d), ["sample"]), -0.05), "percent_below")


def _kde(s, d):
    return rounded(density(D.projected_score(_vectors(s, d), ["sample"]).select(F.round("projected_score", 6).alias("v")), "v"), "x", "density", digits=5)


def _paired(s, d):
    return P.paired_test(D.projected_score(_vectors(s, d), ["sample"]), F1, F2)


def _proportion(s, d):
    """The share of scores below the threshold against a half, with its p-value."""
    row = P.colocalization_counts(D.projected_score(_vectors(s, d), ["sample"]), -0.05).first()
    got = proportion_test(row.n_below, row.n, 0.5, "less")
    return s.createDataFrame([(got["proportion"], got["z"], got["pvalue"])], "proportion double, z double, pvalue double")


def _proportion_z(s, d):
    return rounded(_proportion(s, d).drop("pvalue"), "proportion", "z")


def _bin_test_u(s, d):
    return rounded(_bin_test(s, d).drop("pvalue"), "group_1", "group_0")


def _paired_w(s, d):
    return _paired(s, d).drop("pvalue")


def _layer_grid(s, d):
    points = fixture(s, d)
    other = points.expr.where("gene IN ('G00', 'G05')").select("obs_idx", "gene", F.lit("doubled").alias("layer"), (2 * F.col("value")).alias("value"))
    chosen = PointSet.of(points.cells, points.expr.unionByName(other), points.genes, sample_col="sample", coord_cols=("x", "y"), layer="doubled", check=False)
    return rounded(G.raster(chosen, ["G00", "G05"]), "G00", "G05")


def _odd_names(s, d):
    """Features called as the grid's and the points' own columns."""
    base = fixture(s, d).cells
    cells = base.select("obs_idx", F.col("sample").alias("sample_name"), F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), F.col(T).alias("gx"), F.col(F1).alias("x"), F.col(F2).alias("n_cells"))
    return rounded(G.grid_values(PointSet.of(cells, check=False), ["gx", "x", "n_cells"]), "value")


def _round_trip(s, d):
    scratch = Scratch(s, "points")
    fixture(s, d).write(scratch.root)
    return PointSet.read(s, scratch.root).cells.select("obs_idx", "sample", "x", "y", *[F.round(n, 9).alias(n) for n in (T, F1, F2)])


def _added_scores(s, d):
    return rounded(M.add_module_scores(fixture(s, d), SETS, nbin=5, ctrl=3).select("obs_idx", *SETS), *SETS)


def _bins_by_feature(s, d):
    got = api.spatial_binstat(A.adjust(fixture(s, d), T), bins=(6, 8), min_cutoff={T: 2.0, F1: 9.0}, min_count=3, pct_cutoff=0.4, feature=T)
    return rounded(got.bins, "pct")


def _bins_masked(s, d):
    mask = s.range(48).select((F.col("id") / 8).cast("int").alias("row"), (F.col("id") % 8).cast("int").alias("col"), (F.col("id") % 3 == 0).cast("int").alias("mask"))
    return rounded(A.bin_statistics(A.adjust(fixture(s, d), T), bins=(6, 8), cutoff=2.0, min_count=3, mask=mask), "pct")


def _map_cohort(s, d):
    return rounded(api.grid_feature_map(fixture(s, d), T, cutoff_method="mean_of_sample_level_means").grid, "value", "cutoff")


def _cohort_niches(s, d):
    found = N.find_niches(fixture(s, d), [T], method="mean_of_sample_means")
    return rounded(found.summary.select("sample", "feature", "cutoff", "n_positive_grids", "n_niche_grids", "n_niches", "n_niche_cells"), "cutoff")


def _niche_alias(s, d):
    """Niches of another feature stand for the target."""
    return _vector_rows(_vectors(s, d, niches={T: N.find_niches(fixture(s, d), [F1], {F1: 2.5})}))


def _radius_niche(s, d):
    return _vector_rows(R.radius_vectors(fixture(s, d), T, [F1], None, RADIUS, niches=_niches(s, d)))


def _one_niche_sample(s, d):
    found = _niches(s, d)
    name = P.one_sample(found, "view")
    return found.components.where(F.col("sample") == name).groupBy("sample", "feature").agg(F.count("*").alias("n_components"), F.count("niche_id").alias("n_niches"))


def _api_cohort(**how):
    def run(s, d):
        got = api.spatial_vectorX(fixture(s, d), T, FEATURES, **how)
        return rounded(got.projected_score.join(got.vector_len, "feature"), "projected_score", "vector_len")

    return run


def _api_kdtree(s, d):
    got = api.spatial_vector_x_kdtree(fixture(s, d), T, [F1], radius=RADIUS)
    return rounded(got.sample_projected_score.select("sample", "feature", "projected_score"), "projected_score")


def _api_kdtree_pairs(s, d):
    return rounded(api.pairwise_projected_scores_kdtree(fixture(s, d), [T, F1, F2], final_step=75, radius=RADIUS).matrix, T, F1, F2)


def _api_kdtree_obj(s, d):
    return _vector_rows(api.spatial_vector_kdtree(fixture(s, d), T, [F1], radius=RADIUS).vectors)


def _adjusted_cordstat(s, d):
    a, b = (A.adjust(fixture(s, d), n, rotate=90) for n in (T, F1))
    return api.spatial_cordstat(a, b, grid_size=20.0).mov_stat


def _cohort_overlay(s, d):
    units = P.overlay(fixture(s, d), T, F1, "grid", cutoffs={F1: 2.5}, method="mean_of_sample_means")
    return rounded(P.overlay_counts(units), "fraction_a", "fraction_b", "fraction_overlap")


def _overlay_rule(rule):
    return lambda s, d: rounded(P.overlay_counts(P.overlay(fixture(s, d), T, F1, "cell", rule)), "fraction_a", "fraction_b", "fraction_overlap")


def _niche_range_cells(s, d):
    rows = P.niche_feature_values(_niches(s, d), T, fixture(s, d), F1, "cell", quantiles=(0.1, 0.9), vmax=4.0)
    return rounded(rows.select("sample", "obs_idx", "value", "niche", "vmin", "vmax"), "value", "vmin", "vmax")


def _niche_overlay_cells(s, d):
    found = _niches(s, d, (T, F1))
    return P.category_counts(P.niche_overlay(found, found, T, F1, "cell"))


def _chosen_samples(s, d):
    got = C.cohort_cutoffs(fixture(s, d), [T, F1], ["click", "view"], method="mean_of_sample_means", check=False)
    return rounded(got.cutoffs, "cutoff")


def _edges(s, d):
    by = G.edges(fixture(s, d), 20.0)
    return by.select("sample", F.posexplode("x_edges").alias("i", "x_edge"))


def _obj_vectors(s, d):
    return _vector_rows(api.spatial_vector(fixture(s, d), T, [F1]).vectors)


def _explicit_vectors(s, d):
    return _vector_rows(_vectors(s, d, cutoffs={F1: 2.5}))


def _quantile_vectors(s, d):
    return _vector_rows(_vectors(s, d, quantiles=0.5, agg="max", min_cells=2))


def _path(s, d):
    return rounded(P.vector_path(D.cohort_vectors(_vectors(s, d))), "x0", "y0", "x1", "y1")


def _magnitude(s, d):
    v = D.cohort_vectors(_vectors(s, d))
    return rounded(P.magnitude_against_score(D.vector_length(v), D.projected_score(v)), "vector_len", "projected_score")


def _heatmap(s, d):
    return rounded(P.heatmap_cells(_pairs(s, d), [T, F1, F2]), "score", "vmin")


def _paired_scores(s, d):
    return rounded(P.paired_scores(D.projected_score(_vectors(s, d), ["sample"]), F1, F2), "a", "b")


def _domain_categories(s, d):
    return P.category_counts(P.domain_categories(fixture(s, d), T, F1, radius=RADIUS, shift=(20.0, -10.0)))


def _niche_positive(s, d, cells=False):
    points, found = fixture(s, d), _niches(s, d)
    return P.category_counts(P.niche_positive_overlay(found, T, P.positive_for(points, found, F1), points if cells else None))


def _niche_range(s, d):
    points, found = fixture(s, d), _niches(s, d)
    rows = P.niche_feature_values(found, T, points, F1)
    return rounded(rows.select("sample", "gx", "gy", "value", "niche", "vmin", "vmax"), "value", "vmin", "vmax")


def _overlap_points(s, d):
    return rounded(P.overlap_points(fixture(s, d), T, F1, {T: 1.5}, (5.0, 0.0)), "value")


def _stream_static(s, d):
    return rounded(stream_raster(fixture(s, d).cells, T), "value")


QUERIES = {
    "grid_occupancy": lambda s, d: G.occupancy(fixture(s, d), 20.0),
    "grid_mean": _raster("mean"),
    "grid_sum": _raster("sum"),
    "grid_max": _raster("max"),
    "grid_min_cells": lambda s, d: rounded(G.raster(fixture(s, d), [T], min_cells=3), T),
    "grid_feature_map_quantile": _map,
    "grid_edges": _edges,
    "stream_raster": _stream_static,
    "spatial_adjust_rot90": _adjust(rotate=90),
    "spatial_adjust_mirror": _adjust(rotate=180, mirror="X"),
    "binstat": _bins,
    "binstat_mann_whitney": _bin_test,
    "cutoff_median_of_medians_cell": _cohort("cell", "median_of_sample_medians"),
    "cutoff_mean_of_means_grid": _cohort("grid", "mean_of_sample_means"),
    "cutoff_balanced_mean": _cohort("grid", "balanced_global_mean"),
    "cutoff_balanced_median": _cohort("grid", "balanced_global_median"),
    "cutoff_sample_stats": _cohort("cell", "mean_of_sample_means", "sample_stats"),
    "cutoff_replicates": _cohort("cell", "balanced_global_mean", "replicates"),
    "positive_proportions_cell": _proportions("cell"),
    "positive_proportions_grid": _proportions("grid"),
    "niche_grids_8": _niche_grids(8),
    "niche_grids_4": _niche_grids(4),
    "niche_grids_distributed": _niche_grids(8, distributed=True),
    "niche_cells": lambda s, d: _niches(s, d).cells,
    "niche_annotation": _annotated,
    "niche_summary": _niche_summary,
    "cordstat_step4": _cordstat((4, 4, 4, 4)),
    "cordstat_operator_steps": _cordstat((2, 3, 4, 5)),
    "cordstat_summary": _cordstat_summary,
    "vectors_grid_sample": _sample_vectors,
    "vectors_grid_cohort": _cohort_vectors,
    "vectors_grid_niche_target": _niche_vectors,
    "vectors_grid_genes": _gene_vectors,
    "vectors_grid_all_points": _obj_vectors,
    "vectors_grid_explicit": _explicit_vectors,
    "vectors_grid_quantile": _quantile_vectors,
    "vector_path": _path,
    "magnitude_projected": _magnitude,
    "paired_scores": _paired_scores,
    "projected_score": _projected,
    "vector_magnitude": _lengths,
    "sample_projected_score": _sample_projected,
    "pairwise_long": _pairs,
    "pairwise_matrix": _matrix,
    "projected_heatmap": _heatmap,
    "radius_domain": _radius_domain,
    "radius_domain_categories": _domain_categories,
    "radius_coverage": _radius_coverage,
    "vectors_radius_sphere": _radius_vectors(),
    "vectors_radius_euclidean": _radius_vectors(direction_mode="euclidean"),
    "radius_min_coverage": _radius_vectors(min_coverage=0.9),
    "pairwise_radius": _radius_pairs,
    "module_gene_bins": lambda s, d: rounded(M.gene_bins(fixture(s, d), 5), "mean"),
    "module_scores": _module_scores,
    "overlay_counts_cell": _overlay("cell"),
    "overlay_counts_grid": _overlay("grid"),
    "niche_overlay_counts": _niche_overlay,
    "niche_boundary_segments": _boundary,
    "niche_positive_counts_grid": _niche_positive,
    "niche_positive_counts_cell": lambda s, d: _niche_positive(s, d, cells=True),
    "niche_feature_range": _niche_range,
    "spatial_overlap_points": _overlap_points,
    "coloc_summary": _coloc,
    "kde_curve": _kde,
    "paired_wilcoxon": _paired,
    "proportion_test": _proportion,
    "proportion_z": _proportion_z,
    "binstat_mann_whitney_u": _bin_test_u,
    "paired_wilcoxon_w": _paired_w,
    "gene_layer_grid": _layer_grid,
    "grid_odd_feature_names": _odd_names,
    "points_parquet": _round_trip,
    "module_scores_added": _added_scores,
    "binstat_feature_cutoff": _bins_by_feature,
    "binstat_given_mask": _bins_masked,
    "grid_feature_map_cohort": _map_cohort,
    "niche_cohort_cutoff": _cohort_niches,
    "vectors_grid_niche_of_another": _niche_alias,
    "vectors_radius_niche_target": _radius_niche,
    "niche_one_sample": _one_niche_sample,
    "api_vectors_cohort": _api_cohort(),
    "api_vectors_cohort_cutoff": _api_cohort(cutoff_method="mean_of_sample_level_means"),
    "api_vectors_kdtree": _api_kdtree,
    "api_vectors_kdtree_all_points": _api_kdtree_obj,
    "api_pairwise_kdtree": _api_kdtree_pairs,
    "cordstat_adjusted": _adjusted_cordstat,
    "cordstat_beyond_the_grid": _cordstat((40, 35, 50, 3)),
    "overlay_counts_cohort": _cohort_overlay,
    "overlay_counts_median": _overlay_rule("median"),
    "overlay_counts_quantile": _overlay_rule(("quantile", 0.9)),
    "overlay_counts_zero": _overlay_rule("zero"),
    "niche_feature_range_cell": _niche_range_cells,
    "niche_overlay_counts_cell": _niche_overlay_cells,
    "cutoff_chosen_samples": _chosen_samples,
}


