"""Micro cases by hand, properties, and errors of the spatial engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiarc import api
from spatiarc.functions.expressions import grid_steps, radius_steps, rounded_ratio, shift_rows, shift_table
from spatiarc.functions.statistics import density, exact_mann_whitney, mann_whitney, proportion_test, wilcoxon
from spatiarc.operators import displace, niches, plotdata, radius, raster
from spatiarc.operators.adjust import bin_statistics, transform_matrix
from spatiarc.operators.cutoffs import cohort_cutoffs, cutoff_level, cutoff_method, draw_size
from spatiarc.plans.components import connected_components
from spatiarc.sources.points import PointSet, sanitized
from spatiarc.streaming.raster_stream import stream_raster

NAN, INF = math.nan, math.inf


def cells(spark, rows, schema="obs_idx long, sample_name string, x_centroid double, y_centroid double, f double, g double"):
    return PointSet.of(spark.createDataFrame(rows, schema))


def line(spark, values_f, values_g, sample="s", start=0):
    return [(start + i, sample, float(i), 0.0, a, b) for i, (a, b) in enumerate(zip(values_f, values_g, strict=True))]


@pytest.fixture(scope="module")
def square(spark):
    """A 4 x 4 grid of single points; f is positive in the left half, g in the top row; two points lack f."""
    rows = [(4 * y + x, "s", float(x), float(y), [1.0, 0.0][x > 1], [0.0, 1.0][y == 3]) for y in range(4) for x in range(4)]
    rows[0] = (*rows[0][:4], None, 0.0)
    rows[1] = (*rows[1][:4], NAN, 0.0)
    return cells(spark, rows)


def test_points_validation(spark):
    schema = "obs_idx long, sample_name string, x_centroid double, y_centroid double, f double"
    with pytest.raises(ValueError, match="finite"):
        PointSet.of(spark.createDataFrame([(1, "s", NAN, 0.0, 1.0), (2, "s", 1.0, 0.0, 1.0)], schema))
    with pytest.raises(ValueError, match="sample"):
        PointSet.of(spark.createDataFrame([(1, None, 1.0, 0.0, 1.0)], schema))
    with pytest.raises(KeyError):
        PointSet.of(spark.createDataFrame([(1, "s")], "obs_idx long, sample_name string"))
    spatial = PointSet.of(spark.createDataFrame([(1, "s", [3.0, 4.0, 9.0])], "obs_idx long, sample_name string, spatial array<double>"))
    assert spatial.cells.select("x", "y").first() == (3.0, 4.0)
    typed = PointSet.of(spark.createDataFrame([(1, "s", 0.0, 0.0, True, "a")], "obs_idx long, sample_name string, x_centroid double, y_centroid double, flag boolean, name string"))
    assert typed.values("flag").first().value == 1.0
    with pytest.raises(TypeError):
        typed.values("name")
    with pytest.raises(KeyError):
        typed.values("nothing")
    with pytest.raises(ValueError):
        typed.where("other")


def test_genes_are_sparse_and_cells_win(spark):
    base = spark.createDataFrame([(1, "s", 0.0, 0.0, 7.0), (2, "s", 1.0, 0.0, 8.0)], "obs_idx long, sample_name string, x_centroid double, y_centroid double, f double")
    expr = spark.createDataFrame([(1, "A", "X", 5.0), (1, "f", "X", 99.0), (2, "B", "X", NAN), (2, "A", "other", 3.0)], "obs_idx long, gene string, layer string, value double")
    genes = spark.createDataFrame([("A", 0), ("B", 1), ("f", 2)], "gene string, var_idx int")
    rows = {r.obs_idx: r for r in PointSet.of(base, expr, genes).wide(["A", "B", "f"]).collect()}
    assert (rows[1].A, rows[1].B, rows[1].f) == (5.0, 0.0, 7.0)
    assert (rows[2].A, rows[2].B, rows[2].f) == (0.0, None, 8.0)
    assert {r.obs_idx: r.A for r in PointSet.of(base, expr, genes, layer="other").wide(["A"]).collect()} == {1: 0.0, 2: 3.0}
    with pytest.raises(KeyError):
        PointSet.of(base, expr, genes, layer="none")


def test_exact_rounding(spark):
    pairs = [(i, u) for u in range(0, 400, 7) for i in range(0, u + 1, 3)] + [(1, 32), (3, 32), (5, 160), (7, 1_600_000)]
    df = spark.createDataFrame(pairs, "i long, u long").select("i", "u", rounded_ratio("i", "u").alias("r"))
    for i, u, r in df.collect():
        assert r == (None if u == 0 else round(i / u, 4)), (i, u)


def test_missing_values_are_negative_but_occupied(square):
    grid = raster.feature_map(square, "f", grid_size=1.0, cutoff=0.5)
    rows = {(r.gx, r.gy): r for r in grid.collect()}
    assert len(rows) == 16 and not rows[0, 0].positive and not rows[1, 0].positive and rows[0, 1].positive
    assert raster.raster(square, "f", 1.0, "sum").where("gx = 0 AND gy = 0").first().f is None
    with pytest.raises(ValueError):
        raster.raster(square, "f", 0)
    with pytest.raises(ValueError):
        raster.raster(square, "f", 1, "median")
    with pytest.raises(ValueError):
        raster.feature_map(square, "f", 1.0, quantile=1.5).count()


def test_cutoff_precedence(square):
    values = raster.grid_values(square, ["f", "g"], 1.0)
    by = lambda **how: {r.feature: r.cutoff for r in raster.local_cutoffs(values, **how).collect()}
    assert by()["g"] == 0.25
    assert by(explicit={"g": 9.0, "f": NAN}) == {"f": by()["f"], "g": 9.0}
    assert by(quantiles=1.0, explicit={"g": 9.0})["g"] == 1.0
    assert by(quantiles={"f": 0.0}, explicit={"g": 9.0, "f": 5.0}) == {"f": 0.0, "g": 9.0}


def brute_shift(t, f, occ, dx, dy):
    n = [0, 0, 0, 0]
    for x, y in occ:
        if (x - dx, y - dy) in occ:
            a, b = (x, y) in t, (x - dx, y - dy) in f
            n = [n[0] + 1, n[1] + a, n[2] + b, n[3] + (a and b)]
    return n


def test_displacement_against_brute_force(spark):
    rng = np.random.default_rng(3)
    spots = sorted({(int(x), int(y)) for x, y in rng.integers(0, 9, (60, 2))} | {(0, 0)})
    rows = [(i, "s", float(x), float(y), float(rng.integers(0, 2)), float(rng.integers(0, 2))) for i, (x, y) in enumerate(spots)]
    points = cells(spark, rows)
    occ, t, f = set(spots), {(int(r[2]), int(r[3])) for r in rows if r[4] > 0.5}, {(int(r[2]), int(r[3])) for r in rows if r[5] > 0.5}
    masks, _ = displace.wide_masks(points, ["f", "g"], 1.0, cutoffs={"f": 0.5, "g": 0.5})
    got = displace.displacement_stats(masks, "f", ["g"], shift_table(spark, shift_rows([1, 3, 20]))).collect()
    assert len(got) == 24
    for r in got:
        n, a, b, i = brute_shift(t, f, occ, int(r.dx), int(r.dy))
        assert (r.cnt_px, r.cnt_p1, r.cnt_p2, r.cnt_p) == (n, a, b, i)
        assert r.pct_p == (round(i / (a + b - i), 4) if a + b - i else None)
        assert r.pct_op == round(len(t & f) / len(t | f), 4)
        assert r.diff_pct == (None if r.pct_p is None else r.pct_p - r.pct_op)


def test_empty_masks_and_scores(spark):
    points = cells(spark, line(spark, [0.0] * 5, [0.0, 1.0, 0.0, 0.0, 0.0]))
    rows = displace.grid_vectors(points, "f", ["g", "unknown"], [1], grid_size=1.0, cutoffs={"f": 0.5, "g": 0.5})
    by = {r.feature: r for r in rows.collect()}
    assert by["g"].n_positive_target == 0 and by["g"].min_djaccard == 0.0
    assert by["unknown"].min_djaccard is None and by["unknown"].n_bins is None
    scores = {r.feature: r.projected_score for r in displace.projected_score(rows).collect()}
    assert scores["unknown"] == 0.0
    assert {r.feature: r.vector_len for r in displace.vector_length(rows).collect()}["unknown"] == 0.0
    masks, _ = displace.wide_masks(points, ["f"], 1.0, cutoffs={"f": 5.0})
    empty = displace.pairwise_scores(masks.withColumn("on:h", F.col("`on:f`")), ["f", "h"], 1)
    assert [r.projected_score for r in empty.collect()] == [None, None]
    with pytest.raises(KeyError):
        displace.grid_vectors(points, "unknown", ["g"], [1])


def test_pairwise_matches_vectors(square):
    masks, _ = displace.wide_masks(square, ["f", "g"], 1.0)
    pairs = {(r.target, r.feature): r.projected_score for r in displace.pairwise_scores(masks, ["f", "g"], 2).collect()}
    for t, f in (("f", "g"), ("g", "f")):
        v = displace.grid_vectors(square, t, [f], [2], grid_size=1.0).first()
        want = None if v.min_djaccard is None else (v.min_djaccard + v.max_djaccard) / 2
        assert pairs[t, f] == want
    matrix = displace.pairwise_matrix(displace.pairwise_scores(masks, ["f", "g"], 2), ["f", "g"]).collect()
    assert [r.target for r in matrix] == ["f", "g"] and matrix[0].f is None and matrix[1].g is None


def test_components_numpy_and_distributed(spark):
    rng = np.random.default_rng(5)
    spots = sorted({(int(x), int(y)) for x, y in rng.integers(0, 14, (90, 2))})
    active = spark.createDataFrame([(s, "f", x, y) for s in ("a", "b") for x, y in spots], "sample string, feature string, gx long, gy long")
    for connectivity in (4, 8):
        near = niches.neighbour_offsets(connectivity)
        root = {}
        for start in sorted(spots, key=lambda p: (p[1], p[0])):
            if start in root:
                continue
            stack = [start]
            while stack:
                p = stack.pop()
                if p in root:
                    continue
                root[p] = start
                stack += [q for dx, dy in near if (q := (p[0] + dx, p[1] + dy)) in set(spots) and q not in root]
        for distributed in (False, True):
            got = niches.components(active, connectivity, distributed).collect()
            assert len(got) == 2 * len(spots)
            assert all(root[r.gx, r.gy] == (r.root_gx, r.root_gy) for r in got)
    with pytest.raises(ValueError):
        niches.neighbour_offsets(6)


def test_connected_components_generic(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (3, 2), (20, 1), (30, 31), (31, 32), (32, 33), (33, 34), (34, 10), (None, 4)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 20: 1, 10: 10, 11: 10, 30: 10, 31: 10, 32: 10, 33: 10, 34: 10}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_niches(spark):
    grid = ["11000", "11011", "00001", "10000"]
    rows = [(5 * y + x, "s", float(x), float(y), float(c), 0.0) for y, row in enumerate(grid) for x, c in enumerate(row)]
    points = cells(spark, rows)
    found = niches.find_niches(points, "f", 0.5, grid_size=1.0, min_grids=3, connectivity=4)
    assert sorted(r.n_grids for r in found.components.collect()) == [1, 3, 4]
    ids = {(r.gx, r.gy): r.niche_id for r in found.grids.where("niche").collect()}
    assert ids == {(0, 0): 1, (1, 0): 1, (0, 1): 1, (1, 1): 1, (3, 1): 2, (4, 1): 2, (4, 2): 2}
    s = found.summary.first()
    assert (s.n_positive_grids, s.n_niche_grids, s.n_niches, s.n_positive_components, s.largest_niche_grids, s.niche_area) == (8, 7, 2, 3, 4, 7.0)
    assert found.cells.where("in_niche").count() == 7
    one = niches.find_niches(points, "f", 0.5, grid_size=1.0, min_grids=1)
    assert one.grids.where("niche <> positive").count() == 0
    annotated = niches.annotate(points, found)
    assert annotated.where("f_niche").count() == 7 and annotated.where("f_niche_id = 2").count() == 3
    v = displace.grid_vectors(points, "f", ["g"], [1], grid_size=1.0, niches=found).first()
    assert v.n_binary_target == 7 and v.binary_source_target == "niche" and v.cutoff_target is None
    with pytest.raises(ValueError, match="grid size"):
        displace.grid_vectors(points, "f", ["g"], [1], grid_size=2.0, niches=found)
    with pytest.raises(ValueError, match="another grid"):
        displace.grid_vectors(cells(spark, rows[1:]), "f", ["g"], [1], grid_size=1.0, niches=found)
    with pytest.raises(ValueError):
        displace.grid_vectors(points, "g", ["g"], [1], grid_size=1.0, niches=found)
    with pytest.raises(ValueError):
        niches.find_niches(points, ["f", "g"], 0.5)
    with pytest.raises(ValueError):
        niches.find_niches(points, "f", INF)
    with pytest.raises(ValueError):
        niches.find_niches(points, "f", None, method=None)
    with pytest.raises(TypeError):
        displace.niche_map({"f": 3})
    r = radius.radius_vectors(points, "f", ["g"], [1], 1.5, niches=found).first()
    assert r.n_positive_target == 7 and r.binary_source_target == "niche"


def test_draws_and_methods(spark):
    assert (draw_size(12_345), draw_size(999), draw_size(50, 20), draw_size(50, exact=7)) == (12_000, 999, 40, 7)
    with pytest.raises(ValueError):
        draw_size(5, exact=6)
    assert cutoff_level("Grid-level") == "grid" and cutoff_level("cells") == "cell" and cutoff_method("Balanced-Global-mean") == "balanced_global_mean"
    for wrong in (lambda: cutoff_level("pixel"), lambda: cutoff_method("mode")):
        with pytest.raises(ValueError):
            wrong()
    rows = line(spark, [float(i) for i in range(30)], [1.0] * 30, "a") + line(spark, [float(i) for i in range(10)], [2.0] * 10, "b", 30)
    points = cells(spark, rows)
    got = cohort_cutoffs(points, ["f", "g"], level="cell", n_repeats=7)
    reps = got.replicates.collect()
    assert len(reps) == 14 and {r.n_per_sample for r in reps} == {10} and {r.cutoff for r in reps if r.feature == "g"} == {1.5}
    whole = cohort_cutoffs(points, "f", samples=["b"], level="cell", n_repeats=3)
    assert {r.cutoff for r in whole.replicates.collect()} == {4.5}
    assert {r.feature: r.cutoff for r in cohort_cutoffs(points, ["f"], level="cell", method="mean_of_sample_means").cutoffs.collect()} == {"f": (14.5 + 4.5) / 2}
    holes = cells(spark, line(spark, [None, NAN], [1.0, 1.0], "a") + line(spark, [1.0], [1.0], "b", 5))
    with pytest.raises(ValueError, match="without units"):
        cohort_cutoffs(holes, ["f"], level="cell")
    props = {(r["sample"], r.feature): r.positive_fraction for r in api.positive_proportions(points, {"f": 4.0}, level="cell").collect()}
    assert props == {("a", "f"): 25 / 30, ("b", "f"): 0.5}
    empty = {r["sample"]: (r.n_units, r.positive_fraction) for r in api.positive_proportions(holes, {"f": 0.5}).collect()}
    assert empty == {"a": (0, None), "b": (1, 1.0)}
    with pytest.raises(KeyError):
        api.positive_proportions(points, {"f": 4.0}, ["f", "g"])


def test_steps():
    assert grid_steps([4, -1, 2, 2.0]) == [2.0, 4.0] and radius_steps([2.5, 0]) == [2.5]
    for wrong in ([0], [1.5]):
        with pytest.raises(ValueError):
            grid_steps(wrong)
    diagonal = [r for r in shift_rows([2], euclidean=True) if r[1] == "add_X_add_Y"][0]
    assert math.isclose(math.hypot(*diagonal[2:]), 2.0)
    assert sanitized("a b-c!") == "a_b_c" and sanitized("!!") == "feature"


def test_transforms():
    assert transform_matrix(90) == [[0.0, 1.0], [-1.0, 0.0]] and transform_matrix(0, "X") == [[-1.0, 0.0], [0.0, 1.0]]
    assert transform_matrix(operator=[[1, 2], [3, 4]]) == [[1.0, 2.0], [3.0, 4.0]]
    for wrong in ({"rotate": 45}, {"mirror": "Z"}, {"operator": [[1]]}):
        with pytest.raises(ValueError):
            transform_matrix(**wrong)


def test_mirroring_keeps_extremes_on_aligned_data(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "s", float(i % 8), float(i // 8), float(rng.random()), float(rng.random())) for i in range(64)]
    flipped = [(i, s, 7.0 - x, y, f, g) for i, s, x, y, f, g in rows]
    ends = [displace.grid_vectors(cells(spark, r), "f", ["g"], [1, 2], grid_size=1.0).orderBy("step").select("min_djaccard", "max_djaccard").collect() for r in (rows, flipped)]
    assert ends[0] == ends[1]


def test_bins(spark):
    rows = [(i, "s", float(i % 4), float(i // 4), float(i), 0.0) for i in range(16)]
    adjusted = api.spatial_adjust(cells(spark, rows), "f")
    table = {(r.row, r.col): r for r in bin_statistics(adjusted, (2, 2), 7.0, min_count=3, pct_cutoff=0.5).collect()}
    assert {k: r.n for k, r in table.items()} == {(0, 0): 4, (0, 1): 4, (1, 0): 4, (1, 1): 4}
    assert table[0, 0].pct == 1.0 and table[1, 1].pct == 0.0 and table[0, 0].mask == 1
    flat = api.spatial_adjust(cells(spark, [(1, "s", 5.0, 5.0, 1.0, 0.0)]), "f")
    one = [r for r in bin_statistics(flat, (2, 3), None, min_count=0).collect() if r.n]
    assert len(one) == 1 and (one[0].row, one[0].col, one[0].pct) == (0, 2, 0.0)
    with pytest.raises(ValueError):
        bin_statistics(adjusted, (0, 1))
    with pytest.raises(KeyError):
        api.spatial_binstat(adjusted, min_cutoff={"other": 1.0}, feature="f")


def test_radius_against_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "s", float(x) / 4, float(y) / 4, float(rng.random()), float(rng.random())) for i, (x, y) in enumerate(rng.integers(0, 200, (150, 2)))]
    points, r2 = cells(spark, rows), 5.1**2
    got = radius.radius_vectors(points, "f", ["g"], [4.0], 5.1, cutoffs={"f": 0.6, "g": 0.7}).first()
    near = lambda p, q, d=(0, 0): (p[2] - q[2] - d[0]) ** 2 + (p[3] - q[3] - d[1]) ** 2 < r2
    ft, gt = [p for p in rows if p[4] > 0.6], [p for p in rows if p[5] > 0.7]
    dom = lambda act, d=(0, 0): {p[0] for p in rows if any(near(p, q, d) for q in act)}
    t, base = dom(ft), dom(gt)
    jac = lambda a, b: round(len(a & b) / len(a | b), 4)
    diffs, cover = [], []
    for _, _, dx, dy in shift_rows([4.0]):
        diffs.append(jac(t, dom(gt, (dx, dy))) - jac(t, base))
        cover.append(sum(any(near(p, q, (dx, dy)) for p in rows) for q in gt) / len(gt))
    assert (got.min_djaccard, got.max_djaccard) == (min(diffs), max(diffs))
    assert got.min_direction_coverage == min(cover) and math.isclose(got.mean_direction_coverage, sum(cover) / 8)
    pair = radius.pairwise_radius_scores(points, ["f", "g"], 4.0, 5.1, cutoffs={"f": 0.6, "g": 0.7}).where("target = 'f'").first()
    assert pair.projected_score == (min(diffs) + max(diffs)) / 2
    for wrong in ({"radius": 0}, {"min_coverage": 2}, {"direction_mode": "x"}):
        with pytest.raises(ValueError):
            radius.radius_vectors(points, "f", ["g"], [4.0], **wrong)
    none = radius.radius_vectors(points, "f", ["g", "what"], [4.0], 5.1, cutoffs={"f": 9.0, "g": 9.0})
    assert {r.feature: r.min_djaccard for r in none.collect()} == {"g": None, "what": None}


def test_statistics(spark):
    assert math.isclose(proportion_test(12, 44, 0.5, "less")["pvalue"], 0.0020892788, rel_tol=1e-6)
    assert math.isnan(proportion_test(1, 0)["pvalue"])
    assert math.isclose(exact_mann_whitney(0, 3, 3), 2 / math.comb(6, 3))
    rows = spark.createDataFrame([("k", float(v), g) for g, vs in ((1, [1, 2, 3]), (0, [4, 5, 6, 7])) for v in vs], "s string, value double, grp int")
    r = mann_whitney(rows, "s").first()
    assert r.statistic == 0 and math.isclose(r.pvalue, 2 / math.comb(7, 3))
    pairs = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", 3.0, 6.0), ("k", None, 1.0)], "s string, a double, b double")
    w = wilcoxon(pairs, "s").first()
    assert w.n_pairs == 3 and w.statistic == 0 and math.isclose(w.pvalue, 2 / 8)
    curve = density(spark.createDataFrame([(0.0,), (1.0,), (None,)], "v double"), "v", 50).collect()
    assert len(curve) == 50 and density(spark.createDataFrame([(1.0,)], "v double"), "v").count() == 0


def test_plot_tables(spark, square):
    counts = plotdata.overlay_counts(plotdata.overlay(square, "f", "g", "grid", cutoffs={"f": 0.5, "g": 0.5}, grid_size=1.0)).first()
    assert (counts.n_units, counts.n_a, counts.n_b, counts.n_overlap) == (16, 6, 4, 2)
    for rule in ("mean", "median", "zero", 0.5, ("quantile", 0.5), None):
        assert plotdata.overlay(square, "f", "g", "cell", rule).count() == 16
    with pytest.raises(ValueError):
        plotdata.overlay(square, "f", "g", rule="mode")
    mask = spark.createDataFrame([("s", 0, 0), ("s", 1, 0)], "sample string, gx long, gy long")
    assert plotdata.boundary_segments(mask).count() == 6
    found = niches.find_niches(square, ["f", "g"], {"f": 0.5, "g": 0.5}, grid_size=1.0, min_grids=3)
    over = {r.category: r.n for r in plotdata.category_counts(plotdata.niche_overlay(found, found, "f", "g")).collect()}
    assert over == {"niche1": 4, "niche2": 2, "overlap": 2, "other": 8}
    assert plotdata.one_sample(found, None) == "s"
    with pytest.raises(KeyError):
        plotdata.one_sample(found, "x")
    scores = spark.createDataFrame([("s1", "a", "b", 0.5), ("s2", "a", "b", -0.5), ("s1", "b", "a", None)], "sample string, target string, feature string, projected_score double")
    heat = plotdata.heatmap_cells(scores, ["b", "a"]).collect()
    assert [(r.target, r.feature, r.score) for r in heat] == [("a", "b", 0.0)]
    assert plotdata.colocalization_summary(scores)["n_below"] == 1
    assert plotdata.domain_categories(square, "f", "g", radius=0.5, cutoffs={"f": 0.5, "g": 0.5}).groupBy("category").count().count() == 4
    assert plotdata.vector_path(displace.grid_vectors(square, "f", ["g"], [1, 2], grid_size=1.0)).where("is_final").count() == 1


def test_api(square):
    v = api.spatial_vector(square, "f", ["g", "nope"], steps=[1], grid_size=1.0)
    assert {r.feature for r in v.projected_score.collect()} == {"g", "nope"} and v.vectors.first()["sample"] == "obj"
    with pytest.warns(UserWarning):
        x = api.spatial_vector_x(square, "f", ["g"], samples=["s", "gone"], steps=[1], grid_size=1.0, cutoff_method="mean_of_sample_means")
    assert x.pool_raw.count() == 1 and x.sample_vector_len.count() == 1
    with pytest.raises(ValueError):
        api.spatial_vector_x(square, "f", ["g"], cutoff_method="balanced_global_mean", quantile_cutoffs=0.5)
    with pytest.raises(KeyError):
        api.spatial_vector_x(square, "f", ["nope"], steps=[1], cutoff_method="mean_of_sample_means")
    with pytest.raises(KeyError):
        api.pairwise_projected_scores(square, ["f", "nope"])
    p = api.pairwise_projected_scores(square, ["f", "g"], final_step=1, grid_size=1.0)
    assert p.matrix.count() == 2 and p.sample_scores.count() == 2
    k = api.spatial_vector_kdtree(square, "f", ["g"], steps=[1], radius=1.2)
    assert k.vectors.first().backend == "kdtree"
    with pytest.raises(ValueError):
        api.define_niches(square, ["f"], 0.5)
    found, annotated = api.define_niche(square, "f", 0.5, annotate_obs=True, grid_size=1.0, min_grids=1)
    assert "f_niche_id" in annotated.cells.columns and found.summary.count() == 1
    table = api.spatial_cordstat(square, "f", "g", operator_steps=(1, 1, 1, 1), grid_size=1.0)
    assert table.mov_stat.count() == 8 and table.mov_summary.count() == 1
    assert api.grid_feature_map(square, "f", grid_size=1.0, cutoff_method="mean_of_sample_means").grid.count() == 16
    b = api.spatial_binstat(api.spatial_adjust(square, "f"), (2, 2), min_count=0)
    assert b.bins.count() == 4 and b.edges.count() == 1
    assert api.kdtree_domain_map(square, "f", "g", radius=1.1, cutoff_method="mean_of_sample_means").count() == 16


def test_module_scores(spark):
    base = spark.createDataFrame([(i, "s", float(i), 0.0) for i in range(3)], "obs_idx long, sample_name string, x_centroid double, y_centroid double")
    expr = spark.createDataFrame([(0, "A", "X", 6.0), (1, "B", "X", 3.0), (2, "C", "X", 3.0)], "obs_idx long, gene string, layer string, value double")
    genes = spark.createDataFrame([(g, i) for i, g in enumerate("ABCD")], "gene string, var_idx int")
    got = api.add_module_scores(PointSet.of(base, expr, genes), {"m": ["A", "A", "B"], "none": ["Z"]}, nbin=1, ctrl=9)
    rows = {r.obs_idx: (r.m, r.none) for r in got.collect()}
    assert rows == {0: (4.0, None), 1: (1.0, None), 2: (-1.5, None)}


def test_stream_raster(spark, tmp_path):
    schema = "sample string, x double, y double, f double"
    spark.createDataFrame([("s", 1.0, 1.0, 2.0), ("s", 2.0, 1.0, NAN), ("s", 25.0, 1.0, 4.0)], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = stream_raster(stream, "f").writeStream.outputMode("complete").format("memory").queryName("raster_out").start()
    query.processAllAvailable()
    query.stop()
    assert {(r.gx, r.n_cells, r.value) for r in spark.sql("SELECT * FROM raster_out").collect()} == {(0, 2, 2.0), (1, 1, 4.0)}
