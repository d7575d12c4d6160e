"""Joins by counted size, quantiles and draws of hot groups, labels either way, plans without shuffles of points, and misuse that raises."""

import contextlib
import io
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spatiarc import api
from spatiarc.functions.quantiles import group_quantiles
from spatiarc.operators import displace, niches, plotdata, raster
from spatiarc.operators.adjust import adjust, bin_statistics
from spatiarc.operators.cutoffs import balanced_draws, balanced_means, cohort_cutoffs, cutoff_method
from spatiarc.plans.lookup import Lookup
from spatiarc.plans.queries import QUERIES
from spatiarc.sources.points import PointSet

SF = "/root/testdata/sf0.001"
SCHEMA = "obs_idx long, sample_name string, x_centroid double, y_centroid double, f double, g double"


def blob(spark, samples=("s",), dx=0.0, n=8):
    rows = [(1000 * k + n * y + x, s, x + dx, float(y), float(x < 4), float(y < 3)) for k, s in enumerate(samples) for y in range(n) for x in range(n)]
    return PointSet.of(spark.createDataFrame(rows, SCHEMA))


def plan(df):
    with contextlib.redirect_stdout(out := io.StringIO()):
        df.explain("formatted")
    return out.getvalue()


def test_lookup_broadcasts_or_salts(spark):
    table = spark.createDataFrame([(k, -k) for k in range(10)], "k long, v long")
    rows = spark.range(500).select(F.when(F.col("id") < 400, 3).otherwise(F.col("id") % 12).alias("k"), "id")
    want = sorted((r.id, -r.k if r.k < 10 else None) for r in rows.collect())
    small, large = Lookup(table, ["k"]), Lookup(table, ["k"], limit=5, salts=4)
    assert small.small is not None and large.small is None
    for way in (small, large):
        assert sorted((r.id, r.v) for r in way.join(rows, "left").collect()) == want
        assert way.join(rows).count() == sum(v is not None for _, v in want)
    assert "__salt" in plan(large.join(rows)) and "Broadcast" in plan(small.join(rows))


@pytest.mark.parametrize("q", [0.0, 0.01, 0.25, 0.5, 0.9, 1.0])
def test_group_quantiles(spark, q):
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=30_000), "b": rng.integers(0, 3, 25_000).astype(float), "c": rng.normal(size=7), "d": np.array([2.5]), "e": np.repeat([1.0, 5.0], 12_000)}
    rows = spark.createDataFrame([(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("z", None)], "k string, value double").repartition(5)
    got = {r.k: r.q for r in group_quantiles(rows, ["k"], q, "q").collect()}
    assert got.keys() == data.keys()
    for k, vs in data.items():
        assert math.isclose(got[k], np.quantile(vs, q), abs_tol=1e-9), k


def test_balanced_draws_are_the_least_hashes(spark):
    """Every draw holds just the units that come first by hash, none twice, whatever the bucket in which it ends."""
    sizes = {("f", "s"): (700, 500), ("f", "t"): (40, 40), ("g", "s"): (9, 1)}
    units = [(f, s, str(i), float(i)) for (f, s), (n, _) in sizes.items() for i in range(n)]
    rows = spark.createDataFrame(units, "feature string, sample string, key string, value double").repartition(4)
    counted = spark.createDataFrame([(f, s, n, d) for (f, s), (n, d) in sizes.items()], "feature string, sample string, n_units long, n_draw long")
    whole, cut = balanced_draws(rows, counted, 6, 11)
    got = {}
    for r in whole.unionByName(cut).collect():
        got.setdefault((r.feature, r["repeat"]), []).append(r.value)
    import hashlib

    for repeat in range(1, 7):
        for f in ("f", "g"):
            want = []
            for (g, s), (n, d) in sizes.items():
                if g == f:
                    def h(i, g=g, s=s):
                        name = hashlib.md5(f"11|{g}|{s}|{i}".encode()).hexdigest()
                        a, b = int(name[:8], 16) % 2147483647, int(name[8:16], 16) % 2147483647
                        return (a * repeat * 48271 % 2147483647 + b) % 2147483647, str(i)

                    want += [float(i) for i in sorted(range(n), key=h)[:d]]
            assert sorted(got[f, repeat]) == sorted(want)


def test_points_are_not_shuffled_by_sample(spark):
    """With no automatic broadcasts, as if every table were large: no join sorts points by their sample."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("grid_mean", "grid_occupancy", "binstat", "overlay_counts_cell", "positive_proportions_cell", "niche_cells", "radius_domain", "grid_feature_map_quantile", "cutoff_mean_of_means_grid"):
            text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
            assert not re.search(r"SortMergeJoin(\(.*?\))? \[sample#\d+\],", text), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_niches_of_another_feature(spark):
    points = blob(spark)
    found = niches.find_niches(points, ["g"], {"g": 0.5}, grid_size=1.0)
    with pytest.warns(UserWarning, match="stand for"):
        rows = displace.grid_vectors(points, "f", ["g"], [1], grid_size=1.0, cutoffs={"g": 0.5}, niches={"f": found}).collect()
    assert rows[0].n_positive_target == 24 and rows[0].min_djaccard is not None
    both = niches.find_niches(points, ["f", "g"], {"f": 0.5, "g": 0.5}, grid_size=1.0)
    with pytest.raises(ValueError, match="none of them"):
        displace.niche_feature("h", both)


def test_niches_fit_their_own_points_only(spark):
    found = niches.find_niches(blob(spark), ["g"], {"g": 0.5}, grid_size=1.0)
    for other, how in ((blob(spark, dx=1000.0), {}), (blob(spark), {"min_cells": 2}), (blob(spark), {"grid_size": 2.0}), (blob(spark, n=9), {})):
        with pytest.raises(ValueError, match="niches"):
            displace.grid_vectors(other, "f", ["g"], [1], **({"grid_size": 1.0} | how), niches={"g": found})


def test_unknown_samples_raise(spark):
    points = blob(spark, ("s", "t"))
    with pytest.raises(ValueError, match="gone"):
        cohort_cutoffs(points, "f", samples=["s", "gone"], grid_size=1.0, method="mean_of_sample_means")
    assert points.where(["t"]).cells.count() == 64


def test_features_of_any_name(spark):
    base = blob(spark).cells
    names = ["x", "y", "sample", "gx", "n_cells", "v1", "g0", "dotted.name"]
    cells = base.select("obs_idx", F.col("sample").alias("s"), F.col("x").alias("x_centroid"), F.col("y").alias("y_centroid"), *[(F.col("f") * (i + 1)).alias(n) for i, n in enumerate(names)])
    points = PointSet.of(cells, sample_col="s")
    got = {(r.feature, r.value) for r in raster.grid_values(points, names, 1.0).where("gx = 0 AND gy = 0").collect()}
    assert got == {(n, i + 1.0) for i, n in enumerate(names)}
    assert raster.raster(points, names, 1.0).columns == ["sample", "gx", "gy", "n_cells", "x", "y", "feature:sample", "feature:gx", "feature:n_cells", "v1", "g0", "dotted.name"]
    rows = displace.grid_vectors(points, "gx", ["n_cells", "sample"], [1], grid_size=1.0).collect()
    assert {r.feature for r in rows} == {"n_cells", "sample"} and all(r.n_positive_target == 32 for r in rows)


def test_labels_either_way(spark):
    rng = random.Random(5)
    odd = "a\u0001b\u0001c"
    active = [(s, "f", rng.randrange(-20, 20), rng.randrange(-20, 20)) for s in (odd, "a", "") for _ in range(300)]
    df = spark.createDataFrame(sorted(set(active)), "sample string, feature string, gx long, gy long")
    one, two, chosen = ({tuple(r) for r in niches.components(df, 8, d).collect()} for d in (False, True, None))
    assert one == two == chosen and len(one) == len(set(active))
    niches.TASK_CELLS, before = 10, niches.TASK_CELLS
    try:
        assert {tuple(r) for r in niches.components(df).collect()} == one
    finally:
        niches.TASK_CELLS = before


def test_mask_of_bins_must_be_whole(spark):
    adjusted = adjust(blob(spark), "f")
    cells = lambda *rows: spark.createDataFrame(rows, "row int, col int, mask int")
    good = [(r, c, int(r == c)) for r in range(2) for c in range(2)]
    assert {r["mask"] for r in bin_statistics(adjusted, (2, 2), 0.5, 1, mask=cells(*good)).collect()} == {0, 1}
    for bad in (good[:3], [*good, (0, 0, 1)], [*good[:3], (2, 0, 1)], [*good[:3], (1, 1, None)]):
        with pytest.raises(ValueError, match="mask"):
            bin_statistics(adjusted, (2, 2), 0.5, 1, mask=cells(*bad))


def test_bins_by_quotient_are_bins_by_edges(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.uniform(-3, 7, 500), np.linspace(-3, 7, 8), [-3.0, 7.0]])
    rows = spark.createDataFrame([(i, "s", float(v), 1.0, 1.0) for i, v in enumerate(x)], "obs_idx long, sample string, x double, y double, value double")
    got = {r.col: r.n for r in bin_statistics(rows, (3, 7), 0.0, 0).where("row = 0").collect()}
    low, step = x.min(), (x.max() - x.min()) / 7
    want = np.bincount(sum((x >= low + i * step).astype(int) for i in range(1, 7)), minlength=7)
    assert [got[c] for c in range(7)] == want.tolist()


def test_method_names():
    for name in ("median_of_sample_level_median_scores", "median_of_sample_level_medians", "median_of_sample_median"):
        assert cutoff_method(name) == "median_of_sample_medians"
    for name in ("mean_of_sample_level_mean_scores", "Mean-of-sample-level-means", "mean_of_sample_mean"):
        assert cutoff_method(name) == "mean_of_sample_means"
    with pytest.raises(ValueError):
        cutoff_method("balanced_mean")


def test_displacement_of_adjusted_points(spark):
    points = blob(spark, ("s", "t"))
    plain = api.spatial_cordstat(points, "f", "g", operator_steps=(1, 1, 1, 1)).mov_stat
    a, b = (api.spatial_adjust(points, n) for n in ("f", "g"))
    assert sorted(map(repr, plain.collect())) == sorted(map(repr, api.spatial_cordstat(a, b, operator_steps=(1, 1, 1, 1)).mov_stat.collect()))
    for wrong in (api.spatial_adjust(points, "g", rotate=90), api.spatial_adjust(points, "g", sample="s")):
        with pytest.raises(ValueError, match="same points"):
            api.spatial_cordstat(a, wrong)
    with pytest.raises(ValueError, match="values"):
        api.spatial_cordstat(a, api.spatial_adjust(points))


def test_figure_data_names(spark):
    assert plotdata.spatial_vecPlot is plotdata.vector_path and api.one_sided_proportion_test(1, 4)["proportion"] == 0.25
    points = blob(spark)
    units = plotdata.overlay(points, "f", "g", "grid", cutoffs={"f": 0.5}, grid_size=1.0, method="mean_of_sample_means").collect()
    assert sum(r.a for r in units) == 32 and sum(r.b for r in units) == 24
    found = niches.find_niches(points, ["f"], {"f": 0.5}, grid_size=1.0)
    rows = plotdata.niche_feature_values(found, "f", points, "g", "cell", quantiles=None).collect()
    assert len(rows) == 64 and {(r.vmin, r.vmax) for r in rows} == {(0.0, 1.0)} and sum(r.niche for r in rows) == 32
    assert {(r.vmin, r.vmax) for r in plotdata.niche_feature_values(found, "f", points, "g", vmin=-1.0, vmax=9.0).collect()} == {(-1.0, 9.0)}


def test_squares_decide_as_the_exact_test_does(spark):
    """Sites and probes about the rim, at offsets of just the radius too, against all pairs."""
    from spatiarc.operators.radius import Sites, near, within

    rng = random.Random(4)
    sites = [("s", rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(25)] + [("t", 0.0, 0.0)]
    probes = [(rng.choice("st"), rng.uniform(-20, 60), rng.uniform(-20, 60), rng.choice([0.0, 5.0, -7.5]), rng.choice([0.0, 3.0])) for _ in range(1500)]
    probes += [("t", 3.0, 4.0, 0.0, 0.0), ("t", 5.0, 0.0, 0.0, 0.0), ("t", 4.999999, 0.0, 0.0, 0.0), ("t", -3.5, -3.5, 0.0, 0.0)]
    left = spark.createDataFrame(probes, "sample string, x double, y double, dx double, dy double")
    right = spark.createDataFrame(sites, "sample string, x double, y double")
    for moves, sign in ((True, 1), (False, -1)):
        want = sorted(p for p in probes if any(s == p[0] and (x - p[1] - sign * p[3]) ** 2 + (y - p[2] - sign * p[4]) ** 2 < 25 for s, x, y in sites))
        assert sorted(map(tuple, near(left, Sites(right, 5.0, ["sample"]), moves).collect())) == want
        assert sorted(map(tuple, within(left, right, 5.0, ["sample"], moves).collect())) == want


def radius_joins(spark, name):
    """The operators of the semi-joins of a query's plan, where every table counts as small enough to broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        text = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    return re.findall(r"(\w+Join) [^\n]*LeftSemi", text)


@pytest.mark.parametrize("name", ["vectors_radius_sphere", "vectors_radius_niche_target", "radius_coverage", "radius_domain"])
def test_radius_joins_are_not_broadcast(spark, name):
    """The sites of the exact test never go to the driver, however small their files are."""
    joins = radius_joins(spark, name)
    assert joins and set(joins) == {"SortMergeJoin"}


def test_exact_test_sees_rims_only(spark):
    """The squares decide before the exact test: its semi-join isn't run below the join with them, on every displaced row."""
    text = QUERIES["vectors_radius_niche_target"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = lambda line: len(re.match(r"[\s:+|-]*", line)[0])
    found = [i for i, line in enumerate(text) if "Join LeftSemi" in line]
    assert found
    for i in found:
        below = [line for line in text[i + 1 : next((j for j in range(i + 1, len(text)) if depth(text[j]) <= depth(text[i])), len(text))]]
        right = max(j for j, line in enumerate(below) if depth(line) == depth(below[0]))
        assert any("Join Inner" in line and "held_mx" in line for line in below[:right])


def test_frontier_of_sites_answers_as_all_do(spark):
    """However near to a square, or in it, sites are nearest or not at all; a dense block leaves its rim, in batches of any size."""
    from spatiarc.operators.radius import frontier, unbeaten

    draw = np.random.default_rng(5)
    asked = draw.uniform(0, 1, (400, 2))
    for shape in ((1.5, 0.0), (-0.5, -0.5), (-1.5, 1.2), (0.0, -2.0)):
        at = draw.uniform(0, 1, (3000, 2)) * draw.choice([0.1, 1.0, 2.0]) + shape
        at = np.concatenate([at, at[:50]])
        kept = at[unbeaten(at[:, 0], at[:, 1], 1e-6)]
        nearest = lambda sites: ((asked[:, None] - sites) ** 2).sum(axis=2).min(axis=1)
        assert np.array_equal(nearest(kept), nearest(at))
    block = [("s", 2.0 + i / 100, j / 100, m, 0) for i in range(200) for j in range(100) for m in (0, -1)]
    sites = spark.createDataFrame(block, "s_sample string, sx double, sy double, smx long, smy long").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        sizes = set()
        for batch in (7000, 50000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
            rows = frontier(sites, 1.0, ["s_sample"]).toPandas()
            assert set(rows.columns) == set(sites.columns) and {0, -1} == set(rows.smx) and len(rows) < 1500
            for m in (0, -1):
                some = rows[rows.smx == m][["sx", "sy"]].to_numpy()
                every = np.array([(x, y) for _, x, y, sq, _ in block if sq == m])
                points = asked[:100] + (m, 0)
                gap = lambda sites: ((points[:, None] - sites) ** 2).sum(axis=2).min(axis=1)  # noqa: E731, B023
                assert np.array_equal(gap(some), gap(every))
            sizes.add(len(rows))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_squares_counted_as_one_count_the_same(spark, monkeypatch):
    """Displacements by nothing, along an axis, by whole squares and by any length; few rows of a dense area are asked one by one."""
    from spatiarc.functions.expressions import shift_table
    from spatiarc.operators import radius

    rng = random.Random(6)
    width = radius.Sites(spark.range(0).selectExpr("'s' AS sample", "0.0D AS x", "0.0D AS y"), 5.0, ["sample"]).width
    sites = [("s", float(x), float(y)) for x in range(60) for y in range(60)] + [("t", rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(30)]
    rows = [(rng.choice("st"), rng.choice("ab"), rng.uniform(-5, 65), rng.uniform(-5, 65), rng.randint(1, 3)) for _ in range(6000)]
    moves = [(0.0, 0.0), (12.0, 0.0), (0.0, -7.25), (width, 2 * width), (-width, 3.0), (9.5, 9.5), (-300.0, 4.0)]
    shifts = shift_table(spark, [(float(i), f"d{i}", dx, dy) for i, (dx, dy) in enumerate(moves)])
    left = spark.createDataFrame(rows, "sample string, feature string, x double, y double, n long")
    right = spark.createDataFrame(sites, "sample string, x double, y double")
    by, asked, near = ["sample", "feature"], [], radius.near
    monkeypatch.setattr(radius, "near", lambda probe, *how: asked.append(probe.count()) or near(probe, *how))
    for probe_moves in (True, False):
        got = {}
        for most in (0, 10**9):
            monkeypatch.setattr(radius, "PROBES", most)
            got[most] = sorted(map(tuple, radius.near_counts(left, radius.Sites(right, 5.0, ["sample"]), by, shifts, probe_moves).collect()))
        assert got[0] == got[10**9] and got[0]
        few, each = asked[-2:]
        assert each == len(rows) * len(moves) and few < each * 0.8


def test_points_of_one_place_count_each(spark):
    """Repeated points weigh as many as they are, whatever else lies there."""
    from spatiarc.operators.radius import radius_vectors

    cells = blob(spark).cells.withColumnsRenamed({"sample": "sample_name", "x": "x_centroid", "y": "y_centroid"})
    weighed = cells.select("*", F.explode(F.sequence(F.lit(1), F.when(F.col("f") > 0, 3).otherwise(1))).alias("k"))
    points = PointSet.of(weighed.withColumn("obs_idx", F.col("obs_idx") * 10 + F.col("k")).drop("k"))
    (row,) = radius_vectors(points, "f", ["g"], [2], 0.5, cutoffs={"f": 0.5, "g": 0.5}).collect()
    assert (row.n_anchors, row.n_positive_target, row.n_positive_feature) == (128, 96, 48)


def test_pairwise_radius_is_not_broadcast(spark):
    """Which domains a place lies in travels with the place, so no domain is joined with another."""
    joins = radius_joins(spark, "pairwise_radius")
    assert set(joins) <= {"SortMergeJoin"}
    text = plan(QUERIES["pairwise_radius"](spark, SF))
    assert "obs_idx" not in text


def test_balanced_means_are_those_of_the_draws(spark, monkeypatch):
    """By arrays, and by rows where there are many draws; no unit becomes a row for each repeat."""
    from spatiarc.operators import cutoffs

    sizes = {("f", "s"): (3000, 2000), ("f", "t"): (2000, 2000), ("g", "s"): (9, 1), ("g", "t"): (1, 1)}
    units = [(f, s, str(i), i + 0.25) for (f, s), (n, _) in sizes.items() for i in range(n)]
    rows = spark.createDataFrame(units, "feature string, sample string, key string, value double").repartition(4)
    counted = spark.createDataFrame([(f, s, n, d) for (f, s), (n, d) in sizes.items()], "feature string, sample string, n_units long, n_draw long")
    whole, cut = balanced_draws(rows, counted, 7, 11)
    want = {(r.feature, r["repeat"]): r.v for r in whole.unionByName(cut).groupBy("feature", "repeat").agg(F.avg("value").alias("v")).collect()}
    means = balanced_means(rows, counted, 7, 11)
    assert "explode" not in plan(means)
    monkeypatch.setattr(cutoffs, "DRAWS", 20)
    for way in (means, balanced_means(rows, counted, 7, 11)):
        got = {(r.feature, r["repeat"]): r.cutoff for r in way.collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], v, abs_tol=1e-9) for k, v in want.items())
