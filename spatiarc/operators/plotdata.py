"""The tables behind the usual figures; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.functions.expressions import names_of
from spatiarc.functions.quantiles import group_quantiles
from spatiarc.functions.statistics import density, proportion_test, wilcoxon
from spatiarc.operators.cutoffs import Cutoffs, merged_cutoffs
from spatiarc.operators.niches import Niches
from spatiarc.operators.radius import domain_map
from spatiarc.operators.raster import explicit_cutoffs, grid_values, local_cutoffs, masks, place
from spatiarc.plans.lookup import Lookup
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet


def vector_path(vectors: DataFrame) -> DataFrame:
    """Segments of each feature's path through its finite vectors in order of step, the last one marked for its label."""
    w = Window.partitionBy("feature").orderBy("step")
    rows = vectors.where("min_djaccard IS NOT NULL AND max_djaccard IS NOT NULL")
    last = F.col("step") == F.max("step").over(Window.partitionBy("feature"))
    before = lambda c: F.lag(c, 1, 0.0).over(w)
    return rows.select("feature", "step", before("min_djaccard").alias("x0"), before("max_djaccard").alias("y0"), F.col("min_djaccard").alias("x1"), F.col("max_djaccard").alias("y1"), last.alias("is_final"))


def magnitude_against_score(lengths: DataFrame, scores: DataFrame) -> DataFrame:
    rows = lengths.join(scores, "feature")
    return rows.where("vector_len IS NOT NULL AND projected_score IS NOT NULL").select("feature", "vector_len", "projected_score")


def heatmap_cells(scores: DataFrame, order: list[str], triangle: str | None = "lower", vmax: float | None = 0.0) -> DataFrame:
    """Mean scores by pair with their places in ``order``; of a triangle, only its cells without the diagonal. ``vmin`` and
    ``vmax`` (None: the greatest score) come along."""
    if triangle not in ("lower", "upper", None, "none"):
        raise ValueError("triangle is lower, upper or None")
    at = F.create_map(*[x for i, n in enumerate(order) for x in (F.lit(n), F.lit(i))])
    rows = scores.groupBy("target", "feature").agg(F.avg("projected_score").alias("score"))
    rows = rows.withColumn("row", F.try_element_at(at, "target")).withColumn("col", F.try_element_at(at, "feature")).where("row IS NOT NULL AND col IS NOT NULL")
    if triangle in ("lower", "upper"):
        rows = rows.where("col < row" if triangle == "lower" else "col > row")
    high = F.max("score") if vmax is None else F.lit(float(vmax))
    return rows.crossJoin(F.broadcast(rows.agg(F.min("score").alias("vmin"), high.alias("vmax"))))


def paired_scores(sample_scores: DataFrame, first: str, second: str) -> DataFrame:
    """Samples with a score of both features: ``sample, a, b``."""
    one = lambda n, c: F.max(F.when(F.col("feature") == n, F.col("projected_score"))).alias(c)
    return sample_scores.groupBy("sample").agg(one(first, "a"), one(second, "b")).where("a IS NOT NULL AND b IS NOT NULL")


def paired_test(sample_scores: DataFrame, first: str, second: str) -> DataFrame:
    return wilcoxon(paired_scores(sample_scores, first, second).select(F.lit(f"{first}:{second}").alias("pair"), "a", "b"), "pair")


def colocalization_counts(scores: DataFrame, threshold: float = 0.0) -> DataFrame:
    """``n, n_below, percent_below`` of finite scores."""
    rows = scores.where("projected_score IS NOT NULL AND NOT isnan(projected_score)")
    by = rows.agg(F.count("*").alias("n"), F.count_if(F.col("projected_score") < threshold).alias("n_below"))
    return by.withColumn("percent_below", F.expr("try_divide(100 * CAST(n_below AS DOUBLE), CAST(n AS DOUBLE))"))


def colocalization_summary(scores: DataFrame, threshold: float = 0.0, p0: float = 0.5) -> dict[str, float]:
    """The counts with the one-sided proportion test of those below (one row, on the driver); no score raises."""
    row = colocalization_counts(scores, threshold).first()
    if not row.n:
        raise ValueError("no projected scores")
    return {"n": row.n, "n_below": row.n_below, "percent_below": row.percent_below, "pvalue": proportion_test(row.n_below, row.n, p0)["pvalue"]}


def colocalization_density(scores: DataFrame, points: int = 400) -> DataFrame:
    return density(scores, "projected_score", points)


def domain_categories(points: PointSet, target: str, feature: str, **how) -> DataFrame:
    """Anchors as neither, target, feature or overlap."""
    kind = category(F.col("target_domain"), F.col("feature_domain"), ("neither", "target", "feature", "overlap"))
    return domain_map(points, target, feature, **how).withColumn("category", kind)


def category(a: Column, b: Column, names) -> Column:
    return F.when(a & b, names[3]).when(a, names[1]).when(b, names[2]).otherwise(names[0])


def overlap_points(points: PointSet, first: str, second: str, cutoffs=None, shift=(0.0, 0.0)) -> DataFrame:
    """Points above the cutoff of either feature (given by feature, else the sample's mean), those of ``second`` displaced."""
    values = points.values(names_of([first, second]))
    on = masks(values, local_cutoffs(values, None, cutoffs)).where("active")
    move = lambda c, by: F.when(F.col("feature") == second, F.col(c) + by).otherwise(F.col(c)).alias(c)
    return on.select("obs_idx", "sample", "feature", move("x", shift[0]), move("y", shift[1]), "value")


def overlay_level(rows: DataFrame, cutoff="mean") -> DataFrame:
    """``sample, feature, cutoff`` by a rule: None or "mean", "median", "zero", a number, or ("quantile", q)."""
    if cutoff is None or cutoff == "mean":
        level = F.avg("value")
    elif cutoff == "median":
        return group_quantiles(rows, ["sample", "feature"], 0.5, "cutoff")
    elif cutoff == "zero":
        level = F.lit(0.0)
    elif isinstance(cutoff, (int, float)):
        level = F.lit(float(cutoff))
    elif isinstance(cutoff, tuple) and len(cutoff) == 2 and cutoff[0] == "quantile" and 0 <= cutoff[1] <= 1:
        return group_quantiles(rows, ["sample", "feature"], float(cutoff[1]), "cutoff")
    else:
        raise ValueError('a cutoff rule is "mean", "median", "zero", a number or ("quantile", q)')
    return rows.groupBy("sample", "feature").agg(level.alias("cutoff"))


def overlay(
    points: PointSet, first: str, second: str, space: str = "cell", rule="mean", cutoffs=None, grid_size=20.0, agg="mean", min_cells=1, sample=None, method: str | None = None, cutoff_samples=None, **how,
) -> DataFrame:
    """Units with ``a`` and ``b`` (positive for either feature) and their category. Cutoffs by feature (a mapping, a table, or what
    ``cohort_cutoffs`` gave) win; then a cohort ``method`` over all samples, or ``cutoff_samples``; then the rule."""
    if space not in ("cell", "grid"):
        raise ValueError("space is cell or grid")
    names, given = names_of([first, second]), explicit_cutoffs(cutoffs.cutoffs if isinstance(cutoffs, Cutoffs) else cutoffs)
    if method is not None and any(n not in given for n in names):
        given = explicit_cutoffs(merged_cutoffs(points, names, given, level=space, method=method, samples=cutoff_samples, grid_size=grid_size, agg=agg, min_cells=min_cells, **how))
    chosen = points.where(sample)
    values = chosen.values(names) if space == "cell" else once(grid_values(chosen, names, grid_size, agg, min_cells), "raster")
    ids = ["sample", "obs_idx", "x", "y"] if space == "cell" else ["sample", "gx", "gy"]
    level = overlay_level(values, rule)
    for n, c in given.items():
        level = level.withColumn("cutoff", F.when(F.col("feature") == n, F.lit(float(c))).otherwise(F.col("cutoff")))
    on = masks(values, level)
    one = lambda n: F.max(F.when(F.col("feature") == n, F.col("active"))).alias
    by = on.groupBy(*ids).agg(one(first)("a"), one(second)("b"))
    return by.withColumn("category", category(F.col("a"), F.col("b"), ("neither", first, second, "overlap")))


def overlay_counts(units: DataFrame) -> DataFrame:
    """Per sample: units, positives of either feature, overlap, and fractions."""
    by = units.groupBy("sample").agg(F.count("*").alias("n_units"), F.count_if("a").alias("n_a"), F.count_if("b").alias("n_b"), F.count_if(F.col("a") & F.col("b")).alias("n_overlap"))
    share = lambda c: F.expr(f"try_divide(CAST({c} AS DOUBLE), CAST(n_units AS DOUBLE))")
    return by.select("*", share("n_a").alias("fraction_a"), share("n_b").alias("fraction_b"), share("n_overlap").alias("fraction_overlap"))


def one_sample(niches: Niches, sample: str | None) -> str:
    """The named sample, or the only one."""
    found = [r.sample for r in niches.summary.select("sample").distinct().limit(2).collect()]
    if sample is None:
        if len(found) != 1:
            raise ValueError("name a sample: there are several")
        return found[0]
    if not niches.summary.where(F.col("sample") == str(sample)).limit(1).count():
        raise KeyError(f"no niches of sample {sample!r}")
    return str(sample)


def niche_overlay(first: Niches, second: Niches, feature1: str, feature2: str, space: str = "grid") -> DataFrame:
    """Grid cells occupied in both (or all points) as other, niche1, niche2 or overlap."""
    ids = ["sample", "gx", "gy"] if space == "grid" else ["sample", "obs_idx"]
    pick = lambda n, f, c: (n.grids if space == "grid" else n.cells.withColumnRenamed("in_niche", "niche")).where(F.col("feature") == f).select(*ids, F.col("niche").alias(c))
    rows = pick(first, feature1, "a").join(pick(second, feature2, "b"), ids)
    return rows.withColumn("category", category(F.col("a"), F.col("b"), ("other", "niche1", "niche2", "overlap")))


def positive_for(points: PointSet, niches: Niches, feature: str, cutoff: float | None = None, method: str | None = None, agg: str = "mean", **how) -> DataFrame:
    """Positive grid cells of a feature on the niches' own grid (sample, gx, gy, active), checked to be that grid. Cutoffs:
    the given one, the cohort method, or the sample's mean."""
    values = once(grid_values(points, feature, niches.grid_size, agg, niches.min_cells), "raster")
    niches.check_geometry(values, niches.grid_size, niches.min_cells, points.origins)
    given = None if cutoff is None else {feature: cutoff}
    if given is None and method is not None:
        given = merged_cutoffs(points, feature, None, level="grid", method=method, grid_size=niches.grid_size, agg=agg, min_cells=niches.min_cells, **how)
    return masks(values, local_cutoffs(values, None, given)).select("sample", "gx", "gy", "active")


def niche_positive_overlay(niches: Niches, niche_feature: str, positive: DataFrame, points: PointSet | None = None) -> DataFrame:
    """Niche cells against a positive mask (sample, gx, gy, active) of the same grid; with ``points``, a row per point."""
    mine = niches.grids.where(F.col("feature") == niche_feature).select("sample", "gx", "gy", F.col("niche").alias("a"))
    rows = mine.join(positive.select("sample", "gx", "gy", F.col("active").alias("b")), ["sample", "gx", "gy"])
    if points is not None:
        placed = place(points.cells.select("obs_idx", "sample", "x", "y"), points.origins, niches.grid_size).select("obs_idx", "sample", "x", "y", "gx", "gy")
        rows = placed.join(rows, ["sample", "gx", "gy"], "left").na.fill(False, ["a", "b"])
    return rows.withColumn("category", category(F.col("a"), F.col("b"), ("other", "niche", "positive", "overlap")))


def category_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample", "category").agg(F.count("*").alias("n"))


def niche_feature_values(niches: Niches, niche_feature: str, points: PointSet, feature: str, space: str = "grid", agg: str = "mean", quantiles=(0.01, 0.99), vmin: float | None = None, vmax: float | None = None) -> DataFrame:
    """Values of a feature with the niche flag, of grid cells or points, and the range of colours ``vmin, vmax`` per sample: as given,
    else these quantiles of the values (None: the least and greatest), widened if equal."""
    if space not in ("cell", "grid"):
        raise ValueError("space is cell or grid")
    if space == "grid":
        values = once(grid_values(points, feature, niches.grid_size, agg, niches.min_cells), "raster")
        niches.check_geometry(values, niches.grid_size, niches.min_cells, points.origins)
        ids, flag = ["sample", "gx", "gy"], niches.grids.where(F.col("feature") == niche_feature)
    else:
        values = points.values(feature)
        ids, flag = ["sample", "obs_idx"], niches.cells.where(F.col("feature") == niche_feature).withColumnRenamed("in_niche", "niche")
    low, high = (0.0, 1.0) if quantiles is None else map(float, quantiles)
    if not 0 <= low <= high <= 1:
        raise ValueError("quantiles rise within [0, 1]")
    end = lambda q, given, name: values.groupBy("sample").agg(F.lit(float(given)).alias(name)) if given is not None else group_quantiles(values, ["sample"], q, name)
    ends = end(low, vmin, "vmin").join(end(high, vmax, "__high"), "sample")
    ends = ends.select("sample", "vmin", F.when(F.col("__high") > F.col("vmin"), F.col("__high")).otherwise(F.col("vmin") + 1e-12).alias("vmax"))
    return Lookup(ends, ["sample"]).join(values.join(flag.select(*ids, "niche"), ids, "left").na.fill(False, ["niche"]), "left")


def boundary_segments(mask: DataFrame, x0: float | str = 0.0, y0: float | str = 0.0, grid_size: float = 1.0) -> DataFrame:
    """Ends of the unit edges between active grid cells and what is outside: ``sample, xa, ya, xb, yb``."""
    #: Neighbour, then the ends of the shared edge.
    sides = [(-1, 0, 0, 0, 0, 1), (1, 0, 1, 0, 1, 1), (0, -1, 0, 0, 1, 0), (0, 1, 0, 1, 1, 1)]
    each = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(("dx", "dy", "xa", "ya", "xb", "yb"), s, strict=True)]) for s in sides])).alias("s")
    near = mask.select("sample", "gx", "gy", each).withColumn("nx", F.col("gx") + F.col("s.dx")).withColumn("ny", F.col("gy") + F.col("s.dy"))
    inside = mask.select("sample", F.col("gx").alias("nx"), F.col("gy").alias("ny"))
    out = near.join(inside, ["sample", "nx", "ny"], "left_anti")
    base = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    at = lambda g, s, o: (base(o) + (F.col(g) + F.col(f"s.{s}")) * F.lit(float(grid_size))).alias(s)
    return out.select("sample", at("gx", "xa", x0), at("gy", "ya", y0), at("gx", "xb", x0), at("gy", "yb", y0))


def placed_values(points: PointSet, feature: str, grid_size: float = 20.0) -> DataFrame:
    """Points with their grid cell and value, for plots in either space."""
    return place(points.values(feature), points.origins, grid_size).select("sample", "obs_idx", "x", "y", "gx", "gy", "value")


#: The names that users of such analyses know for the data of their figures.
spatial_vecPlot, spatial_magPlot = vector_path, magnitude_against_score
plot_vector, plot_magnitude_projected, plot_projected_heatmap = vector_path, magnitude_against_score, heatmap_cells
plot_paired_projected_scores, plot_colocalization_distribution = paired_scores, colocalization_density
plot_grid_feature_map, plot_kdtree_domain_map, plot_spatial_overlap = placed_values, domain_categories, overlap_points
plot_binary_overlay, plot_niche_overlay, plot_niche_positive_overlay, plot_niche_continuous_feature = overlay, niche_overlay, niche_positive_overlay, niche_feature_values
one_sided_proportion_test = proportion_test
