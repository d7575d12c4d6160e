"""How the overlap of two binary grids changes as one is displaced.

Rasters are written once, so points are not scanned again for each reader. Masks stay wide (one row per occupied grid cell,
a boolean per feature). All displacements of all features are one
equi-join of the masks with themselves on shifted keys, computed before the join, followed by one aggregation with a few
sums per feature; its partial results are tiny, so the shuffle behind it is too.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.functions.expressions import grid_steps, names_of, operator_shift_rows, rounded_ratio, shift_rows, shift_table
from spatiarc.operators.niches import Niches
from spatiarc.operators.raster import above, explicit_cutoffs, local_cutoffs, occupancy, raster_columns
from spatiarc.plans.lookup import Lookup
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet, unpivot

GRID = ["sample", "gx", "gy"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def mask(name: str) -> Column:
    """The boolean column of a feature in a table of masks, whatever the feature is called."""
    return F.col(quoted(f"on:{name}"))


def niche_map(niches) -> dict[str, Niches]:
    """Niches by feature, from one result, several, or a mapping (whose keys win)."""
    if niches is None:
        return {}
    if isinstance(niches, dict):
        if bad := [k for k, v in niches.items() if not isinstance(v, Niches)]:
            raise TypeError(f"not niches: {bad}")
        return dict(niches)
    several = [niches] if isinstance(niches, Niches) else list(niches)
    return {f: n for n in several for f in n.features}


def niche_feature(key: str, niches: Niches) -> str:
    """The feature whose niches stand for ``key``: ``key`` itself, or the only one there is, with a warning."""
    if key in niches.features:
        return key
    if len(niches.features) > 1:
        raise ValueError(f"the niches given for {key!r} are of several features, {list(niches.features)}, and it is none of them")
    warnings.warn(f"niches of {niches.features[0]!r} stand for {key!r}", stacklevel=3)
    return niches.features[0]


def wide_masks(points: PointSet, names: list[str], grid_size=20.0, agg="mean", min_cells=1, quantiles=None, cutoffs=None, niches=None) -> tuple[DataFrame, DataFrame]:
    """(masks: sample, gx, gy and a boolean per name (``mask``); cutoffs: sample, feature, cutoff), positive cells or niches."""
    by_niche = niche_map(niches)
    if extra := sorted(set(by_niche) - set(names)):
        raise ValueError(f"niches of features that are not asked for: {extra}")
    plain = [n for n in names if n not in by_niche]
    if plain:
        grid = once(raster_columns(points, plain, grid_size, agg, min_cells), "raster")
    else:
        grid = once(occupancy(points, grid_size, min_cells), "raster")
    cut = local_cutoffs(unpivot(grid, GRID, plain), quantiles, cutoffs) if plain else None
    out = grid
    if plain:
        levels = cut.groupBy("sample").agg(*[F.max(F.when(F.col("feature") == n, F.col("cutoff"))).alias(f"cut{i}") for i, n in enumerate(plain)])
        out = Lookup(levels, ["sample"]).join(out, "left")
        out = out.select(*GRID, *[above(F.col(f"v{i}"), F.col(f"cut{i}")).alias(f"on:{n}") for i, n in enumerate(plain)])
    else:
        out = out.select(*GRID)
    for n, found in by_niche.items():
        of = niche_feature(n, found)
        found.check_geometry(out.select(*GRID), float(grid_size), min_cells, points.origins)
        member = found.grids.where((F.col("feature") == of) & F.col("niche")).select(*GRID, F.lit(True).alias("__in"))
        out = out.join(member, GRID, "left").withColumn(f"on:{n}", F.coalesce("__in", F.lit(False))).drop("__in")
    return out.select(*GRID, *[mask(n) for n in names]), cut


def displacement_stats(masks: DataFrame, target: str, features, shifts: DataFrame, digits: int | None = 4) -> DataFrame:
    """Per sample, feature and displacement: counts and ratios of the overlap, and the change of the Jaccard index.

    ``pct_p`` is the Jaccard index inside the domain (cells occupied both before and after the displacement), ``pct_pmin``
    and ``pct_pmax`` the overlap over the larger and the smaller mask, the ``pct_op`` ones the same over all cells without
    displacement; rounded before ``diff_pct`` is taken. Displacements without any common cell have counts 0 and NULL ratios.
    """
    names = names_of(features)
    both = lambda t, f: F.sum((t & f).cast("bigint"))
    count = lambda c: F.sum(c.cast("bigint"))
    flag = {n: mask(n) for n in names}
    still = masks.groupBy("sample").agg(
        F.count("*").alias("cnt_all"), count(mask(target)).alias("ot"),
        *[x for i, n in enumerate(names) for x in (count(flag[n]).alias(f"of{i}"), both(mask(target), flag[n]).alias(f"oi{i}"))],
    )
    shifts = F.broadcast(shifts)  # as many rows as displacements asked for
    moved = masks.select("sample", "gx", "gy", *[flag[n].alias(f"f{i}") for i, n in enumerate(names)]).crossJoin(shifts)
    moved = moved.select("sample", (F.col("gx") + F.col("dx").cast("bigint")).alias("gx"), (F.col("gy") + F.col("dy").cast("bigint")).alias("gy"), "step", "direction", *[f"f{i}" for i in range(len(names))])
    there = masks.select(*GRID, mask(target).alias("t"))
    met = moved.join(there, GRID).groupBy("sample", "step", "direction").agg(
        F.count("*").alias("n"), count(F.col("t")).alias("t"),
        *[x for i in range(len(names)) for x in (count(F.col(f"f{i}")).alias(f"f{i}"), both(F.col("t"), F.col(f"f{i}")).alias(f"i{i}"))],
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint")
    rows = still.crossJoin(shifts).join(met, ["sample", "step", "direction"], "left")
    per = F.array(*[
        F.struct(F.lit(n).alias("feature"), zero(f"i{i}").alias("cnt_p"), zero(f"f{i}").alias("cnt_p2"), F.col(f"oi{i}").alias("oi"), F.col(f"of{i}").alias("of"))
        for i, n in enumerate(names)
    ])
    rows = rows.select("sample", "step", "direction", "dx", "dy", "cnt_all", "ot", zero("n").alias("cnt_px"), zero("t").alias("cnt_p1"), F.explode(per).alias("p"))
    rows = rows.select("sample", "p.feature", "step", "direction", "dx", "dy", "p.cnt_p", "cnt_p1", "p.cnt_p2", "cnt_px", "cnt_all", "ot", "p.oi", "p.of")
    rows = rows.withColumns({
        "pct_p": rounded_ratio("cnt_p", "(cnt_p1 + cnt_p2 - cnt_p)", digits), "pct_pmin": rounded_ratio("cnt_p", "greatest(cnt_p1, cnt_p2)", digits),
        "pct_pmax": rounded_ratio("cnt_p", "least(cnt_p1, cnt_p2)", digits), "pct_op": rounded_ratio("oi", "(ot + `of` - oi)", digits),
        "pct_opmin": rounded_ratio("oi", "greatest(ot, `of`)", digits), "pct_opmax": rounded_ratio("oi", "least(ot, `of`)", digits),
    })
    return rows.withColumn("diff_pct", F.col("pct_p") - F.col("pct_op"))


STAT_COLUMNS = ["pct_p", "pct_pmin", "pct_pmax", "pct_op", "pct_opmin", "pct_opmax", "diff_pct", "cnt_p", "cnt_p1", "cnt_p2", "cnt_px", "cnt_all"]


def displacement_table(points: PointSet, target: str, feature: str, operator_steps=(4, 4, 4, 4), grid_size=1.0, agg="mean", min_cells=1, quantiles=None, cutoffs=None, digits: int | None = 4) -> DataFrame:
    """The eight displacements of ``feature`` against ``target``: ``sample, direction`` and the statistics. ``quantiles`` (a
    pair) win over ``cutoffs`` (a pair, or by feature, then both must be there); else means."""
    if len(operator_steps) != 4:
        raise ValueError("operator_steps are four: +X, -X, +Y, -Y")
    pair = [target, feature]
    if quantiles is not None:
        quantiles, cutoffs = dict(zip(pair, quantiles, strict=True)), None
    elif cutoffs is not None and not hasattr(cutoffs, "items") and not isinstance(cutoffs, DataFrame):
        cutoffs = dict(zip(pair, cutoffs, strict=True))
    elif cutoffs is not None and (missing := [n for n in pair if n not in explicit_cutoffs(cutoffs)]):
        raise KeyError(f"no cutoff for {missing}")
    masks, _ = wide_masks(points, names_of(pair), grid_size, agg, min_cells, quantiles, cutoffs)
    shifts = shift_table(points.cells.sparkSession, operator_shift_rows(*map(int, operator_steps)))
    return displacement_stats(masks, target, feature, shifts, digits).select("sample", "direction", *STAT_COLUMNS)


def adjusted_points(first: DataFrame, second: DataFrame) -> PointSet:
    """Two mapped point tables (obs_idx, sample, x, y, value) as points with the features ``first`` and ``second``. They must be
    the same points at the same places."""
    if any("value" not in df.columns for df in (first, second)):
        raise ValueError("both tables must hold values of a feature")
    a = first.select("obs_idx", "sample", "x", "y", F.col("value").alias("first"))
    b = second.select("obs_idx", F.col("sample").alias("s"), F.col("x").alias("u"), F.col("y").alias("v"), F.col("value").alias("second"))
    both = a.join(b, "obs_idx", "full")
    same = lambda p, q: F.abs(F.col(p) - F.col(q)) <= 1e-8 + 1e-5 * F.abs(q)
    if both.where(~F.coalesce(F.col("sample").eqNullSafe(F.col("s")) & same("x", "u") & same("y", "v"), F.lit(False))).limit(1).count():
        raise ValueError("the tables must hold the same points at the same coordinates")
    return PointSet(both.select("obs_idx", "sample", "x", "y", "first", "second"))


def displacement_summary(table: DataFrame) -> DataFrame:
    """Means of all statistics over the directions."""
    return table.groupBy("sample").agg(*[F.avg(c).alias(c) for c in STAT_COLUMNS])


VECTOR_SCHEMA = """min_djaccard double, max_djaccard double, feature string, step double, sample string, cutoff_target double, cutoff_feature double,
n_bins bigint, n_positive_target bigint, n_positive_feature bigint, positive_fraction_target double, positive_fraction_feature double,
n_binary_target bigint, n_binary_feature bigint, binary_fraction_target double, binary_fraction_feature double, binary_source_target string,
binary_source_feature string, backend string"""


def vector_columns() -> list[str]:
    return [c.split()[0] for c in VECTOR_SCHEMA.replace("\n", " ").split(",")]


def grid_vectors(points: PointSet, target: str, features, steps=None, grid_size=20.0, agg="mean", min_cells=1, quantiles=None, cutoffs=None, niches=None, digits: int | None = 4) -> DataFrame:
    """Per sample, feature and step, the least and greatest change of the Jaccard index over eight directions, with cutoffs
    and counts. Features that nobody knows give rows of NULLs; an unknown target raises."""
    by_niche, names = niche_map(niches), names_of(features)
    steps = grid_steps(steps)
    if not set(by_niche) <= {target, *names}:
        raise ValueError("niches of features that are not asked for")
    plain = names_of([n for n in (target, *names) if n not in by_niche]) if {target, *names} - set(by_niche) else []
    known = set(points.known(plain)) | set(by_niche) if plain else set(by_niche)
    used = [n for n in names if n in known]
    spark = points.cells.sparkSession
    all_names = list(dict.fromkeys([target, *used]))
    masks, cut = wide_masks(points, all_names, grid_size, agg, min_cells, quantiles, cutoffs, by_niche)
    source = lambda n: F.lit("niche" if n in by_niche else "positive")
    out = None
    if used:
        stats = displacement_stats(masks, target, used, shift_table(spark, shift_rows(steps)), digits)
        rows = stats.groupBy("sample", "feature", "step").agg(
            F.min("diff_pct").alias("min_djaccard"), F.max("diff_pct").alias("max_djaccard"), F.first("cnt_all").alias("n_bins"), F.first("ot").alias("nt"), F.first("of").alias("nf")
        )
        if cut is not None:
            rows = rows.join(cut.withColumnRenamed("cutoff", "cutoff_feature"), ["sample", "feature"], "left")
            rows = rows.join(cut.where(F.col("feature") == target).select("sample", F.col("cutoff").alias("cutoff_target")), "sample", "left")
        else:
            rows = rows.withColumns({"cutoff_feature": F.lit(None).cast("double"), "cutoff_target": F.lit(None).cast("double")})
        share = lambda c: F.expr(f"try_divide(CAST({c} AS DOUBLE), CAST(n_bins AS DOUBLE))")
        by_feature = F.when(F.col("feature").isin(list(by_niche)), "niche").otherwise("positive") if by_niche else F.lit("positive")
        out = rows.select(
            "min_djaccard", "max_djaccard", "feature", "step", "sample", "cutoff_target", "cutoff_feature", "n_bins", F.col("nt").alias("n_positive_target"), F.col("nf").alias("n_positive_feature"),
            share("nt").alias("positive_fraction_target"), share("nf").alias("positive_fraction_feature"), F.col("nt").alias("n_binary_target"), F.col("nf").alias("n_binary_feature"),
            share("nt").alias("binary_fraction_target"), share("nf").alias("binary_fraction_feature"), source(target).alias("binary_source_target"), by_feature.alias("binary_source_feature"),
            F.lit("grid").alias("backend"),
        )
    for n in (n for n in names if n not in known):
        empty = points.cells.select("sample").distinct().crossJoin(spark.createDataFrame([(s,) for s in steps], "step double"))
        filled = {"feature": F.lit(n), "binary_source_target": source(target), "binary_source_feature": F.lit("positive"), "backend": F.lit("grid"), "sample": F.col("sample"), "step": F.col("step")}
        types = dict(x.split() for x in VECTOR_SCHEMA.replace("\n", " ").split(","))
        blank = empty.select(*[filled.get(c, F.lit(None)).cast(types[c]).alias(c) for c in vector_columns()])
        out = blank if out is None else out.unionByName(blank)
    return out


def cohort_vectors(vectors: DataFrame) -> DataFrame:
    """Means over samples of the changes, per feature and step; samples without a value don't count."""
    return vectors.groupBy("feature", "step").agg(F.avg("min_djaccard").alias("min_djaccard"), F.avg("max_djaccard").alias("max_djaccard"), F.count("*").alias("n_samples"))


def projected_score(vectors: DataFrame, by=(), keep=()) -> DataFrame:
    """(min + max) / 2 at the last step, missing values as 0; with other columns of that step in ``keep``."""
    by = list(by)
    last = vectors.join(vectors.groupBy(*by).agg(F.max("step").alias("__last")), by) if by else vectors.crossJoin(vectors.agg(F.max("step").alias("__last")))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return last.where("step = __last").select(*by, "feature", *keep, ((zero("min_djaccard") + zero("max_djaccard")) / 2).alias("projected_score"))


def vector_length(vectors: DataFrame, by=()) -> DataFrame:
    """Length of the path from the origin through the vectors in order of step, missing coordinates as 0."""
    w = Window.partitionBy(*by, "feature").orderBy("step")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    leg = lambda c: F.pow(F.col(c) - F.lag(c, 1, 0.0).over(w), 2)
    at = vectors.select(*by, "feature", "step", zero("min_djaccard").alias("a"), zero("max_djaccard").alias("b"))
    return at.withColumn("leg", F.sqrt(leg("a") + leg("b"))).groupBy(*by, "feature").agg(F.sum("leg").alias("vector_len"))


def pairwise_scores(masks: DataFrame, names: list[str], step: float, digits: int | None = 4) -> DataFrame:
    """``sample, target, feature, projected_score`` of all ordered pairs at one step; NULL if no direction has a value.

    Each cell lists its active features; pairs that meet are counted from these lists, so the join is one for all pairs.
    """
    spark = masks.sparkSession
    shifts = F.broadcast(shift_table(spark, shift_rows([step])))
    active = masks.select(*GRID, F.array_compact(F.array(*[F.when(mask(n), F.lit(n)) for n in names])).alias("on"))
    moved = active.crossJoin(shifts).select("sample", (F.col("gx") + F.col("dx").cast("bigint")).alias("gx"), (F.col("gy") + F.col("dy").cast("bigint")).alias("gy"), "direction", F.col("on").alias("fs"))
    met = moved.join(active.select(*GRID, F.col("on").alias("ts")), GRID).where("size(fs) + size(ts) > 0")

    def tally(rows, *by):
        none = F.lit(None).cast("string")
        pair = lambda t, f: F.struct(t.alias("target"), f.alias("feature"))
        items = F.concat(
            F.flatten(F.transform("ts", lambda t: F.transform("fs", lambda f: pair(t, f)))), F.transform("ts", lambda t: pair(t, none)), F.transform("fs", lambda f: pair(none, f))
        )
        return rows.select(*by, F.explode(items).alias("p")).groupBy(*by, "p.target", "p.feature").agg(F.count("*").alias("n"))

    ordered = [(t, f) for t in names for f in names if t != f]
    pairs = spark.createDataFrame(ordered, "target string, feature string") if ordered else spark.createDataFrame([], "target string, feature string")

    def joined(rows, counts, by, suffix):
        i = counts.where("target IS NOT NULL AND feature IS NOT NULL").withColumnRenamed("n", f"i{suffix}")
        a = counts.where("feature IS NULL").select(*by, "target", F.col("n").alias(f"a{suffix}"))
        b = counts.where("target IS NULL").select(*by, "feature", F.col("n").alias(f"b{suffix}"))
        return rows.join(i, [*by, "target", "feature"], "left").join(a, [*by, "target"], "left").join(b, [*by, "feature"], "left").na.fill(0, [f"{x}{suffix}" for x in "iab"])

    still = tally(active.select("sample", F.col("on").alias("ts"), F.col("on").alias("fs")), "sample")
    base = joined(active.select("sample").distinct().crossJoin(F.broadcast(pairs)), still, ["sample"], "0")
    rows = joined(base.crossJoin(shifts.select("direction")), tally(met, "sample", "direction"), ["sample", "direction"], "1")
    diff = rounded_ratio("i1", "(a1 + b1 - i1)", digits) - rounded_ratio("i0", "(a0 + b0 - i0)", digits)
    by = rows.withColumn("d", diff).groupBy("sample", "target", "feature").agg(F.min("d").alias("mn"), F.max("d").alias("mx"))
    return by.select("sample", "target", "feature", ((F.col("mn") + F.col("mx")) / 2).alias("projected_score"))


def pairwise_matrix(scores: DataFrame, names: list[str]) -> DataFrame:
    """Means over samples as a matrix: a row per target and a column per feature, in the given order; the diagonal is NULL."""
    rows = scores.groupBy("target").pivot("feature", names).agg(F.avg("projected_score"))
    order = scores.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "target string, position int")
    return order.join(rows, "target", "left").orderBy("position").select("target", *[F.col(quoted(n)) for n in names])
