"""Neighbourhoods of a radius around points instead of grid cells.

"Within the radius of an active point" is a range semi-join. Points of one place share the answer, so places are asked, with
their points counted. Small squares decide most of them before any shuffle; the rest meet the sites that reach their square, an
equi-join with the exact distance as a residual. No such join is left to a broadcast: files tell too little of how many rows they give.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spatiarc.functions.expressions import names_of, radius_steps, rounded_ratio, shift_rows, shift_table
from spatiarc.operators.displace import niche_feature, niche_map
from spatiarc.operators.raster import above, local_cutoffs
from spatiarc.plans.lookup import BROADCAST_ROWS, Lookup, bounded
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet


def check_radius(radius: float, min_coverage: float = 0.0) -> None:
    if not radius > 0:
        raise ValueError("the radius must be positive")
    if not 0 <= min_coverage <= 1:
        raise ValueError("min_coverage lies in [0, 1]")


def active_points(points: PointSet, names: list[str], quantiles=None, cutoffs=None, niches=None) -> tuple[DataFrame, DataFrame | None]:
    """(sample, obs_idx, x, y, feature of active points; sample, feature, cutoff)."""
    by_niche = niche_map(niches)
    plain = [n for n in names if n not in by_niche]
    out = cut = None
    if plain:
        values = points.values(plain)
        found = Lookup(local_cutoffs(values.where("value IS NOT NULL"), quantiles, cutoffs), ["sample", "feature"])
        cut = found.table
        out = found.join(values).where(above(F.col("value"), F.col("cutoff"))).select("sample", "obs_idx", "x", "y", "feature")
    for n, found in by_niche.items():
        of = niche_feature(n, found)
        missing = points.cells.join(found.cells.where(F.col("feature") == of), "obs_idx", "left_anti").limit(1).count()
        if missing:
            raise ValueError(f"niches of {n!r} lack some of the points")
        member = found.cells.where((F.col("feature") == of) & F.col("in_niche")).select("obs_idx")
        rows = points.cells.select("sample", "obs_idx", "x", "y").join(member, "obs_idx").select("sample", "obs_idx", "x", "y", F.lit(n).alias("feature"))
        out = rows if out is None else out.unionByName(rows)
    return once(out, "active-points"), cut


def at_places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, n): each place once, with its number of rows."""
    return once(rows.groupBy(*keys, "x", "y").agg(F.count("*").alias("n")), "places")


def around() -> Column:
    """The squares up to two away, each with a bit of its own."""
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(1 << (5 * (i + 2) + j + 2)).alias("bit")) for i in range(-2, 3) for j in range(-2, 3)])


#: Displaced rows that are asked one by one at most; of more, squares that are all in or all out are counted as one.
PROBES = 50_000_000

#: Sites of one square that are held at once at most, while others may still beat them.
FRONTIER_ROWS = 100_000


def unbeaten(x: np.ndarray, y: np.ndarray, slack: float) -> np.ndarray:
    """Which of the sites may be the nearest to some point of the square from (0, 0) to (1, 1). A site nearer than another to all four
    corners is nearer to every point between them. Those nearest to points of a lattice beat the rest, a finer lattice the rest of that."""
    kept = np.arange(len(x))
    for most in (4, 16):
        g = (np.arange(n := min(most, int(len(kept) ** 0.5) + 1)) + 0.5) / n
        ax, ay = x[kept], y[kept]
        best = np.unique(((ax - np.repeat(g, n)[:, None]) ** 2 + (ay - np.tile(g, n)[:, None]) ** 2).argmin(axis=1))
        corners = np.stack([(ax - i) ** 2 + (ay - j) ** 2 for i in (0, 1) for j in (0, 1)])
        beaten = np.zeros(len(kept), dtype=bool)
        for b in best:
            beaten |= (corners[:, b, None] + slack <= corners).all(axis=0)
        kept = kept[~beaten]
    out = np.zeros(len(x), dtype=bool)
    out[kept] = True
    return out


def frontier(sites: DataFrame, side: float, keys: list[str]) -> DataFrame:
    """``sites`` (keys, sx, sy, smx, smy) without those that another site of the same square is nearer than, wherever a point lies in the
    square: the exact test gives the same without them. A dense square keeps its rim, not its area; rows are streamed square by square."""
    of = [*keys, "smx", "smy"]

    def prune(rows: pd.DataFrame) -> pd.DataFrame:
        x, y = (rows[f"s{c}"].to_numpy() / side - rows[f"sm{c}"].to_numpy() for c in "xy")
        return rows[unbeaten((x + 1e-6) / (1 + 2e-6), (y + 1e-6) / (1 + 2e-6), 1e-6)]  # the square is a little wider, for what doubles round

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
            new = np.zeros(len(rows), dtype=bool)
            for c in of:
                at = rows[c].to_numpy()
                new[1:] |= at[1:] != at[:-1]
            ends = [*np.flatnonzero(new), len(rows)]
            whole = [prune(rows.iloc[a:b]) for a, b in zip([0, *ends], ends[:-1])]
            held = prune(rows.iloc[ends[-2] if len(ends) > 1 else 0 :])
            if len(held) > FRONTIER_ROWS:
                whole, held = [*whole, held], None
            if whole:
                yield pd.concat(whole, ignore_index=True)
        if held is not None:
            yield held

    return sites.repartition(*of).sortWithinPartitions(*of).mapInPandas(stream, sites.schema)


class Sites:
    """Places (keys, x, y) that others may lie near to, and the small squares that decide most of them.

    Any two points of a small square are near, so with a site in its own square a point is in; without one in the two squares
    around it, it is out. The table of such squares follows the area, not the points; it is counted, and broadcast if small (else
    no point is decided by it).
    """

    def __init__(self, rows: DataFrame, radius: float, keys: list[str]):
        self.rows, self.radius, self.keys = rows.select(*keys, "x", "y"), float(radius), keys
        self.width = self.radius / 2**0.5 * (1 - 1e-6)  # the margin is for sums that doubles round
        self.side = F.lit(self.width)

    def square(self, c: str) -> Column:
        return F.floor(F.col(c) / self.side).cast("bigint")

    @cached_property
    def squares(self) -> DataFrame | None:
        held = self.rows.select(*self.keys, self.square("x").alias("mx"), self.square("y").alias("my")).distinct().select(*self.keys, "mx", "my", F.explode(around()).alias("o"))
        held = held.select(*self.keys, (F.col("mx") + F.col("o.i")).alias("mx"), (F.col("my") + F.col("o.j")).alias("my"), F.expr("o.i = 0 AND o.j = 0").alias("sure"))
        return bounded(held.groupBy(*self.keys, "mx", "my").agg(F.max("sure").alias("sure")))

    @cached_property
    def windows(self) -> DataFrame:
        """(keys, wx, wy, sure): four squares each, of which some hold or face a site; ``sure`` if they all decide that points are in."""
        four = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
        held = self.squares.select(*self.keys, "mx", "my", "sure", F.explode(four).alias("o"))
        held = held.select(*self.keys, (F.col("mx") - F.col("o.i")).alias("wx"), (F.col("my") - F.col("o.j")).alias("wy"), "sure")
        return held.groupBy(*self.keys, "wx", "wy").agg((F.count_if("sure") == 4).alias("sure"))

    @cached_property
    def facing(self) -> DataFrame:
        """(keys, qx, qy, open): of squares with sites, which of those around are undecided, as bits."""
        bits = self.squares.where("NOT sure").select(*self.keys, "mx", "my", F.explode(around()).alias("o"))
        bits = bits.select(*self.keys, (F.col("mx") - F.col("o.i")).alias("qx"), (F.col("my") - F.col("o.j")).alias("qy"), "o.bit")
        held = self.squares.where("sure").select(*self.keys, F.col("mx").alias("qx"), F.col("my").alias("qy"))
        return bits.join(F.broadcast(held), [*self.keys, "qx", "qy"]).groupBy(*self.keys, "qx", "qy").agg(F.bit_or("bit").alias("open"))

    @cached_property
    def reaching(self) -> DataFrame:
        """(s_keys, sx, sy, smx, smy): sites beside the undecided squares that some point there may be near to, and nearest
        to. Sites amid others face none."""
        at = self.rows.withColumns({"qx": self.square("x"), "qy": self.square("y")}).join(F.broadcast(self.facing), [*self.keys, "qx", "qy"])
        at = at.select("*", F.explode(F.filter(around(), lambda o: F.col("open").bitwiseAND(o["bit"]) != 0)).alias("o"))
        at = at.select(*[F.col(k).alias(f"s_{k}") for k in self.keys], F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("qx") + F.col("o.i")).alias("smx"), (F.col("qy") + F.col("o.j")).alias("smy"))
        gap = lambda c, m: F.greatest(F.col(m) * self.side - F.col(c), F.col(c) - (F.col(m) + 1) * self.side, F.lit(0.0))
        gx, gy = gap("sx", "smx"), gap("sy", "smy")
        at = at.where(gx * gx + gy * gy < (self.radius * (1 + 1e-6)) ** 2)
        return once(frontier(at, self.width, [f"s_{k}" for k in self.keys]), "reaching")


def near(probe: DataFrame, sites: Sites, probe_moves: bool) -> DataFrame:
    """Rows of ``probe`` (keys, x, y, dx, dy) with a site less than the radius away once the moving side is displaced by (dx, dy):
    active points move, anchors don't. Only rows along the rims, which squares don't decide, go to the exact test."""
    if sites.squares is None:
        return within(probe, sites.rows, sites.radius, sites.keys, probe_moves)
    sign = 1 if probe_moves else -1
    at = probe.withColumns({"px": F.col("x") + sign * F.col("dx"), "py": F.col("y") + sign * F.col("dy")}).withColumns({"mx": sites.square("px"), "my": sites.square("py")})
    held = sites.squares.withColumnsRenamed({c: f"held_{c}" for c in (*sites.keys, "mx", "my")})
    here = [F.col(c) == F.col(f"held_{c}") for c in (*sites.keys, "mx", "my")]
    # the square is read off the table of squares: were the exact test on columns of the probe alone, Spark would run it below this join, on every row
    marked = at.join(F.broadcast(held), here).select(*probe.columns, "held_mx", "held_my", "sure")
    rim = beside(marked.where("NOT sure"), sites.reaching, sites.radius, [*sites.keys, "held_mx", "held_my"], [*[f"s_{k}" for k in sites.keys], "smx", "smy"], probe_moves)
    return marked.where("sure").select(*probe.columns).unionByName(rim.select(*probe.columns))


def near_counts(rows: DataFrame, sites: Sites, by: list[str], shifts: DataFrame, probe_moves: bool) -> DataFrame:
    """``by, step, direction, n``: how many of ``rows`` (by, x, y, n; ``by`` has the keys of the sites) are near a site, by displacement.

    A displaced small square of rows lies in four squares of the sites. Where all four are in or all are out, its rows are counted as one;
    only rows of the other squares and displacements become rows of their own, so the dense inside of an area costs what its squares cost.
    """
    out = [*by, "step", "direction"]
    total = lambda found: found.groupBy(*out).agg(F.sum("n").alias("n"))
    plain = rows.select(*by, "x", "y", "n")
    every = lambda: total(near(plain.crossJoin(F.broadcast(shifts)), sites, probe_moves))
    sign, listed = 1 if probe_moves else -1, shifts.collect()  # as many as displacements asked for
    if sites.squares is None or plain.count() * len(listed) <= PROBES:
        return every()
    told = []
    for i, s in enumerate(listed):
        at = [sign * d / sites.width for d in (s.dx, s.dy)]
        clear = all(a == 0 or 1e-6 < a % 1 < 1 - 1e-6 for a in at)  # else what doubles round may reach a third square
        told.append(f"({i}, {s.step!r}D, '{s.direction}', {s.dx!r}D, {s.dy!r}D, {math.floor(at[0])}L, {math.floor(at[1])}L, {str(clear).lower()})")
    moves = rows.sparkSession.sql(f"SELECT * FROM VALUES {', '.join(told)} AS moves(i, step, direction, dx, dy, ox, oy, clear)")
    placed = plain.withColumns({"qx": sites.square("x"), "qy": sites.square("y")})
    held = once(placed.groupBy(*by, "qx", "qy").agg(F.sum("n").alias("n")), "square-counts")
    judged = held.crossJoin(F.broadcast(moves)).withColumns({"wx": F.expr("qx + ox"), "wy": F.expr("qy + oy")}).join(F.broadcast(sites.windows), [*sites.keys, "wx", "wy"], "left")
    mixed = once(judged.where("NOT clear OR NOT sure").groupBy(*sites.keys, "qx", "qy").agg(F.collect_set("i").alias("open")), "mixed-squares")
    if mixed.count() > BROADCAST_ROWS:
        return every()
    asked = placed.join(F.broadcast(mixed), [*sites.keys, "qx", "qy"]).select(*plain.columns, F.explode("open").alias("i"))
    asked = asked.join(F.broadcast(moves.select("i", "step", "direction", "dx", "dy")), "i").drop("i")
    return total(total(judged.where("clear AND sure")).unionByName(total(near(asked, sites, probe_moves))))


def beside(left: DataFrame, right: DataFrame, radius: float, keys: list[str], others: list[str], probe_moves: bool) -> DataFrame:
    """Rows of ``left`` (x, y, dx, dy) with one of ``right`` (sx, sy) of the same keys less than the radius away. A semi-join stops at
    the first site, so nothing is paired and made distinct again. It is a merge join, which spills; the left rows of a dense square are
    split by adaptive execution."""
    gap = lambda p, q, d: F.col(q) - F.col(p) - F.col(d) if probe_moves else F.col(p) - F.col(q) - F.col(d)
    gx, gy = gap("x", "sx", "dx"), gap("y", "sy", "dy")
    on = gx * gx + gy * gy < F.lit(float(radius)) * F.lit(float(radius))
    for k, other in zip(keys, others):
        on = on & (F.col(k) == F.col(other))
    return left.join(right.hint("merge"), on, "left_semi")


def within(probe: DataFrame, sites: DataFrame, radius: float, keys: list[str], probe_moves: bool) -> DataFrame:
    """The exact test without small squares: both sides are dealt into squares as wide as the radius, the sites into the nine around their own."""
    r, sign = F.lit(float(radius)), 1 if probe_moves else -1
    square = lambda c: F.floor(c / r).cast("bigint")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = probe.withColumn("bx", square(F.col("x") + sign * F.col("dx"))).withColumn("by", square(F.col("y") + sign * F.col("dy")))
    right = sites.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("x").alias("sx"), F.col("y").alias("sy"), F.explode(around).alias("o"))
    right = right.select("*", (square(F.col("sx")) + F.col("o.i")).alias("sbx"), (square(F.col("sy")) + F.col("o.j")).alias("sby")).drop("o")
    return beside(left, right, radius, ["bx", "by", *keys], ["sbx", "sby", *[f"s_{k}" for k in keys]], probe_moves).drop("bx", "by")


def standing(spark) -> DataFrame:
    """The displacement by nothing."""
    return shift_table(spark, [(0.0, "none", 0.0, 0.0)])


def domains(anchors: DataFrame, actives: Sites, names: list[str], shifts: DataFrame | None = None) -> DataFrame:
    """Rows of ``anchors`` (sample, x, y, ...) for each feature (and displacement) whose active points come within the radius."""
    shifts = standing(anchors.sparkSession) if shifts is None else shifts
    probe = for_each(anchors, names).crossJoin(F.broadcast(shifts))  # as many rows as displacements asked for
    return near(probe, actives, False)


def for_each(anchors: DataFrame, names: list[str]) -> DataFrame:
    return anchors.select("*", F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))


def shift_coverage(points: PointSet, actives: DataFrame, shifts: DataFrame, radius: float, places: DataFrame | None = None) -> DataFrame:
    """``sample, feature, step, direction, n_active, n_covered, coverage``: displaced active points with an anchor near.
    ``places``: those of the anchors, if they are known."""
    keys = ["sample", "feature", "step", "direction"]
    held = at_places(actives, ["sample", "feature"]) if "n" not in actives.columns else actives
    places = at_places(points.cells, ["sample"]) if places is None else places
    covered = near_counts(held, Sites(places, radius, ["sample"]), ["sample", "feature"], shifts, True).withColumnRenamed("n", "n_covered")
    total = held.groupBy("sample", "feature").agg(F.sum("n").alias("n_active")).crossJoin(F.broadcast(shifts)).select(*keys, "n_active")
    out = total.join(covered, keys, "left").na.fill(0, ["n_covered"])
    return out.withColumn("coverage", F.expr("try_divide(CAST(n_covered AS DOUBLE), CAST(n_active AS DOUBLE))"))


def radius_stats(points: PointSet, actives: DataFrame, target: str, names: list[str], shifts: DataFrame, radius: float, min_coverage: float = 0.0, digits: int | None = 4) -> DataFrame:
    """Per sample, feature and displacement: the Jaccard index of the domains over all anchors, its change, and coverage.
    Displacements below ``min_coverage`` have NULL and counts 0; no active point (NULL coverage) passes."""
    keys = ["sample", "feature", "step", "direction"]
    places, held = at_places(points.cells, ["sample"]), at_places(actives, ["sample", "feature"])
    sites = Sites(held, radius, ["sample", "feature"])
    target_domain = domains(places, sites, [target]).select("sample", "x", "y", F.lit(1).alias("t"))
    anchors = once(places.join(target_domain.hint("merge"), ["sample", "x", "y"], "left").na.fill(0, ["t"]), "anchors")
    wanted = held.where(F.col("feature").isin(names))
    still = domains(anchors, sites, names).groupBy("sample", "feature").agg(F.sum("n").alias("of"), F.sum(F.expr("n * t")).alias("oi"))
    met = near_counts(for_each(anchors, names), sites, ["sample", "feature", "t"], shifts, False)
    met = met.groupBy(*keys).agg(F.sum("n").alias("nb"), F.sum(F.expr("n * t")).alias("i"))
    per_sample = anchors.groupBy("sample").agg(F.sum("n").alias("cnt_all"), F.sum(F.expr("n * t")).alias("ot"))
    listed = F.explode(F.array(*[F.lit(n) for n in names])).alias("feature")
    rows = per_sample.select("*", listed).crossJoin(F.broadcast(shifts)).join(still, ["sample", "feature"], "left").join(met, keys, "left")
    rows = rows.join(shift_coverage(points, wanted, shifts, radius, places).select(*keys, "n_active", "coverage"), keys, "left").na.fill(0, ["of", "oi", "nb", "i", "n_active"])
    rows = rows.withColumn("ok", F.coalesce(F.col("coverage") >= min_coverage, F.lit(True)))
    for c in ("nb", "i"):
        rows = rows.withColumn(c, F.when(F.col("ok"), F.col(c)).otherwise(0))
    pct = F.when(F.col("ok"), rounded_ratio("i", "(ot + nb - i)", digits))
    rows = rows.withColumns({"pct_p": pct, "pct_op": rounded_ratio("oi", "(ot + `of` - oi)", digits)})
    return rows.select(
        *keys, "dx", "dy", "pct_p", "pct_op", (F.col("pct_p") - F.col("pct_op")).alias("diff_pct"), F.col("i").alias("cnt_p"), F.col("ot").alias("cnt_p1"),
        F.col("nb").alias("cnt_p2"), "cnt_all", F.col("coverage").alias("coverage_fraction"), "n_active",
    )


def radius_vectors(
    points: PointSet, target: str, features, steps=None, radius: float = 15.0, direction_mode: str = "sphere", min_coverage: float = 0.0, quantiles=None, cutoffs=None, niches=None, digits: int | None = 4,
) -> DataFrame:
    """As ``grid_vectors``, over radius domains: with ``n_anchors`` for bins and the least and mean coverage of directions."""
    check_radius(radius, min_coverage)
    if direction_mode not in ("sphere", "euclidean"):
        raise ValueError("direction_mode is sphere or euclidean")
    by_niche, names, steps = niche_map(niches), names_of(features), radius_steps(steps)
    plain = [n for n in names_of([target, *names]) if n not in by_niche]
    known = set(by_niche) | (set(points.known(plain)) if plain else set())
    if target not in known:
        raise KeyError(f"unknown target {target!r}")
    used, spark = [n for n in names if n in known], points.cells.sparkSession
    actives, cut = active_points(points, list(dict.fromkeys([target, *used])), quantiles, cutoffs, by_niche)
    shifts = shift_table(spark, shift_rows(steps, direction_mode == "euclidean"))
    stats = radius_stats(points, actives, target, used or [target], shifts, radius, min_coverage, digits)
    stats = stats if used else stats.limit(0)
    n_target = actives.where(F.col("feature") == target).groupBy("sample").agg(F.count("*").alias("nt"))
    rows = stats.groupBy("sample", "feature", "step").agg(
        F.min("diff_pct").alias("min_djaccard"), F.max("diff_pct").alias("max_djaccard"), F.first("cnt_all").alias("n_anchors"), F.first("n_active").alias("nf"),
        F.min("coverage_fraction").alias("min_direction_coverage"), F.avg("coverage_fraction").alias("mean_direction_coverage"),
    ).join(n_target, "sample", "left").na.fill(0, ["nt"])
    blank = F.lit(None).cast("double")
    if cut is not None:
        rows = rows.join(cut.withColumnRenamed("cutoff", "cutoff_feature"), ["sample", "feature"], "left")
        rows = rows.join(cut.where(F.col("feature") == target).select("sample", F.col("cutoff").alias("cutoff_target")), "sample", "left")
    else:
        rows = rows.withColumns({"cutoff_feature": blank, "cutoff_target": blank})
    share = lambda c: F.expr(f"try_divide(CAST({c} AS DOUBLE), CAST(n_anchors AS DOUBLE))")
    source = lambda n: "niche" if n in by_niche else "positive"
    by_feature = F.when(F.col("feature").isin(list(by_niche)), "niche").otherwise("positive") if by_niche else F.lit("positive")
    out = rows.select(
        "min_djaccard", "max_djaccard", "feature", "step", "sample", "cutoff_target", "cutoff_feature", "n_anchors", F.col("nt").alias("n_positive_target"), F.col("nf").alias("n_positive_feature"),
        share("nt").alias("positive_fraction_target"), share("nf").alias("positive_fraction_feature"), F.col("nt").alias("n_binary_target"), F.col("nf").alias("n_binary_feature"),
        share("nt").alias("binary_fraction_target"), share("nf").alias("binary_fraction_feature"), F.lit(source(target)).alias("binary_source_target"),
        by_feature.alias("binary_source_feature"), "min_direction_coverage", "mean_direction_coverage", F.lit("kdtree").alias("backend"),
    )
    for n in (n for n in names if n not in known):
        rows = points.cells.select("sample").distinct().crossJoin(spark.createDataFrame([(s,) for s in steps], "step double"))
        given = {"feature": F.lit(n), "sample": F.col("sample"), "step": F.col("step"), "binary_source_target": F.lit(source(target)), "binary_source_feature": F.lit("positive"), "backend": F.lit("kdtree")}
        out = out.unionByName(rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in out.schema]))
    return out


def domain_map(points: PointSet, target: str, feature: str, radius: float = 15.0, shift=(0.0, 0.0), quantiles=None, cutoffs=None, niches=None) -> DataFrame:
    """Anchors with ``target_positive, feature_positive, target_domain, feature_domain`` (the feature displaced by ``shift``)."""
    check_radius(radius)
    names = names_of([target, feature])
    actives, _ = active_points(points, names, quantiles, cutoffs, niches)
    places, sites = points.cells.select("obs_idx", "sample", "x", "y"), Sites(at_places(actives, ["sample", "feature"]), radius, ["sample", "feature"])
    moved = shift_table(places.sparkSession, [(0.0, "shift", float(shift[0]), float(shift[1]))])
    marks = {
        "target_positive": actives.where(F.col("feature") == target).select("obs_idx"), "feature_positive": actives.where(F.col("feature") == feature).select("obs_idx"),
        "target_domain": domains(places, sites, [target]).select("obs_idx"), "feature_domain": domains(places, sites, [feature], moved).select("obs_idx"),
    }
    out = places
    for name, rows in marks.items():
        out = out.join(rows.withColumn(name, F.lit(True)), "obs_idx", "left").na.fill(False, [name])
    return out


def pairwise_radius_scores(points: PointSet, names, step: float, radius: float = 15.0, direction_mode: str = "sphere", min_coverage: float = 0.0, quantiles=None, cutoffs=None, niches=None, digits: int | None = 4) -> DataFrame:
    """``sample, target, feature, projected_score`` of all ordered pairs over radius domains, each displaced domain found once."""
    names = names_of(names)
    spark = points.cells.sparkSession
    shifts = shift_table(spark, shift_rows([step], direction_mode == "euclidean"))
    actives, _ = active_points(points, names, quantiles, cutoffs, niches)
    at = ["sample", "x", "y"]
    places, held = at_places(points.cells, ["sample"]), at_places(actives, ["sample", "feature"])
    sites = Sites(held, radius, ["sample", "feature"])
    own = domains(places, sites, names).groupBy(*at).agg(F.array_sort(F.collect_list("feature")).alias("own"))  # as many as named features
    anchors = once(places.join(own.hint("merge"), at, "left"), "anchors")
    inside = once(anchors.where("own IS NOT NULL").groupBy("sample", "own").agg(F.sum("n").alias("n")), "domains")
    met = once(near_counts(for_each(anchors, names), sites, ["sample", "feature", "own"], shifts, False).drop("step"), "moved-domains")
    each = inside.select("sample", "own", "n", F.explode("own").alias("feature"))
    b0 = each.groupBy("sample", "feature").agg(F.sum("n").alias("b0"))
    a0 = b0.select("sample", F.col("feature").alias("target"), F.col("b0").alias("a0"))
    i0 = each.select("sample", "feature", "n", F.explode("own").alias("target")).groupBy("sample", "target", "feature").agg(F.sum("n").alias("i0"))
    b1 = met.groupBy("sample", "feature", "direction").agg(F.sum("n").alias("b1"))
    i1 = met.select("sample", "feature", "direction", "n", F.explode("own").alias("target")).groupBy("sample", "target", "feature", "direction").agg(F.sum("n").alias("i1"))
    cover = shift_coverage(points, held, shifts, radius, places).select("sample", "feature", "direction", "coverage")
    pairs = spark.createDataFrame([(t, f) for t in names for f in names if t != f], "target string, feature string")
    rows = places.select("sample").distinct().crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(shifts.select("direction")))
    for other, keys in ((a0, ["sample", "target"]), (b0, ["sample", "feature"]), (i0, ["sample", "target", "feature"]), (b1, ["sample", "feature", "direction"]), (i1, ["sample", "target", "feature", "direction"]), (cover, ["sample", "feature", "direction"])):
        rows = rows.join(other, keys, "left")
    rows = rows.na.fill(0, ["a0", "b0", "i0", "b1", "i1"])
    ok = F.coalesce(F.col("coverage") >= min_coverage, F.lit(True))
    diff = F.when(ok, rounded_ratio("i1", "(a0 + b1 - i1)", digits)) - rounded_ratio("i0", "(a0 + b0 - i0)", digits)
    by = rows.withColumn("d", diff).groupBy("sample", "target", "feature").agg(F.min("d").alias("mn"), F.max("d").alias("mx"))
    return by.select("sample", "target", "feature", ((F.col("mn") + F.col("mx")) / 2).alias("projected_score"))
