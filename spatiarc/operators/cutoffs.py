"""Cutoffs for a whole cohort of samples, from points or grid cells."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.functions.expressions import names_of, ratio
from spatiarc.functions.quantiles import group_quantiles
from spatiarc.operators.raster import explicit_cutoffs, grid_values
from spatiarc.plans.lookup import Lookup, bounded
from spatiarc.plans.scratch import once
from spatiarc.sources.points import PointSet

#: Methods and their longer names.
METHODS = {
    "median_of_sample_medians": ("median_of_sample_level_median_scores", "median_of_sample_level_medians", "median_of_sample_median"),
    "mean_of_sample_means": ("mean_of_sample_level_mean_scores", "mean_of_sample_level_means", "mean_of_sample_mean"),
    "balanced_global_median": (),
    "balanced_global_mean": (),
}
PRIME, BUCKETS = 2147483647, 64
#: Draws (of samples, features and repeats) that a task counts in arrays at most, and hashes that it holds at once.
DRAWS, HASHES = 20_000, 200_000


def cutoff_level(level: str) -> str:
    plain = str(level).lower().replace("-", "_").removesuffix("_level").removesuffix("s")
    if plain not in ("cell", "grid"):
        raise ValueError("level is cell or grid")
    return plain


def cutoff_method(method: str) -> str:
    plain = str(method).lower().replace("-", "_")
    for name, others in METHODS.items():
        if plain == name or plain in others:
            return name
    raise ValueError(f"method is one of {sorted(METHODS)}")


def draw_size(least: int, round_to: int = 1000, exact: int | None = None) -> int:
    """Units that a balanced draw takes of each sample: the least sample, rounded down to a multiple if that leaves any."""
    if exact is not None:
        if not 0 < exact <= least:
            raise ValueError(f"balance_n must lie in 1..{least}")
        return int(exact)
    return least // round_to * round_to or least if round_to > 0 else least


@dataclass(frozen=True)
class Cutoffs:
    """``cutoffs`` (feature, cutoff), ``sample_stats`` (feature, sample, level, n_units, sample_mean, sample_median; made when
    asked for) and ``replicates`` (feature, repeat, cutoff, n_per_sample, n_samples, level; None unless balanced)."""

    cutoffs: DataFrame
    stats: Callable[[], DataFrame]
    replicates: DataFrame | None
    level: str
    method: str

    @cached_property
    def sample_stats(self) -> DataFrame:
        return self.stats()


def units(points: PointSet, features, level: str, grid_size=20.0, agg="mean", min_cells=1) -> DataFrame:
    """``feature, sample, key, value`` of units with a value; the key names a unit in its sample."""
    if cutoff_level(level) == "cell":
        rows = points.values(features).select("feature", "sample", F.col("obs_idx").cast("string").alias("key"), "value")
    else:
        rows = once(grid_values(points, features, grid_size, agg, min_cells), "grid-units").select("feature", "sample", F.concat_ws("|", "gx", "gy").alias("key"), "value")
    return rows.where("value IS NOT NULL")


def numbered(rows: DataFrame, seed: int) -> DataFrame:
    """``rows`` with the two numbers ``a, b`` that a unit's name gives."""
    name = F.md5(F.concat_ws("|", F.lit(str(seed)), "feature", "sample", "key"))
    number = lambda at: F.conv(F.substring(name, at, 8), 16, 10).cast("bigint") % PRIME
    return rows.select("feature", "sample", "key", "value", number(1).alias("a"), number(9).alias("b"))


def balanced_draws(rows: DataFrame, sizes: DataFrame, n_repeats: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Draws of ``n_draw`` units of each (feature, sample), ``n_repeats`` times: those first in order of a hash, then of their key.

    ``rows`` are (feature, sample, key, value), ``sizes`` (feature, sample, n_units, n_draw). A unit's name gives two numbers a, b
    below ``PRIME`` once; its hash in a repeat is (a * c + b) mod ``PRIME`` with the repeat's own c, so draws are uniform and
    those of two repeats independent. Units are counted into buckets of the hash, narrow ones about the wanted share: those of the
    buckets below the one where the draw ends are all drawn, and only that bucket, a few units, is put in order. Nothing ranks a sample.
    Returns (drawn rows of whole buckets: feature, repeat, value; drawn rows of the last buckets, the same).
    """
    keys = ["feature", "sample"]
    share = F.col("n_draw") / F.col("n_units")
    room = 6 * F.sqrt(share / F.col("n_units")) + 20 / F.col("n_units")
    edges = sizes.select(*keys, "n_draw", (share - room).alias("lo"), (2 * room / (BUCKETS - 2)).alias("wide"))
    units = numbered(rows, seed)
    h = (F.col("a") * F.col("repeat") * F.lit(48271) % PRIME + F.col("b")) % PRIME
    bucket = F.greatest(F.lit(-1), F.least(F.lit(BUCKETS), F.floor((F.col("h") / PRIME - F.col("lo")) / F.col("wide")))).cast("int")

    def hashed(repeats):
        return lambda df: df.withColumn("repeat", repeats).withColumn("h", h).withColumn("bucket", bucket)

    every = Lookup(edges, keys).join(units).transform(hashed(F.explode(F.sequence(F.lit(1), F.lit(n_repeats)))))
    counts = every.groupBy(*keys, "repeat", "bucket").agg(F.count("*").alias("m"), F.first("n_draw").alias("n_draw"))
    upto = F.sum("m").over(Window.partitionBy(*keys, "repeat").orderBy("bucket"))  # as many rows as buckets
    ends = counts.withColumn("upto", upto).where("upto >= n_draw").groupBy(*keys, "repeat").agg(F.min(F.struct("bucket", (F.col("n_draw") - F.col("upto") + F.col("m")).alias("left"))).alias("e"))
    last = ends.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("repeat", "e.bucket", "e.left"))).alias("last"))
    table = Lookup(edges.join(last, keys), keys)
    again = table.join(units).transform(hashed(F.explode(F.sequence(F.lit(1), F.lit(n_repeats))))).withColumn("end", F.element_at("last", F.col("repeat")))
    whole = again.where("bucket < end.bucket").select("feature", "repeat", "value")
    order = Window.partitionBy(*keys, "repeat").orderBy("h", "key")
    cut = again.where("bucket = end.bucket").withColumn("place", F.row_number().over(order)).where("place <= end.left")
    return whole, cut.select("feature", "repeat", "value")


def balanced_means(rows: DataFrame, sizes: DataFrame, n_repeats: int, seed: int) -> DataFrame:
    """``feature, repeat, cutoff``: the means of ``balanced_draws``, whose draws these are.

    Tasks hash whole arrays of units and repeats and keep a count and a sum of each bucket, so no unit becomes a row for each repeat;
    only those of the bucket where a draw ends do, to be put in order. More than ``DRAWS`` draws go by rows instead.
    """
    keys, spark = ["feature", "sample"], rows.sparkSession
    small = bounded(sizes.select(*keys, "n_units", "n_draw"), DRAWS // n_repeats)
    if small is None:
        whole, cut = balanced_draws(rows, sizes, n_repeats, seed)
        return whole.unionByName(cut).groupBy("feature", "repeat").agg(F.avg("value").alias("cutoff"))
    groups = [r for r in small.collect() if r.sample is not None]  # counted
    if not groups:
        return spark.createDataFrame([], "feature string, repeat int, cutoff double")
    n, drawn = (np.array([r[c] for r in groups], float) for c in ("n_units", "n_draw"))
    room = 6 * np.sqrt(drawn / n / n) + 20 / n
    lo, wide, times = drawn / n - room, 2 * room / (BUCKETS - 2), np.arange(1, n_repeats + 1, dtype=np.int64) * 48271 % PRIME
    table = spark.createDataFrame([(r.feature, r.sample, i, r.n_draw) for i, r in enumerate(groups)], "feature string, sample string, g int, n_draw bigint")
    units = numbered(rows, seed).join(F.broadcast(table), keys).select("g", "a", "b", "value", "key")

    def buckets(batch: pa.RecordBatch):
        """Parts of a batch: where it begins, and the group of each unit, and its hash and bucket in each repeat."""
        g, a, b = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3))
        size = max(1, HASHES // n_repeats)
        for at in range(0, len(g), size):
            i = g[at : at + size]
            h = a[at : at + size, None] * times % PRIME + b[at : at + size, None]
            h -= PRIME * (h >= PRIME)
            yield at, i, h, np.clip(np.floor((h / PRIME - lo[i, None]) / wide[i, None]), -1, BUCKETS).astype(np.int64)

    def counted(batches):
        shape = (len(groups), n_repeats, BUCKETS + 2)
        m, s = np.zeros(shape, np.int64), np.zeros(shape)
        for batch in batches:
            value = batch.column(3).to_numpy(zero_copy_only=False)
            for at, i, _, k in buckets(batch):
                where = ((i[:, None] * n_repeats + np.arange(n_repeats)) * (BUCKETS + 2) + k + 1).ravel()
                m += np.bincount(where, minlength=m.size).reshape(shape)
                s += np.bincount(where, np.repeat(value[at : at + len(i)], n_repeats), minlength=m.size).reshape(shape)
        g, r, k = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g.astype(np.int32), (r + 1).astype(np.int32), (k - 1).astype(np.int32), m[g, r, k], s[g, r, k])], ["g", "repeat", "bucket", "m", "s"])

    by = Window.partitionBy("g", "repeat").orderBy("bucket")  # as many rows as buckets
    counts = units.select("g", "a", "b", "value").mapInArrow(counted, "g int, repeat int, bucket int, m bigint, s double")
    counts = counts.groupBy("g", "repeat", "bucket").agg(F.sum("m").alias("m"), F.sum("s").alias("s")).join(F.broadcast(table.select("g", "n_draw", "feature")), "g")
    upto = counts.withColumns({"upto": F.sum("m").over(by), "below": F.coalesce(F.sum("s").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))})
    ends = upto.where("upto >= n_draw").groupBy("g", "repeat", "feature").agg(F.min(F.struct("bucket", (F.col("n_draw") - F.col("upto") + F.col("m")).alias("left"), "below", "n_draw")).alias("e"))
    ends = bounded(ends.select("g", "repeat", "feature", "e.*"), DRAWS)
    end = np.full((len(groups), n_repeats), BUCKETS + 1)
    for r in ends.select("g", "repeat", "bucket").collect():  # counted
        end[r.g, r["repeat"] - 1] = r.bucket

    def last(batches):
        for batch in batches:
            for at, i, h, k in buckets(batch):
                u, r = np.nonzero(k == end[i])
                taken = batch.take(pa.array(u + at))
                yield pa.RecordBatch.from_arrays([pa.array(i[u].astype(np.int32)), pa.array((r + 1).astype(np.int32)), pa.array(h[u, r]), taken.column(3), taken.column(4)], ["g", "repeat", "h", "value", "key"])

    order = Window.partitionBy("g", "repeat").orderBy("h", "key")
    cut = units.mapInArrow(last, "g int, repeat int, h bigint, value double, key string").withColumn("place", F.row_number().over(order))
    cut = cut.join(F.broadcast(ends), ["g", "repeat"]).where(F.col("place") <= F.col("left")).select("feature", "repeat", F.col("value").alias("s"), F.lit(1).cast("bigint").alias("m"))
    parts = ends.select("feature", "repeat", F.col("below").alias("s"), (F.col("n_draw") - F.col("left")).alias("m")).unionByName(cut)
    return parts.groupBy("feature", "repeat").agg((F.sum("s") / F.sum("m")).alias("cutoff"))


def cohort_cutoffs(
    points: PointSet, features, samples=None, level: str = "grid", method: str = "balanced_global_mean", grid_size: float = 20.0, agg: str = "mean", min_cells: int = 1,
    n_repeats: int = 100, round_to: int = 1000, balance_n: int | None = None, seed: int = 666, check: bool = True,
) -> Cutoffs:
    """One cutoff per feature for all samples. Balanced methods draw equally many units of each sample without replacement,
    ``n_repeats`` times (``balanced_draws``), the same ones in every run."""
    level, method, names, keys = cutoff_level(level), cutoff_method(method), names_of(features), ["feature", "sample"]
    chosen = points.where(samples)
    rows = units(chosen, names, level, grid_size, agg, min_cells)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n_units"), F.avg("value").alias("sample_mean"))

    def stats() -> DataFrame:
        medians = group_quantiles(rows, keys, 0.5, "sample_median")
        return sizes.join(medians, keys, "left").select("feature", "sample", F.lit(level).alias("level"), "n_units", "sample_mean", "sample_median")

    if check:
        there, all_samples = sizes.groupBy("feature").agg(F.count("*").alias("n")), chosen.samples().count()
        if (n := {r.feature: r.n for r in there.collect()}) != dict.fromkeys(names, all_samples):  # one row for each feature that was asked for
            raise ValueError(f"samples without units, by feature (of {all_samples} samples): {n}")
    if method == "median_of_sample_medians":
        medians = group_quantiles(rows, keys, 0.5, "value")
        return Cutoffs(group_quantiles(medians, ["feature"], 0.5, "cutoff"), stats, None, level, method)
    if method == "mean_of_sample_means":
        return Cutoffs(sizes.groupBy("feature").agg(F.avg("sample_mean").alias("cutoff")), stats, None, level, method)
    if n_repeats < 1:
        raise ValueError("n_repeats must be positive")
    counted = Lookup(sizes.select(*keys, "n_units"), keys).table
    least = counted.groupBy("feature").agg(F.min("n_units").alias("least"), F.count("*").alias("n_samples")).collect()  # as many as named features
    facts = [(r.feature, draw_size(r.least, round_to, balance_n), r.n_samples) for r in least]
    facts = F.broadcast(points.cells.sparkSession.createDataFrame(facts, "feature string, n_draw bigint, n_samples bigint"))
    wanted, by = counted.join(facts, "feature"), ["feature", "repeat"]
    if method.endswith("mean"):
        reps = balanced_means(rows, wanted, n_repeats, seed)
    else:
        whole, cut = balanced_draws(rows, wanted, n_repeats, seed)
        reps = group_quantiles(whole.unionByName(cut), by, 0.5, "cutoff")
    reps = reps.join(facts, "feature").select(*by, "cutoff", F.col("n_draw").alias("n_per_sample"), "n_samples", F.lit(level).alias("level"))
    outer = reps.groupBy("feature").agg(F.avg("cutoff").alias("cutoff")) if method.endswith("mean") else group_quantiles(reps, ["feature"], 0.5, "cutoff", "cutoff")
    return Cutoffs(outer, stats, reps, level, method)


def merged_cutoffs(points: PointSet, features, explicit=None, **how) -> DataFrame:
    """(feature, cutoff): explicit ones, and for the other features those that ``cohort_cutoffs(**how)`` gives."""
    names, given = names_of(features), explicit_cutoffs(explicit)
    rest = [n for n in names if n not in given]
    spark = points.cells.sparkSession
    table = spark.createDataFrame([(n, given[n]) for n in names if n in given], "feature string, cutoff double")
    return table.unionByName(cohort_cutoffs(points, rest, **how).cutoffs) if rest else table


def positive_proportions(points: PointSet, cutoffs, features=None, level: str = "cell", samples=None, grid_size=20.0, agg="mean", min_cells=1) -> DataFrame:
    """``sample, feature, level, cutoff, n_units, n_positive, positive_fraction``; a feature without a cutoff raises."""
    given = explicit_cutoffs(cutoffs.cutoffs if isinstance(cutoffs, Cutoffs) else cutoffs)
    names = names_of(features or list(given))
    if missing := [n for n in names if n not in given]:
        raise KeyError(f"no cutoff for {missing}")
    chosen = points.where(samples)
    rows = units(chosen, names, level, grid_size, agg, min_cells)
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.lit(given[n]).alias("cutoff")) for n in names])).alias("c")
    frame = chosen.cells.select("sample").distinct().select("sample", pairs).select("sample", "c.feature", "c.cutoff")
    cut = points.cells.sparkSession.createDataFrame([(n, given[n]) for n in names], "feature string, c double")
    by = rows.join(F.broadcast(cut), "feature").groupBy("sample", "feature")  # as many rows as named features
    by = by.agg(F.count("*").alias("n_units"), F.count_if(F.col("value") > F.col("c")).alias("n_positive"))
    out = frame.join(by, ["sample", "feature"], "left").na.fill(0, ["n_units", "n_positive"])  # a sample without units has none and no fraction
    return out.select("sample", "feature", F.lit(cutoff_level(level)).alias("level"), "cutoff", "n_units", "n_positive", ratio("n_positive", "n_units").alias("positive_fraction"))
