"""Rank tests, a proportion test and a density curve."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normal_sf(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def exact_mann_whitney(u: float, m: int, n: int) -> float:
    """Two-sided exact p without ties, by counting arrangements of each U."""
    if m > n:
        m, n = n, m
    counts = {0: [1.0]}
    for i in range(1, m + 1):  # generating function: product of (1 - q**(n + i)) / (1 - q**i)
        poly = counts[i - 1] + [0.0] * n
        for k in range(len(poly) - 1, n + i - 1, -1):
            poly[k] -= poly[k - n - i]
        for k in range(i, len(poly)):
            poly[k] += poly[k - i]
        counts[i] = poly
    total = counts[m]
    high = max(u, m * n - u)
    return min(1.0, 2 * sum(total[math.ceil(high) :]) / math.comb(m + n, m))


def mann_whitney(rows: DataFrame, by: str) -> DataFrame:
    """``by, group_1, group_0, n1, n0, statistic, pvalue`` of (by, value, grp): two-sided, average ranks. Groups of one or
    none give no row. Exact up to 8 in a group without ties, else normal with tie and continuity corrections."""
    known = rows.where("value IS NOT NULL AND NOT isnan(value) AND grp IN (0, 1)")
    tie = Window.partitionBy(by, "value")
    ranked = known.withColumn("t", F.count("*").over(tie)).withColumn("r", F.rank().over(Window.partitionBy(by).orderBy("value")) + (F.col("t") - 1) / 2.0)
    one = F.col("grp") == 1
    sums = ranked.groupBy(by).agg(
        F.avg(F.when(one, F.col("value"))).alias("group_1"), F.avg(F.when(~one, F.col("value"))).alias("group_0"), F.count_if(one).alias("n1"), F.count_if(~one).alias("n0"),
        F.sum(F.when(one, F.col("r")).otherwise(0.0)).alias("rs"), F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
    ).where("n1 > 1 AND n0 > 1")
    sums = sums.withColumn("statistic", F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0)

    @F.pandas_udf("double")
    def pvalue(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, m, n, t in zip(u, n1, n0, ties, strict=True):
            if min(m, n) <= 8 and t == 0:
                out.append(exact_mann_whitney(a, int(m), int(n)))
                continue
            total = m + n
            spread = math.sqrt(m * n / 12 * ((total + 1) - t / (total * (total - 1))))
            z = (max(a, m * n - a) - m * n / 2 - 0.5) / spread if spread else math.nan
            out.append(min(1.0, 2 * normal_sf(z)) if z == z else 1.0)
        return pd.Series(out)

    return sums.select(by, "group_1", "group_0", "n1", "n0", "statistic", pvalue("statistic", "n1", "n0", "ties").alias("pvalue"))


def wilcoxon(pairs: DataFrame, by: str) -> DataFrame:
    """``by, n_pairs, statistic, pvalue`` of (by, a, b): two-sided signed ranks of a - b, zeros dropped, average ranks. Exact
    up to 50 pairs without ties or zeros, else normal with tie correction."""
    complete = pairs.where("a IS NOT NULL AND b IS NOT NULL").withColumn("d", F.col("a") - F.col("b"))
    totals = complete.groupBy(by).agg(F.count("*").alias("n_pairs"))
    some = complete.where("d <> 0").withColumn("m", F.abs("d"))
    some = some.withColumn("t", F.count("*").over(Window.partitionBy(by, "m"))).withColumn("r", F.rank().over(Window.partitionBy(by).orderBy("m")) + (F.col("t") - 1) / 2.0)
    sums = some.groupBy(by).agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("down"),
        F.sum((F.col("t") * F.col("t") - 1).cast("double")).alias("ties"),
    )

    @F.pandas_udf("double")
    def pvalue(n: pd.Series, total: pd.Series, w: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for k, all_pairs, s, t in zip(n, total, w, ties, strict=True):
            k = int(k)
            if k <= 50 and t == 0 and k == all_pairs:
                ways = [1.0] + [0.0] * (k * (k + 1) // 2)
                for i in range(1, k + 1):
                    for j in range(len(ways) - 1, i - 1, -1):
                        ways[j] += ways[j - i]
                out.append(min(1.0, 2 * sum(ways[: int(s) + 1]) / 2**k))
                continue
            spread = math.sqrt(k * (k + 1) * (2 * k + 1) / 24 - t / 48)
            out.append(min(1.0, 2 * normal_sf(abs(s - k * (k + 1) / 4) / spread)) if spread else math.nan)
        return pd.Series(out)

    low = sums.withColumn("statistic", F.least("up", "down")).join(totals, by)
    found = low.select(by, "statistic", pvalue("n", "n_pairs", "statistic", "ties").alias("pvalue"))
    return totals.join(found, by, "left")


def proportion_test(successes: int, n: int, p0: float = 0.5, alternative: str = "less", continuity: bool = True) -> dict[str, float]:
    """Test of a proportion by the normal approximation: ``proportion, z, pvalue`` (NaN if n is not positive)."""
    if alternative not in ("less", "greater", "two-sided"):
        raise ValueError("alternative is less, greater or two-sided")
    if n <= 0:
        return dict.fromkeys(("proportion", "z", "pvalue"), math.nan)
    share, by = successes / n, 0.5 / n if continuity else 0.0
    spread = math.sqrt(p0 * (1 - p0) / n)
    if not spread:
        return {"proportion": share, "z": math.nan, "pvalue": math.nan}
    if alternative == "two-sided":
        z = max(abs(share - p0) - by, 0.0) / spread
        return {"proportion": share, "z": z, "pvalue": 2 * normal_sf(z)}
    z = (share - p0 + (by if alternative == "less" else -by)) / spread
    return {"proportion": share, "z": z, "pvalue": normal_sf(-z if alternative == "less" else z)}


def density(rows: DataFrame, value: str, points: int = 400) -> DataFrame:
    """Gaussian kernel density of a column on an even line over its range, padded by 12 % of it: ``x, density``. Bandwidth
    n ** (-1/5) times the sample deviation; fewer than two values, or equal ones, give no rows.

    Equal values are counted first. Each task lays the line over its values and keeps a partial sum for each point of the line,
    so what is shuffled is the line, not the values.
    """
    known = rows.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("v").agg(F.count("*").alias("c"))
    size, mean = F.sum("c"), F.sum(F.col("v") * F.col("c")) / F.sum("c")
    spread = F.sqrt(F.sum((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")) * F.col("c")) / (size - 1))
    about = known.crossJoin(F.broadcast(known.agg(mean.alias("m")))).agg(size.alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.when(size > 1, spread).alias("sd")).where("n > 1 AND sd > 0")
    about = about.withColumn("pad", F.greatest((F.col("hi") - F.col("lo")) * 0.12, F.lit(1e-6))).withColumn("h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    line = about.select("n", "h", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i"), (F.col("lo") - F.col("pad")).alias("a"), (F.col("hi") + F.col("pad")).alias("b"))
    line = line.select("n", "h", "i", (F.col("a") + F.col("i") * ((F.col("b") - F.col("a")) / (points - 1))).alias("x"))
    z = (F.col("x") - F.col("v")) / F.col("h")
    at = known.crossJoin(F.broadcast(line))  # as many rows as points of the line
    by = at.groupBy("i", "x", "n", "h").agg(F.sum(F.exp(-0.5 * z * z) * F.col("c")).alias("s"))
    return by.select("x", (F.col("s") / (F.col("n") * F.col("h") * math.sqrt(2 * math.pi))).alias("density"))
