"""Exact quantiles of groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.plans.lookup import Lookup

ACCURACY, ROOM = 10_000, 4


def group_quantiles(rows: DataFrame, keys: list[str], q: float, name: str, value: str = "value") -> DataFrame:
    """``keys`` and the ``q`` quantile (linear between ranks) of the values of each group that are not NULL, exactly.

    A sketch bounds the quantile first; only values between its bounds, a few in ten thousand, are counted by value and
    ranked, and what is below them is one count. So no task holds a group's values, however many there are.
    """
    known = rows.where(F.col(value).isNotNull())
    low, high = q - ROOM / ACCURACY, q + ROOM / ACCURACY
    sketch = F.percentile_approx(value, F.array(F.lit(max(low, 0.0)), F.lit(min(high, 1.0))), F.lit(ACCURACY))
    bounds = known.groupBy(*keys).agg(F.count(value).alias("__n"), F.min(value).alias("__min"), F.max(value).alias("__max"), sketch.alias("__b"))
    all_of = F.col("__n") <= ACCURACY  # a small group is counted whole
    bounds = bounds.select(
        *keys, "__n", F.when(all_of | F.lit(low <= 0), F.col("__min")).otherwise(F.col("__b")[0]).alias("__lo"), F.when(all_of | F.lit(high >= 1), F.col("__max")).otherwise(F.col("__b")[1]).alias("__hi")
    )
    near = Lookup(bounds, keys).join(known).where(F.col(value) <= F.col("__hi"))
    counted = near.select(*keys, "__n", F.when(F.col(value) >= F.col("__lo"), F.col(value)).alias("__v")).groupBy(*keys, "__n", "__v").agg(F.count("*").alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = F.lit(float(q)) * (F.col("__n") - 1)
    ranked = counted.withColumn("__upto", upto)
    at = lambda p: F.min(F.when(F.col("__upto") > p, F.col("__v")))
    by = ranked.groupBy(*keys, "__n").agg(at(F.floor(place)).alias("__a"), at(F.ceil(place)).alias("__z"))
    between = (F.ceil(place) - place) * F.col("__a") + (place - F.floor(place)) * F.col("__z")
    return by.select(*keys, F.when(F.ceil(place) == F.floor(place), F.col("__a")).otherwise(between).alias(name))
