"""Signature scores: the mean of a gene set less the mean of control genes of like expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.functions.expressions import finite
from spatiarc.plans.lookup import Lookup, bounded
from spatiarc.sources.points import PointSet, write_back


def gene_bins(points: PointSet, nbin: int = 10) -> DataFrame:
    """``gene, var_idx, mean, bin``: genes in order of their mean over all cells (zeros included), in ``nbin`` even bins."""
    n = points.cells.count()
    sums = points.expr.where(F.col("layer") == points.layer).groupBy("gene").agg(F.sum(finite(F.col("value"))).alias("s"))
    means = points.genes.join(sums, "gene", "left").select("gene", "var_idx", (F.coalesce("s", F.lit(0.0)) / max(n, 1)).alias("mean"))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("mean", "var_idx")) - 1  # genes, not cells
    count = F.count("*").over(Window.partitionBy(F.lit(1)))
    return means.select("gene", "var_idx", "mean", F.least(F.floor(rank * nbin / count), F.lit(nbin - 1)).cast("int").alias("bin"))


def control_genes(points: PointSet, sets: DataFrame, nbin: int = 10, ctrl: int = 100, seed: int = 666) -> DataFrame:
    """``set_name, gene`` of controls: for each gene of a set, up to ``ctrl`` genes of its bin that are not in the set, those
    first in order of a hash of (seed, set, gene, control). The hash makes sets independent of one another's order."""
    bins = gene_bins(points, nbin)
    members = sets.join(bins.select("gene", "bin"), "gene").select("set_name", F.col("gene").alias("of"), "bin", F.row_number().over(Window.partitionBy("set_name", "gene").orderBy("gene")).alias("nth"))
    pool = members.join(bins.select(F.col("gene").alias("gene"), "bin"), "bin")
    pool = pool.join(sets.select("set_name", "gene").distinct(), ["set_name", "gene"], "left_anti")
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), "set_name", "of", "nth", "gene"))
    picked = pool.withColumn("k", F.row_number().over(Window.partitionBy("set_name", "of", "nth").orderBy(order, "gene"))).where(F.col("k") <= ctrl)
    return picked.select("set_name", "gene").distinct()


def module_scores(points: PointSet, sets: DataFrame, nbin: int = 10, ctrl: int = 100, seed: int = 666) -> DataFrame:
    """``obs_idx, set_name, score`` for every cell and set of ``sets`` (set_name, gene; a gene listed twice counts twice).
    Sets without a known gene, or without any control, have NULL."""
    present = sets.join(points.genes.select("gene"), "gene")
    weights = present.groupBy("set_name", "gene").agg(F.count("*").cast("double").alias("m"))
    chosen = weights.join(control_genes(points, sets, nbin, ctrl, seed).withColumn("c", F.lit(1.0)), ["set_name", "gene"], "full").na.fill(0.0, ["m", "c"])
    chosen = Lookup(chosen, ["set_name", "gene"]).table  # found once; several readers follow
    sizes = chosen.groupBy("set_name").agg(F.sum("m").alias("nm"), F.sum("c").alias("nc"))
    values = points.expr.where(F.col("layer") == points.layer).select("obs_idx", "gene", finite(F.col("value")).alias("v"))
    names = sets.select("set_name").distinct().join(sizes, "set_name", "left")
    shares = F.struct("set_name", F.expr("try_divide(m, nm)").alias("m"), F.expr("try_divide(c, nc)").alias("c"))
    by_gene = chosen.join(sizes, "set_name").groupBy("gene").agg(F.collect_list(shares).alias("of"))  # as many rows as genes
    each = Lookup(by_gene, ["gene"]).join(values).select("obs_idx", "v", F.explode("of").alias("s"))
    blank = points.cells.select("obs_idx").crossJoin(F.broadcast(table) if (table := bounded(names)) is not None else names)
    blank = blank.select("obs_idx", "set_name", F.when((F.col("nm") > 0) & (F.col("nc") > 0), F.lit(0.0)).alias("score"), F.lit(True).alias("own"))
    sums = each.select("obs_idx", "s.set_name", (F.col("v") * (F.coalesce("s.m", F.lit(0.0)) - F.coalesce("s.c", F.lit(0.0)))).alias("score"), F.lit(False).alias("own"))
    # one aggregation by cell and set, partial beside the scan: cells and their values meet without a join
    by = blank.unionByName(sums).groupBy("obs_idx", "set_name").agg(F.max("own").alias("own"), F.count_if(F.col("own") & F.col("score").isNull()).alias("none"), F.sum("score").alias("score"))
    return by.where("own").select("obs_idx", "set_name", F.when(F.col("none") == 0, F.col("score")).alias("score"))


def add_module_scores(points: PointSet, sets: dict[str, list[str]], **how) -> DataFrame:
    """The cells with a column per set."""
    spark = points.cells.sparkSession
    table = spark.createDataFrame([(s, g) for s, genes in sets.items() for g in genes], "set_name string, gene string")
    wide = module_scores(points, table, **how).groupBy("obs_idx").agg(*[F.max(F.when(F.col("set_name") == s, F.col("score"))).alias(f"__s{i}") for i, s in enumerate(sets)])
    return write_back(points.cells, wide, {s: F.col(f"__s{i}") for i, s in enumerate(sets)})
