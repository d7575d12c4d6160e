"""Connected components of an edge table, as alternating star contractions over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc.plans.scratch import Scratch


def connected_components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """Nodes of ``edges(u, v)`` with the smallest node that each can reach: ``(node, root)``.

    Each round, every node points its larger neighbours, then its smaller ones, at its least neighbour (large-star and
    small-star contraction), so path lengths shrink geometrically. The least neighbour is a partial aggregate, and the
    join beside it may be split by adaptive execution, so a hub holds no single task. Every round is a written table.
    Self-loops and NULL ends are ignored; an empty edge table gives no rows.
    """
    with Scratch(edges.sparkSession, name) as scratch:
        return _contracted(edges, scratch, max_rounds)


def _contracted(edges: DataFrame, scratch: Scratch, max_rounds: int) -> DataFrame:
    both = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    table = scratch.save(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "r0")
    before = None
    for i in range(1, max_rounds + 1):
        sym = table.select("u", "v").union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        table = scratch.save(small, f"r{i}")
        state = table.agg(
            F.count("*").alias("n"),
            F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0)).alias("x"),
            F.coalesce(F.expr("try_sum(cast(pmod(xxhash64(v, u), 1000003) AS BIGINT))"), F.lit(0)).alias("s"),
        ).first()
        scratch.drop(f"r{i - 1}")
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return table.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        table.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
