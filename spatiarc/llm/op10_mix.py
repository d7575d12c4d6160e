"""Mixing sources to target weights by systematic sampling.

Every document of a source expects the same number of copies (target / source size). Expected copies are prefix-summed
along the documents of the source in order of size, one random offset is added, and a document is emitted once per
integer boundary that its interval crosses. Order by size makes the words taken follow the target closely.

The prefix sum is distributed: rows are dealt by range of (source, size, doc_id), ranked within their range, and the
counts of the ranges before are added, so neither a hot source nor many equal documents meet in one task.

Defined cases: a null text has size 0; a null source is a source (last in order); sources without words have target 0 and
nothing taken; repeated rows are documents of their own; extra columns are ignored by the plan and kept by ``mix``;
empty tables give empty results; very long texts are counted whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, table, text_slices, with_columns, word_count
from spatiarc.plans.scratch import Scratch

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2, "mix-1"


def word_sizes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``source``, ``size``, the words of the text, and ``h``, a hash that tells apart rows without ids."""

    def run(batches):
        for b, texts in text_slices(batches):
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            yield with_columns(b, ["doc_id", "source"], size=pa.array(list(map(word_count, texts)), pa.int64()), h=pa.array(hashes, pa.int64()))

    return docs.select("doc_id", "source", "text").mapInArrow(run, field_sql(docs, "doc_id", "source") + ", size bigint, h bigint")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Per source: its size, its number of documents, and its target.

    Weights go round the sources in code-point order, null last. Targets share ``share`` of all words by weight and stop
    at ``cap`` times the source's size; what is over is shared again by weight. That is one water level: sources in order
    of cap / weight stop at their caps as long as the level of the rest is no lower.
    """
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)) + 1)
    by = by.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * cap)
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    level = (
        F.lit(share) * F.sum("source_size").over(all_rows).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    by = by.withColumn("level", level).withColumn("full", F.col("cap") / F.col("w") <= F.col("level"))
    rest = F.min(F.when(~F.col("full"), F.struct(F.col("cap") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(all_rows)["level"]
    return by.select("source", "source_size", "n", F.when(F.col("full"), F.col("cap")).otherwise(rest * F.col("w")).alias("target"))


def offset_of(source, seed: str):
    """One offset in [0, 1) for each source, the same in every run."""
    head = F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(source, F.lit("")))), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: int = CAP, seed: str = SEED) -> DataFrame:
    """Per document: ``doc_id, source, size, h, source_size, target, copies, place`` (its place in its source)."""
    with Scratch(docs.sparkSession, "mix") as scratch:
        return _placed(docs, scratch, weights, share, cap, seed)


def _placed(docs: DataFrame, scratch: Scratch, weights, share: float, cap: int, seed: str) -> DataFrame:
    rows = scratch.save(word_sizes(docs), "sizes")
    keys = [F.col("source").asc_nulls_last(), "size", "doc_id", "h"]
    dealt = scratch.save(rows.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("source", "part").agg(F.count("*").alias("m"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("ahead"))
    targets = source_targets(rows, weights, share, cap).withColumnRenamed("source", "s")
    per_range = counts.join(targets, counts.s.eqNullSafe(targets.s)).select(counts.s, "p", "ahead", "source_size", "target", "n")
    ranked = dealt.withColumn("rn", F.row_number().over(Window.partitionBy("source", "part").orderBy("size", "doc_id", "h")))
    placed = ranked.join(per_range, ranked.source.eqNullSafe(per_range.s) & (ranked.part == per_range.p))
    place = (F.col("ahead") + F.col("rn")).cast("double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    u = offset_of(F.col("source"), seed)
    copies = F.least(F.floor(u + place * rate) - F.floor(u + (place - 1) * rate), F.lit(cap).cast("bigint"))
    return placed.select("doc_id", "source", "size", "h", "source_size", "target", copies.alias("copies"), place.cast("bigint").alias("place"))


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as many times as it is emitted."""
    with Scratch(docs.sparkSession, "mixed") as scratch:
        plan = scratch.save(mix_plan(docs, **how), "plan")
    ids = ["doc_id", "source", "size", "h"]
    plan = plan.withColumn("nth", F.row_number().over(Window.partitionBy(*ids).orderBy("place")))  # rows that are alike in all of these
    plan = plan.where("copies > 0").select(*[F.col(c).alias(f"__{c}") for c in (*ids, "nth", "copies")])

    def run(batches):
        for b, texts in text_slices(batches):
            hashes = np.array([xxhash.xxh64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            yield with_columns(b, b.schema.names, __n=pa.array(list(map(word_count, texts)), pa.int64()), __x=pa.array(hashes, pa.int64()))

    rows = docs.mapInArrow(run, field_sql(docs, *docs.columns) + ", `__n` bigint, `__x` bigint")
    rows = rows.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id", "source", "__n", "__x").orderBy(F.xxhash64("text"), "text")))
    on = rows.doc_id.eqNullSafe(plan["__doc_id"]) & rows.source.eqNullSafe(plan["__source"]) & (rows["__n"] == plan["__size"]) & (rows["__x"] == plan["__h"]) & (rows["__k"] == plan["__nth"])
    return rows.join(plan, on).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "__copies"))).select(*docs.columns)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP10_SQL = r"""
WITH rows AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM rows GROUP BY source
), weighed AS (
  SELECT *, ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3]::DOUBLE AS w,
         source_size::DOUBLE * 2 AS cap FROM by_source
), levels AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS lvl
  FROM weighed
), targets AS (
  SELECT source, source_size, CASE WHEN cap / w <= lvl THEN cap ELSE w * (
      SELECT arg_min(lvl, cap / w) FROM levels WHERE cap / w > lvl) END AS target FROM levels
), placed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(('0x' || substr(md5('mix-1|' || coalesce(r.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u,
         CAST(row_number() OVER (PARTITION BY r.source ORDER BY r.size, r.doc_id) AS DOUBLE) AS place
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       least(CAST(floor(u + place * rate) - floor(u + (place - 1) * rate) AS BIGINT), 2) * size AS taken
FROM placed
"""
