"""Cells, genes and gene sets derived from the driver's ``events`` table, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from spatiarc.sources.points import PointSet

CELLS_SQL = """
SELECT obs_idx, sample_name, x_centroid, y_centroid, noise_score,
  noise_score + greatest(CAST(0 AS DOUBLE), CAST(4 AS DOUBLE) * (CAST(1 AS DOUBLE) - ((x_centroid - 200) * (x_centroid - 200)
    + (y_centroid - 160) * (y_centroid - 160)) / CAST(14400 AS DOUBLE))) AS hypoxia_score,
  CAST(user_id % 50 AS DOUBLE) / CAST(12.5 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), CAST(4 AS DOUBLE) * (CAST(1 AS DOUBLE)
    - ((x_centroid - 280) * (x_centroid - 280) + (y_centroid - 200) * (y_centroid - 200)) / CAST(14400 AS DOUBLE))) AS inflammation_score
FROM (SELECT event_id AS obs_idx, user_id, event_type AS sample_name,
  CAST((event_id * 7919 + user_id * 13) % 2400 AS DOUBLE) / CAST(4 AS DOUBLE) AS x_centroid,
  CAST((event_id * 104729 + user_id * 101) % 1920 AS DOUBLE) / CAST(4 AS DOUBLE) AS y_centroid,
  value / CAST(50 AS DOUBLE) AS noise_score FROM {events}) AS e
"""
GENES = 30
SETS = {"early": ["G00", "G03", "G05", "G03"], "late": ["G20", "G24", "G29"], "absent": ["NOPE"]}


def expr_sql(events: str) -> str:
    genes = ", ".join(f"({j})" for j in range(GENES))
    return f"""
SELECT obs_idx, concat('G', lpad(CAST(j AS {{string}}), 2, '0')) AS gene, 'X' AS layer, CAST(m - 2 AS DOUBLE) AS value
FROM (SELECT event_id AS obs_idx, j, (event_id * (2 * j + 3) + user_id * (j + 1)) % (j + 4) AS m FROM {events} CROSS JOIN (VALUES {genes}) AS g(j)) AS t
WHERE m > 2"""


def fixture(spark: SparkSession, sf_dir: str, check: bool = False) -> PointSet:
    events = f"parquet.`{sf_dir}/events.parquet`"
    cells = spark.sql(CELLS_SQL.format(events=events))
    expr = spark.sql(expr_sql(events).format(string="STRING"))
    genes = spark.createDataFrame([(f"G{j:02d}", j) for j in range(GENES)], "gene string, var_idx int")
    return PointSet.of(cells, expr, genes, check=check)
