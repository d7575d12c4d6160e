"""Column expressions that the operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The eight displacement directions as signs of x and y.
DIRECTIONS = {
    "add_X": (1, 0), "minus_X": (-1, 0), "add_Y": (0, 1), "minus_Y": (0, -1),
    "add_X_add_Y": (1, 1), "add_X_minus_Y": (1, -1), "minus_X_add_Y": (-1, 1), "minus_X_minus_Y": (-1, -1),
}


def finite(c: Column) -> Column:
    """A double with NaN and infinities as NULL, the only mark of a missing value in the engine."""
    d = c.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def ratio(a: str, b: str) -> Column:
    return F.expr(f"try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))")


def rounded_ratio_sql(i: str, u: str, digits: int | None = 4) -> str:
    """SQL (Spark and DuckDB) for i / u rounded half to even on the exact binary quotient; NULL if u is 0.

    Decimal ties are told apart by the residual of the quotient, from a split product (needs u < 2**26).
    """
    if digits is None:
        return f"CASE WHEN {u} > 0 THEN CAST({i} AS DOUBLE) / CAST({u} AS DOUBLE) END"
    s = 10**digits
    n = f"(CAST({i} AS BIGINT) * {s})"
    d = f"nullif(CAST({u} AS BIGINT), 0)"
    k = f"CAST(({n} - {n} % {d}) / {d} AS BIGINT)"
    q = f"(CAST({i} AS DOUBLE) / CAST({d} AS DOUBLE))"
    big = "CAST(134217729 AS DOUBLE)"
    hi = f"({q} * {big} - ({q} * {big} - {q}))"
    r = f"(({hi} * CAST({u} AS DOUBLE) - CAST({i} AS DOUBLE)) + ({q} - {hi}) * CAST({u} AS DOUBLE))"
    up = f"CASE WHEN 2 * ({n} % {d}) > {u} THEN 1 WHEN 2 * ({n} % {d}) < {u} THEN 0 WHEN {r} > 0 THEN 1 WHEN {r} < 0 THEN 0 ELSE {k} % 2 END"
    return f"CASE WHEN {u} > 0 THEN CAST({k} + {up} AS DOUBLE) / CAST({s} AS DOUBLE) END"


def rounded_ratio(i: str, u: str, digits: int | None = 4) -> Column:
    return F.expr(rounded_ratio_sql(i, u, digits))


def shift_rows(steps, euclidean: bool = False) -> list[tuple[float, str, float, float]]:
    """(step, direction, dx, dy); ``euclidean`` keeps diagonal displacements as long as straight ones."""
    out = []
    for step in steps:
        for name, (sx, sy) in DIRECTIONS.items():
            by = step / math.sqrt(2) if euclidean and sx and sy else step
            out.append((float(step), name, float(sx * by), float(sy * by)))
    return out


def operator_shift_rows(right: int, left: int, up: int, down: int) -> list[tuple[float, str, float, float]]:
    """Displacements with a step of their own for +X, -X, +Y and -Y; diagonals combine two."""
    by_sign = {1: (right, up), -1: (left, down), 0: (0, 0)}
    return [(float(max(right, left, up, down)), n, float(sx * by_sign[sx][0]), float(sy * by_sign[sy][1])) for n, (sx, sy) in DIRECTIONS.items()]


def shift_table(spark: SparkSession, rows) -> DataFrame:
    """A table of literals, so it is a local relation of the plan and no Python rows."""
    values = ", ".join(f"({s!r}D, '{d}', {x!r}D, {y!r}D)" for s, d, x, y in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS shifts(step, direction, dx, dy)")


def grid_steps(steps=None) -> list[float]:
    steps = (2, 4, 6, 8, 10, 12) if steps is None else steps
    kept = sorted({float(s) for s in steps if s > 0})
    if not kept:
        raise ValueError("no positive step")
    if any(abs(s - round(s)) > 1e-8 for s in kept):
        raise ValueError("steps on a grid must be whole numbers")
    return [float(round(s)) for s in kept]


def radius_steps(steps=None) -> list[float]:
    steps = (25, 50, 75, 100, 125, 150) if steps is None else steps
    kept = sorted({float(s) for s in steps if s > 0})
    if not kept:
        raise ValueError("no positive step")
    return kept


def names_of(columns) -> list[str]:
    names = [columns] if isinstance(columns, str) else list(columns)
    if not names:
        raise ValueError("no feature named")
    return list(dict.fromkeys(map(str, names)))
