"""Joins of many rows with a table of one row for each key: by a broadcast of counted size, or beyond it by salted keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spatiarc.plans.scratch import once

#: Rows that are broadcast at most, and parts that the rows of a key are dealt into beyond that.
BROADCAST_ROWS, SALTS = 200_000, 64


def bounded(table: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """The table as a local relation if it has at most ``limit`` rows; else None, and no more than those were fetched."""
    rows = table.limit(limit + 1).toArrow()
    return None if rows.num_rows > limit else table.sparkSession.createDataFrame(rows, table.schema)


class Lookup:
    """A table of one row for each key, counted once. A small one goes to every task, so rows aren't shuffled by a key that may
    hold a third of them; a larger one is written, repeated for each salt, and rows meet it by key and salt."""

    def __init__(self, table: DataFrame, keys: list[str], limit: int = BROADCAST_ROWS, salts: int = SALTS):
        self.keys, self.salts, self.small = list(keys), salts, bounded(table, limit)
        self.table = once(table, "lookup") if self.small is None else self.small

    def join(self, rows: DataFrame, how: str = "inner") -> DataFrame:
        if self.small is not None:
            return rows.join(F.broadcast(self.small), self.keys, how)
        dealt = rows.withColumn("__salt", F.pmod(F.xxhash64(F.struct("*")), F.lit(self.salts)).cast("int"))
        repeated = self.table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(self.salts - 1))))
        return dealt.join(repeated, [*self.keys, "__salt"], how).drop("__salt")
