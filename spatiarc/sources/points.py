"""Labelled points in the plane, with features as columns and genes as a sparse long table."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spatiarc.functions.expressions import finite, names_of
from spatiarc.plans.lookup import Lookup

#: Columns of every point; a feature of such a name is kept in a column of another.
RESERVED = ("obs_idx", "sample", "x", "y")


def column_of(name: str, taken: tuple[str, ...] = RESERVED) -> str:
    """The column that holds a feature, where ``taken`` (whatever their case) have a meaning of their own."""
    return f"feature:{name}" if name.lower() in taken else name


@dataclass(frozen=True)
class PointSet:
    """``cells`` (obs_idx, sample, x, y, features) and optionally ``expr`` (obs_idx, gene, layer, value; zeros absent) and
    ``genes`` (gene, var_idx). A cell column wins over a gene of the same name."""

    cells: DataFrame
    expr: DataFrame | None = None
    genes: DataFrame | None = None
    layer: str = "X"

    @classmethod
    def of(
        cls, cells: DataFrame, expr: DataFrame | None = None, genes: DataFrame | None = None, *, id_col: str = "obs_idx", sample_col: str | None = "sample_name",
        coord_cols: tuple[str, str] = ("x_centroid", "y_centroid"), spatial_col: str = "spatial", layer: str = "X", check: bool = True,
    ) -> PointSet:
        """Take the coordinate columns if both are there, else the first two entries of ``spatial_col``. Without a sample
        column all points are one sample, "obj". ``check`` scans for missing coordinates and sample ids, which raise."""
        if all(c in cells.columns for c in coord_cols):
            x, y = (F.col(f"`{c}`").cast("double") for c in coord_cols)
            used = set(coord_cols)
        elif spatial_col in cells.columns:
            x, y = (F.get(F.col(f"`{spatial_col}`"), i).cast("double") for i in (0, 1))
            used = {spatial_col}
        else:
            raise KeyError(f"neither {coord_cols} nor {spatial_col!r} in the cells")
        if sample_col is not None and sample_col not in cells.columns:
            raise KeyError(f"no sample column {sample_col!r}")
        sample = F.lit("obj") if sample_col is None else F.col(f"`{sample_col}`").cast("string")
        others = [c for c in cells.columns if c not in used | {id_col, sample_col}]
        kept = [F.col(f"`{c}`").alias(column_of(c)) for c in others]
        rows = cells.select(F.col(f"`{id_col}`").cast("bigint").alias("obs_idx"), sample.alias("sample"), x.alias("x"), y.alias("y"), *kept)
        if check:
            bad = rows.agg(F.count_if(finite(F.col("x")).isNull() | finite(F.col("y")).isNull()).alias("xy"), F.count_if(F.col("sample").isNull()).alias("s")).first()
            if bad.xy:
                raise ValueError(f"{bad.xy} cells without finite coordinates")
            if bad.s:
                raise ValueError(f"{bad.s} cells without a sample")
        points = cls(rows, expr, genes, layer)
        if layer != "X" and expr is not None and not expr.where(F.col("layer") == layer).limit(1).count():
            raise KeyError(f"no layer {layer!r}")
        return points

    @classmethod
    def read(cls, spark: SparkSession, path: str, **how) -> PointSet:
        """From Parquet tables ``cells``, and ``expr`` and ``genes`` where ``how`` asks for them with ``with_genes``."""
        genes = how.pop("with_genes", False)
        read = lambda n: spark.read.parquet(f"{path}/{n}.parquet")
        return cls.of(read("cells"), read("expr") if genes else None, read("genes") if genes else None, **how)

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """Parquet tables that ``read`` takes again, cells clustered by sample so that a sample's files can be skipped to."""
        cells = self.cells.withColumnsRenamed({"sample": "sample_name", "x": "x_centroid", "y": "y_centroid"})
        cells.repartitionByRange("sample_name", "obs_idx").sortWithinPartitions("sample_name").write.mode(mode).parquet(f"{path}/cells.parquet")
        for name, table in (("expr", self.expr), ("genes", self.genes)):
            if table is not None:
                table.write.mode(mode).parquet(f"{path}/{name}.parquet")

    @cached_property
    def origins(self) -> Lookup:
        """Per sample, the least coordinates ``x0, y0``: found once, and small beside the points."""
        return Lookup(self.cells.groupBy("sample").agg(F.min("x").alias("x0"), F.min("y").alias("y0")), ["sample"])

    def where(self, samples) -> PointSet:
        """Only these samples; one without points raises."""
        if samples is None:
            return self
        names = [str(s) for s in ([samples] if isinstance(samples, str) else samples)]
        chosen = replace(self, cells=self.cells.where(F.col("sample").isin(names)))
        there = {r["sample"] for r in chosen.origins.table.select("sample").collect()}  # as many as were named
        if missing := [n for n in names if n not in there]:
            raise ValueError(f"no cells of samples {missing}")
        return chosen

    def samples(self) -> DataFrame:
        """Samples by first appearance: ``sample, first_idx``."""
        return self.cells.groupBy("sample").agg(F.min("obs_idx").alias("first_idx")).orderBy("first_idx")

    def known(self, features) -> list[str]:
        """Those of the features that a cell column or a gene has."""
        names = names_of(features)
        kept = {n for n in names if column_of(n) in self.cells.columns}
        rest = [n for n in names if n not in kept]
        if rest and self.genes is not None:
            kept |= {r.gene for r in self.genes.where(F.col("gene").isin(rest)).select("gene").distinct().collect()}  # as many as were asked for
        return [n for n in names if n in kept]

    def columns(self, features) -> DataFrame:
        """``obs_idx, sample, x, y`` and one double column per feature, ``v0, v1, ...``; missing values are NULL.

        Only the asked columns are read. Genes become columns in one aggregation; a cell without a row of a gene has 0.
        """
        names = names_of(features)
        if missing := sorted(set(names) - set(self.known(names))):
            raise KeyError(f"unknown features {missing}")
        place = {n: f"v{i}" for i, n in enumerate(names)}
        own = [n for n in names if column_of(n) in self.cells.columns]
        for n in own:
            kind = self.cells.schema[column_of(n)].dataType
            if not isinstance(kind, (T.NumericType, T.BooleanType)):
                raise TypeError(f"feature {n!r} is {kind.simpleString()}, not numeric")
        rows = self.cells.select(*RESERVED, *[finite(F.col(f"`{column_of(n)}`")).alias(place[n]) for n in own])
        genes = [n for n in names if n not in own]
        if genes:
            picked = self.expr.where((F.col("layer") == self.layer) & F.col("gene").isin(genes))
            by_gene = [F.max(F.when(F.col("gene") == g, F.struct(finite(F.col("value")).alias("v")))).alias(f"g{i}") for i, g in enumerate(genes)]
            wide = picked.groupBy("obs_idx").agg(*by_gene)
            rows = rows.join(wide, "obs_idx", "left")
            filled: list[Column] = [F.when(F.col(f"g{i}").isNull(), F.lit(0.0)).otherwise(F.col(f"g{i}.v")).alias(place[g]) for i, g in enumerate(genes)]
            rows = rows.select(*RESERVED, *[place[n] for n in own], *filled)
        return rows.select(*RESERVED, *[f"v{i}" for i in range(len(names))])

    def wide(self, features) -> DataFrame:
        """``obs_idx, sample, x, y`` and one double column per feature, by name (``column_of``)."""
        names = names_of(features)
        return self.columns(names).withColumnsRenamed({f"v{i}": column_of(n) for i, n in enumerate(names)})

    def values(self, features) -> DataFrame:
        """Long form: ``obs_idx, sample, x, y, feature, value``."""
        return unpivot(self.columns(features), list(RESERVED), names_of(features))


def unpivot(columns: DataFrame, ids: list[str], names: list[str], value: str = "value") -> DataFrame:
    """Columns ``v0, v1, ...`` as rows of their names."""
    pairs = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"v{i}").cast("double").alias("v")) for i, n in enumerate(names)])
    return columns.select(*ids, F.explode(pairs).alias("p")).select(*ids, "p.feature", F.col("p.v").alias(value))


def write_back(cells: DataFrame, found: DataFrame, columns: dict[str, Column], id_col: str = "obs_idx") -> DataFrame:
    """``cells`` with new columns from ``found`` (by ``obs_idx``); ``columns`` are expressions over the joined row."""
    found = found.withColumnRenamed("obs_idx", "__id")
    joined = cells.join(found, cells[id_col] == found["__id"], "left")
    kept = [c for c in cells.columns if c not in columns]
    return joined.select(*[cells[c] for c in kept], *[e.alias(n) for n, e in columns.items()])


def sanitized(name: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "_" for c in name).strip("_") or "feature"
