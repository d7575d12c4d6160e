"""What the training-data operators share: reading tables and walking Arrow batches of texts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word operators; the same bytes on which ``bytes.split()`` splits.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch in runs of rows of about ``most`` bytes of text (one row at least), with the texts as bytes, null as empty."""
    for batch in batches:
        texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
        start = total = 0
        for i, x in enumerate(texts):
            total += len(x)
            if total >= most or i + 1 == len(texts):
                yield batch.slice(start, i + 1 - start), texts[start : i + 1]
                start, total = i + 1, 0


_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def word_slices(text: bytes, most: int = 1 << 20) -> Iterator[bytes]:
    """A text in slices of about ``most`` bytes that end before white space, so no word is cut; one slice if it is no longer."""
    at = 0
    while at < len(text):
        end = at + most
        found = _SPACE.search(text, end) if end < len(text) else None
        end = found.start() if found else len(text)
        yield text[at:end]
        at = end


def word_count(text: bytes) -> int:
    return sum(len(part.split()) for part in word_slices(text))


def with_columns(batch: pa.RecordBatch, keep: list[str], **new) -> pa.RecordBatch:
    """Columns ``keep`` of a batch, then the new ones."""
    arrays = [batch.column(k) for k in keep] + [v if isinstance(v, pa.Array) else pa.array(v) for v in new.values()]
    return pa.RecordBatch.from_arrays(arrays, names=[*keep, *new])


def field_sql(df: DataFrame, *names: str) -> str:
    """The DDL of columns as they are in ``df``, for the schema of a mapped result."""
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """The runs of equal keys in batches that are sorted by them, each run whole even if it spans batches."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:], strict=False):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """The ``size`` rows that are first in order of a hash of their key, or all; the order of rows plays no part.

    Only rows below a bound on the hash, which holds the wanted number with room to spare, are sorted.
    """
    n = rows.count()
    h = F.xxhash64(key)
    if n > size:
        share = min(1.0, (size + 8 * size**0.5 + 64) / n)
        rows = rows.where(h <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1)) if share < 1 else (1 << 63) - 1))
    return rows.orderBy(h, key).limit(size)
