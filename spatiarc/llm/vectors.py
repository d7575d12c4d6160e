"""What both vector searches share: usable vectors, shards of candidates, and queries sent to every shard in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spatiarc.llm.common import hash_sample

SHARD_ROWS, QUERY_BLOCK, LEAST_SHARDS, SEEDS = 65_536, 256, 6, 4096


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """``vec_id`` and ``v`` (doubles) of rows whose vector is neither null nor holds null or non-finite components."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return rows.where(F.exists("v", lambda x: x != 0)) if nonzero else rows


def packed(rows: DataFrame, scale: float | None = None) -> DataFrame:
    """``vec_id``, number of dimensions ``d``, bytes a component ``w`` and the vector's bytes ``x``, in the narrowest of 16-bit
    integers, floats and doubles that holds the vector exactly; with ``scale``, of floor(scale * x). Vectors of different lengths
    are never compared."""

    def raw(v: np.ndarray) -> bytes:
        for kind in ("<i2", "<f4"):
            with np.errstate(all="ignore"):
                narrow = v.astype(kind)
            if (narrow.astype("<f8") == v).all():
                return narrow.tobytes()
        return v.tobytes()

    def run(batches):
        for b in batches:
            lists = b.column("v")
            flat, at = lists.flatten().to_numpy(zero_copy_only=False).astype("<f8"), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            with np.errstate(over="ignore"):
                flat = flat if scale is None else np.floor(flat * scale)
            found = [raw(flat[a:e]) for a, e in zip(at, at[1:], strict=False)]
            d = np.diff(at)
            w = np.array([len(x) for x in found]) // np.maximum(d, 1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(d, pa.int32()), pa.array(w, pa.int32()), pa.array(found, pa.binary())], names=["vec_id", "d", "w", "x"])

    return rows.mapInArrow(run, "vec_id bigint, d int, w int, x binary")


_KINDS = {2: "<i2", 4: "<f4", 8: "<f8"}


def doubles(raw: list[bytes], d: int) -> np.ndarray:
    """Packed vectors of ``d`` dimensions as rows of doubles."""
    if len({len(x) for x in raw}) == 1:
        return np.frombuffer(b"".join(raw), _KINDS[len(raw[0]) // d]).astype("<f8").reshape(len(raw), d)
    return np.stack([np.frombuffer(x, _KINDS[len(x) // d]).astype("<f8") for x in raw])


def search_shards(rows: DataFrame, every: int, k: int, search, bound, out: str) -> DataFrame:
    """Run ``search(ids, x)(query_ids, q, bounds)`` for every shard with every block of queries and merge the best ``k``.

    ``rows`` is (vec_id, d, w, x); queries are rows whose id is divisible by ``every``. Shards hold about ``SHARD_ROWS`` rows
    dealt by hash, so none is hot, each in a partition of its own. Queries travel as packed blocks, once per shard, by shuffle:
    neither side is broadcast. What is broadcast are ``SEEDS`` rows: ``bound(query_ids, q, ids, x)`` finds for each query how good
    the kth best of them is, and this bound goes with the query to all shards, so that none searches below it. ``search`` is
    made per shard and called per block, and yields (query_id, vec_id, score) arrays; ``out`` is the order of scores, "desc" or "asc".
    """
    n = rows.count()
    shards = max(LEAST_SHARDS, -(-n // SHARD_ROWS))
    seeds: dict[int, list] = {}
    for r in hash_sample(rows, "vec_id", SEEDS).collect():
        seeds.setdefault(r.d, []).append((r.vec_id, bytes(r.x)))
    seeds = rows.sparkSession.sparkContext.broadcast({d: (np.array([i for i, _ in v]), doubles([x for _, x in v], d)) for d, v in seeds.items()})
    points = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("block", F.lit(-1))
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("d", "w", "x")).alias("v")).select("vec_id", "v.*")  # of repeated ids, one
    blocks = max(1, -(-n // (every * QUERY_BLOCK)))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))

    def pack(batches):
        """Queries of a task's batches by (block, d, w): ids, vectors and bounds in one binary each."""
        for b in batches:
            keys = [b.column(c).to_numpy() for c in ("block", "d", "w")]
            for key in sorted(set(zip(*(c.tolist() for c in keys), strict=True))):
                on = np.flatnonzero(np.logical_and.reduce([c == v for c, v in zip(keys, key, strict=True)]))
                ids, raw = b.column("vec_id").to_numpy()[on], b.column("x").take(pa.array(on)).to_pylist()
                known = seeds.value.get(key[1])
                limits = bound(ids, doubles(raw, key[1]), *known).astype("<f8") if known is not None else np.full(len(ids), np.nan)
                cells = [[key[0]], [key[1]], [key[2]], [ids.astype("<i8").tobytes()], [b"".join(raw)], [limits.tobytes()]]
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, kinds, strict=True)], names=["block", "d", "w", "ids", "x", "bounds"])

    sent = queries.repartition("block").mapInArrow(pack, "block int, d int, w int, ids binary, x binary, bounds binary")
    sent = sent.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    none = [F.lit(None).cast("binary").alias(c) for c in ("ids", "bounds")]
    union = points.select("shard", "d", "w", "block", "vec_id", "x", *none).union(sent.select("shard", "d", "w", "block", F.lit(None).cast("bigint").alias("vec_id"), "x", "ids", "bounds"))
    dealt = union.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "d", "block", "vec_id")

    def run(batches):
        key = index = None
        held: list[tuple] = []
        for b in batches:
            for shard, d, w, block, vec_id, x, ids, bounds in zip(*(b.column(c).to_pylist() for c in ("shard", "d", "w", "block", "vec_id", "x", "ids", "bounds")), strict=True):
                if key != (shard, d):
                    key, index, held = (shard, d), None, []
                if block < 0:
                    held.append((vec_id, x))
                    continue
                if not held and index is None:
                    continue
                if index is None:
                    index, held = search(np.array([i for i, _ in held]), doubles([v for _, v in held], d)), []
                ids = np.frombuffer(ids, "<i8")
                q, v, s = index(ids, np.frombuffer(x, _KINDS[w]).astype("<f8").reshape(len(ids), d), np.frombuffer(bounds, "<f8"))
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, f"query_id bigint, vec_id bigint, score {'bigint' if out == 'desc' else 'double'}")
    order = [F.desc("score") if out == "desc" else F.asc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
