"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees over shards, then components.

Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` blocks of bits, so the distinct
fingerprints are dealt once per block by its value; each (block, value) is a shard with a BK-tree of its own, and only the
tree of the shard that a query falls in is searched. A shard of more than ``heavy`` fingerprints is dealt again by blocks
of its other bits, which must also agree on one of ``radius + 1``, and so on. Each shard returns one link per fingerprint (to the
least fingerprint that it reaches inside the shard), never all pairs; links of all shards meet in ``connected_components``.
Trees go to tasks with their shard instead of by broadcast, as their size grows with the data.

Defined cases: texts null or without words have fingerprint zero, which links like any other; with fewer words than a
shingle takes, the whole sequence is the shingle; repeated rows stay rows; a null doc_id is never a component's id unless
all of the component's are null; very long texts are hashed whole, slice by slice; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, sorted_groups, table, text_slices, with_columns, word_slices
from spatiarc.plans.components import connected_components
from spatiarc.plans.scratch import Scratch

SHINGLE, RADIUS, SEED, SHARD, HEAVY, DEPTH = 4, 4, 42, 256, 8192, 4
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bits set in over half of the XXH64 values of the word shingles of an ASCII-lower-cased text; zero without words."""
    counts, total = np.zeros((8, 8), np.int64), 0  # by bit of a byte, then byte
    words: list[bytes] = []
    for part in word_slices(text):  # a long text slice by slice, with the words that its next shingles begin with
        words = words[max(0, len(words) - shingle + 1) :] + part.lower().split()
        if len(words) < shingle:
            continue
        h = shingle_hashes(words, shingle)
        total += len(h)
        for a in range(0, len(h), 255):  # a byte lane counts to 255
            lanes = h[a : a + 255]
            for bit in range(8):
                counts[bit] += np.add.reduce((lanes >> np.uint64(bit)) & _LANES).reshape(1).astype("<u8").view(np.uint8)
    if not total:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    on = (2 * counts > total).T.reshape(-1)  # byte by byte, low bit first
    return int(np.packbits(on, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, name: str = "__fp") -> DataFrame:
    """``docs`` and the fingerprint of ``text`` as a signed long."""

    def run(batches):
        for b, texts in text_slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield with_columns(b, b.schema.names, **{name: pa.array(fps, pa.int64())})

    return docs.mapInArrow(run, field_sql(docs, *docs.columns) + f", {name} bigint")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id`` and ``fp``, the fingerprint as a signed long."""

    def run(batches):
        for b, texts in text_slices(batches):
            fps = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield with_columns(b, ["doc_id"], fp=pa.array(fps, pa.int64()))

    return docs.select("doc_id", "text").mapInArrow(run, field_sql(docs, "doc_id") + ", fp bigint")


class BKTree:
    """Children keyed by their integer Hamming distance to the parent's fingerprint; runs of few points stay leaves."""

    def __init__(self, points: np.ndarray, index: np.ndarray | None = None, leaf: int = 24):
        index = np.arange(len(points)) if index is None else index
        self.index, self.kids = index, {}
        if len(index) <= leaf:
            self.pivot = None
            return
        self.pivot, self.index = index[0], index[:1]
        rest = index[1:]
        far = np.bitwise_count(points[rest] ^ points[self.pivot])
        order = np.argsort(far, kind="stable")
        keys, at = np.unique(far[order], return_index=True)
        for k, part in zip(keys.tolist(), np.split(rest[order], at[1:]), strict=True):
            self.kids[k] = BKTree(points, part, leaf) if k else _Same(part)

    def links(self, points: np.ndarray, queries: np.ndarray, radius: int):
        """(query, match) index arrays of each visited node, following only edges within the radius."""
        if self.pivot is None:
            near = np.bitwise_count(points[queries][:, None] ^ points[self.index][None, :]) <= radius
            q, m = np.nonzero(near)
            yield queries[q], self.index[m]
            return
        far = np.bitwise_count(points[queries] ^ points[self.pivot]).astype(np.int16)
        hit = queries[far <= radius]
        yield hit, np.full(len(hit), self.pivot)
        for k, kid in self.kids.items():
            some = queries[np.abs(far - k) <= radius]
            if len(some):
                yield from kid.links(points, some, radius)


class _Same:
    """Points equal to the parent; distinct fingerprints have none."""

    def __init__(self, index):
        self.index = index

    def links(self, points, queries, radius):
        far = np.bitwise_count(points[queries] ^ points[self.index[0]])
        for q in queries[far <= radius]:
            yield np.full(len(self.index), q), self.index


def shard_links(points: np.ndarray, radius: int = RADIUS, block: int = 1024) -> np.ndarray:
    """For each point of a shard, the index of the least point of its component within the shard."""
    parent = np.arange(len(points))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    tree = BKTree(points)
    for a in range(0, len(points), block):
        for q, m in tree.links(points, np.arange(a, min(a + block, len(points))), radius):
            fresh = (q < m) & (parent[q] != parent[m])
            for x, y in zip(q[fresh].tolist(), m[fresh].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
    return np.array([find(i) for i in range(len(points))], np.int64)


def free_blocks(path: tuple[int, ...], radius: int) -> list[list[int]]:
    """The ``radius + 1`` blocks of bits into which a shard is dealt that has used up a block at each step of ``path``."""
    free: list[int] = list(range(64))
    parts: list[list[int]] = []
    for step in (*path, None):
        size, most = len(free) // (radius + 1), 12
        parts = [free[i * size : i * size + min(size, most)] for i in range(radius + 1)]
        if step is not None:
            free = [b for b in free if b not in parts[step]]
    return parts


def block_values(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.int64)
    for i, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)).astype(np.int64) << i
    return out


def dealt_again(rows: DataFrame, radius: int) -> DataFrame:
    """Rows (fp, path, key) of heavy shards, once for each block of their other bits, which near ones must agree on too."""

    def run(batches):
        for b in batches:
            fp, key, paths = b.column("fp").to_numpy(), b.column("key").to_numpy(), np.array(b.column("path").to_pylist(), object)
            for path in sorted(set(paths.tolist())):
                on = paths == path
                for i, bits in enumerate(free_blocks(tuple(map(int, path.split("."))), radius)):
                    values = block_values(fp[on].view(np.uint64), bits)
                    keys = [xxhash.xxh64_intdigest(f"{k}.{i}.{v}") for k, v in zip(key[on].tolist(), values.tolist(), strict=True)]
                    arrays = [pa.array(fp[on]), pa.array([f"{path}.{i}"] * int(on.sum()), pa.string()), pa.array(np.array(keys, np.uint64).view(np.int64))]
                    yield pa.RecordBatch.from_arrays(arrays, names=["fp", "path", "key"])

    return rows.select("fp", "path", "key").mapInArrow(run, "fp bigint, path string, key bigint")


def near_links(distinct: DataFrame, scratch: Scratch, radius: int = RADIUS, heavy: int = HEAVY) -> DataFrame:
    """Links ``(u, v)`` that connect the fingerprints ``fp`` just as all pairs within ``radius`` bits would."""
    n = distinct.count()
    bits = max(1, min(64 // (radius + 1), int(np.ceil(np.log2(max(n, 1) / SHARD + 1)))))
    step = 64 // (radius + 1)

    def key(i):
        value = F.shiftrightunsigned("fp", i * step).bitwiseAND(F.lit((1 << min(bits, step, 12)) - 1))
        return F.struct(F.lit(str(i)).alias("path"), F.xxhash64(F.lit(i), value).alias("key"))

    dealt = distinct.select("fp", F.explode(F.array(*[key(i) for i in range(radius + 1)])).alias("k")).select("fp", "k.path", "k.key")
    shards = []
    for depth in range(1, DEPTH + 1):  # a heavy shard is dealt by blocks of its other bits, again while it stays heavy
        counts = dealt.groupBy("path", "key").agg(F.count("*").alias("m")).where(F.col("m") > heavy)
        counts = scratch.save(counts.select("path", "key"), f"heavy{depth}")
        if depth == DEPTH or not counts.limit(1).count():
            shards.append(dealt)
            break
        shards.append(dealt.join(counts, ["path", "key"], "left_anti"))
        dealt = scratch.save(dealt_again(dealt.join(counts, ["path", "key"]), radius), f"dealt{depth}")
    every = shards[0]
    for more in shards[1:]:
        every = every.unionByName(more)
    keys = ["path", "key"]
    sorted_rows = every.repartition(*keys).sortWithinPartitions(*keys, "fp")

    def run(batches):
        for _, part in sorted_groups(batches, keys):
            if part.num_rows < 2:
                continue
            fp = part["fp"].to_numpy()
            root = fp[shard_links(fp.view(np.uint64), radius)]
            on = root != fp
            if on.any():
                yield pa.RecordBatch.from_arrays([pa.array(fp[on]), pa.array(root[on])], names=["u", "v"])

    return sorted_rows.mapInArrow(run, "u bigint, v bigint")


def near_components(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``prints`` (doc_id, fp) with ``component_id``, the smallest doc_id reachable over links of at most ``radius`` bits, and
    ``root``, the component's least fingerprint, which tells apart components of one ``component_id``.

    What is joined by fingerprint or root is written first, so adaptive execution can split the rows of a large group."""
    with Scratch(prints.sparkSession, "simhash") as scratch:
        ids = scratch.save(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "ids")
        links = scratch.save(near_links(ids.select("fp"), scratch, radius).distinct(), "links")
        roots = scratch.save(connected_components(links, "simhash-components"), "roots")
        rooted = scratch.save(ids.join(roots, ids.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root")), "rooted")
        least = scratch.save(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "least")
        named = scratch.save(rooted.join(least, "root").select("fp", "component_id", "root"), "named")
        scratch.drop("ids", "links", "roots", "rooted", "least")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id, root`` of every row."""
    prints = Scratch(docs.sparkSession, "prints").save(fingerprints(docs, shingle), "prints")
    return near_components(prints, radius)


def keep_one_per_group(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: of the rows whose doc_id names it, one with their least fingerprint.

    A fingerprint lies in one group only, so doc_id and fingerprint name the row's group even where groups share a doc_id or
    have none. Where every doc_id that names a group stands in one row, the doc_id is enough and texts aren't hashed again.
    """
    groups = Scratch(docs.sparkSession, "groups").save(simhash_groups(docs, shingle, radius), "groups")
    names = F.col("doc_id").eqNullSafe(F.col("component_id"))
    repeated = groups.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(names).alias("names")).where("names AND n > 1").limit(1).count() > 0
    kept = groups.where(names).groupBy("root", "doc_id").agg(F.min("fp").alias("__kept_fp")).select(F.col("doc_id").alias("__id"), "__kept_fp")
    if not repeated:
        return docs.join(kept, docs.doc_id.eqNullSafe(kept["__id"])).select(*docs.columns)
    rows = with_fingerprint(docs, shingle)
    rows = rows.join(kept, rows.doc_id.eqNullSafe(kept["__id"]) & (rows["__fp"] == kept["__kept_fp"]))
    return rows.dropDuplicates(["doc_id", "__fp"]).select(*docs.columns)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
