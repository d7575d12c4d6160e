"""Exact removal of long repeats with a logarithmic family of sparse suffix arrays.

Every window of ``span`` bytes is named after an anchor: the position of the least hash of 8 bytes among the window's first
``reach`` positions (leftmost of equals). Equal windows have the same anchor at the same distance, so only suffixes at
anchors are indexed, a few per hundred bytes. An entry is (k, f): ``k`` fingerprints the suffix's first ``core`` bytes, which
all its windows share; ``f`` fingerprints the union of its windows. Suffixes are ordered by ``k`` instead of by their
bytes: that brings equal ones together as well, and the bytes themselves would fill the disk (README has the figures).

``SuffixFamily`` holds sorted arrays (k, n, and the least and greatest text) as written tables. A new batch becomes an array
of level 0 and is merge-scanned against the levels present: while the last level has its size the two merge into one of the
next level (only the last of these merges is written), so each suffix is rewritten a logarithmic number of times at most, and the
levels that stay are scanned beside it. Every scan adds the cores that the new batch repeats to ``hits``, so after each batch all long matches so far are known.

Entries with equal (k, f) repeat in all their windows. Of entries that share only ``k``, windows are compared by what lies
around the core: by all bytes but ``STEP`` first, then one distance at a time, which also finds matches that begin or
end inside an entry; this is exact at the byte. Both comparisons are counts by fingerprint with partial sums, so a passage in a
third of all rows is dealt over as many tasks as any other.

Rows are named by a 128-bit hash of their text, so exact copies meet by partial aggregation and no copy group is ever
listed. A core that lies in different texts, or in copies of one, also marks its rows: ``shares_passage`` is 1 wherever
``core + reach - 1`` bytes (272, about fifty words) repeat in another row, and never for less than ``core`` bytes. Where a window of
that size begins but none of ``span`` bytes, at a text's end, its anchor makes an entry for the mark alone (lo and hi are -1).

Defined cases: null and empty texts have no bytes and keep none; texts shorter than ``span`` stay whole; an empty table
gives no rows; very long texts are indexed in pieces of ``SLICE`` bytes that overlap by a window, so memory follows the text's
length only once; matches never cross rows; repeated rows are rows (each is a repeat of the other); of tied anchors the
leftmost counts; extra columns and nulls in them play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, table, text_slices, with_columns
from spatiarc.plans.scratch import Scratch

SPAN, REACH, CORE, STEP, SLICE = 400, 128, 145, 16, 1 << 20
#: Bytes of text to a batch, and the least number of batches.
BATCH_BYTES, LEAST_BATCHES = 64 << 30, 4
ENTRY = "k bigint, f bigint, t1 bigint, t2 bigint, a bigint, lo int, hi int"


def core_size(span: int, reach: int) -> int:
    """The bytes behind an anchor that fingerprints cover: what all windows share, ``CORE`` at most."""
    return min(CORE, span - reach + 1)


def mark_size(span: int, reach: int) -> int:
    """The bytes that mark a row wherever they repeat in another: an anchor and its core lie within them."""
    return core_size(span, reach) + reach - 1


def anchors(buffer: bytes, ends: list[tuple[int, int, bool]], span: int = SPAN, reach: int = REACH):
    """Anchors of all windows in the texts at (start, end, last) of ``buffer``: text number, anchor, and the least and greatest
    distance back to a window's start. Behind the last window the anchors of smaller ones, for the mark, have distances -1."""
    none = np.zeros(0, np.int64)
    b = np.frombuffer(buffer, np.uint8)
    small = mark_size(span, reach)
    if len(b) < small:
        return none, none, none, none
    x = b.astype(np.uint64)
    for width in (1, 2, 4):  # to 8 bytes at each position
        x = x[:-width] | (x[width:] << np.uint64(8 * width))
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    x = (x & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(x), dtype=np.uint64)
    done = 1
    while done < reach:  # least of `done` positions, doubled
        more = min(done, reach - done)
        x = np.minimum(x[: len(x) - more], x[more:])
        done += more
    valid, number, whole = [], [], []
    for i, (start, end, last) in enumerate(ends):
        n = max(end - start - span + 1, 0)
        more = max(end - start - small + 1, 0) if last else n
        if more:
            valid.append(np.arange(start, start + more))
            number.append(np.full(more, i))
            whole.append(np.arange(more) < n)
    if not valid:
        return none, none, none, none
    p, number, whole = np.concatenate(valid), np.concatenate(number), np.concatenate(whole)
    a = (x[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    moved = (np.diff(a) != 0) | (np.diff(number) != 0)
    first = np.flatnonzero(np.concatenate(([True], moved | (np.diff(whole) != 0))))
    last = np.concatenate((first[1:] - 1, [len(p) - 1]))
    keep = whole[first] | np.concatenate(([True], moved))[first]  # an anchor that a whole window has is there already
    first, last = first[keep], last[keep]
    lo, hi = a[first] - p[last], a[first] - p[first]
    return number[first], a[first], np.where(whole[first], lo, -1), np.where(whole[first], hi, -1)


def text_key(text: bytes) -> tuple[int, int]:
    h = np.frombuffer(xxhash.xxh3_128_digest(text), "<i8")
    return int(h[0]), int(h[1])


def pieces(texts: list[bytes], span: int, most: int, least: int | None = None) -> Iterator[list[tuple[int, int, bytes, bool]]]:
    """(text, start, bytes, whether they end the text) in groups of about ``most`` bytes; a longer text comes in several, which
    overlap so that each window lies in one of them. Texts shorter than ``least`` (``span`` if None) are left out."""
    held: list[tuple[int, int, bytes, bool]] = []
    total = 0
    for i, t in enumerate(texts):
        for start in range(0, max(len(t) - span + 1, int(len(t) >= (least or span))), most):
            part = t[start : start + most + span - 1]
            held.append((i, start, part, start + len(part) == len(t)))
            total += len(part)
            if total >= most:
                yield held
                held, total = [], 0
    if held:
        yield held


def entries_of(texts: list[bytes], span: int = SPAN, reach: int = REACH, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    core, h = core_size(span, reach), xxhash.xxh64_intdigest
    names = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
    for group in pieces(texts, span, most, mark_size(span, reach)):
        buffer = b"".join(x for _, _, x, _ in group)
        starts = np.concatenate(([0], np.cumsum([len(x) for _, _, x, _ in group]))).astype(np.int64)
        number, a, lo, hi = anchors(buffer, list(zip(starts.tolist(), starts[1:].tolist(), (e for *_, e in group), strict=False)), span, reach)
        view = memoryview(buffer)
        k = np.fromiter((h(view[i : i + core]) for i in a.tolist()), np.uint64, len(a)).view(np.int64)
        parts = zip((a - hi).tolist(), (a - lo + span).tolist(), (lo * 1024 + hi).tolist(), strict=True)
        f = np.fromiter((h(view[i:j], s) if s >= 0 else 0 for i, j, s in parts), np.uint64, len(a)).view(np.int64)
        of, offset = (np.array(c, np.int64) for c in list(zip(*group, strict=True))[:2])
        keys = names[of[number]]
        arrays = [k, f, keys[:, 0], keys[:, 1], a - starts[number] + offset[number], lo.astype(np.int32), hi.astype(np.int32)]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["k", "f", "t1", "t2", "a", "lo", "hi"])


def suffix_entries(docs: DataFrame, span: int = SPAN, reach: int = REACH) -> DataFrame:
    def run(batches):
        for _, texts in text_slices(batches, most=SLICE):
            yield from entries_of(texts, span, reach)

    return docs.select("text").mapInArrow(run, ENTRY)


class SuffixFamily:
    """Sorted arrays (k, n, x, y) by level, under the shared folder: how often a core occurs, and the least and greatest
    short name of its texts; and ``hits``, the cores that repeat, with ``apart``: whether in different texts."""

    def __init__(self, spark: SparkSession):
        self.scratch, self.levels, self.made = Scratch(spark, "suffixes"), [], 0  # levels: (level, name, table), oldest first
        self.hits: list[DataFrame] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        self.made += 1
        name = f"level{level}-{self.made}"
        counted = rows.groupBy("k").agg(F.sum("n").alias("n"), F.min("x").alias("x"), F.max("y").alias("y")).sortWithinPartitions("k")
        self.levels.append((level, name, self.scratch.save(counted, name)))

    def add(self, entries: DataFrame) -> None:
        """Sort a batch together with the last levels of equal size, one after another, into one new level; scan it against the rest."""
        short = F.shiftright("t1", 32).cast("int")
        rows = entries.select("k", F.lit(1).cast("bigint").alias("n"), short.alias("x"), short.alias("y"))
        level, merged = 0, []
        while self.levels and self.levels[-1][0] == level:  # a merge is a scan of what it merges
            _, name, old = self.levels.pop()
            rows, level = rows.unionByName(old), level + 1
            merged.append(name)
        self._write(rows, level)
        if merged:
            self.scratch.drop(*merged)
        newest = self.levels[-1][2]
        both = newest
        for _, _, older in self.levels[:-1]:
            there = older.select("k", F.col("n").alias("m"), F.col("x").alias("u"), F.col("y").alias("v"))
            pairs = newest.join(there, "k")
            both = both.unionByName(pairs.select("k", (F.col("n") + F.col("m")).alias("n"), F.least("x", "u").alias("x"), F.greatest("y", "v").alias("y")))
        self.hits.append(self.scratch.save(both.where("n > 1").select("k", (F.col("x") != F.col("y")).alias("apart")), f"hits{self.made}"))

    def scan(self) -> DataFrame:
        """``k, apart`` of all cores that repeat."""
        rows = self.hits[0]
        for other in self.hits[1:]:
            rows = rows.unionByName(other)
        return rows.groupBy("k").agg(F.max("apart").alias("apart"))


def with_text_key(docs: DataFrame) -> DataFrame:
    def run(batches):
        for b, texts in text_slices(batches):
            keys = np.array([text_key(t) for t in texts], np.int64).reshape(-1, 2)
            yield with_columns(b, b.schema.names, t1=pa.array(keys[:, 0]), t2=pa.array(keys[:, 1]))

    return docs.mapInArrow(run, field_sql(docs, *docs.columns) + ", t1 bigint, t2 bigint")


def around_cores(keyed: DataFrame, per_text: DataFrame, span: int, step: int) -> DataFrame:
    """For each entry and run of ``step`` distances from ``p``: a fingerprint of what all their windows share, and the bytes left
    and right of that which only some of them hold."""

    def run(batches):
        for b, texts in text_slices(batches, most=SLICE):
            out: dict[str, list] = {c: [] for c in ("k", "f", "lo", "hi", "p", "s", "left", "right")}
            for t, es in zip(texts, b.column("es").to_pylist(), strict=True):
                view = memoryview(t)
                for e in es:
                    a, lo, hi = e["a"], e["lo"], e["hi"]
                    for p in range(lo - lo % step, hi + 1, step):
                        at, end = a - p, a - p - step + 1 + span
                        same = xxhash.xxh64_intdigest(view[at:end], p)
                        row = (e["k"], e["f"], lo, hi, p, same - (same >> 63 << 64), t[a - min(hi, p + step - 1) : at], t[end : a - max(lo, p) + span])
                        for c, v in zip(out.values(), row, strict=True):
                            c.append(v)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    rows = keyed.join(per_text, ["t1", "t2"]).select("text", "es")
    return rows.mapInArrow(run, "k bigint, f bigint, lo int, hi int, p int, s bigint, `left` binary, `right` binary")


def window_names(runs: DataFrame, step: int) -> DataFrame:
    """``k, f, d, w``: a fingerprint of the window at each distance of a run."""

    def run(batches):
        for b in batches:
            ks, fs, ds, ws = [], [], [], []
            for r in b.to_pylist():
                p, left, right = r["p"], r["left"], r["right"]
                for d in range(max(r["lo"], p), min(r["hi"], p + step - 1) + 1):
                    n = d - p
                    w = xxhash.xxh64_intdigest(left[len(left) - n :] + b"|" + right[: step - 1 - n], (r["s"] + d) & 0xFFFFFFFFFFFFFFFF)
                    ks.append(r["k"]), fs.append(r["f"]), ds.append(d), ws.append(w - (w >> 63 << 64))
            types = ((ks, pa.int64()), (fs, pa.int64()), (ds, pa.int32()), (ws, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in types], names=["k", "f", "d", "w"])

    return runs.mapInArrow(run, "k bigint, f bigint, d int, w bigint")


def repeated(rows: DataFrame, keys: list[str], scratch: Scratch, name: str) -> DataFrame:
    """Those rows whose keys occur more than once. The keys are written first: beside a plain shuffle adaptive execution can split
    the rows of a hot key."""
    return rows.join(scratch.save(rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1").select(*keys), name), keys)


def removed_runs(entries: list[dict], span: int = SPAN) -> list[tuple[int, int]]:
    """Maximal runs covered by repeated windows; an entry's windows start ``hi`` to ``lo`` before ``a``, or at its distances ``ds``."""
    starts, ends = [], []
    for e in entries:
        a, ds = e["a"], e["ds"]
        if ds is None:
            starts.append(a - e["hi"]), ends.append(a - e["lo"] + span)
        else:
            starts += [a - d for d in ds]
            ends += [a - d + span for d in ds]
    if not starts:
        return []
    order = np.argsort(np.array(starts, np.int64), kind="stable")
    s, e = np.array(starts, np.int64)[order], np.maximum.accumulate(np.array(ends, np.int64)[order])
    new = np.flatnonzero(np.concatenate(([True], s[1:] > e[:-1])))
    return list(zip(s[new].tolist(), e[np.concatenate((new[1:] - 1, [len(e) - 1]))].tolist(), strict=True))


def repeated_entries(docs: DataFrame, scratch: Scratch, span: int = SPAN, reach: int = REACH, batches: int | None = None) -> DataFrame:
    """Per distinct text (t1, t2) with a core that repeats: its repeated ``entries`` (a, lo, hi, ds) and ``shares``."""
    step = min(STEP, reach)
    if batches is None:
        batches = max(LEAST_BATCHES, -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BATCH_BYTES))
    entries = scratch.save(suffix_entries(docs, span, reach), "entries")
    family = SuffixFamily(docs.sparkSession)
    try:
        for i in range(batches):
            family.add(entries.where(F.pmod(F.col("t1"), F.lit(batches)) == i))
        found = scratch.save(entries.join(scratch.save(family.scan(), "hits"), "k"), "found")
    finally:
        family.scratch.drop()
    scratch.drop("entries")
    one_each = found.where("lo >= 0").groupBy("k", "f").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "a", "lo", "hi")).alias("e"))
    one_each = scratch.save(one_each.select("k", "f", "n", "e.*"), "one-each")
    per_text = repeated(one_each, ["k"], scratch, "cores").groupBy("t1", "t2").agg(F.collect_list(F.struct("k", "f", "a", "lo", "hi")).alias("es"))
    per_text = scratch.save(per_text, "per-text")  # beside it the rows of a text with many copies can be split
    keyed = with_text_key(docs.select("text").where(F.octet_length("text") >= span))
    around = scratch.save(around_cores(keyed, per_text, span, step).dropDuplicates(["k", "f", "p"]), "around")  # copies of a text are cut the same
    windows = scratch.save(window_names(repeated(around, ["k", "p", "s"], scratch, "runs"), step), "windows")
    some = repeated(windows, ["k", "d", "w"], scratch, "equal").groupBy("k", "f").agg(F.sort_array(F.collect_set("d")).alias("ds"))
    states = one_each.select("k", "f", "n").join(some, ["k", "f"], "left")
    states = states.select("k", "f", ((F.col("n") > 1) | F.col("ds").isNotNull()).alias("on"), F.when(F.col("n") == 1, F.col("ds")).alias("ds"))
    rows = found.join(scratch.save(states, "states"), ["k", "f"], "left")
    one = F.when(F.col("on") & (F.col("lo") >= 0), F.struct("a", "lo", "hi", "ds"))
    places = F.size(F.collect_set(F.struct("a", "lo")))  # a text of several pieces may have an anchor in two
    by = rows.groupBy("t1", "t2").agg(F.collect_set(one).alias("entries"), F.max("apart").alias("apart"), F.count("*").alias("n"), places.alias("m"))
    return scratch.save(by.select("t1", "t2", "entries", (F.col("apart") | (F.col("n") > F.col("m"))).alias("shares")), "texts")


def remove_repeats(docs: DataFrame, span: int = SPAN, reach: int = REACH, batches: int | None = None, digest: bool = False) -> DataFrame:
    """Per row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage``; without ``digest`` also ``kept`` (bytes) and
    ``runs`` (removed)."""
    scratch = Scratch(docs.sparkSession, "repeats")
    try:
        found = repeated_entries(docs, scratch, span, reach, batches)
        for name in ("hits", "found", "cores", "per-text", "one-each", "runs", "around", "equal", "windows", "states"):
            scratch.drop(name)
    except BaseException:
        scratch.drop()
        raise
    rows = with_text_key(docs.select("doc_id", "text")).join(found, ["t1", "t2"], "left").select("doc_id", "text", "entries", "shares")
    pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b, texts in text_slices(batches):
            runs = [removed_runs(e or [], span) for e in b.column("entries").to_pylist()]
            kept = [b"".join(t[a:e] for a, e in zip([0, *(y for _, y in r)], [*(x for x, _ in r), len(t)], strict=True)) if r else t for t, r in zip(texts, runs, strict=True)]
            new = {
                "n_bytes": pa.array(list(map(len, texts)), pa.int64()), "n_removed": pa.array([len(t) - len(x) for t, x in zip(texts, kept, strict=True)], pa.int64()),
                "n_spans": pa.array(list(map(len, runs)), pa.int64()), "kept_sha256": [hashlib.sha256(x).hexdigest() for x in kept],
                "shares_passage": pa.array([int(bool(x)) for x in b.column("shares").to_pylist()], pa.int32()),
            }
            if not digest:
                new |= {"kept": pa.array(kept, pa.binary()), "runs": pa.array([[{"start": a, "end": e} for a, e in r] for r in runs], pair)}
            yield with_columns(b, ["doc_id"], **new)

    schema = field_sql(docs, "doc_id") + ", n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, shares_passage int"
    return rows.mapInArrow(run, schema + ("" if digest else ", kept binary, runs array<struct<start:bigint,`end`:bigint>>"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
