"""Quality by nearest-neighbour voting in a latent-semantic space.

A text becomes hashed counts of its byte trigrams (log, inverse document frequency, unit length) beside measures of its
form (letters, symbols, repeated words and lines, ...), each scaled by what is usual; truncated singular vectors fitted on
the labelled sample turn both into one latent unit vector. The labelled vectors, at most ``SAMPLE`` of them, are broadcast;
for every document exact cosines with all of them are computed block by block, and its ``NEIGHBOURS`` nearest vote with
their labels, weighted by similarity. Labels are learned only from rows whose crc32(doc_id) mod 5 is not 0; nothing but
the text enters a score.

Defined cases: null and empty texts have the zero form and score what their neighbours give; an empty table gives no rows; without
labelled rows every score is 0.5; of neighbours tied at the last place those first in the sample's order vote; very long texts are
counted whole; repeated rows stay; labels without a document, or null, teach nothing; extra columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, hash_sample, table, text_slices, with_columns, word_slices

SAMPLE, BUCKETS, RANK, NEIGHBOURS, POWER, THRESHOLD, FORM_WEIGHT = 4096, 4096, 64, 15, 8.0, 0.3, 2.0
_CLASS = np.zeros(256, np.int64)  # 0 other symbols, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 plain punctuation, 7 beyond ASCII
for _chars, _k in ((range(97, 123), 1), (range(65, 91), 2), (range(48, 58), 3), (b" \t", 4), (b"\n\r", 5), (b".,;:'\"-()?", 6), (range(128, 256), 7)):
    _CLASS[list(_chars)] = _k


def trigrams(text: bytes, most: int = 1 << 20) -> np.ndarray:
    out = np.zeros(BUCKETS, np.int64)
    for a in range(0, max(len(text) - 2, 0), most):
        b = np.frombuffer(text, np.uint8, min(most + 2, len(text) - a), a).astype(np.uint32)
        mixed = (((b[:-2] << 16) | (b[1:-1] << 8) | b[2:]) * np.uint32(2654435761)) >> np.uint32(32 - 12)
        out += np.bincount(mixed, minlength=BUCKETS)
    return out.astype(np.float32)


def form(text: bytes, grams: np.ndarray) -> list[float]:
    """Measures of form: shares of character classes, repeats of words and lines, lengths. Words and lines are told apart by 64-bit
    hashes, eight bytes each, so a long text needs no list of its words."""
    shares = np.zeros(8)
    for a in range(0, len(text), 1 << 20):
        shares += np.bincount(_CLASS, np.bincount(np.frombuffer(text[a : a + (1 << 20)], np.uint8), minlength=256), minlength=8)
    shares /= max(len(text), 1)
    h, hashes, short, length = xxhash.xxh3_64_intdigest, [np.zeros(0, np.uint64)], 0, 0
    for part in word_slices(text):
        words = part.split()
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        short, length = short + int((sizes < 3).sum()), length + int(sizes.sum())
        hashes.append(np.fromiter(map(h, words), np.uint64, len(words)))
    words = np.concatenate(hashes)
    lines = [h(x) for x in text.split(b"\n") if x]
    n, distinct = max(len(words), 1), len(np.unique(words))
    pairs = words[1:] * np.uint64(0x9E3779B97F4A7C15) + words[:-1]
    total = max(float(grams.sum()), 1.0)
    return [
        *np.sqrt(shares).tolist(), np.log(distinct + 1) / np.log(n + 2), float((words[1:] == words[:-1]).sum()) / n, short / n, min(length / n, 40.0) / 10,
        len(set(lines)) / max(len(lines), 1), np.log1p(len(lines)) - np.log1p(n), np.log1p(n) / 4, float((grams > 0).sum()) / min(total, BUCKETS),
        float(grams.max()) / total, len(np.unique(pairs)) / n,
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    grams = np.stack([trigrams(t) for t in texts]) if texts else np.zeros((0, BUCKETS), np.float32)
    forms = np.array([form(t, g) for t, g in zip(texts, grams, strict=True)], np.float32)
    return grams, forms


class Latent:
    """The latent space of labelled rows and their vectors in it."""

    def __init__(self, grams: np.ndarray, forms: np.ndarray, labels: np.ndarray, rank: int = RANK, seed: int = 7):
        self.idf = np.log((1 + len(grams)) / (1 + (grams > 0).sum(0))).astype(np.float32)
        self.mean, self.std = forms.mean(0), forms.std(0) + 1e-3
        x = self.weigh(grams, forms)
        rng = np.random.default_rng(seed)
        y = x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32)
        for _ in range(3):  # subspace iteration for the leading right singular vectors
            y = np.linalg.qr(x @ (x.T @ np.linalg.qr(y)[0]))[0]
        self.axes = np.ascontiguousarray(np.linalg.svd(y.T @ x, full_matrices=False)[2][:rank].T).astype(np.float32)
        self.vectors, self.labels = self.unit(x @ self.axes), labels.astype(np.float32)

    def weigh(self, grams, forms):
        g = np.log1p(grams) * self.idf
        g /= np.maximum(np.linalg.norm(g, axis=1, keepdims=True), 1e-9)
        f = np.clip((forms - self.mean) / self.std, -6, 6) * np.float32(FORM_WEIGHT / np.sqrt(forms.shape[1]))
        return np.concatenate([g, f], axis=1).astype(np.float32)

    @staticmethod
    def unit(x):
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def score(self, grams: np.ndarray, forms: np.ndarray, block: int = 512) -> np.ndarray:
        """Label votes of the nearest, weighted by a power of similarity, in [0, 1]."""
        out = np.empty(len(grams))
        k = min(NEIGHBOURS, len(self.labels))
        for a in range(0, len(grams), block):
            z = self.unit(self.weigh(grams[a : a + block], forms[a : a + block]) @ self.axes)
            cos = z @ self.vectors.T
            near = nearest(cos, k)
            w = np.maximum(np.take_along_axis(cos, near, 1), 1e-3).astype(np.float64) ** POWER
            out[a : a + block] = np.clip((w * self.labels[near]).sum(1) / w.sum(1), 0, 1)
        return out


def nearest(cos: np.ndarray, k: int) -> np.ndarray:
    """The columns of the ``k`` greatest cosines of each row; of those tied at the kth, the first columns."""
    near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
    kth = np.take_along_axis(cos, near, 1).min(1)
    for i in np.flatnonzero((cos >= kth[:, None]).sum(1) > k):
        above = np.flatnonzero(cos[i] > kth[i])
        near[i] = np.concatenate([above, np.flatnonzero(cos[i] == kth[i])[: k - len(above)]])
    return near


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Latent | None:
    """A latent space from at most ``sample`` labelled rows, the first in hash order."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL AND NOT isnan(quality)")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = hash_sample(known, "doc_id", sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # the limit bounds the broadcast

    def run(batches):
        for b, texts in text_slices(batches):
            grams, forms = features(texts)
            packed = [zlib.compress(g.astype("<f4").tobytes(), 1) for g in np.concatenate([grams, forms], 1)]
            yield with_columns(b, ["doc_id", "quality"], packed=pa.array(packed, pa.binary()))

    found = rows.select("doc_id", "quality", "text").mapInArrow(run, field_sql(docs, "doc_id") + ", quality double, packed binary")
    got = found.groupBy("doc_id").agg(F.first("quality").alias("quality"), F.min("packed").alias("packed")).select("quality", "packed").toPandas()  # one row of each id, ``sample`` at most
    if not len(got):
        return None
    order = np.lexsort((got["packed"].map(hash_bytes).to_numpy(), got["quality"].to_numpy()))
    x = np.stack([np.frombuffer(zlib.decompress(p), "<f4") for p in got["packed"]])[order]
    return Latent(x[:, :BUCKETS], x[:, BUCKETS:], got["quality"].to_numpy()[order] > 0.5)


def hash_bytes(x: bytes) -> int:
    return xxhash.xxh64_intdigest(x) >> 1


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        latent = model.value
        for b, texts in text_slices(batches):
            scores = latent.score(*features(texts)) if latent is not None else np.full(len(texts), 0.5)
            yield with_columns(b, ["doc_id"], score=pa.array(scores, pa.float64()), predicted=pa.array((scores >= threshold).astype(np.int32)))

    scored = docs.select("doc_id", "text").mapInArrow(run, field_sql(docs, "doc_id") + ", score double, predicted int")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
