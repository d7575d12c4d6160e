"""Toxicity by a chain of classifiers.

Categories are predicted one after the other, by linear (logistic) models over the presence of words and word beginnings;
each later model also gets the probabilities of the earlier categories. In training those are out-of-fold predictions, so
a later model sees them as unsure as they will be. The categories come from labels and languages, not from words: ``toxic_main`` (toxic, in the sample's most
frequent language), ``toxic_other`` (toxic, in another, whose marks are rarer) and ``toxic``, the label itself; a document is
rejected if the last probability reaches ``THRESHOLD`` (0.35: a toxic document kept counts as two clean ones lost). Languages only
tell which category a training row is of; they enter no score.

Models are fitted on the driver from at most ``SAMPLE`` labelled rows, the first in hash order; features are chosen from
the sample by their odds in each category. Scoring reads whole texts; a word's weights are looked up once per worker and word.

Defined cases: an empty table gives no rows; null and empty texts have no features and get the models' base rates, never rejected
for emptiness alone; without labelled rows, or with labels of one kind, probabilities are the base rates; repeated rows stay; labels
that are null or without a document teach nothing, of an id labelled twice the greatest labels count; features of equal strength go by
their hash; very long texts are read whole; extra columns play no part.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, hash_sample, table, text_slices, with_columns, word_slices

SAMPLE, FOLDS, FEATURES, RARE, CLEAR, SURE, THRESHOLD, CACHE = 8192, 4, 1024, 3, 3.0, 2.2, 0.35, 300_000
CATEGORIES = ("toxic_main", "toxic_other", "toxic")
_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[int]:
    """31-bit hashes of the word (odd) and of its first four and five letters where it has more (even)."""
    h = xxhash.xxh32_intdigest
    return [h(word) >> 2 << 1 | 1, *(h(word[:n]) >> 2 << 1 for n in (4, 5) if len(word) > n)]


def text_words(text: bytes) -> set[str]:
    found: set[str] = set()
    for part in word_slices(text):  # white space parts words here too
        found.update(_WORD.findall(part.decode("utf-8", "replace").lower()))
    return found


def text_features(text: bytes) -> np.ndarray:
    return np.unique(np.fromiter((f for w in text_words(text) for f in word_features(w)), np.int32))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z.clip(-30, 30)))


class Chain:
    """Weights by feature for every category, and of the earlier categories' probabilities."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: np.ndarray, links: np.ndarray):
        self.index = {x: i for i, x in enumerate(features.tolist())}
        self.weights, self.bias, self.links = np.vstack([weights, np.zeros(len(bias))]), bias, links
        self.known: dict[str, tuple[int, ...]] = {}

    def rows(self, words: set[str]) -> list[int]:
        found: set[int] = set()
        if len(self.known) > CACHE:
            self.known = {}
        for w in words:
            ids = self.known.get(w)
            if ids is None:
                ids = self.known[w] = tuple(self.index[f] for f in word_features(w) if f in self.index)
            if ids:
                found.update(ids)
        return sorted(found)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        z = np.empty((len(texts), len(self.bias)))
        for i, t in enumerate(texts):
            z[i] = self.bias + self.weights[self.rows(text_words(t))].sum(0)
        return self.chained(z)

    def chained(self, z: np.ndarray) -> np.ndarray:
        """Probabilities from the log-odds that the words alone give: each category adds what the ones before it say."""
        p = np.zeros_like(z)
        for k in range(z.shape[1]):
            p[:, k] = sigmoid(z[:, k] + p[:, :k] @ self.links[k, :k])
        return p


def fit_logistic(rows: np.ndarray, cols: np.ndarray, n: int, width: int, extra: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 25):
    """Logistic regression over sparse presence (rows, cols) and dense ``extra`` columns: weights, extra weights, bias.

    Conjugate-gradient Newton steps; deterministic.
    """
    m = extra.shape[1]

    def times(w):
        return np.bincount(rows, w[cols], n) + extra @ w[width : width + m] + w[-1]

    def back(r):
        return np.concatenate([np.bincount(cols, r[rows], width), extra.T @ r, [r.sum()]])

    w, pen = np.zeros(width + m + 1), np.full(width + m + 1, ridge)
    pen[width:] = 0.05
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3) if n else 0.5
    w[-1] = np.log(rate / (1 - rate))
    if n == 0 or y.min() == y.max():
        return w[:width], w[width:-1], w[-1]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-times(w).clip(-30, 30)))
        grad, curve = back(p - y) + pen * w, np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -grad
        d, rr = r.copy(), r @ r
        if rr < 1e-18:
            break
        for _ in range(25):
            hd = back(curve * times(d)) + pen * d
            a = rr / max(d @ hd, 1e-12)
            step, r = step + a * d, r - a * hd
            new = r @ r
            if new < 1e-6 * (grad @ grad) or new < 1e-18:
                break
            d, rr = r + d * new / rr, new
        size = 1.0
        loss = lambda v: np.logaddexp(0, -np.where(y > 0, 1, -1) * times(v)).sum() + 0.5 * (pen * v * v).sum()
        at = loss(w)
        while size > 1e-3 and loss(w + size * step) > at:
            size /= 2
        w = w + size * step
        if size * np.abs(step).max() < 1e-4:
            break
    return w[:width], w[width:-1], w[-1]


def fit_chain(texts: list[np.ndarray], main: np.ndarray, toxic: np.ndarray) -> Chain:
    """``texts``: the features of each labelled text; ``main``: whether it is in the main language; ``toxic``: its label."""
    n = len(texts)
    seen, counts = np.unique(np.concatenate([np.zeros(0, np.int32), *texts]), return_counts=True)
    seen, total = seen[counts >= RARE], counts[counts >= RARE].astype(float)
    toxic = toxic.astype(float)
    wanted = (toxic * main, toxic * ~main, toxic)
    rows, cols = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, ids in enumerate(texts):
        at = np.minimum(np.searchsorted(seen, ids), max(len(seen) - 1, 0)).astype(np.int32)
        cols.append(at[seen[at] == ids] if len(seen) else at[:0])
        rows.append(np.full(len(cols[-1]), i, np.int32))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    of = np.zeros((3, len(seen)), bool)  # features of each category's model: only clear marks, as a frequent word with slight odds would outweigh one rare insult
    for k, y in enumerate(wanted):
        on = np.bincount(cols, y[rows], len(seen))
        log = np.log((on + 0.5) / (y.sum() + 1)) - np.log((total - on + 0.5) / (n - y.sum() + 1))
        strength = np.abs(log) * np.sqrt(np.maximum(on, total * (y.sum() / max(n, 1))))
        sure = log / np.sqrt(1 / (on + 0.5) + 1 / (total - on + 0.5))  # in standard errors: few rows must not make a mark
        order = np.argsort(-strength, kind="stable")
        of[k, order[(log[order] >= CLEAR) & (sure[order] >= SURE) & (on[order] >= RARE)][: FEATURES // 2]] = True
    used = np.flatnonzero(of.any(0))
    number = np.full(len(seen), -1)
    number[used] = np.arange(len(used))
    on = number[cols] >= 0 if len(cols) else np.zeros(0, bool)
    all_rows, all_cols, names, of = rows[on], number[cols[on]], seen[used], of[:, used]
    folds = np.arange(n) % FOLDS
    weights, bias, links = np.zeros((len(names), 3)), np.zeros(3), np.zeros((3, 3))
    earlier = np.zeros((n, 0))  # out-of-fold probabilities of the categories before
    for k, y in enumerate(wanted):
        mine = of[k][all_cols] if len(all_cols) else np.zeros(0, bool)
        rows, cols = all_rows[mine], all_cols[mine]
        w, e, b = fit_logistic(rows, cols, n, len(names), earlier, y)
        weights[:, k], bias[k], links[k, :k] = w, b, e
        out = np.zeros(n)
        for fold in range(FOLDS):
            fit_on = folds != fold
            renumber = np.cumsum(fit_on) - 1
            on = fit_on[rows] if len(rows) else np.zeros(0, bool)
            wf, ef, bf = fit_logistic(renumber[rows[on]], cols[on], int(fit_on.sum()), len(names), earlier[fit_on], y[fit_on])
            z = np.bincount(rows, wf[cols], n) + earlier @ ef + bf if n else np.zeros(0)
            out[~fit_on] = sigmoid(z[~fit_on])
        earlier = np.column_stack([earlier, out])
    return Chain(names, weights, bias, links)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Chain:
    known = labels.select("doc_id", F.nanvl(F.col("toxic").cast("double"), F.lit(None).cast("double")).alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    chosen = hash_sample(known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", sample)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        for b, texts in text_slices(batches):
            yield with_columns(b, ["doc_id", "lang", "toxic"], features=pa.array([text_features(t).tobytes() for t in texts], pa.binary()))

    rows = docs.select("doc_id", lang.alias("lang"), "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "lang", "toxic", "text")  # the limit bounds the broadcast
    found = rows.mapInArrow(run, field_sql(docs, "doc_id") + ", lang string, toxic double, features binary").groupBy("doc_id")
    got = found.agg(F.min(F.struct("features", "lang", "toxic")).alias("r")).select("r.*").collect()  # one row of each id, ``sample`` at most
    got.sort(key=lambda r: (xxhash.xxh64_intdigest(bytes(r["features"])), r["toxic"], r["lang"] or ""))
    langs = Counter(r["lang"] for r in got)
    main = min(langs, key=lambda x: (-langs[x], x or ""), default=None)
    return fit_chain(
        [np.frombuffer(r["features"], np.int32) for r in got], np.array([r["lang"] == main for r in got], bool), np.array([r["toxic"] > 0.5 for r in got], float)
    )


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD, keep: bool = False) -> DataFrame:
    """Probabilities of all categories and ``rejected`` per row; with ``keep``, instead the rows of ``docs`` that are not rejected."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample))

    def run(batches):
        chain = model.value
        for b, texts in text_slices(batches):
            p = chain.probabilities(texts)
            if keep:
                yield b.filter(pa.array(p[:, -1] < threshold))
            else:
                yield with_columns(b, ["doc_id"], **{f"p_{c}": pa.array(p[:, k]) for k, c in enumerate(CATEGORIES)}, rejected=pa.array((p[:, -1] >= threshold).astype(np.int32)))

    if keep:
        return docs.mapInArrow(run, docs.schema)
    return docs.select("doc_id", "text").mapInArrow(run, field_sql(docs, "doc_id") + "".join(f", p_{c} double" for c in CATEGORIES) + ", rejected int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
