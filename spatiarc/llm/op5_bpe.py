"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent pre-tokens of the corpus are encoded once and compiled into a minimal acyclic automaton (states with equal
futures are shared). Each arc carries how many words are passed over by taking it, so the sum along a word's path is its
number in sorted order, and that number points at its ids. The automaton is one file of flat arrays which Spark hands to
every executor and which the Python workers memory-map, so workers of a machine share its pages. Words it lacks are merged
exactly, by rank. Its size is bounded by ``LEXICON`` words; the bound decides speed, never ids.

Defined cases: a null text is empty (no ids; decodes to the empty text); an empty table gives no rows; very long texts are split
and encoded whole, a very long pre-token by a heap of its pairs; pairs of equal rank merge from the left; the special token's string in a text becomes its
id, as in the tokenizers library; repeated rows are rows; other columns, nulls among them, play no part.
"""

from __future__ import annotations

import atexit
import hashlib
import heapq
import json
import os
import shutil
import tempfile
from collections import Counter

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spatiarc.llm.common import field_sql, table, text_slices, with_columns, word_slices
from spatiarc.plans.scratch import Scratch

LEXICON, LONGEST, LONG, CACHE = 65_536, 48, 64, 300_000
LONG_TEXT = 1 << 20
_CUT = regex.compile(r"(?<=\S) (?=\p{L})")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in vocabulary files of this kind."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Bytes of each id, the ids of merges by their two parts, and special strings, from a tokenizers file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = json.load(f)
        letters = byte_letters()
        plain = lambda s: bytes(letters[c] for c in s)
        ids = {plain(k): v for k, v in raw["model"]["vocab"].items() if all(c in letters for c in k)}
        self.special = {x["content"]: x["id"] for x in raw.get("added_tokens", [])}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for k, v in ids.items():
            self.bytes_of[v] = k
        for k, v in self.special.items():
            self.bytes_of[v] = k.encode()
        self.single = [ids[bytes([b])] for b in range(256)]
        self.merges = {}
        self.made = []  # by rank
        for rank, pair in enumerate(raw["model"]["merges"]):
            a, b = (plain(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[ids[a] << 20 | ids[b]] = rank
            self.made.append(ids[a + b])
        self._tables()
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    def _tables(self) -> None:
        self.pairs = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[k] for k in self.pairs.tolist()], np.int64)
        self.of_rank, self.single_of = np.array(self.made, np.int64), np.array(self.single, np.int64)
        self.last = len(self.made)
        self.byte_rank = self._rank(np.repeat(self.single_of, 256), np.tile(self.single_of, 256))

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        want = a << 20 | b
        i = np.minimum(np.searchsorted(self.pairs, want), len(self.pairs) - 1)
        return np.where(self.pairs[i] == want, self.ranks[i], self.last)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """Ids of each pre-token as little-endian unsigned 32-bit integers. The lowest rank of a word merges first, leftmost
        of equals; in each round every word that is not done makes one merge, all of them together."""
        out: list[bytes] = [b""] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = np.array(self.merge(w), "<u4").tobytes()
        todo = [i for i, w in enumerate(words) if 0 < len(w) <= LONG]
        if not todo or not len(self.pairs):
            for i in todo:
                out[i] = self.single_of[np.frombuffer(words[i], np.uint8)].astype("<u4").tobytes()
            return out
        raw = np.frombuffer(b"".join([words[i] for i in todo]), np.uint8).astype(np.int64)
        who, sizes = np.array(todo), np.array([len(words[i]) for i in todo], np.int64)
        ids = self.single_of[raw]
        rank = np.full(len(ids), self.last)
        rank[:-1] = self.byte_rank[raw[:-1] * 256 + raw[1:]]
        while len(who):
            ends = np.cumsum(sizes)
            starts = ends - sizes
            rank[ends - 1] = self.last
            low = np.minimum.reduceat(rank, starts)
            done = low == self.last
            if done.any():
                gone = np.repeat(done, sizes)
                blob, at = ids[gone].astype("<u4").tobytes(), 0
                for i, n in zip(who[done].tolist(), (4 * sizes[done]).tolist(), strict=True):
                    out[i] = blob[at : at + n]
                    at += n
                who, sizes, low, ids, rank = who[~done], sizes[~done], low[~done], ids[~gone], rank[~gone]
                if not len(who):
                    break
                ends = np.cumsum(sizes)
                starts = ends - sizes
            places = np.flatnonzero(rank == np.repeat(low, sizes))
            owner = np.searchsorted(ends, places, side="right")
            first = places[np.concatenate(([True], owner[1:] != owner[:-1]))]
            ids[first] = self.of_rank[low]
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            ids, rank, sizes = ids[keep], rank[keep], sizes - 1
            first = first - np.arange(len(first))  # where they are after the removals before them
            ends = np.cumsum(sizes)
            starts = ends - sizes
            for at in (first[first < ends - 1], first[first > starts] - 1):
                rank[at] = self._rank(ids[at], ids[at + 1])
        return out

    def merge(self, word: bytes) -> list[int]:
        """The same for one pre-token, with a heap of candidate pairs, so that a long run stays near-linear."""
        ids, rank = [self.single[b] for b in word], self.merges.get
        n = len(ids)
        right, left, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := rank(ids[i] << 20 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            if not alive[i] or ids[i] != a or (j := right[i]) >= n or ids[j] != b:
                continue
            ids[i], alive[j], right[i] = self.made[m], False, right[j]
            if right[j] < n:
                left[right[j]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := rank(ids[x] << 20 | ids[y])) is not None:
                    heapq.heappush(heap, (m, x, ids[x], ids[y]))
        return [x for x, on in zip(ids, alive, strict=True) if on]


def compile_lexicon(words: dict[bytes, list[int]]) -> dict[str, np.ndarray]:
    """Arrays of the minimal automaton of ``words``: arcs by (state, byte), words passed over, finals, and ids by number."""
    register: dict[tuple, int] = {}
    total: list[int] = []  # words from each state on
    arcs_of: list[tuple] = []
    final_of: list[bool] = []

    def freeze(node) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(total)
            total.append(node[0] + sum(total[t] for _, t in node[1]))
            arcs_of.append(key[1])
            final_of.append(node[0])
        return register[key]

    path, last = [[False, []]], b""  # open nodes along the last word; sorted order closes a branch for good
    for word in [*sorted(words), None]:
        keep = len(os.path.commonprefix([last, word])) if word is not None else 0
        while len(path) > keep + 1:
            done = freeze(path.pop())
            path[-1][1].append((last[len(path) - 1], done))
        if word is not None:
            path += [[False, []] for _ in word[keep:]]
            path[-1][0], last = True, word
    root = freeze(path[0])
    keys, to, skip = [], [], []
    for state, arcs in enumerate(arcs_of):
        over = int(final_of[state])
        for byte, target in arcs:
            keys.append(state * 256 + byte), to.append(target), skip.append(over)
            over += total[target]
    listed = [words[w] for w in sorted(words)]
    return {
        "keys": np.array(keys, np.int64), "to": np.array(to, np.int32), "skip": np.array(skip, np.int32), "final": np.array(final_of, np.uint8),
        "root": np.array([root], np.int64), "at": np.cumsum([0, *map(len, listed)]).astype(np.int64), "ids": np.array([i for x in listed for i in x], np.uint32),
    }


def write_arrays(arrays: dict[str, np.ndarray], path: str) -> None:
    """One file: a line of JSON that says where each array lies, then the arrays."""
    where, at = {}, 0
    for k, v in arrays.items():
        where[k] = [at, v.dtype.str, len(v)]
        at += -(-v.nbytes // 16) * 16
    head = json.dumps(where).encode()
    head += b" " * (-(len(head) + 1) % 16) + b"\n"
    with open(path, "wb") as f:
        f.write(head)
        for v in arrays.values():
            f.write(v.tobytes() + bytes(-v.nbytes % 16))


def map_arrays(path: str) -> dict[str, np.ndarray]:
    with open(path, "rb") as f:
        start, where = len(head := f.readline()), json.loads(head)
    return {k: np.memmap(path, np.dtype(t), "r", start + at, (n,)) if n else np.zeros(0, t) for k, (at, t, n) in where.items()}


def lookup(lexicon: dict[str, np.ndarray], words: list[bytes]) -> np.ndarray:
    """The number of each word in the automaton or -1; all words step along their arcs together."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    number, state = np.zeros(len(words), np.int64), np.full(len(words), int(lexicon["root"][0]))
    flat, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    keys, on = lexicon["keys"], np.flatnonzero(sizes > 0)
    step = 0
    while len(on):
        want = state[on] * 256 + flat[at[on] + step]
        i = np.minimum(np.searchsorted(keys, want), max(len(keys) - 1, 0)) if len(keys) else np.zeros(len(on), int)
        ok = keys[i] == want if len(keys) else np.zeros(len(on), bool)
        state[on[~ok]] = -1
        on, i = on[ok], i[ok]
        state[on], number[on] = lexicon["to"][i], number[on] + lexicon["skip"][i]
        step += 1
        on = on[sizes[on] > step]
    good = state >= 0
    good[good] = lexicon["final"][state[good]] > 0
    return np.where(good, number, -1)


def text_pieces(text: str, most: int = 1 << 19) -> list[str]:
    """A text in pieces of about ``most`` characters, cut before a space that follows a non-space and leads a letter: there the
    pattern always begins a pre-token, and no special string holds a space."""
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        found = _CUT.search(text, at + most) if at + most < len(text) else None
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class Encoder:
    """Pre-tokens to ids: a cache of the worker, then the automaton, then exact merges."""

    def __init__(self, vocabulary: Vocabulary, lexicon: dict[str, np.ndarray] | None):
        self.v, self.lexicon, self.known = vocabulary, lexicon, {}
        self.find = regex.compile(PATTERN).findall

    def learn(self, words: set[str]) -> None:
        """Put ids of all ``words`` in the cache, which starts anew when it would hold over ``CACHE`` words besides."""
        fresh = [w for w in words if w not in self.known]
        if len(self.known) + len(fresh) > CACHE:
            self.known, fresh = {}, list(words)
        raw = [w.encode() for w in fresh]
        numbers = lookup(self.lexicon, raw).tolist() if self.lexicon is not None and fresh else [-1] * len(fresh)
        unseen = [(w, b) for w, b, i in zip(fresh, raw, numbers, strict=True) if i < 0]
        if len(unseen) < len(fresh):
            on, at, ids = np.array([i for i in numbers if i >= 0]), self.lexicon["at"], memoryview(self.lexicon["ids"]).cast("B")
            found = zip((w for w, i in zip(fresh, numbers, strict=True) if i >= 0), (4 * at[on]).tolist(), (4 * at[on + 1]).tolist(), strict=True)
            self.known.update((w, bytes(ids[a:e])) for w, a, e in found)
        self.known.update(zip((w for w, _ in unseen), self.v.merge_all([b for _, b in unseen]), strict=True))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; a long text piece by piece."""
        if all(len(t) <= LONG_TEXT for t in texts):
            return self._encode(texts)
        return [b"".join(self._encode([p])[0] for p in text_pieces(t)) for t in texts]

    def _encode(self, texts: list[str]) -> list[bytes]:
        """Words that are new to the worker are looked up together."""
        special = lambda t: self.v.split is not None and any(s in t for s in self.v.special)
        parts = [[(p, p in self.v.special) for p in self.v.split.split(t) if p] if special(t) else [(t, False)] for t in texts]
        split = [[[p] if mark else self.find(p) for p, mark in ps] for ps in parts]
        words: set[str] = set()
        for ps, ws in zip(parts, split, strict=True):
            for (_, mark), w in zip(ps, ws, strict=True):
                if not mark:
                    words.update(w)
        self.learn(words)
        get = self.known.__getitem__
        out = []
        for ps, ws in zip(parts, split, strict=True):
            done = [self.v.special[p].to_bytes(4, "little") if mark else b"".join(map(get, w)) for (p, mark), w in zip(ps, ws, strict=True)]
            out.append(done[0] if len(done) == 1 else b"".join(done))
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        get = self.v.bytes_of.__getitem__
        parts = [b"".join(map(get, np.frombuffer(ids[a : a + (1 << 20)], "<u4").tolist())) for a in range(0, len(ids), 1 << 20)]
        return b"".join(parts).decode("utf-8", "replace")


_OPEN: dict[tuple, Encoder] = {}


def _encoder(vocabulary: str, lexicon: str) -> Encoder:
    key = (vocabulary, lexicon)
    if key not in _OPEN:
        _OPEN[key] = Encoder(Vocabulary(SparkFiles.get(vocabulary)), map_arrays(SparkFiles.get(lexicon)))
    return _OPEN[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """Space-led runs of letters and of digits, of at most ``LONGEST`` bytes, with their counts over all texts.

    These are the pre-tokens that repeat; counting runs between white space that are wholly one is cheaper than
    splitting by the full pattern, and which words the lexicon holds never changes an id.
    """

    def counted(counts):
        kept = [(w, n) for w, n in counts.items() if len(w) < LONGEST and word(w)]
        words = pa.array([b" " + w for w, _ in kept], pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

    def word(w: bytes) -> bool:
        if w.isascii():
            return w.isalpha() or w.isdigit()
        try:
            text = w.decode()
        except UnicodeDecodeError:
            return False
        return text.isalpha() or text.isdecimal()

    def run(batches):
        counts: Counter = Counter()
        for _, texts in text_slices(batches):
            for t in texts:
                for part in word_slices(t):
                    counts.update(part.split())
            if len(counts) > CACHE:
                yield counted(counts)
                counts.clear()
        yield counted(counts)

    return docs.select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, size: int, least: int = 2) -> list[tuple[str, int]]:
    """At most ``size`` words with their counts, those that occur most and at least ``least`` times. A histogram of bounded size tells
    the level of counts that is cut; of the words at that level those first in order of the alphabet are taken."""
    scratch = Scratch(docs.sparkSession, "words")
    try:
        words = scratch.save(word_counts(docs).where(F.col("n") >= least), "words").withColumn("level", F.floor(F.log2("n") * 64).cast("int"))
        histogram = sorted(((r.level, r.m) for r in words.groupBy("level").agg(F.count("*").alias("m")).collect()), reverse=True)  # under 64 x 64 rows
        whole, total, cut = [], 0, None
        for level, m in histogram:
            if total + m > size:
                cut = level
                break
            whole, total = [*whole, level], total + m
        got = [(r.word, r.n) for r in words.where(F.col("level") >= whole[-1]).select("word", "n").collect()] if whole else []
        if cut is not None and total < size:
            got += [(r.word, r.n) for r in words.where(F.col("level") == cut).orderBy("word").limit(size - total).select("word", "n").collect()]
        return sorted(got)
    finally:
        scratch.drop()


def share_lexicon(docs: DataFrame, tokenizer: str, size: int = LEXICON) -> tuple[str, str]:
    """Compile the most frequent words, at most ``size``, and give both files to all executors; returns their names there."""
    spark = docs.sparkSession
    top = [w for w, _ in frequent_words(docs, size)]
    v = Vocabulary(tokenizer)
    folder = tempfile.mkdtemp(prefix="spatiarc-lexicon-")  # the driver's; Spark copies the file to executors, new ones too
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "lexicon.bin")
    write_arrays(compile_lexicon({w.encode(): v.merge(w.encode()) for w in top}), path)
    with open(path, "rb") as f:
        name = f"lexicon-{hashlib.sha256(f.read()).hexdigest()[:16]}.bin"
    os.rename(path, named := os.path.join(folder, name))
    for shared in (named, tokenizer):
        if not any(x.rsplit("/", 1)[-1] == os.path.basename(shared) for x in spark.sparkContext.listFiles):  # an equal lexicon is there already
            spark.sparkContext.addFile(shared)
    return os.path.basename(tokenizer), name


def encode_documents(docs: DataFrame, tokenizer: str, with_ids: bool = False, lexicon_size: int = LEXICON) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``; with ``with_ids`` also ``ids`` (array) and ``decoded``."""
    names = share_lexicon(docs, tokenizer, lexicon_size)

    def run(batches):
        encoder = _encoder(*names)
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for b, texts in text_slices(batches):
            ids = encoder.encode_all([t.decode("utf-8", "replace") for t in texts])
            texts = [encoder.decode(x) for x in ids]
            new = {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": list(map(sha, ids)), "decoded_sha256": [sha(t.encode()) for t in texts]}
            if with_ids:
                new |= {"ids": pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in ids], pa.list_(pa.int32())), "decoded": texts}
            yield with_columns(b, ["doc_id"], **new)

    schema = field_sql(docs, "doc_id") + ", n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())
