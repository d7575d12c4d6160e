"""Greedy word-piece lengths with a linear longest-match automaton.

The vocabulary is a trie. A node that no longer matches fails over to the node of what is left after its longest-match
pieces are popped; how many it pops is computed once with the link. A word's length in pieces is the sum of popped counts
along its bytes plus what its last node still pops, so each byte is read once and no piece is ever built. Distinct words
of a batch walk the automaton together.

A word is a maximal run of bytes other than white space, with the mark of a word's start before it. A word that pieces
cannot cover counts as one unknown piece (with all single bytes in the vocabulary there is none).

Defined cases: null and empty texts have 0 tokens; an empty table gives no rows; very long texts are counted slice by slice; of pieces
that match, the longest is taken, so there are no ties; repeated rows stay; other columns, nulls among them, play no part.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from spatiarc.llm.common import field_sql, table, text_slices, with_columns, word_slices
from spatiarc.llm.op5_bpe import byte_letters, tokenizer_path

CACHE, STUCK, LONG = 300_000, 1 << 40, 1 << 20


class LongestMatch:
    def __init__(self, pieces: list[bytes]):
        kids: list[dict[int, int]] = [{}]
        token, parent, by = [False], [0], [0]
        for piece in pieces:
            node = 0
            for byte in piece:
                nxt = kids[node].get(byte)
                if nxt is None:
                    nxt = kids[node][byte] = len(kids)
                    kids.append({}), token.append(False), parent.append(node), by.append(byte)
                node = nxt
            token[node] = bool(piece)
        n = len(kids)
        fail, popped = [-1] * n, [0] * n
        queue = list(kids[0].values())
        for v in queue:
            queue.extend(kids[v].values())
            if token[v]:
                fail[v], popped[v] = 0, 1
                continue
            z, count = fail[parent[v]], popped[parent[v]]
            while z >= 0 and by[v] not in kids[z]:
                count, z = count + popped[z], fail[z]
            if z >= 0:
                fail[v], popped[v] = kids[z][by[v]], count
        self.fail, self.popped = np.array(fail), np.array(popped, np.int64)
        end = [0] * n  # what is popped when a word ends at a node
        for v in queue:
            end[v] = STUCK if fail[v] < 0 else min(STUCK, popped[v] + end[fail[v]])
        self.end = np.array(end, np.int64)
        self.keys = np.array(sorted(p * 256 + b for p, b in zip(parent[1:], by[1:], strict=True)), np.int64)
        self.to = np.array([kids[k >> 8][k & 255] for k in self.keys.tolist()], np.int64)

    def lengths(self, words: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat, at = np.frombuffer(b"".join(words), np.uint8), np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
        node, count, step = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        on = np.flatnonzero(sizes > 0)
        while len(on) and len(self.keys):
            want = node[on] * 256 + flat[at[on] + step[on]]
            i = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
            ok = self.keys[i] == want
            go, back = on[ok], on[~ok]
            node[go] = self.to[i[ok]]
            step[go] += 1
            count[back] += self.popped[node[back]]
            node[back] = self.fail[node[back]]
            stuck = back[node[back] < 0]
            node[stuck], step[stuck], count[stuck] = 0, sizes[stuck], STUCK
            on = on[step[on] < sizes[on]]
        if not len(self.keys):
            count[sizes > 0] = STUCK
        count += self.end[node]
        return np.where(count >= STUCK, 1, count)


_OPEN: dict[str, LongestMatch] = {}


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file as bytes; its mark of a word's start is the space byte."""
    letters = byte_letters()
    with open(path, encoding="utf-8") as f:
        words = json.load(f)["model"]["vocab"]
    return [bytes(letters[c] for c in w) for w in words if all(c in letters for c in w)]


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row."""
    name = tokenizer.rsplit("/", 1)[-1]
    if not any(x.rsplit("/", 1)[-1] == name for x in docs.sparkSession.sparkContext.listFiles):
        docs.sparkSession.sparkContext.addFile(tokenizer)

    def run(batches):
        if name not in _OPEN:
            _OPEN[name] = LongestMatch(vocabulary(SparkFiles.get(name)))
        known: dict[bytes, int] = {}

        def counted(known, parts, counts):
            """Add the tokens of split texts; words new to the worker walk the automaton together."""
            fresh = list({w for _, ws in parts for w in ws if w not in known})
            if len(known) + len(fresh) > CACHE:
                known.clear()
                fresh = list({w for _, ws in parts for w in ws})
            known.update(zip(fresh, _OPEN[name].lengths([b" " + w for w in fresh]).tolist(), strict=True))
            for i, ws in parts:
                counts[i] += sum(map(known.__getitem__, ws))

        for b, texts in text_slices(batches):
            words, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            parts = [(i, part.split()) for i, t in enumerate(texts) if len(t) <= LONG for part in (t,)]
            for i, split in parts:
                words[i] = len(split)
            counted(known, parts, counts)
            for i, t in enumerate(texts):
                for part in word_slices(t) if len(t) > LONG else ():
                    words[i] += len(split := part.split())
                    counted(known, [(i, split)], counts)
            yield with_columns(b, ["doc_id"], n_words=pa.array(words), n_tokens=pa.array(counts))

    return docs.select("doc_id", "text").mapInArrow(run, field_sql(docs, "doc_id") + ", n_words bigint, n_tokens bigint")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
