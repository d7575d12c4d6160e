"""Secret scans: fixed patterns, and a password guess-cost dynamic program over values in credential contexts.

Base spans are the matches of three patterns. The method adds spans of kind ``guess``: values that stand after a credential
word (a wider set than the base pattern's, with any non-space characters, after a sign or "is"), past the scheme ``Bearer`` if it
comes first, or before the host of an address, and whose guess cost is at least ``10 ** GUESSES``. The cost of a value is that
of its cheapest segmentation into words, dates, repeats, keyboard walks, separators and brute-force spans: the sum of log10
guesses of the spans, plus log10 of the factorial of how many there are (separators apart), since an attacker must also try
the orders. Base spans stay whatever they cost.

Words cost their rank in a dictionary by frequency: the fixed parts of passwords first, then the words of a public vocabulary in
its order, then words that the scanned texts hold at least ``COMMON`` times, at most ``DICTIONARY`` of them. So ordinary words, of
any language that the corpus is in, aren't taken for secrets.

The program keeps only the ends of segmentations that cost less than its bound, so it looks a few dozen characters past the last
cheap span, whatever the length of a value.

Defined cases: null and empty texts have no spans; an empty table gives no rows; spans are half-open in code points, found in
whole texts of any length; of equal starts, base spans come first; repeated rows stay; other columns, nulls among them, play no part.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spatiarc.llm.common import field_sql, table, text_slices, with_columns
from spatiarc.llm.op5_bpe import byte_letters, frequent_words, tokenizer_path

GUESSES, SHORTEST, DICTIONARY, COMMON, LONGEST, FAR = 12.0, 6, 30_000, 25, 24, 40.0
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|bearer)"""
    r"""["']?(?:\x20*(?::|=>?)\x20*|\x20+(?:is|was)\x20+)["'`]?(?:Bearer\x20+["'`]?)?+|\bBearer\x20+["'`]?)([^\s"'`<>,;]{6,})""",
    re.I | re.A,
)
ADDRESS = re.compile(r"://[^\s:@/]{1,64}:([^\s@/]{6,256})@")
#: One of these is in every text that the two patterns above can match; a plain search for them is cheaper.
HINTS = ("pass", "pwd", "secret", "token", "api", "key", "credential", "auth", "bearer")
#: Frequent parts of passwords, most frequent first.
WORDS = """password 123456 qwerty admin letmein welcome monkey dragon master login hello freedom secret summer winter spring
autumn shadow sunshine princess football baseball superman batman trustno love michael jordan hunter ranger buster soccer
hockey killer george andrew charlie thomas access test pass user root guest changeme default example token key value
company server database service public private system oracle mysql postgres cloud data office home computer internet
january february march april june july august september october november december monday friday sunday""".split()
#: Rows of a keyboard.
ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_RANK = {w: i + 1 for i, w in enumerate(WORDS)}
_LEET = str.maketrans("@4310$5!7", "aaeiossit")
_SEPARATORS, _SEPARATOR_COST = "-_./ ", math.log10(5)
_NEAR = {}
for _r, _row in enumerate(ROWS):
    for _c, _k in enumerate(_row):
        _NEAR[_k] = {ROWS[r][c] for r in (_r - 1, _r, _r + 1) for c in (_c - 1, _c, _c + 1) if 0 <= r < len(ROWS) and 0 <= c < len(ROWS[r])} - {_k}
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)\d\d", re.A)


def vocabulary_words(path: str) -> list[str]:
    """Words of a byte-level vocabulary file: its letter-only pieces that begin a word, in its order."""
    letters, out = byte_letters(), []
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    for piece in sorted(vocabulary, key=vocabulary.get):
        if all(c in letters for c in piece):
            word = bytes(letters[c] for c in piece).decode("utf-8", "replace")
            if word[:1] == " " and len(word) > 2 and word[1:].isalpha():
                out.append(word[1:].lower())
    return out


def dictionary(docs: DataFrame | None = None, tokenizer: str | None = None, size: int = DICTIONARY) -> dict[str, int]:
    """Words by rank: fixed ones, those of a vocabulary file, those frequent in ``docs``; words of over ``LONGEST`` letters are left out."""
    words = [*WORDS, *(vocabulary_words(tokenizer) if tokenizer else [])]
    if docs is not None:
        found = [(w.strip().lower(), n) for w, n in frequent_words(docs, size, COMMON)]
        words += [w for w, _ in sorted(found, key=lambda x: (-x[1], x[0])) if w.isalpha()]
    ranks: dict[str, int] = {}
    for w in words:
        if 2 <= len(w) <= LONGEST:
            ranks.setdefault(w, len(ranks) + 1)
    return ranks


def _alphabet(value: str) -> int:
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    n = sum(size for test, size in kinds if any(map(test, value)))
    return n + 33 * any(not (c.isdigit() or c.isalpha()) for c in value) or 10


def repeat_length(value: str, i: int, size: int) -> int:
    """Characters from ``i`` on that equal the one ``size`` later, by comparing ever longer slices."""
    n, done, step = len(value), 0, 16
    while (m := min(step, n - i - size - done)) > 0:
        if value[i + done : i + done + m] == value[i + size + done : i + size + done + m]:
            done, step = done + m, step * 2
        elif m == 1:
            break
        else:
            step = m // 2
    return done


class Spans:
    """The cheap spans of a value, found from each start that the program reaches."""

    def __init__(self, value: str, ranks: dict[str, int]):
        self.value, self.low, self.ranks, self.per_char = value, value.lower(), ranks, math.log10(_alphabet(value))
        if len(self.low) != len(value):  # a few letters lower to two characters
            self.low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        self.plain = self.low.translate(_LEET)

    def beside(self, i: int) -> bool:
        a, b = self.low[i], self.low[i + 1]
        return b in _NEAR.get(a, ()) or abs(ord(b) - ord(a)) == 1 and b.isalnum()

    def at(self, i: int, budget: float = math.inf) -> Iterator[tuple[int, float, int]]:
        """(end, log10 guesses, 1 or for a separator 0) of the spans from ``i`` that cost less than ``budget``."""
        value, low, n = self.value, self.low, len(self.value)
        for j in range(i + 2, min(n, i + LONGEST) + 1):
            for form, extra in ((low[i:j], 1), (self.plain[i:j], 4), (low[i:j][::-1], 2)):
                if (rank := self.ranks.get(form)) is not None:
                    cased = value[i:j]
                    caps = 1 if cased == low[i:j] else 2 if cased[1:] == low[i + 1 : j] or cased.isupper() else 2 ** sum(map(str.isupper, cased))
                    yield j, math.log10(rank * extra * caps + 1), 1
        if value[i] in _SEPARATORS:
            yield i + 1, _SEPARATOR_COST, 0
        if m := _DATE.match(value, i):
            yield m.end(), math.log10(365 * 120 if m.end() - i > 6 else 120 * 12 if m.end() - i > 4 else 120), 1
        for size in (1, 2, 3, 4):
            times = 1 + repeat_length(value, i, size) // size
            if times * size >= max(3, 2 * size):
                yield i + times * size, size * self.per_char + math.log10(times), 1
        j, turns, step = i, 0, None
        while j + 1 < n and self.beside(j):
            now = ord(low[j + 1]) - ord(low[j])
            turns, step, j = turns + (step is not None and now != step), now, j + 1
            cost = math.log10(47 * (j + 1 - i)) + turns * math.log10(6)
            if cost >= budget:
                break
            if j - i >= 3:
                yield j + 1, cost, 1


def guess_cost(value: str, ranks: dict[str, int] | None = None, most: float = FAR) -> float:
    """log10 of the guesses of the cheapest segmentation, or ``most`` if that is no less.

    States are (spans so far, whether the last is brute force and still open) at each end that some segmentation reaches below
    ``most``; a longer brute-force span passes it soon, so few ends are held at a time.
    """
    spans, orders = Spans(value, _RANK if ranks is None else ranks), lambda k: math.lgamma(k + 1) / math.log(10)
    n, per_char = len(value), spans.per_char
    held: dict[int, dict[tuple[int, bool], float]] = {0: {(0, False): 0.0}}
    ends = [0]

    def reach(j: int, k: int, brute: bool, cost: float) -> None:
        if cost + orders(k) >= most:
            return
        if j not in held:
            held[j] = {}
            heapq.heappush(ends, j)
        held[j][k, brute] = min(cost, held[j].get((k, brute), math.inf))

    while ends:
        i = heapq.heappop(ends)
        states = held.pop(i)
        if i == n:
            return min(most, min(c + orders(k) for (k, _), c in states.items()))
        closed: dict[int, float] = {}
        for (k, brute), c in states.items():
            closed[k] = min(c, closed.get(k, math.inf))
            if brute:
                reach(i + 1, k, True, c + per_char)
        cheap = list(spans.at(i, most - min(closed.values())))
        for k, c in closed.items():
            reach(i + 1, k + 1, True, c + per_char)
            for j, cost, counted in cheap:
                reach(j, k + counted, False, c + cost)
    return most


def find_secrets(text: str, ranks: dict[str, int] | None = None) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) by start, then kind, then end."""
    low = text.lower()
    named = any(word in low for word in HINTS)
    spans = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= SHORTEST] if named else []
    if "AKIA" in text:
        spans += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    spans += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    found = [*(CONTEXT.finditer(text) if named else ()), *(ADDRESS.finditer(text) if "://" in text else ())]
    guesses = set()
    for m in found:
        value = m.group(1) if m.re is ADDRESS else m.group(1).rstrip(".!?)]}")
        if len(value) >= SHORTEST and value.lower() != "bearer" and not value.startswith(("http://", "https://")) and guess_cost(value, ranks, GUESSES) >= GUESSES:
            guesses.add(("guess", m.start(1), m.start(1) + len(value)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted([*spans, *guesses], key=lambda s: (s[1], order[s[0]], s[2]))


def shared_dictionary(docs: DataFrame, tokenizer: str | None):
    """The dictionary as a broadcast variable: at most ``DICTIONARY`` words of the corpus beside the files' own."""
    return docs.sparkSession.sparkContext.broadcast(dictionary(docs, tokenizer))


def scan_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``doc_id`` and its ``found`` spans, an array of (kind, start, end)."""
    words = shared_dictionary(docs, tokenizer)

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b, texts in text_slices(batches):
            found = [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets(t.decode("utf-8", "replace"), words.value)] for t in texts]
            yield with_columns(b, ["doc_id"], found=pa.array(found, kind))

    return docs.select("doc_id", "text").mapInArrow(run, field_sql(docs, "doc_id") + ", found array<struct<kind:string,start:bigint,end:bigint>>")


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each maximal run of overlapping spans replaced by a mark of its first kind."""
    out, at = [], 0
    runs: list[list] = []
    for kind, a, b in spans:
        if runs and a < runs[-1][2]:
            runs[-1][2] = max(runs[-1][2], b)
        else:
            runs.append([kind, a, b])
    for kind, a, b in runs:
        out += [text[at:a], f"[{kind} removed]"]
        at = b
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """``docs`` with secrets replaced in ``text``; ``n_chars`` of changed texts is counted anew. Null texts stay null."""
    words = shared_dictionary(docs, tokenizer)

    def run(batches):
        for b, texts in text_slices(batches):
            was_null = b.column("text").is_null().to_pylist()
            new, counts = [], b.column("n_chars").to_pylist() if "n_chars" in b.schema.names else None
            for i, t in enumerate(texts):
                text = t.decode("utf-8", "replace")
                if spans := find_secrets(text, words.value):
                    text = redact(text, spans)
                    if counts is not None:
                        counts[i] = len(text)
                new.append(None if was_null[i] else text)
            b = b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, b.schema.field("text").type))
            if counts is not None:
                b = b.set_column(b.schema.get_field_index("n_chars"), "n_chars", pa.array(counts, b.schema.field("n_chars").type))
            yield b

    return docs.mapInArrow(run, docs.schema)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = shared_dictionary(docs, tokenizer_path())

    def run(batches):
        for b, texts in text_slices(batches):
            rows = [find_secrets(t.decode("utf-8", "replace"), words.value) for t in texts]
            joined = [",".join(f"{k}:{a}:{e}" for k, a, e in r) for r in rows]
            base = [",".join(f"{k}:{a}:{e}" for k, a, e in r if k != "guess") for r in rows]
            counts = {f"n_{k}": pa.array([sum(s[0] == k for s in r) for r in rows], pa.int64()) for k in KINDS[:3]}
            yield with_columns(b, ["doc_id"], **counts, base_sha256=[hashlib.sha256(x.encode()).hexdigest() for x in base], spans=pa.array(joined, pa.string()))

    schema = field_sql(docs, "doc_id") + ", n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
