"""Quality rules as a short-circuit cascade, ordered by rejections per cost measured on a sample.

Every document gets the base statistics.  Documents that pass the base rule go
through RULES; a batch that has lost a fifth of its documents is cut
down before the next rule, so late rules see few documents.  The order is greedy: on the sample, the rule with the
most rejections per second among the documents that earlier rules left comes next.  The order changes
the cost, never the verdict.  The sample is every document whose hashed doc_id
falls in 1 of ``rows / sample_rows`` classes; only counts per set of
failed rules (at most 2^rules) and seconds per rule reach the driver.

Cases: a null or empty text has no words and fails the base rule; a null doc_id is kept as it is; repeated
rows are judged alike; other columns are passed through; an empty table gives an empty result.
"""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hygeia.llm import words as K

U = np.uint64
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"


class Batch:
    """Texts of a batch, with what rules share worked out once, when first asked for."""

    def __init__(self, texts: pa.Array):
        self.texts = texts
        self.buf, self.offs = K.flat(texts)
        self.start, self.end, self.first = K.words(self.buf, self.offs)
        self._kept: dict = {}

    def get(self, name: str, make):
        if name not in self._kept:
            self._kept[name] = make()
        return self._kept[name]

    @property
    def size(self) -> int:
        return len(self.offs) - 1

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.first)

    def chars(self, table: np.ndarray) -> np.ndarray:
        """Per text, the bytes for which ``table`` is True."""
        return K.per_text(table[self.buf], self.offs)

    def lines(self):
        def make():
            s, e = K.spans(self.buf != 10, self.offs)
            worded = np.searchsorted(self.start, e) > np.searchsorted(self.start, s)
            return s[worded], e[worded]
        return self.get("lines", make)

    def n_lines(self) -> np.ndarray:
        return np.diff(np.searchsorted(self.lines()[0], self.offs))

    def hashes(self) -> np.ndarray:
        return self.get("hashes", lambda: K.span_hash(self.buf, self.start, self.end))

    def lasts(self) -> np.ndarray:
        return self.buf[self.end - 1]


def _table(of: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(of)] = True
    return t


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return K.mix(h ^ (doc.astype(U) * U(K.GOLD)))


def word_chars(b: Batch) -> np.ndarray:
    t = np.ones(256, bool)
    t[[9, 10, 11, 12, 13, 32]] = False
    t[0x80:0xC0] = False  # second and later bytes of a character
    return b.get("word_chars", lambda: b.chars(t))


def n_symbols(b: Batch) -> np.ndarray:
    return b.get("n_symbols", lambda: b.chars(_table(SYMBOLS)))


def n_dup_lines(b: Batch) -> np.ndarray:
    def make():
        s, e = b.lines()
        doc = np.searchsorted(b.offs, s, "right") - 1
        o, k = K.order_of(_own(K.span_hash(b.buf, s, e, 7), doc))
        again = np.flatnonzero(k[1:] == k[:-1]) + 1
        return np.bincount(doc[o[again]], minlength=b.size)
    return b.get("n_dup_lines", make)


def n_repeat_words(b: Batch, width: int = 3) -> np.ndarray:
    at, w = K.windows(b.hashes(), b.first, width)
    o, k = K.order_of(_own(w, K.owner(b.first, at)))
    same = k[1:] == k[:-1]
    twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(k) else np.zeros(0, bool)
    return K.per_text(K.covered(at[np.sort(o[twice])], width, int(b.first[-1])), b.first)


def base_statistics(b: Batch) -> dict[str, np.ndarray]:
    return {"n_words": b.n_words, "word_chars": word_chars(b), "n_symbols": n_symbols(b),
            "n_dup_lines": n_dup_lines(b), "n_repeat_words": n_repeat_words(b)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])


def _many_symbols(b: Batch) -> np.ndarray:
    return n_symbols(b) > 0.3 * b.n_words


def _word_length(b: Batch) -> np.ndarray:
    mean = word_chars(b) / np.maximum(b.n_words, 1)
    return (mean < 2) | (mean > 14)


def _repeated_lines(b: Batch) -> np.ndarray:
    return n_dup_lines(b) > 0.4 * b.n_lines()


def _shouting(b: Batch) -> np.ndarray:
    """Most words end in an exclamation mark, or most letters of the ASCII range are capitals."""
    marks = np.diff(np.searchsorted(np.flatnonzero(b.lasts() == 33), b.first))
    upper, lower = b.chars(_table(bytes(range(65, 91)))), b.chars(_table(bytes(range(97, 123))))
    return (marks > 0.4 * b.n_words) | (upper > lower)


def _few_letters(b: Batch) -> np.ndarray:
    """Fewer than half of the words hold a letter (ASCII letters, or any character beyond ASCII)."""
    t = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
    at = np.zeros(len(b.buf) + 1, np.int64)
    np.cumsum(t[b.buf], out=at[1:])
    return K.per_text(at[b.end] > at[b.start], b.first) < 0.5 * b.n_words


def _one_word(b: Batch) -> np.ndarray:
    """One word is more than a quarter of the text."""
    doc = K.owner(b.first, np.arange(len(b.start)))
    o, k = K.order_of(_own(b.hashes(), doc))
    if not len(k):
        return np.zeros(b.size, bool)
    at = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    most = np.zeros(b.size, np.int64)
    np.maximum.at(most, doc[o[at]], np.diff(np.concatenate([at, [len(k)]])))
    return 4 * most > b.n_words


def _open_lines(b: Batch) -> np.ndarray:
    """Most lines end in an ellipsis (three full stops, or the character)."""
    s, e = b.lines()
    last = np.maximum(e - 3, 0)
    dots = (b.buf[last] == 46) & (b.buf[e - 1] == 46) & (b.buf[np.maximum(e - 2, 0)] == 46)
    char = (b.buf[last] == 0xE2) & (b.buf[np.maximum(e - 2, 0)] == 0x80) & (b.buf[e - 1] == 0xA6)
    hit = (dots | char) & (e - s >= 3)
    return np.diff(np.searchsorted(s[hit], b.offs)) > 0.5 * np.maximum(b.n_lines(), 1)


RULES = {
    "many_symbols": _many_symbols, "word_length": _word_length, "repeated_lines": _repeated_lines,
    "shouting": _shouting, "few_letters": _few_letters, "one_word": _one_word, "open_lines": _open_lines,
}


def cascade(texts: pa.Array, rules: list) -> np.ndarray:
    """Which texts every rule lets through."""
    kept = np.arange(len(texts))
    b = Batch(texts)
    index = kept  # texts of the batch
    for rule in rules:
        ok = ~rule(b)
        alive = np.isin(index, kept) & ok
        kept = index[alive]
        if len(kept) < 0.8 * len(index):
            b, index = Batch(texts.take(pa.array(kept))), kept
    out = np.zeros(len(texts), bool)
    out[kept] = True
    return out


def pieces(batch: pa.RecordBatch, column: str = "text", size: int = 4 << 20):
    """The rows of a batch in runs of about ``size`` bytes of text."""
    texts = batch.column(column)
    end = np.cumsum(np.diff(K.flat(texts)[1])) if batch.num_rows else np.zeros(0)
    i = 0
    while i < batch.num_rows:
        j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + size, "right")))
        yield batch.slice(i, j - i)
        i = j


def rule_order(docs: DataFrame, rules: dict, sample_rows: int) -> list[str]:
    names = list(rules)
    rows = docs.count()
    part = max(1, rows // sample_rows)
    sample = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(part)) == 0).select("text")

    def tried(batches):
        for batch in batches:
            for p in pieces(batch):
                texts = p.column("text")
                texts = texts.filter(pa.array(~base_failed(base_statistics(Batch(texts)))))
                failed, spent = np.zeros(len(texts), np.int64), []
                for k, name in enumerate(names):
                    t = time.perf_counter()
                    failed |= rules[name](Batch(texts)).astype(np.int64) << k
                    spent.append(time.perf_counter() - t)
                sets, n = np.unique(failed, return_counts=True)
                yield pa.RecordBatch.from_pydict({
                    "failed": pa.array([*sets.tolist(), *[-1 - k for k in range(len(names))]], pa.int64()),
                    "n": pa.array([*n.tolist(), *[0] * len(names)], pa.int64()),
                    "s": pa.array([*[0.0] * len(sets), *spent], pa.float64())})

    got = sample.mapInArrow(tried, "failed bigint, n bigint, s double").groupBy("failed").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    cost = {names[-1 - r["failed"]]: r["s"] for r in got if r["failed"] < 0}
    sets = {r["failed"]: r["n"] for r in got if r["failed"] >= 0}
    order: list[str] = []
    while len(order) < len(names):
        left = [n for n in names if n not in order]
        rejects = {n: sum(c for f, c in sets.items() if f >> names.index(n) & 1) for n in left}
        best = max(left, key=lambda n: (rejects[n] / max(cost.get(n, 0), 1e-9), -names.index(n)))
        order.append(best)
        sets = {f: c for f, c in sets.items() if not f >> names.index(best) & 1}
    return order


def judge(docs: DataFrame, rules: dict | None = None, sample_rows: int = 2_000) -> DataFrame:
    """``docs`` with the base statistics, base_failed and kept (clashing columns are replaced)."""
    rules = rules or RULES
    ordered = [rules[n] for n in rule_order(docs, rules, sample_rows)]
    new = [*BASE, "base_failed", "kept"]
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])

    def work(batches):
        for batch in batches:
            for p in pieces(batch):
                texts = p.column("text")
                stats = base_statistics(Batch(texts))
                failed = base_failed(stats)
                kept = np.zeros(len(texts), bool)
                rest = np.flatnonzero(~failed)
                kept[rest] = cascade(texts.take(pa.array(rest)), ordered) if len(rest) else False
                yield pa.RecordBatch.from_arrays(
                    [*p.columns, *(pa.array(stats[c].astype(np.int64)) for c in BASE), pa.array(failed), pa.array(kept)],
                    names=[*p.schema.names, *new])

    schema = T.StructType(list(docs.schema.fields) + [T.StructField(c, T.LongType()) for c in BASE]
                          + [T.StructField(c, T.BooleanType()) for c in ("base_failed", "kept")])
    return docs.mapInArrow(work, schema)
