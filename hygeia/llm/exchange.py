"""Asking the whole corpus about 64-bit hashes: one question per distinct hash and chunk, one answer back.

Documents are dealt into chunks by ranges of doc_id (chunk numbers rise with
doc_id).  A chunk sends its distinct hashes, sorted and cut into ``buckets``
ranges of hash values; a bucket sees the hashes of every chunk in its range and
answers each chunk in the order of its question.  A hash that a third of all
documents hold reaches its bucket once per chunk, not once per document, and no
answer carries more than the chunk asked.  Questions travel as delta-coded byte
planes: about 5 bytes a hash, and answers as bit planes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygeia.llm import words as K

U = np.uint64
QUESTION = "bucket int, chunk int, ask binary"
ANSWER = "chunk int, bucket int, say binary"


def squeeze(a: np.ndarray) -> bytes:
    """Integers as byte planes (all lowest bytes first), compressed: planes of zeros cost nothing."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T) if len(a) else np.zeros(0, np.uint8)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True) + len(a).to_bytes(8, "little")


def expand(b: bytes, dtype) -> np.ndarray:
    n, size = int.from_bytes(b[-8:], "little"), np.dtype(dtype).itemsize
    raw = pa.decompress(b[:-8], decompressed_size=n * size, codec="zstd", asbytes=True) if n else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(dtype).reshape(n)


def squeeze_sorted(h: np.ndarray) -> bytes:
    return squeeze(np.diff(h, prepend=U(0)))


def expand_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(expand(b, U), dtype=U)


def cuts(h: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted hashes change bucket: ``buckets + 1`` offsets."""
    edge = np.array([((b << 32) // buckets) << 32 for b in range(1, buckets)], dtype=U)
    return np.concatenate([[0], np.searchsorted(h, edge), [len(h)]]).astype(np.int64)


def questions(chunk: int, h: np.ndarray, buckets: int, counts: np.ndarray | None = None) -> pa.Table:
    """``h``: distinct, sorted.  ``counts``: how many documents of the chunk hold each."""
    at = cuts(h, buckets)
    asks = []
    for b in range(buckets):
        part = slice(at[b], at[b + 1])
        ask = squeeze_sorted(h[part])
        if counts is not None:
            more = squeeze(counts[part].astype(np.int64))
            ask = ask + more + len(more).to_bytes(8, "little")
        asks.append(ask)
    keep = [b for b in range(buckets) if at[b + 1] > at[b]]
    return pa.table({"bucket": pa.array(keep, pa.int32()), "chunk": pa.array([chunk] * len(keep), pa.int32()),
                     "ask": pa.array([asks[b] for b in keep], pa.binary())})


def _asked(t: pa.Table) -> list[tuple[int, int, bytes]]:
    rows = zip(t["chunk"].to_pylist(), t["bucket"].to_pylist(), t["ask"].to_pylist())
    return sorted(rows, key=lambda r: r[0])


def _answers(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    c, b, s = zip(*rows) if rows else ((), (), ())
    return pa.table({"chunk": pa.array(c, pa.int32()), "bucket": pa.array(b, pa.int32()),
                     "say": pa.array(s, pa.binary())})


def _common(parts: list[np.ndarray]) -> np.ndarray:
    """Sorted hashes that occur in two parts or more (each part is distinct)."""
    s = np.concatenate(parts) if parts else np.zeros(0, U)
    s.sort()
    twice = s[1:][s[1:] == s[:-1]]
    return twice[np.concatenate([[True], twice[1:] != twice[:-1]])] if len(twice) else twice


def _find(common: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``h`` of hashes in ``common``, and where they stand there."""
    if not len(common):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    hit = np.flatnonzero(common[at] == h)
    return hit, at[hit]


def answer_where(t: pa.Table) -> pa.Table:
    """For each hash asked: is it in another chunk; is it in a chunk of smaller number."""
    rows = _asked(t)
    parts = [expand_sorted(r[2]) for r in rows]
    common = _common(parts)
    seen, out = np.zeros(len(common), bool), []
    for (chunk, bucket, _), h in zip(rows, parts):
        other, earlier = np.zeros(len(h), bool), np.zeros(len(h), bool)
        hit, at = _find(common, h)
        other[hit] = True
        earlier[hit] = seen[at]
        seen[at] = True
        out.append((chunk, bucket, squeeze(np.packbits(np.concatenate([other, earlier]))) + len(h).to_bytes(8, "little")))
    return _answers(out)


def read_where(answers: pa.Table, n: int, buckets: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The answers to ``questions(h)`` in the order of ``h``: (in another chunk, in a smaller chunk)."""
    at = cuts(h, buckets)
    other, earlier = np.zeros(n, bool), np.zeros(n, bool)
    for bucket, say in zip(answers["bucket"].to_pylist(), answers["say"].to_pylist()):
        k = int.from_bytes(say[-8:], "little")
        bits = np.unpackbits(expand(say[:-8], np.uint8))
        other[at[bucket]:at[bucket + 1]] = bits[:k]
        earlier[at[bucket]:at[bucket + 1]] = bits[k:2 * k]
    return other, earlier


def answer_count(t: pa.Table) -> pa.Table:
    """For each hash asked: how many documents of the other chunks hold it."""
    rows = _asked(t)
    parts, counts = [], []
    for _, _, ask in rows:
        k = int.from_bytes(ask[-8:], "little")
        parts.append(expand_sorted(ask[:-8 - k]))
        counts.append(expand(ask[-8 - k:-8], np.int64))
    common = _common(parts)
    total, found = np.zeros(len(common), np.int64), []
    for h, c in zip(parts, counts):
        hit, at = _find(common, h)
        total[at] += c[hit]
        found.append((hit, at))
    out = []
    for (chunk, bucket, _), h, c, (hit, at) in zip(rows, parts, counts, found):
        others = np.zeros(len(h), np.int64)
        others[hit] = total[at] - c[hit]
        out.append((chunk, bucket, squeeze(others)))
    return _answers(out)


def read_count(answers: pa.Table, buckets: int, h: np.ndarray) -> np.ndarray:
    at = cuts(h, buckets)
    others = np.zeros(len(h), np.int64)
    for bucket, say in zip(answers["bucket"].to_pylist(), answers["say"].to_pylist()):
        others[at[bucket]:at[bucket + 1]] = expand(say, np.int64)
    return others


def _trimmed(work, pair: bool = False):
    """``work`` on one table or two, giving freed memory back after each group."""
    def one(t: pa.Table) -> pa.Table:
        try:
            return work(t)
        finally:
            K.give_back()

    def two(t: pa.Table, said: pa.Table) -> pa.Table:
        try:
            return work(t, said)
        finally:
            K.give_back()

    return two if pair else one


def ask_all(chunks: DataFrame, ask, answer) -> DataFrame:
    """``chunks`` (column chunk and more) -> answers, by ``ask`` (a chunk's table -> questions) and ``answer``."""
    return (chunks.groupBy("chunk").applyInArrow(_trimmed(ask), QUESTION)
            .groupBy("bucket").applyInArrow(_trimmed(answer), ANSWER))


def with_answers(chunks: DataFrame, answers: DataFrame, work, schema: str) -> DataFrame:
    """``work`` (a chunk's table, its answers) for every chunk."""
    return (chunks.groupBy("chunk").cogroup(answers.select(F.col("chunk"), "bucket", "say").groupBy("chunk"))
            .applyInArrow(_trimmed(work, True), schema))
