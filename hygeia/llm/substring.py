"""Removal of passages that occur in several documents, by level-wise doubling of repeated windows.

Level 0 looks at every window of ``width`` words of every document; only
windows that occur in two documents or more go on.  A window of twice the
length is a candidate only where both its halves were repeated, and so on,
until no candidate survives.  Each level asks the whole corpus about its
distinct windows chunk by chunk (exchange.py).  A word is removed if a window of
level 0 that covers it also starts in a document with a smaller doc_id.

Windows are compared by 64-bit hashes of their words: among n windows about
n^2 / 2^65 pairs are taken as equal though they aren't.

Cases: a null or empty text has no words and keeps its place; rows with equal
doc_id never remove words from each other, and a null doc_id counts as the
smallest; texts shorter than ``width`` words are kept as they are; an empty
table gives an empty result; other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hygeia.llm import exchange as X
from hygeia.llm import words as K
from hygeia.llm.common import Scratch, block_count, range_block, range_bounds

U = np.uint64
LOWEST = -(2**63)

#: One row per document and one per chunk (kind 1) with the chunk's repeated windows.
_LEVEL0 = ("kind int, chunk int, doc_id bigint, text_hash bigint, n_words bigint, n_removed bigint, "
           "starts array<int>, ends array<int>, state binary")
_STATE = "chunk int, state binary"


def _chunk(t: pa.Table):
    """A chunk's documents by doc_id: ids, text hashes, words and hashes of words."""
    ids = t["doc_id"].combine_chunks().fill_null(LOWEST).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    t = t.take(pa.array(order))
    buf, offs = K.flat(t["text"])
    s, e, first = K.words(buf, offs)
    return t, ids[order], first, K.span_hash(buf, s, e)


def _distinct(h: np.ndarray, ids: np.ndarray):
    """Distinct hashes, sorted; for each: lowest and highest id; for each window: its distinct hash."""
    order, s = K.order_of(h)
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    end = np.concatenate([at[1:], [len(s)]]).astype(np.int64) - 1 if len(s) else at
    which = np.empty(len(h), np.int64)
    which[order] = np.cumsum(new) - 1
    return s[at], ids[order[at]] if len(s) else ids[:0], ids[order[end]] if len(s) else ids[:0], which


def _pack_state(docs: np.ndarray, at: np.ndarray, h: np.ndarray) -> bytes:
    parts = [X.squeeze(np.diff(docs, prepend=0)), X.squeeze(np.diff(at, prepend=0)), X.squeeze(h)]
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _unpack_state(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, i = [], 0
    while i < len(b):
        n = int.from_bytes(b[i:i + 8], "little")
        parts.append(b[i + 8:i + 8 + n])
        i += 8 + n
    return np.cumsum(X.expand(parts[0], np.int64)), np.cumsum(X.expand(parts[1], np.int64)), X.expand(parts[2], U)


def _doubled(ids: np.ndarray, at: np.ndarray, h: np.ndarray, half: int):
    """Candidates of twice the length: where a repeated window starts at both halves of one document.

    ``at`` numbers the chunk's words, so windows of one document only meet if
    ``half`` words on there is a candidate of the same document."""
    nxt = np.searchsorted(at, at + half)
    inside = np.minimum(nxt, len(at) - 1) if len(at) else nxt
    ok = np.flatnonzero((at[inside] == at + half) & (ids[inside] == ids)) if len(at) else nxt
    return ids[ok], at[ok], K.mix(h[ok] * U(K.BASE) + h[inside[ok]])


def repeated_spans(docs: DataFrame, width: int = 13, chunk_bytes: int = 8 << 20) -> DataFrame:
    """Per document: doc_id, text_hash (xxhash64), n_words, n_removed, starts/ends (word ranges to remove)
    and longest (words of the longest window length at which one of its windows was still repeated; 0: none)."""
    spark = docs.sparkSession
    work = Scratch(spark, "substring")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    chunks = block_count(spark, size, chunk_bytes, 256 << 10)
    bounds = range_bounds(docs, "doc_id", chunks)
    buckets = chunks
    dealt = docs.select(range_block("doc_id", bounds).cast("int").alias("chunk"), F.col("doc_id").cast("bigint"),
                        F.xxhash64("text").alias("text_hash"), "text")

    def ask(t: pa.Table) -> pa.Table:
        _, _, first, h = _chunk(t)
        return X.questions(t["chunk"][0].as_py(), np.unique(K.windows(h, first, width)[1]), buckets)

    def settle(t: pa.Table, said: pa.Table) -> pa.Table:
        chunk = t["chunk"][0].as_py()
        t, ids, first, h = _chunk(t)
        at, w = K.windows(h, first, width)
        del h
        doc = K.owner(first, at)
        distinct, low, high, which = _distinct(w, ids[doc])
        other, earlier = X.read_where(said, len(distinct), buckets, distinct)
        del distinct
        later = earlier[which] | (ids[doc] > low[which])
        gone = K.covered(at[later], width, int(first[-1]))
        s, e = K.spans(gone, first)
        by = np.searchsorted(s, first)
        n = len(ids)
        again = (other | (low != high))[which]
        state = _pack_state(doc[again], at[again], w[again])
        starts = pa.ListArray.from_arrays(pa.array(by, pa.int32()), pa.array(s - first[K.owner(first, s)], pa.int32()))
        ends = pa.ListArray.from_arrays(pa.array(by, pa.int32()), pa.array(e - first[K.owner(first, s)], pa.int32()))
        rows = pa.table({
            "kind": pa.array(np.zeros(n, np.int32)), "chunk": pa.array(np.full(n, chunk, np.int32)),
            "doc_id": t["doc_id"].combine_chunks(), "text_hash": t["text_hash"].combine_chunks(),
            "n_words": pa.array(np.diff(first)), "n_removed": pa.array(K.per_text(gone, first)),
            "starts": starts, "ends": ends, "state": pa.nulls(n, pa.binary())})
        docs_of = pa.table({"doc_id": t["doc_id"].combine_chunks(), "text_hash": t["text_hash"].combine_chunks()})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, docs_of.schema) as f:
            f.write_table(docs_of)
        head = sink.getvalue().to_pybytes()
        one = pa.table({
            "kind": pa.array([1], pa.int32()), "chunk": pa.array([chunk], pa.int32()),
            "doc_id": pa.nulls(1, pa.int64()), "text_hash": pa.nulls(1, pa.int64()),
            "n_words": pa.nulls(1, pa.int64()), "n_removed": pa.array([int(again.sum())], pa.int64()),
            "starts": pa.nulls(1, starts.type), "ends": pa.nulls(1, ends.type),
            "state": pa.array([len(head).to_bytes(8, "little") + head + state], pa.binary())})
        return pa.concat_tables([rows, one]).cast(rows.schema)

    level0 = work.table(X.with_answers(dealt, X.ask_all(dealt, ask, X.answer_where), settle, _LEVEL0), "level0")
    result = level0.where("kind = 0").select("doc_id", "text_hash", "n_words", "n_removed", "starts", "ends")

    heads, longest = level0.where("kind = 1").select("chunk", "state"), []
    alive = heads.where(F.length("state") > 0)

    def split(b: bytes) -> tuple[bytes, bytes]:
        n = int.from_bytes(b[:8], "little")
        return b[:8 + n], b[8 + n:]

    def reached(length: int):
        def rows(batches):
            for batch in batches:
                for b in batch.column("state").to_pylist():
                    head, state = split(b)
                    ids = np.unique(_unpack_state(state)[0])
                    t = pa.ipc.open_stream(head[8:]).read_all().take(pa.array(ids))
                    t = t.append_column("longest", pa.array(np.full(len(ids), length, np.int64)))
                    yield from t.to_batches()
        return rows

    def next_level(half: int):
        def ask(t: pa.Table) -> pa.Table:
            _, _, h = _doubled(*_unpack_state(split(t["state"][0].as_py())[1]), half)
            return X.questions(t["chunk"][0].as_py(), np.unique(h), buckets)

        def settle(t: pa.Table, said: pa.Table) -> pa.Table:
            head, state = split(t["state"][0].as_py())
            doc, at, h = _doubled(*_unpack_state(state), half)
            ids = pa.ipc.open_stream(head[8:]).read_all()["doc_id"].combine_chunks()
            ids = ids.fill_null(LOWEST).to_numpy(zero_copy_only=False)
            distinct, low, high, which = _distinct(h, ids[doc])
            other, _ = X.read_where(said, len(distinct), buckets, distinct)
            again = (other | (low != high))[which]
            found = [head + _pack_state(doc[again], at[again], h[again])] if again.any() else []
            return pa.table({"chunk": t["chunk"].combine_chunks()[:len(found)], "state": pa.array(found, pa.binary())})

        return ask, settle

    length, level = width, 0
    while True:
        tops = alive.select("state").mapInArrow(reached(length), "doc_id bigint, text_hash bigint, longest bigint")
        longest.append(tops)

        ask_next, settle_next = next_level(length)
        level += 1
        nxt = work.table(X.with_answers(alive, X.ask_all(alive, ask_next, X.answer_where), settle_next, _STATE),
                         f"level{level}")
        if nxt.isEmpty():
            break
        alive, length = nxt, 2 * length
    top = longest[0]
    for t in longest[1:]:
        top = top.unionByName(t)
    top = top.groupBy("doc_id", "text_hash").agg(F.max("longest").alias("longest"))
    out = result.alias("a").join(top.alias("b"), F.expr("a.doc_id <=> b.doc_id and a.text_hash = b.text_hash"), "left")
    return out.select("a.*", F.coalesce("b.longest", F.lit(0)).cast("bigint").alias("longest"))


def _cut(batches):
    for b in batches:
        out = []
        for text, starts, ends in zip(b.column("_text").to_pylist(), b.column("_starts").to_pylist(),
                                      b.column("_ends").to_pylist()):
            if not starts:
                out.append(text)
                continue
            w = (text or "").translate(_SPACES).split(" ")
            w = [x for x in w if x]
            kept, i = [], 0
            for s, e in zip(starts, ends):
                kept += w[i:s]
                i = e
            out.append(" ".join(kept + w[i:]))
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in b.schema.names if c not in ("_text", "_starts", "_ends")), pa.array(out, pa.string())],
            names=[*(c for c in b.schema.names if c not in ("_text", "_starts", "_ends")), "_kept"])


_SPACES = {c: " " for c in range(9, 14)}


def substring_dedup(docs: DataFrame, width: int = 13, chunk_bytes: int = 8 << 20) -> DataFrame:
    """``docs`` with text cut: a document that loses words holds its kept words joined by one space, others
    are unchanged.  Adds n_words, n_removed, longest (clashing columns of ``docs`` are replaced)."""
    spans = repeated_spans(docs, width, chunk_bytes)
    found = spans.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                         F.col("n_words").alias("_n"), F.col("n_removed").alias("_gone"),
                         F.col("starts").alias("_starts"), F.col("ends").alias("_ends"),
                         F.col("longest").alias("_longest")).dropDuplicates(["_id", "_hash"])
    own = [c for c in docs.columns if c not in ("n_words", "n_removed", "longest")]
    rest = [c for c in own if c != "text"]
    d = docs.select(*[F.col(f"`{c}`") for c in own], F.xxhash64("text").alias("_text_hash"))
    j = d.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_hash")), "left")
    j = j.select(*[F.col(f"`{c}`") for c in rest], F.col("_n").alias("n_words"), F.col("_gone").alias("n_removed"),
                 F.col("_longest").alias("longest"), F.col("text").alias("_text"), "_starts", "_ends")
    schema = T.StructType([f for f in j.schema if f.name not in ("_text", "_starts", "_ends")]).add("_kept", "string")
    kept = j.mapInArrow(_cut, schema)
    return kept.select(*[F.col("_kept").alias("text") if c == "text" else F.col(f"`{c}`") for c in own],
                       "n_words", "n_removed", "longest")
