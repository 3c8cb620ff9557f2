"""Best-fit packing of token sequences, after a dominance reduction of the instance.

Lengths are integers up to the capacity, so an instance is its histogram: at
most ``capacity`` counts, however many documents.  The plan is made on the
histogram.  First the reduction of Martello and Toth: while some set of items with item j dominates
every other set that could share j's bin, that bin is fixed (as often as the counts allow) and its items
leave the instance.  Best-fit decreasing packs what is left.  A plan is a
list of slots (length, ranks from..to, sequences from..., offset); a document's rank among its length is a distributed
running count, so its place is a look-up and no rows meet on the driver.

Cases: a null or empty text is the one token ``eos``; a document of more than ``capacity`` tokens is cut
into full pieces, the first piece is the shorter one; repeated rows are packed each; a null doc_id is kept;
an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import zlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygeia.llm import words as K
from hygeia.llm.common import Scratch, block_count, running_sum
from hygeia.llm.quality import pieces

U = np.uint64
#: Distinct units whose ids a worker keeps (about 15 MB, several times that while new ones are put in); beyond it starts afresh.
KEPT_UNITS = 500_000
#: Bytes of text that a worker encodes at a time: its arrays over the units take many times as much.
ENCODED_BYTES = 2 << 20
BLOCK_ROWS = 50_000
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


# ---- the plan (driver, on the histogram) -----------------------------------
class _Counts:
    """Counts by length, with the lengths still there in order."""

    def __init__(self, hist: dict[int, int]):
        self.n = {k: v for k, v in hist.items() if v > 0}
        self.order = sorted(self.n)

    def take(self, length: int, count: int) -> None:
        self.n[length] -= count
        if not self.n[length]:
            del self.n[length]
            self.order.pop(bisect_left(self.order, length))

    def largest(self, limit: int, without: int = 0) -> int:
        """The largest length <= limit, when one item of length ``without`` is away (0: none)."""
        i = bisect_right(self.order, limit) - 1
        while i >= 0 and self.order[i] == without and self.n[without] == 1:
            i -= 1
        return self.order[i] if i >= 0 else 0

    def smallest_sum(self, items: int, without: int) -> int:
        """Least total of ``items`` items when one of length ``without`` is away."""
        total = left = 0
        for k in self.order:
            have = min(self.n[k] - (k == without), items - left)
            total, left = total + k * have, left + have
            if left == items:
                return total
        return 2**62


def _dominant(c: _Counts, j: int, capacity: int) -> tuple[int, ...] | None:
    """Lengths that, with j, dominate every feasible set that holds j; None if none is proved."""
    room = capacity - j
    k = c.largest(room, j)
    if not k:
        return ()
    if k == room or c.smallest_sum(2, j) > room:
        return (k,)  # whatever else shares j's bin fits in k's place
    if c.smallest_sum(3, j) > room:
        # at most two more items: (k, b) dominates if it fills the bin and no pair has both items above b
        b = room - k
        if c.n.get(b, 0) - (b == j) - (b == k) > 0:
            i = bisect_right(c.order, b)
            above = c.order[i] if i < len(c.order) else 2**62
            if 2 * above > room:
                return (k, b)
    return None


def reduce_instance(hist: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(fixed bins as (lengths, how many), what is left of the histogram)."""
    c, fixed = _Counts(hist), []
    changed = True
    while changed:
        changed = False
        for j in list(reversed(c.order)):
            while c.n.get(j):
                more = _dominant(c, j, capacity)
                if more is None:
                    break
                bin_ = (j, *more)
                times = min(c.n[k] // bin_.count(k) for k in set(bin_))
                for k in bin_:
                    c.take(k, times)
                fixed.append((bin_, times))
                changed = True
    return fixed, dict(c.n)


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on counts: bins of equal content are one entry."""
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, entry: tuple[tuple[int, ...], int]) -> None:
        if room not in open_:
            open_[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        open_[room].append(entry)

    for j in sorted(hist, reverse=True):
        left = hist[j]
        while left:
            i = bisect_left(rooms, j)
            if i == len(rooms):
                new = math.ceil(left / (capacity // j))
                put(capacity - j, ((j,), new))
                left -= new
                continue
            room = rooms[i]
            content, n = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(i)
            used = min(n, left)
            left -= used
            if n > used:
                put(room, (content, n - used))
            put(room - j, ((*content, j), used))
    return [e for entries in open_.values() for e in entries]


def plan(hist: dict[int, int], capacity: int) -> np.ndarray:
    """Slots (length, first rank, last rank + 1, first sequence, offset), by length and rank."""
    fixed, left = reduce_instance(hist, capacity)
    rank: dict[int, int] = {}
    slots, sequence = [], 0
    for content, n in fixed + best_fit(left, capacity):
        offset = 0
        for length in content:
            at = rank.get(length, 0)
            slots.append((length, at, at + n, sequence, offset))
            rank[length] = at + n
            offset += length
        sequence += n
    return np.array(sorted(slots), dtype=np.int64).reshape(len(slots), 5)


# ---- tokens ----------------------------------------------------------------
def _byte_names() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable bytes stand for themselves, others follow 255."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in keep}
    names.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in keep)})
    return names


def unit_cuts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Bytes at which a text can be cut without a change of its tokens: before a single space and around a single
    newline between two characters that aren't white space of any kind."""
    n = len(buf)
    cut = np.zeros(n + 1, bool)
    cut[offs] = True
    if n > 2:
        space = K.is_space(buf)
        lead = (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))  # first bytes of other white space
        edge = np.zeros(n + 1, bool)
        edge[offs] = True
        mid = slice(1, n - 1)
        before = ~space[:-2]
        before[1:] &= ~lead[:n - 3]
        before[2:] &= ~lead[:n - 4] if n > 4 else True
        ok = before & ~space[2:] & ~lead[2:] & ~edge[1:n - 1] & ~edge[2:n]
        at = np.flatnonzero(ok & ((buf[mid] == 32) | (buf[mid] == 10))) + 1
        cut[at] = True
        cut[at[buf[at] == 10] + 1] = True
    cut[n] = False
    return np.flatnonzero(cut)


class Encoder:
    """Token ids of whole texts, each distinct unit between two cuts encoded once."""

    def __init__(self, spec: str):
        self.spec = spec
        model = json.loads(spec)
        vocab, merges = model["model"]["vocab"], model["model"]["merges"]
        special = [t["content"] for t in model.get("added_tokens", [])]
        names = _byte_names()
        raw = {bytes(names[c] for c in t): i for t, i in vocab.items() if t not in special}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        # with ids in the order of the merges, the ranks of both libraries agree
        self.ranked = all(vocab["".join(m)] == 256 + i for i, m in enumerate(pairs)) and len(raw) == 256 + len(pairs)
        self.special = [s.encode() for s in special]
        self.slow = None
        self.forget()
        if self.ranked:
            import tiktoken
            self.width = np.zeros(max(raw.values()) + 1, np.int64)
            for token, i in raw.items():
                self.width[i] = len(token)
            self.fast = tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=raw, special_tokens={})

    def exact(self, texts: list[str]) -> list[list[int]]:
        if self.slow is None:
            from tokenizers import Tokenizer
            self.slow = Tokenizer.from_str(self.spec)
        return [self.slow.encode(t, add_special_tokens=False).ids for t in texts]

    def units(self, buf: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of units one after the other, and how many each has.

        Units without inner white space go through the encoder in one call, a newline after each: it is a
        token of its own there, and the lengths of the tokens tell where a unit ends."""
        odd = K.is_space(buf) | (buf == 0xC2) | ((buf >= 0xE1) & (buf <= 0xE3))
        c = np.zeros(len(buf) + 1, np.int64)
        np.cumsum(odd, out=c[1:])
        plain = (c[e] == c[s + 1]) & (~odd[s] | ((buf[s] == 32) & (e > s + 1)))
        if not self.ranked:
            plain[:] = False
        size = np.zeros(len(s), np.int64)
        ids_of: dict[int, list[int]] = {}
        at = np.flatnonzero(plain)
        ids = np.zeros(0, np.uint32)
        if len(at):
            joined = b"\n".join([raw[i:j] for i, j in zip(s[at].tolist(), e[at].tolist())]) + b"\n"
            ids = np.array(self.fast.encode_ordinary(joined.decode("utf-8")), np.uint32)
            ends, unit_end = np.cumsum(self.width[ids]), np.cumsum(e[at] - s[at] + 1)
            last = np.searchsorted(ends, unit_end)
            assert (ends[last] == unit_end).all() and (self.width[ids[last]] == 1).all()
            size[at] = np.diff(last, prepend=-1) - 1
            keep = np.ones(len(ids), bool)
            keep[last] = False
            ids = ids[keep]
        rest = np.flatnonzero(~plain)
        for k in rest.tolist():
            text = raw[s[k]:e[k]].decode("utf-8")
            ids_of[k] = self.fast.encode_ordinary(text) if self.ranked else self.exact([text])[0]
            size[k] = len(ids_of[k])
        if not len(rest):
            return ids, size
        out = np.empty(int(size.sum()), np.uint32)
        fill = np.repeat(plain, size)
        out[fill] = ids
        out[~fill] = np.fromiter((x for k in rest.tolist() for x in ids_of[k]), np.uint32, int(size[rest].sum()))
        return out, size

    def look_up(self, h: np.ndarray, buf: np.ndarray, raw: bytes, s: np.ndarray, e: np.ndarray):
        """Where the ids of each distinct unit stand in the pool, and how many there are; encodes the new ones."""
        if len(self.known) > KEPT_UNITS:
            self.forget()
        k = np.minimum(np.searchsorted(self.known, h), max(len(self.known) - 1, 0))
        new = self.known[k] != h if len(self.known) else np.ones(len(h), bool)
        ids, size = self.units(buf, raw, s[new], e[new])
        at = np.cumsum(size) - size + len(self.pool)
        self.pool = np.concatenate([self.pool, ids])
        known = np.concatenate([self.known, h[new]])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.at = np.concatenate([self.at, at])[order]
        self.size = np.concatenate([self.size, size])[order]
        k = np.searchsorted(self.known, h)
        return self.at[k], self.size[k]

    def forget(self) -> None:
        self.known, self.pool = np.zeros(0, U), np.zeros(0, np.uint32)
        self.at = self.size = np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        buf, offs = K.flat(texts)
        if len(buf) == 0:
            return [np.zeros(0, np.uint32)] * (len(offs) - 1)
        s = unit_cuts(buf, offs)
        e = np.concatenate([s[1:], [len(buf)]])
        order, sorted_h = K.order_of(K.span_hash(buf, s, e, 29))
        new = np.concatenate([[True], sorted_h[1:] != sorted_h[:-1]])
        which = np.empty(len(s), np.int64)
        which[order] = np.cumsum(new) - 1
        one, raw, distinct = order[new], buf.tobytes(), sorted_h[new]
        at, size = self.look_up(distinct, buf, raw, s[one], e[one])
        pool = self.pool
        n = size[which]
        end = np.cumsum(n)
        flat = pool[np.repeat(at[which] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        first = np.concatenate([[0], end])[np.searchsorted(s, offs)]
        out = [flat[first[i]:first[i + 1]] for i in range(len(offs) - 1)]
        for mark in self.special:
            if mark in raw:
                for i in range(len(out)):
                    text = raw[offs[i]:offs[i + 1]]
                    if mark in text:
                        out[i] = np.array(self.exact([text.decode("utf-8")])[0], np.uint32)
        return out


def _encoder(spec: str) -> Encoder:
    """The encoder of this worker process: kept with the library, as shipped functions have no module of their own."""
    import tiktoken

    kept = tiktoken.__dict__.setdefault("_unit_encoders", {})
    key = hash(spec)
    if key not in kept:
        kept.clear()
        kept[key] = Encoder(spec)
    return kept[key]


def token_pieces(docs: DataFrame, spec: str, capacity: int, eos: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a vocabulary file: its size doesn't grow with the data

    def work(batches):
        enc = _encoder(shared.value)
        for batch in batches:
            for p in pieces(batch, size=ENCODED_BYTES):
                ids_of, rows = enc.encode(p.column("text")), ([], [], [], [], [])
                for doc, ids in zip(p.column("doc_id").to_pylist(), ids_of):
                    ids = np.append(ids, np.uint32(eos)).astype("<u4")
                    n, start, k = len(ids), 0, 0
                    while start < n:
                        length = (n % capacity or capacity) if k == 0 else capacity
                        for c, v in zip(rows, (doc, k, start, length, zlib.crc32(ids[start:start + length].tobytes()))):
                            c.append(v)
                        start, k = start + length, k + 1
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)],
                                                 names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, _PIECE)


def pack_pieces(found: DataFrame, capacity: int) -> DataFrame:
    """``found`` (a written table with doc_id, piece, length and more) with sequence_id and offset."""
    spark = found.sparkSession
    hist = {r["length"]: r["n"] for r in found.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    slots = plan(hist, capacity)  # at most a few slots for each of ``capacity`` lengths
    blocks = block_count(spark, sum(hist.values()), BLOCK_ROWS, 5_000)
    shared = spark.sparkContext.broadcast(slots)
    placed = found.withColumn("_block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int"))
    order = [F.col(c).asc_nulls_first() for c in found.columns]
    ranked = running_sum(placed, ["length"], "_block", order, F.lit(1), "_rank").drop("_block")
    cols = found.columns

    def work(batches):
        slots = shared.value
        key = (slots[:, 0] << 44) + slots[:, 1]
        for b in batches:
            rank = b.column("_rank").to_numpy()
            at = np.searchsorted(key, (b.column("length").to_numpy() << 44) + rank, "right") - 1
            hit = slots[at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(hit[:, 3] + rank - hit[:, 1]),
                                              pa.array(hit[:, 4])], names=[*cols, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*cols, "_rank").mapInArrow(work, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = f.read()
    work = Scratch(docs.sparkSession, "packing")
    return pack_pieces(work.table(token_pieces(docs, spec, capacity, eos), "pieces"), capacity)
