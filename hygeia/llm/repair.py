"""Repair of conversations: the cheapest edits that make their roles alternate, by a survivor-coalescence Viterbi search.

A conversation's rows are read in order (turn, nulls first; then role and text). Each row is kept (0), given the role user or
assistant (2) or deleted (3; a blank or duplicate row must be), and a row of empty text may be inserted anywhere (2); a
truncated row that stays costs 1 more. The roles that result read ``(s?(ua)+)?`` by their initials. Among the
cheapest edits those whose letters (K, R, D, I) are least in ASCII order are taken.

The search has four states: nothing yet, after s, after u, after a. One survivor a state stands in a tree of backpointers
whose nodes count what refers to them: a branch without a survivor is freed at once, and as soon as all survivors
share an ancestor the edits up to it are put out and forgotten. What is held is the part still open, not the
conversation. Ties compare the whole open paths: letters of two survivors that have read the same rows are never a prefix of each other,
so their order is one rank a survivor, renewed at each row, and a comparison looks at rank and new letters only. A
survivor that can't win any more, not even by a tie, is dropped; else the one that deleted everything would hold
the tree open for ever.

Rows are shuffled by conversation and stream through one task in sorted order (the sort spills); duplicates are found before, by
a window per (conversation, role, text), so that no task remembers a conversation's texts.

Cases: a null role or text counts as one space; null conversations are one conversation; null turns come first; equal rows are
interchangeable; roles without an initial fit nowhere; a conversation without rows has no edits; an empty table gives an empty
result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: ASCII white space.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT = "KRDI"
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after a row whose role is kept, by its initial; and after a role chosen by the edit.
KEPT = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
CHOSEN = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
ROLE = {AFTER_U: "user", AFTER_A: "assistant"}
EDIT = [("seq", T.LongType()), ("edit", T.StringType()), ("cost", T.IntegerType()), ("fault", T.StringType()), ("turn", T.LongType()),
        ("was", T.StringType()), ("role", T.StringType()), ("text", T.StringType())]
BATCH = 2_000


class _Node:
    """An edit on a path: letter, state after it, row. ``refs`` counts children and survivors that stand here."""

    __slots__ = ("parent", "edit", "kids", "refs")

    def __init__(self, parent: _Node | None, edit: tuple | None):
        self.parent, self.edit, self.kids, self.refs = parent, edit, set(), 0
        if parent is not None:
            parent.kids.add(self)
            parent.refs += 1


class Survivors:
    """The search over one conversation. ``push`` and ``finish`` return edits (letter, state, row) that are certain by now."""

    def __init__(self):
        self.root = _Node(None, None)
        self.live: dict[int, tuple] = {START: (0, 0, "", self.root)}  # state: cost, rank, letters since, node
        self.root.refs += 1
        self._insert()
        self.open = self.most_open = 0

    def _insert(self) -> None:
        """Rows inserted here: u from the start, after s or after a; then a after u."""
        for to, sources in ((AFTER_U, (START, AFTER_S, AFTER_A)), (AFTER_A, (AFTER_U,))):
            ways = [(c + 2, r, w + INSERT, n) for c, r, w, n in (self.live[s] for s in sources if s in self.live)]
            best = min(ways, key=lambda x: x[:3], default=None)
            if best and (to not in self.live or best[:3] < self.live[to][:3]):
                node = _Node(best[3], (INSERT, to, None))
                node.refs += 1
                old = self.live.get(to)
                self.live[to] = (*best[:3], node)
                if old:
                    self._release(old[3])

    def _release(self, node: _Node) -> None:
        node.refs -= 1
        while node.refs == 0 and node.parent is not None:
            parent = node.parent
            parent.kids.discard(node)
            parent.refs -= 1
            node.parent = None
            node = parent

    def push(self, row: tuple) -> list[tuple]:
        """``row``: (initial, must be deleted, truncated, anything else ...)."""
        initial, must, truncated = row[:3]
        ways: dict[int, tuple] = {}

        def offer(to: int, cost: int, rank: int, letters: str, node: _Node) -> None:
            if to not in ways or (cost, rank, letters) < ways[to][:3]:
                ways[to] = (cost, rank, letters, node)

        for state, (cost, rank, since, node) in self.live.items():
            offer(state, cost + 3, rank, since + DELETE, node)
            if not must:
                if (to := KEPT[state].get(initial)) is not None:
                    offer(to, cost + truncated, rank, since + KEEP, node)
                offer(CHOSEN[state], cost + 2 + truncated, rank, since + REROLE, node)
        old = [s[3] for s in self.live.values()]
        order = {k: i for i, k in enumerate(sorted(w[1:3] for w in ways.values()))}
        self.live = {}
        for to, (cost, rank, letters, parent) in ways.items():
            node = _Node(parent, (letters[-1], to, row))
            node.refs += 1
            self.live[to] = (cost, order[rank, letters], "", node)
        for node in old:
            self._release(node)
        self._insert()
        self._drop()
        self.open += 1
        return self._certain()

    def _drop(self) -> None:
        """Every way on from after-s, and all but one kept s (3 to delete) of the start's, are open after a as well."""
        cost = {s: v[0] for s, v in self.live.items()}
        far = 1 << 62
        if cost.get(AFTER_S, -1) > min(cost.get(AFTER_A, far), cost.get(START, far)):
            self._release(self.live.pop(AFTER_S)[3])
        if cost.get(START, -1) > cost.get(AFTER_A, far) + 3:
            self._release(self.live.pop(START)[3])

    def _certain(self) -> list[tuple]:
        out = []
        while self.root.refs == 1 and len(self.root.kids) == 1:
            self.root = self.root.kids.pop()
            self.root.parent = None
            out.append(self.root.edit)
        self.most_open = max(self.most_open, self.open)
        self.open -= sum(e[2] is not None for e in out)
        return out

    def finish(self) -> list[tuple]:
        *_, node = min((self.live[s] for s in (START, AFTER_A) if s in self.live), key=lambda x: x[:3])
        path = []
        while node is not self.root:
            path.append(node.edit)
            node = node.parent
        return path[::-1]


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (blank, duplicate, truncated or null) and copy (number among rows equal in role and text)."""
    rows = rows.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"),
                       F.coalesce("text", F.lit(" ")).alias("text"))
    first = W.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    ends = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = (F.when(ends == "", "blank").when(F.col("copy") > 1, "duplicate").when(~F.right(ends, F.lit(1)).isin(".", "!", "?"), "truncated"))
    return rows.withColumn("copy", F.row_number().over(first)).withColumn("fault", fault)


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation in order: conv_id, seq (from 0), edit, cost, fault, turn, was (role before, null of an inserted
    row), role and text (after, null role of a deleted row). Rows of a conversation stay together and sorted in their partition."""
    marked = with_faults(rows)
    kind = marked.schema["conv_id"]
    schema = T.StructType([kind, *[T.StructField(n, t) for n, t in EDIT]])
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text", "copy"]
    arranged = marked.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text", "fault")

    def work(batches):
        out: list[list] = [[] for _ in range(9)]
        search, conv, seq = None, None, 0
        field = None

        def put(edits):
            nonlocal seq
            for letter, state, row in edits:
                turn, was, text, fault = row[3:] if row else (None, None, "", None)
                cost = 3 if letter == DELETE else 2 * (letter != KEEP) + (fault == "truncated")
                role = {KEEP: was, DELETE: None}.get(letter, ROLE.get(state))
                for c, v in zip(out, (conv, seq, letter, cost, fault, turn, was, role, text)):
                    c.append(v)
                seq += 1

        def flush():
            kinds = (field, pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=schema.names)
            for c in out:
                c.clear()
            return b

        for batch in batches:
            field = batch.schema.field("conv_id").type
            for lo in range(0, batch.num_rows, BATCH):
                part = batch.slice(lo, BATCH)
                for c, turn, role, text, fault in zip(*(part.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text", "fault"))):
                    if search is None or c != conv:
                        if search is not None:
                            put(search.finish())
                        search, conv, seq = Survivors(), c, 0
                    put(search.push((role[:1], fault in ("blank", "duplicate"), fault == "truncated", turn, role, text, fault)))
                if out[0]:
                    yield flush()
        if search is not None:
            put(search.finish())
            if out[0]:
                yield flush()

    return arranged.mapInArrow(work, schema)


def digests(edits: DataFrame) -> DataFrame:
    """One row per conversation of ``repair``'s rows (which lie in order in their partition): counts of faults, gaps between turns, illegal
    neighbours before the repair, cost, audit (the letters) and repaired_sha256. Texts pass through a running hash."""
    kind = edits.schema["conv_id"]
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    schema = T.StructType([kind, *[T.StructField(n, T.LongType()) for n in longs], T.StructField("audit", T.StringType()),
                           T.StructField("repaired_sha256", T.StringType())])

    def work(batches):
        rows: list[tuple] = []
        conv = state = field = None

        def close():
            n, low, high, distinct, _, audit, sha, _ = state
            gaps = high - low + 1 - distinct if distinct else 0
            rows.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], n["illegal"], n["cost"], "".join(audit), sha.hexdigest()))

        def flush():
            kinds = (field, *[pa.int64()] * 6, pa.string(), pa.string())
            b = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=schema.names)
            rows.clear()
            return b

        for batch in batches:
            field = batch.schema.field("conv_id").type
            names = ("conv_id", "edit", "cost", "fault", "turn", "was", "role", "text")
            for c, edit, cost, fault, turn, was, role, text in zip(*(batch.column(x).to_pylist() for x in names)):
                if state is None or c != conv:
                    if state is not None:
                        close()
                    # counts, least and greatest turn, distinct turns, initial before, letters, hash, whether a row was hashed
                    conv, state = c, [dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "cost"), 0), None, None, 0, None, [],
                                      hashlib.sha256(), False]
                n = state[0]
                n["cost"] += cost
                if fault:
                    n[fault] += 1
                if edit != INSERT:
                    if state[4] is not None and state[4] + was[:1] not in ("su", "ua", "au"):
                        n["illegal"] += 1
                    state[4] = was[:1]
                    if turn is not None:
                        state[3] += turn != state[2]
                        state[1] = turn if state[1] is None else state[1]
                        state[2] = turn
                state[5].append(edit)
                if edit != DELETE:
                    state[6].update((b"\n" if state[7] else b"") + f"{role}:{text}".encode())
                    state[7] = True
            if len(rows) >= BATCH:
                yield flush()
        if state is not None:
            close()
        if rows:
            yield flush()

    return edits.mapInArrow(work, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults set by crc32 of conv_id:turn modulo 20: 0 drops a row, 1 empties its text, 2 takes out its
    ``[.!?]``, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    k = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    hit = conversations.select("conv_id", "turn", k.alias("_k"), role.alias("role"), text.alias("text")).where("_k <> 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("_k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("_k") == 1, "").when(F.col("_k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("_k") == 3, 2).otherwise(1))).alias("_copy")).drop("_copy")


def repaired_digests(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """``digests`` of the repaired ``rows`` for every conv_id of ``conversations``; zeros and empty texts where no row is left."""
    found = digests(repair(rows)).withColumnRenamed("conv_id", "_conv")
    every = conversations.select("conv_id").distinct()
    longs: list[Column] = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return (every.join(found, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
            .select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256")))
