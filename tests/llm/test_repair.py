"""Conversation repair against all edit sequences, a plain program over whole strings, and hand-made cases."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hygeia.llm import repair, sql
from hygeia.llm.repair import Survivors

GOOD = re.compile(r"(s?(ua)+)?")
ROW = "conv_id bigint, turn bigint, role string, text string"


def run(rows):
    """(audit, cost) of rows (initial, must be deleted, truncated)."""
    s, out = Survivors(), []
    for r in rows:
        out += s.push((*r, r))
    out += s.finish()
    cost = sum(3 if e == "D" else 2 * (e != "K") + row[2] * 1 if row else 2 for e, _, row in out)
    return "".join(e for e, *_ in out), cost


def every(rows):
    """The least (cost, audit) over all sequences with at most two insertions in a place."""
    best = None
    gaps = [g for k in range(3) for g in itertools.product("ua", repeat=k)]
    choices = [[("D", "", 3)] + ([] if must else [("K", x, cut), ("R", "u", 2 + cut), ("R", "a", 2 + cut)]) for x, must, cut in rows]
    for edits in itertools.product(*choices):
        for ins in itertools.product(gaps, repeat=len(rows) + 1):
            roles, audit, cost = "", "", 0
            for k in range(len(rows) + 1):
                roles, audit, cost = roles + "".join(ins[k]), audit + "I" * len(ins[k]), cost + 2 * len(ins[k])
                if k < len(rows):
                    roles, audit, cost = roles + edits[k][1], audit + edits[k][0], cost + edits[k][2]
            if GOOD.fullmatch(roles) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best[::-1]


def plain(rows):
    """The same by a table of whole strings, nothing dropped."""
    state = {"": (0, "")}
    after = {"": "su", "s": "u", "u": "a", "a": "u"}

    def inserted(state):
        for _ in range(3):
            for s in list(state):
                t = after[s][-1]
                way = (state[s][0] + 2, state[s][1] + "I")
                if t not in state or way < state[t]:
                    state[t] = way
        return state

    state = inserted(state)
    for x, must, cut in rows:
        new = {}
        for s, (c, a) in state.items():
            ways = [(s, c + 3, a + "D")]
            if not must:
                ways += [(x, c + cut, a + "K")] if x and x in after[s] else []
                ways.append((after[s][-1], c + 2 + cut, a + "R"))
            for t, *w in ways:
                if t not in new or tuple(w) < new[t]:
                    new[t] = tuple(w)
        state = inserted(new)
    return min(state[s] for s in ("", "a") if s in state)[::-1]


rows = st.lists(st.tuples(st.sampled_from(["s", "u", "a", "x", ""]), st.booleans(), st.booleans()), max_size=40)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suax"), st.sampled_from([False, False, True]), st.booleans()), max_size=2))
def test_every_sequence(r):
    assert run(r) == every(r) == plain(r)


@settings(max_examples=400, deadline=None)
@given(rows)
def test_plain(r):
    assert run(r) == plain(r)


def test_long_and_tied():
    rng = random.Random(3)
    calm = [("ua"[k % 2], False, False) for k in range(20_000)]
    s = Survivors()
    for r in calm:
        s.push((*r, None))
    assert s.most_open < 10  # the whole conversation isn't held
    blank = Survivors()
    for _ in range(5_000):
        blank.push(("u", True, False, None))
    assert blank.most_open < 10
    for r in ([("u", False, False)] * 301, [("a", False, True)] * 200, [(rng.choice("sua"), rng.random() < .2, rng.random() < .3) for _ in range(600)],
              [("s", False, False)] * 90, [("u", True, False)] * 50 + [("s", False, False), ("u", False, False)]):
        assert run(r) == plain(r)


def brute(rows):
    """The contract's row of each conversation; rows: (conv, turn, role, text) after damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv),
                     key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        seen, faults = set(), []
        for _, r, x in own:
            body = x.strip(" \t\n\v\f\r")
            faults.append("blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        audit, cost = plain([(r[:1], f in ("blank", "duplicate"), f == "truncated") for (_, r, _), f in zip(own, faults)])
        kept, k, last = [], 0, ""
        for e in audit:
            if e in "DK":
                if e == "K":
                    last = own[k][1][:1]
                    kept.append(f"{own[k][1]}:{own[k][2]}")
                k += 1
            else:
                last = "a" if last == "u" else "u"
                kept.append({"u": "user:", "a": "assistant:"}[last] + (own[k][2] if e == "R" else ""))
                k += e == "R"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own)), cost, audit,
                     hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def hit(rows):
    out = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(k, x)
        if k:
            out += [(c, t, "user" if k == 4 else r, x)] * (2 if k == 3 else 1)
    return out


def table():
    rng = random.Random(7)
    rows = [(None, None, None, None), (None, 3, "user", "a."), (1, None, "user", "b."), (1, None, None, "c"), (2, 5, "", "."), (2, 5, "", "."), (3, 0, "user", " \n\t "),
            (4, -(2**40), "system", "é。"), (4, 2**40, "tool", "x!"), (5, 1, "user", "wait \n"), (5, 1, "assistant", "\x0b.\x0c")]
    for c in range(6, 90):
        for t in range(rng.randrange(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Yes.", "No", "Why?", "", "é !", "a" * 3000 + "."])))
    rows += [(200, t, "user" if t % 3 else "assistant", f"row {t}.") for t in range(3_000)]  # one long conversation
    rng.shuffle(rows)
    return rows


def found(df):
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r)[1:] for r in df.select(*names).collect()}


def test_table(spark):
    rows = table()
    df = spark.createDataFrame(rows, ROW).withColumns({c: F.lit("old") for c in ("seq", "edit", "audit", "copy")})
    got = found(repair.repaired_digests(df, repair.damaged(df)))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: none for c, *_ in rows} | brute(hit(rows))
    assert got == want and any(v == none for v in want.values())


def test_edits_are_the_repaired_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Still here"), (1, 2, "user", "Hi.")], ROW)
    got = [(r.seq, r.edit, r.fault, r.was, r.role, r.text, r.cost) for r in repair.repair(df).collect()]
    assert got == [(0, "K", None, "user", "user", "Hi.", 0), (1, "R", "truncated", "user", "assistant", "Still here", 3), (2, "D", "duplicate", "user", None, "Hi.", 3)]


def test_empty(spark):
    df = spark.createDataFrame([], ROW)
    assert repair.repaired_digests(df, repair.damaged(df)).collect() == []


def test_sql_of_odd_rows(spark):
    duckdb = pytest.importorskip("duckdb")
    conversations = spark.createDataFrame(table(), ROW).where("conv_id <> 200 or conv_id is null").toPandas()  # noqa: F841
    conversations["conv_id"] = conversations["conv_id"].astype("Int64")
    conversations["turn"] = conversations["turn"].astype("Int64")
    con = duckdb.connect()
    con.register("conversations", conversations)
    cur = con.execute(sql.CONVERSATION_REPAIR)
    names = [d[0] for d in cur.description]
    got = {r[0]: r[1:] for r in cur.fetchall()}
    assert names == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    want = brute(hit([r for r in table() if r[0] != 200]))
    assert {c: got[c] for c in want} == want
