"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from hygeia.llm import spelling
from tests.llm import data


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def groups(counts, ratio=2):
    """{word: (form, root, n, n_near, form_n)} by all pairs."""
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    form = {}
    for w, of in near.items():
        top = min(of, key=lambda x: (-counts[x], x), default=None)
        form[w] = top if top is not None and counts[top] >= ratio * counts[w] else None
    out = {}
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None)
    return out


def counted(rows, spoil=97, least=5, often=3):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if spoil and h % spoil == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= least and k >= often}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_whole(spark):
    rng = random.Random(5)
    letters = "abcdeéÀß"
    words = ["".join(rng.choice(letters) for _ in range(rng.randrange(4, 9))) for _ in range(150)]
    words += [w[:k] + rng.choice(letters) + w[k + rng.randrange(2):] for w in words for k in (0, 1, len(w) // 2, len(w) - 1, len(w))]
    words += ["aaaaa", "aaaaaa", "aaaaaaa", "ababab", "bababa", "abababa", "×÷×÷×"]
    weight = [rng.choice([1, 1, 2, 5, 20]) for _ in words]
    rows = [(i, " ".join(rng.choices(words, weight, k=200))) for i in range(200)]
    rows += [(None, "Straße STRASSE naïve " * 9), (7, None), (7, ""), (7, "x" * 300_000 + " " + "y" * 5), (8, rows[0][1]), (8, rows[0][1])]
    df = spark.createDataFrame([(*r, "old", "old") for r in rows], "doc_id bigint, text string, word string, n string")
    counts = counted(rows, 7)
    got = found(spelling.spelling_variants(df, spoil=7))
    assert got == groups(counts) and len(counts) > 400
    assert any(v[0] and v[0] != v[1] for v in got.values())  # a chain of forms


def test_long_texts_are_counted_alike(spark, monkeypatch):
    rows = [(i, t) for i, t, *_ in data.documents()] + [(1, "Hello wörld " * 500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = counted(rows, None, 1, 1)
    for long, held in ((1 << 22, 200_000), (10, 3)):
        monkeypatch.setattr(spelling, "LONG", long)
        monkeypatch.setattr(spelling, "HELD", held)
        assert {r.word: r.n for r in spelling.word_counts(df, 1).collect()} == want


def test_chains_and_empty(spark):
    chain = [("aaaaa" + "b" * k, 3 * 2**k) for k in range(12)]  # twelve steps to the root
    got = found(spelling.variant_groups(spark.createDataFrame(chain, "word string, n bigint")))
    assert got == groups(dict(chain)) and got["aaaaa"][1] == chain[-1][0]
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


@settings(max_examples=15, deadline=None)
@given(st.sets(st.text("abé", min_size=5, max_size=7), max_size=60))
def test_near_words(spark, words):
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n bigint")
    got = {(r.word, r.near) for r in spelling.near_words(df).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_no_join_by_broadcast(spark, monkeypatch):
    """The file of a vocabulary is far smaller than its keys in memory, so its size must not choose the join."""
    tables, plans = spelling.Scratch.table, []
    monkeypatch.setattr(spelling.Scratch, "table", lambda self, df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), tables(self, df, name))[1])
    words = spark.createDataFrame([("hello", 9), ("hallo", 4), ("hullo", 1), ("other", 3)], "word string, n bigint")
    out = spelling.variant_groups(words)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
    assert found(out)["hullo"] == ("hello", "hello", 1, 2, 9) and found(out)["hallo"] == ("hello", "hello", 4, 2, 9)
