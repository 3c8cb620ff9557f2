"""The bounded nearest-neighbour join against all pairs, and what it looks up."""

import math
import random
from collections import Counter

import pytest

from hygeia.operators import knn


def grams(text):
    t = " ".join(p for p in text.lower().split("  "))
    return Counter(t[i:i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))


def brute(queries, docs, n):
    """{(group, query): [(doc, score)]} by all pairs; docs: [(group, id, text, order)]."""
    out = {}
    for g, q in set(queries):
        own = [(i, grams(t), o) for h, i, t, o in docs if h == g]
        df = Counter(x for _, c, _ in own for x in c)
        idf = {x: math.log((1 + len(own)) / (1 + k)) + 1 for x, k in df.items()}
        vec = {x: k * idf[x] for x, k in grams(q).items() if x in idf}
        size = math.sqrt(sum(v * v for v in vec.values()))
        scored = []
        for i, c, o in own:
            s = sum(v * c[x] * idf[x] for x, v in vec.items() if x in c)
            if s:
                scored.append((-round(s / size / math.sqrt(sum((k * idf[x]) ** 2 for x, k in c.items())), 10), o, i))
        if scored:
            out[g, q] = [(i, round(-s, 4)) for s, _, i in sorted(scored)[:n]]
    return out


def table(seed, n_docs=300, n_queries=80):
    rng = random.Random(seed)
    words = ["standard", "polished", "tin", "brass", "copper", "brand#12", "brand#34", "xeon", "epyc", "milan", "7543", "9654p", "large", "small box"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6)))
    docs = [(rng.choice("ab"), i, text(), rng.randrange(50) * 1000 + i) for i in range(n_docs)]
    docs += [("c", n_docs, "only", 0), ("a", n_docs + 1, docs[0][2], 7), ("a", n_docs + 2, "", 3), ("a", n_docs + 3, "x", 4)]
    queries = [(rng.choice("ab"), text()) for _ in range(n_queries)]
    queries += [("a", docs[0][2]), ("c", "only  one"), ("c", "zzz"), ("d", "tin"), ("a", ""), ("a", "q"), ("b", "stendard  polish tin")]
    typo = [(g, t[:3] + "x" + t[4:]) for g, _, t, _ in docs[:20]]
    return queries + typo, docs


def frames(spark, queries, docs):
    return spark.createDataFrame(queries, "g string, q string"), spark.createDataFrame(docs, "g string, id long, t string, o long")


@pytest.mark.parametrize("seed, n", [(1, 3), (2, 1), (3, 7)])
def test_equals_all_pairs(spark, seed, n):
    queries, docs = table(seed)
    q, d = frames(spark, queries, docs)
    got = {}
    for r in knn.knn_join(q, d, "g", "q", "id", "t", "o", n).collect():
        got.setdefault((r.g, r.q), {})[r["rank"]] = (r.id, r.score)
    want = brute(queries, docs, n)
    assert set(got) == set(want)
    for k, v in want.items():
        assert [got[k][i + 1] for i in range(len(v))] == v, k


def test_least_score(spark):
    queries, docs = table(4)
    q, d = frames(spark, queries, docs)
    got = {(r.g, r.q, r.id) for r in knn.knn_join(q, d, "g", "q", "id", "t", "o", 3, min_score=0.6).collect()}
    assert got == {(*k, i) for k, v in brute(queries, docs, 3).items() for i, s in v if s >= 0.6}


def test_few_pairs_are_looked_up(spark):
    """The steps together read at most a quarter of the postings that a join on every gram reads."""
    rng = random.Random(8)
    syllables = ["stan", "dard", "ano", "dized", "pol", "ished", "xe", "on", "ep", "yc", "mi", "lan", "ge", "noa", "ber", "ga", "mo", "rome"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randrange(2, 4))) for _ in range(150)]
    docs = [("a", i, f"{rng.choice(['amd', 'intel', 'arm'])} {rng.choice(names)} {rng.choice(names)} {rng.randrange(10**4)} cpu", i) for i in range(4_000)]
    queries = [("a", t[:-1] + rng.choice("0123456789")) for _, _, t, _ in rng.sample(docs, 200)]
    q, d = frames(spark, queries, docs)
    index, weights = knn.build_index(d, "g", "id", "t")
    steps = knn.knn_steps(q.selectExpr("g", "q as _q").distinct(), index, weights, "g", "id", 3)
    read = [x.count() for x in steps.read]
    df = Counter(x for _, _, t, _ in docs for x in grams(t))
    every = sum(df[x] for t in {t for _, t in queries} for x in grams(t))
    assert 4 * sum(read) <= every, (read, every)
