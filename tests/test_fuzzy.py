"""Scorer-based fuzzy joins against brute force over all pairs (small fixture)."""

import random
import re

from pyspark.sql import functions as F

from hygeia.operators import fuzzy_join as FJ
from hygeia.operators.fuzzy_join import fuzzy_join
from tests import plain_scores as P

SCORERS = {"partial_ratio": P.partial_ratio, "token_set_ratio": P.token_set_ratio, "wratio": P.weighted_ratio}


def process_py(s):
    return re.sub(r"\W", " ", s.lower()).strip(" ")


def test_scorer_reference_values():
    assert P.ratio("7543", "9654p") == 2 * 2 / 9 * 100
    assert P.partial_ratio("abc", "xxabcxx") == 100.0
    assert P.token_set_ratio("a b c", "c b a d") == 100.0
    assert P.token_set_ratio("", "a") == 0.0
    assert round(P.weighted_ratio("spec cpu", "spec cpu 2017"), 4) == 90.0  # partial branch, 0.9 scale
    assert round(P.weighted_ratio("spec cpu", "cpu spec"), 4) == 95.0  # token branch, 0.95 scale


def _brute(queries, cands, scorer, cutoff, n, process):
    out = {}
    for g, q in queries:
        sc = []
        for g2, c, o in cands:
            if g2 != g:
                continue
            a, b = (process_py(q), process_py(c)) if process else (q, c)
            s = SCORERS[scorer](a, b)
            if s >= cutoff:
                sc.append((-s, o, c, round(s / 100, 4)))
        sc.sort()
        out[(g, q)] = [(c, sc_) for _, _, c, sc_ in sc[:n]]
    return out


def test_fuzzy_join_matches_brute_force(spark):
    rnd = random.Random(3)
    words = ["milan", "genoa", "spec", "cpu", "int", "rate", "m6a", "large", "7543", "9654p", "x-1"]
    def txt():
        return " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 3)))
    cands = [(rnd.choice("ab"), txt(), i) for i in range(40)]
    queries = [(rnd.choice("ab"), txt()) for _ in range(25)]
    qdf = spark.createDataFrame(queries, "g string, q string")
    cdf = spark.createDataFrame(cands, "g string, c string, o int")
    for scorer, cutoff, process in [("partial_ratio", 10, True), ("token_set_ratio", 75, False),
                                    ("wratio", 60, False)]:
        got = {}
        for r in fuzzy_join(qdf, cdf, "g", "q", "c", "o", scorer, cutoff, 3, process).collect():
            got.setdefault((r["g"], r["q"]), []).append((r["rank"], r["c"], r["score"]))
        exp = _brute(set(queries), cands, scorer, cutoff, 3, process)
        for k, v in exp.items():
            assert [(c, s) for _, c, s in sorted(got.get(k, []))] == v, (scorer, k)


def test_token_set_join_of_similar_words(spark):
    """No common word is needed: typed words, joined words, short texts; every cut-off finds what all pairs find."""
    rnd = random.Random(11)
    words = ["intel", "xeon", "gold", "6338", "platinum", "amd", "epyc", "a", "i7", "x", "ab", "9654"]
    def typo(w):
        k = rnd.randrange(len(w) + 1)
        return rnd.choice([w, w[:k] + rnd.choice("xyz") + w[k:], w[:k] + w[k + 1:], w])
    def txt():
        return " ".join(typo(rnd.choice(words)) for _ in range(rnd.randint(0, 4)))
    cands = [(rnd.choice("ab"), txt(), i) for i in range(120)]
    queries = [(rnd.choice("ab"), txt()) for _ in range(80)] + [("a", "inteel xeeon"), ("a", "intelxeon gold"), ("b", "ab"), ("b", "  ")]
    qdf = spark.createDataFrame(queries, "g string, q string")
    cdf = spark.createDataFrame(cands, "g string, c string, o int")
    for cutoff in (75, 90, 50):
        got = {}
        for r in fuzzy_join(qdf, cdf, "g", "q", "c", "o", "token_set_ratio", cutoff, None).collect():
            got.setdefault((r["g"], r["q"]), set()).add((r["o"], r["score"]))
        exp = {k: {(o, round(P.token_set_ratio(k[1], c) / 100, 4)) for g, c, o in cands if g == k[0] and P.token_set_ratio(k[1], c) >= cutoff}
               for k in set(queries)}
        assert got == {k: v for k, v in exp.items() if v}, cutoff


def test_token_set_join_scores_few_pairs(spark):
    """Of texts with a few frequent words, a twentieth of all pairs is scored at most."""
    rnd = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda: "".join(rnd.choice(letters) for _ in range(rnd.randint(4, 9)))
    cands = [("a", f"{name()} {name()} {rnd.randrange(10**5)} cpu", i) for i in range(500)]
    queries = [("a", t.replace(" cpu", " pcu")) for _, t, _ in cands[:100]]
    qdf = spark.createDataFrame(queries, "g string, q string")
    cdf = spark.createDataFrame(cands, "g string, c string, o int")
    met, left = FJ.candidate_pairs(FJ._texts(qdf, "g", "q", False), FJ._texts(cdf, "g", "c", False), "g", "token_set_ratio", 75)
    counts = met.count(), left.count()
    want = sum(P.token_set_ratio(q, c) >= 75 for _, q in queries for _, c, _ in cands)
    assert want <= counts[1] <= counts[0], (counts, want)
    assert counts[1] <= len(queries) * len(cands) / 20, (counts, want)
