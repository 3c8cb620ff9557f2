"""Score expressions against plain programs, at word borders of the bit states and on random texts."""

import random

import pytest

from hygeia.functions import scores as S
from tests import plain_scores as P

SCORES = {"lcs": P.lcs, "ratio": P.ratio, "partial_ratio": P.partial_ratio, "token_set_ratio": P.token_set_ratio, "weighted_ratio": P.weighted_ratio}


def both(spark, name, pairs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string").repartition(4)
    got = {r.i: r.s for r in df.select("i", getattr(S, name)(F.col("a"), F.col("b")).alias("s")).collect()}
    for i, (a, b) in enumerate(pairs):
        assert got[i] == pytest.approx(SCORES[name](a, b), abs=1e-9), (name, a, b)


def random_pairs(n, seed):
    rng = random.Random(seed)
    words = ["milan", "genoa", "spec", "cpu", "int", "rate", "m6a", "large", "7543", "9654p", "x-1", "é漢", "a"]
    text = lambda: rng.choice([" ", "  "]).join(rng.choice(words) for _ in range(rng.randrange(0, 5)))
    return [(text(), text()) for _ in range(n)] + [("", ""), ("", "a"), (" ", "a"), ("a", "a"), ("ab", "ba"), ("spec cpu", "spec cpu 2017"), ("a b c", "c b a d")]


@pytest.mark.parametrize("name", list(SCORES))
def test_random(spark, name):
    both(spark, name, random_pairs(120, 1))


def test_word_borders(spark):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choice("abcé") for _ in range(n))
    sizes = [1, 59, 60, 61, 62, 63, 64, 65, 119, 120, 121, 124, 128, 130, 1000]
    pairs = [(text(m), text(n)) for m in sizes for n in (1, 60, 61, 120, 121, 300)] + [("a" * 200, "a" * 130), ("ab" * 500, "ba" * 500)]
    both(spark, "lcs", pairs)
    both(spark, "partial_ratio", [(text(61), text(90)), (text(70), text(70)), ("x" * 65, "y" * 80 + "x" * 65)])
