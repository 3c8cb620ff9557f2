"""Rows that share a doc_id are cut in the same place whatever their order."""

import itertools

from hygeia.llm import mixing
from tests.llm import data


def test_six_orders(spark):
    rows = [(1, "a b c d e", "en", "x", 9), (1, "v w x y z", "en", "x", 9), (1, "one two", "en", "x", 7), (2, "p q r", "en", "x", 5),
            (2, "r q p", "en", "x", 5), (None, "n o", "en", "y", 3), (None, "o n", "en", "y", 3)]
    taken = set()
    for order in itertools.islice(itertools.permutations(rows), 0, 5040, 840):
        out = mixing.mix_sources(data.frame(spark, list(order)).repartition(3)).collect()
        taken.add(tuple(sorted((r.source, r.doc_id or 0, r.text, r.taken) for r in out)))
    assert len(taken) == 1
