"""Near-duplicate classes of template documents around the threshold, against all pairs."""

import random

import pytest

from hygeia.llm import minhash
from tests.llm import brute, data


def templates(words, seed=3, groups=150):
    """Documents of one template, mostly just under 0.8 of each other. The two of a group differ from the template at
    the same two places, by other words: they have no shingle of their own in common, but reach 0.8."""
    rng, texts = random.Random(seed), []
    base = data.sentence(rng, words, 5000).split()
    for g in range(groups):
        places = [rng.randrange(4, words // 2 - 10), rng.randrange(words // 2, words - 4)]
        for m in range(2):
            w = base.copy()
            for k, at in enumerate([*places, rng.randrange(4, words - 4)]):
                w[at] = f"own{g}x{m}x{k}"
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words", [240, 270])
def test_template_documents(spark, words):
    docs = templates(words)
    got = {r["doc_id"]: r["class_id"] for r in
           minhash.near_classes(spark.createDataFrame(docs, "doc_id bigint, text string"), chunk_bytes=50_000).collect()}
    want = brute.near_classes(docs)
    assert 20 < len(set(want.values())) < len(docs)
    assert got == want


def test_one_row_of_each_component(spark):
    rng = random.Random(8)
    a, b, c, d = (data.sentence(rng, 60, 5000) for _ in range(4))
    # two texts under one id, null ids with different texts and near copies
    docs = [(1, a), (1, b), (2, a + " more"), (None, c), (None, c + " more"), (None, d), (3, b), (3, b), (None, ""), (None, " ")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = minhash.near_dedup(table).collect()
    texts = [r["text"] for r in got]
    assert sum(t.startswith(c) for t in texts) == 1
    assert sorted(t for t in texts if not t.startswith(c)) == sorted(["", " ", a, b, d])
    assert {r["doc_id"] for r in got if r["text"] in (a, b)} == {1}
    assert sum(r["kept"] for r in minhash.near_classes(table).collect()) == 6
