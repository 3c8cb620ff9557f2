"""Ids of marked words against the library's own of whole texts."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hygeia.llm import queries, subwords
from tests.llm import data

MODEL = queries.pieces_model()


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


AWKWARD = ["", " ", "  ", "a ", " a", "▁", "▁ ▁a▁", "a  b   c" + " " * 40, "a\tb\n\n c\r\n", "<s> </s> <unk> <0x41>", "é é ﬁ Ａ 漢字 😀👩‍👩‍👧",
           "\x00\x01 ﻿​ x", "x" * 5_000, " " * 3_000 + "end", "ab" * 4_000 + " ab"]


def test_awkward(library):
    table = subwords.WordTable(library)
    for t in [*AWKWARD, *AWKWARD]:
        ids, _ = table.encode([t])
        assert ids.tolist() == library.encode(t), t[:40]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\n aeth")), max_size=60), max_size=5))
def test_texts(library, texts):
    ids, at = subwords.WordTable(library, most=3).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [library.encode(t) for t in texts]


def test_table_is_bounded(library):
    table = subwords.WordTable(library, most=50)
    for k in range(40):
        text = " ".join(f"w{k}x{j}" for j in range(30))
        assert table.encode([text])[0].tolist() == library.encode(text)
        assert len(table.slot) <= 50 + 30


def test_each_distinct_word_is_segmented_once(library):
    class Counting:
        def __init__(self):
            self.seen = []

        def __getattr__(self, name):
            return getattr(library, name)

        def encode(self, words, num_threads):
            self.seen += words
            return library.encode(words, num_threads=num_threads)

    counting = Counting()
    table = subwords.WordTable(counting)
    for _ in range(3):
        table.encode(["the cat the hat", "the cat  sat", "the"])
    assert sorted(counting.seen) == sorted({"the", "cat", "hat", " sat"})


@pytest.mark.parametrize("by_word", [True, False])
def test_whole(spark, library, monkeypatch, by_word):
    monkeypatch.setattr(subwords, "separable", lambda m: by_word)
    rows = [(r[0], r[1]) for r in data.documents()] + [(None, "no id "), (3, "twice"), (3, "twice")] + list(enumerate(AWKWARD))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit("old") for c in ("ids", "decoded", "n_tokens")})
    out = subwords.decode(subwords.encode(df, MODEL), MODEL).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    want = [(i, library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in rows]
    assert sorted(((r.doc_id, r.ids, r.decoded) for r in out), key=key) == sorted(want, key=key)


def test_query(spark, library, tmp_path):
    rows = [(1, "Hello  world "), (2, None), (2, "é")]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.op13_sentencepiece(spark, str(tmp_path)).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(e), sha(",".join(map(str, e))), sha(library.decode(e))) for i, t in rows for e in [library.encode(t or "")]]
    assert got == sorted(want)
    assert queries.op13_sentencepiece(spark.createDataFrame([], "doc_id bigint, text string").sparkSession, str(tmp_path)).count() == 3


def test_separable():
    with open(MODEL, "rb") as f:
        model = f.read()
    assert subwords.separable(model)
    from sentencepiece import sentencepiece_model_pb2 as pb

    for change in (lambda m: setattr(m.pieces[300], "piece", "a▁b"), lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True),
                   lambda m: setattr(m.normalizer_spec, "add_dummy_prefix", False), lambda m: setattr(m.pieces[300], "type", pb.ModelProto.SentencePiece.USER_DEFINED)):
        m = pb.ModelProto.FromString(model)
        change(m)
        assert not subwords.separable(m.SerializeToString())
