"""SentencePiece ids by a table of distinct marked words, and text from ids.

In the escaped text every space is a marker (U+2581). Where no piece of the model has a marker after another character, no piece
crosses the place before a run of markers, so a text falls into marked words (a run of markers and what follows up to the next)
that are segmented on their own. A task reads texts in blocks, gives every distinct marked word of its table a slot, has the library
segment each new one once, and joins the ids back by position: the slots of a text, in order, pick their ids.
The table is emptied when it holds ``TABLE`` words, so memory is bounded whatever the corpus holds. There is no shuffle.

The short way is taken only where it's exact: a BPE or unigram model with byte pieces, the identity normalizer with a leading marker
and all spaces kept, no user-defined pieces, no piece across a marker. With any other model each whole text is segmented.

Cases: a null text counts as empty and has no ids; long texts are cut at marked words, and a word is never cut; repeated
rows stay rows of their own; an empty table gives an empty result; other columns, ids among them, are replaced or left out.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hygeia.llm.quality import pieces

MARK = "▁"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Distinct marked words a task holds.
TABLE = 500_000
#: Bytes of text read at once.
BLOCK = 4 << 20
_LOADED: dict = {}


def _library(model: bytes):
    """The library's processor for ``model``, loaded once per worker process."""
    import sentencepiece

    key = hash(model)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = sentencepiece.SentencePieceProcessor(model_proto=model)
    return _LOADED[key]


def separable(model: bytes) -> bool:
    """Whether marked words may be segmented on their own (see above)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto.FromString(model)
    norm, kinds = spec.normalizer_spec, pb.ModelProto.SentencePiece.Type
    words = [p.piece for p in spec.pieces if p.type in (kinds.NORMAL, kinds.UNUSED)]
    return (spec.trainer_spec.model_type in (pb.TrainerSpec.BPE, pb.TrainerSpec.UNIGRAM) and not norm.precompiled_charsmap
            and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
            and not spec.trainer_spec.treat_whitespace_as_suffix and MARK in words
            and sum(p.type == kinds.BYTE for p in spec.pieces) == 256 and not any(p.type == kinds.USER_DEFINED for p in spec.pieces)
            and not any(MARK in w.lstrip(MARK) for w in words))


class WordTable:
    """Slots of distinct marked words; the ids of slot i are ``ids[start[i]:start[i + 1]]``."""

    def __init__(self, library, most: int = TABLE):
        self.library, self.most = library, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.ids, self.start = array("i"), array("q", [0])

    def _segment(self, words: list[str]) -> None:
        alone = [self.library.piece_to_id(MARK)]
        for i in range(0, len(words), 10_000):
            # the library puts a marker before what it's given, so each word goes in without its first one; a lone marker is a piece
            part = words[i:i + 10_000]
            for word, ids in zip(part, self.library.encode([w[1:].replace(MARK, " ") for w in part], num_threads=1)):
                ids = alone if word == MARK else ids
                self.ids.extend(ids)
                self.start.append(len(self.ids))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offset of each text and one more)."""
        if len(self.slot) > self.most:
            self.clear()
        slot, seen = self.slot, len(self.slot)
        at, first = array("q"), [0]
        for t in texts:
            if t:
                at.extend([slot.setdefault(w, len(slot)) for w in WORD.findall(MARK + t.replace(" ", MARK))])
            first.append(len(at))
        if len(slot) > seen:
            words = list(slot)
            self._segment(words[seen:])
        at, start = np.frombuffer(at, np.int64) if at else np.zeros(0, np.int64), np.frombuffer(self.start, np.int64)
        low, n = start[at], start[at + 1] - start[at]
        end = np.concatenate([[0], np.cumsum(n)])
        take = np.arange(end[-1]) + np.repeat(low - end[:-1], n)
        ids = np.frombuffer(self.ids, np.int32)[take] if len(take) else np.zeros(0, np.int32)
        return ids, end[np.array(first)]


def encode(docs: DataFrame, model_file: str) -> DataFrame:
    """doc_id and ids (array<int>) of each row's text, as the library's ``encode`` gives them (no begin or end ids, no sampling)."""
    with open(model_file, "rb") as f:
        model = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a model file: its size doesn't grow with the data
    by_word = separable(model)

    def work(batches):
        library = _library(shared.value)
        table = WordTable(library)
        for batch in batches:
            for p in pieces(batch, size=BLOCK):
                texts = p.column("text").to_pylist()
                if by_word:
                    ids, offsets = table.encode(texts)
                else:
                    lists = [library.encode(t or "") for t in texts]
                    ids, offsets = np.array([i for x in lists for i in x], np.int32), np.cumsum([0, *map(len, lists)])
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))],
                                                 names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(work, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with decoded, the text that the library's ``decode`` gives (null ids: empty)."""
    with open(model_file, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def work(batches):
        library = _library(shared.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                p = batch.slice(lo, 200)
                texts = [library.decode(ids.as_py() or []) for ids in p.column("ids")]
                yield pa.RecordBatch.from_arrays([p.column("doc_id"), p.column("ids"), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, ids array<int>, decoded string")
