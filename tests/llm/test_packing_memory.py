"""Memory of the encoder of a worker: arrays over the units of a bounded run of text, few units kept."""

import tracemalloc

import pyarrow as pa

from hygeia.llm import packing as P
from hygeia.llm.queries import vocabulary


def encoder():
    with open(vocabulary(), encoding="utf-8") as f:
        return P.Encoder(f.read())


def test_a_run_of_text_takes_bounded_memory():
    texts = [" ".join(f"w{(i * 7919 + k * 31) % 90_000}" for k in range(2_000)) for i in range(600)]
    batch, enc = pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), encoder()
    tracemalloc.start()
    for p in P.pieces(batch, size=P.ENCODED_BYTES):
        enc.encode(p.column("text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150e6, peak


def test_ids_do_not_depend_on_the_units_kept(monkeypatch):
    texts = [f"one two {i} three\nfour  five {i % 3}" for i in range(40)] + ["", "it's"]
    kept = [x.tolist() for x in encoder().encode(pa.array(texts))]
    monkeypatch.setattr(P, "KEPT_UNITS", 3)
    enc = encoder()
    assert [enc.encode(pa.array([t]))[0].tolist() for t in texts] == kept
