"""Operators on documents against plain versions, on awkward small tables."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hygeia.llm import minhash, mixing, packing, quality, queries, sharding, sketch, substring
from tests.llm import brute, data

ROWS = data.documents()
#: The same rows, some of them twice, with a null id; and columns whose names clash with the results'.
TWICE = ROWS + ROWS[:10] + [(None, "no id", None, None, 5), (None, ROWS[3][1], "en", "a", 1)]
CLASH = ["size", "kept", "n_words", "longest", "target", "taken", "shard", "slot", "curve", "base_failed"]


@pytest.fixture(scope="module")
def docs(spark):
    return data.frame(spark, ROWS).cache()


@pytest.fixture(scope="module")
def twice(spark):
    d = data.frame(spark, TWICE)
    return d.withColumns({c: F.lit("old") for c in CLASH}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return data.frame(spark, [])


def rows(df):
    return [tuple(r) for r in df.collect()]


# ---- 1 -----------------------------------------------------------------------
def test_quality_base(twice):
    got = collections.Counter(rows(quality.judge(twice).select("doc_id", *quality.BASE, "base_failed")))
    want = collections.Counter()
    for i, t, *_ in TWICE:
        b = brute.base(t)
        want[(i, *b, b[0] < 50 or 100 * b[4] > 50 * b[0])] += 1
    assert got == want


def test_quality_verdict_does_not_depend_on_the_order():
    import pyarrow as pa
    texts = pa.array([t for _, t, *_ in ROWS] + ["LOUD!! WORDS!! " * 40, "a%%% b$$$ c### " * 30, "x\nline\n" * 50])
    rules = list(quality.RULES.values())
    a, b = quality.cascade(texts, rules), quality.cascade(texts, rules[::-1])
    each = np.all([~r(quality.Batch(texts)) for r in rules], axis=0)
    assert (a == b).all() and (a == each).all() and not a[-3:].any()


def test_quality_empty(empty):
    assert rows(quality.judge(empty)) == []


# ---- 2 -----------------------------------------------------------------------
def check_packing(got, table):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(queries.vocabulary())
    places, by = collections.defaultdict(list), collections.Counter()
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
        by[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
    want = collections.Counter()
    for i, t, *_ in table:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [2]
        at = 0
        for k, size in enumerate([len(ids) % 1024 or 1024][:1] + [1024] * 10_000):
            if at >= len(ids):
                break
            size = min(size, len(ids)) if len(ids) > 1024 else len(ids)
            want[i, k, at, size, zlib.crc32(np.array(ids[at:at + size], "<u4").tobytes())] += 1
            at += size
    assert by == want
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 1024
    return len(places)


def test_packing(twice, empty):
    got = packing.pack_documents(twice, queries.vocabulary()).collect()
    n = check_packing(got, TWICE)
    total = sum(r["length"] for r in got)
    assert n <= total / 1024 * 1.02 + 1
    assert rows(packing.pack_documents(empty, queries.vocabulary())) == []


BITS = [*"ab1'!\n\t\r é漢😀", "\u00a0", "\u2003", "\x85", "\x1c", "'s", "  ", "<|endoftext|>"]


@given(st.lists(st.sampled_from(BITS), max_size=30).map("".join))
@settings(max_examples=300, deadline=None)
def test_units_have_the_tokens_of_the_text(text):
    import pyarrow as pa
    enc = test_units_have_the_tokens_of_the_text.__dict__.setdefault("enc", packing.Encoder(open(queries.vocabulary(), encoding="utf-8").read()))
    got = enc.encode(pa.array([text, "x y\nz", text + text]))
    assert [g.tolist() for g in got] == enc.exact([text, "x y\nz", text + text])


@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_reduction_keeps_the_optimum(lengths):
    hist = dict(collections.Counter(lengths))
    fixed, left = packing.reduce_instance(hist, 20)
    assert all(sum(b) <= 20 for b, _ in fixed)
    rest = [k for k, n in left.items() for _ in range(n)]
    used = collections.Counter(rest)
    for b, n in fixed:
        for k in b:
            used[k] += n
    assert used == collections.Counter(lengths)
    assert sum(n for _, n in fixed) + brute.fewest_bins(rest, 20) == brute.fewest_bins(lengths, 20)


# ---- 3 -----------------------------------------------------------------------
def test_mixing(twice, empty):
    got = mixing.mix_sources(twice).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    again = mixing.mix_sources(twice.repartition(7)).select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collections.Counter(got) == collections.Counter(again)
    sizes = collections.Counter()
    for _, t, _, s, _ in TWICE:
        sizes[s] += len(brute.words(t))
    want, taken = brute.targets(sizes), collections.Counter()
    assert collections.Counter((r["doc_id"], r["size"]) for r in got) == collections.Counter(
        (i, len(brute.words(t))) for i, t, *_ in TWICE)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    assert rows(mixing.mix_sources(empty)) == []


def test_mix_limit(spark):
    rows_ = [(i, "w " * n, "en", s, 0) for i, (n, s) in enumerate([(1, "a"), (1000, "b"), (500, "c"), (0, "d")])]
    got = {r["source"]: r for r in mixing.mix_sources(data.frame(spark, rows_)).collect()}
    assert got["a"]["target"] == 3.0 and got["a"]["taken"] == 3 and got["d"]["taken"] == 0
    copies = collections.Counter(r["doc_id"] for r in mixing.mixed_documents(data.frame(spark, rows_)).collect())
    assert copies[0] == 3 and copies[3] == 0


# ---- 4 -----------------------------------------------------------------------
def test_hilbert_curve_is_a_path(spark):
    for n, bits in ((2, 3), (3, 2), (4, 2)):
        side = 2**bits
        points = spark.range(side**n).select(*[F.expr(f"cast(id div {side**k} % {side} as int)").alias(f"x{k}") for k in range(n)])
        cols = [F.col(f"x{k}") for k in range(n)]
        got = sorted((r[n], r[:n]) for r in points.select(*cols, sharding.hilbert_index(cols, bits)).collect())
        assert [h for h, _ in got] == list(range(side**n))
        assert all(sum(abs(a - b) for a, b in zip(p, q)) == 1 for (_, p), (_, q) in zip(got, got[1:]))


def test_shards(twice, empty):
    got = sharding.hilbert_shards(twice).collect()
    slots = collections.defaultdict(list)
    for r in got:
        raw = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        slots[r["shard"]].append(r["slot"])
    assert set(slots) <= set(range(16)) and len(got) == len(TWICE)
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    curve = sorted((r["shard"], r["slot"], r["curve"]) for r in got)
    assert [c for *_, c in curve] == sorted(c for *_, c in curve)
    assert rows(sharding.hilbert_shards(empty)) == []


# ---- 7 -----------------------------------------------------------------------
def test_substring(twice):
    out = substring.substring_dedup(twice, chunk_bytes=20_000)
    joined = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    got = collections.Counter(rows(out.select("doc_id", "n_words", "n_removed", F.sha2(joined, 256))))
    assert got == collections.Counter(brute.substring([(i, t) for i, t, *_ in TWICE]))


def test_substring_levels(spark, empty):
    rng_text = " ".join(f"u{i}" for i in range(60))
    d = data.frame(spark, [(1, "x " + rng_text, "en", "a", 0), (2, rng_text + " y", "en", "a", 0), (3, "z " * 3, "en", "a", 0)])
    got = {r["doc_id"]: (r["n_removed"], r["longest"], r["text"]) for r in substring.substring_dedup(d).collect()}
    assert got == {1: (0, 52, "x " + rng_text), 2: (60, 52, "y"), 3: (0, 0, "z " * 3)}
    assert rows(substring.substring_dedup(empty)) == []


# ---- 8 -----------------------------------------------------------------------
def test_near_classes(docs, empty):
    got = {r["doc_id"]: r for r in minhash.near_classes(docs, chunk_bytes=20_000).collect()}
    want = brute.near_classes([(i, t) for i, t, *_ in ROWS])
    assert {i: r["class_id"] for i, r in got.items()} == want
    assert sum(r["kept"] for r in got.values()) == len(set(want.values()))
    assert rows(minhash.near_classes(empty)) == []


def test_near_dedup_keeps_one_row_of_a_class(twice):
    kept = minhash.near_dedup(twice).collect()
    want = brute.near_classes([(i, t) for i, t, *_ in ROWS])
    ids = [r["doc_id"] for r in kept if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(want.values())) and set(kept[0].asDict()) == set(twice.columns)


def test_samples_agree_with_the_similarity():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 300).astype(np.uint64)
    a, b = np.sort(h[:220]), np.sort(h[60:])
    wa, wb = 1 + (a % np.uint64(5)).astype(float), 1 + (b % np.uint64(5)).astype(float)
    sig = minhash.signature(np.array([0, len(a)]), np.concatenate([a, b]), np.concatenate([wa, wb]), 2000)
    true = minhash.weighted_jaccard((a, wa), (b, wb))
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04


# ---- 10 ----------------------------------------------------------------------
def test_fingerprints(docs, empty):
    d = queries_on(docs)
    want, order = {}, sorted(ROWS, key=lambda r: -r[0])
    jac = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, t, *_) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want[i] = (t, t[:len(t) - half] + nxt[:half], nxt)
    shapes = {}
    for r in d.collect():
        t, edited, nxt = want[r["doc_id"]]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        s = [set(brute.shingles(x)) for x in (t, edited, nxt)]
        assert abs(r["near_edited"] - jac(s[0], s[1])) < 0.2 and abs(r["near_next"] - jac(s[0], s[2])) < 0.2
        assert shapes.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert queries_on(empty).collect() == []


def queries_on(docs):
    return sketch.edited_fingerprints(docs, chunk_bytes=20_000).select(
        "doc_id", "n_chars", "edited_sha256", sketch.fingerprint("sketch").alias("fingerprint"),
        sketch.resemblance("sketch", "edited_sketch").alias("near_edited"),
        sketch.resemblance("sketch", "next_sketch").alias("near_next"))


def test_fingerprints_repeated_rows(twice):
    assert queries_on(twice).count() == len(TWICE)


def test_sketches_merge(spark):
    rng = data.random.Random(3)
    text = data.sentence(rng, 3000, 100_000)
    w = text.split()
    cut = [" ".join(w[:1504]), " ".join(w[1500:])]  # the parts share the shingles across the cut
    d = spark.createDataFrame([(0, text), (1, cut[0]), (1, cut[1])], "k int, text string")
    d = d.withColumn("h", sketch.word_hashes("text")).withColumn("s", sketch.bottom_k("h"))
    merged = {r["k"]: r["s"] for r in sketch.merge_parts(d, ["k"], "s").collect()}
    assert merged[0] == merged[1]
    n = d.where("k = 0").select(sketch.distinct_shingles("s")).first()[0]
    assert abs(n - 2996) < 0.35 * 2996
