"""Operators on pages and conversations, and the pipeline, against plain versions."""

import collections
import hashlib
import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from hygeia.llm import chat, html_crf, minhash, mixing, packing, quality, queries, substring, warc
from hygeia.llm.common import Scratch
from hygeia.llm.graph import components
from tests.llm import brute, data

PAGES = "page_id bigint, url string, html string"


def page(k, body, title="T"):
    return (f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title><style>p{{a}}</style><script>var t="</p>";x({k});'
            f'</script></head><body><nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li></ul></nav><!-- ad {k} -->'
            f'<div class="ad">buy this.</div><article><h1>{title}</h1>{body}</article><footer>&copy; me {k}</footer></body></html>')


def pages():
    rng = random.Random(4)
    rows = []
    for k in range(60):
        body = "".join(f"<p>{data.sentence(rng, rng.randrange(4, 60))}.</p>" for _ in range(rng.randrange(1, 6)))
        rows.append((k, f"https://www.h{k % 7}.example.org:443/p/{k % 11}?q={k}#frag", page(k, body, f"Title {k}")))
    big = page(1, "<p>" + data.sentence(rng, 400) + "</p>")
    rows += [(60 + k, "http://hot.example.com/", big) for k in range(9)]
    rows += [(70, None, None), (71, "", ""), (None, "http://x.org/a\r\nb", big), (72, "no url", "plain text"), (5, rows[5][1], rows[5][2]),
             (68, "http://hot.example.com/", big), (73, "http://y.org/é", "a\r\n\r\nWARC/1.1\r\n\r\n" * 60),
             (74, "http://z.org", page(2, "<p>" + "long " * 200_000 + "</p>"))]
    return rows


ROWS = pages()


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, PAGES).withColumns({c: F.lit("old") for c in ("text", "offset", "key", "n_chars")}).cache()


# ---- 6 -----------------------------------------------------------------------
CASES = [
    (page(0, "<p><b>Bold start.<br><p>Next &amp; last&nbsp;one.</p>  <ul><li>item <i>x</i></li></ul>"), "T Bold start. Next & last one. item x"),
    ("<body><header><h2>Site name</h2></header><main><p>The text of the story is here, and it is long enough to be read.</p>"
     "<aside><p>Related things.</p></aside><p>It goes on after that, with more words than before.</p></main>"
     "<section id=comments><div class=comment><p>A reader says this and that, at some length.</p></div></section>"
     "<div class='cookie-notice'><p>We use cookies, please agree to all of them.</p></div><form><label>Search</label></form></body>",
     "The text of the story is here, and it is long enough to be read. It goes on after that, with more words than before."),
    ("<article><p>unclosed <p>two words<script>if (a<b) x('</article>')</script> and more<!-- no --> to come", "unclosed two words and more to come"),
    ("", ""), (None, ""), ("<script>only</script>", ""),
]


@pytest.fixture(scope="module")
def field():
    w, tr = html_crf.fit([h for _, _, h in ROWS[:40]])
    return w.tolist(), tr.tolist()


@pytest.mark.parametrize("html, text", CASES)
def test_extract(field, html, text):
    assert html_crf.extract_text(html, *field) == text


def test_crf_on_held_out_layouts(field):
    rng, right, n = random.Random(11), 0, 0
    for _, _, h in ROWS[40:60]:
        blocks = html_crf.leaf_blocks(h)
        texts = [b.text for b, y in zip(blocks, html_crf.own_labels(blocks)) if y]
        for _ in range(5):
            made, known = html_crf.layout_labels(html_crf.layouts(texts[0], texts[1:], " ".join(texts).split(), rng))
            got = html_crf.viterbi(html_crf.features(made), *field)
            right, n = right + sum(a == b for a, b in zip(got, known)), n + len(known)
    assert right / n > 0.95


def test_viterbi_is_the_best_path(field):
    w, tr = field
    rng = random.Random(2)
    rows = [rng.sample(range(len(w)), 4) for _ in range(9)]

    def score(labels):
        s = sum(sum(w[i] for i in f) for f, y in zip(rows, labels) if y)
        return s + sum(tr[a][b] for a, b in zip(labels, labels[1:]))

    best = max(range(2**9), key=lambda m: score([m >> k & 1 for k in range(9)]))
    assert abs(score(html_crf.viterbi(rows, w, tr)) - score([best >> k & 1 for k in range(9)])) < 1e-9


def test_main_text(table, spark):
    got = {r["page_id"]: r for r in html_crf.main_text(table).collect()}
    assert got[70]["text"] == got[71]["text"] == "" and got[70]["n_chars"] == 0
    assert got[74]["n_chars"] == 2 + 5 * 200_000 - 1
    for i, _, h in ROWS[:60]:
        assert got[i]["text"] == " ".join(b.text for b in html_crf.leaf_blocks(h) if "article" in b.tags)
    assert html_crf.main_text(spark.createDataFrame([], PAGES)).collect() == []


# ---- 9 -----------------------------------------------------------------------
def test_archives(table, spark):
    got = warc.archive_round_trip(table).collect()
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    last = {}
    for i, _, h in ROWS:
        if i is not None and len((h or "").encode()) >= 1000:
            last[digest(h)] = max(i, last.get(digest(h), i))
    want = collections.Counter()
    for i, u, h in ROWS:
        n = len((h or "").encode())
        to = last.get(digest(h)) if n >= 1000 and i is not None else None
        to = None if to == i else to
        want[i, u, n, digest(h), "revisit" if to is not None else "response", to] += 1
    assert collections.Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"])
                               for r in got) == want
    assert all(r["intact"] for r in got)
    ordered = [r["key"] for r in sorted(got, key=lambda r: (r["part"], r["history"]))]
    assert ordered == sorted(ordered)
    assert warc.archive_round_trip(spark.createDataFrame([], PAGES)).collect() == []


@given(st.lists(st.lists(st.text("abc", max_size=3)).map(sorted), max_size=9))
@settings(max_examples=200, deadline=None)
def test_losers_merge(runs):
    got = [(runs[r][p], r) for r, p in warc.losers(runs)]
    assert got == sorted((k, r) for r, run in enumerate(runs) for k in run)


def test_url_keys():
    assert warc.url_key("https://WWW.Sub.Example.org:443/A/b?x=1#f") == "org,example,sub)/A/b?x=1"
    assert warc.url_key("http://a.org:8080") == "org,a:8080)/" and warc.url_key(None) == ""


# ---- 5 -----------------------------------------------------------------------
CALLS = "conv_id bigint, call_id string, turn bigint, name string, arguments string, needs array<string>, level string"
RESULTS = "conv_id bigint, call_id string, turn bigint, content string"
SCHEMAS = {"add": {"a": ("integer", True, 0, 9), "b": ("integer", False, None, None), "s": ("string", False, None, None),
                   "t": ("boolean", False, None, None)}}


def test_tool_calls(spark):
    calls = [
        (1, "c3", 5, "add", '{"b": 2,  "a":1}', ["c1", "c2"], "x"), (1, "c1", 1, "add", '{"a":10}', [], "x"),
        (1, "c2", 3, "add", '{"s": 4, "z": null}', ["c1"], "x"), (1, "c2", 3, "add", '{"s": 4, "z": null}', ["c1"], "x"),
        (1, "c4", 7, "add", "{broken", ["c4"], "x"), (1, "c5", 8, None, None, ["gone"], "x"), (2, "c1", 1, "mul", '{"a":{"y":1,"x":[2, 1]}}', None, "x"),
        (None, None, None, "add", '{"a":3,"t":"no","s":"\\u00e9\\n"}', None, "x"), (3, "p", 1, "add", '{"a":1}', ["q"], "x"),
        (3, "q", 2, "add", '{"a":1}', ["p"], "x"), (3, "r", 3, "add", '[1]', ["q"], "x")]
    results = [(1, "c1", 4, "late"), (1, "c1", 2, "ok"), (1, "zz", 9, "orphan"), (2, "c1", 2, None), (None, None, 1, "n")]
    c, r = spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)
    got = {(x["conv_id"], x["call_id"]): x for x in chat.link_tool_calls(c, r, SCHEMAS).collect()}
    assert len(got) == 10
    assert {k: x["level"] for k, x in got.items()} == {
        (1, "c1"): 0, (1, "c2"): 1, (1, "c3"): 2, (1, "c4"): None, (1, "c5"): None, (2, "c1"): 0, (None, None): 0, (3, "p"): None,
        (3, "q"): None, (3, "r"): None}
    assert [k for k, x in sorted(got.items(), key=lambda kv: kv[1]["position"]) if k[0] == 1] == [(1, f"c{i}") for i in (1, 2, 3, 4, 5)]
    assert {k: x["errors"] for k, x in got.items()} == {
        (1, "c1"): ["a: out of range"], (1, "c2"): ["a: missing", "s: not string", "unknown parameter"], (1, "c3"): [],
        (1, "c4"): ["malformed"], (1, "c5"): ["malformed"], (2, "c1"): ["unknown tool"], (None, None): ["t: not boolean"],
        (3, "p"): [], (3, "q"): [], (3, "r"): ["malformed"]}
    assert got[1, "c1"]["n_results"] == 2 and got[1, "c1"]["result_turn"] == 2 and got[1, "c2"]["n_rows"] == 2
    assert got[1, "c3"]["record"] == '{"arguments":{"a":1,"b":2},"id":"c3","name":"add","result":null}'
    assert got[2, "c1"]["record"] == '{"arguments":{"a":{"x":[2,1],"y":1}},"id":"c1","name":"mul","result":null}'
    assert json.loads(got[1, "c4"]["record"])["arguments"] == {"raw": "{broken"}
    assert [x["content"] for x in chat.orphan_results(c, r).collect()] == ["orphan"]
    none = chat.link_tool_calls(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS), SCHEMAS)
    assert none.collect() == []


def test_long_chains(spark):
    n = 12
    calls = spark.createDataFrame([(1, f"c{i}", n - i, "add", '{"a":1}', [f"c{i - 1}"] if i else [], "") for i in range(n)], CALLS)
    got = chat.link_tool_calls(calls, spark.createDataFrame([], RESULTS), SCHEMAS).collect()
    assert sorted((x["position"], x["call_id"]) for x in got) == [(i, f"c{i}") for i in range(n)]


# ---- shared and the pipeline ---------------------------------------------------
def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(1, 1)]
    parent = {}

    def root(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    real = {x for a, b in edges if a != b for x in (a, b)}
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a int, b int"), Scratch(spark, "test")).collect()}
    assert got == {x: root(x) for x in real}


def test_pipeline(spark, tmp_path):
    rows = data.documents(seed=8, n=50)
    d = data.frame(spark, rows)
    d.write.parquet(str(tmp_path / "documents.parquet"))
    final = corpus_pipeline.run(spark, str(tmp_path)).collect()

    import pyarrow as pa
    rules = list(quality.RULES.values())
    keep = [r for r in rows if (lambda b: not (b[0] < 50 or 100 * b[4] > 50 * b[0]))(brute.base(r[1]))
            and quality.cascade(pa.array([r[1]]), rules)[0]]
    classes = brute.near_classes([(r[0], r[1]) for r in keep])
    keep = [r for r in keep if classes[r[0]] == r[0]]
    spans = {i: (n, g) for i, n, g, _ in brute.substring([(r[0], r[1]) for r in keep])}
    left = {r[0] for r in keep if spans[r[0]][1] < spans[r[0]][0]}

    docs = d
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = Scratch(spark, "test").table(stage(spark, docs, ""), name)
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"]: len(brute.words(r["text"])) for r in docs.collect()} == {i: spans[i][0] - spans[i][1] for i in left}
    mixed = collections.Counter(r["doc_id"] for r in corpus_pipeline.mixture(spark, docs, "").collect())
    assert set(mixed) <= left and max(mixed.values()) <= 3
    assert collections.Counter(r["doc_id"] for r in final if r["piece"] == 0) == mixed
