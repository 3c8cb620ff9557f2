"""Pages whose text must come whole: omitted tags, embedded and unclosed elements, letters that change length, long pages."""

import pytest

from hygeia.llm import html_crf


def texts(page):
    return [b.text for b in html_crf.leaf_blocks(page)]


@pytest.mark.parametrize("page, want", [
    ("<html><head><title>t</title><meta x><article><p>all of it</article>", ["all of it"]),
    ("<head><script>x</script><noscript>no<link y></noscript>\n text first<p>then", ["text first", "then"]),
    ("<head><title>t</title></head><body><p>a", ["a"]),
    ("<p>Let <math><mi>x</mi></math> be <svg><text>y</text></svg>", ["Let x be y"]),
    ("<article><object><p>fallback</p></object><noscript><p>plain</p></noscript><xmp>sample</xmp></article>", ["fallback", "plain", "sample"]),
    ("<div><button>press</div><p>on", ["press", "on"]),
    ("<div><select><option>a<option>b<p>out</p></div><div><noscript>n</div><p>on", ["a b", "out", "n", "on"]),
    ("<div><svg><g>s</div><p>one</p><div><math>m</div><p>two", ["s", "one", "m", "two"]),
])
def test_nothing_is_lost(page, want):
    assert texts(page) == want


def test_kind_of_buttons_and_selects():
    assert [b.kinds for b in html_crf.leaf_blocks("<article><p>a <button>b</button> c</p><select><option>d</select></article>")] == [
        ("main",), ("main", "form"), ("main",), ("main", "form")]


@pytest.mark.parametrize("n", [1, 7, 9, 40])
def test_letters_that_lower_to_two(n):
    dotted = "\u0130" * n
    assert texts(f"<head><title>{dotted}</title></head><p>{dotted}</p><SCRIPT>x('{dotted}')</Script><p>next</p><style>s</STYLE><p>last") == [
        dotted, "next", "last"]


PAGES = "page_id bigint, url string, html string"


def marked(k, n=4):
    body = "".join(f"<p>Sentence {i} of page {k}, with a few more words to be read.</p>" for i in range(n))
    tail = "".join(f"<section class=comments><p>Remark {i} of a reader.</p></section>" for i in range(n))
    return f"<body><nav><a href=x>Menu</a></nav><article><h1>Title {k}</h1>{body}</article>{tail}<footer>&copy; all rights {k}</footer></body>"


def test_features_of_long_training_pages(monkeypatch):
    seen = []
    monkeypatch.setattr(html_crf, "train", lambda examples: seen.extend(examples) or (None, None))
    html_crf.fit([marked(0, 100)], per_page=0)
    labels = [y for _, ys in seen for y in ys]
    assert len(labels) == 203 and sum(labels) == 101 and labels[-1] == 0
    last = html_crf.INDEX["last"]
    assert not any(last in f for fs, ys in seen for f, y in zip(fs, ys) if y)
    html_crf.fit([marked(0, 5000)], per_page=0)
    footer = html_crf.INDEX["near:footer"]
    assert sum(len(f) for f, _ in seen) <= 203 + 240 and footer in seen[-1][0][-1]


def test_training_pages_have_labels(spark):
    bare = [(k, None, f"<body><!-- <article> --><div>Page {k} without any mark.</div></body>") for k in range(200)]
    table = spark.createDataFrame([*bare, *[(1000 + k, None, marked(k)) for k in range(5)]], PAGES)
    assert sorted(html_crf.training_pages(table, 3)) == sorted(set(html_crf.training_pages(table, 3)))
    assert all(html_crf.labelled(h) for h in html_crf.training_pages(table, 3)) and len(html_crf.training_pages(table, 150)) == 5
    got = {r["page_id"]: r["text"] for r in html_crf.main_text(table, train_pages=3).collect()}
    assert "rights" not in got[1000] and "Menu" not in got[1000] and "Sentence 0" in got[1000]
    with pytest.raises(Exception, match="to train the field on"):
        html_crf.main_text(spark.createDataFrame(bare, PAGES)).collect()
    assert [r["text"] for r in html_crf.main_text(spark.createDataFrame([(1, None, ""), (2, None, None)], PAGES)).collect()] == ["", ""]
