"""Broken markup: quotes that are never closed lose no text, and deep or unclosed markup takes time in proportion to its length."""

import time

import pytest

from hygeia.llm import html_crf


@pytest.mark.parametrize("page, want", [
    ("<p title=it's>first</p><p>it's second</p>", ["first", "it's second"]),
    ('<p title="a>first</p><p>second', ["first", "second"]),
    ('<p title="a > b" class=\'c">\'>first', ["first"]),
    ('<p say="no>first</p><p title="b">second', ["second"]),  # closed later, as browsers read it
    ('<i =">"<p>one</p><p>two', ["one", "two"]),  # the quote holds a sign, the tag ends at the next
    ("a < b <p", ["a < b <p"]),
    ("<p>x<! y", ["x<! y"]),
])
def test_quotes_and_ends(page, want):
    assert [b.text for b in html_crf.leaf_blocks(page)] == want


N = 50_000


@pytest.mark.parametrize("page", [
    "<div>x" * N, "<b>" * N + "</i>" * N, "<i><div>" + "<b>" * N + "</i>" * N, '<a b="' * N, '<a b=">' * N, '<i =">"' * N,
    "<! " * N, "<div><a b='\"" * N + ">", '<i ="' * N + ">", "<a>y" * N, "<select><div>" * N,
])
def test_long_broken_pages(page):
    t = time.process_time()
    html_crf.leaf_blocks(page[:len(page) // 4])
    quarter = time.process_time() - t
    t = time.process_time()
    html_crf.leaf_blocks(page)
    whole = time.process_time() - t
    assert whole < 12 * quarter + 0.5  # 16 times where the time is quadratic


def test_kinds_and_names_of_deep_blocks():
    b = html_crf.leaf_blocks("<article>" + "<div class=sidebar>" * 3 + "<section><p>x")[-1]
    assert b.kinds == ("main", "side", "side", "side") and {"article", "div", "section", "p"} == b.tags
