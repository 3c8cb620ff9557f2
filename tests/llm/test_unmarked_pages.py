"""Held-out pages without the element that labels them, and layouts whose main part is of a family that training never saw."""

import collections
import random
import re

import pytest

from hygeia.llm import html_crf as C
from tests.llm import data
from tests.llm.test_pages import ROWS


def scores(pairs):
    both = want = got = 0
    for a, b in pairs:
        a, b = collections.Counter(a.split()), collections.Counter(b.split())
        both, want, got = both + sum((a & b).values()), want + sum(a.values()), got + sum(b.values())
    return both / want, both / got


def truth(page):
    blocks = C.leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, C.own_labels(blocks)) if y)


@pytest.fixture(scope="module")
def field():
    w, tr = C.fit([h for _, _, h in ROWS[:40]])
    return w.tolist(), tr.tolist()


def test_article_as_div(field):
    plain = [(truth(h), C.extract_text(re.sub(r"<(/?)article", r"<\1div", h), *field)) for _, _, h in ROWS[40:60]]
    recall, precision = scores(plain)
    assert recall >= 0.95 and precision >= 0.95


def test_family_held_out():
    """Trained without layouts of plain and ``story`` parts, read on them alone."""
    out = ("<div>{}</div>", '<section class="story">{}</section>')
    w, tr = C.fit([h for _, _, h in ROWS[:40]], mains=tuple(m for m in C.MAINS if m not in out))
    w, tr = w.tolist(), tr.tolist()
    rng, pairs = random.Random(3), []
    words = data.sentence(random.Random(1), 400).split()
    for _ in range(120):
        texts = [data.sentence(rng, rng.randrange(5, 50)) + "." for _ in range(rng.randrange(1, 8))]
        blocks, labels = C.layout_labels(C.layouts("A title", texts, words, rng, out))
        found = C.viterbi(C.features(blocks), w, tr)
        pairs.append((" ".join(b.text for b, y in zip(blocks, labels) if y), " ".join(b.text for b, y in zip(blocks, found) if y)))
    recall, precision = scores(pairs)
    print("held-out families: recall", recall, "precision", precision)
    # measured 0.891 and 0.946 (0.40 and 0.997 without the copies): 0.95 isn't reached on families that training never saw
    assert recall >= 0.85 and precision >= 0.9


def test_copies_without_names():
    page = "<body><nav class=menu>m</nav><ARTICLE id=x><p>a</p></ARTICLE><div role=note>n</div></body>"
    blocks = C.leaf_blocks(page)
    copy, bare = C.renamed(page, blocks, "div"), C.renamed(page, blocks, "div", False)
    assert [b.kinds for b in copy] == [("nav",), (), ()] and not any("article" in b.tags for b in copy)
    assert [b.text for b in bare] == ["m", "a", "n"]
    shown = "<article>class=a is shown</article>"  # what looks like an attribute is text: no copy without it
    assert C.renamed(shown, C.leaf_blocks(shown), "div", False) is None
