"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into its leaf blocks: the text between two borders of
block elements.  Markup, comments, scripts, styles and the head hold no
blocks.  A block has features of its ancestors (their tags and what kind of part their tags,
classes, ids and roles name) and of its text.  The field labels the
blocks of a page as content or not; it is trained on labelled pages and decoded by Viterbi.

Training pages are ``train_pages`` (150 by default, the bound on what reaches the driver) of the
table's pages with labels, those of least hashed page_id.  Of each, up to ``train_blocks`` blocks (240 by default, the bound on
what the training holds) are learned from, with their features on the whole page: all blocks, or stretches of 60 spread
evenly from the first to the last.  Each gives labelled pages of three kinds: itself, where its
blocks inside an article element and outside other parts are content; of some, itself again with that element under another name (``COPIES``: half
as a plain ``div``, a tenth without classes, ids and roles too, half as ``main``), under the same labels; and its content set into layouts of other sites, with menus, headers, sidebars, notices, adverts, forms and reader
comments, whose labels are known from the layout.

Cases: a null, empty or text-free html gives an empty text; broken markup is read as far as browsers
would (unclosed elements end with their parent); a page without any marked part is judged by its texts; a
table with texts but without any labelled page raises; rows that repeat a page are each extracted; null ids and urls are kept; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element names.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure
footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody
td tfoot th thead tr ul caption xmp""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea template iframe title".split())
#: Elements whose text is a block of its own, though they may stand inside a paragraph, and the kind of part they are.
OWN = {"button": "form", "select": "form", "noscript": None, "object": None}
#: What can stand in a head; anything else ends it.
HEAD = RAW - {"textarea", "iframe"} | frozenset("html head base basefont bgsound link meta noscript".split())
CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
             "th": ("td", "th"), "option": ("option",)}
KEEPS = frozenset("article aside blockquote body div dl fieldset figure footer form header li main nav ol section table td th ul".split())

#: Kinds of parts, by words in tags, classes, ids and roles (first kind that matches).
KINDS = {
    "comments": "comment comments disqus respond reply replies discussion responses",
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs pagination pager toc tabs skip sitemap",
    "footer": "footer foot colophon copyright legal contentinfo bottom",
    "side": "aside sidebar side widget widgets rail related recommended complementary trending popular",
    "ad": "ad ads advert adverts advertisement advertising sponsor sponsored promo promoted banner adsense adbox",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription overlay toast "
              "paywall dialog announcement warning",
    "form": "form search login signup register input label fieldset legend",
    "share": "share sharing social follow byline meta tags tagged author",
    "header": "header masthead head topbar hero logo branding",
    "main": "main article content post entry story body text page prose maincontent articlebody",
}
_KIND = {w: k for k, words in reversed(KINDS.items()) for w in words.split()}
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)|<[!?][^>]*>|[^<]+|<", re.S)
_TAIL = re.compile(r"<!--.*|[^<]+|<", re.S)  # where no tag can end any more
_STEP = re.compile(r">|=\s*[\"']")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I | re.A) for t in RAW}
_ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def part_kind(tag: str, attributes: str) -> str | None:
    """What part of a page an element is, by its name and its class, id and role."""
    own = OWN[tag] if tag in OWN else _KIND.get(tag)
    if tag in ("body", "label", "input"):
        own = None
    if own and own != "main":
        return own
    named = None
    for m in _ATTR.finditer(attributes):
        for w in _WORD.findall(m[1] or m[2] or m[3] or ""):
            k = _KIND.get(w.lower())
            if k and k != "main":
                return k
            named = named or k
    return own or named


class Place:
    """Where a block stands: an open element and what holds it. Blocks and elements inside share their parent's place."""

    __slots__ = ("up", "name", "kind", "tag", "near", "seen", "tags")

    def __init__(self, up: "Place | None", name: str, kind: str | None):
        self.up, self.name, self.kind = up, name, kind
        self.tag = name if name in BLOCKS or up is None else up.tag
        self.near = kind or (up.near if up else None)
        seen, tags = (up.seen, up.tags) if up else (frozenset(), frozenset())
        self.seen = seen if kind is None or kind in seen else seen | {kind}
        self.tags = tags if not name or name in tags else tags | {name}


class Block:
    __slots__ = ("text", "place", "linked", "chars")

    def __init__(self, text: str, place: Place, linked: int, chars: int):
        self.text, self.place, self.linked, self.chars = text, place, linked, chars

    @property
    def tags(self) -> frozenset:
        """Names of the elements that hold the block."""
        return self.place.tags

    @property
    def kinds(self) -> tuple:
        """Kinds of the parts that hold the block, the outermost first."""
        out, p = [], self.place
        while p:
            if p.kind:
                out.append(p.kind)
            p = p.up
        return tuple(reversed(out))


class _Open:
    """The open elements, with the places of each name, so that looking for one takes no walk over all."""

    def __init__(self):
        self.root = Place(None, "", None)
        self.stack: list[Place] = []
        self.at: dict[str, list[int]] = {}
        self.keeps: list[int] = []

    def top(self) -> Place:
        return self.stack[-1] if self.stack else self.root

    def push(self, name: str, kind: str | None) -> None:
        self.at.setdefault(name, []).append(len(self.stack))
        if name in KEEPS:
            self.keeps.append(len(self.stack))
        self.stack.append(Place(self.top(), name, kind))

    def cut(self, i: int) -> None:
        while len(self.stack) > i:
            name = self.stack.pop().name
            self.at[name].pop()
            if name in KEEPS:
                self.keeps.pop()

    def last(self, names) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)

    def close(self, name: str) -> None:
        """An end tag: a block element ends wherever it is open, another one only inside the innermost keeping element."""
        i = self.last((name,))
        if i >= 0 and (name in BLOCKS or not self.keeps or i >= self.keeps[-1]):
            self.cut(i)

    def shut(self, names) -> None:
        """Elements that a new one ends, if no keeping element stands between."""
        i = self.last(names)
        if i >= 0 and (not self.keeps or i >= self.keeps[-1]):
            self.cut(i)

    def leave(self, name: str) -> None:
        if self.at.get(name):
            self.cut(self.at[name][0])


class _Tags:
    """Ends of tags. Quotes open after an equals sign only; one that is never closed ends at the tag's ``>``.

    A page whose quotes leave a tag without end has its quotes wrong: from there on they are not looked at. So each
    character is passed a bounded number of times.
    """

    def __init__(self, page: str):
        self.page, self.broken = page, False
        self.final = {c: page.rfind(c) for c in ">\"'"}

    def end(self, at: int) -> int:
        """Position of the ``>`` that ends a tag, or -1."""
        pos = at
        while not self.broken:
            m = _STEP.search(self.page, pos)
            if not m:
                self.broken = True
                break
            if m[0] == ">":
                return m.start()
            quote = m[0][-1]
            if self.final[quote] < m.end():
                stop = self.page.find(">", m.end())
                self.broken = stop < 0
                return stop
            pos = self.page.find(quote, m.end()) + 1
        return self.page.find(">", at)


def leaf_blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, white space inside each turned into one space."""
    out: list[Block] = []
    parts: list[str] = []
    linked = chars = 0
    page = page or ""
    opened, tags = _Open(), _Tags(page)
    at, end, final = 0, len(page), tags.final[">"]
    head = None

    def flush() -> None:
        nonlocal linked, chars
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, opened.top(), linked, max(1, chars)))
            parts.clear()
        linked = chars = 0

    while at < end:
        inside = at <= final
        m = (_TOKEN if inside else _TAIL).match(page, at)
        at = m.end()
        name = m[2] if inside else None
        stop = tags.end(at) if name else -1
        if stop < 0:
            raw = m[0]
            if raw[0] != "<" or raw == "<" or name:
                if head == "noscript" or head and not raw.strip():
                    continue
                head = None
                text = entities.unescape(raw) if "&" in raw else raw
                n = len(text) - text.count(" ")
                chars += n
                if opened.at.get("a"):
                    linked += n
                parts.append(text)
            continue
        attributes, at = page[at:stop], stop + 1
        tag, closing = name.lower(), bool(m[1])
        if head:
            if closing and tag not in ("head", "body", "html"):
                head = "head"
                continue
            if closing or tag not in HEAD:
                head = None
            elif tag == "noscript":
                head = "noscript"
            if head and tag not in RAW:
                continue
        elif not closing and tag == "head":
            head = "head"
            continue
        if not closing and tag in RAW:
            if tag in ("template", "iframe", "textarea"):
                parts.append(" ")
            if not attributes.endswith("/"):
                done = _ENDS[tag].search(page, at)
                close = page.find(">", done.end()) if done else -1
                at = end if close < 0 else close + 1
            continue
        if tag in BLOCKS or tag in OWN:
            flush()
        elif tag in ("br", "option"):
            parts.append(" ")
        if closing:
            opened.close(tag)
            continue
        if tag in VOID:
            continue
        if tag in BLOCKS and tag != "hr":  # a select holds options only
            opened.leave("select")
        opened.shut(CLOSED_BY.get(tag) or (("p",) if tag in BLOCKS else ()))
        if not attributes.endswith("/"):
            opened.push(tag, part_kind(tag, attributes))
    flush()
    return out


# ---- features ---------------------------------------------------------------
NAMES = ["bias"]
NAMES += [f"near:{k}" for k in [*KINDS, "none"]] + [f"has:{k}" for k in KINDS]
NAMES += [f"tag:{t}" for t in ("p", "h", "li", "td", "blockquote", "pre", "div", "figcaption", "other")]
NAMES += [f"anc:{t}" for t in ("article", "main", "section", "ul", "table", "a", "form", "blockquote")]
NAMES += [f"links:{i}" for i in range(4)] + [f"words:{i}" for i in range(6)]
NAMES += ["stop", "comma", "sign", "first", "last", "bad_inside_main", "main_inside_bad"]
INDEX = {n: i for i, n in enumerate(NAMES)}


#: Blocks of a stretch of a training page.
STRETCH = 60
#: Copies of training pages whose labelling element has another name: the name, whether classes, ids and roles stay, the share of pages.
COPIES = (("div", True, 0.5), ("div", False, 0.1), ("main", True, 0.5))
#: Pages that may have labels.
_MARKED = r"(?i)<(article|main)[\s/>]"
_MAIN_TAG = re.compile(r"<(/?)(?:article|main)(?=[\s/>])", re.I)
_ANCESTORS = ("article", "main", "section", "ul", "table", "a", "form", "blockquote")


def _place(p: Place) -> list[int]:
    """Features of where a block stands."""
    f = [0, INDEX[f"near:{p.near or 'none'}"]]
    f += [INDEX[f"has:{k}"] for k in sorted(p.seen)]
    t = "h" if len(p.tag) == 2 and p.tag[0] == "h" and p.tag != "hr" else p.tag
    f.append(INDEX.get(f"tag:{t}", INDEX["tag:other"]))
    f += [INDEX[f"anc:{t}"] for t in _ANCESTORS if t in p.tags]
    if "main" in p.seen and len(p.seen) > 1:
        f.append(INDEX["main_inside_bad"] if p.near == "main" else INDEX["bad_inside_main"])
    return f


def features(blocks: list[Block]) -> list[list[int]]:
    """Indices of the features that each block has."""
    out, n, places = [], len(blocks), {}
    links, words = INDEX["links:0"], INDEX["words:0"]
    stop, comma, sign, first, last = (INDEX[x] for x in ("stop", "comma", "sign", "first", "last"))
    for i, b in enumerate(blocks):
        p = b.place
        key = (p.tag, p.near, p.seen, p.tags)
        if key not in places:
            places[key] = _place(p)
        f = places[key].copy()
        text = b.text
        share = b.linked / b.chars
        f.append(links + (0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.7 else 3))
        w = text.count(" ") + 1
        f.append(words + (0 if w < 3 else 1 if w < 6 else 2 if w < 12 else 3 if w < 25 else 4 if w < 60 else 5))
        if text[-1] in ".!?…\"'”":
            f.append(stop)
        if "," in text:
            f.append(comma)
        if "©" in text or "|" in text:
            f.append(sign)
        if i < 0.1 * n:
            f.append(first)
        if i >= 0.9 * n:
            f.append(last)
        out.append(f)
    return out


# ---- the field --------------------------------------------------------------
def train(pages: list[tuple[list[list[int]], list[int]]], rounds: int = 200, rate: float = 0.3, l2: float = 1e-5):
    """(weights per feature for content against not, transitions 2 x 2) by gradient ascent on the
    conditional log-likelihood (forward-backward over all pages side by side, Adam steps)."""
    pages = [p for p in pages if p[0]]
    k = len(NAMES)
    if not pages:
        return np.zeros(k), np.zeros((2, 2))
    size = max(len(x) for x, _ in pages)
    p = len(pages)
    x = np.zeros((p, size, k), np.float32)
    y = np.zeros((p, size), np.int64)
    real = np.zeros((p, size), bool)
    for i, (rows, labels) in enumerate(pages):
        for j, f in enumerate(rows):
            x[i, j, f] = 1
        y[i, :len(labels)], real[i, :len(labels)] = labels, True
    w, tr = np.zeros(k), np.zeros((2, 2))
    m = v = np.zeros(k + 4)
    total = real.sum()
    pair = real[:, 1:]
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[:, :-1][pair], y[:, 1:][pair]), 1)
    target = np.tensordot(y * real, x, axes=([0, 1], [0, 1]))
    for step in range(1, rounds + 1):
        e = np.zeros((p, size, 2))
        e[:, :, 1] = x @ w.astype(np.float32)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, size):
            n = a[:, t - 1, :, None] + tr
            a[:, t] = np.where(real[:, t, None], e[:, t] + np.logaddexp(n[:, 0], n[:, 1]), a[:, t - 1])
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        for t in range(size - 2, -1, -1):
            n = tr + (e[:, t + 1] + b[:, t + 1])[:, None, :]
            b[:, t] = np.where(real[:, t + 1, None], np.logaddexp(n[:, :, 0], n[:, :, 1]), 0)
        mine = np.exp(np.minimum(a + b - z[:, None, None], 0))[:, :, 1] * real
        both = a[:, :-1, :, None] + tr + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]
        both = (np.exp(np.minimum(both, 0)) * pair[:, :, None, None]).sum((0, 1))
        g = np.concatenate([(target - np.tensordot(mine, x, axes=([0, 1], [0, 1]))) / total - l2 * w,
                            ((seen - both) / total - l2 * tr).ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, tr = w + move[:k], tr + move[k:].reshape(2, 2)
    return w, tr


def viterbi(rows: list[list[int]], w: list[float], tr: list[list[float]]) -> list[int]:
    """The most likely labels (1: content); ties go to content."""
    if not rows:
        return []
    a0, a1, back = 0.0, sum(w[i] for i in rows[0]), []
    for f in rows[1:]:
        s = sum(w[i] for i in f)
        from0, from1 = a0 + tr[0][0], a1 + tr[1][0]
        to0, to1 = a0 + tr[0][1], a1 + tr[1][1]
        back.append((from1 >= from0, to1 >= to0))
        a0, a1 = max(from0, from1), s + max(to0, to1)
    label = 1 if a1 >= a0 else 0
    out = [label]
    for b in reversed(back):
        label = int(b[label])
        out.append(label)
    return out[::-1]


# ---- labelled pages -----------------------------------------------------------
def own_labels(blocks: list[Block]) -> list[int] | None:
    """Content: inside an article or main element and in no other part within it. None if the page has neither."""
    if not any("article" in b.tags or "main" in b.tags for b in blocks):
        return None
    return [int(("article" in b.tags or "main" in b.tags) and b.place.near == "main") for b in blocks]


#: What holds the content in the layouts of training pages.
MAINS = ('<article>{}</article>', '<main>{}</main>', '<div class="content">{}</div>', '<div id="post-body">{}</div>',
         '<div class="entry-content">{}</div>', '<main><article>{}</article></main>', '<div>{}</div>', '<section class="story">{}</section>')


def layouts(title: str, texts: list[str], words: list[str], rng: random.Random, mains: tuple = MAINS) -> str:
    """A page of another layout around ``texts``; content blocks carry the mark <!--1-->, which training reads."""
    say = lambda a, b: " ".join(rng.choice(words) for _ in range(rng.randint(a, b)))
    some = lambda p, s: s() if rng.random() < p else ""
    esc = entities.escape

    def links(n: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{esc(say(1, 3))}</a></li>' for i in range(n)) + "</ul>"

    def box(kind: str, inner: str) -> str:
        tag, names = {
            "nav": (("nav", "div", "ul"), ("menu", "main-nav", "navbar", "breadcrumbs", "")),
            "header": (("header", "div"), ("site-header", "masthead", "header", "")),
            "footer": (("footer", "div"), ("footer", "site-footer", "copyright", "")),
            "side": (("aside", "div", "section"), ("sidebar", "related-posts", "widget", "right-rail")),
            "ad": (("div", "aside", "p"), ("ad", "ads", "advert", "sponsored", "promo")),
            "notice": (("div", "section", "p"), ("cookie-notice", "notice", "alert", "newsletter", "consent-banner")),
            "form": (("form", "div"), ("search-form", "login", "subscribe", "")),
            "comments": (("section", "div", "ol"), ("comments", "comment-list", "comment", "respond", "replies")),
        }[kind]
        t, c = rng.choice(tag), rng.choice(names)
        if not c and part_kind(t, "") is None:
            c = names[0]
        how = rng.choice(("class", "id"))
        return f'<{t} {how}="{c}">{inner}</{t}>' if c else f"<{t}>{inner}</{t}>"

    para = lambda a, b: f"<p>{esc(say(a, b))}.</p>"
    parts = [some(0.6, lambda: box("header", f"<h2>{esc(say(1, 4))}</h2>" + some(0.5, lambda: para(2, 9)))),
             some(0.8, lambda: box("nav", links(rng.randint(2, 8)))),
             some(0.4, lambda: box("notice", para(5, 50))), some(0.5, lambda: box("ad", para(3, 60)))]
    body = [f"<!--1--><h1>{esc(title)}</h1>"]
    for t in texts:
        tag = rng.choices(("p", "li", "blockquote", "h2", "div", "pre"), (20, 2, 1, 1, 2, 1))[0]
        inner = esc(t)
        if rng.random() < 0.15 and " " in inner:
            a, b = inner.split(" ", 1)
            inner = f'{rng.choice(("<b>", "<em>", "<a href=x>"))}{a}</b></em></a> {b}'
        body.append(f"<!--1--><{tag}>{inner}</{tag}>")
        body.append(some(0.06, lambda: box(rng.choice(("ad", "notice", "side", "form")), para(3, 20))))
    main = rng.choice(mains)
    tail = some(0.5, lambda: box("comments", "".join(
        f'<div class="comment"><b>{esc(say(1, 2))}</b>{para(3, 80)}</div>' for _ in range(rng.randint(1, 4)))))
    inside = rng.random() < 0.3
    parts += [main.format("".join(body) + (tail if inside else "")), "" if inside else tail,
              some(0.5, lambda: box("side", links(rng.randint(1, 5)) + some(0.5, lambda: para(5, 60)))),
              some(0.3, lambda: box("form", f"<label>{esc(say(1, 3))}</label><input>" + some(0.5, lambda: para(2, 8)))),
              some(0.3, lambda: box("ad", para(3, 25))),
              some(0.8, lambda: box("footer", f"<p>&copy; {esc(say(1, 8))}</p>" + some(0.4, lambda: links(3))))]
    return "<html><body>" + "".join(parts) + "</body></html>"


def layout_labels(page: str) -> tuple[list[Block], list[int]]:
    """Blocks and labels of a page made by ``layouts``: a mark stands before each content block."""
    marked = page.replace("<!--1-->", "\x01")
    blocks, labels = [], []
    flagged = re.sub("\x01(<[^>]*>)", "\\1\x01", marked)
    for b in leaf_blocks(flagged):
        labels.append(int("\x01" in b.text))
        b.text = b.text.replace("\x01", "").strip()
        if b.text:
            blocks.append(b)
        else:
            labels.pop()
    return blocks, labels


def labelled(page: str | None) -> tuple[list[Block], list[int]] | None:
    """Blocks and labels of a page that labels itself, None of others."""
    blocks = leaf_blocks(page)
    labels = own_labels(blocks)
    return (blocks, labels) if labels and any(labels) else None


def stretches(n: int, most: int) -> list[tuple[int, int]]:
    """(start, end) of the blocks of n that are learned from: all if n <= most, else stretches from the first to the last block."""
    size = min(STRETCH, most)
    if n <= most:
        return [(i, min(i + size, n)) for i in range(0, n, size)]
    many = max(1, most // size)
    starts = [0] if many == 1 else [(n - size) * i // (many - 1) for i in range(many)]
    return [(i, i + size) for i in starts]


def renamed(page: str, blocks: list[Block], name: str, names: bool = True) -> list[Block] | None:
    """The blocks of a page whose article and main elements have another name (without ``names`` no element has a class, id or
    role either), for training on pages that mark their main part otherwise or not at all. None if the texts don't come out
    the same."""
    other = _MAIN_TAG.sub(rf"<\1{name}", page)
    out = leaf_blocks(other if names else _ATTR.sub("", other))
    return out if [b.text for b in out] == [b.text for b in blocks] else None


def fit(pages: list[str | None], per_page: int = 3, seed: int = 7, train_blocks: int = 240, mains: tuple = MAINS):
    """Weights and transitions from a bounded list of pages."""
    rng, draw = random.Random(seed), random.Random(seed + 1)
    examples = []
    for page in pages:
        own = labelled(page)
        if own is None:
            continue
        blocks, labels = own
        rows = features(blocks)
        examples += [(rows[i:j], labels[i:j]) for i, j in stretches(len(rows), train_blocks)]
        for name, names, share in COPIES if per_page else ():
            copy = renamed(page, blocks, name, names) if draw.random() < share else None
            if copy:
                rows = features(copy)
                examples += [(rows[i:j], labels[i:j]) for i, j in stretches(len(rows), train_blocks)]
        texts = [b.text for b, y in zip(blocks, labels) if y]
        words = " ".join(texts).split()[:2000]
        for _ in range(per_page):
            made, known = layout_labels(layouts(texts[0][:80], rng.sample(texts, min(len(texts), rng.randint(1, 12))), words, rng, mains))
            examples.append((features(made), known))
    return train(examples)


def extract_text(page: str | None, w: list[float], tr: list[list[float]]) -> str:
    blocks = leaf_blocks(page)
    return " ".join(b.text for b, y in zip(blocks, viterbi(features(blocks), w, tr)) if y)


def _label_keys(batches):
    for b in batches:
        yield b.filter(pa.array([labelled(h) is not None for h in b.column("html").to_pylist()], pa.bool_())).select(["_k", "_h"])


def training_pages(pages: DataFrame, train_pages: int) -> list[str]:
    """Up to ``train_pages`` pages with labels, those of least hashed page_id. Most pages with a marked element have labels, so the
    first of these are tried; if some have none, tasks find out which pages have."""
    hashed = (pages.where(F.col("html").rlike(_MARKED))
              .select("html", F.xxhash64("page_id", F.lit(5)).alias("_k"), F.xxhash64("html").alias("_h")))

    def first(keys: DataFrame) -> list[str]:
        # the hashes first: tasks send a few bytes a page to the driver, and html of the chosen pages alone
        chosen = keys.distinct().orderBy("_k", "_h").limit(train_pages).collect()
        pairs = {(r["_k"], r["_h"]) for r in chosen}
        rows = (hashed.where(F.col("_k").isin([k for k, _ in pairs]) & F.col("_h").isin([h for _, h in pairs]))
                .groupBy("_k", "_h").agg(F.first("html").alias("html")).orderBy("_k", "_h").limit(train_pages).collect())
        return [r["html"] for r in rows]

    found = first(hashed.select("_k", "_h"))
    if all(labelled(h) for h in found):
        return found
    return first(hashed.mapInArrow(_label_keys, "_k bigint, _h bigint"))


def main_text(pages: DataFrame, train_pages: int = 150, train_blocks: int = 240) -> DataFrame:
    """``pages`` with text and n_chars in place of html (clashing columns are replaced)."""
    sample = training_pages(pages, train_pages)
    trained = bool(sample)
    w, tr = fit(sample, train_blocks=train_blocks)
    weights, moves = w.tolist(), tr.tolist()
    keep = [c for c in pages.columns if c not in ("html", "text", "n_chars")]

    def work(batches):
        for b in batches:
            htmls = b.column("html").to_pylist()
            if not trained and any(leaf_blocks(h) for h in htmls):
                raise ValueError("no page with an article or main element to train the field on")
            texts = [extract_text(h, weights, moves) for h in htmls]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    d = pages.select(*[F.col(f"`{c}`") for c in keep], "html")
    schema = T.StructType([f for f in d.schema if f.name != "html"]).add("text", "string").add("n_chars", "long")
    return d.mapInArrow(work, schema)
