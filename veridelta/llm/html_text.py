"""Main text of web pages by boosted trees over DOM nodes.

Every element gets features of its subtree (text, links, density), attribute
words, depth, siblings and ancestors; boosted trees give its log-odds of being
main text. A bottom-up decoding then labels whole subtrees: an element is kept,
dropped, or opened so that its children decide, whichever explains the text
under it best, and nothing under a dropped or kept element contradicts it. A page
of which nothing is kept falls back to its dense elements.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gbt
from .common import prepare
from .dom import BLOCK, HIDDEN, Node, parse

#: Words in class, id, role and similar attributes, by what they tell.
WORDS = {
    "main": "article content post entry main story text body prose blog news read".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs toolbar skip".split(),
    "frame": "header footer masthead topbar bottom copyright legal colophon banner logo site contentinfo foot head".split(),
    "side": "sidebar aside side widget rail complementary related recommended recommend more popular trending tags share social".split(),
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion promoted adsense dfp teaser".split(),
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay banner disclaimer warning toast privacy subscribe newsletter signup paywall".split(),
    "comment": "comment comments discussion disqus respond response responses reply replies thread reader readers commentlist".split(),
    "form": "form search login signin register input subscribe newsletter contact".split(),
}
_GROUP = {w: {g for g, ws in WORDS.items() if w in ws} for ws in WORDS.values() for w in ws}
_TAGS = (
    "p", "h1", "h", "li", "list", "a", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form", "table", "pre", "inline",
)
_TAG_OF = {
    "h2": "h", "h3": "h", "h4": "h", "h5": "h", "h6": "h", "ul": "list", "ol": "list", "dl": "list", "dd": "li", "dt": "li", "menu": "nav",
    "fieldset": "form", "label": "form", "input": "form", "legend": "form", "tr": "table", "td": "table", "th": "table", "tbody": "table",
    "blockquote": "p", "figcaption": "p", "code": "pre", "dialog": "aside",
}
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_TOLD = ("class", "id", "role", "aria-label", "data-role", "itemprop", "name")
_GROUPS = tuple(WORDS)
_NEAR = ("nav", "header", "footer", "aside", "form", "article", "main", "section", "list")
#: Tags that never hold main text, where there is only their word for it.
_NOT_MAIN = frozenset("nav header footer aside form fieldset menu dialog".split())
_SPACE = re.compile(r"\s+")
#: Cost of opening an element whose children then decide, in log-odds.
OPEN = 1.5


def groups_of(node: Node) -> frozenset[str]:
    if not node.attrs:
        return frozenset()
    found: set[str] = set()
    attributes = node.attributes()
    for name in _TOLD:
        if name in attributes:
            for word in _SPLIT.split(_CAMEL.sub("-", attributes[name]).lower()):
                found |= _GROUP.get(word, frozenset())
    if "hidden" in attributes or "display:none" in attributes.get("style", "").replace(" ", "").lower() or attributes.get("aria-hidden") == "true":
        found.add("hidden")
    return frozenset(found)


class Page:
    """Elements in page order with their subtree sums."""

    def __init__(self, html: str):
        self.nodes: list[Node] = []
        root = parse(html)
        stack = [root]
        while stack:  # page order without recursion: pages can be deep
            node = stack.pop()
            if node.tag in HIDDEN:
                node.items = []
                continue
            node.start = len(self.nodes)
            self.nodes.append(node)
            stack.extend(x for x in reversed(node.items) if isinstance(x, Node))
        n = len(self.nodes)
        self.text, self.link, self.tags, self.commas, self.blocks, self.own = (np.zeros(n) for _ in range(6))
        self.parent = np.array([x.parent.start if x.parent else -1 for x in self.nodes])
        for i, node in enumerate(self.nodes):
            for x in node.items:
                if isinstance(x, str):
                    chars = len("".join(x.split()))
                    self.own[i] += chars
                    self.commas[i] += x.count(",") + x.count(".")
            self.tags[i] = 1
            self.blocks[i] = node.tag in BLOCK
        self.text[:] = self.own
        for i in range(n - 1, 0, -1):
            p, node = self.parent[i], self.nodes[i]
            if node.tag == "a":
                self.link[i] = self.text[i]
            self.text[p] += self.text[i]
            self.link[p] += self.link[i]
            self.tags[p] += self.tags[i]
            self.commas[p] += self.commas[i]
            self.blocks[p] += self.blocks[i]
        self.end = np.arange(1, n + 1)
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.end[p] = max(self.end[p], self.end[i])

    def features(self) -> np.ndarray:
        n = len(self.nodes)
        groups = [groups_of(x) for x in self.nodes]
        tags = [_TAG_OF.get(x.tag, x.tag if x.tag in BLOCK or x.tag == "a" else "inline") for x in self.nodes]
        kinds = np.zeros((n, len(_TAGS)), np.float32)
        marks = np.zeros((n, len(_GROUPS) + 1), np.float32)
        near = np.zeros((n, len(_NEAR) + len(_GROUPS) + 1), np.float32)
        sibling = np.zeros((n, 5), np.float32)
        places = {g: i for i, g in enumerate((*_GROUPS, "hidden"))}
        tag_at, near_at = {t: i for i, t in enumerate(_TAGS)}, {t: i for i, t in enumerate(_NEAR)}
        for i in range(n):
            if tags[i] in tag_at:
                kinds[i, tag_at[tags[i]]] = 1
            for g in groups[i]:
                marks[i, places[g]] = 1
            p = self.parent[i]
            if p >= 0:
                near[i] = near[p]
                if tags[p] in near_at:
                    near[i, near_at[tags[p]]] = 1
                near[i, len(_NEAR) :] = np.maximum(near[i, len(_NEAR) :], marks[p])
        for i, node in enumerate(self.nodes):
            kids = [x.start for x in node.items if isinstance(x, Node) and x.tag not in HIDDEN]
            if not kids:
                continue
            kids_text = self.text[kids]
            total, most = kids_text.sum() + 1e-9, len(kids)
            for k, c in enumerate(kids):
                same = sum(tags[j] == tags[c] for j in kids[max(0, k - 8) : k + 9])
                sibling[c] = (min(most, 50), k / most, same / min(most, 17), self.text[c] / total, (self.text[kids[k - 1]] if k else 0) + (self.text[kids[k + 1]] if k + 1 < most else 0))
        page = self.text[0] + 1e-9
        offset = np.concatenate(([0.0], np.cumsum(self.own)[:-1])) / page
        t = self.text
        numbers = np.stack(
            (
                np.array([min(x.depth, 30) for x in self.nodes]), np.log1p(t), np.log1p(self.own), self.link / (t + 1e-9), np.log1p(t / self.tags),
                np.log1p(self.tags), self.commas / (t + 1) * 20, t / (self.blocks + 1), t / page, offset,
            ),
            axis=1,
        )
        sibling[:, 4] = np.log1p(sibling[:, 4])
        return np.concatenate((numbers, sibling, kinds, marks, near), axis=1).astype(np.float32)

    def keep(self, odds: np.ndarray, open_cost: float = OPEN) -> np.ndarray:
        """Elements whose own text is kept, by hierarchical decoding."""
        weight = np.log1p(self.own) * (self.own > 0)
        yes = np.minimum(odds, 8) * weight  # evidence for keeping an element's own text
        kept_all = yes.copy()
        n = len(yes)
        for i in range(n - 1, 0, -1):
            kept_all[self.parent[i]] += kept_all[i]
        best, choice = np.zeros(n), np.zeros(n, np.int8)  # 0 drop, 1 keep, 2 open
        opened = np.maximum(yes, 0) - open_cost
        for i in range(n - 1, -1, -1):
            options = (0.0, kept_all[i], opened[i] if self.tags[i] > 1 else -1e18)
            choice[i] = int(np.argmax(options))
            best[i] = options[choice[i]]
            if i:
                opened[self.parent[i]] += best[i]
        out = np.zeros(n, bool)
        i = 0
        while i < n:
            if choice[i] == 2:
                out[i] = yes[i] > 0
                i += 1
            else:
                out[i : self.end[i]] = choice[i] == 1
                i = self.end[i]
        return out

    def dense(self) -> np.ndarray:
        """Elements that neither their tag, nor a name, nor many links mark as no main
        text, and that lie in none that is marked."""
        out = np.zeros(len(self.nodes), bool)
        for i, node in enumerate(self.nodes):
            p, groups = self.parent[i], groups_of(node)
            named = groups - {"main"} and "main" not in groups
            marked = node.tag in _NOT_MAIN or named or (node.tag in BLOCK and node.tag != "body" and self.link[i] > self.text[i] / 2)
            out[i] = not marked and (p < 0 or out[p])
        return out

    def main_text(self, odds: np.ndarray) -> str:
        """The decoded text; where that is empty, what is dense."""
        return self.blocks_of(self.keep(odds)) or self.blocks_of(self.dense())

    def blocks_of(self, keep: np.ndarray) -> str:
        """Text of the kept elements: blocks in page order, joined by two line ends."""
        blocks: list[str] = []
        run: list[str] = []

        def flush() -> None:
            line = _SPACE.sub(" ", "".join(run)).strip()
            if line:
                blocks.append(line)
            run.clear()

        stack: list[Node | str | None] = [self.nodes[0]]
        owner: list[int] = []
        while stack:
            x = stack.pop()
            if x is None:  # the end of an element
                node = self.nodes[owner.pop()]
                if node.tag in BLOCK:
                    flush()
            elif isinstance(x, str):
                if keep[owner[-1]]:
                    run.append(x)
            elif x.tag in HIDDEN:
                continue
            elif x.tag == "br":
                run.append(" ")
            else:
                if x.tag in BLOCK:
                    flush()
                owner.append(x.start)
                stack.append(None)
                stack.extend(reversed(x.items))
        flush()
        return "\n\n".join(blocks)


# --- training pages -------------------------------------------------------


def _words(rng: random.Random, n: int) -> str:
    parts = ("ka lo mi ter en sor va di ru ne al po che ti ma on er st re in da vel").split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


def _prose(rng: random.Random, low: int = 1, high: int = 6) -> str:
    return " ".join(_words(rng, rng.randint(3, 22)).capitalize() + rng.choice(".....?!").replace(" ", "") for _ in range(rng.randint(low, high)))


def _plain_name(rng: random.Random) -> str:
    """A name that tells nothing: of layout, or made by a tool."""
    kind = rng.random()
    if kind < 0.5:
        return rng.choice("box row col wrap c1 x-2 inner block grid cell outer left u-1 css-1x2 container panel".split())
    if kind < 0.75:
        return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=rng.randint(1, 7)))
    return "-".join(_words(rng, 1) for _ in range(rng.randint(1, 2)))


def _attrs(rng: random.Random, group: str, share: float = 0.8) -> str:
    if rng.random() > share:
        return f' class="{_plain_name(rng)}"' if rng.random() < 0.6 else ""
    word = rng.choice(WORDS[group])
    if rng.random() < 0.12:  # names of another kind besides, as in a post's topic
        other = [rng.choice(WORDS[rng.choice([g for g in WORDS if g != group])]) for _ in range(rng.randint(1, 2))]
        return f' class="{word} {rng.choice(("tag", "c", "is", "topic"))}-{"-".join(other)}"'
    word = rng.choice((word, word, f"site-{word}", f"{word}-{rng.choice('box wrap list area inner block'.split())}", f"page-{word}"))
    return rng.choice((f' class="{word}"', f' id="{word}"', f' class="{rng.choice(("row", "col", "u-1"))} {word}"', f" class='{word}'"))


def _links(rng: random.Random, n: int) -> str:
    return "".join(f'<li><a href="/{i}">{_words(rng, rng.randint(1, 4))}</a></li>' for i in range(n))


def training_page(rng: random.Random) -> str:
    """A synthetic page; ``data-y`` marks the elements that hold the main text and
    ``data-n`` what is not. Names tell much, little or nothing, and a part of the
    pages has no element around the main text, or no other text at all."""
    hint = rng.choice((0.85, 0.85, 0.85, 0.35, 0.0))
    layout = rng.choices(("held", "loose", "alone", "text"), (70, 15, 10, 5))[0]

    def not_main(tag: str, group: str, inner: str) -> str:
        return f"<{tag}{_attrs(rng, group, hint)} data-n>{inner}</{tag}>"

    def block() -> str:
        kind = rng.random()
        if kind < 0.7:
            text = _prose(rng)
            if rng.random() < 0.25:
                text = f"<b>{text[:30]}</b>{text[30:]}<br>{_prose(rng, 1, 1)}"
            if rng.random() < 0.25:
                text += f' <a href="/x">{_words(rng, 2)}</a> {_words(rng, 4)}.'
            tag = rng.choice(("p", "p", "p", "p", "div"))
            return f"<{tag}>{text}" + ("" if tag == "p" and rng.random() < 0.15 else f"</{tag}>")
        if kind < 0.78:
            return f"<h2>{_words(rng, rng.randint(2, 8)).capitalize()}</h2>"
        if kind < 0.86:
            items = "".join(f"<li>{_prose(rng, 1, 2)}</li>" for _ in range(rng.randint(2, 6)))
            return f"<ul>{items}</ul>"
        if kind < 0.91:
            return f"<blockquote><p>{_prose(rng, 1, 3)}</p></blockquote>"
        if kind < 0.95:
            return "<table>" + "".join(f"<tr><td>{_words(rng, 2)}</td><td>{_words(rng, 3)}</td></tr>" for _ in range(rng.randint(2, 6))) + "</table>"
        return f"<pre><code>{_words(rng, 12)}</code></pre>"

    def outside(hint: float = hint) -> str:
        kind = rng.choice("ad ad menu notice side form share related comments ad".split())
        if kind == "ad":
            return not_main(rng.choice(("div", "aside", "section", "p")), "advert", rng.choice((_prose(rng, 1, 2), f"<p>{_prose(rng, 1, 2)}</p>", f'<a href="/b">{_words(rng, 6)}</a>')))
        if kind == "menu":
            return not_main(rng.choice(("nav", "div", "ul")), "menu", f"<ul>{_links(rng, rng.randint(3, 12))}</ul>")
        if kind == "notice":
            return not_main(rng.choice(("div", "section", "aside", "dialog")), "notice", f"<p>{_prose(rng, 1, 3)}</p>" + ("<button>ok</button>" if rng.random() < 0.5 else ""))
        if kind == "form":
            return not_main(rng.choice(("form", "form", "div")), "form", f"<label>{_words(rng, 3)}</label><input><p>{_prose(rng, 1, 1)}</p>")
        if kind == "comments":
            each = "".join(f"<div{_attrs(rng, 'comment', hint)}><b>{_words(rng, 1)}</b><p>{_prose(rng, 1, 4)}</p></div>" for _ in range(rng.randint(1, 6)))
            return f'<{(tag := rng.choice(("section", "div", "ol")))} class="{rng.choice(WORDS["comment"])}" data-n><h3>{_words(rng, 1)}</h3>{each}</{tag}>'
        if kind == "share":
            return not_main("div", "side", _links(rng, 4))
        return not_main(rng.choice(("aside", "div", "section")), "side", f"<h3>{_words(rng, 2)}</h3>" + rng.choice((f"<ul>{_links(rng, rng.randint(3, 8))}</ul>", f"<p>{_prose(rng, 1, 3)}</p>")))

    title = _words(rng, rng.randint(4, 12)).capitalize()
    head = f"<!DOCTYPE html><html><head><title>{title}</title><script>x('</p>')</script></head>"
    if layout == "text":  # hardly any markup
        lines = "<br>".join(_prose(rng, 1, 4) for _ in range(rng.randint(1, 8)))
        return f"{head}<body data-y>{lines}</body></html>"
    if layout == "alone":  # nothing but the main text, repetitive or not
        same = _prose(rng, 2, 4)
        parts = [f"<p>{same} {_words(rng, 1)}.</p>" if rng.random() < 0.5 else block() for _ in range(rng.randint(1, 12))]
        inner = (f"<h1>{title}</h1>" if rng.random() < 0.5 else "") + "".join(parts)
        for _ in range(rng.randint(0, 2)):
            inner = f"<div{_attrs(rng, 'main', hint / 2)}>{inner}</div>"
        return f"{head}<body data-y>{inner}</body></html>"
    inner = "".join(block() for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14))))
    if rng.random() < 0.85:
        inner = f"<h1>{title}</h1>" + inner
    for _ in range(rng.choice((0, 0, 1, 2))):  # amid the main text only attributes tell what is not part of it
        at = inner.find("<p>", rng.randrange(len(inner)))
        at = at if at >= 0 else len(inner)
        inner = inner[:at] + outside(0.97) + inner[at:]
    if rng.random() < 0.2:
        inner += outside()
    holder = rng.choice(("article", "article", "article", "main", "div", "div", "section"))
    told = _attrs(rng, "main", hint if holder != "div" else max(hint, 0.7))
    core = f"<{holder}{told if holder != 'article' or rng.random() < 0.5 else ''} data-y>{inner}</{holder}>"
    if layout == "loose":  # blocks lie in the body or in a box with all the rest
        core = re.sub(r"<(h1|h2|p|ul|div|table|blockquote|pre)(?=[ >])(?![^>]*data-n)", r"<\1 data-y", inner)
    for _ in range(rng.randint(0, 2) if layout == "held" else 0):
        core = f"<div{_attrs(rng, 'main', 0.3)}>{core}{outside() if rng.random() < 0.3 else ''}</div>"
    tag = rng.choice(("header", "header", "div"))
    top = f"<{tag}{_attrs(rng, 'frame', hint if tag == 'header' else 0.9)} data-n>{_words(rng, 3)}{'<p>' + _prose(rng, 1, 1) + '</p>' if rng.random() < 0.4 else ''}</{tag}>"
    tag = rng.choice(("footer", "footer", "footer", "div"))
    bottom = f"<{tag}{_attrs(rng, 'frame', hint if tag == 'footer' else 0.9) if rng.random() < 0.6 or tag == 'div' else ''} data-n>&copy; {_words(rng, 2)} {rng.choice((_prose(rng, 1, 3), _links(rng, 4)))}</{tag}>"
    menu = rng.choice(("<nav data-n><ul>{}</ul></nav>", "<div class='menu' data-n><ul>{}</ul></div>", "<ul class='nav' data-n>{}</ul>")).format(_links(rng, rng.randint(3, 9)))
    before = "".join(outside() for _ in range(rng.choice((0, 0, 1, 1, 2))))
    after = "".join(outside() for _ in range(rng.choice((0, 0, 1, 2, 3))))
    start = rng.choice((top + menu, menu + top, menu, top, menu))
    rest = rng.random()
    if layout == "loose" and rest < 0.5:  # few other parts
        start, before, after = rng.choice((start, "")), "", ""
    return f"{head}<body>{start}{before}{core}{after}{bottom}</body></html>"


@lru_cache(maxsize=1)
def model(pages: int = 900, seed: int = 11) -> gbt.Trees:
    """Boosted trees fitted on ``pages`` synthetic pages (a bound, not a sample of
    the corpus: real pages carry no labels). Elements above the main text, whose
    subtrees mix both, are left out."""
    rng, xs, ys = random.Random(seed), [], []
    for _ in range(pages):
        page = Page(training_page(rng))
        state, mixed = np.zeros(len(page.nodes), np.int8), np.zeros(len(page.nodes), bool)
        for i, node in enumerate(page.nodes):
            p = page.parent[i]
            own = 1 if "data-y" in node.attrs else -1 if "data-n" in node.attrs else 0
            above = state[p] if p >= 0 else 0
            state[i] = -1 if own < 0 or above < 0 else own or above
        mixed[:] = (state == 0) & (page.own == 0)
        x = page.features()[~mixed & (page.text > 0)]
        xs.append(x)
        ys.append((state == 1)[~mixed & (page.text > 0)])
    return gbt.train(np.concatenate(xs), np.concatenate(ys).astype(float))


def extract_many(htmls: list[str | None], trees: gbt.Trees) -> list[str]:
    """Predictions are made for all elements of the pages at once."""
    pages = [Page(h or "") for h in htmls]
    sizes = np.cumsum([0, *(len(p.nodes) for p in pages)])
    odds = trees.predict(np.concatenate([p.features() for p in pages])) if pages else np.zeros(0)
    return [p.main_text(odds[a:b]) if p.text[0] else "" for p, a, b in zip(pages, sizes, sizes[1:])]


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages``.

    Null, empty and text-free pages have an empty text; equal pages equal texts.
    Repeated rows come back repeated; an empty table gives no rows."""
    prepare(pages.sparkSession)
    trees = model()
    df = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = dict(df.dtypes)["page_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                texts = extract_many(part.column(2).to_pylist(), trees)
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars"])

    return df.mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
