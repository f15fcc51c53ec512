"""The main text of web pages: boosted trees over DOM nodes, decoded from the root down.

A page is read into a tree of block elements and runs of text; inline markup belongs to its run. Every node has features: how dense
text, links and elements are in its subtree, which words its tag, class, id and role hold (its own and those above it), its depth, and how
it compares with its siblings. Trees give each node the likelihood that main text stands in its subtree, and the page gets the likeliest
labelling in which what is kept lies only in what is kept: a menu isn't kept for a paragraph in it, nor a paragraph in a menu.

No page is labelled, so the trees learn from pages laid out here: words of a bounded sample of the given pages (MAX_SAMPLE_PAGES) are put
into articles, menus, headers, footers, sidebars, notices, adverts, forms and comments in varied markup, with and without telling names.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass, field
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapelab.llm import gbdt

#: Pages (of at most so many characters) from which the words of the training pages are taken, and how many of those are laid out.
MAX_SAMPLE_PAGES, MAX_SAMPLE_CHARS, TRAINING_PAGES = 200, 100_000, 600

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What these hold is never text of the page.
UNSEEN = frozenset("script style head title noscript template iframe object svg math select datalist button textarea canvas audio video applet noframes noembed".split())
#: Read as plain characters up to their own end tag.
RAW = frozenset("script style textarea title iframe noframes noembed xmp".split())
#: A start tag ends an open element of these kinds, unless one of the second kind is open inside of it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "body": ({"body"}, set()), "html": ({"html"}, set()),
}

#: Words in class, id and role that tell what an element is for, by the kind they tell of.
TOKENS = {
    "main": "article content main post story entry body text page prose copy".split(),
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar tabs pager pagination toc sitemap skip".split(),
    "edge": "header masthead footer foot colophon copyright legal bottom top logo brand".split(),
    "side": "sidebar aside side rail widget related recommended popular trending recirc more tags archive secondary complementary".split(),
    "advert": "ad ads adv advert advertisement adslot banner sponsor sponsored promo promotion promoted commercial affiliate teaser".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay dialog newsletter subscribe subscription paywall signup login cta".split(),
    "social": "share sharing social follow like meta byline author tools actions rating vote".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus thread reader readers feedback reviews".split(),
    "form": "form search contact survey poll input".split(),
    "hidden": "hidden invisible offscreen collapse sr".split(),
}
KINDS = tuple(TOKENS)
_KIND_OF = {word: i for i, kind in enumerate(KINDS) for word in TOKENS[kind]}
#: The same for tags.
_TAG_KIND = {"article": 0, "main": 0, "nav": 1, "menu": 1, "header": 2, "footer": 2, "aside": 3, "dialog": 5, "form": 8, "fieldset": 8, "search": 8}
_ROLES = {"main": 0, "article": 0, "navigation": 1, "menubar": 1, "banner": 2, "contentinfo": 2, "complementary": 3, "alert": 5, "dialog": 5, "search": 8, "form": 8}
TAGS = ("#text", "p", "div", "section", "li", "ul ol", "h1", "h2 h3 h4 h5 h6", "td th", "table tbody thead tfoot tr", "blockquote pre figure figcaption", "body html")
_TAG_GROUP = {t: i for i, group in enumerate(TAGS) for t in group.split()}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?![\w-]|\s*=)""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Page:
    """Nodes in page order: parent (-1: none), tag group, kinds (bits of KINDS); runs of text have their text and the characters of it in links."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)


def kinds_of(tag: str, attributes: str) -> int:
    """What an element's tag, class, id, role and style tell of, as bits of KINDS."""
    bits = 1 << _TAG_KIND[tag] if tag in _TAG_KIND else 0
    if attributes:
        for m in _NAMES.finditer(attributes):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name == "style":
                bits |= (1 << KINDS.index("hidden")) * bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name == "hidden" or name == "aria-hidden":
                bits |= (1 << KINDS.index("hidden")) * (value.lower() != "false")
            elif name == "role":
                bits |= 1 << _ROLES[value.lower()] if value.lower() in _ROLES else 0
            else:
                for word in _WORDS.findall(value):
                    k = _KIND_OF.get(word.lower())
                    if k is not None:
                        bits |= 1 << k
    return bits


def parse(page: str) -> Page:
    """The block elements and runs of text of a page, however broken its markup; one pass over the characters."""
    out = Page()
    stack: list[tuple[str, int]] = []  # open block elements: tag, node
    run: list[str] = []
    linked, in_link = 0, False
    unseen: list[str] = []  # open elements that hold no text
    strict, at, n = True, 0, len(page)

    def add(parent: int, tag: int, kinds: int, text: str = "", links: int = 0) -> int:
        out.parent.append(parent)
        out.tag.append(tag)
        out.kinds.append(kinds)
        out.text.append(text)
        out.linked.append(links)
        return len(out.parent) - 1

    root = add(-1, _TAG_GROUP["body"], 0)

    def flush() -> None:
        nonlocal linked, in_link
        if run:
            text = " ".join("".join(run).split())
            if text:
                add(stack[-1][1] if stack else root, 0, 0, text, min(linked, len(text)))
            run.clear()
        linked = 0

    def take(piece: str) -> None:
        nonlocal linked
        if not unseen and piece:
            piece = entities.unescape(piece) if "&" in piece else piece
            run.append(piece)
            if in_link:
                linked += len(piece)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            take(page[at:])
            break
        if lt > at:
            take(page[at:lt])
        ahead = page[lt + 1 : lt + 4]
        if ahead == "!--":
            end = page.find("-->", lt + 2)  # <!--> is a whole comment
            at = n if end < 0 else end + 3
            continue
        if ahead[:1] in ("!", "?") or ahead[:1] == "/" and not ahead[1:2].isalpha():
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        if not ahead[:1].isalpha() and ahead[:1] != "/":
            take("<")
            at = lt + 1
            continue
        m = _TAG.match(page, lt) if strict else None
        if m is None:
            strict = False  # a quote is never closed: from here on a tag ends at the next >
            m = _LOOSE.match(page, lt)
        if m is None:  # cut off inside a tag, or no tag
            if page.find(">", lt) < 0:
                break
            take("<")
            at = lt + 1
            continue
        at, tag, closing = m.end(), m[2].lower(), bool(m[1])
        if unseen:
            if closing and tag in unseen:
                del unseen[len(unseen) - 1 - unseen[::-1].index(tag) :]
                continue
            if "head" in unseen and not closing and (tag == "body" or tag in BLOCKS and tag != "html" and unseen == ["head"]):
                unseen.clear()  # a head that isn't closed
            else:
                if not closing and tag in UNSEEN and not m[3].endswith("/"):
                    unseen.append(tag)
                    if tag in RAW:
                        at = _raw_end(page, at, tag, unseen)
                continue
        if tag in UNSEEN:
            if not closing and not (m[3].endswith("/") and tag in ("svg", "math")):
                unseen.append(tag)
                if tag in RAW:
                    at = _raw_end(page, at, tag, unseen)
            continue
        if tag in BLOCKS:
            flush()
            in_link = False
            if closing:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        del stack[i:]
                        break
                continue
            if tag == "hr" or tag in ("html", "body") and any(t == tag for t, _ in stack):
                continue
            if stack and stack[-1][0] == "p":
                stack.pop()
            if tag in CLOSES:
                ends, holds = CLOSES[tag]
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in holds:
                        break
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
            elif len(tag) == 2 and tag[0] == "h" and stack and re.fullmatch("h[1-6]", stack[-1][0]):
                stack.pop()
            node = add(stack[-1][1] if stack else root, _TAG_GROUP.get(tag, 2), kinds_of(tag, m[3]))
            if not (m[3].endswith("/") and tag in VOID):
                stack.append((tag, node))
        elif tag == "a":
            in_link = not closing
        elif tag == "br" or tag == "img" or tag == "input":
            run.append(" ")
    flush()
    return out


def _raw_end(page: str, at: int, tag: str, unseen: list[str]) -> int:
    """Behind the end tag of a raw element; a page that ends before it has nothing more."""
    m = re.compile(f"</{tag}(?=[\\s/>])[^>]*>", re.I).search(page, at)
    unseen.pop()
    return m.end() if m else len(page)


def _kind_matrix(bits: np.ndarray) -> np.ndarray:
    return (bits[:, None] >> np.arange(len(KINDS))) & 1


def tree_features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all nodes of all pages, end to end; also their parents (-1: root), depths and page numbers."""
    sizes = np.array([len(p.parent) for p in pages], np.int64)
    start = np.concatenate([[0], np.cumsum(sizes)])
    page = np.repeat(np.arange(len(pages)), sizes)
    join = lambda name, kind=np.int64: np.concatenate([np.array(getattr(p, name), kind) for p in pages]) if pages else np.zeros(0, kind)
    parent = join("parent")
    parent = np.where(parent >= 0, parent + start[page], -1)
    tag, kinds, linked = join("tag"), join("kinds"), join("linked")
    texts = [t for p in pages for t in p.text]
    n = len(parent)
    chars = np.fromiter(map(len, texts), np.int64, n)
    marks = np.fromiter((t.count(".") + t.count(",") + t.count("。") if t else 0 for t in texts), np.int64, n)
    ends = np.fromiter((t[-1:] in ".!?:;\"'”»" and bool(t) for t in texts), np.int64, n)
    rights = np.fromiter(("©" in t or "|" in t if t else False for t in texts), np.int64, n)
    words = np.fromiter((t.count(" ") + 1 if t else 0 for t in texts), np.int64, n)
    has = parent >= 0
    depth = np.zeros(n, np.int64)
    levels = [np.flatnonzero(~has)]
    order_parent = np.where(has, parent, 0)
    while True:  # parents stand before their children, so a level is found from the one above
        in_last = np.zeros(n, bool)
        in_last[levels[-1]] = True
        nxt = np.flatnonzero(has & in_last[order_parent])
        if not len(nxt):
            break
        depth[nxt] = len(levels)
        levels.append(nxt)
    above = np.zeros(n, np.int64)
    for lv in levels[1:]:
        above[lv] = above[parent[lv]] | kinds[parent[lv]]
    sub = {k: v.astype(np.float64) for k, v in (("chars", chars), ("linked", linked), ("marks", marks), ("words", words), ("runs", (chars > 0) * 1), ("nodes", np.ones(n)), ("ends", ends))}
    for lv in reversed(levels[1:]):
        for v in sub.values():
            np.add.at(v, parent[lv], v[lv])
    children = np.bincount(parent[has], minlength=n)[:n] if n else np.zeros(0)
    up = np.where(has, parent, np.arange(n))
    nth = np.zeros(n)
    seen = np.argsort(up, kind="stable")
    first = np.flatnonzero(np.diff(up[seen], prepend=-1)) if n else np.zeros(0, np.int64)
    nth[seen] = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
    prose = (sub["linked"] < 0.3 * sub["chars"]) & (sub["chars"] > 60)
    prose_beside = np.bincount(up, prose, n)[up] - prose if n else np.zeros(0)
    total = np.maximum(sub["chars"][start[:-1]][page], 1) if n else np.zeros(0)
    before = np.concatenate([[0], np.cumsum(chars)])[:-1]
    place = (before - before[start[:-1]][page]) / total if n else np.zeros(0)
    c = np.maximum(sub["chars"], 1)
    up2 = up[up]
    own, over = _kind_matrix(kinds), _kind_matrix(above)
    columns = [
        tag, depth, np.log1p(sub["chars"]), np.log1p(sub["words"]), sub["linked"] / c, sub["nodes"] / c * 100, sub["marks"] / np.maximum(sub["words"], 1), sub["ends"] / np.maximum(sub["runs"], 1), sub["words"] / np.maximum(sub["runs"], 1), np.minimum(children, 50),
        np.minimum(nth, 50), np.minimum(children[up], 50), sub["chars"] / np.maximum(sub["chars"][up], 1), sub["chars"] / total, place, np.minimum(prose_beside, 20), tag[up], tag[up2], sub["linked"][up] / np.maximum(sub["chars"][up], 1), np.log1p(sub["chars"][up]), sub["words"][up] / np.maximum(sub["runs"][up], 1), rights,
        np.log1p(sub["chars"][up2]), sub["linked"][up2] / np.maximum(sub["chars"][up2], 1), over[:, 1:].sum(1), own[:, 1:].sum(1),
    ]
    x = np.concatenate([np.stack(columns, 1).astype(np.float64), own, over], 1) if n else np.zeros((0, 26 + 2 * len(KINDS)))
    return x, parent, depth, page


def decode(likely: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """Which nodes are kept: the likeliest labelling of each tree in which a kept node's ancestors are kept. Ties are kept."""
    keep, drop = np.log(np.clip(likely, 1e-9, 1)), np.log(np.clip(1 - likely, 1e-9, 1))
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    levels = [order[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
    for lv in reversed(levels[1:]):
        np.add.at(keep, parent[lv], np.maximum(keep[lv], drop[lv]))
        np.add.at(drop, parent[lv], drop[lv])
    kept = keep >= drop
    for lv in levels[1:]:
        kept[lv] &= kept[parent[lv]]
    return kept


def extract(pages: list[str | None], model: gbdt.Trees) -> list[str]:
    """The main text of each page: its kept runs in page order, with an empty line between; null and empty pages have none."""
    parsed = [parse(p or "") for p in pages]
    x, parent, depth, page = tree_features(parsed)
    kept = decode(model.predict(x), parent, depth) if len(x) else np.zeros(0, bool)
    texts = [t for p in parsed for t in p.text]
    out: list[list[str]] = [[] for _ in pages]
    for i in np.flatnonzero(kept).tolist():
        if texts[i]:
            out[page[i]].append(texts[i])
    return ["\n\n".join(blocks) for blocks in out]


# Training pages


class Layout:
    """Writes a page of blocks that are main text or not, in markup drawn by chance; ``truth`` has the main text."""

    def __init__(self, words: list[str], seed: int):
        self.r = Random(seed)
        self.words = words
        self.truth: list[str] = []
        self.telling = self.r.random() < 0.75  # else names tell nothing
        self.semantic = self.r.random() < 0.6

    def sentence(self, least: int, most: int) -> str:
        w = [self.r.choice(self.words) for _ in range(self.r.randint(least, most))]
        for i in range(4, len(w) - 1, self.r.randint(5, 12)):
            w[i] += ","
        return " ".join(w)[:1].upper() + " ".join(w)[1:] + self.r.choice(["."] * 8 + ["!", "?"])

    def prose(self) -> str:
        if self.r.random() < 0.16:
            return self.r.choice([self.sentence(1, 4), self.phrase(6)])
        return " ".join(self.sentence(3, 22) for _ in range(self.r.choice([1, 1, 2, 3, 5, 8])))

    def phrase(self, most: int = 4) -> str:
        return " ".join(self.r.choice(self.words) for _ in range(self.r.randint(1, most)))

    def named(self, tag: str, kind: str, inside: str, semantic: str = "") -> str:
        """An element whose tag or class tells its kind, or doesn't."""
        r = self.r
        if semantic and self.semantic and r.random() < 0.7:
            return f"<{semantic}{r.choice(['', f' class={chr(34)}{r.choice(TOKENS[kind])}{chr(34)}']) if self.telling else ''}>{inside}</{semantic}>"
        name = r.choice(TOKENS[kind]) if self.telling else "".join(r.choice("qxzvkjw") for _ in range(5))
        name = r.choice([name, f"{name}-{r.choice(['wrap', 'box', 'inner', 'area'])}", f"site-{name}", f"c{r.randint(1, 99)} {name}"]) if self.telling else name
        return f"<{tag} {r.choice(['class', 'class', 'id'])}=\"{name}\">{inside}</{tag}>"

    def links(self, least: int = 3, most: int = 9) -> str:
        r = self.r
        items = [f'<a href="/{i}">{self.phrase(3)}</a>' for i in range(r.randint(least, most))]
        return r.choice(["<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>", " ".join(items), "".join(f"<p>{i}</p>" for i in items), " | ".join(items)])

    def main(self, tag: str, text: str, shown: str | None = None) -> str:
        self.truth.append(" ".join(text.split()))
        return f"<{tag}>{shown or text}</{tag}>" if self.r.random() < 0.93 or tag != "p" else f"<p>{shown or text}"

    def article(self) -> str:
        r, out = self.r, []
        if r.random() < 0.85:
            out.append(self.main("h1", self.sentence(3, 9)[:-1]))
        for _ in range(r.choice([1, 2, 3, 5, 8, 13, 20])):
            kind = r.random()
            if kind < 0.7:
                text = self.prose()
                w = text.split(" ")
                i = r.randrange(len(w))
                out.append(self.main("p", text, " ".join([*w[:i], f"<b>{w[i]}</b>" if r.random() < 0.5 else f'<a href="/x">{w[i]}</a>', *w[i + 1 :]]) if r.random() < 0.4 else text))
            elif kind < 0.78:
                out.append(self.main(r.choice(["h2", "h3"]), self.phrase(6)))
            elif kind < 0.84:
                out.append("<ul>" + "".join(self.main("li", self.sentence(2, 14)) for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.88:
                out.append("<blockquote>" + self.main("p", self.prose()) + "</blockquote>")
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(self.main("td", self.phrase(3)) for _ in range(3)) + "</tr>" for _ in range(r.randint(2, 4))) + "</table>")
            elif kind < 0.93:
                out.append(self.main("div", self.prose()))
            else:
                out.append(r.choice([self.advert, self.related, self.share, self.signup])())
        return "".join(out)

    def advert(self) -> str:
        return self.named("div", "advert", self.r.choice([self.sentence(2, 12), f"<p>{self.prose()}</p>", f'<a href="/ad">{self.phrase(5)}</a>']))

    def related(self) -> str:
        return self.named("div", "side", self.r.choice([f"<h3>{self.phrase()}</h3>", ""]) + self.links(), "aside")

    def share(self) -> str:
        return self.named("div", "social", self.links(2, 5))

    def signup(self) -> str:
        inside = f"<p>{self.sentence(3, 12)}</p>" + self.r.choice([f"<label>{self.phrase(2)}</label><input name=q>", f"<label>{self.phrase(2)}</label> <button>{self.phrase(1)}</button>"])
        return self.r.choice([f"<form>{inside}</form>", self.named("div", "notice", inside), self.named("div", "form", f"<form>{inside}</form>")])

    def notice(self) -> str:
        return self.named("div", "notice", f"<p>{self.sentence(4, 25)}</p>" + self.r.choice(["", f'<a href="/ok">{self.phrase(2)}</a>', f"<button>{self.phrase(1)}</button>"]), "dialog")

    def menu(self) -> str:
        return self.named("div", "menu", self.links(), "nav")

    def top(self) -> str:
        return self.named("div", "edge", self.r.choice([f'<a href="/">{self.phrase(2)}</a>', f"<p>{self.phrase(5)}</p>", f"<h2>{self.phrase(3)}</h2>"]) + self.r.choice(["", self.links()]), "header")

    def foot(self) -> str:
        return self.named("div", "edge", self.r.choice(["&copy; ", "", "<p>&copy; "]) + self.phrase(4) + self.r.choice(["", " &middot; " + self.sentence(2, 10), self.links()]), "footer")

    def side(self) -> str:
        return self.named("div", "side", "".join(self.r.choice([f"<h3>{self.phrase(3)}</h3>{self.links()}", f"<p>{self.prose()}</p>", self.advert()]) for _ in range(self.r.randint(1, 3))), "aside")

    def comments(self) -> str:
        r = self.r
        one = lambda: self.named(r.choice(["div", "li"]), "comment", r.choice([f"<span>{self.phrase(2)}</span>", f"<h4>{self.phrase(2)}</h4>", f"<b>{self.phrase(2)}</b>"]) + f"<p>{self.prose()}</p>" + r.choice(["", f'<a href="/r">{self.phrase(1)}</a>']))
        telling, self.telling = self.telling, True  # nothing else tells a reader's text from the author's
        out = self.named("section", "comment", f"<h3>{self.phrase(3)}</h3>" * (r.random() < 0.7) + "".join(one() for _ in range(r.randint(1, 6))))
        self.telling = telling
        return out

    def page(self) -> str:
        r = self.r
        some = lambda share, *makers: "".join(m() for m in makers if r.random() < share)
        if r.random() < 0.12:  # a page of text alone
            inner = "".join(self.main("p", self.prose()) for _ in range(r.randint(1, 4))) if r.random() < 0.5 else self.article()
            return r.choice([inner, f"<article>{inner}</article>", f"<html><head><title>{self.phrase()}</title></head><body>{inner}</body></html>"])
        before = [m() for m in (self.top, self.menu, self.notice, self.advert, self.signup) if r.random() < 0.5]
        r.shuffle(before)
        inner = self.article()
        inner = r.choice([lambda: f"<article>{inner}{some(0.2, self.comments, self.share)}</article>", lambda: self.named("div", "main", inner, "article"), lambda: self.named("section", "main", inner, "main"), lambda: inner])() if self.semantic or self.telling else self.named("div", "main", inner)
        body = some(0.2, self.side) + inner + some(0.3, self.related, self.comments, self.side, self.share)
        body = r.choice([body, f"<main>{body}</main>" if self.semantic else f"<div>{body}</div>", f'<div class="container">{body}</div>', f"<table><tr><td>{body}</td></tr></table>"])
        after = [m() for m in (self.foot, self.side, self.notice, self.signup, self.advert) if r.random() < 0.45]
        return f"<!DOCTYPE html><html><head><title>{self.phrase()}</title><style>p{{}}</style></head><body>{''.join(before)}<!-- {self.phrase()} -->{body}{''.join(after)}<script>var a='<p>';</script></body></html>"


def node_labels(page: Page, truth: list[str]) -> np.ndarray:
    """1 for the runs that are the truth's blocks, in order, and for all that they lie in."""
    out = np.zeros(len(page.parent), np.int64)
    left = 0
    for i, t in enumerate(page.text):
        if t and left < len(truth) and t == truth[left]:
            left += 1
            while i >= 0 and not out[i]:
                out[i] = 1
                i = page.parent[i]
    return out


def training_pages(words: list[str], pages: int = TRAINING_PAGES, seed: int = 0) -> list[tuple[str, list[str]]]:
    """Laid-out pages and their main blocks; the same for the same words."""
    out = []
    for k in range(pages):
        page = Layout(words, seed * 1_000_003 + k)
        out.append((page.page(), page.truth))
    return out


def fit(words: list[str], pages: int = TRAINING_PAGES) -> gbdt.Trees:
    laid = training_pages(words, pages)
    parsed = [parse(page) for page, _ in laid]
    x = tree_features(parsed)[0]
    y = np.concatenate([node_labels(p, truth) for p, (_, truth) in zip(parsed, laid)])
    return gbdt.fit(x, y, trees=60, depth=5, rate=0.2)


def sample_words(pages: DataFrame, max_pages: int = MAX_SAMPLE_PAGES) -> list[str]:
    """The distinct words of a bounded sample of pages, sorted; a few plain ones if there are none.

    About ``max_pages`` rows whose hash falls below the share that gives so many; copies among them count once, and no more than twice ``max_pages`` come to the driver.
    """
    rows = pages.select(F.col("html").cast("string").alias("html"), F.shiftrightunsigned(F.xxhash64("page_id", "url", "html"), 1).alias("h")).filter(F.length("html") <= MAX_SAMPLE_CHARS)
    total = rows.count()
    if total > max_pages:
        rows = rows.filter(F.col("h") < int(2**63 * max_pages / total))
    some = rows.select("html").distinct().orderBy("html").limit(2 * max_pages).collect()
    words = {w.strip(".,;:!?") for r in some for t in parse(r["html"]).text for w in t.split() if len(w) < 20 and "<" not in w and "&" not in w}
    return sorted(w for w in words if w) or "one two three four five six seven eight nine ten".split()


def extract_pages(pages: DataFrame, model: gbdt.Trees) -> DataFrame:
    """page_id, url, text, n_chars: a row per row of ``pages``. Null and empty pages have an empty text; rows that repeat fare alike; an empty table gives no rows."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
