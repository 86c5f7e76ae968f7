"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed into a tree (a forgiving tokenizer, implied end tags, raw text elements, no error on broken or cut markup). Each
element that holds text of its own, and each container of such, gets features: tag, tokens of its id, class and role, depth, link and
text density of its subtree, and statistics of its siblings. Boosted regression trees give the log odds that it is main text. Decoding is
hierarchical: going up the tree, a container is kept only if what its best kept descendants and its own log odds add up to is positive,
and dropping it drops all below it, so no descendant is kept inside a dropped ancestor.

The trees lie in ``html_trees.json``, which ``python -m tidecount.llm.html_extract`` writes: they are trained on ``TRAINING_PAGES`` pages (a bound that doesn't
grow with the input) that ``training_pages`` makes by a grammar of site layouts with a fixed seed and known main text.
"""

from __future__ import annotations

import html as entities
import json
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import as_bytes, share
from ._text import chunks

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 3200, 110, 5, 0.2, 32
MODEL = Path(__file__).with_name("html_trees.json")
DEEPEST = 512  # open elements; deeper ones leave no node, as in browsers, but their text stays

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea title iframe noembed noframes xmp svg annotation annotation-xml select button datalist".split())
FALLBACK = frozenset("noscript object canvas audio video map".split())  # shown where something else is not
OPAQUE = frozenset("script style textarea title iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img del math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "body": ("head",)}
SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
# Parts of element names by what they tell, and parts in front of which (or, "free", behind which) a name only tells of its surroundings.
GOOD = frozenset("article articlebody body content contents entry main maincontent post story text prose blog copy richtext paragraph lead headline".split())
BAD = frozenset("comment comments disqus reply replies respond footer foot header masthead banner menu nav navbar navigation navi crumb crumbs breadcrumb breadcrumbs sidebar side aside rail widget widgets related recommend recommended recommendations share sharing social promo promoted sponsor sponsored ad ads adv advert adverts advertisement cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login search tags tagcloud pagination pager toolbar copyright legal meta byline author teaser teasers trending popular".split())
COMMENTS = frozenset("comment comments disqus reply replies respond discussion responses".split())
AROUND = frozenset("has with without no is not tag category cat type format status layout theme lang js hide show hentry single template".split())
FRAME_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
TOP_TAGS = frozenset(("#root", "html", "body"))
# Words of texts that frame a page.
MARKS = re.compile(r"©|\(c\) (?:19|20)\d\d|copyright|all rights reserved|cookies?\b|javascript|your browser|newsletter|subscribe|sponsored|advertisement|terms of (?:use|service)|privacy policy|alle rechte|tous droits|derechos reservados|impressum", re.I)
PARTS = re.compile(r"[a-z]+")


TOLD: dict[str, tuple[bool, bool, bool]] = {}  # names seen so far; a plain table travels to executors by value, a cached function would not


def told(name: str) -> tuple[bool, bool, bool]:
    """Whether an element's id, class and role speak for main text, against it, and of comments."""
    known = TOLD.get(name)
    if known is not None:
        return known
    good = bad = comments = False
    for token in name.split():
        parts = PARTS.findall(token)
        if not parts or (len(parts) > 1 and (parts[0] in AROUND or parts[-1] == "free")):
            continue
        good |= not GOOD.isdisjoint(parts)
        bad |= not BAD.isdisjoint(parts)
        comments |= not COMMENTS.isdisjoint(parts)
    if len(TOLD) > 100_000:
        TOLD.clear()
    TOLD[name] = good, bad, comments
    return good, bad, comments


# A quote delimits a value right after "=" only; elsewhere it is an ordinary character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|$)|'[^']*+(?:'|$)|[^\s>\"'][^\s>]*+)?+)?+)*+)(?:>|$)|</[^>]*(?:>|$)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|$)|'([^']*+)(?:'|$)|([^\s>\"'][^\s>]*+))?+)?+")


class Node:
    """An element, or a run of text and inline elements directly inside one (``tag`` is then ``#``)."""

    __slots__ = ("tag", "name", "parent", "children", "pieces", "link_chars", "hidden", "text")

    def __init__(self, tag: str, parent: Node | None, name: str = "", hidden: bool = False):
        self.tag, self.parent, self.name, self.hidden = tag, parent, name, hidden
        self.children: list[Node] = []
        self.pieces: list[str] = []
        self.link_chars = 0
        self.text = ""


def _pairs(page: str, tag: str) -> dict[int, tuple[int, int]]:
    """For the start of each start tag that has a matching end tag, where that begins and ends."""
    out, opened = {}, []
    for found in re.compile(f"<(/?){tag}(?=[\\s/>])[^>]*>", re.I).finditer(page):
        if not found.group(1):
            if tag in ("button", "select"):  # a second start tag ends the first element
                opened.clear()
            opened.append(found.start())
        elif opened:
            out[opened.pop()] = found.span()
    return out


def _left(page: str, at: int, end: int, stack: list[Node]) -> bool:
    """Whether an end tag between ``at`` and ``end`` closes an element that is open at ``at``, and with it what was opened there."""
    outer, inner = {n.tag for n in stack} - {"p"}, {}
    for found in TOKEN.finditer(page, at, end):
        tag = (found.group(2) or "").lower()
        if found.group(1):
            if inner.get(tag):
                inner[tag] -= 1
            elif tag in outer:
                return True
        elif tag:
            inner[tag] = inner.get(tag, 0) + 1
    return False


def parse(page: str) -> Node:
    """The block tree of a page. Inline elements leave no node; white space inside a block becomes one space."""
    root = Node("#root", None)
    stack, run = [root], None
    opened, inline, broke = Counter(), Counter(), False  # open elements by tag; whether only spaces came since a line break
    at, end = 0, len(page)
    pairs: dict[str, dict[int, tuple[int, int]]] = {}

    def flush() -> None:
        nonlocal run
        if run is not None:
            run.text = " ".join("".join(run.pieces).split())
            run.pieces = []
            if run.text:
                run.parent.children.append(run)
            run = None

    def put(text: str) -> None:
        nonlocal run, broke
        some = not text.isspace()
        if run is None:
            if not some:
                return
            run = Node("#", stack[-1])
        broke &= not some
        text = entities.unescape(text) if "&" in text else text
        run.pieces.append(text)
        if inline["a"]:
            run.link_chars += len(text.strip())

    def close_from(k: int) -> None:
        for node in stack[k:]:
            opened[node.tag] -= 1
        del stack[k:]
        inline.clear()

    while at < end:
        found = TOKEN.search(page, at)
        if not found:
            put(page[at:])
            break
        if found.start() > at:
            put(page[at : found.start()])
        at = found.end()
        tag = (found.group(2) or "").lower()
        if not tag:
            if found.group(0).startswith("<![CDATA["):
                put(found.group(0)[9:-3])
            continue
        if found.group(1):
            if tag in INLINE:
                if inline[tag]:
                    inline[tag] -= 1
            elif opened[tag]:
                flush()
                k = len(stack) - 1
                while stack[k].tag != tag:
                    k -= 1
                close_from(k)
            continue
        closed = found.group(3).rstrip().endswith("/") and tag not in OPAQUE
        if tag == "br":  # two in a row end a block
            if run is not None and broke:
                flush()
            elif run is not None:
                run.pieces.append(" ")
            broke = run is not None
            continue
        if tag in INLINE:
            if tag not in VOID and not closed:
                inline[tag] += 1
            continue
        if tag in FALLBACK and run is not None:  # inside a block's text
            continue
        if tag in RAW:
            if tag in OPAQUE:
                close = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
                at = close.start() if close else end
                shut = page.find(">", at)
                at = shut + 1 if close and shut >= 0 else end
            elif not closed:  # all up to the matching end tag; without one, the start tag only
                if tag not in pairs:
                    pairs[tag] = _pairs(page, tag)
                close, after = pairs[tag].get(found.start(), (at, at))
                if tag not in ("button", "datalist") or not _left(page, at, close, stack):
                    at = after
            continue
        flush()
        broke = False
        if tag in ENDS_P and stack[-1].tag == "p":
            close_from(len(stack) - 1)
        for other in CLOSES.get(tag, ()):
            for k in range(len(stack) - 1, 0, -1) if opened[other] else ():
                if stack[k].tag in SCOPE.get(tag, ()):
                    break
                if stack[k].tag == other:
                    close_from(k)
                    break
        if tag in VOID:
            continue
        parts, hidden = [], False
        if found.group(3).strip():
            for key, a, b, c in ATTRIBUTE.findall(found.group(3)):
                key = key.lower()
                if key in ("id", "class", "role", "itemprop"):
                    parts.append((a or b or c).lower())
                elif key == "hidden" or (key == "style" and "display:none" in (a or b or c).replace(" ", "").lower()):
                    hidden = True
        node = Node(tag, stack[-1], " ".join(parts), hidden)
        stack[-1].children.append(node)
        if not closed and len(stack) < DEEPEST:
            stack.append(node)
            opened[tag] += 1
    flush()
    return root


NAMES = (
    "depth", "chars", "links", "words", "ends", "commas", "blocks", "marks", "prose", "is_p", "is_heading", "is_item", "is_cell", "is_frame", "is_article", "is_top", "is_fallback", "good", "bad",
    "in_frame", "in_article", "above_good", "above_bad", "in_comments", "place", "siblings", "like", "is_run", "share", "of_parent", "most_prose", "before", "after", "parent_links", "parent_prose",
)
AT = {name: i for i, name in enumerate(NAMES)}
NOTE = 300  # characters that a text which frames a page has at most
ENDS = frozenset(".!?…\"”»。！？")
# is_p, is_heading, is_item, is_cell
HELD = {"p": (1, 0, 0, 0), **{f"h{i}": (0, 1, 0, 0) for i in range(1, 7)}, "li": (0, 0, 1, 0), "dd": (0, 0, 1, 0), "dt": (0, 0, 1, 0), "td": (0, 0, 0, 1), "th": (0, 0, 0, 1)}
NOT_HELD = (0, 0, 0, 0)


class Page:
    """A page's nodes in page order and their features."""

    def __init__(self, page: str):
        self.nodes: list[Node] = []
        self.parent: list[int] = []
        rows: list[list[float]] = []
        todo = [(parse(page), -1, 0, (0, 0, 0, 0, 0), 0.0, 0)]
        # parents come before children, siblings in page order
        while todo:
            node, parent, depth, above, place, like = todo.pop()
            if node.hidden or (not node.children and node.tag != "#"):
                continue
            me = len(self.nodes)
            self.nodes.append(node)
            self.parent.append(parent)
            if node.tag == "#":
                text, holder = node.text, node.parent.tag
                size, words = len(text), text.count(" ") + 1
                rows.append((
                    depth, size, node.link_chars, words, text[-1] in ENDS, text.count(","), 1, size <= NOTE and MARKS.search(text) is not None, size if words > 9 and 2 * node.link_chars < size else 0,
                    *HELD.get(holder, NOT_HELD), 0, 0, 0, holder in FALLBACK, 0, 0, *above, place, len(node.parent.children), like, 1, 0, 0, 0, 0, 0, 0, 0,
                ))
                continue
            tag = node.tag
            top, frame, article = tag in TOP_TAGS, tag in FRAME_TAGS, tag in ("article", "main")
            good, bad, comments = (False, False, False) if top or not node.name else told(node.name)
            rows.append((
                depth, 0, 0, 0, 0, 0, 0, 0, 0, *HELD.get(tag, NOT_HELD), frame, article, top, tag in FALLBACK, good, bad,
                *above, place, len(node.parent.children) if node.parent else 0, like, 0, 0, 0, 0, 0, 0, 0, 0,
            ))
            inside = (above[0] + frame, above[1] + article, above[2] + good, above[3] + bad, above[4] + comments)
            children, n = node.children, len(node.children)
            if n == 1:
                todo.append((children[0], me, depth + 1, inside, 0.0, 1))
                continue
            tags: dict[str, int] = {}
            for child in children:
                tags[child.tag] = tags.get(child.tag, 0) + 1
            for k in range(n - 1, -1, -1):
                todo.append((children[k], me, depth + 1, inside, k / (n - 1), tags[children[k].tag]))
        self.x = np.array(rows, float).reshape(len(rows), len(NAMES))
        if len(rows):
            self._subtrees()

    def _subtrees(self) -> None:
        x, parent = self.x, np.array(self.parent)
        sums = slice(AT["chars"], AT["prose"] + 1)
        for i in range(len(parent) - 1, 0, -1):  # sums over subtrees; a run's own values are its sums
            x[parent[i], sums] += x[i, sums]
        chars, prose = x[:, AT["chars"]].copy(), x[:, AT["prose"]].copy()
        runs = np.flatnonzero(x[:, AT["is_run"]] > 0)
        self.runs = runs
        lengths = np.log1p(chars[runs])
        x[runs, AT["before"]] = np.concatenate([[0], lengths[:-1]])
        x[runs, AT["after"]] = np.concatenate([lengths[1:], [0]])
        blocks, some = np.maximum(1.0, x[:, AT["blocks"]]), np.maximum(1.0, chars)
        up = np.maximum(parent, 0)
        x[:, AT["share"]] = chars / some[0]
        x[:, AT["of_parent"]] = chars / some[up]
        most = np.zeros(len(x))
        np.maximum.at(most, up[1:], prose[1:])
        x[:, AT["most_prose"]] = (prose > 0) & (prose >= most[up])
        x[:, AT["links"]] /= some
        x[:, AT["ends"]] /= blocks
        x[:, AT["marks"]] /= blocks
        x[:, AT["commas"]] /= np.maximum(1.0, x[:, AT["words"]])
        x[:, AT["words"]] = np.log1p(x[:, AT["words"]] / blocks)
        x[:, AT["prose"]] = prose / some
        x[:, AT["chars"]] = np.log1p(chars)
        x[:, AT["blocks"]] = np.log1p(x[:, AT["blocks"]])
        x[:, AT["parent_links"]], x[:, AT["parent_prose"]] = x[up, AT["links"]], x[up, AT["prose"]]


class Trees:
    """Boosted regression trees for the logistic loss, over features cut into bins."""

    def __init__(self):
        self.feature: list[np.ndarray] = []
        self.limit: list[np.ndarray] = []
        self.value: list[np.ndarray] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
        mean = float((y * weight).sum() / weight.sum())
        self.start = float(np.log(mean / (1 - mean)))
        score = np.full(len(y), self.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (y - p), weight * p * (1 - p)
            feature, limit, value = np.full(2 ** (DEPTH + 1), -1), np.zeros(2 ** (DEPTH + 1)), np.zeros(2 ** (DEPTH + 1))
            at = np.ones(len(y), int)
            for node in range(1, 2**DEPTH):
                rows = np.flatnonzero(at == node)
                if len(rows) < 60:
                    continue
                best = (1e-3, -1, 0)
                sum_g, sum_h = g[rows].sum(), h[rows].sum()
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    low_g = np.bincount(bins[rows, f], g[rows], BINS + 1).cumsum()[: len(e)]
                    low_h = np.bincount(bins[rows, f], h[rows], BINS + 1).cumsum()[: len(e)]
                    gain = low_g**2 / (low_h + 1) + (sum_g - low_g) ** 2 / (sum_h - low_h + 1) - sum_g**2 / (sum_h + 1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
                if best[1] >= 0:
                    feature[node], limit[node] = best[1], edges[best[1]][best[2]]
                    at[rows] = 2 * node + (bins[rows, best[1]] > best[2])
            for node in np.unique(at):
                rows = at == node
                value[node] = RATE * g[rows].sum() / (h[rows].sum() + 1)
            score += value[at]
            self.feature.append(feature)
            self.limit.append(limit)
            self.value.append(value)
        return self

    def stored(self) -> str:
        """The trees as JSON: for each its inner nodes (node, feature, limit) and its leaves (node, value)."""
        inner = [[[int(i), int(f[i]), float(t[i])] for i in np.flatnonzero(f >= 0)] for f, t in zip(self.feature, self.limit, strict=True)]
        leaves = [[[int(i), round(float(v[i]), 6)] for i in np.flatnonzero(v)] for v in self.value]
        return json.dumps({"features": list(NAMES), "pages": TRAINING_PAGES, "depth": DEPTH, "start": round(self.start, 6), "inner": inner, "leaves": leaves}, separators=(",", ":"))

    @classmethod
    def read(cls, text: str) -> Trees:
        held, out = json.loads(text), cls()
        if held["features"] != list(NAMES) or held["depth"] != DEPTH:
            raise ValueError("the stored trees are of other features; write them anew")
        out.start = held["start"]
        for inner, leaves in zip(held["inner"], held["leaves"], strict=True):
            feature, limit, value = np.full(2 ** (DEPTH + 1), -1), np.zeros(2 ** (DEPTH + 1)), np.zeros(2 ** (DEPTH + 1))
            for i, f, t in inner:
                feature[i], limit[i] = f, t
            for i, v in leaves:
                value[i] = v
            out.feature.append(feature)
            out.limit.append(limit)
            out.value.append(value)
        return out

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        every = np.arange(len(x))
        for feature, limit, value in zip(self.feature, self.limit, self.value, strict=True):
            at = np.ones(len(x), int)
            for _ in range(DEPTH):
                f = feature[at]
                at = np.where(f >= 0, 2 * at + (x[every, f] > limit[at]), at)
            score += value[at]
        return score


def votes(page: Page, odds: np.ndarray) -> np.ndarray:
    """Each node's log odds, weighed by the text below it. The page and its body have no say; a run that is all of its element is judged together with it."""
    own = np.clip(odds, -6, 6) * (1 + page.x[:, AT["chars"]]) * (page.x[:, AT["is_top"]] == 0)
    out = own.copy()
    for i in page.runs:
        if len(page.nodes[page.parent[i]].children) == 1:
            out[i] += own[page.parent[i]]
    return out


def decode(page: Page, odds: np.ndarray) -> list[str]:
    """The texts of the runs that stay: those of the best choice of nodes that keeps none below a dropped one."""
    n = len(page.nodes)
    own = votes(page, odds)
    best = np.zeros(n)
    for i in range(n - 1, -1, -1):
        best[i] += own[i]
        if i and best[i] > 0:
            best[page.parent[i]] += best[i]
    kept = best > 0
    out = []
    for i in range(n):
        if i:
            kept[i] &= kept[page.parent[i]]
        else:
            kept[i] = True
        if kept[i] and page.nodes[i].tag == "#":
            out.append(page.nodes[i].text)
    return out


# Words for the training pages.
_WORDS = "der die und mit von für the of and to in that with from was which les des une pour dans est que por para con como sobre data model river stone glass light paper water garden window market letter winter engine signal".split()
_SHORT = "Home About Contact News Sports Login Register Search Next Previous Tags Share Print Subscribe Menu Accueil Startseite Inicio Archiv Help Terms Privacy Jobs Shop Cart".split()
_HOLDERS = "article article-body post post-content entry entry-content content main-content story story-body text prose blog-post richtext td-post-content".split()
_SHELLS = "page site wrapper container main-wrapper row grid outer inner layout col-md-8 columns l-page u-flex app".split()
_AROUND = "single-post has-sidebar with-sidebar no-sidebar ad-free logged-in category-news tag-river tag-ads category-widgets post-4711 status-publish type-post format-standard has-comments no-js theme-light page-template-default with-header is-wide has-banner".split()


def training_pages(count: int = TRAINING_PAGES, seed: int = 11) -> Iterator[tuple[str, list[str]]]:
    """Pages of many layouts with the blocks of their main text."""
    for k in range(count):
        yield _Writer(random.Random(seed * 100_003 + k)).page()


class _Writer:
    """One page: a shell (plain, nested, semantic, table), an article of some length and mark-up, and framing parts with telling names, or none."""

    def __init__(self, r: random.Random):
        self.r, self.main = r, []
        self.noise = r.choice((" | ", "*** ", "!! ", " &amp; ", "### ", "%%% ")) if r.random() < 0.12 else ""  # text that is not prose is main text all the same
        self.named = r.random() < 0.7  # whether elements have names
        self.semantic = r.random() < 0.6  # or tags that tell of them

    def some(self, p: float, f) -> str:
        return f() if self.r.random() < p else ""

    def attr(self, *names: str, always: bool = False) -> str:
        r = self.r
        if not (always or (self.named and r.random() < 0.8)):
            return ""
        extra = [x for x in (r.choice(_SHELLS), r.choice(_AROUND)) if r.random() < 0.25]
        key = r.choice(("class", "class", "class", "id"))
        return f' {key}="{" ".join([r.choice(names), *(extra if key == "class" else ())])}"'

    def tag(self, semantic: str, plain: str = "div") -> str:
        return semantic if self.semantic and self.r.random() < 0.85 else plain

    def words(self, low: int, high: int, noise: bool = False) -> str:
        r = self.r
        n = r.randint(low, high)
        out = [("".join(r.choice(_WORDS)[:4] for _ in range(r.randint(1, 3))) if r.random() < 0.5 else r.choice(_WORDS)) for _ in range(n)]
        if noise and self.noise:
            return self.noise.join(out)
        return " ".join(out)

    def prose(self, low: int, high: int, noise: bool = False) -> str:
        """Sentences of ``low`` to ``high`` words in all."""
        if noise and self.noise:
            return self.words(low, high, True)
        r, left, out = self.r, self.r.randint(low, high), []
        while left > 0:
            n = min(left, r.randint(4, 22))
            w = self.words(n, n).split(" ")
            for i in range(3, n - 1):
                if r.random() < 0.1:
                    w[i] += ","
            w[0] = w[0].capitalize()
            out.append(" ".join(w) + r.choice("....!?"))
            left -= n
        return " ".join(out)

    # main text

    def block(self, text: str) -> str:
        """A block of the main text, some words of it marked up."""
        r = self.r
        self.main.append(" ".join(entities.unescape(text).split()))
        w = text.split(" ")
        for _ in range(r.choice((0, 0, 0, 1, 1, 2, 4))):
            i = r.randrange(len(w))
            if "<" not in w[i] and "&" not in w[i]:
                w[i] = r.choice(('<a href="/ref">{}</a>', '<a class="link" href="https://x.example/a?b=1&amp;c=2">{}</a>', "<b>{}</b>", "<em>{}</em>", "<strong>{}</strong>", "<code>{}</code>", "<span>{}</span>")).format(w[i])
        if r.random() < 0.03:
            return f'<a href="/all">{text}</a>'
        return r.choice((" ", " ", " ", "\n")).join(w)

    def paragraph(self) -> str:
        if self.r.random() < 0.06:  # an article may speak of what frames a page
            return self.block(self.r.choice(("All rights reserved.", "Copyright 2019 by the author.", f"{self.prose(4, 20)} Cookies and javascript. {self.prose(2, 10)}", f"Subscribe, {self.prose(4, 20)}", "&copy; the author")))
        return self.block(self.prose(*self.r.choice(((1, 5), (4, 20), (8, 30), (15, 60), (30, 120), (90, 300))), noise=True))

    def body(self) -> str:
        """The blocks below the title, in one of the ways in which sites write paragraphs."""
        r, out = self.r, []
        way = r.choice(("p", "p", "p", "p", "div", "br", "open"))
        lines = []

        def end() -> None:
            if lines:
                out.append(r.choice(("<br><br>", "<br/>\n<br/>", "<br /> <br />")).join(lines))
                lines.clear()

        for _ in range(r.choice((1, 1, 2, 3, 4, 5, 6, 8, 12, 25))):
            kind = r.random()
            if kind < 0.72:
                if way == "br":
                    lines.append(self.paragraph())
                else:
                    out.append({"p": f"<p{self.some(0.1, lambda: self.attr('paragraph', 'p1', 'has-text-align-left'))}>{{}}</p>", "div": "<div>{}</div>", "open": "<p>{}"}[way].format(self.paragraph()))
                continue
            end()
            if kind < 0.79:
                h = r.choice(("h2", "h2", "h3", "h4"))
                out.append(f"<{h}>{self.block(self.words(1, 8, True))}</{h}>")
            elif kind < 0.84:
                items = "".join(f"<li>{self.block(self.prose(2, 25, True))}</li>" for _ in range(r.randint(1, 6)))
                out.append(r.choice(("<ul>{}</ul>", "<ol>{}</ol>")).format(items))
            elif kind < 0.87:
                out.append(r.choice(("<blockquote><p>{}</p></blockquote>", "<blockquote>{}</blockquote>", "<pre>{}</pre>")).format(self.paragraph()))
            elif kind < 0.9:
                out.append("<table>" + "".join("<tr>" + "".join(f"<{c}>{self.block(self.words(1, 5, True))}</{c}>" for c in ("th", "td", "td")) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>")
            elif kind < 0.92:
                out.append(f"<figure><img src=\"/p.jpg\" alt=\"\"><figcaption>{self.block(self.prose(3, 20))}</figcaption></figure>")
            elif kind < 0.935:
                out.append("<dl>" + "".join(f"<dt>{self.block(self.words(1, 4))}</dt><dd>{self.block(self.prose(3, 25))}</dd>" for _ in range(r.randint(1, 4))) + "</dl>")
            elif kind < 0.95:
                out.append(f"<noscript><p>{self.block(self.prose(20, 60))}</p></noscript>")
            else:
                out.append(r.choice((self.advert, self.sharing, self.form, self.related, self.player))())
        end()
        return r.choice(("", "\n")).join(out)

    def article(self) -> str:
        r = self.r
        title = ""
        if r.random() < 0.88:
            h = r.choice(("h1", "h1", "h1", "h2"))
            title = f"<{h}{self.some(0.3, lambda: self.attr('title', 'headline', 'entry-title', 'post-title'))}>{self.block(self.words(1, 12, True))}</{h}>"
            if self.semantic and r.random() < 0.15:
                title = f"<header{self.attr('entry-header', 'article-header')}>{title}</header>"
        return title + self.some(0.25, self.byline) + self.body() + self.some(0.2, self.sharing)

    # framing parts

    def byline(self) -> str:
        return f"<div class=\"{self.r.choice(('byline', 'meta', 'entry-meta', 'post-meta', 'author-info'))}\"><span>{self.words(1, 3)}</span> <a href=\"/author\">{self.words(1, 2)}</a></div>"

    def links(self, low: int = 2, high: int = 12) -> str:
        r = self.r
        texts = [r.choice(_SHORT) if r.random() < 0.5 else self.words(1, r.choice((1, 1, 3, 8))) for _ in range(r.randint(low, high))]
        each = [f'<a href="/{i}">{t}</a>' for i, t in enumerate(texts)]
        return r.choice((lambda: "<ul>" + "".join(f"<li>{a}</li>" for a in each) + "</ul>", lambda: r.choice((" | ", " ", " &raquo; ", " &middot; ")).join(each), lambda: "".join(f"<div>{a}</div>" for a in each)))()

    def advert(self) -> str:
        tag = self.r.choice(("div", "div", "aside", "section", "ins"))
        text = self.r.choice((lambda: self.prose(3, 30), lambda: f'<p>{self.prose(3, 25)}</p><a href="/buy">{self.words(1, 4)}</a>', lambda: f'<span>Advertisement</span><a href="/buy">{self.words(2, 8)}</a>'))()
        return f"<{tag} class=\"{self.r.choice(('ad', 'ads', 'ad-slot', 'advert', 'advertisement', 'banner', 'sponsored', 'promo', 'ad-container', 'sponsor-box'))}\">{text}</{tag}>"

    def sharing(self) -> str:
        return f"<div class=\"{self.r.choice(('share', 'social', 'share-buttons', 'social-links', 'post-tags tags', 'sharing'))}\">{self.links(1, 6)}</div>"

    def related(self) -> str:
        r = self.r
        cards = "".join(f'<div class="card"><h3><a href="/{i}">{self.words(3, 9)}</a></h3>{self.some(0.6, lambda: f"<p>{self.prose(6, 25)}</p>")}</div>' for i in range(r.randint(1, 5)))
        tag = r.choice(("div", "section", "aside"))
        return f"<{tag} class=\"{r.choice(('related', 'related-posts', 'recommended', 'read-more teasers', 'trending', 'popular-posts'))}\"><h3>{self.words(1, 3)}</h3>{r.choice((cards, self.links(2, 6)))}</{tag}>"

    def player(self) -> str:
        return self.r.choice(("<video controls><source src=\"a.mp4\">Your browser does not support video.</video>", "<audio controls>Your browser does not play sound, <a href=\"a.mp3\">download it</a>.</audio>", "<noscript>Please enable JavaScript to view this.</noscript>", "<noscript><img src=\"/pixel.gif\" alt=\"\"></noscript>", "<canvas>Your browser shows no canvas.</canvas>"))

    def form(self) -> str:
        tag = self.r.choice(("form", "form", "div"))
        return f"<{tag}{self.attr('newsletter', 'search', 'login', 'newsletter-signup', 'subscribe-box', always=tag == 'div')}><label>{self.words(1, 10)}</label><input name=q><p>{self.prose(2, 15)}</p><button>Go</button></{tag}>"

    def notice(self) -> str:
        text = self.r.choice((lambda: self.prose(6, 40), lambda: f"We use cookies. {self.prose(4, 25)}"))()
        return f"<div {self.r.choice(('class', 'id'))}=\"{self.r.choice(('cookie-banner', 'cookie-notice', 'consent', 'gdpr-notice', 'notice', 'popup', 'modal', 'overlay'))}\"><p>{text}</p>{self.some(0.5, lambda: '<button>OK</button>')}</div>"

    def nav(self) -> str:
        tag = self.tag("nav")
        return f"<{tag}{self.attr('nav', 'menu', 'main-menu', 'navbar', 'site-navigation', 'breadcrumbs', 'topnav')}>{self.links(3, 14)}</{tag}>"

    def header(self) -> str:
        tag = self.tag("header")
        inner = self.r.choice((f"<div>{self.words(1, 4)}</div>", f'<a href="/">{self.words(1, 3)}</a>', f"<h1>{self.words(1, 3)}</h1>" if tag == "header" else f"<span>{self.words(1, 3)}</span>"))
        return f"<{tag}{self.attr('header', 'masthead', 'site-header', 'page-header', 'top-banner', always=tag == 'div')}>{inner}{self.some(0.5, lambda: f'<p>{self.words(2, 10)}</p>')}{self.some(0.5, self.nav)}</{tag}>"

    def widget(self) -> str:
        return f"<h3>{self.words(1, 4)}</h3>" + self.r.choice((self.links, lambda: f"<p>{self.prose(5, 50)}</p>", lambda: "".join(f'<p><a href="/{i}">{self.words(3, 8)}</a> {self.prose(4, 14)}</p>' for i in range(self.r.randint(1, 4)))))()

    def sidebar(self) -> str:
        tag = self.tag("aside")
        inner = "".join(self.widget() if self.r.random() < 0.6 else f"<div class=\"widget\">{self.widget()}</div>" for _ in range(self.r.randint(1, 4)))
        return f"<{tag}{self.attr('sidebar', 'side', 'widget-area', 'right-rail', 'side-column', always=tag == 'div')}>{inner}</{tag}>"

    def comments(self) -> str:
        r = self.r
        tag, each = r.choice((("section", "div"), ("div", "div"), ("ol", "li"), ("div", "article"), ("ul", "li")))
        one = lambda: f"<{each} class=\"{r.choice(('comment', 'reply', 'comment-body', 'comment even depth-1'))}\"><p class=\"{r.choice(('author', 'who', 'comment-meta'))}\">{self.words(1, 3)}</p><p>{self.prose(3, 80)}</p></{each}>"
        return f"<{tag} {r.choice(('id', 'class'))}=\"{r.choice(('comments', 'comment-list', 'disqus_thread', 'discussion comments', 'responses'))}\"><h3>{self.words(1, 3)}</h3>{''.join(one() for _ in range(r.randint(1, 6)))}{self.some(0.3, self.form)}</{tag}>"

    def footer(self) -> str:
        r = self.r
        tag = self.tag("footer", r.choice(("div", "div", "p")))
        text = r.choice((f"&copy; {r.randint(1999, 2025)} {self.words(1, 4)}.", f"&copy; {self.words(1, 3)} &middot; {self.prose(2, 40)}", f"Copyright {self.words(1, 4)}. All rights reserved.", f"{self.words(1, 3)} | {self.words(1, 4)}" if tag == "footer" else "&copy;"))
        return f"<{tag}{self.attr('footer', 'site-footer', 'copyright', 'legal', 'bottom', always=tag == 'div')}>{text}{self.some(0.4, self.links) if tag != 'p' else ''}</{tag}>"

    # shells

    def page(self) -> tuple[str, list[str]]:
        r = self.r
        shell = r.choice(("bare", "bare", "bare", "nested", "nested", "nested", "named", "named", "named", "semantic", "semantic", "table", "table"))
        body = self.article()
        if shell == "semantic":
            tag = r.choice(("article", "article", "main", "section"))
            body = f"<{tag}{self.attr(*_HOLDERS, always=tag == 'section')}>{body}{self.some(0.12, self.comments)}</{tag}>"
        elif shell == "named":
            body = f"<div{self.attr(*_HOLDERS, always=True)}>{body}</div>"
        elif shell == "nested":
            for _ in range(r.randint(1, 3)):
                body = f"<div>{body}</div>"
        after = self.some(0.3, self.comments) + self.some(0.25, self.related) + self.some(0.15, self.advert) + self.some(0.15, self.form)
        side = self.some(0.4, self.sidebar)
        if shell == "table":
            left = self.some(0.7, self.links)
            inner = f"<tr>{f'<td width=150>{left}</td>' if left else ''}<td>{body}</td>{f'<td>{side}</td>' if side else ''}</tr>"
            body = f"<table width=\"100%\">{self.some(0.4, lambda: f'<tr><td colspan=3>{self.links(3, 8)}</td></tr>')}{inner}</table>{after}"
        else:
            body = r.choice((f"{body}{after}{side}", f"{side}{body}{after}"))
            for _ in range(r.choice((0, 0, 0, 1) if shell == "bare" else (0, 0, 1, 1, 2))):
                body = f"<div{self.attr(*_SHELLS)}>{body}</div>"
        top = self.some(0.2, self.notice) + self.some(0.45, self.header) + self.some(0.6, self.nav) + self.some(0.25, self.advert)
        rest = self.some(0.7, self.footer) + self.some(0.15, self.notice) + self.some(0.1, self.player)
        around = f' class="{" ".join(r.sample(_AROUND, r.randint(1, 5)))}"' if r.random() < 0.3 else ""
        script = r.choice(("", "<script>if (a < b && c > d) { document.write('<div class=\"x\">' + t + '</div>'); }</script>", '<script type="application/json">{"body": "<p>no</p>"}</script>'))
        head = f"<head><title>{self.words(1, 8)}</title>{r.choice(('', '<style>h1 { color: red } p > a { color: blue }</style>'))}{script}</head>"
        return f"{r.choice(('', '<!DOCTYPE html>'))}<html>{head}<body{around}>{top}{r.choice(('', '<!-- begin -->'))}{body}{rest}{script if r.random() < 0.2 else ''}</body></html>", self.main


def _labels(page: Page, main: list[str]) -> np.ndarray:
    """1 for runs of the main text (each of its blocks once, in order) and for containers of which a quarter of the text is main."""
    good = np.zeros(len(page.nodes))
    size = np.zeros(len(page.nodes))
    at = 0
    for i in page.runs:
        size[i] = 1 + len(page.nodes[i].text)
        if at < len(main) and page.nodes[i].text == main[at]:
            good[i], at = size[i], at + 1
    for i in range(len(page.nodes) - 1, 0, -1):
        good[page.parent[i]] += good[i]
        size[page.parent[i]] += size[i]
    return (good * 4 > size).astype(float)


def fitted() -> Trees:
    """Trees trained anew."""
    xs, ys, ws = [], [], []
    for source, main in training_pages():
        page = Page(source)
        xs.append(page.x[1:])
        ys.append(_labels(page, main)[1:])
        ws.append(np.full(len(page.x) - 1, 1 / np.sqrt(len(page.x))))
    return Trees().fit(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


@lru_cache(1)
def trained() -> Trees:
    return Trees.read(MODEL.read_text())


def extract(sources: list[str], trees: Trees) -> list[list[str]]:
    """The kept blocks of each page."""
    pages = [Page(s) for s in sources]
    some = [p.x for p in pages if len(p.x)]
    odds = trees.log_odds(np.concatenate(some)) if some else np.zeros(0)
    out, at = [], 0
    for page in pages:
        out.append(decode(page, odds[at : at + len(page.x)]) if len(page.x) else [])
        at += len(page.x)
    return out


def _extracted(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = model()
        for batch in chunks(batches, "raw", 1 << 20):
            blocks = extract([(r or b"").decode("utf-8", "replace") for r in batch.column("raw").to_pylist()], trees)
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(["\n".join(b) for b in blocks], pa.string())], ["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages(page_id, url, html, ...)``. No shuffle.

    Null and empty pages, and pages without main text, give an empty text. Markup may be broken or cut off anywhere.
    Repeated rows give repeated results.
    """
    raw = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), as_bytes("html").alias("raw"))
    texts = raw.mapInArrow(_extracted(share(pages.sparkSession, trained())), "page_id long, url string, text string")
    return texts.withColumn("n_chars", F.char_length("text").cast("long"))


if __name__ == "__main__":
    MODEL.write_text(fitted().stored())
