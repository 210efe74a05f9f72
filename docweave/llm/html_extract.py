"""HTML extraction: gradient-boosted trees over DOM-node features, decoded hierarchically.

A tolerant parser builds a tree of block elements (inline elements belong to their block). Each node
has features of its subtree (text, link and tag density, sentence marks), its attribute tokens, depth,
position and siblings. Boosted trees, trained here on pages of a generator with known labels, give the
probability that a node belongs to the article. Decoding takes the likeliest labelling in which no node
is kept under a dropped one, so ancestors and descendants never contradict each other.

Text of a kept node: character references decoded, white space inside a block as one space, trimmed,
blocks joined in page order by one space. Null and empty pages give an empty text; text without any
markup is kept whole; unclosed or misplaced tags are repaired; a comment or tag that never ends is markup
up to the page's end; controls and fallback content (SKIPPED) have no text. Repeated rows, null ids and
null urls pass through; an empty table gives an empty result; very long and deeply nested pages need time
and memory in proportion to their length, a few hundred bytes a node: feature rows are made in blocks.
One pass without a shuffle; extra columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from docweave.llm.common import chunks, free_name

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?][^>]*+>""", re.S
)
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_OPENING = re.compile(r"<(?:[a-zA-Z]|/[a-zA-Z]|[!?])")
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page, with all that they hold.
SKIPPED = frozenset("object select datalist button head audio".split())
#: What a head may hold; anything else ends it.
OF_HEAD = frozenset("title meta link base style script noscript template".split())
#: Elements whose text is skipped to the end tag, whatever it holds.
RAW = frozenset("script style noscript template svg iframe canvas math title textarea video audio".split())
#: An opening tag ends an open element of these.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}, "p": {"p"}}
TAGS = "html body main article section div p h1 h2 h3 h4 ul ol li table tr td th thead tbody blockquote pre figure figcaption header footer nav aside form button input label dl dt dd address details summary fieldset hr".split()
_TAG_AT = {t: i for i, t in enumerate(TAGS)}
_PHRASE = frozenset("p h1 h2 h3 h4 h5 h6 pre".split())

# Words that page authors use in class and id attributes, by what they mark.
CUES = {
    "ad": "ad ads advert advertisement adbox sponsor sponsored promo promotion banner dfp outbrain taboola".split(),
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs crumbs topbar toolbar pagination pager tabs sitemap skip".split(),
    "foot": "footer foot copyright legal colophon credits bottom".split(),
    "head": "header masthead logo branding top site sitename".split(),
    "side": "sidebar side aside widget rail related recommended popular trending more links tags share sharing social follow".split(),
    "comment": "comment comments reply replies discussion disqus respond responses thread feedback reader".split(),
    "form": "form newsletter subscribe subscription signup login search register input contact".split(),
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay banner message warning privacy paywall".split(),
    "content": "content article post entry story main body text page blog news maincontent prose".split(),
}
# Words of legal lines, consent boxes, letters and adverts.
PHRASES = frozenset("© copyright rights reserved cookie cookies consent privacy terms imprint impressum datenschutz subscribe newsletter login sponsored advertisement".split())
_CUE_OF = {w: k for k, (_, ws) in reversed(list(enumerate(CUES.items()))) for w in ws}
BUCKETS = 32
#: Feature rows made at once.
ROWS = 1 << 14
COLUMNS = len(TAGS) + 1 + 2 * len(CUES) + BUCKETS + 25


class Page:
    """The tree of a page: parallel lists by node, and runs of text, each with its node."""

    __slots__ = ("tag", "parent", "depth", "attrs", "begin", "runs", "links", "inputs")

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attrs, self.begin = ["#root"], [-1], [0], [""], [0]
        self.runs: list[tuple[int, str, int]] = []  # node, text of one block, characters of it in links
        self.inputs = [0]
        self.parse(source)

    def parse(self, source: str) -> None:
        stack, names = [0], {}
        pieces: list[str] = []
        anchors = linked = 0
        at = muted = 0
        last = source.rfind(">")

        def flush() -> None:
            nonlocal linked
            if pieces:
                text = "".join(pieces)
                if "&" in text:
                    text = html.unescape(text)
                text = " ".join(text.split())
                if text and not muted:
                    self.runs.append((stack[-1], text, min(linked, len(text))))
                pieces.clear()
            linked = 0

        def close(n: int) -> None:
            nonlocal muted
            while len(stack) > n:
                name = self.tag[stack.pop()]
                names[name] -= 1
                muted -= name in SKIPPED

        skip_to = None
        for m in _TAG.finditer(source, 0, last + 1):
            begin = m.start()
            if begin < at:
                continue
            if skip_to is not None:
                if not ((m[1] or m[4]) and (m[2] or m[5]).lower() == skip_to):
                    continue
                skip_to = None
                at = m.end()
                continue
            if begin > at:
                pieces.append(source[at:begin])
                if anchors:
                    linked += begin - at
            at = m.end()
            name = m[2] or m[5]
            if name is None:
                if source.startswith("<!--", begin) and not (source.endswith("-->", begin + 4, at) or at - begin < 7 and source.startswith(("<!-->", "<!--->"), begin)):
                    at = len(source)  # a comment without an end
                    break
                continue
            name = name.lower()
            if m[1] or m[4]:
                if name == "a":
                    anchors = max(0, anchors - 1)
                elif name not in INLINE and names.get(name):
                    flush()
                    n = len(stack) - 1
                    while self.tag[stack[n]] != name:
                        n -= 1
                    close(n)
                    anchors = 0
                elif name == "p":
                    flush()
                continue
            given = m[3] or m[6] or ""
            if name in INLINE:
                if name == "a":
                    anchors = 1
                elif name == "br":
                    pieces.append(" ")
                continue
            if names.get("head") and name not in OF_HEAD:
                flush()
                close(max(i for i, n in enumerate(stack) if self.tag[n] == "head"))
            if name in RAW:
                if not given.endswith("/"):
                    skip_to = name
                continue
            flush()
            anchors = 0
            ended = CLOSES.get(name)
            if name not in VOID and names.get("p") and name not in ("html", "body", "head"):
                ended = (ended or set()) | {"p"}
            if ended:
                # up to the nearest such element, but not out of a table or list that this one is in
                for n in range(len(stack) - 1, max(0, len(stack) - 6), -1):
                    t = self.tag[stack[n]]
                    if t in ended:
                        close(n)
                        break
                    if t in ("ul", "ol", "table", "dl") or (t in ("div", "article", "section", "main", "blockquote") and name != "body"):
                        break
            if name in ("html", "body") and names.get(name):
                continue
            node = len(self.tag)
            self.tag.append(name)
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            self.attrs.append(given)
            self.begin.append(begin)
            self.inputs.append(1 if name in ("input", "button", "select", "option") else 0)
            if name not in VOID and not given.endswith("/"):
                stack.append(node)
                names[name] = names.get(name, 0) + 1
                muted += name in SKIPPED
        if skip_to is None and at < len(source):
            # no tag ends behind the last ">": what opens there is markup
            cut = _OPENING.search(source, max(at, last + 1))
            pieces.append(source[at : cut.start() if cut else len(source)])
        flush()


@functools.lru_cache(maxsize=1 << 15)
def attribute_cues(given: str) -> tuple[tuple[int, ...], tuple[int, ...], bool]:
    """Cue counts of an attribute string, the hashed column of each of its tokens, and whether it hides the element."""
    cues = [0] * len(CUES)
    hidden, hashed = False, set()
    for name, a, b, c in _ATTRIBUTE.findall(given):
        name, value = name.lower(), a or b or c
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            hidden = True
        if name in ("class", "id", "role", "itemprop"):
            for token in _TOKEN.findall(value):
                token = token.lower()
                if token in _CUE_OF:
                    cues[_CUE_OF[token]] += 1
                hashed.add(zlib.crc32(token.encode()) % BUCKETS)
    return tuple(cues), tuple(sorted(hashed)), hidden


class Features:
    """Features of a page's nodes, held by column; ``rows`` makes them into a matrix of COLUMNS columns."""

    def __init__(self, page: Page):
        n = self.n = len(page.tag)
        parent = np.array(page.parent)
        text, link, runs, marks, own, words, usual = (np.zeros(n) for _ in range(7))
        for node, run, linked in page.runs:
            text[node] += len(run)
            own[node] += len(run)
            link[node] += linked
            runs[node] += 1
            words[node] += run.count(" ") + 1
            marks[node] += run.count(".") + run.count(",")
            usual[node] += sum(w.strip(".,:;!?|()").lower() in PHRASES for w in run.split(" ", 60)[:60])
        nodes, phrases, inputs = np.ones(n), np.array([t in _PHRASE for t in page.tag], float), np.array(page.inputs, float)
        for i in range(n - 1, 0, -1):
            p = parent[i]
            text[p] += text[i]
            link[p] += link[i]
            runs[p] += runs[i]
            marks[p] += marks[i]
            usual[p] += usual[i]
            words[p] += words[i]
            nodes[p] += nodes[i]
            phrases[p] += phrases[i]
            inputs[p] += inputs[i]
        children = np.bincount(parent[1:], minlength=n) if n > 1 else np.zeros(n)
        place, seen = np.zeros(n), np.zeros(n)
        alike: dict[tuple[int, str], int] = {}
        for i in range(1, n):
            place[i] = seen[parent[i]]
            seen[parent[i]] += 1
            key = (page.parent[i], page.tag[i])
            alike[key] = alike.get(key, 0) + 1
        self.tags = np.array([_TAG_AT.get(t, len(TAGS)) for t in page.tag])
        self.cues = np.zeros((n, len(CUES)), np.int16)
        self.above = np.zeros((n, len(CUES)), np.int16)
        self.hashed: dict[int, tuple[int, ...]] = {}
        hidden = np.zeros(n)
        for i, given in enumerate(page.attrs):
            if given:
                self.cues[i], hashed, hidden[i] = attribute_cues(given.strip())
                if hashed:
                    self.hashed[i] = hashed
            if i:
                self.above[i] = np.minimum(self.above[parent[i]] + self.cues[parent[i]], 1 << 14)
        up = np.maximum(parent, 0)
        siblings = np.where(parent >= 0, children[up], 1)
        same = np.array([1, *[alike[(page.parent[i], page.tag[i])] for i in range(1, n)]])
        total = max(1.0, text[0])
        mean_sibling = text[up] / np.maximum(1, siblings)
        path = {t: np.zeros(n, bool) for t in ("article", "main", "nav", "aside", "footer", "form", "header")}
        for t, flag in path.items():
            for i in range(1, n):
                flag[i] = flag[page.parent[i]] or page.tag[page.parent[i]] == t
        self.columns = [
            c.astype(np.float32)
            for c in (
                np.log1p(text), np.log1p(own), link / np.maximum(1, text), text / nodes, marks / np.maximum(1, words), words / np.maximum(1, runs),
                np.log1p(phrases), inputs / nodes, np.array(page.depth, float), children, place, place / np.maximum(1, siblings), same / np.maximum(1, siblings),
                text / np.maximum(1, text[up]), text / total, hidden, usual / np.maximum(1, words), np.minimum(9, text / np.maximum(1, mean_sibling)), *path.values(),
            )
        ]

    def rows(self, a: int, b: int) -> np.ndarray:
        """The feature rows of nodes a to b."""
        out = np.zeros((b - a, COLUMNS), np.float32)
        out[np.arange(b - a), self.tags[a:b]] = 1
        base = len(TAGS) + 1
        out[:, base : base + len(CUES)] = self.cues[a:b]
        out[:, base + len(CUES) : base + 2 * len(CUES)] = np.minimum(self.above[a:b], 2)
        base += 2 * len(CUES)
        for i in range(a, b):
            for h in self.hashed.get(i, ()):
                out[i - a, base + h] = 1
        for j, c in enumerate(self.columns):
            out[:, base + BUCKETS + j] = c[a:b]
        return out


def node_features(page: Page) -> np.ndarray:
    """A row of COLUMNS features for each node."""
    found = Features(page)
    return found.rows(0, found.n)


# boosted trees -----------------------------------------------------------------------------------


class Boosted:
    """Gradient-boosted regression trees of the logistic loss, on features cut into bins."""

    def __init__(self, rounds: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 24, ridge: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.ridge = rounds, depth, rate, bins, ridge
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
        width = self.bins + 1
        cell = binned + np.arange(x.shape[1]) * width
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        raw = np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, p * (1 - p)
            size = 2 ** (self.depth + 1) - 1
            feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
            node = np.zeros(len(y), np.int64)
            for at in range(size):
                rows = np.flatnonzero(node == at)
                gs, hs = g[rows].sum(), h[rows].sum()
                value[at] = -self.rate * gs / (hs + self.ridge)
                if at >= 2**self.depth - 1 or len(rows) < 8:
                    continue
                cells = cell[rows].ravel()
                reps = x.shape[1]
                gh = np.bincount(cells, weights=np.repeat(g[rows], reps), minlength=reps * width).reshape(reps, width).cumsum(axis=1)
                hh = np.bincount(cells, weights=np.repeat(h[rows], reps), minlength=reps * width).reshape(reps, width).cumsum(axis=1)
                gain = gh**2 / (hh + self.ridge) + (gs - gh) ** 2 / (hs - hh + self.ridge) - gs**2 / (hs + self.ridge)
                gain[(hh < 0.5) | (hs - hh < 0.5)] = -1
                j, b = np.unravel_index(np.argmax(gain), gain.shape)
                if gain[j, b] <= 1e-3 or b >= len(edges[j]):
                    continue
                feature[at], cut[at] = j, edges[j][b]
                left = binned[rows, j] <= b
                node[rows[left]], node[rows[~left]] = 2 * at + 1, 2 * at + 2
            self.trees.append((feature, cut, value))
            raw += value[node]
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[node]
                inner = f >= 0
                node = np.where(inner, 2 * node + 1 + (x[rows, np.maximum(f, 0)] > cut[node]), node)
            total += value[node]
        return total


def decode(parent: list[int], raw: np.ndarray, keep_root: bool = True) -> np.ndarray:
    """The likeliest labels in which a kept node's parent is kept. ``raw``: log-odds of keeping."""
    n = len(parent)
    kept, dropped = -np.logaddexp(0, -raw), -np.logaddexp(0, raw)
    below = np.zeros(n)  # of the children, each as its best choice
    none = np.zeros(n)  # of the subtree, all dropped
    best = np.zeros(n, bool)
    for i in range(n - 1, -1, -1):
        none[i] += dropped[i]
        take = kept[i] + below[i]
        best[i] = take >= none[i] or (keep_root and i == 0)
        if i:
            below[parent[i]] += max(take, none[i])
            none[parent[i]] += none[i]
    for i in range(1, n):
        best[i] &= best[parent[i]]
    return best


# training pages ----------------------------------------------------------------------------------


class Generator:
    """Pages of random layout and wording whose every block is known to be of the article or not."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, a: int, b: int) -> str:
        r = self.r
        out = []
        for _ in range(r.randint(a, b)):
            w = "".join(r.choice("aeioubcdfghklmnprstvw") for _ in range(r.randint(1, 9)))
            out.append(w + (r.choice(".,.,;!") if r.random() < 0.16 else ""))
        return " ".join(out)

    def attr(self, *cues: str, sure: float = 0.8) -> str:
        r = self.r
        if r.random() > sure:
            return "" if r.random() < 0.5 else f' class="c{r.randint(1, 99)}"'
        token = r.choice(CUES[r.choice(cues)])
        if r.random() < 0.4:
            token += r.choice("-_") + r.choice(["box", "block", "area", "inner", "wrap", "list", "item", "1", "2"])
        if r.random() < 0.25:  # beside a generated name
            token = " ".join(r.sample([token, self.made_up()], 2))
        return f' {r.choice(["class", "class", "id"])}="{token}"'

    def made_up(self) -> str:
        """A class as build tools make them."""
        r = self.r
        return r.choice(["css", "sc", "jss", "x", "c"]) + r.choice(["-", "_", ""]) + "".join(r.choice("abcdefgh0123456789") for _ in range(r.randint(1, 6)))

    def plain(self) -> str:
        """No attribute, or one that says nothing."""
        r = self.r
        return "" if r.random() < 0.5 else f' {r.choice(["class", "id"])}="{r.choice([self.made_up(), "col" + str(r.randint(1, 4)), "inner", "row", "wrapper", "container"])}"'

    def nested(self, inner: str) -> str:
        """Within plain elements, seldom many."""
        r = self.r
        for _ in range(r.choice([1, 1, 2, 3]) if r.random() < 0.98 else r.randint(10, 60)):
            tag = r.choice(["div", "div", "div", "section", "center"])
            inner = f"<{tag}{self.plain()}>{inner}</{tag}>"
        return inner

    def links(self, a: int, b: int) -> str:
        r = self.r
        items = [f'<a href="/{r.randint(1, 999)}">{self.words(1, 4)}</a>' for _ in range(r.randint(a, b))]
        if r.random() < 0.7:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        return r.choice([" ", " | ", ""]).join(items)

    def para(self) -> str:
        r = self.r
        text = self.words(*r.choice([(1, 6), (8, 40), (20, 120)]))
        if r.random() < 0.3:
            parts = text.split(" ")
            i = r.randrange(len(parts))
            parts[i] = r.choice(["<b>{}</b>", "<em>{}</em>", '<a href="#">{}</a>', "{}<br>", "<span>{}</span>"]).format(parts[i])
            text = " ".join(parts)
        if r.random() < 0.1:
            return f"<p><b>{text}<br>"
        return f"<p>{text}</p>" if r.random() < 0.9 else f"<p>{text}"

    def body(self) -> str:
        r = self.r
        out = [f"<h1>{self.words(2, 12)}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 1, 2, 3, 5, 9])):
            k = r.random()
            if k < 0.12:
                out.append(self.nested(self.para() + (self.para() if r.random() < 0.5 else "")))
            elif k < 0.76:
                out.append(self.para())
            elif k < 0.82:
                out.append(f"<h2>{self.words(1, 7)}</h2>{self.para()}")
            elif k < 0.88:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 20)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.92:
                out.append(f"<blockquote>{self.para()}</blockquote>")
            elif k < 0.95:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.98:
                out.append(f'<figure><img src="x.png"><figcaption>{self.words(3, 12)}</figcaption></figure>')
            else:
                out.append(f"<pre>{self.words(3, 20)}</pre>")
        return "".join(out)

    def usual(self, text: str, sure: float = 0.6) -> str:
        """With a usual phrase of such blocks, in most of them."""
        r = self.r
        parts = text.split(" ")
        if r.random() < sure:
            parts[r.randrange(len(parts))] += " " + " ".join(r.sample(sorted(PHRASES), r.randint(1, 2)))
        return " ".join(parts)

    def junk(self, kind: str) -> str:
        r = self.r
        if kind == "nav":
            return f"<nav{self.attr('nav', sure=0.4)}>{self.links(3, 9)}</nav>" if r.random() < 0.7 else f"<div{self.attr('nav', sure=0.95)}>{self.links(2, 9)}</div>"
        if kind == "header":
            inner = f"<h1>{self.words(1, 3)}</h1><p>{self.words(2, 9)}</p>" if r.random() < 0.6 else f'<a href="/">{self.words(1, 3)}</a>{self.links(2, 6)}'
            return f"<header{self.attr('head', sure=0.5)}>{inner}</header>" if r.random() < 0.7 else f"<div{self.attr('head', sure=0.95)}>{inner}</div>"
        if kind == "footer":
            inner = r.choice(["&copy; 2024 " + self.words(1, 20), f"<p>{self.usual(self.words(3, 30))}</p>", self.usual(self.words(3, 15)), self.links(2, 6), f"&copy; {self.words(1, 2)} &middot; {self.words(2, 40)}"])
            return f"<footer{self.attr('foot', sure=0.4)}>{inner}</footer>" if r.random() < 0.75 else f"<div{self.attr('foot', sure=0.85)}>{inner}</div>"
        if kind == "ad":
            return f"<{(t := r.choice(['div', 'div', 'section', 'aside']))}{self.attr('ad', sure=0.97)}>{r.choice([self.words(2, 40), self.para(), self.para() + self.links(1, 3)])}</{t}>"
        if kind == "side":
            inner = f"<h3>{self.words(1, 3)}</h3>{r.choice([self.links(3, 8), self.para(), self.para() + self.para()])}"
            return f"<aside{self.attr('side', sure=0.5)}>{inner}</aside>" if r.random() < 0.6 else f"<div{self.attr('side', sure=0.97)}>{inner}</div>"
        if kind == "comment":
            items = "".join(f"<{(t := r.choice(['div', 'li', 'article', 'p']))}{self.attr('comment', sure=0.6)}>{r.choice([self.words(3, 60), self.para(), self.para() + self.para()])}</{t}>" for _ in range(r.randint(1, 5)))
            return f"<{(t := r.choice(['section', 'div', 'div', 'ol']))}{self.attr('comment', sure=0.98)}>{r.choice(['', f'<h2>{self.words(1, 3)}</h2>'])}{items}</{t}>"
        if kind == "form":
            inner = f"<label>{self.words(1, 4)}</label><input name=q><button>{self.words(1, 2)}</button>"
            return f"<form{self.attr('form', sure=0.4)}>{r.choice(['', f'<p>{self.words(4, 25)}</p>'])}{inner}</form>"
        return f"<{(t := r.choice(['div', 'div', 'section', 'p']))}{self.attr('notice', sure=0.85)}>{r.choice([self.usual(self.words(4, 40)), f'<p>{self.usual(self.words(4, 30))}</p>'])}{r.choice(['', f'<button>{self.words(1, 2)}</button>'])}</{t}>"

    def page(self) -> tuple[str, list[tuple[int, int]]]:
        """A page and the spans of its source that are article."""
        r = self.r
        out, spans, size = [], [], 0

        def put(s: str, ours: bool = False) -> None:
            nonlocal size
            if ours:
                spans.append((size, size + len(s)))
            out.append(s)
            size += len(s)

        if r.random() < 0.08:  # a fragment
            put(r.choice([self.body, lambda: self.nested(self.body()), lambda: self.nested(self.words(1, 30))])(), True)
            return "".join(out), spans
        put(f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(2, 8)}</title><style>p{{margin:0}}</style><script>var a="</p>";</script></head><body>')
        wrap = r.random() < 0.35
        kinds = ["nav", "header", "ad", "notice", "form", "side"]
        if wrap:
            put(f"<div{self.attr('content', 'head', sure=0.3)}>")
        for k in r.sample(kinds, r.randint(0, 4)):
            put(self.junk(k))
        outer = r.random() < 0.3
        if outer:
            put(f"<main{self.attr('content', sure=0.3)}>")
        around = []
        if r.random() < 0.3:  # plain elements around the article alone
            around = [r.choice(["div", "div", "section", "center"]) for _ in range(r.randint(1, 4) if r.random() < 0.95 else r.randint(8, 30))]
        table = r.random() < 0.06
        if table:
            put(f"<table><tr><td>{self.links(2, 7)}</td>")
        for t in around:
            put(f"<{t}{self.plain()}>")
        tag = "td" if table else r.choice(["article", "article", "article", "main", "div", "div", "section"])
        put(f"<{tag}{self.plain() if r.random() < 0.2 else self.attr('content', sure=0.4 if tag in ('article', 'main') else 0.85)}>" if tag != "td" or not around else "<div>")
        if r.random() < 0.1:
            put(self.junk(r.choice(["nav", "form"])))
        for _ in range(r.choice([1, 1, 1, 2, 3])):
            put(self.body(), True)
            if r.random() < 0.25:
                put(self.junk(r.choice(["ad", "side", "form", "notice"])))
        put(f"</{tag}>" if tag != "td" or not around else "</div>")
        for t in reversed(around):
            put(f"</{t}>")
        if table:
            put("</tr></table>")
        if r.random() < 0.3:
            put(self.junk("comment"))
        if outer:
            put("</main>")
        for k in r.sample(["side", "ad", "comment", "form", "nav", "notice"], r.randint(0, 3)):
            put(self.junk(k))
        if r.random() < 0.85:
            put(self.junk("footer"))
        if wrap:
            put("</div>")
        put("" if r.random() < 0.1 else "</body></html>")
        return "".join(out), spans


def labels_of(page: Page, spans: list[tuple[int, int]]) -> np.ndarray:
    """Nodes that start in the article, and their ancestors."""
    n = len(page.tag)
    y = np.array([any(a <= b < z for a, z in spans) for b in page.begin])
    for i in range(n - 1, 0, -1):
        if y[i]:
            y[page.parent[i]] = True
    y[0] = True
    return y


@functools.lru_cache(maxsize=1)
def trained(pages: int = 800, seed: int = 3) -> Boosted:
    """The model, trained once a process on generated pages."""
    make = Generator(seed)
    xs, ys = [], []
    for _ in range(pages):
        source, spans = make.page()
        page = Page(source)
        xs.append(node_features(page))
        ys.append(labels_of(page, spans))
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def texts_of(sources: list[str | None], model: Boosted) -> list[str]:
    """Main texts of pages; the trees run over the nodes of many pages at once, ROWS at most."""
    pages = [Page(s) if s else None for s in sources]
    raws: list[list[np.ndarray]] = [[] for _ in pages]
    held: list[tuple[int, np.ndarray]] = []

    def judged() -> None:
        if held:
            raw, at = model.raw(np.concatenate([x for _, x in held])), 0
            for i, x in held:
                raws[i].append(raw[at : at + len(x)])
                at += len(x)
            held.clear()

    size = 0
    for i, page in enumerate(pages):
        if page is None or not page.runs:
            continue
        found = Features(page)
        for a in range(0, found.n, ROWS):
            x = found.rows(a, min(found.n, a + ROWS))
            if size + len(x) > ROWS:
                judged()
                size = 0
            held.append((i, x))
            size += len(x)
    judged()
    out = []
    for page, raw in zip(pages, raws, strict=True):
        if not raw:
            out.append("")
            continue
        best = decode(page.parent, np.concatenate(raw))
        out.append(" ".join(text for node, text, _ in page.runs if best[node]))
    return out


def extract(df: DataFrame, source: str = "html", keep: tuple[str, ...] = ("page_id", "url"), model: Boosted | None = None) -> DataFrame:
    """``keep`` and text, the main text of each page."""
    kept = list(keep)
    model = model or trained()
    read = free_name(df, "html_")
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, read, 1 << 20):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(texts_of(batch.column(read).to_pylist(), model), pa.string())], names=schema.names)

    return df.select(*kept, df[source].alias(read)).mapInArrow(run, schema)
