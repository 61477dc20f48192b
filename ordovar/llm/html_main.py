"""Main-text extraction: gradient-boosted trees over features of a page's blocks, decoded along the tree.

A tolerant parser makes the tree of block elements; inline elements only lend their text. Every block gets features: its tag, tokens
of class, id and role of itself and of its ancestors, depth, text and link density of its subtree, its share of parent and page, and
its siblings. Boosted trees give each block the log-odds of being main text. Decoding keeps a block only with its ancestors: the best
set closed under parents is found bottom up, weighing blocks by their text, so no kept block lies in a dropped one.

No table holds labels for pages, so the trees are trained on pages that a generator with a fixed seed makes, of many layouts, with
known main text. Scripts, styles, form controls and other elements without prose never give text.

Null and empty pages have the empty text, as have pages without main text. Repeated rows are extracted each. Text is never cut.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# -- parsing

#: A start tag whose attributes may hold > in quotes, and one up to the next >.
_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN = re.compile(r"<([a-zA-Z][^\s/>]*+)([^>]*+)>")
_END = re.compile(r"</([a-zA-Z][^\s/>]*+)[^>]*+>")
_COMMENT_END = re.compile(r"--!?>")
_ATTR = re.compile(r"""(?<![^\s"'/])(class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is no markup: up to their end tag, or the page's end.
RAW = frozenset("script style textarea title iframe noframes xmp noembed".split())
SILENT = frozenset("head noscript template svg math object canvas select button option optgroup datalist audio video map".split())
#: Elements that may be closed by their own start tag, and such as hold no blocks, so that a block's start tag ends them.
SELF_CLOSED = frozenset("svg math".split())
NO_BLOCKS = frozenset("select option optgroup datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr label legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - frozenset("html body label legend caption td th tr tbody thead tfoot".split())
#: A start tag that ends an open element of these names, up to the holder.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"})}

TAGS = "p h1 h2 h3 li ul ol div section article main nav header footer aside form table td blockquote pre figure body".split()
#: Fixed words of class, id and role values, by what they speak of.
WORDS = {
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs toolbar skip links",
    "head": "header masthead topbar logo brand branding top",
    "foot": "footer copyright colophon legal bottom imprint",
    "side": "sidebar aside rail widget widgets related recommended recommendations trending popular teaser complementary secondary",
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner adbox",
    "note": "cookie cookies consent notice gdpr alert popup modal overlay announcement disclaimer privacy warning dialog",
    "form": "form login search subscribe newsletter signup register contact",
    "reply": "comment comments commentlist disqus reply replies respond response responses discussion review reviews thread reader feedback",
    "share": "share sharing social follow twitter facebook",
    "good": "article content main post entry story body text page blog articlebody",
}
GROUP = {w: k for k, (_, ws) in enumerate(WORDS.items()) for w in ws.split()}
GROUPS = len(WORDS)
TAG_NO = {t: i for i, t in enumerate(TAGS)}


@dataclass(slots=True)
class Block:
    tag: str
    parent: Block | None
    depth: int
    groups: int
    children: list[Block] = field(default_factory=list)
    runs: list[int] = field(default_factory=list)
    own: int = 0  # characters of its own runs, without white space at the ends
    own_link: int = 0
    words: int = 0
    marks: int = 0
    tags: int = 0
    place: int = 0


def _groups(tag: str, attrs: str) -> int:
    bits = 0
    if attrs:
        for m in _ATTR.finditer(attrs):
            for w in _SPLIT.split((m[2] or m[3] or m[4] or "")):
                g = GROUP.get(w.lower())
                if g is not None:
                    bits |= 1 << g
            if m[1].lower() in ("class", "id") and bits == 0:
                for w in re.split(r"[^a-z]+", (m[2] or m[3] or m[4] or "").lower()):
                    if w in GROUP:
                        bits |= 1 << GROUP[w]
    return bits


def parse(page: str) -> tuple[list[Block], list[tuple[Block, str]]]:
    """(blocks in page order, the first of them the root; text runs with their blocks, in page order, white space made single)."""
    root = Block("body", None, 0, 0)
    blocks, runs = [root], []
    stack: list[tuple[str, Block]] = [("html", root)]  # open elements with the block that they are or lie in
    open_: dict[str, int] = {}  # how many elements of a name are open
    inside: list[int] = []  # places of open blocks in the stack
    buffer: list[str] = []
    silent, links, linked = 0, 0, 0
    lower, at, n, plain = "", 0, len(page), False

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join("".join(buffer).split())
            buffer.clear()
            if text:
                b = stack[-1][1]
                b.runs.append(len(runs))
                b.own += len(text)
                b.own_link += min(linked, len(text))
                b.words += text.count(" ") + 1
                b.marks += text.count(".") + text.count(",") + text.count("!") + text.count("?") + text.count(";")
                runs.append((b, text))
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not silent:
            if "&" in piece:
                piece = html.unescape(piece)
            buffer.append(piece)
            if links:
                linked += len(piece)

    def push(tag: str, block: Block) -> None:
        nonlocal silent, links
        open_[tag] = open_.get(tag, 0) + 1
        if tag in BLOCK:
            inside.append(len(stack))
        stack.append((tag, block))
        silent += tag in SILENT
        links += tag == "a"

    def pop_to(k: int) -> None:
        nonlocal silent, links
        if inside and inside[-1] >= k:
            flush()
        for t, _ in stack[k:]:
            silent -= t in SILENT
            links -= t == "a"
            open_[t] -= 1
        del stack[k:]
        while inside and inside[-1] >= k:
            inside.pop()

    def end_of(tag: str) -> None:
        if open_.get(tag):
            k = len(stack) - 1
            while stack[k][0] != tag:
                k -= 1
            pop_to(k)
        elif tag in BLOCK or tag == "br":
            flush()

    def start_of(tag: str, attrs: str) -> None:
        if tag == "br":
            buffer.append(" ")
        elif tag in BLOCK:
            while any(open_.get(t) for t in NO_BLOCKS) and stack[-1][0] in NO_BLOCKS:
                pop_to(len(stack) - 1)
            flush()
            if tag in ("html", "body"):
                root.groups |= _groups(tag, attrs)
                return
            if tag in CLOSES_P and inside and stack[inside[-1]][0] == "p":
                pop_to(inside[-1])
            if tag in ENDS:
                mine, holders = ENDS[tag]
                if any(open_.get(t) for t in mine):
                    for k in reversed(inside):
                        if stack[k][0] in mine:
                            pop_to(k)
                            break
                        if stack[k][0] in holders:
                            break
            if tag == "hr":
                return
            up = stack[-1][1]
            b = Block(tag, up, up.depth + 1, _groups(tag, attrs))
            b.place = len(up.children)
            up.children.append(b)
            blocks.append(b)
            push(tag, b)
        elif tag not in VOID and not (tag in SELF_CLOSED and attrs.endswith("/")):
            stack[-1][1].tags += 1
            push(tag, stack[-1][1])

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(page[at:])
            break
        add(page[at:lt])
        kind = page[lt + 1 : lt + 2]
        if kind in ("!", "?") or (kind == "/" and not _END.match(page, lt)):
            if page.startswith("<!--", lt):
                m = _COMMENT_END.search(page, lt + 2)
                at = m.end() if m else n
            else:
                at = page.find(">", lt) + 1 or n
            continue
        if kind == "/":
            m = _END.match(page, lt)
            at = m.end()
            end_of(m[1].lower())
            continue
        if not (kind.isascii() and kind.isalpha()):
            add("<")
            at = lt + 1
            continue
        m = None if plain else _TAG.match(page, lt)
        if m is None:  # a quote that nothing closes: from here on, quotes hide no >
            plain = True
            m = _PLAIN.match(page, lt)
        if m is None:  # no > ahead: no tag either
            add(page[lt:])
            break
        at = m.end()
        tag, attrs = m[1].lower(), m[2].rstrip()
        if tag in RAW:
            if not lower:
                lower = page.lower() if len(page.lower()) == n else "".join(c.lower() if c.isascii() else c for c in page)
            end = lower.find(f"</{tag}", at)
            close = page.find(">", end) if end >= 0 else -1
            at = n if close < 0 else close + 1
            continue
        start_of(tag, attrs)
    while len(stack) > 1:
        pop_to(len(stack) - 1)
    flush()
    return blocks, runs


# -- features

N_FEATURES = 20 + len(TAGS) + 2 * GROUPS + 6


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    number = {id(b): i for i, b in enumerate(blocks)}
    total = np.array([(b.own, b.own_link, b.words, b.marks, b.tags, 1, len(b.runs)) for b in blocks], float)
    for i in range(n - 1, 0, -1):
        total[number[id(blocks[i].parent)]] += total[i]
    page = max(1.0, total[0, 0])
    out = np.zeros((n, N_FEATURES), np.float32)
    before = 0
    above = [0] * n
    tags_above = [0] * n
    for i, b in enumerate(blocks):
        text, link, words, marks, tags, inner, runs = total[i]
        up = number[id(b.parent)] if b.parent else 0
        if b.parent:
            above[i] = above[up] | blocks[up].groups
            tags_above[i] = tags_above[up] | (1 << TAG_NO[blocks[up].tag] if blocks[up].tag in TAG_NO else 0)
        sib = b.parent.children if b.parent else [b]
        prev = total[number[id(sib[b.place - 1])], 0] if b.place > 0 else 0.0
        nxt = total[number[id(sib[b.place + 1])], 0] if b.place + 1 < len(sib) else 0.0
        same = sum(s.tag == b.tag for s in sib[max(0, b.place - 8) : b.place + 9])
        row = out[i]
        row[:20] = (
            b.depth, np.log1p(text), link / max(1.0, text), words / max(1.0, runs), marks / max(1.0, words), tags / max(1.0, words), inner, np.log1p(b.own), b.own_link / max(1, b.own), text / page,
            text / max(1.0, total[up, 0]), before / page, b.place, len(sib), same, np.log1p(prev), np.log1p(nxt), len(b.children), text / max(1.0, inner), np.log1p(page),
        )
        if b.tag in TAG_NO:
            row[20 + TAG_NO[b.tag]] = 1
        base = 20 + len(TAGS)
        for g in range(GROUPS):
            row[base + g] = b.groups >> g & 1
            row[base + GROUPS + g] = above[i] >> g & 1
        for j, t in enumerate(("nav", "header", "footer", "aside", "form", "article")):
            row[base + 2 * GROUPS + j] = tags_above[i] >> TAG_NO[t] & 1
        before += b.own
    return out


# -- boosted trees


@dataclass
class Trees:
    """Complete binary trees of one depth: of node k, the children are 2k + 1 and 2k + 2."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    depth: int

    def logodds(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            k = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                k = 2 * k + 1 + (x[rows, f[k]] > c[k])
            out += leaf[k - len(f)]
        return out


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.25, bins: int = 24) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) + np.arange(x.shape[1]) * bins  # > cut k: bin over k
    usable = np.zeros((x.shape[1], bins - 1), bool)
    for j, c in enumerate(cuts):
        usable[j, : len(c)] = True
    score = np.zeros(len(y))
    inner, leaves = 2**depth - 1, 2**depth
    fs, cs, ls = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        f, c = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            if not len(mine):
                continue
            cells = binned[mine].ravel()
            gl, hl = (np.cumsum(np.bincount(cells, np.repeat(v[mine], x.shape[1]), x.shape[1] * bins).reshape(-1, bins), 1) for v in (g, h))
            gt, ht = gl[0, -1], hl[0, -1]
            gl, hl = gl[:, :-1], hl[:, :-1]
            gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
            gain[(hl < 1) | (ht - hl < 1) | ~usable] = 0
            best = int(gain.argmax())
            if gain.flat[best] > 1e-3:
                f[k], i = divmod(best, bins - 1)
                c[k] = cuts[f[k]][i]
            node[mine] = 2 * k + 1 + (x[mine, f[k]] > c[k])
        at = node - inner
        leaf = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + 1)
        score += leaf[at]
        fs.append(f)
        cs.append(c)
        ls.append(leaf)
    return Trees(np.array(fs), np.array(cs), np.array(ls), depth)


# -- training pages


def made_page(rng: np.random.Generator) -> str:
    """A page of random layout. Words of the main text, and only they, start with x."""
    pick = lambda *a: a[rng.integers(len(a))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(rng.choice(list("aeinrst"), rng.integers(1, 9)))

    def prose(n: int, main: bool) -> str:
        out = []
        for i in range(n):
            w = ("x" if main else "") + word()
            out.append(w + (pick(".", ",", ".") if chance(0.12) or i == n - 1 else ""))
            if chance(0.02):
                out[-1] = f"<{(t := pick('b', 'i', 'a', 'span', 'em'))}>{out[-1]}</{t}>"
        return " ".join(out)

    def item(tag: str, text: str) -> str:
        return f"<{tag}>{text}" + ("" if chance(0.15) and tag in ("p", "li") else f"</{tag}>")

    def box(names: tuple[str, ...], tags: tuple[str, ...], inner: str, plain: float = 0.05) -> str:
        tag = pick(*tags)
        said = f' {pick("class", "class", "id")}="{pick("", "c-", "site ")}{pick(*names)}{pick("", "", "-box", " x1", "-inner")}"'
        return f"<{tag}{'' if chance(plain) or (tag not in ('div', 'section', 'ul', 'p') and chance(0.6)) else said}>{inner}</{tag}>"

    links = lambda n: "<ul>" + "".join(item("li", f'<a href="/{word()}">{prose(int(rng.integers(1, 4)), False)}</a>') for _ in range(n)) + "</ul>"
    some = lambda lo, hi: prose(int(rng.integers(lo, hi)), False)
    para = lambda: item("p", some(4, 60))

    def menu() -> str:
        return box(("nav", "menu", "navbar", "navigation", "breadcrumbs"), ("nav", "nav", "div", "ul"), links(int(rng.integers(2, 9))))

    def ad() -> str:
        return box(("ad", "ads", "advert", "promo", "sponsored", "banner", "advertisement"), ("div", "div", "section", "aside", "p"), pick(some(3, 30), para(), links(2)), 0)

    def head() -> str:
        return box(("header", "masthead", "topbar"), ("header", "header", "div"), pick(f"<h1>{some(1, 5)}</h1>", f"<div>{some(1, 8)}</div>", some(1, 12)) + (links(4) if chance(0.4) else ""))

    def foot() -> str:
        return box(("footer", "copyright", "colophon", "legal"), ("footer", "footer", "div"), pick("&copy; ", "") + pick(some(3, 30), para() + links(3), para()))

    def note() -> str:
        return box(("cookie", "consent", "notice", "gdpr", "popup", "alert", "cookie-notice"), ("div", "section", "aside", "p", "dialog"), pick(some(5, 40), para(), para() + "<button>ok</button>"), 0)

    def side() -> str:
        return box(("sidebar", "widget", "related", "rail", "popular"), ("aside", "aside", "div", "section"), pick(links(5), f"<h3>{some(1, 3)}</h3>" + links(4), para() + para(), f"<h2>{some(1, 3)}</h2>" + para()))

    def form() -> str:
        return f'<form action="/x"{pick("", " class=newsletter", " id=search")}>' + pick(f"<label>{some(1, 5)}</label><input>", f"<p>{some(3, 15)}</p><input><button>go</button>", f"{some(2, 8)}<select><option>a</option></select>") + "</form>"

    def replies() -> str:
        one = lambda: pick(f'<div class="comment"><b>{word()}</b>{para()}</div>', f"<li>{para()}</li>", f"<article>{para()}</article>", para(), f'<div class="reply">{some(3, 50)}</div>')
        return box(("comments", "commentlist", "discussion", "responses", "reader-comments", "replies", "disqus"), ("section", "div", "div", "aside"), (f"<h2>{some(1, 3)}</h2>" if chance(0.5) else "") + "".join(one() for _ in range(rng.integers(1, 7))), 0)

    def share() -> str:
        return box(("share", "social", "follow"), ("div", "ul", "p"), pick(links(3), some(1, 6)), 0)

    body = []
    short = chance(0.25)
    for _ in range(1 if short else rng.integers(1, 12)):
        n = int(rng.integers(1, pick(10, 70))) if short else int(rng.integers(1, 10)) if chance(0.3) else int(rng.integers(8, 120))
        kind = pick(*(("p",) * 6), "h2", "h3", "blockquote", "quote", "ul", "ol", "pre", "div", "br", "table", "figure", "dl", "address") if chance(0.45) else "p"
        text = prose(n, True)
        cell = lambda tag, lo=1, hi=9: f"<{tag}>{prose(int(rng.integers(lo, hi)), True)}</{tag}>"
        if kind == "table":
            wide = int(rng.integers(2, 5))
            caption = cell("caption") if chance(0.3) else ""
            topmost = f"<thead><tr>{''.join(cell('th', 1, 4) for _ in range(wide))}</tr></thead>" if chance(0.5) else ""
            lines = "".join(f"<tr>{''.join(cell('th' if i == 0 and chance(0.2) else 'td', 1, 6) for i in range(wide))}</tr>" for _ in range(rng.integers(2, 9)))
            body.append(f"<table{pick('', ' class=data', ' class=wikitable')}>{caption}{topmost}{f'<tbody>{lines}</tbody>' if chance(0.6) else lines}</table>")
        elif kind == "figure":
            body.append(f"<figure{pick('', ' class=image')}>{pick('<img src=a.png>', '<pre>' + prose(6, True) + '</pre>')}{cell('figcaption', 2, 30)}</figure>")
        elif kind == "dl":
            body.append("<dl>" + "".join(cell("dt", 1, 4) + cell("dd", 2, 30) for _ in range(rng.integers(1, 6))) + "</dl>")
        elif kind == "quote":
            body.append("<blockquote>" + "".join(item("p", prose(int(rng.integers(4, 50)), True)) for _ in range(rng.integers(1, 3))) + (cell(pick("cite", "p"), 1, 5) if chance(0.25) else "") + "</blockquote>")
        elif kind == "ol":
            body.append("<ol>" + "".join(item("li", prose(int(rng.integers(2, 30)), True)) for _ in range(rng.integers(2, 7))) + "</ol>")
        elif kind == "ul":
            body.append("<ul>" + "".join(item("li", prose(int(rng.integers(1, 15)), True)) for _ in range(rng.integers(2, 6))) + "</ul>")
        elif kind == "br":
            body.append(f"{text}<br>{prose(5, True)}<br>")
        elif kind == "p" and chance(0.2):
            body.append(f"<p><b>{text}<br>")
        else:
            body.append(item(kind, text))
        if chance(0.12):
            body.append(pick(ad, ad, ad, share, side, form, note)())
    title = f"<h1>{prose(int(rng.integers(2, 12)), True)}</h1>"
    inner = (title if chance(0.3 if short else 0.8) else "") + "".join(body)
    if chance(0.15):
        inner = f"<div>{inner}</div>"
    tail = (replies() if chance(0.15) else "") + (share() if chance(0.1) else "")
    tag = pick("article", "article", "article", "main", "div", "div", "section", "div")
    names = ("content", "post", "entry-content", "article-body", "story", "main", "text", "post-body")
    main = f"<{tag}{'' if tag in ('article', 'main') and chance(0.7) else f' {pick("class", "id")}="{pick(*names)}"' if chance(0.85) else ''}>{inner}{tail}</{tag}>"
    if chance(0.1):
        main = f"<main>{main}</main>"
    above = [f() for f, p in ((note, 0.25), (head, 0.35), (menu, 0.75), (ad, 0.5), (form, 0.15)) if chance(p)]
    below = [f() for f, p in ((side, 0.3), (ad, 0.25), (replies, 0.3), (form, 0.15), (foot, 0.8), (note, 0.2)) if chance(p)]
    if chance(0.5):
        rng.shuffle(above)
    whole = "".join(above) + main + "".join(below)
    if chance(0.25):
        whole = f'<div {pick("id", "class")}="{pick("wrapper", "container", "page", "root")}">{whole}</div>'
    return f"<html><head><title>{word()}</title></head><body>{whole}</body></html>"


@lru_cache(maxsize=2)
def trained(pages: int = 800, seed: int = 7) -> Trees:
    rng = np.random.default_rng(seed)
    xs, ys, ws = [], [], []
    for _ in range(pages):
        blocks, runs = parse(made_page(rng))
        number = {id(b): i for i, b in enumerate(blocks)}
        size = np.zeros((len(blocks), 2))
        for b, text in runs:
            words = text.split()
            size[number[id(b)]] += (sum(w.startswith("x") for w in words), len(words))
        own = size.copy()
        for i in range(len(blocks) - 1, 0, -1):
            size[number[id(blocks[i].parent)]] += size[i]
        use = np.where(own[:, 1:] > 0, own, size)  # a block's own text decides, else its subtree's
        keep = use[:, 1] > 0
        xs.append(features(blocks)[keep])
        ys.append((use[keep, 0] > 0.5 * use[keep, 1]).astype(float))
        ws.append(np.where(own[keep, 1] > 0, 1.0, 0.5))
    return boost(np.concatenate(xs), np.concatenate(ys), np.concatenate(ws))


# -- decoding


def kept(blocks: list[Block], logodds: np.ndarray) -> np.ndarray:
    """The set of blocks, closed under parents, with the largest sum of log-odds, weighed by own text; blocks without weigh little."""
    number = {id(b): i for i, b in enumerate(blocks)}
    size = np.array([np.sqrt(b.own) if b.own else 1e-3 for b in blocks])
    logodds = logodds.copy()
    # plain siblings of one tag are alike: each takes half of its log-odds from all of them
    for b in blocks:
        alike: dict[str, list[int]] = {}
        for c in b.children:
            if not c.groups and c.own:
                alike.setdefault(c.tag, []).append(number[id(c)])
        for k in alike.values():
            if len(k) > 1:
                logodds[k] = 0.5 * logodds[k] + 0.5 * (logodds[k] * size[k]).sum() / size[k].sum()
    value = logodds * size
    best = value.copy()
    for i in range(len(blocks) - 1, 0, -1):
        if best[i] > 0:
            best[number[id(blocks[i].parent)]] += best[i]
    out = best > 0
    for i, b in enumerate(blocks):
        if b.parent is not None:
            out[i] &= out[number[id(b.parent)]]
    return out


def main_texts(pages: list[str | None], trees: Trees) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    x = [features(b) for b, _ in parsed]
    scores = np.split(trees.logodds(np.concatenate(x)), np.cumsum([len(f) for f in x])[:-1]) if x else []
    out = []
    for (blocks, runs), s in zip(parsed, scores, strict=True):
        keep = kept(blocks, s)
        inside = {id(b) for b, k in zip(blocks, keep, strict=True) if k}
        out.append(" ".join(text for b, text in runs if id(b) in inside))
    return out


def extract(df: DataFrame, trees: Trees | None = None, html_col: str = "html", batch: int = 256) -> DataFrame:
    """df with text in place of the page's html column."""
    trees = trees or trained()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                names = [c for c in part.schema.names if c != "__html"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(main_texts(part.column("__html").to_pylist(), trees), pa.string())], [*names, "text"])

    rows = df.withColumn("__html", F.col(html_col).cast("string"))
    rows = rows.drop(html_col, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__html")
    return rows.mapInArrow(kernel, f"{kinds}, text string")
