"""Main text of web pages: the maximum-scoring run of words and tags.

A page is read as blocks of words with tags between them. A word scores positive, the more
so the more its block looks like an article's (its tag, its length, its share of links); a
tag scores negative; words in an element that is named like a page's surroundings (nav,
class="ad") score negative as well. All of these weights are learned from labelled pages:
logistic regression for words, log-odds for tags. One linear scan finds the contiguous run
of the highest sum. Where an article or main element, or else one parent of blocks, holds most
of that run, the run is set to the edges of that element. The blocks of the run whose words do
not score negative are the page's text.

Only what HTML itself never shows as text (scripts, heads, controls, hidden elements) is left
out beforehand; everything else is decided by scores.

Nulls and edge cases: a null or empty page, or one without words, has an empty text. If all
words of a page are named like surroundings, their names do not count. Unclosed and stray
tags are allowed; a tag that is cut off ends at the next "<". Repeated rows give the same
text; an empty table gives an empty result; extra columns are dropped; texts of any length
are read whole, in time linear in their length.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Elements by role, as the HTML standard names them.
RAW = ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "title", "math", "canvas", "audio", "video")
UNSEEN = ("head", "button", "select", "datalist", "dialog")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
INLINE = ("a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr")
# Elements that hold blocks; only the names of these are looked at.
CONTAINERS = ("div", "section", "article", "header", "nav", "aside", "footer", "form", "ul", "ol", "dl", "li", "dt", "dd", "table", "tbody", "tr", "td", "th", "fieldset", "details", "center", "figure")
# Blocks, and what ends an element whose end tag may be left out, as the HTML standard has them.
BLOCKS = ("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul")
SIBLINGS = {"p": BLOCKS, "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "tbody", "tfoot"), "td": ("td", "th", "tr", "tbody", "tfoot"), "th": ("td", "th", "tr", "tbody", "tfoot"), "tbody": ("tbody", "tfoot"), "head": BLOCKS, "option": ("option",)}

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(?P<close>/?)(?P<name>[A-Za-z][^\s/<>]*)(?P<attrs>(?:[^<>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z|[\"'])", re.S)
ATTR = re.compile(r"([^\s=\"'/>]++)(?:\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
PARTS = re.compile(r"[_\-:]+")
WORDS = re.compile(r"\S+")
SPACE = re.compile(r"\s+")

_raw, _unseen, _void, _inline, _containers, _blocks = map(frozenset, (RAW, UNSEEN, VOID, INLINE, CONTAINERS, BLOCKS))
_ends = {name: frozenset(by) for name, by in SIBLINGS.items()}
_parts = frozenset(("nav", "menu", "header", "footer", "aside", "form", "section", "article", "main", "search", "dialog", "body", "html"))
_raw_end = {name: re.compile(rf"</{name}[\s/>]", re.I) for name in RAW}


# ---- pages as blocks -----------------------------------------------------------


class Block:
    """Words between two tags that part blocks: how they stand, and the tags since the block before."""

    __slots__ = ("text", "words", "linked", "tag", "names", "tags", "within", "group")

    def __init__(self, tag: str, names: frozenset, tags: list, within: int, group: int):
        self.text, self.words, self.linked, self.tag, self.names, self.tags, self.within, self.group = [], 0, 0, tag, names, tags, within, group


def _attributes(name: str, attrs: str, known: bool) -> tuple[bool, list[str]]:
    """Whether the element is hidden; and its class tokens and role (behind a point) and id (behind #)."""
    hidden, names = False, []
    for key, *values in ATTR.findall(attrs):
        key, value = key.lower(), "".join(values).strip().lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and NO_DISPLAY.search(value):
            hidden = True
        elif known and value:
            if key == "class":
                names += (f".{v}" for v in value.split())
            elif key == "role":
                names.append(f".{value}")
            elif key == "id":
                names.append(f"#{value}")
    return hidden, names


def read(page: str) -> tuple[list[Block], list[list[int]], dict[int, tuple[int, int]]]:
    """The blocks of shown text; the article and main elements as [first block, behind the last, the one around it]; and first block and behind the last of every element by its number."""
    blocks: list[Block] = []
    around: list[list[int]] = []
    nothing: frozenset = frozenset()
    spans: dict[int, tuple[int, int]] = {}
    # name, names of all ancestors (None: hidden), article or main, number, blocks before it
    stack: list[tuple[str, frozenset | None, int, int, int]] = [("", nothing, -1, 0, 0)]
    opened: dict[str, int] = defaultdict(int)
    named: dict = {}
    block, tags, linked, at, n, number = None, [], False, 0, len(page), 0
    search, never = TOKEN.search, frozenset()

    def pop() -> None:
        name, _, mine, number, before = stack.pop()
        opened[name] -= 1
        if before < len(blocks):
            spans[number] = before, len(blocks)
        if mine >= 0 and mine != stack[-1][2]:
            around[mine][1] = len(blocks)

    def words(text: str) -> None:
        nonlocal block, tags
        if block is None:
            if text.isspace():
                return
            inner, outer = stack[-1], stack[-2] if len(stack) > 1 else stack[-1]
            block = Block(inner[0] or "body", inner[1], tags, inner[2], 0 if outer[0] in ("", "html", "body") else outer[3])
            blocks.append(block)
            tags = []
        count = len(WORDS.findall(text))
        block.text.append(text)
        block.words += count
        block.linked += count * linked

    while at < n:
        m = search(page, at)
        end = m.start() if m else n
        if end > at and stack[-1][1] is not None:
            words(page[at:end])
        if not m:
            break
        at = m.end()
        cdata, closing, name, attrs = m.groups()
        if name is None:
            if cdata and stack[-1][1] is not None:
                words(cdata)
            continue
        name = name.lower()
        if name in _raw:
            if not closing and not attrs.endswith("/"):
                over = _raw_end[name].search(page, at)
                at = over.start() if over else n
            continue
        inline = name in _inline
        if inline and stack[-1][1] is not None:
            if name == "a":
                linked = not closing
            if not attrs or closing or name in _void or not _attributes(name, attrs, False)[0]:
                continue
        if not inline and stack[-1][1] is not None:
            block, linked = None, False
            tags.append(name)
        if closing:
            if opened[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
                if not inline and stack[-1][1] is not None:
                    block = None
            continue
        if not inline:
            while stack[-1][0] in _inline and opened["p"] and name in _blocks:
                pop()
            while name in _ends.get(stack[-1][0], never):
                pop()
        if name in _void or attrs.endswith("/") and name not in _containers:
            continue
        if name == "body":
            while opened["head"]:
                pop()
        _, above, mine, *_ = stack[-1]
        if above is None or name in _unseen:
            names = None
        else:
            hidden, own = _attributes(name, attrs, name in _containers) if attrs else (False, ())
            if hidden:
                names = None
            elif inline:
                continue
            else:
                if name in ("article", "main"):
                    if name == "main" or not around:
                        above = nothing  # the article: what is around it was not closed
                    around.append([len(blocks), n, mine])
                    mine = len(around) - 1
                key = (above, name, tuple(own))
                if (names := named.get(key)) is None:
                    kind = f"{name} in article" if name == "header" and ("article" in above or "main" in above) else name
                    names = named[key] = above | {kind, *own}
        number += 1
        stack.append((name, names, mine, number, len(blocks)))
        opened[name] += 1
    while len(stack) > 1:
        pop()
    return blocks, around, spans


# ---- labelled pages --------------------------------------------------------------

# What labelled pages call the parts around an article, by kind, and the article itself.
MENUS = ("<nav>", "<menu>", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "menubar", "topbar", "toolbar", "pagination", "pager", "skip", "")
HEADERS = ("<header>", "header", "masthead", "banner", "login", "search", "")
ADVERTS = ("ad", "ads", "advert", "advertisement", "advertising", "sponsor", "sponsored", "promo", "banners", "")
NOTICES = ("cookie", "cookies", "consent", "notice", "notices", "notification", "alert", "gdpr", "popup", "modal", "overlay", "dialog", "")
SIDEBARS = ("<aside>", "sidebar", "sidebars", "aside", "complementary", "widget", "related", "newsletter", "subscribe", "share", "social", "")
FORMS = ("<form>",)
COMMENTS = ("comments", "comment", "replies", "respond", "disqus")
FOOTERS = ("<footer>", "footer", "contentinfo", "copyright", "")
ARTICLES = ("<article>", "<main>", "content", "post", "entry", "story", "text", "", "", "body")
# What stands before and behind such names, around articles and within them alike.
BEFORE = ("user", "reader", "page", "main", "top", "global")
BEHIND = ("area", "list", "left", "slot", "bar", "box", "inner", "posts", "body", "section", "block", "right", "links", "item")
# Words that say how a page looks, not what an element is; and wrappers of an article with what is beside it.
SAYS_WHETHER = ("no", "has", "with", "without", "is", "not", "hide", "show", "category", "tag", "type", "status", "format")
SAYS_HOW = ("open", "closed", "enabled", "disabled", "on", "off", "free", "hidden", "visible")
WRAPPERS = ("wrap", "wrapper", "container", "layout", "grid", "row", "columns")
LABELLED_PAGES = 240


def _text(n: int) -> str:
    return " ".join(["word"] * n)


def _in(name: str, inner: str, k: int) -> str:
    """``inner`` in an element of that name: <name>, or a div or section with it as class or id."""
    if name.startswith("<"):
        return f"{name}{inner}</{name[1:]}"
    tag = ("div", "div", "section")[k % 3]
    return f"<{tag}{f' {("class", "id")[k // 3 % 2]}={name!r}' if name else ''}>{inner}</{tag}>"


def _compound(name: str, k: int) -> str:
    """Every third name as it is, every third behind and every third before another word."""
    if not name or name.startswith("<") or k % 3 == 0:
        return name
    return f"{BEFORE[k // 3 % len(BEFORE)]}-{name}" if k % 3 == 1 else f"{name}-{BEHIND[k // 3 % len(BEHIND)]}"


def _links(n: int, words: int, k: int) -> str:
    items = [f"<a href='/'>{_text(1 + (words * (i + k)) % 3)}</a>" for i in range(n)]
    return "<ul>" + "".join(f"<li>{a}</li>" for a in items) + "</ul>" if k % 2 else " ".join(items)


def labelled_page(k: int) -> list[tuple[str, bool]]:
    """Page number ``k`` of the labelled pages, in parts: (html, whether it is the article)."""
    pick = lambda names, step=1: _compound(names[k // step % len(names)], k // 4)
    say = lambda i: _text(6 + (7 * k + 11 * i) % 53)
    kind = k % 8
    if kind in (0, 1, 2):
        article = f"<h1>{_text(2 + k % 7)}</h1>" + "".join(f"<p>{say(i)} <b>word</b> {_text(i)}{'<br>' + _text(9) if i % 3 == 1 else ''}</p>" for i in range(1 + k % 6)) + f"<p>{_text(1 + k % 4)}</p>" * (k % 2)
        if kind == 1 and ARTICLES[k % len(ARTICLES)] in ("<article>", "<main>"):
            article = f"<header><h1>{_text(3)}</h1><p>{_text(5)}</p></header>" + article
    elif kind in (3, 4):
        article = f"<div>{_text(1 + k % 5)}</div><div>{_text(2 + k % 3)}</div>" + "".join(f"<div>{say(i)} <a>word word</a> {_text(3)}</div>" for i in range(2 + k % 5)) + f"<div>{_text(2 + k % 5)}</div>"
    elif kind == 5:
        article = f"<h2>{_text(3)}</h2><p>{say(0)}</p><ul>" + "".join(f"<li>{_text(1 + (k + i) % 12)}</li>" for i in range(6)) + f"</ul><p>{say(1)}</p><ol><li>{_text(4)}</li><li>{_text(9)}</li></ol>"
    elif kind == 6:
        article = f"<h1>{_text(4)}</h1><h2>{_text(3)}</h2><p>{say(0)}</p><blockquote><p>{say(1)}</p></blockquote><table><tr><td>{_text(1)}</td><td>{_text(2)}</td></tr><tr><td>{_text(1)}</td><td>{_text(3)}</td></tr></table><p>{say(2)}</p>"
    else:
        article = f"<p>{say(0)}</p><figure><figcaption>{_text(5)}</figcaption></figure><h3>{_text(3)}</h3><p>{say(3)} <a>word</a>, <a>word word</a> {say(1)}</p><p>{_text(2)}</p><div>{_text(2)}</div><ul><li><a>{_text(4)}</a></li><li><a>{_text(2)}</a></li></ul>"
    menu = _in(pick(MENUS), _links(4 + k % 4, 1 + k % 2, k), k)
    header = _in(pick(HEADERS, 2), f"<a href='/'>{_text(1 + k % 2)}</a><p>{_text(2 + k % 4)}</p>", k + 1)
    advert = _in(pick(ADVERTS), (f"{_text(3 + k % 12)}", f"<p>{_text(5 + k % 9)}</p>", f"<a>{_text(3 + k % 6)}</a>")[k // 3 % 3], 3 * (k // 2))
    notice = _in(pick(NOTICES), f"<p>{_text(7 + k % 14)}</p><a>{_text(1)}</a>", k + 2)
    side = _in(pick(SIDEBARS), f"<h3>{_text(1 + k % 2)}</h3>{_links(5, 2, k)}" + f"<p>{_text(4 + k % 12)}</p>" * (k % 2), k)
    form = _in(pick(FORMS), f"<label>{_text(2)}</label><input><p>{_text(3 + k % 9)}</p>", k)
    comments = _in(pick(COMMENTS, 5), f"<h3>{_text(1)}</h3>" + f"<div><div>{_text(2)}</div><p>{say(4)}</p></div>" * (1 + k % 3), 3 * k)
    footer = _in(pick(FOOTERS), (f"{_text(4 + k % 15)}", f"<p>{_text(3 + k % 11)}</p>{_links(3, 1, k)}")[k % 2], k + 3)
    before, after = [(menu, header), (header, menu), (menu, advert), (notice, menu), (menu,), (header, menu, advert)][k % 6], [(footer,), (side, footer), (form, footer), (comments, footer), (advert, side, footer)][k % 5]
    name = pick(ARTICLES)
    whole = _in(name, "\0", k)
    open_, close = whole.split("\0")
    if k % 7 == 3:
        wrap, unwrap = "<div id='wrap'><div>", "</div></div>"
    else:
        wrap, unwrap = "", ""
    return [("<html><body>" + wrap + "".join(before) + open_, False), (article, True), (close + "".join(after) + unwrap + "</body></html>", False)]


def labelled(number: int = LABELLED_PAGES) -> list[tuple[list[Block], list[bool]]]:
    """The blocks of each labelled page, with whether they are the article's."""
    out = []
    for k in range(number):
        parts = labelled_page(k)
        blocks = read("".join(html for html, _ in parts))[0]
        lengths = [len(read("".join(html for html, _ in parts[:i]))[0]) for i in (1, 2)]
        out.append((blocks, [lengths[0] <= i < lengths[1] for i in range(len(blocks))]))
    return out


# ---- weights ---------------------------------------------------------------------


def _shapes(blocks: list[Block]) -> list[tuple[str, str, str, str]]:
    """Of each block: its tag, its length, its share of links, and how its siblings' words compare with those of the page's largest family."""
    families: Counter = Counter()
    for b in blocks:
        families[b.group] += b.words - b.linked
    most = max(families.values(), default=0)
    out = []
    for b in blocks:
        share, family = b.linked / b.words, families[b.group] / most if most else 0.0
        kin = 4 if family == 1 else 3 if family >= 0.5 else 2 if family >= 0.2 else 1 if family >= 0.05 else 0
        out.append((f"tag {'div' if b.tag in _parts else b.tag}", f"size {min(b.words.bit_length(), 6)}", f"links {0 if not share else 1 if share < 0.5 else 2 if share < 1 else 3}", f"kin {kin}"))
    return out


def learn_weights(pages=None, epochs: int = 400, rate: float = 2.0, decay: float = 1e-4) -> dict[str, dict[str, float]]:
    """``shape`` and ``name``: a logistic regression of blocks inside articles; ``tag``: log-odds of tags inside and outside, all negative."""
    pages = labelled() if pages is None else pages
    rows, y, inside, outside = [], [], Counter(), Counter()
    for blocks, marks in pages:
        for i, (block, mark, shape) in enumerate(zip(blocks, marks, _shapes(blocks))):
            rows.append([*shape, *(f"name {p}" for p in {p for n in block.names for p in _name_parts(n)})])
            y.append(mark)
            # Tags between two blocks of the article are inside it.
            (inside if mark and i and marks[i - 1] else outside).update(block.tags)
    features = {f: i for i, f in enumerate(sorted({f for r in rows for f in r}))}
    x = np.zeros((len(rows), len(features) + 1))
    x[:, -1] = 1
    for i, r in enumerate(rows):
        x[i, [features[f] for f in r]] = 1
    # Classes of a feature that is rare count as much as those of a common one.
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-3)
    xs, target, w = x * scale, np.array(y, float), np.zeros(x.shape[1])
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(xs @ w, -30, 30)))
        w -= rate / x.shape[1] ** 0.5 * (xs.T @ (p - target) / len(y) + decay * w)
    w = w * scale
    found = {f: float(w[i]) for f, i in features.items()}
    odds = {t: min(-0.05, math.log((inside[t] + 0.5) / (outside[t] + 0.5)) - 0.5) for t in inside.keys() | outside.keys()}
    words = {"shape": {"": float(w[-1])} | {f: v for f, v in found.items() if not f.startswith("name ")}, "name": {f[5:]: v for f, v in found.items() if f.startswith("name ")}}

    def right(weights) -> float:
        """Over the labelled pages, the mean overlap of the best run with the article, names left aside."""
        overlap = 0.0
        for blocks, marks in pages:
            first, behind, _ = best_run(*scores(blocks, weights | {"name": {}}))
            overlap += sum(marks[first:behind]) / max(1, sum(marks) + sum(not m for m in marks[first:behind]))
        return overlap / max(1, len(pages))

    # What tags weigh against words: the scale under which the scan finds the labelled articles best.
    scaled = [words | {"tag": {t: v * scale for t, v in odds.items()}} for scale in TAG_SCALES]
    return max(scaled, key=right)


TAG_SCALES = (0.25, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0)


@functools.lru_cache(maxsize=1)
def learned() -> dict[str, dict[str, float]]:
    return learn_weights()


HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: The share of a run that an element must hold for the run to be set to its edges.
MOST = 0.6
#: A name that speaks against an article at least as much as this makes the words in it score negative.
TELLING = -1.0


def _name_parts(name: str) -> list[str]:
    """The words of a class or id, each behind a point; a tag's name is itself."""
    return [f".{p}" for p in PARTS.split(name[1:]) if p and p != "site"] if name[0] in ".#" else [name]


def _name_weight(name: str, weights: dict[str, float]) -> float:
    """What a name says of an element: of a class of several words, the one that speaks most against an article.

    Names that say how a page looks (has-sidebar, ad-free) say nothing; nor do an article's header (post-header) and what wraps an
    article with its surroundings (content-sidebar-wrap). An id is often a heading's words (related-work) and counts if all of them are known.
    """
    parts = _name_parts(name)
    found = [weights.get(p) for p in parts]
    known = [w for w in found if w is not None]
    if not known or name[0] not in ".#" or len(parts) == 1:
        return known[0] if known else 0.0
    plain = [p[1:] for p in parts]
    about = [p in ("article", "main", "page", *ARTICLES) for p in plain]
    if plain[0] in SAYS_WHETHER or plain[-1] in SAYS_HOW or name[0] == "#" and None in found:
        return 0.0
    if any(about) and plain[-1] in WRAPPERS or plain[-1] == "header" and any(about[:-1]):
        return 0.0
    return min(known)


def scores(blocks: list[Block], weights: dict[str, dict[str, float]], names: bool = True) -> tuple[list[float], list[float]]:
    """The score of each block's words, and of the tags before it."""
    shape, name, tag = weights["shape"], weights["name"], weights["tag"]
    telling: dict[frozenset, float] = {}
    other = min(tag.values(), default=-1.0) / 2
    out, gaps = [], []
    for b, looks in zip(blocks, _shapes(blocks)):
        if (against := telling.get(b.names)) is None:
            against = telling[b.names] = min((_name_weight(n, name) for n in b.names), default=0.0)
        if names and against <= TELLING:
            out.append(against * b.words)
        else:
            logit = shape[""] + sum(shape.get(f, 0.0) for f in looks) + sum(name.get(n, 0.0) for n in b.names if n[0] not in ".#" and name.get(n, 0.0) > TELLING)
            out.append(b.words * math.log1p(math.exp(min(logit, 30.0))))
        gaps.append(sum(tag.get(t, other) for t in b.tags))
    return out, gaps


def best_run(words: list[float], gaps: list[float]) -> tuple[int, int, float]:
    """(first, behind the last, sum) of the contiguous run of blocks with the highest sum of words and the tags between; the first of equal ones, (0, 0, 0) if none is above 0."""
    best = (0, 0, 0.0)
    total, start = 0.0, 0
    for i, (w, g) in enumerate(zip(words, gaps)):
        if total + g <= 0:
            total, start = w, i
        else:
            total += g + w
        if total > best[2]:
            best = (start, i + 1, total)
    return best


def main_text(page: str | None, weights: dict[str, dict[str, float]] | None = None) -> str:
    """The text of the best run, one block a line."""
    if not page:
        return ""
    blocks, around, spans = read(page)
    weights = weights or learned()
    words, gaps = scores(blocks, weights)
    first, behind, best = best_run(words, gaps)
    if not best:
        words, gaps = scores(blocks, weights, names=False)
        first, behind, best = best_run(words, gaps)
    # Where an element holds most of the run, the run is set to its edges.
    held, family = Counter(), Counter()
    for i in range(first, behind):
        element = blocks[i].within
        family[blocks[i].group] += max(0.0, words[i])
        while element >= 0 and words[i] > 0:
            held[element] += words[i]
            element = around[element][2]
    enough = MOST * sum(family.values())
    # An inner article or main has a higher number than the one around it.
    element = max((e for e, w in held.items() if w >= enough), default=-1)
    parent = max((g for g, w in family.items() if g and w >= enough), default=0)
    if element >= 0:
        first, behind = around[element][:2]
        if first and blocks[first].tag not in HEADINGS and blocks[first - 1].tag in HEADINGS:
            first -= 1  # the title stands before it
    elif parent:
        start, end = spans[parent]
        while first > start and not 0 < blocks[first - 1].linked == blocks[first - 1].words:  # not a menu
            first -= 1
        behind = max(behind, end)
    lines = (SPACE.sub(" ", htmllib.unescape("".join(b.text))).strip() for b, w in zip(blocks[first:behind], words[first:behind]) if w > 0)
    return "\n".join(filter(None, lines))


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every page. One narrow pass; no shuffle."""
    weights = learned()

    def extract(batches):
        for b in batches:
            texts = [main_text(p.as_py(), weights) for p in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(extract, f"page_id {key}, url string, text string, n_chars long")
