"""Main text of web pages: boosted trees over DOM nodes, decoded along the tree.

A page is read tolerantly into block elements and the text blocks they own.  Each element
has features of its subtree (text, tags, links, sentences), its depth, its siblings,
its place in the page and its attribute and tag tokens (learned log odds, for itself and
for what encloses it).  Gradient-boosted trees give the log odds that it belongs to the
article.  Decoding picks the best labelling in which an element is outside, in, or cut
out of the article and children never contradict their parents: below ``outside`` an
article may begin, below ``in`` a part may be cut out, and below that all stays out.

The trees are fitted on ``TRAINING_PAGES`` generated pages (articles of invented words
with menus, headers, footers, sidebars, notices, adverts, forms and comments around and
within, in named and unnamed containers, in the body itself, as bare text); no page of the
input is used, so equal pages give equal text anywhere.

Defined cases: null or empty html gives an empty text; pages of any length and depth are
read in time that grows with their length; a tag whose quotes never close ends at its
first ``>``; references to numbers beyond all code points are U+FFFD; unclosed elements end with their parent or, for paragraphs and list
items, where the next begins.  ``page_id`` and ``url`` are passed through, null or not;
no other column is read.
"""

from __future__ import annotations

import bisect
import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import released, table

TRAINING_PAGES, TREES, DEPTH, RATE, BINS = 400, 40, 3, 0.3, 32
SWITCH = 1.0  # what it costs to begin or cut out a part

_OPEN = re.compile(r"<(?:(!--)|(/?)([a-z][a-z0-9:-]*)|[!?/])", re.I)
#: Attributes up to the end of a tag, quoted values as one.
_INSIDE = re.compile(r"(?:\"[^\"]*\"|'[^']*'|[^>\"']+)*+>")
_MARK = re.compile("[\"'>]")
#: Elements whose content is no text: these run to the end of the page if no end tag follows, the others only hide their tag then.
TO_END = frozenset("script style title textarea".split())
_RAW_END = {n: re.compile(rf"</{n}(?=[\s/>])", re.I) for n in [*sorted(TO_END), "noscript", "template", "svg", "iframe", "select", "button"]}
#: What ends these before an end tag: they can't hold it.
_BREAKS = {n: re.compile(rf"<{n}(?=[\s/>])", re.I) for n in ("select", "button")}
_BREAKS["svg"] = re.compile(r"<(?:p|div|article|section|h[1-6]|ul|ol|li|table|blockquote|pre|body|img|span)(?=[\s/>])", re.I)
_FOREIGN = re.compile(r"<foreignobject", re.I)
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
_ATTRIBUTE = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
_HUMP = re.compile(r"([a-z])([A-Z])")
_SPACE = re.compile(r"\s+")
_BLANKS = tuple(" \t\n\r\f\v")
_SENTENCE = re.compile(r"[.!?,;:]")
#: References to numbers beyond all code points, which need not be read as numbers.
_LONG = re.compile(r"&#0*[1-9][0-9]{8,};?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset"
    " h1 h2 h3 h4 h5 h6 header hgroup html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that begins ends these, up to the elements after them.
ENDS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table")}
ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in ENDS.items()}


class _Ahead:
    """The next match of a pattern at or after a place, for places that never fall: each is looked for once."""

    def __init__(self, pattern: re.Pattern, html: str):
        self.pattern, self.html, self.found, self.over = pattern, html, None, False

    def __call__(self, at: int) -> re.Match | None:
        while not self.over and (self.found is None or self.found.start() < at):
            self.found = self.pattern.search(self.html, at)
            self.over = self.found is None
        return None if self.over else self.found


class _Ends:
    """Where tags end: at the first ``>`` outside quotes or, if there is none up to the end of the page, at the first of all."""

    def __init__(self, html: str):
        self.html, self.marks, self.ends, self.last = html, None, None, html.rfind(">")

    def __call__(self, at: int) -> int:
        """The end of the tag whose name ends at ``at``; 0 if the page has none."""
        if at > self.last:
            return 0
        if self.marks is None:
            if m := _INSIDE.match(self.html, at):
                return m.end()
            self._mark(at)
        return self.ends[bisect.bisect_left(self.marks, at)] or self.html.find(">", at) + 1

    def _mark(self, at: int):
        """Where a tag would end from each quote or ``>`` on, from the last of them to the first."""
        kinds = [(m.start(), m.group()) for m in _MARK.finditer(self.html, at)]
        self.marks, self.ends = [i for i, _ in kinds], [0] * (len(kinds) + 1)
        following = {}
        for k in range(len(kinds) - 1, -1, -1):
            i, kind = kinds[k]
            if kind == ">":
                self.ends[k] = i + 1
            else:
                self.ends[k] = self.ends[following[kind] + 1] if kind in following else 0
                following[kind] = k


def _tokens(html: str):
    """Start, end, slash, name and attributes of each tag or comment; elements without text are one token without a name.

    Whatever the page holds, no place is looked at more than a few times.
    """
    at, head, tag_end = 0, False, _Ends(html)
    ahead = {n: _Ahead(r, html) for n, r in _RAW_END.items()}
    breaks = {n: _Ahead(r, html) for n, r in _BREAKS.items()}
    foreign = _Ahead(_FOREIGN, html)
    while m := _OPEN.search(html, at):
        start, name, slash = m.start(), (m.group(3) or "").lower(), m.group(2)
        if m.group(1):
            end = html.find("-->", m.end()) + 3
            end = end if end > 2 else len(html)
        elif not (end := tag_end(m.end()) if name else html.find(">", m.end()) + 1):
            if name in TO_END and not slash and html[m.end() : m.end() + 1] in ("/", *_BLANKS):
                yield start, len(html), slash, "", ""
                return
            if not name and html.find("<!--", start) < 0:  # nothing ends any more
                return
            at = start + 1
            continue
        attributes, at = html[m.end() : end - 1] if name else "", end
        if name == "head" or head and (name in IN_HEAD or not name):
            head, hidden = name != "head" or not slash, True
        else:
            head = head and not name
            hidden = False
        if name in _RAW_END and not slash:
            hidden = True
            if not (name == "svg" and attributes.rstrip().endswith("/")):
                end = ahead[name](at)
                if end is None or end.end() > tag_end.last:
                    at = len(html) if name in TO_END else at
                else:
                    stop = breaks[name](at) if name in breaks else None
                    stop = None if stop is None or stop.end() > end.start() else stop.start()
                    inside = foreign(at) if name == "svg" and stop is not None else None
                    if stop is None or inside is not None and inside.end() <= stop:
                        at = html.find(">", end.end()) + 1
                    else:
                        at = stop if name == "svg" else at
        yield start, at, slash, "" if hidden else name, attributes


class Page:
    """Block elements in document order (parents first) and the text blocks that they own."""

    def __init__(self, html: str):
        self.tag, self.tokens, self.parent, self.depth = ["#page"], [("tag:page",)], [-1], [0]
        self.links, self.tags = [0], [0]  # link characters and tags inside the element's own blocks
        self.blocks: list[tuple[int, str]] = []
        stack, names, text, at, link = [0], ["#page"], [], 0, 0
        places: dict[str, list[int]] = {}  # where in the stack elements of each name are open

        def flush():
            if text:
                whole = _LONG.sub("&#999999999;", "".join(text))
                whole = _SPACE.sub(" ", entities.unescape(whole)).strip()
                text.clear()
                if whole:
                    self.blocks.append((stack[-1], whole))

        def last(of) -> int:
            return max((places[n][-1] for n in of if places.get(n)), default=0)

        def close(k: int):
            for n in names[k:]:
                places[n].pop()
            del names[k:], stack[k:]

        for start, end, slash, name, attributes in _tokens(html):
            if start > at:
                part = html[at:start]
                text.append(part)
                if link:
                    self.links[stack[-1]] += len(part)
            at = end
            if not name:
                continue
            if name not in BLOCK:
                self.tags[stack[-1]] += 1
                if name == "a":
                    link = not slash
                elif name in ("br", "hr", "img"):
                    text.append(" ")
                continue
            flush()
            link = 0
            if slash:
                if k := last((name,)):
                    close(k)
                continue
            if k := last(("p",)):
                close(k)
            if name in ENDS:
                ended, border = ENDS[name]
                k = last(ended)
                if k > last(border):
                    close(k)
            own = ["tag:" + name]
            if attributes:
                for a in _ATTRIBUTE.findall(attributes):
                    own += _PART.findall(_HUMP.sub(r"\1 \2", a[0] or a[1] or a[2]).lower())
            self.tag.append(name)
            self.tokens.append(tuple(own))
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self.links.append(0)
            self.tags.append(1)
            places.setdefault(name, []).append(len(stack))
            stack.append(len(self.tag) - 1)
            names.append(name)
        if at < len(html):
            text.append(html[at:])
        flush()


#: Names of the columns of :func:`features`.
FEATURES = ("own tokens", "enclosing tokens", "worst enclosing tokens", "depth", "text", "link share", "text per tag", "sentence marks", "paragraphs", "place among siblings", "siblings", "text against siblings", "share of page", "place in page", "children", "own text")


def features(page: Page, odds: dict[str, float]) -> np.ndarray:
    n = len(page.tag)
    chars, links, tags, marks, paras, own = (np.zeros(n) for _ in range(6))
    first = np.full(n, np.inf)
    at = 0
    for owner, text in page.blocks:
        chars[owner] += len(text)
        marks[owner] += len(_SENTENCE.findall(text))
        first[owner] = min(first[owner], at)
        at += len(text)
    own[:] = chars
    links[:], tags[:] = page.links, page.tags
    paras[:] = [t == "p" for t in page.tag]
    parent = page.parent
    children, order, rank = [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        rank[i] = children[parent[i]]
        children[parent[i]] += 1
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        links[p] += links[i]
        tags[p] += tags[i]
        marks[p] += marks[i]
        paras[p] += paras[i]
        first[p] = min(first[p], first[i])
    mine = [min(6.0, max(-6.0, sum(odds.get(t, 0.0) for t in tokens))) for tokens in page.tokens]
    above, worst = [0.0] * n, [0.0] * n
    for i in range(1, n):
        above[i] = 0.7 * above[parent[i]] + mine[parent[i]]
        worst[i] = min(worst[parent[i]], mine[parent[i]])
    up = np.array([max(p, 0) for p in parent])
    siblings = np.array(children)[up]
    total = max(1.0, chars[0])
    others = (chars[up] - own[up] - chars) / np.maximum(siblings - 1, 1)
    return np.column_stack([
        mine, above, worst, page.depth, np.log1p(chars), links / np.maximum(chars, 1), np.log1p(chars / np.maximum(tags, 1)), 100 * marks / np.maximum(chars, 1), np.log1p(paras),
        np.array(rank) / np.maximum(siblings, 1), np.log1p(siblings), np.log1p(chars) - np.log1p(np.maximum(others, 0)), chars / total, np.where(np.isfinite(first), first, at) / total, np.log1p(children), np.log1p(own),
    ])


class Boosted:
    """Gradient-boosted trees of a fixed depth for the log odds of a yes, on binned features."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned, score, self.trees = self.binned(x), np.zeros(len(y)), []
        columns, wide = x.shape[1], BINS
        flat = binned + np.arange(columns) * wide
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            grad, hess = y - p, p * (1 - p)
            leaf, splits = np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                width = 1 << level
                cell = ((leaf * columns * wide)[:, None] + flat).ravel()
                g, h = (np.bincount(cell, np.repeat(v, columns), width * columns * wide).reshape(width, columns, wide).cumsum(axis=2) for v in (grad, hess))
                gain = sum(a**2 / (b + 1.0) for a, b in ((g, h), (g[..., -1:] - g, h[..., -1:] - h)))
                best = gain.reshape(width, -1).argmax(axis=1)
                column, cut = best // wide, best % wide
                splits.append((column, cut))
                leaf = 2 * leaf + (binned[np.arange(len(y)), column[leaf]] > cut[leaf])
            g, h = (np.bincount(leaf, v, 1 << DEPTH) for v in (grad, hess))
            value = RATE * g / (h + 1.0)
            self.trees.append((splits, value))
            score += value[leaf]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(self.edges, x.T, strict=True)])

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned, score, at = self.binned(x), np.zeros(len(x)), np.arange(len(x))
        for splits, value in self.trees:
            leaf = np.zeros(len(x), np.int64)
            for column, cut in splits:
                leaf = 2 * leaf + (binned[at, column[leaf]] > cut[leaf])
            score += value[leaf]
        return score


def decode(page: Page, odds: np.ndarray) -> list[bool]:
    """Which elements are in the article, under the best labelling without contradictions."""
    n = len(page.tag)
    gain = odds.tolist()
    outside, inside, cut = [-g for g in gain], list(gain), [-g for g in gain]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        outside[p] += max(outside[i], inside[i] - SWITCH)
        inside[p] += max(inside[i], cut[i] - SWITCH)
        cut[p] += cut[i]
    state = [0] * n  # 0 outside, 1 in, 2 cut out
    state[0] = int(inside[0] - SWITCH > outside[0])
    for i in range(1, n):
        above = state[page.parent[i]]
        state[i] = int(inside[i] - SWITCH > outside[i]) if above == 0 else 1 + (cut[i] - SWITCH > inside[i]) if above == 1 else 2
    return [s == 1 for s in state]


# --- training pages ------------------------------------------------------------------

_GOOD = "article content post entry story main body text page-content article-body post-content entry-content".split()
_BAD = {
    "menu": "nav menu navbar navigation topnav breadcrumb toolbar tabs pagination".split(),
    "header": "header masthead top branding site-header banner".split(),
    "footer": "footer bottom copyright site-footer legal colophon".split(),
    "side": "sidebar aside related widget trending recommended more rail".split(),
    "notice": "cookie notice consent gdpr alert popup modal banner disclaimer".split(),
    "ad": "ad ads advert advertisement sponsored promo adsense".split(),
    "form": "form login subscribe subscription newsletter search signup contact register".split(),
    "comments": "comments comment discussion replies responses disqus".split(),
    "share": "share social buttons sharing follow tags".split(),
}
_TAGS = {"menu": "nav nav div ul", "header": "header header div", "footer": "footer footer footer div", "side": "aside aside div section", "notice": "div div section aside", "ad": "div div div aside", "form": "form form div div section", "comments": "section div div ol", "share": "div ul div"}


def training_page(seed: int) -> str:
    """A generated page; elements of the article carry the attribute ``data-in``, others none.

    Some articles stand in named elements, some in elements whose names say nothing, some
    in the body itself; their paragraphs may be ``div`` or lines of bare text.  Some pages
    are bare text (a comment marks them), some have no article.
    """
    rng = random.Random(seed)
    syllables = [a + b for a in "b c d f g l m n p r s t v st tr".split() for b in "a e i o u an er".split()]

    def words(n):
        return ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(n)]

    def sentence(most=22):
        w = words(int(rng.randrange(1, most)))
        return " ".join(w).capitalize() + rng.choice([".", ".", ".", "!", "?", ""])

    def prose():
        return " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8])))

    def name(kind, list_):
        if rng.random() < 0.25:
            return ""
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(list_)}{rng.choice(["", "", "", " box", " row", "-1", " wrapper", "-area", "-list", "-section", "-inner", "-" + rng.choice(list_)])}"'

    def bad(kind):
        tag = rng.choice(_TAGS[kind].split())
        n = int(rng.randrange(2, 9))
        link = lambda: f'<a href="/{words(1)[0]}">{" ".join(words(int(rng.randrange(1, 4))))}</a>'
        if kind in ("menu", "share") or kind == "side" and rng.random() < 0.6:
            inner = "".join(f"<li>{link()}</li>" for _ in range(n))
            inner = inner if tag in ("ul", "ol") else f"<ul>{inner}</ul>" if rng.random() < 0.8 else " | ".join(link() for _ in range(n))
        elif kind == "comments":
            inner = "".join(f'<{"li" if tag == "ol" else "div"}{name(kind, _BAD[kind])}><p>{prose()}</p></{"li" if tag == "ol" else "div"}>' for _ in range(n))
            inner = (f"<h3>{rng.choice(['Comments', '3 replies', ''])}</h3>" if tag != "ol" else "") + inner
        elif kind == "form":
            inner = f'<label>{sentence(5)}</label><input name="q"><p>{sentence(8)}</p>'
        elif kind == "footer":
            inner = f"&copy; {sentence(6)}" + (f"<p>{sentence()}</p>" if rng.random() < 0.5 else f" &middot; {sentence()}") + (link() if rng.random() < 0.5 else "")
        elif kind == "header":
            inner = f"<h1>{' '.join(words(2))}</h1>" if rng.random() < 0.4 else f"<p>{sentence(6)}</p>" + link()
        else:
            inner = rng.choice(["{}", "<p>{}</p>", "<div>{}</div>"]).format(" ".join(sentence() for _ in range(int(rng.randrange(1, 4))))) + (link() if rng.random() < 0.3 else "")
        cls = name(kind, _BAD[kind])
        if not cls and tag not in ("nav", "footer", "header", "form"):
            cls = f' class="{rng.choice(_BAD[kind])}"'
        return f"<{tag}{cls}>{inner}</{tag}>"

    if rng.random() < 0.06:
        bare = rng.choice(["\n", "<br>", " "]).join(prose() for _ in range(rng.randrange(1, 12)))
        return "<!-- data-in -->" + bare if rng.random() < 0.5 else f"<html><head><title>{sentence(8)}</title></head><body data-in>{bare}</body></html>"
    paragraph = rng.choice(["p"] * 7 + ["div", "div", "br", "div><p", "div><p"])
    around = name("", ["".join(words(1)) for _ in range(3)]) if "div" in paragraph and rng.random() < 0.5 else ""
    parts = [f"<h1 data-in>{sentence(12)}</h1>"] if rng.random() < 0.85 else []
    for _ in range(rng.choice([1, 2, 4, 8, 16, 30])):
        kind = rng.random()
        if kind < 0.72 and paragraph == "br":
            parts.append(prose() + "<br><br>")
        elif kind < 0.72:
            begin = f"<div{around} data-in>" + ("<p data-in>" if paragraph != "div" else "") if "div" in paragraph else "<p data-in>"
            parts.append(begin + prose() + ("</p></div>" if paragraph == "div><p" else f"</{paragraph}>" if paragraph == "div" or rng.random() < 0.8 else ""))
        elif kind < 0.8:
            parts.append(f"<h2 data-in>{sentence(8)}</h2>")
        elif kind < 0.86:
            parts.append("<ul data-in>" + "".join(f"<li data-in>{sentence()}</li>" for _ in range(int(rng.randrange(2, 6)))) + "</ul>")
        elif kind < 0.91:
            parts.append(f"<blockquote data-in><p data-in>{prose()}</p></blockquote>")
        elif kind < 0.93:
            parts.append(f"<pre data-in>{' '.join(words(12))}</pre>")
        elif kind < 0.95:
            parts.append("<table data-in><tr data-in>" + "".join(f"<td data-in>{words(1)[0]}</td>" for _ in range(4)) + "</tr></table>")
        else:
            parts.append(bad(rng.choice(["ad", "side", "share", "notice", "form"])))
    for kind, share in (("share", 0.15), ("form", 0.15), ("side", 0.1), ("comments", 0.25)):
        if rng.random() < share:
            parts.append(bad(kind))
    tag = rng.choice(["article", "article", "article", "main", "main", "div", "div", "section", "td", "td", "body", "body"])
    plain = rng.random() < 0.4  # a name that says nothing, or none
    cls = name("good", ["".join(words(1)) for _ in range(3)] if plain else _GOOD)
    if not cls and not plain and tag in ("div", "section", "td"):
        cls = f' class="{rng.choice(_GOOD)}"'
    article = "".join(parts)
    if tag == "td":
        side = "".join(f"<td>{bad(rng.choice(['menu', 'side', 'ad']))}</td>" for _ in range(rng.randrange(0, 2)))
        article = f"<table><tr>{side}<td{cls} data-in>{article}</td></tr></table>"
    elif tag != "body":
        article = f"<{tag}{cls} data-in>{article}</{tag}>"
    if rng.random() < 0.03:
        article = ""
    before = [bad(k) for k in ("header", "menu", "notice", "ad", "form", "side") if rng.random() < 0.5]
    after = [bad(k) for k in ("share", "comments", "side", "ad", "form", "notice", "footer", "menu") if rng.random() < 0.45]
    rng.shuffle(before)
    middle = "".join(before) + article + "".join(after)
    if tag == "body":
        return f"<html><head><title>{sentence(8)}</title></head><body{' data-in' if article else ''}>{middle}</body></html>"
    for _ in range(int(rng.randrange(0, 3))):
        middle = f"<div{name('', ['wrapper', 'container', 'page', 'layout', 'row', 'site'])}>{middle}</div>"
    return f"<html><head><title>{sentence(8)}</title></head><body>{middle}</body></html>"


def labels(html: str) -> tuple[Page, np.ndarray]:
    page = Page(html.replace(" data-in", ' itemprop="zzin"'))
    inside = np.array(["zzin" in t for t in page.tokens], float)
    inside[0] = html.startswith("<!-- data-in -->")
    page.tokens = [tuple(x for x in t if x != "zzin") for t in page.tokens]
    return page, inside


class Model:
    def __init__(self, pages: int = TRAINING_PAGES):
        made = [labels(training_page(s)) for s in range(pages)]
        yes, no = {}, {}
        for page, inside in made:
            for tokens, y in zip(page.tokens, inside, strict=True):
                for t in tokens:
                    into = yes if y else no
                    into[t] = into.get(t, 0) + 1
        self.token_odds = {t: float(np.log((yes.get(t, 0) + 1) / (no.get(t, 0) + 1))) for t in sorted(yes.keys() | no.keys()) if yes.get(t, 0) + no.get(t, 0) >= 3}
        x = np.vstack([features(page, self.token_odds) for page, _ in made])
        self.trees = Boosted(x, np.concatenate([y for _, y in made]))

    def extract(self, pages: list[str]) -> list[list[str]]:
        """The article's text blocks of each page."""
        read = [Page(h) for h in pages]
        odds = self.trees.odds(np.vstack([features(p, self.token_odds) for p in read])) if read else np.zeros(0)
        out, at = [], 0
        for p in read:
            keep = decode(p, odds[at : at + len(p.tag)])
            at += len(p.tag)
            out.append([text for owner, text in p.blocks if keep[owner]])
        return out


def main_text(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars and n_blocks for each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or Model())

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 200):
                part = batch.slice(i, 200)
                blocks = shared.value.extract([h or "" for h in part.column(2).to_pylist()])
                text = ["\n\n".join(b) for b in blocks]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([len(b) for b in blocks], pa.int64())], ["page_id", "url", "text", "n_chars", "n_blocks"])

    return pages.select("page_id", "url", "html").mapInArrow(released(run), "page_id long, url string, text string, n_chars long, n_blocks long")


def op3_main_text(spark, sf_dir):
    return main_text(table(spark, sf_dir, "pages"))
