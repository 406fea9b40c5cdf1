"""HTML extraction (op6): content and boilerplate blocks separated by a minimum cut.

A page is read into text blocks with their place in the element tree. Fixed log-odds of tags, class names, link density
and length give each run of blocks of one container a cost for either label; the costs are the capacities to the two
terminals. Names are evidence by degrees: only one whose every word is of boilerplate settles the matter. Runs that are adjacent, or near in the tree, are tied by smoothness edges. The maximum flow saturates the
cheapest cut, and what stays connected to the source is content.
"""

from __future__ import annotations

import html
import re
from collections import deque
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .memory import lean, slices

#: Element names of the HTML standard by their part in a page.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "template", "svg", "math", "noscript"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby",
    "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
FLOW = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "blockquote", "pre", "figure", "figcaption", "table", "thead", "tbody", "tr", "td", "th", "br", "hr"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
CLOSES_P = FLOW - {"br", "thead", "tbody", "tr", "td", "th", "li", "dt", "dd"} | {"div", "section", "article", "aside", "nav", "header", "footer", "main", "form", "fieldset", "address", "details", "menu", "center", "dialog", "search"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

#: Log-odds of content. NEVER holds whatever the neighbours are.
NEVER = -1000.0
TAGS = {
    **dict.fromkeys(("head", "nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "object", "canvas", "audio", "video", "label", "fieldset", "search", "datalist"), NEVER),
    "article": 8.0, "main": 6.0, "p": 1.5, "blockquote": 1.5, "pre": 1.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "li": -0.3, "td": -0.3, "th": -0.3, "address": -3.0,
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "tablist", "status"}
BAD = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "notification", "alert",
    "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "nav", "navbar", "navigation", "menu", "menus", "breadcrumb", "breadcrumbs", "masthead", "footer", "sidebar", "side", "aside", "widget", "widgets",
    "related", "recommended", "recommendations", "share", "sharing", "social", "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "login", "search", "searchbox", "form", "pagination", "pager",
    "copyright", "disclaimer", "toolbar", "paywall", "teaser", "outbrain", "taboola", "skip", "hidden",
}
GOOD = {"article", "content", "main", "post", "entry", "story", "body", "text", "prose"}
HEADER = {"header", "topbar"}
BESIDE = {"has", "with", "no", "without", "is"}
#: Words of names that only say where a part stands or how it is built.
PLACE = {
    "site", "page", "global", "top", "bottom", "left", "right", "upper", "lower", "inner", "outer", "wrapper", "wrap", "container", "holder", "box", "bar", "block", "section", "area", "panel", "region", "zone", "row", "col",
    "column", "grid", "list", "item", "items", "group", "set", "link", "links", "button", "buttons", "btn", "icon", "icons", "title", "heading", "label", "primary", "secondary", "fixed", "sticky", "slot", "unit", "posts",
    "articles", "stories", "entries", "js", "wp",
}
#: Words that make a phrase of a name ("side by side", "alert free"): what stands beside them isn't what the element is.
PHRASE = {"by", "free", "of", "to", "for", "in", "on", "and", "or", "non", "not", "less", "vs"} | BESIDE
#: Log-odds of a name that is boilerplate in part: with two such words or as its last one, as another, and of weak evidence.
MOST, PART, WEAK = -8.0, -6.0, -1.0

TAG = re.compile(r"""<(?:!--(?:.*?)(?:-->|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)(?:>|\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+").findall

ADJACENT, NEAR = 1.0, 1.5
UNIT = 1000


class Element(NamedTuple):
    tag: str
    number: int
    depth: int
    parent: Element | None
    odds: float
    article: bool
    container: Element | None
    named: int  # number of the outermost element around the text whose name is against it, 0 for none


class Block(NamedTuple):
    text: str
    element: Element
    linked: int


def name_odds(words: list[str], soft: bool) -> float:
    """Log-odds of one class name or id, from its words.

    A name settles the matter only if all of its words are of boilerplate or of place; otherwise it is evidence that
    text can outweigh. soft: a name of several words is weak evidence.
    """
    bad = [w in BAD for w in words]
    if not any(bad):
        return 2.0 if not GOOD.isdisjoint(words) else 0.0
    if words[0] in BESIDE:  # "has-sidebar" and the like tell what stands beside an element, not what it is
        return 0.0
    if not PHRASE.isdisjoint(words):
        return WEAK
    rest = [w for w, b in zip(words, bad, strict=True) if not b and w not in PLACE and not w.isdigit() and len(w) > 2]
    if not rest:
        return WEAK if soft and len(words) > 1 else NEVER
    if all(w in GOOD for w in rest):  # comment-body, article-footer, newsletter-article
        return WEAK if soft else MOST
    if words[-1] in GOOD:
        return WEAK
    if soft:
        return WEAK
    return MOST if sum(bad) > 1 or bad[-1] else PART


def element_odds(tag: str, raw: str, parent: Element, soft: bool = False) -> tuple[float, bool]:
    """Log-odds that an element adds to its text, and whether its name is against it."""
    odds, against = TAGS.get(tag, 0.0), False
    if tag == "header" and not parent.article:
        odds = NEVER
    if raw and tag not in ("html", "body") and not raw.isspace():
        attributes = {}
        for k, a, b, c in ATTRIBUTE.findall(raw):
            attributes.setdefault(k.lower(), a or b or c)
        if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
            return NEVER, False
        if attributes.get("role", "").lower() in ROLES:
            return NEVER, False
        names = [[n.lower() for n in NAMES(w)] for k in ("class", "id") for w in attributes.get(k, "").split()]
        evidence = [name_odds(n, soft) for n in names if n]
        if evidence:
            if any(n and HEADER.issuperset(w for w in n if w not in PLACE) and not HEADER.isdisjoint(n) for n in names) and not parent.article:
                evidence.append(WEAK if soft else NEVER)
            worst = min(evidence)
            if worst < 0 and tag not in ("article", "main"):
                odds, against = odds + worst, worst <= PART
            odds += max(0.0, max(evidence))
    return max(NEVER, odds), against


def blocks(page: str, soft: frozenset[int] = frozenset()) -> list[Block]:
    """Text blocks in page order. Missing and misplaced end tags are put right as far as text needs it.

    soft: numbers of elements whose names are weak evidence.
    """
    root = Element("", 0, 0, None, 0.0, False, None, 0)
    root = root._replace(container=root)
    stack = [root]
    out: list[Block] = []
    held: list[str] = []
    state = {"linked": 0, "links": 0, "number": 0}

    def flush() -> None:
        if held:
            text = " ".join("".join(held).split())
            if text:
                top = next(e for e in reversed(stack) if e.tag not in INLINE)
                out.append(Block(text, top, state["linked"]))
            held.clear()
        state["linked"] = 0

    def close(index: int) -> None:
        while len(stack) > index:
            if stack[-1].tag not in INLINE:
                flush()
            elif stack[-1].tag == "a":
                state["links"] -= 1
            stack.pop()

    def add(text: str) -> None:
        if text:
            text = html.unescape(text) if "&" in text else text
            held.append(text)
            if state["links"] > 0:
                state["linked"] += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:  # end tag
            if tag == "br":
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag == "br" or tag == "hr":
            held.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i].tag in SCOPE[tag]:
                    break
        if tag not in INLINE:
            flush()
        elif tag == "a":
            state["links"] += 1
        parent = stack[-1]
        state["number"] += 1
        odds, against = element_odds(tag, m[3], parent, state["number"] in soft)
        e = Element(tag, state["number"], parent.depth + 1, parent, max(NEVER, parent.odds + odds), parent.article or tag in ("article", "main"), None, parent.named or against * state["number"])
        stack.append(e._replace(container=parent.container) if tag in FLOW or tag in INLINE else e)
        if stack[-1].container is None:
            stack[-1] = e._replace(container=e)
    flush()
    return out


def block_odds(b: Block) -> float:
    size = len(b.text)
    odds = b.element.odds + min(2.0, size / 80) - 0.8
    if b.linked > 0.5 * size and b.element.tag not in HEADINGS:
        odds -= 6.0
    elif b.text[-1] in ".!?…。\"”":
        odds += 0.5
    return odds


def distance(a: Element, b: Element) -> int:
    """Edges between two elements of the tree."""
    steps = 0
    while a.number != b.number:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


class Flow:
    """Maximum flow by level graphs (Dinic); capacities are integers."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.left: list[int] = []

    def edge(self, a: int, b: int, there: int, back: int = 0) -> None:
        self.out[a].append(len(self.to))
        self.out[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.left += [there, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.out)
        level[source] = 0
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for e in self.out[a]:
                if self.left[e] > 0 and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    todo.append(self.to[e])
        return level

    def run(self, source: int, sink: int) -> int:
        total = 0
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return total
            turn = [0] * len(self.out)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    much = min(self.left[e] for e in path)
                    total += much
                    for e in path:
                        self.left[e] -= much
                        self.left[e ^ 1] += much
                    k = next(i for i, e in enumerate(path) if not self.left[e])
                    a = self.to[path[k] ^ 1]
                    del path[k:]
                while turn[a] < len(self.out[a]):
                    e = self.out[a][turn[a]]
                    if self.left[e] > 0 and level[self.to[e]] == level[a] + 1:
                        break
                    turn[a] += 1
                if turn[a] < len(self.out[a]):
                    path.append(e)
                    a = self.to[e]
                elif a == source:
                    break
                else:
                    level[a] = -1
                    a = self.to[path.pop() ^ 1]


def label(found: list[Block]) -> list[bool]:
    """Content or not, for each block, by the minimum cut."""
    runs: list[list] = []  # container, odds, blocks; a run has one container and one sign
    for k, b in enumerate(found):
        odds = max(NEVER, block_odds(b))
        if runs and runs[-1][0].number == b.element.container.number and (runs[-1][1] > 0) == (odds > 0):
            runs[-1][1] = max(NEVER, runs[-1][1] + odds)
            runs[-1][2].append(k)
        else:
            runs.append([b.element.container, odds, [k]])
    source, sink = len(runs), len(runs) + 1
    flow = Flow(len(runs) + 2)
    seen: dict[int, int] = {}
    for i, (container, odds, _) in enumerate(runs):
        cap = int(abs(odds) * UNIT)
        flow.edge(source, i, cap if odds > 0 else 0)
        flow.edge(i, sink, cap if odds <= 0 else 0)
        tied = {}
        if i:
            tied[i - 1] = ADJACENT + NEAR / (1 + distance(container, runs[i - 1][0]))
        if container.number in seen:
            tied.setdefault(seen[container.number], NEAR)
        for j, w in tied.items():
            flow.edge(j, i, int(w * UNIT), int(w * UNIT))
        seen[container.number] = i
    flow.run(source, sink)
    level = flow.levels(source)
    out = [False] * len(found)
    for i, (_, odds, own) in enumerate(runs):
        for k in own:
            out[k] = level[i] >= 0
    return out


def main_text(page: str | None) -> str:
    """The main text of a page: content blocks in page order, joined by a space. Empty for null, empty and textless pages.

    Where nothing is content, the name of the element that holds most of the text, a quarter at least, is taken as weak
    evidence and the cut is run again, so that no article is lost for the name of an element around it.
    """
    soft: set[int] = set()
    while True:
        found = blocks(page or "", frozenset(soft))
        keep = label(found)
        held: dict[int, int] = {}
        for b in found:
            if b.element.named and b.element.named not in soft:
                held[b.element.named] = held.get(b.element.named, 0) + len(b.text)
        if any(keep) or 4 * max(held.values(), default=0) < max(1, sum(len(b.text) for b in found)):
            return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)
        soft.add(max(held, key=lambda n: (held[n], -n)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of each row of (page_id, url, html).

    Repeated rows stay; null ids and urls stay null. Empty table: empty result. Other columns are ignored.
    """

    def run(it):
        for batch in (part for whole in it for part in slices(whole, "html")):
            texts = [main_text(p) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    return rows.mapInArrow(lean(run), "page_id long, url string, text string, n_chars long")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the main text of every row of `pages`."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
