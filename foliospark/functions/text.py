"""Text functions: tags, HTML, CJK-aware sizes, hashes. Built-in expressions unless a rule is sequential."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CJK = r"[぀-ヿ㐀-䶿一-鿿가-힯＀-￯]"


def tag_key(c: Column) -> Column:
    """Lower case without space, hyphen and underscore."""
    return F.lower(F.translate(c, " -_", ""))


def tag_key_loose(c: Column) -> Column:
    """The clean-up view's key: everything from U+0020 to U+005F goes after lower-casing, digits and most signs too."""
    return F.regexp_replace(F.lower(c), r"[\x20-\x5F]", "")


def without_hash(c: Column) -> Column:
    return F.regexp_replace(c, r"^#+", "")


#: Signs of HTML and their references, in the order of replacement.
ESCAPES = (("&", "&amp;"), ("'", "&#x27;"), ("`", "&#x60;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"))


def escape_html(c: Column) -> Column:
    for sign, name in ESCAPES:
        c = F.replace(c, F.lit(sign), F.lit(name))
    return c


def html_text(c: Column) -> Column:
    """Plain text of simple HTML by patterns: scripts, styles and tags go, the common references are read."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for name, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(name), F.lit(sign))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def hrefs(c: Column) -> Column:
    """Targets of the anchors of a page, in order."""
    return F.regexp_extract_all(c, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']+)["']"""), F.lit(1))


def cjk_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(CJK))


def token_estimate(c: Column) -> Column:
    """1.5 tokens for a CJK character, 0.35 for any other, rounded up."""
    n = cjk_count(c)
    return F.ceil(n * F.lit(1.5) + (F.length(c) - n) * F.lit(0.35))


def truncate_to(text: str, budget: int) -> str:
    """The longest beginning whose token estimate stays within the budget."""
    dense = np.fromiter(map(bool, map(re.compile(CJK).match, text)), bool, len(text))
    cost = np.ceil(np.cumsum(dense) * 1.5 + np.cumsum(~dense) * 0.35 - 1e-9)
    return text[: int(np.searchsorted(cost, budget, "right"))]


def truncated(c: Column, budget: int) -> Column:
    """truncate_to as a column."""

    @F.pandas_udf(T.StringType())
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else truncate_to(t, budget))

    return cut(c)


class _Plain(HTMLParser):
    """Text of a page by blocks: paragraphs and headings apart by an empty line, list items and lines by one end; addresses of links in brackets."""

    GAP = {"p": 2, "h1": 2, "h2": 2, "h3": 2, "h4": 2, "h5": 2, "h6": 2, "blockquote": 2, "ul": 2, "ol": 2, "table": 2, "pre": 2, "div": 1, "li": 1, "tr": 1, "section": 1, "article": 1, "br": 1, "header": 1, "footer": 1, "main": 1, "nav": 1, "aside": 1}
    SILENT = {"script", "style", "head", "title", "noscript", "template"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.gap, self.silent, self.space, self.links = 0, 0, False, []

    def block(self, tag):
        self.gap, self.space = max(self.gap, self.GAP[tag]), False

    def say(self, text):
        if self.gap and self.out:
            self.out.append("\n" * self.gap)
        elif self.space and self.out:
            self.out.append(" ")
        self.gap, self.space = 0, False
        self.out.append(text)

    def handle_starttag(self, tag, attrs):
        self.silent += tag in self.SILENT
        if tag in self.GAP:
            self.block(tag)
        if tag == "li":
            self.say(" * ")
        elif tag == "a":
            self.links.append((dict(attrs).get("href") or "", len(self.out)))

    def handle_endtag(self, tag):
        self.silent -= tag in self.SILENT and self.silent > 0
        if tag == "a" and self.links:
            href, at = self.links.pop()
            if href and "".join(self.out[at:]).strip() not in ("", href):
                self.space = True
                self.say(f"[{href}]")
        if tag in self.GAP and tag != "br":
            self.block(tag)

    def handle_data(self, data):
        words = data.split()
        if self.silent or not words:
            self.space |= bool(data) and not self.silent
            return
        self.space |= data[0].isspace() and bool(self.out) and not self.out[-1].endswith(" ")
        self.say(" ".join(words))
        self.space = data[-1].isspace()


def html_plain_text(page: str | None) -> str:
    """Readable text of a page by its elements; images, scripts and styles have none."""
    reader = _Plain()
    reader.feed(page or "")
    reader.close()
    return "".join(reader.out).strip()


@F.pandas_udf(T.StringType())
def html_plain(c: pd.Series) -> pd.Series:
    return c.map(html_plain_text)


def string_hash(text: str) -> int:
    """31 h + c over UTF-16 units in 32 bits, without its sign."""
    h = 0
    raw = text.encode("utf-16-le")
    for k in range(0, len(raw), 2):
        h = (31 * h + raw[k] + 256 * raw[k + 1]) & 0xFFFFFFFF
    return abs(h - (1 << 32) if h >> 31 else h)


@F.pandas_udf(T.LongType())
def hash_of(c: pd.Series) -> pd.Series:
    return c.map(string_hash)


def jitter_minutes(c: Column, period: int = 60) -> Column:
    """A feed's own minute within the period."""
    return F.pmod(hash_of(c), F.lit(period))


def page_signals(html: Column, host: Column) -> dict[str, Column]:
    """Length of the text, links to other hosts for each paragraph, and advertising scripts of a page."""
    text = F.length(html_text(html))
    own = F.concat(F.lit("://"), host)
    out = F.size(F.filter(hrefs(html), lambda x: x.rlike(r"^https?://") & ~F.contains(x, own)))
    paragraphs = F.greatest(F.regexp_count(html, F.lit(r"(?i)<p\b")), F.lit(1))
    ads = F.regexp_count(html, F.lit(r"(?i)<script\b[^>]*(?:doubleclick|googlesyndication|adservice|taboola|outbrain)"))
    return {"text_length": text, "outbound": out, "outbound_ratio": out / paragraphs, "ad_scripts": ads}


def quality_reason(text_length: Column, ratio: Column, ads: Column, least: int = 400, most_ratio: float = 2.5, most_ads: int = 20) -> Column:
    """Why a page isn't worth reading; null if nothing speaks against it."""
    return F.when(text_length < least, "short").when(ratio > most_ratio, "links").when(ads > most_ads, "ads")


def on_list(host: Column, hosts: list[str]) -> Column:
    """Whether a host or a domain above it is listed."""
    low = F.lower(host)
    return F.exists(F.array(*[F.lit(h) for h in hosts]).cast("array<string>"), lambda h: (low == h) | low.endswith(F.concat(F.lit("."), h)))


def screen(host: Column, recent: Column, reason: Column, hosts: list[str]) -> Column:
    """First reason against a domain: listed, fewer than three articles in the window, then the page's own."""
    return F.coalesce(F.when(on_list(host, hosts), "blocked"), F.when(recent < 3, "inactive"), reason)


def embedding_text(title: Column, summary: Column, body: Column) -> Column:
    """Title, summary and body in paragraphs, white space unified; the body is shorter where a fifth is CJK. Null without any text."""
    clean = lambda c, n: F.nullif(F.rtrim(F.substring(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")), 1, n)), F.lit(""))
    whole = F.trim(F.regexp_replace(F.coalesce(body, F.lit("")), r"\s+", " "))
    dense = cjk_count(whole) >= F.length(whole) * 0.2
    parts = [clean(title, 300), clean(summary, 600), F.when((F.length(whole) > 0) & dense, clean(whole, 1200)).otherwise(clean(whole, 1500))]
    return F.nullif(F.concat_ws("\n\n", *parts), F.lit(""))


def is_challenge(title: Column, html: Column, titles: list[str], markers: list[str], most: int = 20_000) -> Column:
    """A bot check that came with status 200: an exact title, or a marker in a page of a check's size."""
    small = F.length(html) <= most
    marked = F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(html), m))
    return F.coalesce(F.lower(F.trim(title)).isin(titles), F.lit(False)) | F.coalesce(small & marked, F.lit(False))


def preferred(render: Column, probe: Column, blocked: Column) -> Column:
    """The rendered value, or the probe's where the render was blocked; the other fills gaps. Empty counts as none."""
    r, p = F.nullif(render, F.lit("")), F.nullif(probe, F.lit(""))
    return F.when(blocked, F.coalesce(p, r)).otherwise(F.coalesce(r, p))


def chunk_problems(source: Column, out: Column, to_cjk: bool) -> Column:
    """What is wrong with a translated piece: the same words again, the old language, other tags."""
    prose = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style|code|pre|kbd)[^>]*>.*?</\1>", " "), r"<[^>]+>", " "), r"\s+", " "))
    share = lambda c: cjk_count(c) / F.greatest(F.length(F.regexp_replace(c, r"\s", "")), F.lit(1))
    a, b = prose(source), prose(out)
    tags = lambda c: F.regexp_count(c, F.lit(r"<[^>]+>"))
    echo = (F.length(a) > 100) & (a == b)
    old = F.lit(to_cjk) & (F.length(a) > 200) & (share(a) < 0.1) & (share(b) < 0.05)
    return F.array_compact(F.array(F.when(echo, "echo").when(old, "language"), F.when(F.abs(tags(source) - tags(out)) > 2, "tags")))


VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)\s*([a-zA-Z0-9-]*)[^>]*?(/?)>", re.S)


def html_pieces(html: str, most: int) -> list[str]:
    """Pieces of about `most` characters that add up to the input; cuts fall between elements, or after a tag inside large ones."""
    cuts, depth = [0], 0
    for m in MARKUP.finditer(html):
        if m[2] and m[1]:
            depth = max(0, depth - 1)
        elif m[2] and not m[3] and m[2].lower() not in VOID:
            depth += 1
        if not depth:
            cuts.append(m.end())
    cuts.append(len(html))
    out: list[str] = []
    held = ""
    for a, b in zip(cuts, cuts[1:], strict=False):
        part = html[a:b]
        if held and len(held) + len(part) > most:
            out.append(held)
            held = ""
        if len(part) <= most:
            held += part
            continue
        while part:
            end = min(most, len(part))
            if end < len(part):
                before = part.rfind(">", 0, end + 1)
                after = part.find(">", end)
                end = before + 1 if before > 0 else after + 1 if after >= 0 else len(part)
            out.append(part[:end])
            part = part[end:]
    return [*out, held] if held else out


def robots_rules(rules: str, agent: str) -> tuple[list[tuple[str, bool]], float | None]:
    """The rules (path, allowed) and the crawl delay of an agent's group in a robots file, else of the group for all."""
    lines = [line.split("#", 1)[0].partition(":") for line in (rules or "").splitlines()]
    fields = [(name.strip().lower(), value.strip()) for name, colon, value in lines if colon]
    found: dict[str, tuple[list, list]] = {}
    heads: list[str] = []
    for k, (name, value) in enumerate(fields):
        if name == "user-agent":
            heads = [*(heads if k and fields[k - 1][0] == "user-agent" else []), value.lower()]
            found.setdefault(value.lower(), ([], []))
        for own, delays in (found[h] for h in heads):
            if name in ("allow", "disallow") and value:
                own.append((value, name == "allow"))
            elif name == "crawl-delay" and re.fullmatch(r"\d+(\.\d+)?", value):
                delays.append(float(value))
    own, delays = found.get(agent.lower(), found.get("*", ([], [])))
    return own, delays[-1] if delays else None


def robots_allow(rules: str, agent: str, path: str) -> bool:
    """Whether a robots file lets an agent fetch a path: the longest matching rule of its group wins; allow on a tie."""
    return max(((len(p), ok) for p, ok in robots_rules(rules, agent)[0] if path.startswith(p)), default=(0, True))[1]


def robots(rules: Column, path: Column, agent: str) -> Column:
    """struct<allowed boolean, delay double> of a path under a robots file."""

    @F.pandas_udf("allowed boolean, delay double")
    def judge(files: pd.Series, paths: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"allowed": [robots_allow(r or "", agent, p or "/") for r, p in zip(files, paths, strict=True)], "delay": [robots_rules(r or "", agent)[1] for r in files]}).astype({"delay": "float64"})

    return judge(rules, path)


def salvaged_objects(raw: str) -> list[dict]:
    """All JSON objects that a garbled answer holds whole, inner ones before the outer."""
    found, starts, quoted, skip = [], [], False, False
    for i, ch in enumerate(raw):
        if skip:
            skip = False
        elif quoted:
            skip, quoted = ch == "\\", ch != '"'
        elif ch == '"':
            quoted = True
        elif ch == "{":
            starts.append(i)
        elif ch == "}" and starts:
            try:
                found.append(json.loads(raw[starts.pop() : i + 1]))
            except ValueError:
                continue
    return found


#: Keys of an item of a batch answer.
ITEM = ("title_ja", "summary_ja")


def _digest(item) -> tuple[str, str | None] | None:
    """(title, summary or None) of one answered item; None if a text is missing or the title is empty."""
    texts = [item.get(k) for k in ITEM] if isinstance(item, dict) else [None]
    if not all(isinstance(x, str) for x in texts):
        return None
    title, summary = (x.strip() for x in texts)
    return (title, summary or None) if title else None


def _number(item) -> int | None:
    value = item.get("id") if isinstance(item, dict) else None
    if isinstance(value, bool):
        return None
    return value if isinstance(value, int) else int(value) if isinstance(value, str) and value.strip().isdecimal() else None


def _between(raw: str, first: str, last: str):
    """The JSON value from the first to the last bracket of a kind, or None."""
    a, z = raw.find(first), raw.rfind(last)
    try:
        return json.loads(raw[a : z + 1]) if 0 <= a < z else None
    except ValueError:
        return None


def digests(raw: str | None) -> dict[int, tuple[str, str | None]]:
    """Items of a batch answer by number: a list, an object with a list in it, an object by numbers, or what can be saved of a garbled one.

    A list's items without a number count from 1; of a garbled answer only items with a number are taken.
    """
    raw = (raw or "").strip()
    shapes = sorted((("{", "}"), ("[", "]")), key=lambda s: raw.find(s[0]) if s[0] in raw else len(raw))
    value = next((v for v in (_between(raw, *s) for s in shapes) if v is not None), None)
    while isinstance(value, dict) and (inner := next((v for v in value.values() if isinstance(v, list)), None)) is not None:
        value = inner
    if isinstance(value, list):
        items = [(n if (n := _number(x)) is not None else k, x) for k, x in enumerate(value, 1)]
    else:
        items = [(int(k), v) for k, v in value.items() if k.isdecimal()] if isinstance(value, dict) else []
    for found in (items, [(_number(x), x) for x in salvaged_objects(raw)]):
        out = {n: d for n, x in found if n is not None and (d := _digest(x))}
        if out:
            return out
    return {}


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("id", T.LongType()), T.StructField("title", T.StringType()), T.StructField("summary", T.StringType())])))
def digest_items(c: pd.Series) -> pd.Series:
    """digests as a column, by number."""
    return c.map(lambda raw: [{"id": n, "title": t, "summary": s} for n, (t, s) in sorted(digests(raw).items())])


def one_line(c: Column) -> Column:
    """White space unified; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def shortened_text(c: Column, most: int) -> Column:
    """At most so many characters, the last one an ellipsis where something is cut."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


#: Characters of an embedding text, of its content excerpt and of metadata.
PROFILE_CHARS, EXCERPT_CHARS, METADATA_CHARS = 8000, 3000, 800


def bookmark_profile(b: dict[str, Column], most: int = PROFILE_CHARS) -> Column:
    """The text that a bookmark is embedded by: labelled lines of what is there, the content last, in paragraphs.

    b: columns title, type, tags (array), summary, note; of links url, linkTitle, description, author, publisher,
    published (a date), content; of texts sourceUrl, text; of assets sourceUrl, fileName, assetType, metadata (JSON), content.
    Columns that aren't given count as null.
    """
    col = lambda n, t="string": b.get(n, F.lit(None)).cast(t)
    is_ = lambda t: col("type") == t
    labelled = lambda name, c: F.concat(F.lit(f"{name}: "), one_line(c))
    host = lambda c: F.nullif(F.lower(F.regexp_extract(c, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))
    bare = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[?#].*$", ""), r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/]+)$", "$1/"), r"^\s+|\s+$", "")
    pairs = F.map_entries(F.from_json(col("metadata"), "map<string,string>"))
    simple = F.filter(pairs, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^[\[{]"))
    fields = F.nullif(F.array_join(F.transform(simple, lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; "), F.lit(""))
    metadata = shortened_text(one_line(F.coalesce(fields, col("metadata"))), METADATA_CHARS)
    budget = max(500, min(EXCERPT_CHARS, int(most * 0.4)))
    content = F.when(is_("text"), col("text")).otherwise(col("content"))
    tags = F.array_join(F.sort_array(b["tags"]), ", ") if "tags" in b else F.lit(None).cast("string")
    other_title = F.when(~one_line(col("linkTitle")).eqNullSafe(one_line(col("title"))), col("linkTitle"))
    parts = [
        labelled("Title", col("title")), F.concat(F.lit("Type: "), col("type")), labelled("Tags", tags), labelled("Summary", col("summary")), labelled("Note", col("note")),
        *[F.when(is_("link"), c) for c in (
            labelled("Domain", host(col("url"))), labelled("URL", bare(col("url"))), labelled("Page title", other_title), labelled("Description", col("description")), labelled("Author", col("author")),
            labelled("Publisher", col("publisher")), labelled("Published", F.date_format(col("published", "timestamp"), "yyyy-MM-dd")),
        )],
        *[F.when(~is_("link"), c) for c in (labelled("Source URL", bare(col("sourceUrl"))), labelled("Source domain", host(col("sourceUrl"))))],
        *[F.when(is_("asset"), c) for c in (labelled("File name", col("fileName")), labelled("Asset type", col("assetType")), labelled("Metadata", metadata))],
        F.concat(F.lit("Content excerpt: "), shortened_text(one_line(content), budget)),
    ]
    return F.substring(F.nullif(F.concat_ws("\n\n", *parts), F.lit("")), 1, most)


def first_asset(assets: Column, kind: str) -> Column:
    """Id of the first of a bookmark's assets (array<struct<id, assetType>>) of a kind, or null."""
    return F.try_element_at(F.filter(assets, lambda a: a["assetType"] == kind), F.lit(1))["id"]
