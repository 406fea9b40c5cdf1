"""The search language: text to a matcher tree, on the driver.

A query is a row of terms separated by white space, ``and`` or ``or`` (one precedence level, from left to right), with
parentheses. A term is a qualifier (``is: url: list: after: before: age: feed: title: tag: source:`` or ``#``) with a
word or a quoted string, negated by ``-`` or ``!``, or free text. Unknown ``is:`` words, dates and sources that can't
be read are free text. Free text takes part in no matcher, so ``#a or foo`` is the matcher ``#a`` with the text ``foo``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta

#: Where a bookmark can come from.
SOURCES = ("api", "web", "cli", "mobile", "extension", "singlefile", "rss", "import")
FLAGS = {"fav": "favourited", "archived": "archived", "tagged": "tagged", "inlist": "in_list", "broken": "broken"}
TYPES = {"link": "link", "text": "text", "media": "asset"}
NAMED = {"url:": "url", "title:": "title", "#": "tag", "tag:": "tag", "list:": "list", "feed:": "feed"}

LEXER = re.compile(
    r"""(?P<and>\s+[aA][nN][dD])|(?P<or>\s+[oO][rR])|(?P<hash>\#)|(?P<qualifier>(?:is|url|list|after|before|age|feed|title|tag|source):)
    |(?P<string>"[^"]+")|(?P<open>\()|(?P<close>\))|(?P<space>\s+)|(?P<minus>[-!])|(?P<word>[^ )(]+)""".replace("\n    ", "")
)


@dataclass(frozen=True)
class Leaf:
    """One condition; `negated` asks for its opposite."""

    kind: str
    value: object = None
    negated: bool = False


@dataclass(frozen=True)
class Both:
    op: str  # and, or
    parts: tuple = ()


@dataclass(frozen=True)
class Age:
    newer: bool
    amount: int
    unit: str


@dataclass
class Parsed:
    result: str  # full, partial, invalid
    text: str
    matcher: Leaf | Both | None = None


@dataclass
class _State:
    tokens: list[tuple[str, str]]
    at: int = 0
    stack: list = field(default_factory=list)

    def kind(self, ahead: int = 0) -> str:
        return self.tokens[self.at + ahead][0] if self.at + ahead < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]


def tokens(query: str) -> list[tuple[str, str]]:
    return [(m.lastgroup, m.group()) for m in LEXER.finditer(query)]


def parse_date(text: str) -> datetime | None:
    for form in ("%Y", "%Y-%m"):
        try:
            return datetime.strptime(text, form).replace(tzinfo=UTC)
        except ValueError:
            pass
    try:
        when = datetime.fromisoformat(text)
    except ValueError:
        return None
    return when if when.tzinfo else when.replace(tzinfo=UTC)


def parse_age(text: str) -> Age | None:
    m = re.fullmatch(r"([<>])(\d+)([dwmy])", text)
    return Age(m[1] == "<", int(m[2]), m[3]) if m else None


def age_limit(age: Age, now: datetime) -> datetime:
    """The moment that an age counts back to; months and years by the calendar, with the overflow of short months going on."""
    if age.unit in "dw":
        return now - timedelta(days=age.amount * (7 if age.unit == "w" else 1))
    months = now.year * 12 + now.month - 1 - age.amount * (12 if age.unit == "y" else 1)
    return now.replace(year=months // 12, month=months % 12 + 1, day=1) + timedelta(days=now.day - 1)


def _qualified(sign: str, name: str, value: str) -> tuple[str, Leaf | None]:
    """Free text and matcher of a qualifier with its value."""
    no = bool(sign)
    if name == "is:":
        if value in FLAGS:
            return "", Leaf(FLAGS[value], None, no)
        if value in TYPES:
            return "", Leaf("type", TYPES[value], no)
    elif name in NAMED:
        return "", Leaf(NAMED[name], value, no)
    elif name == "source:" and value in SOURCES:
        return "", Leaf("source", value, no)
    elif name in ("after:", "before:") and (when := parse_date(value)):
        return "", Leaf(name[:-1], when, no)
    elif name == "age:" and (age := parse_age(value)):
        return "", Leaf("age", age)  # a sign before an age has no effect
    return sign + name + value, None


def _term(s: _State) -> tuple[str, Leaf | Both | None] | None:
    start = s.at
    sign = s.take() if s.kind() == "minus" else ""
    if s.kind() in ("qualifier", "hash"):
        if s.kind(1) == "word" or (s.kind(1) == "string"):
            name, quoted = s.take(), s.kind() == "string"
            value = s.take()
            if name == "is:" and quoted:
                return sign + name + value[1:-1], None
            return _qualified(sign, name, value[1:-1] if quoted else value)
    if not sign:
        if s.kind() in ("word", "qualifier"):
            return s.take(), None
        if s.kind() == "open":
            s.take()
            inner = _terms(s)
            if inner and s.kind() == "close":
                s.take()
                return inner
    s.at = start
    return None


def _terms(s: _State) -> tuple[str, Leaf | Both | None] | None:
    left = _term(s)
    while left:
        start, op = s.at, "and"
        if s.kind() in ("and", "or") and s.kind(1) == "space":
            op = s.kind()
            s.at += 2
        elif s.kind() == "space":
            s.at += 1
        else:
            break
        right = _term(s)
        if not right:
            s.at = start
            break
        parts = tuple(m for m in (left[1], right[1]) if m is not None)
        left = f"{left[0]} {right[0]}".strip(), Both(op, parts) if parts else None
    return left


def flatten(m: Leaf | Both) -> Leaf | Both:
    """Nested parts of one operator become one; a single part stands for itself."""
    if isinstance(m, Leaf):
        return m
    if len(m.parts) == 1:
        return flatten(m.parts[0])
    parts: list = []
    for p in map(flatten, m.parts):
        parts += p.parts if isinstance(p, Both) and p.op == m.op else (p,)
    return Both(m.op, tuple(parts))


def parse(query: str) -> Parsed:
    """What a query means; what can't be read goes to the text."""
    s = _State(tokens(query.strip()))
    found = _terms(s)
    if not found:
        return Parsed("invalid", query)
    text, matcher = found
    rest = "".join(t for _, t in s.tokens[s.at :])
    return Parsed("partial" if rest else "full", (text + rest).strip() if rest else text, flatten(matcher) if matcher else None)
