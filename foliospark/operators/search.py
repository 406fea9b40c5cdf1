"""Matcher trees compiled to one plan: every leaf is a Boolean column of the caller's bookmarks.

Facts of other tables (tags, lists, feeds, assets) are sets of ids. What every result must meet (a lone leaf, the parts of
an `and` at the top) becomes a semi or anti join with its set; below an `or` a set comes in as a Boolean column by one
left join with its de-duplicated ids. Ids never reach the driver and Catalyst sees the whole tree. A leaf that isn't
known counts as false.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.query_language import Age, Both, Leaf, age_limit, parse

#: Smart lists visited in one evaluation at most.
MOST_LISTS = 30


@dataclass
class Library:
    """One caller's tables. links, texts and assets share the bookmark's id; all ids are opaque."""

    bookmarks: DataFrame  # id, type, archived, favourited, createdAt, title, source
    links: DataFrame | None = None  # id, url, title, crawlStatus, crawlStatusCode
    assets: DataFrame | None = None  # id, sourceUrl
    tags: DataFrame | None = None  # id, name
    tags_on: DataFrame | None = None  # bookmarkId, tagId, attachedBy
    lists: DataFrame | None = None  # id, name, type, query
    in_lists: DataFrame | None = None  # bookmarkId, listId
    feeds: DataFrame | None = None  # id, name
    feed_imports: DataFrame | None = None  # bookmarkId, rssFeedId


def contains(column: Column, text: str) -> Column:
    """LIKE with % and _ of the text as wildcards; letters match in either case (all letters, not only ASCII)."""
    return column.ilike("%" + text.replace("\\", "\\\\") + "%")


class Compiler:
    def __init__(self, lib: Library, now: datetime | None = None):
        self.lib = lib
        self.now = now or datetime.now(UTC)
        self.frame = lib.bookmarks
        self.made = 0
        self.visited: set = set()

    def _fact(self, ids: DataFrame) -> Column:
        """A column that is true for the ids of a frame (its one column)."""
        self.made += 1
        name = f"__fact{self.made}"
        ids = ids.toDF(name + "_id").distinct().withColumn(name, F.lit(True))
        self.frame = self.frame.join(ids, self.frame["id"] == ids[name + "_id"], "left").drop(name + "_id")
        return F.coalesce(F.col(name), F.lit(False))

    def _link(self, *columns: str) -> list[Column]:
        self.made += 1
        names = [f"__link{self.made}_{c}" for c in columns]
        links = self.lib.links.select(F.col("id").alias(f"__link{self.made}"), *[F.col(c).alias(n) for c, n in zip(columns, names, strict=True)])
        self.frame = self.frame.join(links, self.frame["id"] == links[f"__link{self.made}"], "left")
        return [F.col(f"__link{self.made}"), *map(F.col, names)]

    def _set(self, m: Leaf) -> tuple[DataFrame, bool] | None:
        """The ids that a leaf asks of another table, and whether they are those that don't match; None for other leaves."""
        no, lib = m.negated, self.lib
        if m.kind == "tag":
            own = lib.tags.filter(F.col("name") == m.value).select(F.col("id").alias("tagId"))
            return lib.tags_on.join(own, "tagId", "left_semi").select("bookmarkId"), no
        if m.kind == "tagged":
            return lib.tags_on.select("bookmarkId"), no
        if m.kind == "in_list":
            return lib.in_lists.select("bookmarkId"), no
        if m.kind == "feed":
            own = lib.feeds.filter(F.col("name") == m.value).select(F.col("id").alias("rssFeedId"))
            return lib.feed_imports.join(own, "rssFeedId", "left_semi").select("bookmarkId"), no
        if m.kind == "url":  # of links and of assets; a text bookmark matches neither this nor its opposite
            there = lambda c: ~contains(F.col(c), m.value) if no else contains(F.col(c), m.value)
            ids = lib.links.filter(there("url")).select("id")
            return (ids if lib.assets is None else ids.union(lib.assets.filter(there("sourceUrl")).select("id"))), False
        return None

    def _named_lists(self, name: str, no: bool) -> Column:
        """Every list of the name: manual members, and what smart lists find. No list of the name: nothing, negated or not.

        Only the queries of smart lists come to the driver, where they are parsed.
        """
        named = self.lib.lists.filter(F.col("name") == name)
        if named.isEmpty():
            return F.lit(False)
        manual = named.filter("type <> 'smart'").select(F.col("id").alias("listId"))
        inside = [self._fact(self.lib.in_lists.join(manual, "listId", "left_semi").select("bookmarkId"))]
        inside += [self.smart(r.id, r.query) for r in named.filter("type = 'smart'").select("id", "query").limit(MOST_LISTS + 1).collect()]
        any_ = reduce(Column.__or__, inside)
        return ~any_ if no else any_

    def required(self, m: Leaf | Both) -> Column | None:
        """Cuts the frame to what a matcher at the top finds; returns what is left to filter by."""
        if isinstance(m, Both) and m.op == "and":
            rest = [c for c in map(self.required, m.parts) if c is not None]
            return reduce(Column.__and__, rest) if rest else None
        found = self._set(m) if isinstance(m, Leaf) else None
        if found is None:
            return self.column(m)
        self.made += 1
        ids = found[0].toDF(f"__set{self.made}")
        self.frame = self.frame.join(ids, self.frame["id"] == ids[f"__set{self.made}"], "left_anti" if found[1] else "left_semi")
        return None

    def smart(self, list_id, query: str) -> Column:
        """A saved query. One that is being visited already adds nothing; text without a matcher finds nothing."""
        if list_id in self.visited or len(self.visited) >= MOST_LISTS:
            return F.lit(False)
        parsed = parse(query)
        if parsed.result != "full":
            raise ValueError(f"the query of list {list_id} can't be read: {query}")
        if parsed.matcher is None:
            return F.lit(False)
        self.visited.add(list_id)
        try:
            return self.column(parsed.matcher)
        finally:
            self.visited.discard(list_id)

    def column(self, m: Leaf | Both) -> Column:
        if isinstance(m, Both):
            return reduce(Column.__and__ if m.op == "and" else Column.__or__, map(self.column, m.parts))
        return F.coalesce(self._leaf(m), F.lit(False))

    def _leaf(self, m: Leaf) -> Column:
        no = m.negated
        flip = lambda c: ~c if no else c
        if m.kind in ("archived", "favourited"):
            return F.col(m.kind) == F.lit(not no)
        if m.kind == "type":
            return flip(F.col("type") == m.value)
        if m.kind == "source":
            return ~F.col("source").eqNullSafe(m.value) if no else F.col("source") == m.value
        if m.kind == "after":
            return F.col("createdAt") < F.lit(m.value) if no else F.col("createdAt") >= F.lit(m.value)
        if m.kind == "before":
            return F.col("createdAt") > F.lit(m.value) if no else F.col("createdAt") <= F.lit(m.value)
        if m.kind == "age":
            age: Age = m.value
            limit = F.lit(age_limit(age, self.now))
            return F.col("createdAt") >= limit if age.newer else F.col("createdAt") < limit
        if m.kind == "list":
            return self._named_lists(m.value, no)
        if (found := self._set(m)) is not None:
            there = self._fact(found[0])
            return ~there if found[1] else there
        if m.kind == "title":
            _, title = self._link("title")
            own, linked = contains(F.col("title"), m.value), contains(title, m.value)
            if no:
                return F.coalesce(~own, F.lit(True)) & F.coalesce(~linked, F.lit(True))
            return F.coalesce(own, F.lit(False)) | F.coalesce(linked, F.lit(False))
        if m.kind == "broken":  # the opposite is a crawl that went well, not the rest
            there, status, code = self._link("crawlStatus", "crawlStatusCode")
            if no:
                return there.isNotNull() & (status == "success") & code.between(200, 299)
            return there.isNotNull() & ((status == "failure") | (code < 200) | (code > 299))
        raise ValueError(f"no such matcher: {m.kind}")


def matching(lib: Library, matcher: Leaf | Both, now: datetime | None = None) -> DataFrame:
    """The ids of the bookmarks that a matcher finds."""
    compiler = Compiler(lib, now)
    found = compiler.required(matcher)
    return (compiler.frame if found is None else compiler.frame.filter(found)).select("id")


def find(lib: Library, query: str, now: datetime | None = None) -> DataFrame:
    """The ids that a query's matcher finds; all of them for a query of free text."""
    parsed = parse(query)
    return matching(lib, parsed.matcher, now) if parsed.matcher is not None else lib.bookmarks.select("id")


def full_text(docs: DataFrame, query: str, id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id and BM25 score of the texts that have every term of the query."""
    terms = sorted(set(query.lower().split()))
    words = docs.select(F.col(id_col).alias("id"), F.filter(F.split(F.lower(F.coalesce(text_col, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("words"))
    times = lambda term: F.size(F.filter("words", lambda w: w == F.lit(term)))
    counts = [times(t).alias(f"tf{k}") for k, t in enumerate(terms)]
    rows = words.select("id", F.size("words").alias("len"), *counts)
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean"), *[F.count_if(F.col(f"tf{k}") > 0).alias(f"df{k}") for k in range(len(terms))])
    part = lambda k: F.log(1 + (F.col("n") - F.col(f"df{k}") + 0.5) / (F.col(f"df{k}") + 0.5)) * F.col(f"tf{k}") * (k1 + 1) / (F.col(f"tf{k}") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    every = reduce(Column.__and__, [F.col(f"tf{k}") > 0 for k in range(len(terms))], F.lit(True))
    return rows.crossJoin(F.broadcast(stats)).filter(every).select("id", reduce(Column.__add__, [part(k) for k in range(len(terms))], F.lit(0.0)).alias("score"))  # stats is one row
