"""Readers of bookmark exports, feeds and captured API answers, and writers of the library's own formats.

Every import reader gives the columns of ROW. Times are seconds since 1970, null where a file has none.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "title string, contentType string, url string, text string, tags array<string>, addDate double, notes string, archived boolean, paths array<array<string>>, listExternalIds array<string>"
NO_TAGS, NO_PATHS = "array<string>", "array<array<string>>"


def row(**columns: Column) -> list[Column]:
    """The columns of ROW in order; what isn't given is empty."""
    defaults = {"tags": F.array().cast(NO_TAGS), "paths": F.array().cast(NO_PATHS)}
    types = dict(p.rsplit(" ", 1) for p in ROW.split(", "))
    return [columns.get(n, defaults.get(n, F.lit(None))).cast(t).alias(n) for n, t in types.items()]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def filled(c: str | Column) -> Column:
    """A trimmed text, null if nothing is left."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def split_tags(c: Column, sign: str) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), sign), lambda t: F.trim(t)), lambda t: t != "")


def seconds(c: Column, form: str | None = None) -> Column:
    when = F.try_to_timestamp(c, F.lit(form)) if form else F.try_to_timestamp(c)
    return F.unix_micros(when) / 1e6


class _Folders(HTMLParser):
    """Walks the nested definition lists of a browser export."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple] = []
        self.path: list[str] = []
        self.pending: str | None = None
        self.depth: list[bool] = []
        self.open: dict | None = None
        self.text: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "dl":
            self.depth.append(self.pending is not None)
            if self.pending is not None:
                self.path.append(self.pending)
                self.pending = None
        elif tag in ("h3", "a"):
            self.text, self.open = [], (a if tag == "a" else None)

    def handle_data(self, data):
        if self.text is not None:
            self.text.append(data)

    def handle_endtag(self, tag):
        if tag == "dl" and self.depth:
            if self.depth.pop():
                self.path.pop()
        elif tag == "h3" and self.text is not None:
            self.pending, self.text = "".join(self.text).strip(), None
        elif tag == "a" and self.open is not None:
            a, title = self.open, "".join(self.text or []).strip()
            date = a.get("add_date") or ""
            tags = [t.strip() for t in (a.get("tags") or "").split(",") if t.strip()]
            self.rows.append((title, "link" if a.get("href") else None, a.get("href"), None, tags, float(date) if re.fullmatch(r"\d+(\.\d+)?", date) else None, None, None, [list(self.path)] if self.path else [], None))
            self.open = self.text = None


def browser_html(spark: SparkSession, path: str) -> DataFrame:
    """Browser bookmark files: folders become paths."""

    def run(it):
        for pdf in it:
            for text in pdf["value"]:
                p = _Folders()
                p.feed(text or "")
                yield pd.DataFrame(p.rows, columns=[c.split(" ")[0] for c in ROW.split(", ")])

    return spark.read.text(path, wholetext=True).mapInPandas(run, ROW)


def pipe_csv(spark: SparkSession, path: str) -> DataFrame:
    """title, url, time_added, tags (by |), status."""
    return read_csv(spark, path).select(*row(title=F.col("title"), contentType=F.lit("link"), url=F.col("url"), tags=split_tags(F.col("tags"), r"\|"), addDate=F.col("time_added").try_cast("double"), archived=F.col("status") == "archive"))


def queue_csv(spark: SparkSession, path: str) -> DataFrame:
    """Title, URL, Tags (by ;), Last Interaction Date, In Queue ("False": archived)."""
    return read_csv(spark, path).select(*row(title=F.col("Title"), contentType=F.lit("link"), url=F.col("URL"), tags=split_tags(F.col("Tags"), ";"), addDate=seconds(F.col("`Last Interaction Date`")), archived=F.col("`In Queue`") == "False"))


def folder_csv(spark: SparkSession, path: str) -> DataFrame:
    """URL, Title, Selection, Folder, Timestamp, Tags (a JSON array; what isn't one is empty). Folders other than Unread and Archive are paths."""
    folder = F.col("Folder")
    path_ = F.when(folder.isNotNull() & ~folder.isin("Unread", "Archive", "Starred"), F.array(F.array(folder))).otherwise(F.array().cast(NO_PATHS))
    tags = F.coalesce(F.from_json(F.col("Tags"), "array<string>"), F.array().cast(NO_TAGS))
    return read_csv(spark, path).select(*row(title=F.col("Title"), contentType=F.lit("link"), url=F.col("URL"), notes=filled("Selection"), tags=tags, addDate=F.col("Timestamp").try_cast("double"), archived=folder == "Archive", paths=path_))


def reader_csv(spark: SparkSession, path: str) -> DataFrame:
    """Title, URL, Document tags (a list in single quotes), Saved date, Location; feeds and rows without a URL are left out."""
    quoted = F.regexp_replace(F.coalesce(F.col("`Document tags`"), F.lit("[]")), r"(?<=[\[,\s])'|'(?=[\],])", '"')
    tags = F.coalesce(F.from_json(quoted, "array<string>"), F.array().cast(NO_TAGS))
    rows = read_csv(spark, path).filter((F.coalesce(F.col("Location"), F.lit("")) != "feed") & filled("URL").isNotNull())
    return rows.select(*row(title=F.col("Title"), contentType=F.lit("link"), url=F.col("URL"), tags=tags, addDate=seconds(F.col("`Saved date`")), archived=F.col("Location") == "archive"))


def note_csv(spark: SparkSession, path: str) -> DataFrame:
    """title, url, content, note, tags (by ,), created: a URL makes a link, else the content a text."""
    url, text = filled("url"), filled("content")
    return read_csv(spark, path).select(*row(title=F.col("title"), contentType=F.when(url.isNotNull(), "link").when(text.isNotNull(), "text"), url=url, text=F.when(url.isNull(), text), notes=filled("note"), tags=split_tags(F.col("tags"), ","), addDate=seconds(F.col("created"))))


def label_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of title, url, labels, savedAt, state ("Archived")."""
    rows = spark.read.schema("title string, url string, labels array<string>, savedAt string, state string").option("multiLine", True).json(path)
    return rows.select(*row(title=F.col("title"), contentType=F.lit("link"), url=F.col("url"), tags=F.coalesce("labels", F.array().cast(NO_TAGS)), addDate=seconds(F.col("savedAt")), archived=F.col("state") == "Archived"))


def collection_json(spark: SparkSession, path: str) -> DataFrame:
    """Collections with parents: a link's path is its collection's names from the root."""
    from ..operators.analytics import tree_paths

    schema = "collections array<struct<id:long,name:string,parentId:long,links:array<struct<name:string,url:string,tags:array<struct<name:string>>,createdAt:string>>>>"
    found = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("collections").alias("c")).select("c.*")
    sep = "\x1f"
    known = found.select(F.col("id").alias("__up"))  # below a collection that the file doesn't have, a path begins
    nodes = found.join(known, F.col("parentId") == F.col("__up"), "left").select(F.col("id").cast("string").alias("id"), F.col("__up").cast("string").alias("parentId"), F.translate("name", "/", sep).alias("name"))
    paths = tree_paths(nodes, lost_to_root=True)
    paths = paths.select(F.col("id").cast("long").alias("id"), F.transform(F.split("path", "/"), lambda p: F.translate(p, sep, "/")).alias("path"))
    links = found.select("id", "name", F.explode("links").alias("l")).join(paths, "id", "left")
    at = F.array(F.coalesce("path", F.array("name")))
    return links.select(*row(title=F.col("l.name"), contentType=F.lit("link"), url=F.col("l.url"), tags=F.transform("l.tags", lambda x: x["name"]), addDate=seconds(F.col("l.createdAt")), paths=at))


def session_json(spark: SparkSession, path: str) -> DataFrame:
    """Sessions of windows of tabs: the latest session only, of equal dates the later in the file. A session of several files is that of their latest date."""
    sessions = "array<struct<date:double,windows:map<string,map<string,struct<url:string,title:string,lastAccessed:double>>>>>"
    text = spark.read.text(path, wholetext=True)
    latest = text.select(F.from_json("value", "array<struct<date:double>>").alias("s")).agg(F.max(F.array_max(F.transform("s", lambda x: x["date"]))).alias("latest"))
    places = F.transform("s", lambda x, i: F.struct(x["date"].alias("date"), i.alias("pos")))
    files = text.select(F.from_json("value", sessions).alias("s")).filter(F.size("s") > 0).select("s", F.array_max(places).alias("last"))
    last = files.join(F.broadcast(latest), F.col("last.date").eqNullSafe(F.col("latest")))  # latest is one row
    tabs = last.select(F.explode(F.map_values(F.get("s", F.col("last.pos"))["windows"])).alias("t")).select(F.explode(F.map_values("t")).alias("t"))
    return tabs.select(*row(title=F.col("t.title"), contentType=F.lit("link"), url=F.col("t.url"), addDate=F.col("t.lastAccessed") / 1000))


def line_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of URL | title; other lines are left out."""
    rows = spark.read.text(path).filter(F.trim("value").rlike(r"^https?://"))
    cut = F.instr("value", " | ")
    url = F.when(cut > 0, F.substring_index("value", " | ", 1)).otherwise(F.col("value"))
    return rows.select(*row(title=F.when(cut > 0, F.trim(F.expr("substring(value, instr(value, ' | ') + 3)"))), contentType=F.lit("link"), url=F.trim(url)))


NATIVE = "bookmarks array<struct<createdAt:double,title:string,tags:array<string>,lists:array<string>,content:struct<type:string,url:string,text:string>,note:string,archived:boolean>>, lists array<struct<id:string,name:string,description:string,icon:string,type:string,query:string,parentId:string>>"


def native_json(spark: SparkSession, path: str) -> DataFrame:
    """The library's own export; memberships of manual lists only."""
    file = spark.read.schema(NATIVE).option("multiLine", True).json(path)
    doc = F.struct("_metadata.file_path", F.xxhash64("bookmarks", "lists")).alias("doc")  # of equal documents any will do
    file = file.select(doc, F.col("lists").isNotNull().alias("known"), "bookmarks", "lists")
    b = file.select("doc", "known", F.posexplode("bookmarks").alias("place", "b"))
    # a file's lists meet its memberships in a join; beside each bookmark they would be as many as both multiplied
    manual = file.select("doc", F.explode("lists").alias("x")).filter("x.type = 'manual'").select("doc", F.col("x.id").alias("list")).distinct()
    held = b.select("doc", "place", F.posexplode("b.lists").alias("n", "list")).join(manual, ["doc", "list"], "left_semi")
    held = held.groupBy("doc", "place").agg(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("n", "list"))), lambda s: s["list"])).alias("held"))
    b = b.join(held, ["doc", "place"], "left").withColumn("held", F.when(F.col("known") & F.col("b.lists").isNotNull(), F.coalesce("held", F.array().cast(NO_TAGS))))
    return b.select(*row(title=F.col("b.title"), contentType=F.col("b.content.type"), url=F.col("b.content.url"), text=F.col("b.content.text"), tags=F.col("b.tags"), addDate=F.col("b.createdAt"), notes=F.col("b.note"), archived=F.col("b.archived"), listExternalIds=F.col("held")))


READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "html": browser_html, "pipe-csv": pipe_csv, "queue-csv": queue_csv, "folder-csv": folder_csv, "reader-csv": reader_csv, "note-csv": note_csv,
    "label-json": label_json, "collection-json": collection_json, "session-json": session_json, "line-text": line_text, "native-json": native_json,
}


def read_import(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in READERS:
        raise ValueError(f"no reader for {source}")
    return READERS[source](spark, path)


def merge_by_url(rows: DataFrame, order: str | None = None) -> DataFrame:
    """One row per URL: tags and paths united, the earliest date, notes joined, archived if one is, the first title. Texts stay apart.

    order: the column with a row's place in its file (it is left out of the result). Without one, rows count as ordered
    by their values: date, title, notes. Either way the result doesn't depend on how the rows are partitioned.
    """
    place = F.col(order) if order else F.struct(*[F.col(c).isNull() if k % 2 else F.col(c) for c in ("addDate", "title", "notes") for k in (1, 0)], F.col("tags").cast("string"))
    names = [c for c in rows.columns if c != order]
    links, rest = rows.filter("url IS NOT NULL"), rows.filter("url IS NULL").select(names)
    empty = {"tags": NO_TAGS, "paths": NO_PATHS, "listExternalIds": NO_TAGS}
    placed = links.withColumn("n", place).withColumns({c: F.coalesce(F.col(c), F.array().cast(t)) for c, t in empty.items()})
    seq = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("n", c))), lambda s: s[c])
    merged = placed.groupBy("url").agg(
        F.min_by("title", F.when(F.col("title").isNotNull(), F.col("n"))).alias("title"), F.min_by("contentType", "n").alias("contentType"), F.min_by("text", "n").alias("text"),
        F.array_distinct(F.flatten(seq("tags"))).alias("tags"), F.min("addDate").alias("addDate"), F.nullif(F.array_join(F.array_distinct(seq("notes")), "\n---\n"), F.lit("")).alias("notes"),
        F.bool_or("archived").alias("archived"), F.flatten(seq("paths")).alias("paths"), F.nullif(F.array_distinct(F.flatten(seq("listExternalIds"))), F.array().cast(NO_TAGS)).alias("listExternalIds"),
    )
    return merged.select(names).unionByName(rest)


# --- feeds and captured answers


def feed_items(spark: SparkSession, path: str, row_tag: str = "item") -> DataFrame:
    """Items of RSS (`item`) or Atom (`entry`) files: guid, title, link, published, categories. guid: guid, else id, else link."""
    schema = "guid string, id string, title string, link string, pubDate string, published string, updated string, category array<string>, description string, summary string"
    items = spark.read.format("xml").option("rowTag", row_tag).option("ignoreNamespace", True).option("valueTag", "text").schema(schema).load(path)
    when = F.coalesce(F.try_to_timestamp(F.regexp_replace("pubDate", r"^\w{3},\s*|\s+(GMT|[+-]\d{4})$", ""), F.lit("d MMM yyyy HH:mm:ss")), F.try_to_timestamp("published"), F.try_to_timestamp("updated"))
    return items.select(F.coalesce(filled("guid"), filled("id"), filled("link")).alias("guid"), filled("title").alias("title"), filled("link").alias("link"), when.alias("published"), F.coalesce("category", F.array().cast(NO_TAGS)).alias("categories"), F.coalesce("description", "summary").alias("summary"))


def since(items: DataFrame, when: Column, limit: int) -> DataFrame:
    """Items after a moment and those without a date, newest first, at most `limit`."""
    return items.filter(F.col("published").isNull() | (F.col("published") > when)).orderBy(F.desc_nulls_last("published"), "guid").limit(limit)


def paper_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a paper archive's Atom answer: url (https), title, summary without tags, authors joined by a comma, published. Entries without an id are left out."""
    from ..functions.text import html_text

    schema = "id string, title string, summary string, published string, author array<struct<name:string>>"
    items = spark.read.format("xml").option("rowTag", "entry").option("ignoreNamespace", True).schema(schema).load(path)
    names = F.filter(F.transform(F.coalesce("author", F.array().cast("array<struct<name:string>>")), lambda a: F.trim(a["name"])), lambda n: n != "")
    one_space = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))
    url = F.regexp_replace(filled("id"), "^http://", "https://")
    return items.filter(filled("id").isNotNull()).select(url.alias("url"), one_space(F.col("title")).alias("title"), one_space(html_text(F.col("summary"))).alias("summary"), F.nullif(F.array_join(names, ", "), F.lit("")).alias("author"), F.try_to_timestamp("published").alias("published"))


def new_items(items: DataFrame, ledger: DataFrame) -> DataFrame:
    """Items whose guid isn't in the ledger (guid), each once."""
    return items.dropDuplicates(["guid"]).join(ledger.select("guid"), "guid", "left_anti")


def news_hits(spark: SparkSession, path: str) -> DataFrame:
    """Captured answers of a news search: hits with a URL."""
    hits = spark.read.schema("hits array<struct<title:string,url:string,created_at_i:long,points:long>>").option("multiLine", True).json(path).select(F.explode("hits").alias("h"))
    return hits.filter("h.url IS NOT NULL").select("h.url", "h.title", F.timestamp_seconds("h.created_at_i").alias("published"), "h.points")


def repository_items(spark: SparkSession, path: str) -> DataFrame:
    """Captured answers of a repository search: pushed_at, else created_at."""
    items = spark.read.schema("items array<struct<full_name:string,html_url:string,description:string,pushed_at:string,created_at:string,stargazers_count:long>>").option("multiLine", True).json(path).select(F.explode("items").alias("i"))
    return items.select(F.col("i.html_url").alias("url"), F.col("i.full_name").alias("title"), F.coalesce(F.try_to_timestamp("i.pushed_at"), F.try_to_timestamp("i.created_at")).alias("published"), F.col("i.stargazers_count").alias("stars"))


#: Where a site without announced feeds often has one.
FEED_PATHS = ("/feed", "/feed.xml", "/rss.xml", "/atom.xml", "/index.xml", "/feed/", "/rss")


def feed_links(page: Column) -> Column:
    """Feeds that a page announces by alternate links."""
    links = F.regexp_extract_all(page, F.lit(r"(?i)(<link\b[^>]*>)"), F.lit(1))
    feeds = F.filter(links, lambda x: x.rlike(r"(?i)rel\s*=\s*[\"']?alternate") & x.rlike(r"(?i)type\s*=\s*[\"']?application/(rss|atom)\+xml"))
    return F.filter(F.transform(feeds, lambda x: F.regexp_extract(x, r"(?i)href\s*=\s*[\"']([^\"']+)", 1)), lambda x: x != "")


@F.pandas_udf(T.ArrayType(T.StringType()))
def resolved(base: pd.Series, links: pd.Series) -> pd.Series:
    """Links of a page as absolute http(s) addresses, each once, in order; what can't be resolved is left out."""

    def one(b, found):
        out = []
        for x in found if found is not None else ():
            try:
                full = urljoin(b or "", x)
                ok = urlsplit(full).scheme in ("http", "https")
            except ValueError:
                continue
            out += [full] if ok else []
        return list(dict.fromkeys(out))

    return pd.Series([one(b, x) for b, x in zip(base, links, strict=True)])


def feed_candidates(url: Column, page: Column) -> Column:
    """Feeds to try for a page: those it announces, else the conventional places of its site."""
    own = resolved(url, feed_links(F.coalesce(page, F.lit(""))))
    root = F.regexp_extract(url, r"^(?i:https?://[^/?#]+)", 0)
    usual = F.when(root != "", F.transform(F.array(*map(F.lit, FEED_PATHS)), lambda p: F.concat(root, p))).otherwise(F.array().cast(NO_TAGS))
    return F.when(F.size(own) > 0, own).otherwise(usual)


#: Sources that a poll reads: kind and function (spark, config) to items (url, title, published).
def _feed(spark: SparkSession, config: dict) -> DataFrame:
    return feed_items(spark, config["path"], config.get("row_tag", "item")).select(F.col("link").alias("url"), "title", "published")


ADAPTERS: dict[str, Callable[[SparkSession, dict], DataFrame]] = {
    "feed": _feed,
    "news": lambda spark, config: news_hits(spark, config["path"]).select("url", "title", "published"),
    "papers": lambda spark, config: paper_entries(spark, config["path"]).select("url", "title", "published"),
    "repositories": lambda spark, config: repository_items(spark, config["path"]).select("url", "title", "published"),
}


def fetch_items(spark: SparkSession, kind: str, config: dict, after: Column | None = None, limit: int = 100) -> DataFrame:
    """Items of one source through its adapter: with a URL, after a moment or without a date, newest first, at most `limit`."""
    if kind not in ADAPTERS:
        raise ValueError(f"no adapter for {kind}")
    items = ADAPTERS[kind](spark, config).filter("url IS NOT NULL")
    return since(items.withColumn("guid", F.col("url")), F.lit("1970-01-01").cast("timestamp") if after is None else after, limit).drop("guid")


# --- exports


def native_records(docs: DataFrame) -> DataFrame:
    """Export records of (createdAt seconds, title, tags, lists, type, url, text, note, archived): content of links and texts only."""
    content = F.when(F.col("type").isin("link", "text"), F.struct("type", F.when(F.col("type") == "link", F.col("url")).alias("url"), F.when(F.col("type") == "text", F.col("text")).alias("text")))
    return docs.select("createdAt", "title", "tags", "lists", content.alias("content"), "note", "archived")


def browser_lines(docs: DataFrame) -> DataFrame:
    """One line of a browser bookmark file per link with an http(s) URL."""
    from ..functions.text import escape_html
    from ..functions.urls import allowed

    links = docs.filter((F.col("type") == "link") & allowed(F.col("url")))
    tags = F.when(F.size("tags") > 0, F.concat(F.lit(' TAGS="'), escape_html(F.array_join("tags", ",")), F.lit('"'))).otherwise("")
    line = F.concat(F.lit('    <DT><A HREF="'), escape_html(F.col("url")), F.lit('" ADD_DATE="'), F.col("createdAt").cast("long").cast("string"), F.lit('"'), tags, F.lit(">"), escape_html(F.coalesce("title", "url")), F.lit("</A>"))
    return links.select(line.alias("value"))
