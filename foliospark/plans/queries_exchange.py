"""Imports, feeds and exports: files written from the test tables and read by the library's readers, with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics as A
from ..sources import exports as X
from ..sources import imports as I
from ..sources.stored import Store
from ..sources.tables import Tables, with_tables

Q: dict = {}
S: dict[str, str] = {}
DAY = "TIMESTAMP '2024-01-01 00:00:00'"


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        def run(spark, sf_dir):
            t = Tables(spark, sf_dir)
            return f(t, Store(spark, name))

        Q[name] = run
        if sql:
            S[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def flat(rows):
    """An import's rows with plain types."""
    return rows.select("title", "contentType", "url", F.array_join("tags", "|").alias("tags"), F.col("addDate").cast("long").alias("addDate"), "archived")


def number():
    return F.col("page_id").cast("string")


def names(*parts):
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def day(c="page_id"):
    """A time by the number of a row, as ISO text."""
    return F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col(c) * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")


SECONDS = "1704067200 + page_id * 3600"


@query("s02_browser_html", f"""SELECT 'T & ' || page_id AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'a|b c' ELSE '' END AS tags, {SECONDS} AS addDate, NULL::BOOLEAN AS archived, CASE page_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'One' ELSE 'One/Two ' || (page_id % 7) END AS path FROM pages""")
def _(t, store):
    """A file for every seventh of the pages, with folders two deep."""
    tags = F.when(F.col("page_id") % 2 == 0, ' TAGS="a,b c"').otherwise("")
    line = names('<DT><A HREF="', F.replace("url", F.lit("&"), F.lit("&amp;")), '" ADD_DATE="', (F.lit(1704067200) + F.col("page_id") * 3600).cast("string"), '"', tags, ">T &amp; ", number(), "</A>")
    rows = t.pages.select((F.col("page_id") % 7).alias("file"), (F.col("page_id") % 3).alias("depth"), line.alias("line"))
    part = lambda k: F.concat_ws("", F.collect_list(F.when(F.col("depth") == k, F.col("line"))))
    files = rows.groupBy("file").agg(part(0).alias("a"), part(1).alias("b"), part(2).alias("c"))
    page = names("<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p>", F.col("a"), "<DT><H3>One</H3><DL><p>", F.col("b"), "<DT><H3>Two ", F.col("file").cast("string"), "</H3><DL><p>", F.col("c"), "</DL><p></DL><p></DL>")
    got = I.read_import(t.spark, "html", one_each(files.select(page.alias("value"), "file"), "file", store))
    return got.select("title", "contentType", "url", F.array_join("tags", "|").alias("tags"), F.col("addDate").cast("long").alias("addDate"), "archived", F.coalesce(F.array_join(F.try_element_at("paths", F.lit(1)), "/"), F.lit("")).alias("path"))


def one_each(df, key, store, form="text"):
    """The path of files with one row each, by a key that no two rows share."""
    path = store.path()
    df.write.partitionBy(key).format(form).save(path)
    return path


#: Rows in a document that is read whole.
FILE_ROWS = 10_000


def file_count(df, least=1):
    """Files for a table's rows, so that a file's size doesn't grow with the table."""
    return max(least, -(-df.count() // FILE_ROWS))


def csv(df, store):
    path = store.path()
    df.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


@query("s03_pipe_csv", f"SELECT 'T, ' || page_id AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS tags, {SECONDS} AS addDate, page_id % 3 = 0 AS archived FROM pages")
def _(t, store):
    df = t.pages.select(names("T, ", number()).alias("title"), "url", (F.lit(1704067200) + F.col("page_id") * 3600).alias("time_added"), F.when(F.col("page_id") % 2 == 0, "a| b ").alias("tags"), F.when(F.col("page_id") % 3 == 0, "archive").otherwise("unread").alias("status"))
    return flat(I.read_import(t.spark, "pipe-csv", csv(df, store)))


@query("s04_queue_csv", f"SELECT 'T \"' || page_id || '\"' AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'x|y' ELSE '' END AS tags, CASE WHEN page_id % 5 <> 0 THEN {SECONDS} END AS addDate, page_id % 3 = 0 AS archived FROM pages")
def _(t, store):
    df = t.pages.select(names('T "', number(), '"').alias("Title"), F.col("url").alias("URL"), F.when(F.col("page_id") % 2 == 0, "x;y;").alias("Tags"), F.when(F.col("page_id") % 5 != 0, day()).otherwise("never").alias("Last Interaction Date"), F.when(F.col("page_id") % 3 == 0, "False").otherwise("True").alias("In Queue"))
    return flat(I.read_import(t.spark, "queue-csv", csv(df, store)))


@query("s05_native_json", "SELECT CAST(b.id AS VARCHAR) AS title, b.type AS contentType, CASE WHEN b.type = 'link' THEN 'https://x.org/' || b.id END AS url, CAST(epoch(b.createdAt) AS BIGINT) AS addDate, b.archived, coalesce(m.lists, '') AS lists FROM bookmarks b LEFT JOIN (SELECT bookmarkId, string_agg(CAST(listId AS VARCHAR), ',' ORDER BY CAST(listId AS VARCHAR)) AS lists FROM in_lists JOIN lists ON lists.id = listId AND lists.type = 'manual' GROUP BY 1) m ON m.bookmarkId = b.id WHERE b.type <> 'asset'", "bookmarks", "in_lists", "lists")
def _(t, store):
    """A backup, read again: its memberships have all lists, the reader keeps the manual ones."""
    held = t.in_lists.groupBy(F.col("bookmarkId").alias("id")).agg(F.sort_array(F.collect_set(F.col("listId").cast("string"))).alias("lists"))
    none = F.array().cast("array<string>")
    docs = t.bookmarks.join(held, "id", "left").select((F.unix_micros(F.col("createdAt").cast("timestamp")) / 1e6).alias("createdAt"), F.col("id").cast("string").alias("title"), none.alias("tags"), F.coalesce("lists", none).alias("lists"), "type", names("https://x.org/", F.col("id").cast("string")).alias("url"), F.lit("words").alias("text"), F.lit(None).cast("string").alias("note"), "archived")
    records = X.native_records(docs).filter("content IS NOT NULL")
    n = file_count(t.bookmarks, 16)
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(n)).alias("part")
    in_files = lambda df: df.repartition(n, "part").groupBy("part")  # noqa: E731  about a file in a task
    lists = X.list_records(t.lists).select("id", "name", "type")
    # a file has the lists that its bookmarks are in, and each list is in one more
    used = records.select(part("title"), F.explode("lists").alias("id")).unionByName(lists.select(part("id"), "id")).distinct().join(lists, "id")
    lists = in_files(used).agg(F.collect_list(F.struct("id", "name", "type")).alias("lists"))
    files = in_files(records.withColumn("part", part("title"))).agg(F.collect_list(F.struct(*records.columns)).alias("bookmarks")).join(lists.hint("merge"), "part", "left")
    got = I.read_import(t.spark, "native-json", one_each(files, "part", store, "json"))
    return got.select("title", "contentType", "url", F.col("addDate").cast("long").alias("addDate"), "archived", F.array_join(F.sort_array("listExternalIds"), ",").alias("lists"))


@query("s06_label_json", f"SELECT 'T' || page_id AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'l1|l2' ELSE '' END AS tags, {SECONDS} AS addDate, CASE WHEN page_id % 4 <> 1 THEN page_id % 4 = 0 END AS archived FROM pages")
def _(t, store):
    labels = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("l1"), F.lit("l2")))
    state = F.when(F.col("page_id") % 4 == 0, "Archived").when(F.col("page_id") % 4 != 1, "Active")
    item = F.struct(names("T", number()).alias("title"), "url", labels.alias("labels"), day().alias("savedAt"), state.alias("state"))
    files = t.pages.groupBy((F.col("page_id") % 9).alias("file")).agg(F.to_json(F.collect_list(item)).alias("value"))
    return flat(I.read_import(t.spark, "label-json", one_each(files, "file", store)))


@query("s07_collection_json", "SELECT s_name AS title, 'https://s.org/' || s_suppkey AS url, r_name || '/' || n_name AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t, store):
    """Regions hold nations, nations hold suppliers as links."""
    link = F.struct(F.col("s_name").alias("name"), names("https://s.org/", F.col("s_suppkey").cast("string")).alias("url"), F.array().cast("array<struct<name:string>>").alias("tags"), F.lit("2024-01-01T00:00:00Z").alias("createdAt"))
    held = t.raw("supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.collect_list(link).alias("links"))
    nations = t.raw("nation").join(held, "n_nationkey", "left").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), (F.col("n_regionkey") + 1000).cast("long").alias("parentId"), "links")
    regions = t.raw("region").select((F.col("r_regionkey") + 1000).cast("long").alias("id"), F.col("r_name").alias("name"), F.lit(None).cast("long").alias("parentId"), F.lit(None).cast(nations.schema["links"].dataType).alias("links"))
    path = store.path()
    nations.unionByName(regions).agg(F.collect_list(F.struct("id", "name", "parentId", "links")).alias("collections")).write.json(path)
    got = I.read_import(t.spark, "collection-json", path)
    return got.select("title", "url", F.array_join(F.element_at("paths", 1), "/").alias("path"))


@query("s08_session_json", "SELECT 't' || event_id AS title, 'https://e.org/' || event_id AS url, event_id AS addDate FROM events WHERE user_id % 13 = (SELECT max(user_id % 13) FROM events)")
def _(t, store):
    """Thirteen sessions of windows by kind of event, each dealt over the files; the one of the latest date counts."""
    tab = F.struct(names("https://e.org/", F.col("event_id").cast("string")).alias("url"), names("t", F.col("event_id").cast("string")).alias("title"), (F.col("event_id") * 1000.0).alias("lastAccessed"))
    n = file_count(t.events)
    dealt = t.events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(n))).repartition(n, "part")  # about a file in a task
    tabs = dealt.groupBy("part", (F.col("user_id") % 13).cast("double").alias("date"), "event_type").agg(F.map_from_entries(F.collect_list(F.struct(F.col("event_id").cast("string"), tab))).alias("tabs"))
    sessions = tabs.groupBy("part", "date").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "tabs"))).alias("windows"))
    path = one_each(sessions.groupBy("part").agg(F.to_json(F.collect_list(F.struct("date", "windows"))).alias("value")), "part", store)
    got = I.read_import(t.spark, "session-json", path)
    return got.select("title", "url", F.col("addDate").cast("long").alias("addDate"))


@query("s09_note_csv", f"SELECT 'T' || page_id AS title, CASE page_id % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'text' END AS contentType, CASE WHEN page_id % 3 = 0 THEN url END AS url, CASE WHEN page_id % 3 = 1 THEN 'line one' || chr(10) || 'line \"two\"' END AS text, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS tags, {SECONDS} AS addDate FROM pages")
def _(t, store):
    kind = F.col("page_id") % 3
    df = t.pages.select(names("T", number()).alias("title"), F.when(kind == 0, names(" ", F.col("url"), " ")).otherwise(" ").alias("url"), F.when(kind != 2, 'line one\nline "two"').alias("content"), F.lit("n").alias("note"), F.when(F.col("page_id") % 2 == 0, " a, b,").alias("tags"), day().alias("created"))
    got = I.read_import(t.spark, "note-csv", csv(df, store))
    return got.select("title", "contentType", "url", "text", F.array_join("tags", "|").alias("tags"), F.col("addDate").cast("long").alias("addDate"))


@query("s10_folder_csv", f"SELECT 'T' || page_id AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS tags, {SECONDS} AS addDate, page_id % 3 = 0 AS archived, CASE WHEN page_id % 3 = 2 THEN 'Work' ELSE '' END AS path FROM pages")
def _(t, store):
    folder = F.when(F.col("page_id") % 3 == 0, "Archive").when(F.col("page_id") % 3 == 1, "Unread").otherwise("Work")
    df = t.pages.select(F.col("url").alias("URL"), names("T", number()).alias("Title"), F.lit(None).cast("string").alias("Selection"), folder.alias("Folder"), (F.lit(1704067200) + F.col("page_id") * 3600).alias("Timestamp"), F.when(F.col("page_id") % 2 == 0, '["a","b"]').otherwise("oops").alias("Tags"))
    got = I.read_import(t.spark, "folder-csv", csv(df, store))
    return got.select("title", "contentType", "url", F.array_join("tags", "|").alias("tags"), F.col("addDate").cast("long").alias("addDate"), "archived", F.coalesce(F.try_element_at(F.try_element_at("paths", F.lit(1)), F.lit(1)), F.lit("")).alias("path"))


@query("s11_reader_csv", f"SELECT 'T' || page_id AS title, 'link' AS contentType, url, CASE WHEN page_id % 2 = 0 THEN 'a|b c' ELSE '' END AS tags, {SECONDS} AS addDate, page_id % 4 = 0 AS archived FROM pages WHERE page_id % 4 <> 1 AND page_id % 5 <> 0")
def _(t, store):
    place = F.when(F.col("page_id") % 4 == 0, "archive").when(F.col("page_id") % 4 == 1, "feed").otherwise("new")
    df = t.pages.select(names("T", number()).alias("Title"), F.when(F.col("page_id") % 5 != 0, F.col("url")).otherwise(" ").alias("URL"), F.when(F.col("page_id") % 2 == 0, "['a', 'b c']").otherwise("[]").alias("Document tags"), F.regexp_replace(F.translate(day(), "T", " "), "Z$", "+00:00").alias("Saved date"), place.alias("Location"))
    return flat(I.read_import(t.spark, "reader-csv", csv(df, store)))


@query("s12_line_text", "SELECT url, CASE WHEN page_id % 2 = 0 THEN 'T | ' || page_id END AS title FROM pages WHERE page_id % 3 <> 0")
def _(t, store):
    line = F.when(F.col("page_id") % 3 == 0, "some words").when(F.col("page_id") % 2 == 0, names(F.col("url"), " | T | ", number())).otherwise(F.col("url"))
    path = store.path()
    t.pages.select(line.alias("value")).write.text(path)
    return I.read_import(t.spark, "line-text", path).select("url", "title")


@query("s13_dispatcher", " UNION ALL ".join(f"SELECT '{k}' AS source, (SELECT count(*) FROM pages) AS n" for k in ("line-text", "pipe-csv", "label-json")))
def _(t, store):
    """One table in three formats, each read by the name of its source."""
    lines = store.path()
    t.pages.select(F.col("url").alias("value")).write.text(lines)
    objects = one_each(t.pages.groupBy((F.col("page_id") % 9).alias("file")).agg(F.to_json(F.collect_list(F.struct("url", F.lit("t").alias("title")))).alias("value")), "file", store)
    files = {"line-text": lines, "pipe-csv": csv(t.pages.select(F.lit("t").alias("title"), "url", F.lit(1).alias("time_added"), F.lit("a").alias("tags"), F.lit("x").alias("status")), store), "label-json": objects}
    out = None
    for name, path in files.items():
        n = I.read_import(t.spark, name, path).agg(F.lit(name).alias("source"), F.count("url").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def feed_file(t, store):
    """An RSS file a seventh of the pages: some items without guid, date or category."""
    esc = lambda c: F.replace(c, F.lit("&"), F.lit("&amp;"))
    when = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    item = names("<item><title> T ", number(), " </title><link>", esc(F.col("url")), "</link>", F.when(F.col("page_id") % 3 != 0, names("<guid>g", number(), "</guid>")).otherwise(""), F.when(F.col("page_id") % 4 != 0, names("<pubDate>", when, "</pubDate>")).otherwise(""), F.when(F.col("page_id") % 2 == 0, "<category>a</category><category>b</category>").otherwise(""), "</item>")
    files = t.pages.groupBy((F.col("page_id") % 7).alias("file")).agg(F.concat_ws("", F.collect_list(item)).alias("items"))
    return one_each(files.select(names("<rss><channel>", F.col("items"), "</channel></rss>").alias("value"), "file"), "file", store)


FEED = f"SELECT CASE WHEN page_id % 3 <> 0 THEN 'g' || page_id ELSE url END AS guid, 'T ' || page_id AS title, url AS link, CASE WHEN page_id % 4 <> 0 THEN {SECONDS} END AS published, CASE WHEN page_id % 2 = 0 THEN 'a|b' ELSE '' END AS categories FROM pages"


def feed_rows(items):
    return items.select("guid", "title", "link", F.unix_seconds("published").alias("published"), F.array_join("categories", "|").alias("categories"))


@query("s14_feed_items", FEED)
def _(t, store):
    return feed_rows(I.feed_items(t.spark, feed_file(t, store)))


@query("s15_feed_since", f"SELECT guid, published FROM ({FEED}) WHERE published IS NULL OR published > 1704067200 + 360000 ORDER BY published DESC NULLS LAST, guid LIMIT 60")
def _(t, store):
    return I.since(I.feed_items(t.spark, feed_file(t, store)), F.timestamp_seconds(F.lit(1704067200 + 360000)), 60).select("guid", F.unix_seconds("published").alias("published"))


@query("st06_feed_ledger", f"SELECT DISTINCT guid FROM ({FEED}) WHERE guid NOT IN (SELECT 'g' || page_id FROM pages WHERE page_id % 5 = 0)")
def _(t, store):
    ledger = t.pages.filter("page_id % 5 = 0").select(names("g", number()).alias("guid"))
    return I.new_items(I.feed_items(t.spark, feed_file(t, store)), ledger).select("guid")


@query("s16_news_hits", f"SELECT url, 'T' || page_id AS title, {SECONDS} AS published, page_id % 100 AS points FROM pages WHERE page_id % 3 <> 0")
def _(t, store):
    hit = F.struct(names("T", number()).alias("title"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("url"), (F.lit(1704067200) + F.col("page_id") * 3600).alias("created_at_i"), (F.col("page_id") % 100).alias("points"))
    path = one_each(t.pages.groupBy((F.col("page_id") % 9).alias("page")).agg(F.collect_list(hit).alias("hits")), "page", store, "json")
    return I.news_hits(t.spark, path).select("url", "title", F.unix_seconds("published").alias("published"), "points")


@query("s17_paper_entries", f"SELECT 'https://p.org/abs/' || page_id AS url, 'A title & ' || page_id AS title, 'First line second <b> line' AS summary, CASE page_id % 3 WHEN 0 THEN 'A. One, B. Two' WHEN 1 THEN 'A. One' END AS author, {SECONDS} AS published FROM pages WHERE page_id % 5 <> 0")
def _(t, store):
    authors = F.when(F.col("page_id") % 3 == 0, "<author><name> A. One </name></author><author><name>B. Two</name></author>").when(F.col("page_id") % 3 == 1, "<author><name>A. One</name></author>").otherwise("")
    entry = names("<entry>", F.when(F.col("page_id") % 5 != 0, names("<id>http://p.org/abs/", number(), "</id>")).otherwise(""), "<title>A\n  title &amp; ", number(), "</title><summary> First line\n&lt;i&gt;second&lt;/i&gt; &amp;lt;b&amp;gt; line </summary>", authors, "<published>", day(), "</published></entry>")
    files = t.pages.groupBy((F.col("page_id") % 7).alias("file")).agg(F.concat_ws("", F.collect_list(entry)).alias("items"))
    path = one_each(files.select(names('<feed xmlns="http://www.w3.org/2005/Atom">', F.col("items"), "</feed>").alias("value"), "file"), "file", store)
    return I.paper_entries(t.spark, path).select("url", "title", "summary", "author", F.unix_seconds("published").alias("published"))


@query("s18_repository_items", f"SELECT url, 'o/' || page_id AS title, CASE WHEN page_id % 2 = 0 THEN {SECONDS} ELSE 1704067200 END AS published, page_id AS stars FROM pages")
def _(t, store):
    item = F.struct(names("o/", number()).alias("full_name"), F.col("url").alias("html_url"), F.when(F.col("page_id") % 2 == 0, day()).alias("pushed_at"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.col("page_id").alias("stargazers_count"))
    path = one_each(t.pages.groupBy((F.col("page_id") % 9).alias("page")).agg(F.collect_list(item).alias("items")), "page", store, "json")
    return I.repository_items(t.spark, path).select("url", "title", F.unix_seconds("published").alias("published"), "stars")


NEWEST = "ORDER BY published DESC NULLS LAST, url LIMIT 200"


@query("s19_adapters", f"SELECT * FROM (SELECT 'feed' AS kind, link AS url, title, published FROM ({FEED}) {NEWEST}) UNION ALL SELECT * FROM (SELECT 'news', url, 'N' || page_id, {SECONDS} AS published FROM pages WHERE page_id % 3 <> 0 {NEWEST})")
def _(t, store):
    hit = F.struct(names("N", number()).alias("title"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("url"), (F.lit(1704067200) + F.col("page_id") * 3600).alias("created_at_i"))
    path = one_each(t.pages.groupBy((F.col("page_id") % 9).alias("page")).agg(F.collect_list(hit).alias("hits")), "page", store, "json")
    feed = I.fetch_items(t.spark, "feed", {"path": feed_file(t, store)}, limit=200)
    news = I.fetch_items(t.spark, "news", {"path": path}, limit=200)
    both = feed.withColumn("kind", F.lit("feed")).unionByName(news.withColumn("kind", F.lit("news")))
    return both.select("kind", "url", "title", F.unix_seconds("published").alias("published"))


@query("s21_feed_candidates", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^https?://[^/?#]+') || '/rss/' || page_id || '.xml' WHEN 1 THEN 'https://f.org/atom ' || regexp_extract(url, '^https?://[^/?#]+') || '/b'
    ELSE array_to_string(list_transform(['/feed', '/feed.xml', '/rss.xml', '/atom.xml', '/index.xml', '/feed/', '/rss'], lambda p: regexp_extract(url, '^https?://[^/?#]+') || p), ' ') END AS feeds FROM pages""")
def _(t, store):
    head = F.when(F.col("page_id") % 3 == 0, names('<link rel="alternate" type="application/rss+xml" href="/rss/', number(), '.xml"><link rel="stylesheet" href="/x.css">')).when(
        F.col("page_id") % 3 == 1, "<LINK type='application/atom+xml' rel='alternate' href='https://f.org/atom'><link rel=alternate type='application/rss+xml' href='/b'><link rel='alternate' type='application/rss+xml' href='https://f.org/atom'>"
    ).otherwise("<link rel='alternate' hreflang='de' href='/de'>")
    return t.pages.select("page_id", F.array_join(I.feed_candidates(F.col("url"), F.concat(head, F.col("html"))), " ").alias("feeds"))


@query("s22_keyset_iteration", "SELECT count(*) AS n, CAST(sum(id) AS BIGINT) AS total, max(id) AS last FROM bookmarks", "bookmarks")
def _(t, store):
    """A whole table: partitions take the place of pages by key."""
    return t.bookmarks.select("id").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("total"), F.max("id").alias("last"))


@query("s23_stored_files", "SELECT 'asset-' || r_regionkey AS key, CAST(length(r_name) + 1 AS BIGINT) AS size FROM region")
def _(t, store):
    """A folder per asset with one file."""
    root = store.path()
    for row in t.raw("region").select("r_regionkey", "r_name").collect():  # five files
        t.spark.createDataFrame([(row.r_name,)], "value string").coalesce(1).write.text(f"{root}/user/asset-{row.r_regionkey}")
    return X.stored_files(t.spark, f"{root}/user/*").filter("path LIKE '%.txt'").select("key", "size")


# --- exports


@query("k02_list_records", "SELECT CAST(id AS VARCHAR) AS id, name, type, CASE WHEN type = 'smart' THEN 'is:fav -is:archived' END AS query, NULL::VARCHAR AS icon, NULL::VARCHAR AS description, NULL::VARCHAR AS \"parentId\" FROM lists", "lists")
def _(t, store):
    return X.list_records(t.lists)


@query("k04_backup", "SELECT b.id, b.type, coalesce(m.lists, '') AS lists FROM bookmarks b LEFT JOIN (SELECT bookmarkId, string_agg(CAST(listId AS VARCHAR), ',' ORDER BY CAST(listId AS VARCHAR)) AS lists FROM in_lists JOIN lists ON lists.id = listId AND lists.type = 'manual' GROUP BY 1) m ON m.bookmarkId = b.id WHERE b.type <> 'asset' UNION ALL SELECT id, 'list', '' FROM lists", "bookmarks", "in_lists", "lists")
def _(t, store):
    """Written as compressed lines and read again."""
    docs = t.bookmarks.select("id", F.lit(0.0).alias("createdAt"), F.col("id").cast("string").alias("title"), F.array().cast("array<string>").alias("tags"), "type", F.lit("https://x.org").alias("url"), F.lit("w").alias("text"), F.lit(None).cast("string").alias("note"), "archived")
    path = store.path()
    X.write_backup(X.backup(docs, t.lists, t.in_lists), t.lists, path)
    records = t.spark.read.schema("title string, lists array<string>, content struct<type:string>").json(f"{path}/bookmarks")
    lists = t.spark.read.schema("id string").json(f"{path}/lists")
    return records.select(F.col("title").cast("long").alias("id"), "content.type", F.array_join("lists", ",").alias("lists")).unionByName(lists.select(F.col("id").cast("long").alias("id"), F.lit("list").alias("type"), F.lit("").alias("lists")))


@query("k05_feed_of_a_list", "SELECT CAST(b.id AS VARCHAR) AS guid, CASE WHEN b.type = 'link' THEN l.url ELSE 'https://me.org/assets/a' || b.id END AS link, 'T <' || b.id || '>' AS title, CAST(epoch(b.createdAt) AS BIGINT) AS published FROM bookmarks b LEFT JOIN links l ON l.id = b.id WHERE b.type = 'asset' OR (b.type = 'link' AND b.id % 4 <> 0)", "bookmarks", "links")
def _(t, store):
    """Written as one file and read by the library's own reader."""
    docs = t.bookmarks.join(t.links.select("id", "url"), "id", "left").select("id", "type", F.when(F.col("id") % 4 == 0, "data:text/html,x").otherwise(F.col("url")).alias("url"), names("a", F.col("id").cast("string")).alias("assetId"), names("T <", F.col("id").cast("string"), ">").alias("title"), "createdAt", F.lit("A & B").alias("author"), F.array(F.lit("x"), F.lit("y")).alias("tags"), F.lit(None).cast("string").alias("description"))
    path = store.path()
    X.write_feed(X.feed_document(X.feed_entries(docs, "https://me.org/assets/"), "My <list>", "https://me.org", "A list"), path)
    return I.feed_items(t.spark, path).select("guid", "link", "title", F.unix_seconds("published").alias("published"))


@query("k07_vector_store", "SELECT vec_id AS id, label, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' END AS state FROM embeddings WHERE vec_id % 5 = 0 OR (label <> 3 AND vec_id % 7 <> 1)")
def _(t, store):
    """One user's vectors are cleared, some are deleted, and some come anew."""
    old = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("userId"), F.lit("old").alias("state"), F.col("embedding").alias("vector"))
    out = X.vector_changes(old, old.filter("id % 5 = 0").withColumn("state", F.lit("new")), old.filter("id % 7 = 1").select("id"), F.col("userId") == 3)
    return out.select("id", F.col("userId").alias("label"), "state")


@query("k09_dump", "SELECT 'bookmarks' AS \"table\", count(*) AS rows FROM bookmarks UNION ALL SELECT 'tags_on', count(*) FROM tags_on", "bookmarks", "tags_on")
def _(t, store):
    return X.dump({"bookmarks": t.bookmarks, "tags_on": t.tags_on}, store.path())


@query("k09_migrate", "SELECT bookmarkId + 1000000 AS bookmarkId, 'n' || tagId AS tagId, attachedBy FROM tags_on WHERE bookmarkId % 2 = 0 AND tagId % 3 <> 0", "tags_on")
def _(t, store):
    """To a server with other ids: half of the bookmarks and two thirds of the tags go."""
    maps = {"bookmark": t.bookmarks.filter("id % 2 = 0").select(F.col("id").alias("old"), (F.col("id") + 1_000_000).alias("new")), "tag": t.tags.filter("id % 3 <> 0").select(F.col("id").alias("old"), names("n", F.col("id").cast("string")).alias("new"))}
    return X.migrated({"tags_on": t.tags_on}, maps, {"tags_on": {"bookmarkId": "bookmark", "tagId": "tag"}})["tags_on"]


@query("u06_united_arrays", "SELECT o_custkey % 50 AS url, array_to_string(list_sort(list(DISTINCT o_orderpriority)), ',') AS tags FROM orders GROUP BY 1")
def _(t, store):
    rows = t.raw("orders").select(*I.row(url=(F.col("o_custkey") % 50).cast("string"), contentType=F.lit("link"), tags=F.array("o_orderpriority")), F.col("o_orderkey").alias("place"))
    return I.merge_by_url(rows, "place").select(F.col("url").cast("long").alias("url"), F.array_join(F.sort_array("tags"), ",").alias("tags"))


@query("wf9_latest_session", "SELECT user_id, arg_max(event_id, (CAST(ts AS DATE), event_id)) AS event_id FROM events GROUP BY 1")
def _(t, store):
    """Of equal dates the later element wins."""
    return t.events.groupBy("user_id").agg(F.max_by("event_id", F.struct(F.to_date("ts"), "event_id")).alias("event_id"))


@query("j18_tree_paths", "SELECT n_name AS name, r_name || ' / ' || n_name AS path FROM nation JOIN region ON r_regionkey = n_regionkey")
def _(t, store):
    nodes = t.raw("region").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parentId"), F.col("r_name").alias("name")).union(t.raw("nation").select("n_nationkey", F.col("n_regionkey") + 1000, "n_name"))
    return A.tree_paths(nodes).filter("depth = 1").join(nodes, "id").select("name", F.replace("path", F.lit("/"), F.lit(" / ")).alias("path"))
