"""Listing, search and statistics queries with their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..operators import analytics as A
from ..operators import maintenance as M
from ..operators import search
from ..sources.tables import Tables, with_tables

NOW = datetime(1998, 8, 1)  # noqa: DTZ001  the tables' times have no zone
NOW_SQL = "TIMESTAMP '1998-08-01 00:00:00'"
Q: dict = {}
S: dict[str, str] = {}


def query(name: str, sql: str | None = None, *tables: str):
    """Registers a function of Tables under a name, with the SQL that gives the same rows."""

    def add(f):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            S[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def library(t: Tables, titles: bool = True) -> search.Library:
    """The search's tables. titles: with the bookmarks' own titles, which need a join."""
    named = t.tags.select(F.col("id").alias("p"), F.col("name").alias("title"))
    titled = t.bookmarks.join(named, F.col("p") == F.col("id") + 1, "left").drop("p") if titles else t.bookmarks.withColumn("title", F.lit(None).cast("string"))
    feeds = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    imports = t.bookmarks.join(t.users.select(F.col("id").alias("u"), "nation"), F.col("u") == F.col("userId")).select(F.col("id").alias("bookmarkId"), F.col("nation").alias("rssFeedId"))
    return search.Library(titled, t.links, t.assets, t.tags, t.tags_on, t.lists, t.in_lists, feeds, imports)


@query("s01_table_scan", "SELECT r_regionkey, r_name FROM region")
def _(t):
    return t.raw("region").select("r_regionkey", "r_name")


@query("a01_count", "SELECT count(*) AS n FROM bookmarks", "bookmarks")
def _(t):
    return t.bookmarks.agg(F.count(F.lit(1)).alias("n"))


@query("a02_filtered_counts", "SELECT userId, count(*) AS n, count(*) FILTER (favourited) AS fav, count(*) FILTER (archived) AS archived FROM bookmarks GROUP BY userId", "bookmarks")
def _(t):
    return t.bookmarks.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.count_if("favourited").alias("fav"), F.count_if("archived").alias("archived"))


@query("a03_by_type", "SELECT k.type, count(b.id) AS n FROM (VALUES ('link'), ('text'), ('asset'), ('unknown')) k(type) LEFT JOIN bookmarks b ON b.type = k.type GROUP BY k.type", "bookmarks")
def _(t):
    kinds = t.spark.createDataFrame([(k,) for k in ("link", "text", "asset", "unknown")], "type string")
    return kinds.join(t.bookmarks.groupBy("type").agg(F.count(F.lit(1)).alias("c")), "type", "left").select("type", F.coalesce("c", F.lit(0)).alias("n"))


@query("a04_by_source", "SELECT source, count(*) AS n FROM bookmarks GROUP BY source", "bookmarks")
def _(t):
    return t.bookmarks.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source")


@query("a05_sum_or_zero", "SELECT u.id, round(coalesce(sum(b.size), 0), 2) AS size FROM users u LEFT JOIN bookmarks b ON b.userId = u.id GROUP BY u.id", "users", "bookmarks")
def _(t):
    sums = t.bookmarks.groupBy("userId").agg(F.sum("size").alias("s"))
    return t.users.join(sums, F.col("id") == F.col("userId"), "left").select("id", F.round(F.coalesce("s", F.lit(0.0)), 2).alias("size"))


@query("a06_count_and_sum_by_type", "SELECT type, count(*) AS n, round(sum(size), 1) AS size FROM bookmarks GROUP BY type", "bookmarks")
def _(t):
    return t.bookmarks.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("size"), 1).alias("size"))


@query("a07_top_domains", "SELECT host, n FROM (SELECT split_part(CASE WHEN url LIKE '%://%' THEN split_part(url, '://', 2) ELSE url END, '/', 1) AS host, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, host LIMIT 10) WHERE host <> ''")
def _(t):
    return A.top(t.pages, urls.host_as_written(F.col("url")), 10, "host").filter("host <> ''")


@query("a08_rolling_counts", f"SELECT userId, count(*) FILTER (createdAt >= {NOW_SQL} - INTERVAL 7 DAY) AS d7, count(*) FILTER (createdAt >= {NOW_SQL} - INTERVAL 30 DAY) AS d30, count(*) FILTER (createdAt >= {NOW_SQL} - INTERVAL 365 DAY) AS d365 FROM bookmarks GROUP BY userId", "bookmarks")
def _(t):
    since = lambda d: F.count_if(F.col("createdAt") >= F.lit(NOW) - F.expr(f"INTERVAL {d} DAYS")).alias(f"d{d}")
    return t.bookmarks.groupBy("userId").agg(since(7), since(30), since(365))


@query("a09_hour_histogram", "SELECT CAST(h.h AS INTEGER) AS bin, count(e.ts) AS n FROM range(24) h(h) LEFT JOIN events e ON extract(hour FROM e.ts) = h.h GROUP BY 1")
def _(t):
    return A.dense_histogram(t.events, F.hour("ts"), 0, 23)


@query("a09_weekday_histogram", "SELECT CAST(h.h AS INTEGER) AS bin, count(e.ts) AS n FROM range(7) h(h) LEFT JOIN events e ON extract(dow FROM e.ts) = h.h GROUP BY 1")
def _(t):
    return A.dense_histogram(t.events, F.dayofweek("ts") - 1, 0, 6)


@query("a10_top_tags", "SELECT name, count(*) AS n FROM tags_on JOIN tags ON id = tagId GROUP BY name ORDER BY n DESC, name LIMIT 10", "tags", "tags_on")
def _(t):
    return A.top(t.tags_on.join(t.tags, F.col("tagId") == F.col("id")), "name", 10, "name")


@query("a11_year_counts", "SELECT count(*) AS n, count(*) FILTER (favourited) AS fav, count(*) FILTER (archived) AS archived FROM bookmarks WHERE createdAt >= TIMESTAMP '1995-01-01 00:00:00' AND createdAt <= TIMESTAMP '1995-12-31 23:59:59'", "bookmarks")
def _(t):
    year = t.bookmarks.filter("createdAt >= timestamp_ntz'1995-01-01 00:00:00' AND createdAt <= timestamp_ntz'1995-12-31 23:59:59'")
    return A.counts_if(year, n=F.lit(True), fav=F.col("favourited"), archived=F.col("archived"))


@query("a12_first_of_year", "SELECT userId, arg_min(id, (createdAt, id)) AS id FROM bookmarks WHERE extract(year FROM createdAt) = 1995 GROUP BY userId", "bookmarks")
def _(t):
    return t.bookmarks.filter(F.year("createdAt") == 1995).groupBy("userId").agg(F.min_by("id", F.struct("createdAt", "id")).alias("id"))


@query("a13_month_histogram", "SELECT CAST(m.m AS INTEGER) AS bin, count(b.id) AS n FROM range(1, 13) m(m) LEFT JOIN bookmarks b ON extract(month FROM b.createdAt) = m.m AND extract(year FROM b.createdAt) = 1995 GROUP BY 1", "bookmarks")
def _(t):
    return A.dense_histogram(t.bookmarks.filter(F.year("createdAt") == 1995), F.month("createdAt"), 1, 12)


@query("a14_peak_hour_and_day", """SELECT (SELECT h FROM (SELECT extract(hour FROM ts) AS h, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, h LIMIT 1) AS hour,
    (SELECT CAST(d AS VARCHAR) FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events GROUP BY 1) ORDER BY n DESC, d LIMIT 1) AS day""")
def _(t):
    hours = t.events.groupBy(F.hour("ts").cast("long").alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("h", F.struct("n", -F.col("h"))).alias("hour"))
    days = t.events.groupBy(F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("d", F.struct(-F.col("n"), "d")).cast("string").alias("day"))
    return hours.crossJoin(days)  # one row each


@query("a15_enough_rows", "SELECT userId, count(*) >= 20 AS enough FROM bookmarks GROUP BY userId", "bookmarks")
def _(t):
    return t.bookmarks.groupBy("userId").agg((F.count(F.lit(1)) >= 20).alias("enough"))


@query("a16_top_tags_of_year", "SELECT t.name, count(*) AS n FROM tags_on o JOIN tags t ON t.id = o.tagId JOIN bookmarks b ON b.id = o.bookmarkId WHERE extract(year FROM b.createdAt) = 1995 GROUP BY 1 ORDER BY n DESC, t.name LIMIT 5", "tags", "tags_on", "bookmarks")
def _(t):
    year = t.bookmarks.filter(F.year("createdAt") == 1995).select(F.col("id").alias("bookmarkId"))
    return A.top(t.tags_on.join(year, "bookmarkId").join(t.tags, F.col("tagId") == F.col("id")), "name", 5, "name")


@query("a17_tag_list", "SELECT t.id, t.name, count(*) FILTER (o.attachedBy = 'ai') AS ai, count(*) FILTER (o.attachedBy = 'human') AS human, count(o.tagId) AS total FROM tags t LEFT JOIN tags_on o ON o.tagId = t.id GROUP BY 1, 2", "tags", "tags_on")
def _(t):
    return A.tag_list(t.tags, t.tags_on)


@query("a17_tags_by_machine_only", "SELECT t.id FROM tags t JOIN tags_on o ON o.tagId = t.id JOIN bookmarks b ON b.id = o.bookmarkId WHERE b.favourited AND extract(year FROM b.createdAt) = 1996 GROUP BY 1 HAVING count(*) FILTER (o.attachedBy = 'human') = 0", "tags", "tags_on", "bookmarks")
def _(t):
    liked = t.bookmarks.filter(F.col("favourited") & (F.year("createdAt") == 1996)).select(F.col("id").alias("bookmarkId"))
    return A.tag_list(t.tags, t.tags_on.join(liked, "bookmarkId")).filter("ai > 0 AND human = 0").select("id")


@query("a18_tag_stats", "SELECT tagId, count(*) FILTER (attachedBy = 'ai') AS ai, count(*) FILTER (attachedBy = 'human') AS human FROM tags_on GROUP BY tagId", "tags_on")
def _(t):
    return t.tags_on.groupBy("tagId").pivot("attachedBy", ["ai", "human"]).count().na.fill(0, ["ai", "human"])


@query("a19_per_user_sizes", "SELECT u.id, count(b.id) AS n, round(coalesce(sum(CASE WHEN b.type = 'asset' THEN b.size END), 0), 2) AS assets FROM users u LEFT JOIN bookmarks b ON b.userId = u.id GROUP BY 1", "users", "bookmarks")
def _(t):
    own = t.bookmarks.groupBy("userId").agg(F.count(F.lit(1)).alias("c"), F.sum(F.when(F.col("type") == "asset", F.col("size"))).alias("s"))
    return t.users.join(own, F.col("id") == F.col("userId"), "left").select("id", F.coalesce("c", F.lit(0)).alias("n"), F.round(F.coalesce("s", F.lit(0.0)), 2).alias("assets"))


@query("a20_status_matrix", "SELECT CASE WHEN balance < 0 THEN 'past_due' ELSE 'active' END AS status, coalesce(nullif(tier, 'MACHINERY'), 'free') AS tier, count(*) AS n FROM users GROUP BY 1, 2", "users")
def _(t):
    return t.users.groupBy(F.when(F.col("balance") < 0, "past_due").otherwise("active").alias("status"), F.coalesce(F.nullif("tier", F.lit("MACHINERY")), F.lit("free")).alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query("a21_backlog", "SELECT count(*) FILTER (crawlStatus = 'failure') AS failed, count(*) FILTER (crawlStatus = 'success') AS done, count(*) FILTER (crawlStatusCode > 299) AS odd FROM links", "links")
def _(t):
    return A.counts_if(t.links, failed=F.col("crawlStatus") == "failure", done=F.col("crawlStatus") == "success", odd=F.col("crawlStatusCode") > 299)


@query("a22_status_columns", "SELECT user_id, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").pivot("event_type", ["view", "click", "purchase", "signup", "error"]).count().na.fill(0)


@query("a24_recent_by_cluster", "SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1")
def _(t):
    newest = t.events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    return t.events.join(newest, F.col("ts") >= F.col("since")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("a25_evidence_top", "SELECT user_id, round(coalesce(sum(value), 0), 4) AS evidence FROM events GROUP BY 1 ORDER BY evidence DESC, user_id LIMIT 20")
def _(t):
    return t.events.groupBy("user_id").agg(F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 4).alias("evidence")).orderBy(F.desc("evidence"), "user_id").limit(20)


@query("a26_status_counts", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query("a27_observation_rate", """SELECT coalesce(round(avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END), 6), 1) AS rate FROM events
    WHERE ts >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 28 DAY AND ts < TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 1 DAY""")
def _(t):
    now = F.lit(datetime(2024, 1, 31))  # noqa: DTZ001
    inside = t.events.filter((F.col("ts") >= now - F.expr("INTERVAL 28 DAYS")) & (F.col("ts") < now - F.expr("INTERVAL 1 DAY")))
    return inside.agg(F.coalesce(F.round(F.avg(F.when(F.col("event_type") == "view", 1.0).otherwise(0.0)), 6), F.lit(1.0)).alias("rate"))


@query("a28_pool_size", "SELECT label, count(*) AS n FROM embeddings GROUP BY 1")
def _(t):
    return t.raw("embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("a35_tags_by_use", "SELECT name, count(*) AS n FROM tags_on JOIN tags ON id = tagId GROUP BY name ORDER BY n DESC, name LIMIT 200", "tags", "tags_on")
def _(t):
    return A.top(t.tags_on.join(t.tags, F.col("tagId") == F.col("id")), "name", 200, "name")


@query("a36_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").distinct()


@query("a37_latency_histogram", """SELECT '1.0' AS le, count(*) FILTER (value <= 1) AS n FROM events UNION ALL SELECT '5.0', count(*) FILTER (value <= 5) FROM events UNION ALL SELECT '25.0', count(*) FILTER (value <= 25) FROM events
    UNION ALL SELECT '100.0', count(*) FILTER (value <= 100) FROM events UNION ALL SELECT '+Inf', count(value) FROM events""")
def _(t):
    return A.latency_histogram(t.events, "value", [1.0, 5.0, 25.0, 100.0])


@query("a38_list_sizes", "SELECT l.id, count(m.bookmarkId) AS n FROM lists l LEFT JOIN in_lists m ON m.listId = l.id GROUP BY 1", "lists", "in_lists")
def _(t):
    return t.lists.join(t.in_lists, F.col("id") == F.col("listId"), "left").groupBy("id").agg(F.count("bookmarkId").alias("n"))


# --- joins and set operations


@query("j01_inner", "SELECT l.id, l.url, b.archived FROM links l JOIN bookmarks b ON b.id = l.id", "links", "bookmarks")
def _(t):
    return t.links.join(t.bookmarks, "id").select("id", "url", "archived")


@query("j02_three_way", "SELECT b.userId, t.name, count(*) AS n FROM tags t JOIN tags_on o ON o.tagId = t.id JOIN bookmarks b ON b.id = o.bookmarkId GROUP BY 1, 2", "tags", "tags_on", "bookmarks")
def _(t):
    return t.tags.join(t.tags_on, F.col("id") == F.col("tagId")).drop("id").join(t.bookmarks.select("id", "userId"), F.col("id") == F.col("bookmarkId")).groupBy("userId", "name").agg(F.count(F.lit(1)).alias("n"))


@query("j03_left_keeps_unused", "SELECT t.id, count(o.bookmarkId) AS n FROM tags t LEFT JOIN tags_on o ON o.tagId = t.id AND o.attachedBy = 'ai' GROUP BY 1", "tags", "tags_on")
def _(t):
    return t.tags.join(t.tags_on.filter("attachedBy = 'ai'"), F.col("id") == F.col("tagId"), "left").groupBy("id").agg(F.count("bookmarkId").alias("n"))


@query("j04_left_either_side", "SELECT u.id FROM users u LEFT JOIN (SELECT DISTINCT userId FROM bookmarks WHERE favourited) f ON f.userId = u.id WHERE f.userId IS NOT NULL OR u.balance < 0", "users", "bookmarks")
def _(t):
    fav = t.bookmarks.filter("favourited").select("userId").distinct()
    return t.users.join(fav, F.col("id") == F.col("userId"), "left").filter("userId IS NOT NULL OR balance < 0").select("id")


@query("j05_nested_documents", """SELECT b.id, coalesce(t.tags, '') AS tags, coalesce(l.n, 0) AS lists FROM bookmarks b
    LEFT JOIN (SELECT bookmarkId, string_agg(name, '|' ORDER BY name) AS tags FROM (SELECT DISTINCT bookmarkId, tagId FROM tags_on) d JOIN tags ON id = d.tagId GROUP BY 1) t ON t.bookmarkId = b.id
    LEFT JOIN (SELECT bookmarkId, count(*) AS n FROM in_lists GROUP BY 1) l ON l.bookmarkId = b.id""", "bookmarks", "tags", "tags_on", "in_lists")
def _(t):
    docs = A.documents(t.bookmarks, t.tags, t.tags_on, t.in_lists)
    return docs.select("id", F.array_join(F.sort_array(F.transform("tags", lambda x: x["name"])), "|").alias("tags"), F.size("lists").cast("long").alias("lists"))


@query("j06_semi", "SELECT id FROM bookmarks b WHERE EXISTS (SELECT 1 FROM tags_on o WHERE o.bookmarkId = b.id AND o.attachedBy = 'ai')", "bookmarks", "tags_on")
def _(t):
    return t.bookmarks.join(t.tags_on.filter("attachedBy = 'ai'"), F.col("id") == F.col("bookmarkId"), "left_semi").select("id")


@query("j07_anti", "SELECT id FROM tags t WHERE NOT EXISTS (SELECT 1 FROM tags_on o JOIN bookmarks b ON b.id = o.bookmarkId WHERE o.tagId = t.id AND b.favourited AND extract(year FROM b.createdAt) = 1996)", "tags", "tags_on", "bookmarks")
def _(t):
    liked = t.bookmarks.filter(F.col("favourited") & (F.year("createdAt") == 1996)).select(F.col("id").alias("bookmarkId"))
    return t.tags.join(t.tags_on.join(liked, "bookmarkId"), F.col("id") == F.col("tagId"), "left_anti").select("id")


@query("j08_purge_unless_used", "SELECT id FROM bookmarks b WHERE createdAt < TIMESTAMP '1996-01-01 00:00:00' AND NOT EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id AND m.listId < 20)", "bookmarks", "in_lists")
def _(t):
    old = t.bookmarks.filter("createdAt < timestamp_ntz'1996-01-01 00:00:00'")
    return old.join(t.in_lists.filter("listId < 20"), F.col("id") == F.col("bookmarkId"), "left_anti").select("id")


@query("j09_in_list", "SELECT id, size FROM bookmarks WHERE userId IN (SELECT id FROM users WHERE nation = 3)", "bookmarks", "users")
def _(t):
    return t.bookmarks.join(t.users.filter("nation = 3").select(F.col("id").alias("userId")), "userId", "left_semi").select("id", "size")


@query("j10_two_keys", "SELECT o.bookmarkId, o.tagId, m.listId FROM tags_on o LEFT JOIN in_lists m ON m.bookmarkId = o.bookmarkId AND m.listId = o.tagId", "tags_on", "in_lists")
def _(t):
    m = t.in_lists.withColumnRenamed("bookmarkId", "b")
    return t.tags_on.join(m, (F.col("b") == F.col("bookmarkId")) & (F.col("listId") == F.col("tagId")), "left").select("bookmarkId", "tagId", "listId")


@query("j12_ranking_input", "SELECT e.vec_id, p.url, s.s_name AS source FROM embeddings e LEFT JOIN pages p ON p.page_id = e.vec_id LEFT JOIN supplier s ON s.s_suppkey = e.label")
def _(t):
    return t.raw("embeddings").select("vec_id", "label").join(t.pages.select(F.col("page_id").alias("vec_id"), "url"), "vec_id", "left").join(t.raw("supplier").select(F.col("s_suppkey").cast("int").alias("label"), F.col("s_name").alias("source")), "label", "left").select("vec_id", "url", "source")


@query("j17_tree_paths", "SELECT 's' || s_suppkey AS id, 2 AS depth, r_name || '/' || n_name || '/' || s_name AS path FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'n' || n_nationkey, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT 'r' || r_regionkey, 0, r_name FROM region")
def _(t):
    text_id = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    nodes = t.raw("region").select(text_id("r", "r_regionkey").alias("id"), F.lit(None).cast("string").alias("parentId"), F.col("r_name").alias("name"))
    nodes = nodes.union(t.raw("nation").select(text_id("n", "n_nationkey"), text_id("r", "n_regionkey"), "n_name")).union(t.raw("supplier").select(text_id("s", "s_suppkey"), text_id("n", "s_nationkey"), "s_name"))
    return A.tree_paths(nodes)


@query("u01_intersection", "SELECT bookmarkId AS id FROM in_lists WHERE listId < 30 INTERSECT SELECT bookmarkId FROM tags_on WHERE attachedBy = 'ai' INTERSECT SELECT id FROM bookmarks WHERE archived", "in_lists", "tags_on", "bookmarks")
def _(t):
    return A.intersect_ids([t.in_lists.filter("listId < 30").select(F.col("bookmarkId").alias("id")), t.tags_on.filter("attachedBy = 'ai'").select(F.col("bookmarkId").alias("id")), t.bookmarks.filter("archived").select("id")])


@query("u02_union", "SELECT id FROM bookmarks WHERE favourited UNION SELECT bookmarkId FROM in_lists WHERE listId = 1", "bookmarks", "in_lists")
def _(t):
    return A.union_ids([t.bookmarks.filter("favourited").select("id"), t.in_lists.filter("listId = 1").select("bookmarkId")])


@query("u04_difference", "SELECT page_id FROM pages EXCEPT SELECT DISTINCT label FROM embeddings")
def _(t):
    return t.pages.select("page_id").join(t.raw("embeddings").select(F.col("label").cast("long").alias("page_id")), "page_id", "left_anti").distinct()


@query("u05_merge_ignore_conflicts", "SELECT DISTINCT bookmarkId, CASE WHEN tagId IN (1, 2, 3, 4) THEN 1 ELSE tagId END AS tagId FROM tags_on", "tags_on")
def _(t):
    return t.tags_on.select("bookmarkId", F.when(F.col("tagId").isin(1, 2, 3, 4), 1).otherwise(F.col("tagId")).alias("tagId")).dropDuplicates(["bookmarkId", "tagId"])


# --- sort, pages, windows


@query("t01_keyset_newest", "SELECT id, CAST(createdAt AS VARCHAR) AS created FROM bookmarks WHERE createdAt < TIMESTAMP '1996-01-01 00:00:00' OR (createdAt = TIMESTAMP '1996-01-01 00:00:00' AND id <= 5000) ORDER BY createdAt DESC, id DESC LIMIT 21", "bookmarks")
def _(t):
    page = A.keyset_page(t.bookmarks, "createdAt", "id", 20, True, (datetime(1996, 1, 1), 5000))  # noqa: DTZ001
    return page.select("id", F.date_format("createdAt", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query("t02_keyset_oldest", "SELECT id FROM bookmarks WHERE createdAt > TIMESTAMP '1996-01-01 00:00:00' OR (createdAt = TIMESTAMP '1996-01-01 00:00:00' AND id >= 5000) ORDER BY createdAt, id LIMIT 21", "bookmarks")
def _(t):
    return A.keyset_page(t.bookmarks, "createdAt", "id", 20, False, (datetime(1996, 1, 1), 5000)).select("id")  # noqa: DTZ001


@query("t03_keyset_by_id", "SELECT id FROM bookmarks WHERE id > 500 ORDER BY id LIMIT 51", "bookmarks")
def _(t):
    return t.bookmarks.filter("id > 500").select("id").orderBy("id").limit(51)


@query("t04_offset_page", "SELECT id, name FROM tags ORDER BY name, id LIMIT 25 OFFSET 50", "tags")
def _(t):
    return A.offset_page(t.tags, [F.col("name"), F.col("id")], 2, 25)


@query("t06_tag_relevance", "SELECT id, name FROM tags WHERE name LIKE '%hot%' ORDER BY CASE WHEN name = 'hot' THEN 2 WHEN name LIKE 'hot%' THEN 1 ELSE 0 END DESC, length(name), name, id LIMIT 20", "tags")
def _(t):
    rank = F.when(F.col("name") == "hot", 2).when(F.col("name").startswith("hot"), 1).otherwise(0)
    return t.tags.filter(F.col("name").contains("hot")).orderBy(F.desc(rank), F.length("name"), "name", "id").limit(20)


@query("t09_largest", "SELECT id, size FROM bookmarks ORDER BY size DESC, id LIMIT 50", "bookmarks")
def _(t):
    return t.bookmarks.select("id", "size").orderBy(F.desc("size"), "id").limit(50)


@query("t10_fair_batch", """SELECT id FROM (SELECT b.id, row_number() OVER (ORDER BY s.last NULLS FIRST, b.createdAt, b.id) AS rn FROM bookmarks b JOIN (SELECT userId, max(createdAt) FILTER (archived) AS last FROM bookmarks GROUP BY 1) s ON s.userId = b.userId
    WHERE NOT b.archived AND b.userId NOT IN (7, 8)) WHERE rn <= 10 AND rn + (SELECT count(*) FROM bookmarks WHERE userId IN (7, 8) AND NOT archived) <= 20""", "bookmarks")
def _(t):
    state = F.when(F.col("archived"), "completed").when(F.col("userId").isin(7, 8), "processing").otherwise("pending")
    items = t.bookmarks.select("id", F.col("userId").alias("sessionId"), state.alias("status"), "createdAt")
    sessions = t.bookmarks.groupBy(F.col("userId").alias("id")).agg(F.max(F.when(F.col("archived"), F.col("createdAt"))).alias("lastProcessedAt"))
    return M.claim(items, sessions, in_flight=20).select("id")


@query("t12_best_unselected", "SELECT id, size FROM bookmarks b WHERE NOT EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id AND m.listId < 50) ORDER BY size DESC, id LIMIT 100", "bookmarks", "in_lists")
def _(t):
    return t.bookmarks.join(t.in_lists.filter("listId < 50"), F.col("id") == F.col("bookmarkId"), "left_anti").select("id", "size").orderBy(F.desc("size"), "id").limit(100)


@query("wf1_best_per_group", "SELECT userId, id, size FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY size DESC, id) AS rn FROM bookmarks) WHERE rn = 1", "bookmarks")
def _(t):
    return A.first_per(t.bookmarks, ["userId"], [F.desc("size"), F.asc("id")]).select("userId", "id", "size")


@query("wf4_newest_within_quota", "SELECT userId, id FROM (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY createdAt DESC, id) AS rn FROM bookmarks) WHERE rn <= 3", "bookmarks")
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("userId").orderBy(F.desc("createdAt"), "id")
    return t.bookmarks.withColumn("rn", F.row_number().over(w)).filter("rn <= 3").select("userId", "id")


@query("wf5_last_operation", "SELECT user_id, arg_max(event_type, event_id) AS op FROM events GROUP BY 1")
def _(t):
    return A.last_operation(t.events, "user_id", "event_id").select("user_id", F.col("event_type").alias("op"))


# --- search


def _search(name: str, text_: str, sql: str, *tables: str):
    query(name, sql, *tables)(lambda t: search.find(library(t, "title:" in text_), text_, NOW))


_search("p09_favourited", "is:fav", "SELECT id FROM bookmarks WHERE favourited", "bookmarks")
_search("p02_tagged", "-is:tagged", "SELECT id FROM bookmarks b WHERE NOT EXISTS (SELECT 1 FROM tags_on o WHERE o.bookmarkId = b.id)", "bookmarks", "tags_on")
_search("p03_list", "list:Supplier#000000001", "SELECT id FROM bookmarks WHERE id IN (SELECT bookmarkId FROM in_lists JOIN lists ON lists.id = listId WHERE name = 'Supplier#000000001')", "bookmarks", "in_lists", "lists")
_search("p03_missing_list_negated", "-list:missing", "SELECT id FROM bookmarks WHERE false", "bookmarks")
_search("p04_in_list", "is:inlist", "SELECT id FROM bookmarks b WHERE EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id)", "bookmarks", "in_lists")
_search("p05_feed", "-feed:NATION_3", "SELECT b.id FROM bookmarks b JOIN users u ON u.id = b.userId JOIN nation ON n_nationkey = u.nation WHERE n_name <> 'NATION_3'", "bookmarks", "users")
_search("p06_archived", "-is:archived", "SELECT id FROM bookmarks WHERE NOT archived", "bookmarks")
_search("p07_url", "url:example.com/en", "SELECT id FROM links WHERE url ILIKE '%example.com/en%' UNION SELECT id FROM assets WHERE sourceUrl ILIKE '%example.com/en%'", "links", "assets")
_search("p07_url_negated", "-url:example.com/en", "SELECT id FROM links WHERE NOT url ILIKE '%example.com/en%' UNION SELECT id FROM assets WHERE NOT sourceUrl ILIKE '%example.com/en%'", "links", "assets")
_search("p03_smart_list", "list:Supplier#000000000", "SELECT id FROM bookmarks WHERE favourited AND NOT archived", "bookmarks")
_search("p03_smart_list_negated", "is:link -list:Supplier#000000000", "SELECT id FROM bookmarks WHERE type = 'link' AND NOT (favourited AND NOT archived)", "bookmarks")
_search("p17_sets_below_or", "(is:inlist or url:example.com/en) and (-is:tagged or feed:NATION_3)", """SELECT b.id FROM bookmarks b WHERE (EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id) OR b.id IN (SELECT id FROM links WHERE url ILIKE '%example.com/en%') OR b.id IN (SELECT id FROM assets WHERE sourceUrl ILIKE '%example.com/en%'))
    AND (NOT EXISTS (SELECT 1 FROM tags_on o WHERE o.bookmarkId = b.id) OR b.userId IN (SELECT id FROM users WHERE nation = 3))""", "bookmarks", "in_lists", "links", "assets", "tags_on", "users")
_search("p08_title", "title:en", "SELECT b.id FROM bookmarks b LEFT JOIN tags t ON t.id = b.id + 1 LEFT JOIN links l ON l.id = b.id WHERE t.name ILIKE '%en%' OR l.title ILIKE '%en%'", "bookmarks", "tags", "links")
_search("p10_after", "after:1996-05-01", "SELECT id FROM bookmarks WHERE createdAt >= TIMESTAMP '1996-05-01 00:00:00'", "bookmarks")
_search("p11_before_negated", "-before:1996-05-01", "SELECT id FROM bookmarks WHERE createdAt > TIMESTAMP '1996-05-01 00:00:00'", "bookmarks")
_search("p12_age", "age:<2y", f"SELECT id FROM bookmarks WHERE createdAt >= {NOW_SQL} - INTERVAL 2 YEAR", "bookmarks")
_search("p13_type", "is:media", "SELECT id FROM bookmarks WHERE type = 'asset'", "bookmarks")
_search("p14_broken", "is:broken", "SELECT b.id FROM bookmarks b JOIN links l ON l.id = b.id WHERE l.crawlStatus = 'failure' OR l.crawlStatusCode < 200 OR l.crawlStatusCode > 299", "bookmarks", "links")
_search("p14_not_broken", "-is:broken", "SELECT b.id FROM bookmarks b JOIN links l ON l.id = b.id WHERE l.crawlStatus = 'success' AND l.crawlStatusCode BETWEEN 200 AND 299", "bookmarks", "links")
_search("p16_and", "is:archived is:fav is:link", "SELECT id FROM bookmarks WHERE archived AND favourited AND type = 'link'", "bookmarks")
_search("p17_or_and", "(is:fav or is:archived) and -is:text and is:inlist", "SELECT id FROM bookmarks b WHERE (favourited OR archived) AND type <> 'text' AND EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id)", "bookmarks", "in_lists")


@query("p01_tag_name", "SELECT id FROM bookmarks WHERE id IN (SELECT bookmarkId FROM tags_on WHERE tagId IN (SELECT id FROM tags WHERE name = (SELECT min(name) FROM tags)))", "bookmarks", "tags_on", "tags")
def _(t):
    from ..plans.query_language import Leaf

    return search.matching(library(t, False), Leaf("tag", t.tags.agg(F.min("name")).first()[0]))


@query("p15_source_negated", "SELECT id FROM bookmarks WHERE source IS NULL OR source <> '1-URGENT'", "bookmarks")
def _(t):
    from ..plans.query_language import Leaf

    return search.matching(library(t, False), Leaf("source", "1-URGENT", True))


@query("p18_broken_report", "SELECT l.id, l.url, l.crawlStatusCode AS code, l.crawlStatus = 'failure' AS failed FROM links l WHERE l.crawlStatus = 'failure' OR l.crawlStatusCode NOT BETWEEN 200 AND 299", "links")
def _(t):
    bad = (F.col("crawlStatus") == "failure") | ~F.col("crawlStatusCode").between(200, 299)
    return t.links.filter(bad).select("id", "url", F.col("crawlStatusCode").cast("long").alias("code"), (F.col("crawlStatus") == "failure").alias("failed"))


@query("p19_url_exists", "SELECT DISTINCT page_id FROM pages WHERE regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') IN (SELECT regexp_replace(regexp_replace(url, '#.*$', ''), '/$', '') FROM pages WHERE page_id < 10)")
def _(t):
    some = t.pages.filter("page_id < 10").select(urls.light(F.col("url")).alias("u"))
    return t.pages.select("page_id", urls.light(F.col("url")).alias("u")).join(some, "u", "left_semi").select("page_id")


@query("p20_same_url", "SELECT id FROM links l WHERE EXISTS (SELECT 1 FROM links q WHERE q.url = l.url AND q.id < l.id)", "links")
def _(t):
    first = t.links.groupBy("url").agg(F.min("id").alias("first"))
    return t.links.join(first, "url").filter("id > first").select("id")


@query("p21_highlight_search", "SELECT conv_id, turn FROM conversations WHERE text ILIKE '%the%' OR role ILIKE '%user%' ORDER BY conv_id, turn LIMIT 51")
def _(t):
    hit = search.contains(F.col("text"), "the") | search.contains(F.col("role"), "user")
    return t.raw("conversations").filter(hit).select("conv_id", "turn").orderBy("conv_id", "turn").limit(51)


@query("p22_access", "SELECT DISTINCT b.id FROM bookmarks b WHERE b.userId = 7 OR EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id AND m.listId IN (1, 2))", "bookmarks", "in_lists")
def _(t):
    own = t.bookmarks.filter("userId = 7").select("id")
    return A.union_ids([own, t.bookmarks.join(t.in_lists.filter("listId IN (1, 2)"), F.col("id") == F.col("bookmarkId"), "left_semi").select("id")])


@query("p23_masked_state", "SELECT id, CASE WHEN userId = 7 THEN archived END AS archived FROM bookmarks", "bookmarks")
def _(t):
    return t.bookmarks.select("id", F.when(F.col("userId") == 7, F.col("archived")).alias("archived"))


@query("p24_quota", "SELECT u.id, count(b.id) >= 10 AS full_, round(coalesce(sum(b.size), 0), 2) + 1000 > 1000000 AS over_ FROM users u LEFT JOIN bookmarks b ON b.userId = u.id GROUP BY 1", "users", "bookmarks")
def _(t):
    own = t.bookmarks.groupBy("userId").agg(F.count(F.lit(1)).alias("c"), F.sum("size").alias("s"))
    return t.users.join(own, F.col("id") == F.col("userId"), "left").select("id", (F.coalesce("c", F.lit(0)) >= 10).alias("full_"), (F.round(F.coalesce("s", F.lit(0.0)), 2) + 1000 > 1_000_000).alias("over_"))


@query("v13_full_text", """WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM documents),
    c AS (SELECT doc_id, CAST(len(w) AS DOUBLE) AS l, CAST(len(list_filter(w, lambda x: x = 'the')) AS DOUBLE) AS a, CAST(len(list_filter(w, lambda x: x = 'with')) AS DOUBLE) AS b FROM d),
    s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(l) AS m, CAST(count(*) FILTER (a > 0) AS DOUBLE) AS da, CAST(count(*) FILTER (b > 0) AS DOUBLE) AS db FROM c)
    SELECT doc_id AS id, round(ln(1 + (n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) + ln(1 + (n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score
    FROM c, s WHERE a > 0 AND b > 0""")
def _(t):
    return search.full_text(t.raw("documents"), "the with", "doc_id").select("id", F.round("score", 6).alias("score"))


# --- maintenance as rewrites


@query("d01_unused_tags_go", "SELECT id, name FROM tags t WHERE EXISTS (SELECT 1 FROM tags_on o WHERE o.tagId = t.id)", "tags", "tags_on")
def _(t):
    return t.tags.join(t.tags_on, F.col("id") == F.col("tagId"), "left_semi")


def machine_tags(t):
    """What a machine says of every tenth bookmark: the name of a tag in capitals, and a name that may be new."""
    tenth = t.bookmarks.filter("id % 10 = 0").select(F.col("id").alias("bookmarkId"), (F.col("id") % 50 + 1).alias("id"))
    named = tenth.join(t.tags, "id").select("bookmarkId", F.upper("name").alias("name"))
    return named.unionByName(tenth.select("bookmarkId", F.concat(F.lit("New-tag "), (F.col("bookmarkId") % 3).cast("string")).alias("name")))


MACHINE = f"""found AS (SELECT b.id AS bookmarkId, upper(t.name) AS name FROM bookmarks b JOIN tags t ON t.id = b.id % 50 + 1 WHERE b.id % 10 = 0 UNION ALL SELECT id, 'New-tag ' || (id % 3) FROM bookmarks WHERE id % 10 = 0)"""


@query("d03_retag", f"""SELECT bookmarkId, tagId, attachedBy FROM tags_on WHERE NOT (attachedBy = 'ai' AND bookmarkId % 10 = 0)
    UNION ALL SELECT n.bookmarkId, n.tagId, 'ai' FROM (WITH {MACHINE} SELECT DISTINCT f.bookmarkId, k.tagId FROM found f JOIN (SELECT lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS k, min(id) AS tagId FROM tags GROUP BY 1) k ON k.k = lower(replace(replace(replace(f.name, ' ', ''), '-', ''), '_', ''))) n
    WHERE NOT EXISTS (SELECT 1 FROM tags_on o WHERE o.bookmarkId = n.bookmarkId AND o.tagId = n.tagId AND o.attachedBy <> 'ai')""", "tags_on", "tags", "bookmarks")
def _(t):
    return M.retag(t.tags_on, machine_tags(t), t.tags, text.tag_key)


@query("d03_new_tags", f"SELECT min(name) AS name, lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS k FROM (WITH {MACHINE} SELECT * FROM found) WHERE lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) NOT IN (SELECT lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) FROM tags) GROUP BY 2", "tags", "bookmarks")
def _(t):
    return M.missing_tags(machine_tags(t), t.tags, text.tag_key)


@query("d10_cache_hits", "SELECT a.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id AND a.label = b.label AND len(a.embedding) = len(b.embedding) WHERE b.vec_id % 2 = 0")
def _(t):
    e = t.raw("embeddings").select("vec_id", "label", F.size("embedding").alias("dim"))
    return e.join(e.filter("vec_id % 2 = 0"), ["vec_id", "label", "dim"], "left_semi").select("vec_id")


@query("st13_purge", "SELECT id FROM bookmarks b WHERE NOT (createdAt < TIMESTAMP '1997-01-01 00:00:00' AND NOT EXISTS (SELECT 1 FROM in_lists m WHERE m.bookmarkId = b.id AND m.listId < 10))", "bookmarks", "in_lists")
def _(t):
    used = t.in_lists.filter("listId < 10")
    old = t.bookmarks.filter("createdAt < timestamp_ntz'1997-01-01 00:00:00'").join(used, F.col("id") == F.col("bookmarkId"), "left_anti").select("id")
    return t.bookmarks.select("id").join(old, "id", "left_anti")


@query("st15_latest_state", "SELECT user_id, max(value) AS best, arg_max(event_type, (ts, event_id)) AS state FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(F.max("value").alias("best"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))


@query("f08_tag_key", "SELECT id, lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS key FROM tags", "tags")
def _(t):
    return t.tags.select("id", text.tag_key(F.col("name")).alias("key"))


@query("f11_edit_distance", """SELECT a, b, levenshtein(a, b) AS d FROM (SELECT key AS a, lead(key) OVER (PARTITION BY userId ORDER BY key, id) AS b FROM (SELECT DISTINCT userId, tagId AS id, lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS key
    FROM tags_on JOIN bookmarks ON bookmarks.id = bookmarkId JOIN tags ON tags.id = tagId)) WHERE b IS NOT NULL""", "tags_on", "bookmarks", "tags")
def _(t):
    rows = t.user_tags.select("userId", "id", text.tag_key(F.col("name")).alias("a"))
    after = rows.withColumn("b", F.lead("a").over(Window.partitionBy("userId").orderBy("a", "id"))).filter("b IS NOT NULL")
    return after.select("a", "b", F.levenshtein("a", "b").cast("long").alias("d"))


@query("f14_escape", """SELECT page_id, replace(replace(replace(replace(replace(replace(html, '&', '&amp;'), '''', '&#x27;'), '`', '&#x60;'), '"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS html FROM pages""")
def _(t):
    return t.pages.select("page_id", text.escape_html(F.col("html")).alias("html"))


@query("f15_hrefs", "SELECT page_id, array_to_string(regexp_extract_all(html, '<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), ' ') AS links FROM pages")
def _(t):
    return t.pages.select("page_id", F.array_join(text.hrefs(F.col("html")), " ").alias("links"))


@query("f02_url_hash", "SELECT page_id, substr(sha256(url), 1, 32) AS hash FROM pages")
def _(t):
    return t.pages.select("page_id", urls.url_hash(F.col("url")).alias("hash"))


@query("f07_allowed", "SELECT page_id, regexp_matches(url, '^https?://[^\\s/]+') AS allowed FROM pages")
def _(t):
    return t.pages.select("page_id", urls.allowed(F.col("url")).alias("allowed"))


@query("f21_token_estimate", "SELECT doc_id, CAST(ceil((length(text) - n) * 1.5 + n * 0.35 - 1e-9) AS BIGINT) AS tokens FROM (SELECT doc_id, text, length(regexp_replace(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}]', '', 'g')) AS n FROM documents)")
def _(t):
    n = text.cjk_count(F.col("text"))
    return t.raw("documents").select("doc_id", F.ceil(n * F.lit(1.5) + (F.length("text") - n) * F.lit(0.35) - 1e-9).alias("tokens"))
