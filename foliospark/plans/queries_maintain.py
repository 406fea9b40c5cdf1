"""Maintenance, import, export and content queries with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, urls
from ..operators import analytics as A
from ..operators import maintenance as M
from ..operators import recommend as R
from ..sources import imports as I
from .queries_library import NOW, NOW_SQL
from ..sources.tables import Tables, with_tables
from ..streaming import keyed

Q: dict = {}
S: dict[str, str] = {}
HOST_SQL = "regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1)"


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            S[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def host(c="url"):
    return F.regexp_extract(c, r"^https?://(?:www\.)?([^/:?#]+)", 1)


# --- rewrites


@query("d02_merge_tags", "SELECT bookmarkId, CASE WHEN tagId BETWEEN 2 AND 20 THEN 1 ELSE tagId END AS tagId, max(attachedBy) AS attachedBy FROM tags_on GROUP BY 1, 2", "tags_on")
def _(t):
    mapping = t.tags.filter("id BETWEEN 2 AND 20").select(F.col("id").alias("source"), F.lit(1).cast("long").alias("target"))
    return M.merge_tags(t.tags, t.tags_on, mapping)[1]


@query("d04_merge_lists", "SELECT DISTINCT bookmarkId, CASE WHEN listId IN (2, 3) THEN 1 ELSE listId END AS listId FROM in_lists", "in_lists")
def _(t):
    ids = t.lists.filter("id IN (2, 3)").select(F.col("id").alias("old"), F.lit(1).cast("long").alias("new"))
    return M.remap(t.in_lists, ids, "listId").select("bookmarkId", "listId").distinct()


@query("d05_archived_sessions", f"""SELECT u.id, strftime(f.last, '%Y-%m-%d') AS finished, count(b.id) FILTER (type = 'text') AS pending, count(b.id) FILTER (type = 'asset') AS processing, count(b.id) FILTER (type = 'link' AND NOT b.archived) AS completed, count(b.id) FILTER (type = 'link' AND b.archived) AS failed
    FROM users u JOIN (SELECT userId, max(createdAt) AS last FROM bookmarks GROUP BY 1) f ON f.userId = u.id LEFT JOIN bookmarks b ON b.userId = u.id AND b.favourited WHERE f.last <= {NOW_SQL} + INTERVAL 2 YEAR GROUP BY 1, 2""", "users", "bookmarks")
def _(t):
    sessions = t.users.select("id").join(t.bookmarks.groupBy(F.col("userId").alias("id")).agg(F.max("createdAt").alias("finishedAt")), "id")
    state = F.when(F.col("type") == "text", "pending").when(F.col("type") == "asset", "processing").when(F.col("archived"), "failed").otherwise("completed")
    items = t.bookmarks.filter("favourited").select(F.col("userId").alias("sessionId"), state.alias("status"))
    out = M.archive_sessions(sessions, items, F.lit(NOW) + F.expr("INTERVAL 2 YEARS") + F.expr("INTERVAL 30 DAYS"))
    return out.select("id", F.date_format("finishedAt", "yyyy-MM-dd").alias("finished"), "pending", "processing", "completed", "failed")


@query("d08_list_tree", """SELECT CASE WHEN n_regionkey = 4 THEN n_name ELSE r_name || '/' || n_name END AS path FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name FROM region WHERE r_regionkey <> 4
    UNION ALL SELECT 'Loop ' || r_regionkey FROM region""")
def _(t):
    """Regions and their nations, without the fourth region; and lists that are below each other in a circle."""
    nodes = t.raw("region").filter("r_regionkey <> 4").select((F.col("r_regionkey") + 1000).alias("id"), F.lit(None).cast("int").alias("parentId"), F.col("r_name").alias("name"))
    nodes = nodes.union(t.raw("nation").select("n_nationkey", F.col("n_regionkey") + 1000, "n_name"))
    loop = t.raw("region").select((F.col("r_regionkey") + 2000).alias("id"), ((F.col("r_regionkey") + 1) % 5 + 2000).alias("parentId"), F.concat(F.lit("Loop "), F.col("r_regionkey").cast("string")).alias("name"))
    return A.tree_paths(nodes.union(loop), lost_to_root=True).select("path")


@query("d09_rerun_keeps_feedback", "SELECT id FROM bookmarks WHERE id % 2 = 0 AND (id % 4 = 0 OR archived) UNION SELECT id FROM bookmarks WHERE id % 3 = 0", "bookmarks")
def _(t):
    rows = t.bookmarks.select(F.col("id").alias("impressionId"), F.col("id").alias("candidateId"), "archived")
    old, new = rows.filter("impressionId % 2 = 0").drop("archived"), rows.filter("impressionId % 3 = 0").drop("archived")
    return M.keep_with_feedback(old, new, rows.filter("impressionId % 4 = 0 OR archived").select("impressionId")).select(F.col("candidateId").alias("id"))


@query("st09_stale_items", "SELECT event_id AS id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 1 HOUR THEN 'pending' WHEN event_type = 'view' THEN 'processing' ELSE 'completed' END AS status FROM events")
def _(t):
    items = t.events.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "processing").otherwise("completed").alias("status"), F.col("ts").alias("startedAt"))
    return M.stale_to_pending(items, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("id", "status")


@query("st12_past_days", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) FILTER (event_type = 'view') AS viewed FROM events WHERE ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1, 2")
def _(t):
    past = t.events.filter(F.col("ts") < F.expr("timestamp_ntz'2024-01-20 00:00:00'"))
    return past.groupBy("user_id", F.to_date("ts").cast("string").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("viewed"))


@query("st14_cache_purge", "SELECT event_id FROM events WHERE coalesce(CASE WHEN event_type = 'click' THEN ts + INTERVAL 5 DAY END, ts) >= TIMESTAMP '2024-01-15 00:00:00'")
def _(t):
    cache = t.events.select("event_id", F.col("ts").alias("createdAt"), F.when(F.col("event_type") == "click", F.col("ts") + F.expr("INTERVAL 5 DAYS")).alias("lastUsedAt"))
    return M.purge_cache(cache, F.expr("timestamp_ntz'2024-01-15 00:00:00'")).select("event_id")


@query("st16_upsert", "SELECT user_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(t):
    rows = t.events.select("user_id", "value", "event_id")
    return M.upsert(rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), ["user_id"], "event_id").select("user_id", "value")


@query("st17_insert_new", "SELECT DISTINCT user_id FROM events WHERE event_id % 2 = 1 AND user_id NOT IN (SELECT user_id FROM events WHERE event_id % 97 = 0)")
def _(t):
    users = t.events.select("user_id", "event_id")
    return M.insert_new(users.filter("event_id % 97 = 0"), users.filter("event_id % 2 = 1"), ["user_id"]).select("user_id")


@query("s20_missing_seeds", "SELECT n_name AS name FROM nation WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def _(t):
    n = t.raw("nation").select(F.col("n_name").alias("name"), "n_regionkey")
    return M.missing_seeds(n.select("name"), n.filter("n_regionkey = 1"))


@query("j20_dangling", "SELECT page_id AS key FROM pages WHERE page_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 = 0)")
def _(t):
    return M.dangling(t.pages.select(F.col("page_id").alias("key")), t.raw("documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("id")))


@query("j16_hash_lookup", "SELECT a.page_id, min(b.page_id) AS first FROM pages a JOIN pages b ON substr(sha256(split_part(a.url, '?', 1)), 1, 32) = substr(sha256(split_part(b.url, '?', 1)), 1, 32) GROUP BY 1")
def _(t):
    hashed = t.pages.select("page_id", urls.url_hash(F.substring_index("url", "?", 1)).alias("h"))
    return hashed.join(hashed.groupBy("h").agg(F.min("page_id").alias("first")), "h").select("page_id", "first")


@query("j19_finished_items", "SELECT l.id, CASE WHEN l.crawlStatus = 'failure' THEN 'failed' WHEN b.archived THEN 'completed' ELSE 'processing' END AS state FROM links l LEFT JOIN bookmarks b ON b.id = l.id", "links", "bookmarks")
def _(t):
    state = F.when(F.col("crawlStatus") == "failure", "failed").when(F.col("archived"), "completed").otherwise("processing")
    return t.links.join(t.bookmarks.select("id", "archived"), "id", "left").select("id", state.alias("state"))


@query("j21_children_of_lists", "SELECT l.id, count(m.bookmarkId) AS n, coalesce(min(m.bookmarkId), -1) AS first FROM lists l LEFT JOIN in_lists m ON m.listId = l.id GROUP BY 1", "lists", "in_lists")
def _(t):
    kids = t.in_lists.groupBy("listId").agg(F.sort_array(F.collect_list("bookmarkId")).alias("kids"))
    kept = t.lists.join(kids, F.col("id") == F.col("listId"), "left")
    return kept.select("id", F.greatest(F.size("kids"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.try_element_at("kids", F.lit(1)), F.lit(-1)).alias("first"))


# --- vectors and profiles

DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"


@query("v06_max_similarity", f"SELECT b.vec_id AS id, round(greatest(0, max({DOT})), 5) AS sim FROM embeddings a, embeddings b WHERE a.vec_id < 10 AND b.vec_id >= 10 GROUP BY 1")
def _(t):
    e = t.raw("embeddings")
    few = F.broadcast(e.filter("vec_id < 10").select(F.col("embedding").alias("q")))  # ten rows
    from ..functions.vectors import dot

    return e.filter("vec_id >= 10").join(few).groupBy(F.col("vec_id").alias("id")).agg(F.round(F.greatest(F.lit(0.0), F.max(dot(F.col("embedding"), F.col("q")))), 5).alias("sim"))


@query("v07_mean_of_best", f"SELECT round(avg(s), 5) AS mean FROM (SELECT {DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 5 AND b.vec_id <> 5 ORDER BY s DESC LIMIT 10)")
def _(t):
    from ..functions.vectors import nearest

    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return nearest(e.filter("id <> 5"), e.filter("id = 5").first().vector, 10).agg(F.round(F.avg("score"), 5).alias("mean"))


@query("wf10_representatives", "SELECT label, arg_min(vec_id, (vec_id % 7, vec_id)) AS id FROM embeddings GROUP BY 1")
def _(t):
    rows = t.raw("embeddings").select("label", F.col("vec_id").alias("id"), (F.col("vec_id") % 7).alias("published"))
    return A.first_per(rows, ["label"], [F.asc_nulls_last("published"), F.asc("id")]).select("label", "id")


@query("r16_labels", "SELECT user_id AS impressionId, NOT bool_or(event_type IN ('purchase', 'signup')) AND bool_or(event_type = 'click') AS weak FROM events GROUP BY 1")
def _(t):
    kinds = F.create_map(*[F.lit(x) for x in ("view", "viewed", "click", "clicked", "purchase", "saved", "signup", "liked", "error", "dismissed")])
    return R.rewards(t.events.select(F.col("user_id").alias("impressionId"), F.element_at(kinds, F.col("event_type")).alias("type"))).select("impressionId", "weak")


@query("st10_final_labels", "SELECT i.event_id, count(e.event_id) > 0 AS positive FROM events i LEFT JOIN events e ON e.user_id = i.user_id AND e.event_type = 'purchase' AND e.ts >= i.ts AND e.ts < i.ts + INTERVAL 7 DAY WHERE i.event_type = 'view' AND i.ts < TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1")
def _(t):
    shown = t.events.filter(F.col("event_type") == "view").filter(F.col("ts") < F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select(F.col("event_id").alias("impressionId"), F.col("user_id").alias("itemId"), F.col("ts").alias("shownAt"))
    later = t.events.filter("event_type = 'purchase'").select(F.col("user_id").alias("itemId"), F.lit("saved").alias("type"), F.col("ts").alias("at"))
    hit = R.delayed_events(shown, later).select("impressionId").distinct().withColumn("hit", F.lit(True))
    return shown.join(hit, "impressionId", "left").select(F.col("impressionId").alias("event_id"), F.coalesce("hit", F.lit(False)).alias("positive"))


# --- content, imports, exports


@query("f17_blocked_hosts", f"SELECT page_id, lower({HOST_SQL}) LIKE '%.example.org' OR lower({HOST_SQL}) = 'example.org' AS blocked FROM pages")
def _(t):
    return t.pages.select("page_id", text.on_list(host(), ["example.org"]).alias("blocked"))


@query("f18_recent_activity", "SELECT user_id, count(*) FILTER (ts >= TIMESTAMP '2024-03-31 00:00:00' - INTERVAL 90 DAY) >= 3 AS active FROM events GROUP BY 1")
def _(t):
    since = F.expr("timestamp_ntz'2024-03-31 00:00:00'") - F.expr("INTERVAL 90 DAYS")
    return t.events.groupBy("user_id").agg((F.count_if(F.col("ts") >= since) >= 3).alias("active"))


@query("f24_cjk_share", "SELECT doc_id, CAST(length(text) - length(regexp_replace(text, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}]', '', 'g')) AS BIGINT) AS n FROM documents")
def _(t):
    return t.raw("documents").select("doc_id", text.cjk_count(F.col("text")).cast("long").alias("n"))


@query("f25_html_pieces", "SELECT page_id, length(html) AS n FROM pages")
def _(t):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def pieces(c: pd.Series) -> pd.Series:
        return c.map(lambda h: text.html_pieces(h or "", 3500))

    return t.pages.select("page_id", F.explode(pieces("html")).alias("p")).groupBy("page_id").agg(F.sum(F.length("p")).alias("n"))


@query("f32_title_fallback", "SELECT l.id, coalesce(nullif(l.title, ''), l.url) AS title FROM links l", "links")
def _(t):
    return t.links.select("id", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"))


@query("a34_merge_by_url", f"""SELECT {HOST_SQL} AS url, count(*) AS n, min(page_id) AS first, bool_or(page_id % 2 = 0) AS archived, arg_min('t' || page_id, page_id) FILTER (page_id % 3 <> 0) AS title, string_agg('n' || page_id, chr(10) || '---' || chr(10) ORDER BY page_id) AS notes FROM pages GROUP BY 1""")
def _(t):
    number = F.col("page_id").cast("string")
    rows = t.pages.select(*I.row(title=F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("t"), number)), contentType=F.lit("link"), url=host(), tags=F.array(number), notes=F.concat(F.lit("n"), number), addDate=F.col("page_id"), archived=F.col("page_id") % 2 == 0), F.col("page_id").alias("place"))
    return I.merge_by_url(rows, "place").select("url", F.size("tags").cast("long").alias("n"), F.col("addDate").cast("long").alias("first"), "archived", "title", "notes")


@query("k01_native_records", "SELECT CAST(epoch(createdAt) AS DOUBLE) AS createdAt, id, CASE WHEN type IN ('link', 'text') THEN type END AS kind FROM bookmarks", "bookmarks")
def _(t):
    empty = F.array().cast("array<string>")
    docs = t.bookmarks.select((F.unix_micros(F.col("createdAt").cast("timestamp")) / 1e6).alias("createdAt"), F.col("id").cast("string").alias("title"), empty.alias("tags"), empty.alias("lists"), "type", F.lit("https://x").alias("url"), F.lit("t").alias("text"), F.lit(None).cast("string").alias("note"), "archived")
    return I.native_records(docs).select("createdAt", F.col("title").cast("long").alias("id"), F.col("content.type").alias("kind"))


@query("k03_browser_lines", """SELECT '    <DT><A HREF="' || replace(replace(url, '&', '&amp;'), '''', '&#x27;') || '" ADD_DATE="' || page_id || '"' || CASE WHEN page_id % 2 = 0 THEN ' TAGS="a,b &amp; c"' ELSE '' END || '>' || CASE WHEN page_id % 3 = 0 THEN replace(replace(url, '&', '&amp;'), '''', '&#x27;') ELSE '&lt;t&gt; ' || page_id END || '</A>' AS value FROM pages WHERE page_id % 7 <> 0 AND url ILIKE 'http%://%'""")
def _(t):
    tags = F.when(F.col("page_id") % 2 == 0, F.array(F.lit("a"), F.lit("b & c"))).otherwise(F.array().cast("array<string>"))
    url = F.when(F.col("page_id") % 7 == 0, F.concat(F.lit("javascript:"), "url")).otherwise(F.col("url"))
    title = F.when(F.col("page_id") % 3 != 0, F.concat(F.lit("<t> "), F.col("page_id").cast("string")))
    return I.browser_lines(t.pages.select(F.col("page_id").cast("double").alias("createdAt"), title.alias("title"), tags.alias("tags"), F.lit("link").alias("type"), url.alias("url")))


@query("k06_index_changes", """WITH o AS (SELECT CAST(user_id % 4 AS VARCHAR) AS buffer, event_id AS seq, epoch_us(ts) / 1e6 AS "at", user_id AS id, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'add' END AS op FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY buffer ORDER BY "at", seq) AS rn FROM o),
    b AS (WITH RECURSIVE r AS (SELECT buffer, rn, "at", seq, "at" AS first, 1 AS held, 0 AS batch FROM p WHERE rn = 1
        UNION ALL SELECT p.buffer, p.rn, p."at", p.seq, CASE WHEN r.held = 50 OR p."at" >= r.first + 7200 THEN p."at" ELSE r.first END, CASE WHEN r.held = 50 OR p."at" >= r.first + 7200 THEN 1 ELSE r.held + 1 END, CASE WHEN r.held = 50 OR p."at" >= r.first + 7200 THEN r.batch + 1 ELSE r.batch END
        FROM r JOIN p ON p.buffer = r.buffer AND p.rn = r.rn + 1) SELECT buffer, seq, batch FROM r),
    l AS (SELECT b.buffer, CAST(b.batch AS BIGINT) AS batch, o.id, o.op, o.seq, row_number() OVER (PARTITION BY b.buffer, b.batch, o.id ORDER BY o.seq DESC) AS n FROM b JOIN o ON o.seq = b.seq)
    SELECT buffer, batch, id, op, row_number() OVER (PARTITION BY buffer, batch ORDER BY CASE WHEN op = 'delete' THEN 0 ELSE 1 END, seq) AS turn FROM l WHERE n = 1""")
def _(t):
    ops = t.events.select((F.col("user_id") % 4).cast("string").alias("buffer"), F.col("event_id").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.col("user_id").alias("id"), F.when(F.col("event_type") == "error", "delete").otherwise("add").alias("op"))
    flushed = keyed.batches(ops, 50, 7200.0).select("buffer", "seq", "batch").join(ops.drop("at"), ["buffer", "seq"])
    return keyed.flush_order(flushed).select("buffer", "batch", "id", "op", F.col("turn").cast("long").alias("turn"))


@query("k10_metrics", "SELECT 'bookmarks' AS metric, type AS label, CAST(count(*) AS DOUBLE) AS value FROM bookmarks GROUP BY 2 UNION ALL SELECT 'users', NULL, CAST(count(*) AS DOUBLE) FROM customer", "bookmarks")
def _(t):
    frames = {"bookmarks": t.bookmarks.groupBy("type").agg(F.count(F.lit(1)).alias("value")), "users": t.users.agg(F.count(F.lit(1)).alias("value"))}
    return M.metrics(frames).select("metric", F.try_element_at("labels", F.lit("type")).alias("label"), "value")


@query("t07_rescored_hits", "SELECT doc_id AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place, (SELECT count(*) FROM documents) AS total, CAST(60 AS BIGINT) AS next FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20 OFFSET 40")
def _(t):
    hits = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), "n_chars", F.lit(None).cast("timestamp").alias("createdAt"))
    return A.search_page(hits, docs, 40).select("id", "n_chars", (F.col("place") + 40).cast("long").alias("place"), "total", "next")


@query("t11_people_first", "SELECT bookmarkId, tagId FROM (SELECT *, row_number() OVER (PARTITION BY bookmarkId ORDER BY attachedBy DESC, tagId) AS rn FROM (SELECT DISTINCT * FROM tags_on)) WHERE rn = 1", "tags_on")
def _(t):
    return A.first_per(t.tags_on.distinct(), ["bookmarkId"], [F.desc("attachedBy"), F.asc("tagId")]).select("bookmarkId", "tagId")


AGES = {"<3d": "INTERVAL 3 DAY", ">2w": "INTERVAL 14 DAY", "<5m": "INTERVAL 5 MONTH", ">1y": "INTERVAL 1 YEAR", "<14m": "INTERVAL 14 MONTH"}


@query("q_d_relative_dates", " UNION ALL ".join(f"SELECT '{age}' AS age, strftime({NOW_SQL} - {back}, '%Y-%m-%d %H:%M:%S') AS since, (SELECT count(*) FROM bookmarks WHERE createdAt {'>=' if age[0] == '<' else '<'} {NOW_SQL} - {back}) AS n" for age, back in AGES.items()), "bookmarks")
def _(t):
    from .query_language import age_limit, parse_age

    out = None
    for age in AGES:
        a = parse_age(age)
        since = F.lit(age_limit(a, NOW))
        found = t.bookmarks.filter(F.col("createdAt") >= since if a.newer else F.col("createdAt") < since)
        one = found.agg(F.lit(age).alias("age"), F.lit(f"{age_limit(a, NOW):%Y-%m-%d %H:%M:%S}").alias("since"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out
