"""Vector, recommender and keyed-state queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import analytics as A
from ..operators import recommend as R
from ..sources.stored import Store
from ..sources.tables import Tables, with_tables
from ..streaming import keyed

Q: dict = {}
S: dict[str, str] = {}
DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: CAST(x[1] AS DOUBLE) * CAST(x[2] AS DOUBLE)))"
NOW = "TIMESTAMP '2024-02-01 00:00:00'"


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            S[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def embeddings(t):
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def now():
    return F.expr("timestamp_ntz'2024-02-01 00:00:00'")


@query("v03_dot_with_first", f"SELECT b.vec_id AS id, round({DOT}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0")
def _(t):
    one = embeddings(t).filter("id = 0").select(F.col("vector").alias("q"))
    return embeddings(t).join(F.broadcast(one)).select("id", F.round(vectors.dot(F.col("vector"), F.col("q")), 5).alias("score"))  # one row


@query("t08_top_20_vectors", f"SELECT b.vec_id AS id, round({DOT}, 5) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 3 ORDER BY {DOT} DESC, id LIMIT 20")
def _(t):
    target = embeddings(t).filter("id = 3").first().vector
    return vectors.nearest(embeddings(t), target, 20).select("id", F.round("score", 5).alias("score"))


@query("v02_norms", "SELECT vec_id AS id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm FROM embeddings")
def _(t):
    return embeddings(t).select("id", F.round(vectors.norm(F.col("vector")), 4).alias("norm"))


@query("v11_vector_search", f"SELECT b.vec_id AS id FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.label = a.label AND {DOT} >= 0.3 ORDER BY {DOT} DESC, id LIMIT 10")
def _(t):
    target = embeddings(t).filter("id = 3").first()
    return vectors.nearest(embeddings(t).filter(F.col("label") == target.label), target.vector, 10).filter("score >= 0.3").select("id")


@query("v08_spherical_kmeans")
def _(t):
    e = Store(t.spark, "v08_spherical_kmeans").table(embeddings(t).select("id", vectors.normalised(F.col("vector")).alias("vector")))  # read again in each round
    return R.spherical_kmeans(e, R.cluster_count(e.count()))[1]


@query("v10_near_copies")
def _(t):
    c = t.raw("embeddings").select((F.col("label") % 4).cast("long").alias("userId"), F.col("vec_id").alias("id"), F.col("vec_id").alias("fetchedAt"), F.col("vec_id").cast("string").alias("urlHash"), F.lit(None).cast("string").alias("titleHash"), "embedding")
    return R.near_copies(c)


EVENT_TYPES = {"view": "viewed", "click": "clicked", "purchase": "saved", "signup": "liked", "error": "dismissed"}


def impressions(t):
    kinds = F.create_map(*[x for k, v in EVENT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return t.events.select(F.col("user_id").alias("impressionId"), F.element_at(kinds, F.col("event_type")).alias("type"))


@query("a31_rewards", "SELECT user_id AS impressionId, round(sum(DISTINCT CASE event_type WHEN 'click' THEN 0.2 WHEN 'purchase' THEN 1.2 WHEN 'signup' THEN 1.0 WHEN 'error' THEN -1.0 ELSE 0.0 END)::DOUBLE, 6) AS reward, bool_or(event_type IN ('purchase', 'signup')) AS strong, bool_or(event_type = 'click') AND NOT bool_or(event_type IN ('purchase', 'signup')) AS weak, bool_or(event_type = 'error') AS dismissed FROM events GROUP BY 1")
def _(t):
    return R.rewards(impressions(t)).select("impressionId", F.round("reward", 6).alias("reward"), "strong", "weak", "dismissed")


@query("r17_progress_events", "SELECT event_id, CASE WHEN value >= 60 THEN 'read_full' WHEN value >= 30 THEN 'read_partial' END AS event FROM events")
def _(t):
    return t.events.select("event_id", R.progress_event(F.col("value")).alias("event"))


@query("wf2_examined", """SELECT user_id AS briefingId, event_id AS impressionId, coalesce(event_id <= max(CASE WHEN event_type = 'view' THEN event_id END) OVER w, false) AS examined,
    CASE WHEN max(CASE WHEN event_type = 'view' THEN event_id END) OVER w >= max(event_id) OVER w THEN 'observed' ELSE 'partial' END AS state FROM events WINDOW w AS (PARTITION BY user_id)""")
def _(t):
    return R.examined(t.events.select(F.col("user_id").alias("briefingId"), F.col("event_id").alias("impressionId"), F.col("event_id").alias("rank"), (F.col("event_type") == "view").alias("viewed"), F.lit(True).alias("opened")))


@query("j11_delayed_events", """SELECT i.event_id AS impressionId, e.event_type AS type, CAST(epoch_us(min(e.ts)) AS BIGINT) AS at FROM events i JOIN events e ON e.user_id = i.user_id AND e.ts >= i.ts AND e.ts < i.ts + INTERVAL 7 DAY
    WHERE i.event_type = 'view' AND e.event_type <> 'view' GROUP BY 1, 2""")
def _(t):
    shown = t.events.filter("event_type = 'view'").select(F.col("event_id").alias("impressionId"), F.col("user_id").alias("itemId"), F.col("ts").alias("shownAt"))
    later = t.events.filter("event_type <> 'view'").select(F.col("user_id").alias("itemId"), F.col("event_type").alias("type"), F.col("ts").alias("at"))
    return R.delayed_events(shown, later).select("impressionId", "type", F.unix_micros(F.col("at").cast("timestamp")).alias("at"))


@query("a23_arm_counts", "SELECT user_id AS arm, count(*) FILTER (value > 5) AS examined, count(*) FILTER (value > 5 AND event_type = 'purchase') AS positive, CAST(1 + count(*) FILTER (value > 5 AND event_type = 'purchase') AS DOUBLE) AS alpha, CAST(4 + count(*) FILTER (value > 5) - count(*) FILTER (value > 5 AND event_type = 'purchase') AS DOUBLE) AS beta FROM events GROUP BY 1")
def _(t):
    return R.arm_counts(t.events.select(F.col("user_id").alias("arm"), (F.col("value") > 5).alias("examined"), (F.col("event_type") == "purchase").alias("positive")), "arm")


ARMS = "SELECT user_id, 1.0 + count(*) FILTER (event_type = 'purchase') AS a, 4.0 + count(*) FILTER (event_type <> 'purchase') AS b FROM events GROUP BY 1"


def arms(t):
    return t.events.groupBy("user_id").agg((1.0 + F.count_if(F.col("event_type") == "purchase")).alias("a"), (4.0 + F.count_if(F.col("event_type") != "purchase")).alias("b"))


@query("r01_posterior", f"SELECT user_id, round(CAST(a AS DOUBLE) / CAST(a + b AS DOUBLE), 9) AS mean, round(sqrt(CAST(a AS DOUBLE) * CAST(b AS DOUBLE) / (CAST(a + b AS DOUBLE) * CAST(a + b AS DOUBLE) * CAST(a + b + 1 AS DOUBLE))), 9) AS sd FROM ({ARMS})")
def _(t):
    a, b = F.col("a"), F.col("b")
    return arms(t).select("user_id", F.round(R.posterior_mean(a, b), 9).alias("mean"), F.round(R.posterior_sd(a, b), 9).alias("sd"))


@query("wf3_fetch_tiers", f"""SELECT id, CASE WHEN rn <= ceil(n * 0.25) THEN 'daily' WHEN rn <= ceil(n * 0.75) THEN 'every3days' ELSE 'weekly' END AS tier FROM
    (SELECT user_id AS id, row_number() OVER (ORDER BY CAST(a AS DOUBLE) / CAST(a + b AS DOUBLE) DESC, user_id) AS rn, count(*) OVER () AS n FROM ({ARMS}))""")
def _(t):
    return R.tiers(arms(t).select(F.lit(1).alias("userId"), F.col("user_id").alias("id"), R.posterior_mean(F.col("a"), F.col("b")).alias("mean"))).select("id", "tier")


@query("r06_decay", f"SELECT event_id, round(pow(CAST(0.5 AS DOUBLE), (epoch_us({NOW}) - epoch_us(ts)) / 86400000000.0 / 7), 9) AS w FROM events")
def _(t):
    return t.events.select("event_id", F.round(R.decay(R.hours_between(F.col("ts"), now()) / 24), 9).alias("w"))


@query("r09_freshness", f"SELECT event_id, round(pow(CAST(0.5 AS DOUBLE), (epoch_us({NOW}) - epoch_us(ts)) / 3600000000.0 / 48), 9) AS fresh FROM events")
def _(t):
    return t.events.select("event_id", F.round(R.freshness(F.col("ts"), now()), 9).alias("fresh"))


def candidates(t):
    e = t.raw("embeddings")
    profile = vectors.centroids(e.select("label", F.col("embedding").alias("vector")).filter("label = 1"), "label").select(F.col("centroid").alias("stable"))
    base = e.select(F.col("vec_id").alias("id"), "embedding", "label", F.timestamp_seconds(F.lit(1706745600) - F.col("vec_id") * 3600).alias("publishedAt"))
    base = base.join(F.broadcast(profile))  # one row
    null = F.lit(None).cast("array<double>")
    return base.withColumns({"recent": F.col("stable"), "negative": null, "clusterPreference": F.lit(0.3), "clusterShown": F.col("label"), "domainMean": F.lit(0.25), "librarySimilarity": F.lit(0.4)})


@query("r14_intake", """WITH b AS (SELECT label AS id, count(*) AS avail, label % 3 = 0 AS ind, greatest(0.01, (label + 1) / 10.0) AS w FROM embeddings GROUP BY label),
    seat AS (SELECT id, ind, CAST(w AS DOUBLE) / k AS q, k FROM b, range(1, 101) r(k) WHERE k <= least(avail, 100)),
    one AS (SELECT *, row_number() OVER (PARTITION BY ind ORDER BY q DESC, id) AS rn FROM seat),
    two AS (SELECT *, ind AND rn <= least(20, (SELECT sum(avail) FROM b WHERE ind)) AS f FROM one),
    won AS (SELECT id, f, row_number() OVER (PARTITION BY f ORDER BY q DESC, id) AS rn FROM two)
    SELECT CAST(b.id AS BIGINT) AS id, count(won.id) AS quota FROM b LEFT JOIN won ON won.id = b.id AND (f OR rn <= 100 - least(20, (SELECT sum(avail) FROM b WHERE ind))) GROUP BY b.id""")
def _(t):
    b = t.raw("embeddings").groupBy(F.col("label").cast("long").alias("id")).agg(F.count(F.lit(1)).alias("available"))
    return R.intake(b.select(F.lit(1).alias("userId"), "id", ((F.col("id") + 1) / 10.0).alias("weight"), "available", (F.col("id") % 3 == 0).alias("independent")), 100).select("id", "quota")


@query("r22_demotions", """SELECT c_custkey AS id, CASE WHEN n >= 20 AND p = 0 THEN 'no_positives' WHEN date_diff('second', last, TIMESTAMP '1998-08-01 00:00:00') / 86400.0 >= 60 THEN 'buried' END AS reason
    FROM customer JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus = 'P') AS p, max(o_orderdate) AS last FROM orders GROUP BY 1) o ON o_custkey = c_custkey""")
def _(t):
    o = t.bookmarks.groupBy("userId").agg(F.count(F.lit(1)).alias("n"), F.max("createdAt").alias("last"))
    p = t.raw("orders").groupBy(F.col("o_custkey").alias("userId")).agg(F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    null = F.lit(None)
    reason = R.demotion(F.col("n"), F.col("p"), F.col("last"), null.cast("timestamp"), null.cast("timestamp"), null.cast("string"), F.expr("timestamp_ntz'1998-08-01 00:00:00'"))
    return o.join(p, "userId").select(F.col("userId").alias("id"), reason.alias("reason"))


@query("a33_upper_median", "SELECT user_id, list_sort(list(value))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("user_id").agg(R.upper_median(F.collect_list("value")).alias("median"))


@query("a30_domain_votes", """WITH n AS (SELECT max(page_id) + 1 AS n FROM pages), p AS (SELECT page_id AS id, regexp_extract(url, '^https?://(?:www\\.)?([^/:?#]+)', 1) AS host, url FROM pages),
    v AS (SELECT DISTINCT a.id, b.host AS domain, greatest(0, a.id % 3 - 0.5) AS reward FROM p a, n JOIN p b ON b.id IN (a.id, (a.id * 7) % n, (a.id + 1) % n, (a.id * a.id) % n) WHERE b.host <> a.host)
    SELECT domain, CAST(sum(reward) AS DOUBLE) AS weight, count(*) AS articles, array_to_string(list_sort(list(id))[1:5], ',') AS evidence FROM v GROUP BY 1""")
def _(t):
    """Every page links to itself, to two others in a fixed way and to a third by its square."""
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1)
    n = t.pages.agg((F.max("page_id") + 1).alias("n"))
    to = F.explode(F.array("page_id", F.col("page_id") * 7 % F.col("n"), (F.col("page_id") + 1) % F.col("n"), F.col("page_id") * F.col("page_id") % F.col("n")))
    links = t.pages.select("page_id").crossJoin(F.broadcast(n)).select("page_id", to.alias("to")).join(t.pages.select(F.col("page_id").alias("to"), "url"), "to")  # n is one row
    links = links.groupBy("page_id").agg(F.collect_list("url").alias("links"))
    votes = R.domain_votes(t.pages.join(links, "page_id").select(F.col("page_id").alias("id"), host.alias("host"), "links", (F.col("page_id") % 3 - 0.5).alias("reward")))
    return votes.select("domain", "weight", "articles", F.array_join("evidence", ",").alias("evidence"))


@query("wf11_close_tags", """WITH k AS (SELECT *, row_number() OVER (PARTITION BY userId ORDER BY key, id) AS rn FROM (SELECT DISTINCT userId, tagId AS id, lower(replace(replace(replace(name, ' ', ''), '-', ''), '_', '')) AS key FROM tags_on JOIN bookmarks ON bookmarks.id = bookmarkId JOIN tags ON tags.id = tagId)),
    h AS (WITH RECURSIVE r AS (SELECT userId, id, key, rn, id AS head, key AS head_key FROM k WHERE rn = 1
        UNION ALL SELECT k.userId, k.id, k.key, k.rn, CASE WHEN levenshtein(r.head_key, k.key) <= 1 THEN r.head ELSE k.id END, CASE WHEN levenshtein(r.head_key, k.key) <= 1 THEN r.head_key ELSE k.key END FROM r JOIN k ON k.userId = r.userId AND k.rn = r.rn + 1) SELECT * FROM r)
    SELECT userId, id, head FROM h""", "tags_on", "bookmarks", "tags")
def _(t):
    return R.close_tags(t.user_tags.select("userId", "id", text.tag_key(F.col("name")).alias("key")))


def hits(t):
    return t.events.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))


def streamed(t, decide):
    """Decisions of a stream over the stored hits, all of them in one trigger: it reads a folder of files and writes one."""
    store = Store(t.spark, "limits")
    path = store.path()
    hits(t).write.parquet(path)
    out, checkpoint = store.path(), store.path()
    stream = t.spark.readStream.schema("key string, at double").parquet(path)
    decide(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(keyed.OUT).parquet(out)


def windows_sql(limit: int, seconds: int) -> str:
    """Windows that open with the first hit after the last one's end, and the place of each hit in its window."""
    return f"""WITH h AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
        w AS (WITH RECURSIVE r AS (SELECT key, "at", rn, "at" AS opened FROM h WHERE rn = 1
            UNION ALL SELECT h.key, h."at", h.rn, CASE WHEN h."at" > r.opened + {seconds}000000 THEN h."at" ELSE r.opened END FROM r JOIN h ON h.key = r.key AND h.rn = r.rn + 1) SELECT * FROM r),
        p AS (SELECT key, "at", row_number() OVER (PARTITION BY key, opened ORDER BY rn) AS n FROM w)
        SELECT key, "at", n <= {limit} AS allowed, CAST({limit} - least(n, {limit}) AS BIGINT) AS "left" FROM p"""


def rounded(df):
    """Times as whole microseconds."""
    return df.select("key", F.round(F.col("at") * 1e6).cast("long").alias("at"), "allowed", "left")


@query("st01_fixed_window", windows_sql(5, 86400))
def _(t):
    return rounded(streamed(t, lambda s: keyed.limited(s, 5, 86_400.0)))


@query("st02_sliding_log", """WITH h AS (SELECT CAST(user_id AS VARCHAR) AS key, epoch_us(ts) AS "at", row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events),
    w AS (WITH RECURSIVE r AS (SELECT key, "at", rn, ["at"] AS log, true AS allowed FROM h WHERE rn = 1
        UNION ALL SELECT key, "at", rn, CASE WHEN len(kept) < 5 THEN list_append(kept, "at") ELSE kept END, len(kept) < 5 FROM (SELECT h.key, h."at", h.rn, list_filter(r.log, lambda x: x > h."at" - 86400000000) AS kept FROM r JOIN h ON h.key = r.key AND h.rn = r.rn + 1)) SELECT * FROM r)
    SELECT key, "at", allowed, CAST(5 - len(log) AS BIGINT) AS "left" FROM w""")
def _(t):
    return rounded(streamed(t, lambda s: keyed.limited(s, 5, 86_400.0, True)))


@query("st03_once_in_ten_minutes", f'SELECT key, "at" FROM ({windows_sql(1, 600)}) WHERE allowed')
def _(t):
    return rounded(streamed(t, lambda s: keyed.limited(s, 1, 600.0))).filter("allowed").select("key", "at")


@query("st04_idempotency", "SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, min(event_id) AS first FROM events GROUP BY 1, 2")
def _(t):
    first = A.first_per(t.events.withColumn("day", F.to_date("ts").cast("string")), ["user_id", "day"], [F.asc("event_id")])
    return first.select("user_id", "day", F.col("event_id").alias("first"))


@query("st23_failure_runs", """WITH e AS (SELECT user_id, event_id, event_type = 'error' AS failed, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM events)
    SELECT CAST(user_id AS VARCHAR) AS key, event_id, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id) AS BIGINT) AS run FROM e""")
def _(t):
    rows = t.events.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("double").alias("at"), (F.col("event_type") == "error").alias("failed"))
    return keyed.failure_runs(rows).select("key", F.col("at").cast("long").alias("event_id"), "run")


RULES = [
    {"id": 1, "event": {"type": "click"}, "condition": {"type": "and", "conditions": [{"type": "titleContains", "str": "1"}, {"type": "isFavourited"}]}, "actions": [{"type": "addTag", "target": "t1"}, {"type": "archive"}]},
    {"id": 2, "event": {"type": "purchase", "list": ["0", "1", "2"]}, "condition": {"type": "alwaysTrue"}, "actions": [{"type": "favourite"}]},
    {"id": 3, "enabled": False, "event": {"type": "view"}, "condition": {"type": "alwaysTrue"}, "actions": [{"type": "archive"}]},
]


@query("st18_rules", """SELECT '1' AS ruleId, event_id AS bookmarkId, a.action, a.target FROM events, (VALUES ('addTag', 't1'), ('archive', '')) a(action, target) WHERE event_type = 'click' AND props LIKE '%1%' AND value > 10
    UNION ALL SELECT '2', event_id, 'favourite', '' FROM events WHERE event_type = 'purchase' AND user_id % 10 IN (0, 1, 2)""")
def _(t):
    e = t.events.select(
        F.struct(F.col("event_type").alias("type"), F.create_map(F.lit("list"), (F.col("user_id") % 10).cast("string")).alias("targets")).alias("event"), F.col("event_id").alias("id"),
        F.col("props").alias("title"), (F.col("value") > 10).alias("favourited"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("url"), F.lit("rss").alias("source"), F.lit(False).alias("archived"),
        F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("feeds"),
    )
    return keyed.actions(e, RULES)
