"""Functions, the search language, feedback and the recommender's steps, with the SQL of the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import text, urls, vectors
from ..operators import analytics as A
from ..operators import briefing as B
from ..operators import maintenance as M
from ..operators import recommend as R
from ..sources.tables import Tables, with_tables
from ..streaming import keyed
from . import query_language as L
from .queries_recommend import DOT, EVENT_TYPES, RULES

Q: dict = {}
S: dict[str, str] = {}
CJK = "[\\x{3040}-\\x{30FF}\\x{3400}-\\x{9FFF}\\x{AC00}-\\x{D7AF}\\x{FF00}-\\x{FFEF}]"
KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()) + " END"


def query(name: str, sql: str | None = None, *tables: str):
    def add(f):
        Q[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            S[name] = with_tables(sql, *tables) if tables else sql
        return f

    return add


def kind():
    return F.element_at(F.create_map(*[x for k, v in EVENT_TYPES.items() for x in (F.lit(k), F.lit(v))]), F.col("event_type"))


def text_of(c: str):
    return F.col(c).cast("string")


def rows(t, values: list[tuple], schema: str):
    return t.spark.createDataFrame(values, schema)


# --- URLs and text

CANONICAL = """(SELECT page_id, 'https://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS url FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)), '^(www\\.)?(amp\\.)?', '') AS host,
    regexp_replace(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), '/+$', '') AS path, array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[^=]*|ref|fbclid|gclid|source)='))), '&') AS kept FROM pages))"""


@query("f01_canonical_url", f"SELECT page_id, url, substr(sha256(url), 1, 32) AS hash, regexp_extract(url, '^https://([^/?]+)', 1) AS domain FROM {CANONICAL}")
def _(t):
    return t.pages.select("page_id", urls.canonical(F.col("url")).alias("url")).withColumn("hash", urls.url_hash(F.col("url"))).withColumn("domain", urls.domain(F.col("url")))


@query("f04_domain", f"SELECT page_id, regexp_extract(url, '^https://([^/?]+)', 1) AS domain FROM {CANONICAL}")
def _(t):
    return t.pages.select("page_id", urls.domain(urls.canonical(F.col("url"))).alias("domain"))


@query("f05_host_as_written", "SELECT page_id, split_part(split_part('HTTP://www.' || split_part(url, '://', 2), '://', 2), '/', 1) AS host FROM pages")
def _(t):
    return t.pages.select("page_id", urls.host_as_written(F.concat(F.lit("HTTP://www."), F.substring_index("url", "://", -1))).alias("host"))


@query("f06_light_url", "SELECT page_id, regexp_replace(regexp_replace(url || CASE WHEN page_id % 2 = 0 THEN '#part' ELSE '' END, '#.*$', ''), '/$', '') AS url FROM pages")
def _(t):
    return t.pages.select("page_id", urls.light(F.concat("url", F.when(F.col("page_id") % 2 == 0, "#part").otherwise(""))).alias("url"))


@query("f03_title_hash", "SELECT id, substr(sha256(key), 1, 32) AS hash FROM (SELECT id, regexp_replace(lower(name), '[!-/:-@\\[-`{-~]|\\s', '', 'g') AS key FROM tags)", "tags")
def _(t):
    return t.tags.select("id", urls.title_hash(F.col("name")).alias("hash"))


@query("f09_loose_tag_key", "SELECT id, regexp_replace(lower(name || ' No_' || id || '[x]'), '[\\x20-\\x5F]', '', 'g') AS key FROM tags", "tags")
def _(t):
    return t.tags.select("id", text.tag_key_loose(F.concat("name", F.lit(" No_"), text_of("id"), F.lit("[x]"))).alias("key"))


@query("f10_without_hash", "SELECT id, name FROM tags", "tags")
def _(t):
    return t.tags.select("id", text.without_hash(F.concat(F.repeat(F.lit("#"), (F.col("id") % 4).cast("int")), "name")).alias("name"))


PATTERN_TEXT = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', ' ', 'g'), '(?is)<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g'))"


@query("f12_html_text", f"SELECT page_id, {PATTERN_TEXT} AS text FROM pages")
def _(t):
    return t.pages.select("page_id", text.html_text(F.col("html")).alias("text"))


@query("f13_html_plain", "SELECT doc_id, 'Title ' || doc_id || chr(10) || chr(10) || 'first ' || lang || ' [https://l.org/' || doc_id || '] & more' || chr(10) || chr(10) || ' * one' || chr(10) || ' * ' || source AS text FROM documents")
def _(t):
    number = text_of("doc_id")
    page = F.concat(F.lit("<html><head><title>x</title><style>p{}</style></head><body><h1>Title "), number, F.lit("</h1>\n<p>first\n  <a href='https://l.org/"), number, F.lit("'>"), "lang", F.lit("</a> &amp; more<img src=x></p><script>no()</script><ul><li>one</li><li>"), "source", F.lit("</li></ul></body></html>"))
    return t.raw("documents").select("doc_id", text.html_plain(page).alias("text"))


def paragraphs_sql() -> str:
    outside = "len(list_filter(regexp_extract_all(html, '(?i)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: regexp_matches(x, '^https?://')))"
    paragraphs = "greatest(len(regexp_extract_all(html, '(?i)<p\\b')), 1)"
    return f"SELECT page_id, length({PATTERN_TEXT}) AS text_length, {outside} AS outbound, CAST({outside} AS DOUBLE) / {paragraphs} AS outbound_ratio, len(regexp_extract_all(html, '(?i)<script\\b[^>]*(?:doubleclick|googlesyndication|adservice|taboola|outbrain)')) AS ad_scripts FROM pages"


@query("f16_page_signals", f"SELECT *, CASE WHEN text_length < 400 THEN 'short' WHEN outbound_ratio > 2.5 THEN 'links' WHEN ad_scripts > 20 THEN 'ads' END AS reason FROM ({paragraphs_sql()})")
def _(t):
    s = text.page_signals(F.col("html"), F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1))
    return t.pages.select("page_id", *[(c if k == "outbound_ratio" else c.cast("long")).alias(k) for k, c in s.items()]).withColumn("reason", text.quality_reason(F.col("text_length"), F.col("outbound_ratio"), F.col("ad_scripts")))


@query("f19_quality_reason", "SELECT event_id, CASE WHEN value * 20 < 400 THEN 'short' WHEN value / 10 > 2.5 THEN 'links' WHEN user_id % 40 > 20 THEN 'ads' END AS reason FROM events")
def _(t):
    return t.events.select("event_id", text.quality_reason(F.col("value") * 20, F.col("value") / 10, F.col("user_id") % 40).alias("reason"))


@query("f20_screen", "SELECT event_id, CASE WHEN user_id % 50 = 7 THEN 'blocked' WHEN event_id % 9 < 3 THEN 'inactive' WHEN value < 20 THEN 'short' END AS verdict FROM events")
def _(t):
    host = F.concat(F.lit("A.host"), (F.col("user_id") % 50).cast("string"), F.lit(".ORG"))
    return t.events.select("event_id", text.screen(host, F.col("event_id") % 9, F.when(F.col("value") < 20, "short"), ["host7.org", "other.net"]).alias("verdict"))


@query("f22_truncated", "SELECT doc_id, substr(text, 1, CAST(floor(100 / 0.35::DOUBLE + 1e-9) AS BIGINT)) AS text FROM documents WHERE NOT regexp_matches(text, '" + CJK + "') UNION ALL SELECT doc_id, repeat('漢', 66) FROM documents WHERE regexp_matches(text, '" + CJK + "') UNION ALL SELECT -1 - item_id, repeat('字a', 54) FROM benchmark")
def _(t):
    d = t.raw("documents").select("doc_id", F.when(text.cjk_count(F.col("text")) > 0, F.repeat(F.lit("漢"), F.lit(500))).otherwise(F.col("text")).alias("text"))
    mixed = t.raw("benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.repeat(F.lit("字a"), F.lit(400)).alias("text"))
    return d.unionByName(mixed).select("doc_id", text.truncated(F.col("text"), 100).alias("text"))


@query("f23_embedding_text", """SELECT doc_id, array_to_string(list_filter([nullif(source, ''), nullif(lang, ''), nullif(rtrim(substr(whole, 1, CASE WHEN length(whole) > 0 AND (length(whole) - length(regexp_replace(whole, '""" + CJK + """', '', 'g'))) >= length(whole) * 0.2 THEN 1200 ELSE 1500 END)), '')], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text
    FROM (SELECT *, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS whole FROM documents)""")
def _(t):
    return t.raw("documents").select("doc_id", text.embedding_text(F.col("source"), F.col("lang"), F.col("text")).alias("text"))


@query("f26_chunk_problems", "SELECT turn, conv_id, array_to_string(list_filter([CASE WHEN length(s) > 100 AND turn % 2 = 0 THEN 'echo' END, CASE WHEN conv_id % 3 = 0 THEN 'tags' END], lambda x: x IS NOT NULL), ',') AS problems FROM (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS s FROM conversations)")
def _(t):
    c = t.raw("conversations")
    out = F.concat(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.concat(F.lit("other "), F.col("text"))), F.when(F.col("conv_id") % 3 == 0, "<i></i><b>").otherwise(""))
    return c.select("turn", "conv_id", F.array_join(text.chunk_problems(F.col("text"), out, False), ",").alias("problems"))


@query("f27_robots", "SELECT page_id, CASE page_id % 4 WHEN 0 THEN NOT regexp_matches(path, '^/en/') WHEN 1 THEN NOT regexp_matches(path, '^/(en|fr)/') OR regexp_matches(path, '^/fr/1') WHEN 2 THEN true ELSE false END AS allowed, CAST(CASE page_id % 4 WHEN 0 THEN 2.5 WHEN 3 THEN 7.0 END AS DOUBLE) AS delay FROM (SELECT *, regexp_extract(url, '^https?://[^/]+(/[^?]*)', 1) AS path FROM pages)")
def _(t):
    files = [
        "User-agent: bot\nUser-agent: MyBot # two agents\nDisallow: /en/\nCrawl-delay: 2.5\n\nUser-agent: *\nDisallow: /",
        "Disallow: /lost\nUser-agent: mybot\nDisallow: /en/\nDisallow: /fr/\nAllow: /fr/1\nAllow:\nno colon",
        "User-agent: other\nDisallow: /\nUser-agent: mybot\nDisallow:",
        "User-agent: *\r\nCrawl-Delay: 7\r\nDisallow: /\r\nAllow: /\x07",
    ]
    rules = F.element_at(F.array(*map(F.lit, files)), (F.col("page_id") % 4 + 1).cast("int"))
    return t.pages.withColumn("r", text.robots(rules, F.regexp_extract("url", r"^https?://[^/]+(/[^?]*)", 1), "MyBot")).select("page_id", "r.allowed", "r.delay")


@query("f28_bookmark_profile", """SELECT b.id, CASE b.type WHEN 'link' THEN 'Title: Order ' || b.id || nl || 'Type: link' || nl || 'Tags: a, z' || nl || 'Domain: ' || lower(regexp_extract(l.url, '^https?://([^/:?#]+)', 1)) || nl || 'URL: ' || regexp_replace(l.url, '[?#].*$', '') || nl || 'Page title: ' || l.title || nl || 'Published: ' || strftime(b.createdAt, '%Y-%m-%d') || nl || 'Content excerpt: ' || rtrim(substr(w, 1, 2999)) || '…'
    WHEN 'text' THEN 'Title: Order ' || b.id || nl || 'Type: text' || nl || 'Tags: a, z' || nl || 'Source URL: https://s.org/' || nl || 'Source domain: s.org' || nl || 'Content excerpt: short words'
    ELSE 'Title: Order ' || b.id || nl || 'Type: asset' || nl || 'Tags: a, z' || nl || 'File name: f.pdf' || nl || 'Asset type: pdf' || nl || 'Metadata: pages: ' || b.id || '; ok: true' END AS text
    FROM bookmarks b LEFT JOIN links l ON l.id = b.id, (SELECT chr(10) || chr(10) AS nl, rtrim(repeat('words and more ', 400)) AS w)""", "bookmarks", "links")
def _(t):
    b = t.bookmarks.join(t.links.select("id", "url", F.col("title").alias("linkTitle")), "id", "left")
    is_ = lambda k, v: F.when(F.col("type") == k, v)
    columns = {
        "title": F.concat(F.lit("  Order\n"), text_of("id")), "type": F.col("type"), "tags": F.array(F.lit("z"), F.lit("a")), "url": F.col("url"), "linkTitle": F.col("linkTitle"), "published": F.col("createdAt"),
        "content": is_("link", F.repeat(F.lit("words and  more "), F.lit(400))), "sourceUrl": is_("text", F.lit("https://s.org?x=1#y")), "text": F.lit("short \t words"), "fileName": F.lit("f.pdf"), "assetType": F.lit("pdf"),
        "metadata": F.concat(F.lit('{"pages": '), text_of("id"), F.lit(', "ok": true, "deep": {"a": 1}, "none": null}')),
    }
    return b.select("id", text.bookmark_profile(columns).alias("text"))


@query("f29_digest_items", """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '1:Ä -s,2:B -' WHEN 1 THEN '1:A -s,7:B -s' WHEN 2 THEN '3:C -s' WHEN 3 THEN '1:A -s,2:B -s' WHEN 4 THEN '5:{"x -s' ELSE '' END AS items FROM documents""")
def _(t):
    item = '{"id": %s, "title_ja": "%s", "summary_ja": "%s"}'
    answers = [
        "Here you are: {\"items\": [" + item % (1, "Ä ", " s ") + ", " + item % (2, "B", " ") + "]} done",
        "{\"results\": [" + item % ('"1"', "A", "s") + ", " + item % (7, "B", "s") + ", " + item % (8, " ", "s") + "]}",
        "{\"3\": {\"title_ja\": \"C\", \"summary_ja\": \"s\"}, \"x\": {\"title_ja\": \"D\", \"summary_ja\": \"s\"}}",
        "[{\"title_ja\": \"A\", \"summary_ja\": \"s\"}, {\"title_ja\": \"B\", \"summary_ja\": \"s\"}, {\"title_ja\": 3}]",
        "{\"items\": [" + item % (5, '{\\"x', "s") + ", {\"id\": 6, \"title_ja\": \"cut",
        "no answer at all",
    ]
    raw = F.element_at(F.array(*map(F.lit, answers)), (F.col("doc_id") % 6 + 1).cast("int"))
    shown = F.transform(text.digest_items(raw), lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["title"], F.lit(" -"), F.coalesce(x["summary"], F.lit(""))))
    return t.raw("documents").select("doc_id", F.array_join(shown, ",").alias("items"))


@query("f30_challenge", "SELECT page_id, page_id % 3 = 0 OR (page_id % 5 = 0 AND length(html) + 18 <= 20000) AS challenge, CASE WHEN page_id % 2 = 0 THEN CASE WHEN page_id % 7 = 0 THEN 'render' ELSE 'probe' END ELSE 'render' END AS title FROM pages")
def _(t):
    page = F.concat("html", F.when(F.col("page_id") % 5 == 0, "<x CF-CHALLENGE id=").otherwise(" "))
    title = F.when(F.col("page_id") % 3 == 0, " Just a moment...").when(F.col("page_id") % 4 == 0, "Just a moment... please")
    chosen = text.preferred(F.lit("render"), F.when(F.col("page_id") % 7 != 0, "probe").otherwise(""), F.col("page_id") % 2 == 0)
    return t.pages.select("page_id", text.is_challenge(title, page, ["just a moment..."], ["cf-challenge"]).alias("challenge"), chosen.alias("title"))


@query("f31_jitter", "SELECT n_nationkey, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 60 AS BIGINT) AS minute FROM (SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM nation)")
def _(t):
    return t.raw("nation").select("n_nationkey", text.jitter_minutes(F.col("n_name")).alias("minute"))


@query("f33_explanation", "SELECT event_id, CASE WHEN value >= 50 THEN '+a,-b' WHEN value >= 25 THEN '-b,+a' ELSE '-b,+c' END AS reasons FROM events")
def _(t):
    high = F.col("value") >= 50
    parts = F.create_map(F.lit("a"), F.when(high, 9.0).when(F.col("value") >= 25, 3.0).otherwise(0.5), F.lit("b"), F.lit(-4.0), F.lit("c"), F.lit(1.0))
    return t.events.select("event_id", F.array_join(R.reasons(parts), ",").alias("reasons"))


@query("f34_first_asset", "SELECT o_custkey AS id, min(o_orderkey) FILTER (o_orderpriority = '2-HIGH') AS high, min(o_orderkey) FILTER (o_orderpriority = 'none') AS none FROM orders GROUP BY 1")
def _(t):
    o = t.raw("orders").select(F.col("o_custkey").alias("id"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("assetType")).alias("a"))
    held = o.groupBy("id").agg(F.sort_array(F.collect_list("a")).alias("assets"))
    return held.select("id", text.first_asset(F.col("assets"), "2-HIGH").alias("high"), text.first_asset(F.col("assets"), "none").alias("none"))


# --- the search language


def show(m) -> str:
    if m is None:
        return ""
    if isinstance(m, L.Both):
        return f"{m.op}({', '.join(map(show, m.parts))})"
    return ("!" if m.negated else "") + m.kind + ("" if m.value is None else f"={m.value}")


def parsed(t, form: str):
    """What a query with the name of each nation in it means."""
    names = [r.n_name for r in t.raw("nation").select("n_name").collect()]  # 25 names
    out = [(n, *(lambda p: (p.result, p.text, show(p.matcher)))(L.parse(form.format(n)))) for n in names]
    return rows(t, out, "name string, result string, text string, matcher string")


@query("q_l_lexer", "SELECT n_name AS name, 'minus qualifier word space hash string and space open word close space qualifier or' AS kinds FROM nation")
def _(t):
    names = [r.n_name for r in t.raw("nation").select("n_name").collect()]  # 25 names
    kinds = [(n, " ".join(k for k, _ in L.tokens(f'-list:{n} #"{n} x" AND ({n}) is: or'))) for n in names]
    return rows(t, kinds, "name string, kinds string")


@query("q_p_parse", "SELECT n_name AS name, 'full' AS result, 'free words' AS text, 'and(list=' || n_name || ' x, !archived, source=rss)' AS matcher FROM nation")
def _(t):
    return parsed(t, 'free list:"{} x" -is:archived source:rss words')


@query("q_g_grammar", "SELECT n_name AS name, 'full' AS result, '' AS text, 'and(or(favourited, tag=' || n_name || '), !url=' || n_name || ')' AS matcher FROM nation")
def _(t):
    return parsed(t, "is:fav or #{0} and -url:{0}")


@query("q_g_partial", "SELECT n_name AS name, 'partial' AS result, n_name || ' )' AS text, 'tag=' || n_name AS matcher FROM nation")
def _(t):
    return parsed(t, "#{0} {0} )")


@query("q_f_flatten", "SELECT n_name AS name, 'full' AS result, '' AS text, 'and(favourited, tag=' || n_name || ', or(type=link, type=asset), archived)' AS matcher FROM nation")
def _(t):
    return parsed(t, "(is:fav (#{} ((is:link or is:media)))) (is:archived)")


# --- pages, sets, joins


@query("t05_search_page", "SELECT doc_id AS id, (SELECT count(*) FROM documents) AS total, NULL::BIGINT AS next FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET (SELECT count(*) - 30 FROM documents)")
def _(t):
    hits = t.raw("documents").select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score"))
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), F.timestamp_seconds("doc_id").alias("createdAt"))
    return A.search_page(hits, docs, hits.count() - 30, 100, "asc").select("id", "total", F.col("next").cast("long").alias("next"))


@query("t14_page_size", "SELECT doc_id AS id FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(t):
    return A.offset_page(t.raw("documents").select(F.col("doc_id").alias("id"), "n_chars"), [F.desc("n_chars"), F.asc("id")], 0, A.page_size(None)).select("id")


@query("u03_union_distinct", "SELECT user_id AS id FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE value > 90 UNION SELECT l_suppkey FROM lineitem", "in_lists")
def _(t):
    return A.union_ids([t.events.filter("event_type = 'click'").select(F.col("user_id").alias("id")), t.events.filter("value > 90").select("user_id"), t.raw("lineitem").select("l_suppkey")])


@query("j13_slate_read", f"""SELECT i.user_id AS "briefingId", i.event_id AS "impressionId", p.url, n_name AS domain, r_name AS "clusterLabel", coalesce(array_to_string(list_sort(list(DISTINCT {KIND.replace('event_type', 'e.event_type')}) FILTER (e.event_id IS NOT NULL)), ','), '') AS events
    FROM events i JOIN pages p ON p.page_id = i.event_id % 300 LEFT JOIN nation ON n_nationkey = CASE WHEN i.event_id % 4 <> 0 THEN i.event_id % 30 END LEFT JOIN region ON r_regionkey = p.page_id % 7
    LEFT JOIN events e ON e.event_id // 2 = i.event_id WHERE i.event_type <> 'error' GROUP BY 1, 2, 3, 4, 5""")
def _(t):
    e = t.events
    impressions = e.select(F.col("event_id").alias("id"), F.col("user_id").alias("briefingId"), (F.col("event_id") % 300).alias("candidateId"), F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 30).cast("int").alias("domainId"), F.col("event_id").alias("rank"), F.lit("exploit").alias("arm"), F.col("value").alias("score"), (F.col("event_type") != "error").alias("shown"))
    candidates = t.pages.select(F.col("page_id").alias("id"), "url", F.lit("t").alias("title"), (F.col("page_id") % 7).cast("int").alias("clusterId"))
    domains, clusters = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("domain")), t.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("label"))
    done = e.select(F.floor(F.col("event_id") / 2).alias("impressionId"), kind().alias("type"))
    return B.slate_read(impressions, candidates, domains, clusters, done).select("briefingId", "impressionId", "url", "domain", "clusterLabel", F.array_join("events", ",").alias("events"))


@query("j14_profile_samples", f"""SELECT e.user_id AS "userId", {KIND} IN ('saved', 'liked') AS positive, round(v.embedding[1]::DOUBLE, 5) AS x, CAST(epoch_us(e.ts) AS BIGINT) AS "at", CASE {KIND} WHEN 'saved' THEN 1.2 ELSE 1.0 END::DOUBLE AS weight
    FROM events e JOIN embeddings v ON v.vec_id = e.event_id % 600 WHERE {KIND} IN ('saved', 'liked', 'dismissed') AND e.ts >= TIMESTAMP '2024-01-10 00:00:00'""")
def _(t):
    e = t.events.select(F.col("user_id").alias("userId"), F.col("event_id").alias("impressionId"), kind().alias("type"), F.col("ts").alias("occurredAt"))
    impressions = t.events.select(F.col("event_id").alias("id"), (F.col("event_id") % 600).alias("candidateId"))
    candidates = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = B.profile_samples(e, impressions, candidates, F.expr("timestamp_ntz'2024-01-10 00:00:00'"))
    return out.select("userId", "positive", F.round(F.col("vector")[0].cast("double"), 5).alias("x"), F.unix_micros(F.col("occurredAt").cast("timestamp")).alias("at"), "weight")


@query("j15_vector_join", f"SELECT a.vec_id AS a, b.vec_id AS b, round({DOT}, 5) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 4 = 0 AND b.vec_id % 3 = 1 WHERE {DOT} >= 0.6")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors.within(e.filter("id % 4 = 0"), e.filter("id % 3 = 1"), 0.6).select("a", "b", F.round("score", 5).alias("score"))


# --- vectors


@query("v01_blobs", "SELECT vec_id AS id, len(embedding) AS n, round(embedding[1]::DOUBLE, 6) AS first, len(embedding) * 4 AS bytes FROM embeddings")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), vectors.to_blob(F.col("embedding")).alias("blob"))
    back = e.select("id", F.octet_length("blob").cast("long").alias("bytes"), vectors.from_blob(F.col("blob")).alias("v"))
    return back.select("id", F.size("v").cast("long").alias("n"), F.round(F.col("v")[0].cast("double"), 6).alias("first"), "bytes")


NORM = "sqrt(list_sum(list_transform({0}.embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"


@query("v04_cosine", f"SELECT b.vec_id AS id, CASE WHEN b.vec_id % 10 = 0 THEN 0 ELSE round({DOT} / ({NORM.format('a')} * {NORM.format('b')}), 5) END AS cosine FROM embeddings a, embeddings b WHERE a.vec_id = 1")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding")).alias("v"))
    one = F.broadcast(t.raw("embeddings").filter("vec_id = 1").select(F.col("embedding").alias("q")))  # one row
    return e.join(one).select("id", F.round(vectors.cosine(F.col("v"), F.col("q")), 5).alias("cosine"))


@query("v05_shortened", "SELECT vec_id AS id, pos, round(embedding[pos + 1]::DOUBLE / sqrt(list_sum(list_transform(embedding[1:16], lambda x: x::DOUBLE * x::DOUBLE))), 5) AS x FROM embeddings, (SELECT unnest(range(16)) AS pos)")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.posexplode(vectors.shortened(F.col("embedding"), 16)).alias("pos", "x"))
    return e.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("a32_centroids", "SELECT label, pos, round(avg(embedding[pos + 1]::DOUBLE), 6) AS x FROM embeddings, (SELECT unnest(range(64)) AS pos) GROUP BY 1, 2")
def _(t):
    c = vectors.centroids(t.raw("embeddings").select("label", F.col("embedding").alias("vector")), "label")
    return c.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("x"))


@query("v09_cluster_identity", "SELECT k AS id, CASE WHEN k < 6 THEN (SELECT count(*) FROM embeddings WHERE vec_id % 6 = k) ELSE 0 END AS size FROM (SELECT unnest(range(9)) AS k)")
def _(t):
    """A run finds six clusters where there were nine: the first six keep their ids, the others are empty."""
    sizes = {r.k: r["count"] for r in t.raw("embeddings").groupBy((F.col("vec_id") % 6).alias("k")).count().collect()}  # six rows
    return rows(t, [(i, n) for i, _, n in R.reused_clusters(list(range(9)), np.eye(6), sizes, lambda i: i)], "id long, size long")


@query("wf6_assignment", f"SELECT b.vec_id AS id, arg_min(a.vec_id, (-round({DOT}, 9), a.vec_id)) AS cluster FROM embeddings a, embeddings b WHERE a.vec_id < 8 GROUP BY 1")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    start = np.array([r.vector for r in e.filter("id < 8").orderBy("id").collect()], float)  # eight rows
    return R.spherical_kmeans(e, 8, start=start, rounds=0)[1].select("id", F.col("cluster").cast("long").alias("cluster"))


@query("v12_neighbour_tags", f"""WITH c AS (SELECT b.vec_id AS id, {DOT} AS s FROM embeddings a, embeddings b WHERE a.vec_id = 3 AND b.vec_id <> 3 AND {DOT} >= 0.1 ORDER BY s DESC, id LIMIT 10),
    n AS (SELECT DISTINCT p_name AS name FROM lineitem JOIN c ON c.id = l_orderkey JOIN part ON p_partkey = l_partkey ORDER BY 1 LIMIT 100)
    SELECT name FROM (SELECT name, sum(length(name)) OVER (ORDER BY length(name), name) + 2 * CASE WHEN row_number() OVER (ORDER BY length(name), name) > 1 THEN 1 ELSE 0 END AS used FROM n) WHERE used <= 200""")
def _(t):
    e = t.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return M.neighbour_tags(e, e.filter("id = 3").first().vector, 3, t.tags_on, t.tags, least=0.1, budget=200)


# --- the recommender


@query("r02_cluster_preference", "SELECT user_id, round((1.0 + p) / (5.0 + greatest(n, p)), 9) AS preference FROM (SELECT user_id, count(*) FILTER (event_type = 'purchase')::DOUBLE AS p, count(*) FILTER (value > 50)::DOUBLE AS n FROM events GROUP BY 1)")
def _(t):
    n = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count_if(F.col("value") > 50).alias("n"))
    return n.select("user_id", F.round(R.cluster_preference(F.col("p"), F.col("n")), 9).alias("preference"))


@query("r03_generator", "WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS seed, 0 AS k, CASE WHEN n_nationkey = 0 THEN 1 ELSE n_nationkey::BIGINT END AS s FROM nation UNION ALL SELECT seed, k + 1, (s * 1664525 + 1013904223) % 4294967296 FROM r WHERE k < 20) SELECT seed, CAST(k AS BIGINT) AS k, s AS state FROM r WHERE k > 0")
def _(t):
    out = []
    for seed in [r.n_nationkey for r in t.raw("nation").select("n_nationkey").collect()]:  # 25 seeds
        rng = R.Lcg(seed)
        out += [(seed, k, round(rng() * (1 << 32))) for k in range(1, 21)]
    return rows(t, out, "seed long, k long, state long")


PL = """WITH RECURSIVE r AS (SELECT CAST(n_nationkey AS BIGINT) AS seed, CASE WHEN n_nationkey = 0 THEN 1 ELSE n_nationkey::BIGINT END AS st, [0, 1, 2, 3, 4]::BIGINT[] AS ids, [0.1, 0.5, 0.9, 0.4, 0.2]::DOUBLE[] AS s, -1::BIGINT AS pick, 0::DOUBLE AS p, 0::BIGINT AS k FROM nation
    UNION ALL SELECT seed, st, list_filter(ids, lambda x, i: i <> at_), list_filter(s, lambda x, i: i <> at_), ids[at_], w[at_] / list_sum(w), k + 1 FROM
        (SELECT *, coalesce(list_position(list_transform(range(1, len(w) + 1), lambda j: list_sum(w[1:j]) >= st / 4294967296.0::DOUBLE * list_sum(w)), true), len(w)) AS at_ FROM
            (SELECT seed, (st * 1664525 + 1013904223) % 4294967296 AS st, ids, s, k, list_transform(s, lambda x: exp((x - list_max(s)) / 0.15::DOUBLE)) AS w FROM r WHERE k < 4)))
    SELECT seed, k, pick, round(p, 6) AS p FROM r WHERE k > 0"""


@query("wf7_plackett_luce", PL)
def _(t):
    out = []
    for seed in [r.n_nationkey for r in t.raw("nation").select("n_nationkey").collect()]:  # 25 seeds
        out += [(seed, k, i, round(p, 6)) for k, (i, p) in enumerate(R.plackett_luce([0.1, 0.5, 0.9, 0.4, 0.2], 4, 0.15, R.Lcg(seed)), 1)]
    return rows(t, out, "seed long, k long, pick long, p double")


@query("r04_draws")
def _(t):
    """Beta draws of each user's arm under a seed of its own: between 0 and 1, near the posterior mean over many (see the tests)."""
    arms = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def draw(u, p, n):
        import pandas as pd

        return pd.Series([R.draw_beta(1 + a, 4 + b - a, R.Lcg(int(s))) for s, a, b in zip(u, p, n, strict=True)])

    return arms.select("user_id", draw("user_id", "p", "n").alias("draw"))


@query("r05_thompson")
def _(t):
    """The ten arms of largest draw, of all users."""
    arms = t.events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "purchase").alias("p"), F.count(F.lit(1)).alias("n")).orderBy("user_id").collect()  # a user's arms
    return rows(t, [(k, str(i)) for k, i in enumerate(R.thompson([(r.user_id, 1 + r.p, 4 + r.n - r.p) for r in arms], 10, R.Lcg(1)))], "place long, arm string")


@query("r07_profiles", """SELECT user_id AS "userId", pos, round(s / sqrt(sum(s * s) OVER (PARTITION BY user_id, kind)), 5) AS x, kind FROM (SELECT vec_id % 5 AS user_id, pos, k.kind,
    sum(embedding[pos + 1]::DOUBLE * CASE WHEN k.kind = 'recent' THEN pow(0.5::DOUBLE, vec_id * 2 / 24.0::DOUBLE / 7) ELSE 1 END) AS s FROM embeddings, (SELECT unnest(range(64)) AS pos), (VALUES ('stable'), ('recent'), ('negative')) k(kind)
    WHERE (k.kind = 'negative') = (label % 2 <> 0) AND (k.kind <> 'recent' OR pow(0.5::DOUBLE, vec_id * 2 / 24.0::DOUBLE / 7) >= 0.01) GROUP BY 1, 2, 3)""")
def _(t):
    s = t.raw("embeddings").select((F.col("vec_id") % 5).alias("userId"), (F.col("label") % 2 == 0).alias("positive"), F.col("embedding").alias("vector"), F.timestamp_seconds(F.lit(1_706_745_600) - F.col("vec_id") * 7200).alias("occurredAt"))
    out = M.profiles(s, F.expr("timestamp'2024-02-01 00:00:00'"))
    each = None
    for k in ("stable", "recent", "negative"):
        one = out.select("userId", F.lit(k).alias("kind"), F.posexplode(k).alias("pos", "x"))
        each = one if each is None else each.unionByName(one)
    return each.select("userId", "kind", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("x"))


@query("r08_profile_hash", "SELECT user_id, substr(sha256(CASE WHEN user_id % 3 = 0 THEN unhex('0000803F0000003F') ELSE 'null'::BLOB END || 'null'::BLOB || unhex('0000A0BF')), 1, 16) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    """Vectors of numbers that floats hold exactly; the fifth decimal doesn't count."""
    u = t.events.select("user_id").distinct()
    stable = F.when(F.col("user_id") % 3 == 0, F.array(F.lit(1.00001), F.lit(0.49999)))
    return u.select("user_id", B.profile_hash(stable, F.lit(None).cast("array<double>"), F.array(F.lit(-1.25))).alias("hash"))


SCORE = """(SELECT vec_id AS id, list_sum(list_transform(list_zip(embedding, c.v), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS d, label, pow(0.5::DOUBLE, vec_id / 48.0::DOUBLE) AS fresh FROM embeddings,
    (SELECT list(x ORDER BY pos) AS v FROM (SELECT pos, avg(embedding[pos + 1]::DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS pos) WHERE label = 1 GROUP BY 1)) c)"""


@query("r10_heuristic_score", f"SELECT id, round(1.0 * d + 1.3 * d + 0.8 * (0.3 - 0.2) + 0.6 * (fresh - 0.5) - 0.5 * 0.3 * ln(1 + label) + 0.4 * (0.25 - 0.2) + 0.3 * (1 - 0.4), 5) AS score, round(1.0::DOUBLE / (1 + label), 6) AS uncertainty FROM {SCORE}")
def _(t):
    from .queries_recommend import candidates

    scored = R.score(candidates(t), F.expr("timestamp'2024-02-01 00:00:00'"))
    return scored.select("id", F.round("score", 5).alias("score"), F.round("uncertainty", 6).alias("uncertainty"))


@query("r11_slots", """SELECT n, CAST(a AS BIGINT) AS adjacent, CAST(u AS BIGINT) AS uncertain, CAST(r AS BIGINT) AS random, CAST(n - a - u - r AS BIGINT) AS exploit FROM (SELECT *, greatest(0, least(n - a - u, ceil(n * 0.15::DOUBLE))) AS r FROM
    (SELECT *, greatest(0, least(n - a, ceil(n * 0.1::DOUBLE))) AS u FROM (SELECT n, least(n, ceil(n * 0.2::DOUBLE)) AS a FROM (SELECT unnest(range(1, 101)) AS n))))""")
def _(t):
    slots = [(n, R.slot_counts(n, R.SHARES)) for n in range(1, 101)]
    return rows(t, [(n, s["adjacent"], s["uncertain"], s["random"], s["exploit"]) for n, s in slots], "n long, adjacent long, uncertain long, random long, exploit long")


@query("r12_share_problem", "SELECT k, CASE WHEN k * 0.05::DOUBLE + 0.15 < 0.25 - 1e-9 THEN 'exploration' WHEN abs(0.55 + 0.2 + 0.15 + k * 0.05::DOUBLE - 1) > 0.01 THEN 'sum' ELSE 'none' END AS problem FROM (SELECT unnest(range(10)) AS k)")
def _(t):
    found = [(k, R.share_problem({**R.SHARES, "uncertain": 0.05 * k})) for k in range(10)]
    return rows(t, [(k, "none" if p is None else "exploration" if p.startswith("exploration") else "sum") for k, p in found], "k long, problem string")


@query("r13_slates")
def _(t):
    from .queries_recommend import candidates

    scored = R.score(candidates(t), F.expr("timestamp'2024-02-01 00:00:00'"))
    pool = scored.select((F.col("id") % 3).alias("userId"), "id", "score", "uncertainty", F.col("label").cast("string").alias("clusterId"), (F.col("id") % 40).cast("string").alias("domainId"), (F.col("id") % 11 == 0).alias("trial"), (F.col("id") % 5 == 0).alias("independent"))
    return R.slates(pool, 20, 42).select("userId", "id", "arm", "rank", F.round("propensity", 9).alias("propensity"))


@query("r15_due", "SELECT event_id, event_id % 50 = 0 OR (TIMESTAMP '2024-02-01 00:00:00' - ts) >= CASE event_id % 3 WHEN 0 THEN INTERVAL 20 HOUR WHEN 1 THEN INTERVAL 68 HOUR ELSE INTERVAL 164 HOUR END AS due FROM events")
def _(t):
    tier = F.element_at(F.array(F.lit("daily"), F.lit("every3days"), F.lit("weekly")), (F.col("event_id") % 3 + 1).cast("int"))
    last = F.when(F.col("event_id") % 50 != 0, F.col("ts"))
    return t.events.select("event_id", R.due(tier, last, F.expr("timestamp_ntz'2024-02-01 00:00:00'")).alias("due"))


@query("r18_observation", "SELECT user_id, CASE WHEN user_id % 5 = 0 THEN 'unobserved' WHEN max(CASE WHEN event_type = 'view' THEN event_id END) >= max(event_id) THEN 'observed' ELSE 'partial' END AS state FROM events GROUP BY 1")
def _(t):
    e = t.events.select(F.col("user_id").alias("briefingId"), F.col("event_id").alias("impressionId"), F.col("event_id").alias("rank"), (F.col("event_type") == "view").alias("viewed"), (F.col("user_id") % 5 != 0).alias("opened"))
    return R.examined(e).select(F.col("briefingId").alias("user_id"), "state").distinct()


@query("r19_trial_done", "SELECT event_id, coalesce(CASE WHEN event_id % 4 <> 0 THEN event_id % 10 END, 0) >= 6 OR coalesce(epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(CASE WHEN event_id % 7 <> 0 THEN ts END) >= 28 * 86400000000, false) AS done FROM events")
def _(t):
    return t.events.select("event_id", R.trial_done(F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 10), F.when(F.col("event_id") % 7 != 0, F.col("ts")), F.expr("timestamp_ntz'2024-02-05 00:00:00'")).alias("done"))


@query("r20_trial_plan", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS place, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 20 = 0 ORDER BY c_custkey LIMIT 7")
def _(t):
    """Three trials run, so seven places are free; the domains that the user asked for take them all."""
    c = t.users.orderBy("id").limit(400).collect()  # a user's screened domains
    plan = R.trial_plan([{"id": r.id, "alpha": 1.0, "beta": 4.0, "manual": "subscribe" if r.id % 20 == 0 else None} for r in c], 3, R.Lcg(1))
    return rows(t, [(k, str(i)) for k, i in enumerate(plan)], "place long, id string")


@query("r21_promotions", """WITH seated AS (SELECT c_nationkey AS u, c_custkey AS id, (c_custkey * 37 % 1000) / 1000.0::DOUBLE AS mean, CASE WHEN c_custkey % 11 = 0 THEN 'stale' END AS reason FROM customer WHERE c_custkey % 2 = 0),
    trials AS (SELECT c_nationkey AS u, c_custkey AS id, (c_custkey * 61 % 1000) / 1000.0::DOUBLE AS mean, c_custkey % 5 <> 0 AS done, c_custkey % 13 AS examined, CASE c_custkey % 17 WHEN 0 THEN 'subscribe' WHEN 1 THEN 'reject' END AS manual FROM customer WHERE c_custkey % 2 = 1),
    stay AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY mean, id) AS turn, count(*) OVER (PARTITION BY u) AS n FROM seated WHERE reason IS NULL),
    asked AS (SELECT u, id FROM trials WHERE done AND manual = 'subscribe'),
    f AS (SELECT n.u, greatest(0, 30 - coalesce(s.n, 0) - coalesce(a.n, 0)) AS free, greatest(0.2, CASE WHEN s.n >= 8 THEN s.means[CAST(floor(s.n * 0.25) AS BIGINT) + 1] ELSE 0 END) AS floor FROM (SELECT DISTINCT u FROM trials) n
        LEFT JOIN (SELECT u, count(*) AS n, list_sort(list(mean)) AS means FROM stay GROUP BY 1) s ON s.u = n.u LEFT JOIN (SELECT u, count(*) AS n FROM asked GROUP BY 1) a ON a.u = n.u),
    ranked AS (SELECT t.*, f.free, f.floor, row_number() OVER (PARTITION BY t.u ORDER BY t.mean DESC, t.id) AS place FROM trials t JOIN f ON f.u = t.u WHERE done AND coalesce(manual, '') NOT IN ('subscribe', 'reject') AND examined >= 6),
    ok AS (SELECT *, bool_and(place > free OR mean >= floor) OVER (PARTITION BY u) AS filled FROM ranked),
    won AS (SELECT u, id, NULL::BIGINT AS displaced FROM asked UNION ALL SELECT u, id, NULL FROM ok WHERE place <= free AND mean >= floor UNION ALL SELECT o.u, o.id, s.id FROM ok o JOIN stay s ON s.u = o.u AND s.turn = o.place - o.free WHERE o.place > o.free AND o.filled AND o.mean > s.mean)
    SELECT u AS "userId", id, 'promoted' AS change, displaced, NULL AS reason FROM won UNION ALL SELECT u, id, 'demoted', NULL, reason FROM seated WHERE reason IS NOT NULL UNION ALL SELECT u, displaced, 'demoted', NULL, 'displaced' FROM won WHERE displaced IS NOT NULL
    UNION ALL SELECT u, id, 'demoted', NULL, 'trial_failed' FROM trials WHERE done AND id NOT IN (SELECT id FROM won)""")
def _(t):
    c = t.raw("customer").select(F.col("c_nationkey").alias("userId"), F.col("c_custkey").alias("id"))
    mean = lambda k: (F.col("id") * k % 1000) / 1000.0
    seated = c.filter("id % 2 = 0").withColumn("mean", mean(37)).withColumn("reason", F.when(F.col("id") % 11 == 0, "stale"))
    manual = F.when(F.col("id") % 17 == 0, "subscribe").when(F.col("id") % 17 == 1, "reject")
    trials = c.filter("id % 2 = 1").withColumn("mean", mean(61)).withColumn("done", F.col("id") % 5 != 0).withColumn("examined", F.col("id") % 13).withColumn("manual", manual)
    return R.promotions(trials, seated, 30)


@query("wf8_admission_floor", "SELECT user_id % 20 AS id, greatest(0.2, CASE WHEN count(*) >= 8 THEN list_sort(list(value / 100))[CAST(floor(count(*) * 0.25) AS BIGINT) + 1] ELSE 0 END) AS floor FROM events WHERE event_id % 40 < 25 - user_id % 20 GROUP BY 1")
def _(t):
    some = t.events.filter("event_id % 40 < 25 - user_id % 20").groupBy((F.col("user_id") % 20).alias("id")).agg(F.collect_list(F.col("value") / 100).alias("means"))
    return some.select("id", R.floor_of("means").alias("floor"))


@query("r23_seat_count", "SELECT n, greatest(1, CAST(floor(n * 0.8::DOUBLE * 0.4 * 120 / 20 * 4 / 3 + 0.5) AS BIGINT)) AS seats FROM (SELECT unnest(range(0, 60)) AS n)")
def _(t):
    return rows(t, [(n, R.seat_count(n, 0.8)) for n in range(60)], "n long, seats long")


@query("a29_backfill_votes", f"SELECT domain, CAST(sum(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS weight, count(*) AS articles, array_to_string(list_sort(list(page_id))[1:5], ',') AS evidence FROM (SELECT page_id, regexp_extract(url, '^https://([^/?]+)', 1) AS domain FROM {CANONICAL}) WHERE domain <> (SELECT min(regexp_extract(url, '^https://([^/?]+)', 1)) FROM {CANONICAL}) GROUP BY 1")
def _(t):
    p = t.pages.select(F.col("page_id").alias("id"), (F.col("page_id") % 3 == 0).alias("positive"), urls.domain(urls.canonical(F.col("url"))).alias("host"))
    votes = B.backfill_votes(p, F.col("host"), (p.agg(F.min("host")).first()[0],))
    return votes.select("domain", "weight", "articles", F.array_join("evidence", ",").alias("evidence"))


@query("t13_shown_again", """SELECT o_custkey % 100 AS "userId", o_orderkey AS "candidateId", '2024-02-03' AS until FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders WHERE o_orderstatus <> 'P')
    WHERE rn <= 5 AND o_orderkey % 5 <> 0 AND o_custkey IN (SELECT min(c_custkey) FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 GROUP BY c_custkey % 100)""")
def _(t):
    briefings = t.users.select("id", (F.col("id") % 100).alias("userId"), F.when(F.col("id") % 2 == 0, "2024-02-01").otherwise("2024-01-31").alias("day"), F.when(F.col("id") % 3 == 0, "unobserved").otherwise("partial").alias("state"))
    o = t.raw("orders")
    impressions = o.select(F.col("o_custkey").alias("briefingId"), F.col("o_orderkey").alias("candidateId"), F.col("o_orderkey").alias("rank"), (F.col("o_orderstatus") != "P").alias("shown"))
    candidates = o.select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("userId"), F.when(F.col("o_orderkey") % 5 == 0, "b").alias("bookmarkId"))
    out = B.again(briefings, impressions, candidates, F.lit("2024-02-01"), F.lit("2024-02-03"))
    return out.select("userId", "candidateId", F.col("expiresAt").alias("until"))


@query("st11_abandoned_reads", "SELECT o_custkey AS \"impressionId\" FROM orders GROUP BY 1 HAVING o_custkey % 4 <> 0 AND min(o_orderdate) < TIMESTAMP '1996-01-01 00:00:00' - INTERVAL 7 DAY AND bool_or(o_orderpriority = '1-URGENT') AND NOT bool_or(o_orderpriority = '2-HIGH')")
def _(t):
    o = t.raw("orders")
    impressions = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("createdAt")).withColumn("final", F.col("id") % 4 == 0)
    types = F.when(F.col("o_orderpriority") == "1-URGENT", "read_intent").when(F.col("o_orderpriority") == "2-HIGH", "read_partial").otherwise("viewed")
    events = o.select(F.col("o_custkey").alias("impressionId"), types.alias("type"))
    return B.abandoned_reads(events, impressions, F.expr("timestamp_ntz'1996-01-01 00:00:00'")).select("impressionId")


@query("d06_bootstrap", """WITH b AS (SELECT b.id, b.userId, b.createdAt, CASE WHEN r.id IS NOT NULL THEN 'read_full' WHEN h.id IS NOT NULL THEN 'highlighted' WHEN b.favourited THEN 'favourited' END AS strong FROM bookmarks b
    LEFT JOIN (SELECT DISTINCT bookmarkId AS id FROM in_lists WHERE listId % 10 = 1) h ON h.id = b.id LEFT JOIN (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_quantity * 2 >= 60 AND l_partkey % 5 = 0) r ON r.id = b.id WHERE b.type = 'link' AND b.id % 6 <> 0)
    SELECT sha256('bootstrap:' || userId || ':' || id) AS key, type, strftime(createdAt, '%Y-%m-%d') AS day, round(1.2 + CASE strong WHEN 'read_full' THEN 0.8 WHEN 'highlighted' THEN 0.9 WHEN 'favourited' THEN 1.0 ELSE 0 END, 6)::DOUBLE AS reward FROM b, (VALUES ('saved'), ('strong')) k(kind), LATERAL (SELECT CASE WHEN k.kind = 'saved' THEN 'saved' ELSE strong END AS type) WHERE type IS NOT NULL""", "bookmarks", "in_lists")
def _(t):
    b = t.bookmarks.select("id", "userId", F.when(F.col("type") == "link", "https://x.org").alias("url"), F.lit("t").alias("title"), "createdAt", "favourited")
    highlights = t.in_lists.filter("listId % 10 = 1").select("bookmarkId")
    progress = t.raw("lineitem").filter("l_partkey % 5 = 0").select(F.col("l_orderkey").alias("bookmarkId"), (F.col("l_quantity") * 2).alias("percent"))
    known = t.bookmarks.filter("id % 6 = 0").select(F.col("id").alias("bookmarkId"))
    _, impressions, events = B.bootstrap(b, highlights, progress, known)
    both = events.join(impressions.select(F.col("key").alias("impressionKey"), "reward"), "impressionKey")
    return both.select(F.col("impressionKey").alias("key"), "type", F.date_format("occurredAt", "yyyy-MM-dd").alias("day"), F.round("reward", 6).alias("reward"))


ITEMS = """items AS (SELECT o_custkey % 100 + 1 AS sourceId, 'https://d' || (o_orderkey % 40) || '.org/' || (o_orderkey % 4000) AS url, 'u' || (o_orderkey % 4000) AS urlHash, CASE WHEN o_orderkey % 3 <> 0 THEN 't' || (o_orderkey % 5000) END AS titleHash, o_orderkey AS title, o_orderdate AS published, 'd' || (o_orderkey % 40) || '.org' AS domain FROM orders),
    ready AS (SELECT s_suppkey % 3 AS userId, s_suppkey AS id FROM supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 4 = 3 OR s_suppkey % 200 >= CASE s_suppkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 68 ELSE 164 END)),
    pending AS (SELECT r.userId, i.* FROM items i JOIN ready r ON r.id = i.sourceId)"""


def collected(t):
    n = F.col("s_suppkey")
    tier = F.when(n % 4 == 0, "daily").when(n % 4 == 1, "every3days").when(n % 4 == 2, "weekly")
    now = F.expr("timestamp'2024-02-01 00:00:00'")
    sources = t.raw("supplier").select((n % 3).alias("userId"), n.alias("id"), tier.alias("tier"), (now - F.make_interval(hours=(n % 200).cast("int"))).alias("lastFetchedAt"), F.lit(None).cast("double").alias("mean"), (n % 5 == 0).alias("independent"), (n % 7 != 0).alias("enabled"))
    k = F.col("o_orderkey")
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    items = t.raw("orders").select((F.col("o_custkey") % 100 + 1).alias("sourceId"), F.concat(name("https://d", k % 40), name(".org/", k % 4000)).alias("url"), name("u", k % 4000).alias("urlHash"), F.when(k % 3 != 0, name("t", k % 5000)).alias("titleHash"), k.cast("string").alias("title"), F.col("o_orderdate").alias("published"), F.concat(name("d", k % 40), F.lit(".org")).alias("domain"))
    known = t.raw("orders").filter("o_orderkey % 50 = 0").select((k % 3).alias("userId"), name("u", k % 4000).alias("urlHash"), name("t", k % 5000).alias("titleHash"))
    return B.collect(sources, items, known, now, 10**7)


@query("d07_collect", f"""WITH {ITEMS}, known AS (SELECT o_orderkey % 3 AS userId, 'u' || (o_orderkey % 4000) AS urlHash, 't' || (o_orderkey % 5000) AS titleHash FROM orders WHERE o_orderkey % 50 = 0),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY userId, urlHash ORDER BY published DESC NULLS LAST, sourceId, titleHash NULLS LAST) AS rn FROM pending)
    SELECT userId AS "userId", sourceId AS "sourceId", urlHash AS "urlHash", titleHash AS "titleHash", domain FROM fresh f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM known k WHERE k.userId = f.userId AND k.urlHash = f.urlHash) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.userId = f.userId AND k.titleHash = f.titleHash)""")
def _(t):
    return collected(t)[0].select("userId", "sourceId", "urlHash", "titleHash", "domain")


@query("d07_domains", f"WITH {ITEMS} SELECT DISTINCT userId AS \"userId\", domain, 'discovered' AS status FROM pending")
def _(t):
    return collected(t)[1]


# --- streams and rules


@query("st05_polls", "SELECT n_nationkey AS id, 'n' || n_nationkey AS \"userId\", n_nationkey || '-1998-08-01T10:00:00Z' AS key, m AS minute, CASE WHEN m >= 25 THEN m - 25 ELSE m + 35 END AS wait FROM (SELECT n_nationkey, CAST(abs(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 60 AS BIGINT) AS m FROM (SELECT n_nationkey, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(CAST(n_nationkey AS VARCHAR), ''), lambda c: ascii(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS h FROM nation))")
def _(t):
    feeds = t.raw("nation").select(F.col("n_nationkey").alias("id"), F.concat(F.lit("n"), text_of("n_nationkey")).alias("userId"))
    return keyed.polls(feeds, F.expr("timestamp'1998-08-01 10:25:30'"))


@query("st07_micro_batches", """WITH p AS (SELECT event_id AS seq, epoch_us(ts) // 1000000 AS t, row_number() OVER (ORDER BY epoch_us(ts) // 1000000, event_id) AS rn FROM events),
    r AS (WITH RECURSIVE r AS (SELECT seq, rn, t AS first, 1 AS held, 0::BIGINT AS batch FROM p WHERE rn = 1 UNION ALL SELECT p.seq, p.rn, CASE WHEN held = 20 OR p.t >= first + 3600 THEN p.t ELSE first END, CASE WHEN held = 20 OR p.t >= first + 3600 THEN 1 ELSE held + 1 END, CASE WHEN held = 20 OR p.t >= first + 3600 THEN batch + 1 ELSE batch END
        FROM r JOIN p ON p.rn = r.rn + 1) SELECT * FROM r) SELECT seq, batch FROM r""")
def _(t):
    return keyed.batches(t.events.select(F.lit("one").alias("buffer"), F.col("event_id").alias("seq"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")), 20, 3600.0).select("seq", "batch")


@query("st08_claim", "SELECT id FROM bookmarks b JOIN (SELECT userId, max(createdAt) FILTER (archived) AS last FROM bookmarks GROUP BY 1) s USING (userId) WHERE NOT archived ORDER BY last NULLS FIRST, createdAt, id LIMIT 25", "bookmarks")
def _(t):
    items = t.bookmarks.select("id", F.col("userId").alias("sessionId"), F.when(F.col("archived"), "completed").otherwise("pending").alias("status"), "createdAt")
    sessions = t.bookmarks.groupBy(F.col("userId").alias("id")).agg(F.max(F.when(F.col("archived"), F.col("createdAt"))).alias("lastProcessedAt"))
    return M.claim(items, sessions, batch=25).select("id")


@query("st19_event_match", "SELECT event_id FROM events WHERE (event_type = 'purchase' AND user_id % 10 IN (0, 1, 2))")
def _(t):
    e = t.events.select("event_id", F.struct(F.col("event_type").alias("type"), F.create_map(F.lit("list"), (F.col("user_id") % 10).cast("string")).alias("targets")).alias("event"))
    return e.filter(keyed.event_matches(RULES[1]["event"])).select("event_id")


LEAVES = [
    ({"type": "urlContains", "str": "en/"}, "type = 'link' AND url LIKE '%en/%'"), ({"type": "urlDoesNotContain", "str": "en/"}, "type = 'link' AND url NOT LIKE '%en/%'"),
    ({"type": "titleContains", "str": "T1"}, "title LIKE '%T1%'"), ({"type": "titleDoesNotContain", "str": "t1"}, "title NOT LIKE '%t1%'"), ({"type": "importedFromFeed", "feedId": "2"}, "page_id % 4 = 2"),
    ({"type": "bookmarkTypeIs", "bookmarkType": "text"}, "type = 'text'"), ({"type": "bookmarkSourceIs", "source": "rss"}, "page_id % 2 = 0"), ({"type": "hasTag", "tagId": "a"}, "page_id % 3 = 0"), ({"type": "isFavourited"}, "page_id % 5 = 0"),
    ({"type": "isArchived"}, "page_id % 7 = 0"), ({"type": "alwaysTrue"}, "true"), ({"type": "or", "conditions": [{"type": "isArchived"}, {"type": "and", "conditions": [{"type": "isFavourited"}, {"type": "hasTag", "tagId": "a"}]}]}, "page_id % 7 = 0 OR page_id % 15 = 0"),
]


@query("st20_conditions", "SELECT page_id, " + ", ".join(f"coalesce({sql}, false) AS c{k}" for k, (_, sql) in enumerate(LEAVES)) + " FROM (SELECT page_id, CASE WHEN page_id % 3 <> 1 THEN 'link' ELSE 'text' END AS type, CASE WHEN page_id % 6 <> 0 THEN url END AS url, CASE WHEN page_id % 8 <> 0 THEN 'T' || page_id END AS title FROM pages)")
def _(t):
    p = F.col("page_id")
    b = t.pages.select(
        "page_id", F.when(p % 3 != 1, "link").otherwise("text").alias("type"), F.when(p % 6 != 0, F.col("url")).alias("url"), F.when(p % 8 != 0, F.concat(F.lit("T"), text_of("page_id"))).alias("title"), F.when(p % 2 == 0, "rss").alias("source"),
        (p % 5 == 0).alias("favourited"), (p % 7 == 0).alias("archived"), F.when(p % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("tags"), F.array((p % 4).cast("string")).alias("feeds"),
    )
    return b.select("page_id", *[keyed.condition(c).alias(f"c{k}") for k, (c, _) in enumerate(LEAVES)])


ACTIONS = [("addTag", "t"), ("removeTag", "u"), ("addToList", "l"), ("removeFromList", "m"), ("downloadFullPageArchive", ""), ("favourite", ""), ("archive", "")]


@query("st21_actions", "SELECT '9' AS \"ruleId\", event_id AS \"bookmarkId\", a.action, a.target FROM events, (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in ACTIONS) + ") a(action, target) WHERE event_type = 'click'")
def _(t):
    e = t.events.select(
        F.struct(F.col("event_type").alias("type"), F.create_map().cast("map<string,string>").alias("targets")).alias("event"), F.col("event_id").alias("id"), F.lit("t").alias("title"), F.lit(True).alias("favourited"), F.lit("link").alias("type"), F.lit(None).cast("string").alias("url"),
        F.lit("rss").alias("source"), F.lit(False).alias("archived"), F.array().cast("array<string>").alias("tags"), F.array().cast("array<string>").alias("feeds"),
    )
    return keyed.actions(e, [{"id": 9, "event": {"type": "click"}, "condition": {"type": "alwaysTrue"}, "actions": [{"type": a, "target": b} for a, b in ACTIONS]}])
