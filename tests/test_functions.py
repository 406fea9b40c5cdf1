"""URL, text and vector functions."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import text, urls, vectors


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("http://www.Example.com:80/post/#top", "https://example.com/post"),
        ("https://example.com/post/?utm_source=x&b=2&a=1&fbclid=z", "https://example.com/post?a=1&b=2"),
        ("https://example.com/?p=123", "https://example.com/?p=123"),
        ("https://example.com", "https://example.com/"),
        ("https://example-com.cdn.ampproject.org/c/s/example.com/post", "https://example.com/post"),
        ("https://amp.example.com/x/amp/", "https://example.com/x"),
        ("https://example.com/x.amp.html", "https://example.com/x.html"),
        ("https://youtube.com/watch?v=1&si=2", "https://youtube.com/watch?v=1"),
        ("https://other.com/watch?v=1&si=2", "https://other.com/watch?si=2&v=1"),
        ("https://blog.example.com/a", "https://blog.example.com/a"),
        ("ftp://example.com", None),
        ("javascript:alert(1)", None),
        ("not a url", None),
        ("", None),
        (None, None),
        ("https://example.com:port/", None),
    ],
)
def test_canonical_url(raw, want):
    assert urls.canonical_url(raw) == want


def test_titles():
    assert urls.title_key("Ｒｕｓｔ 1.90 released!") == urls.title_key("rust 1.90 Released")
    assert urls.title_key("Rust 1.90 released") != urls.title_key("Rust 1.91 released")
    assert urls.title_key("!?…") == "…".replace("…", "") or urls.title_key("!?") is None
    assert urls.title_key(None) is None and urls.title_key(" - ") is None


def test_url_columns(spark):
    df = spark.createDataFrame([("https://www.A.com:80/x/?q=1#f",), ("mailto:x",), (None,), ("a.com/x",)], "u string")
    got = df.select(urls.canonical(F.col("u")).alias("c"), urls.canonical_builtin(F.col("u")).alias("b"), urls.host_as_written(F.col("u")).alias("h"), urls.light(F.col("u")).alias("l"), urls.allowed(F.col("u")).alias("ok")).collect()
    assert got[0].c == got[0].b == "https://a.com/x?q=1" and got[0].h == "www.A.com:80" and got[0].l == "https://www.A.com:80/x/?q=1"
    assert [r.ok for r in got] == [True, False, False, False] and got[1].c is None and got[1].b is None and got[3].h == "a.com"
    hashed = df.select(urls.url_hash(F.lit("x")).alias("h"), urls.domain(F.lit("https://a.com/x")).alias("d")).first()
    assert hashed.h == hashlib.sha256(b"x").hexdigest()[:32] and hashed.d == "a.com"


def test_text_columns(spark):
    one = spark.createDataFrame([("My-Tag_1 x", "<p>A &amp; <b>b</b></p><script>x</script>", "漢字ab", '<a href="https://x.com/a">1</a><a class="y" href=\'/b\'>2</a>')], "t string, h string, c string, p string")
    r = one.select(
        text.tag_key(F.col("t")).alias("k"), text.tag_key_loose(F.col("t")).alias("l"), text.without_hash(F.lit("##a")).alias("w"), text.escape_html(F.lit("<a b=\"c\">&'")).alias("e"), text.html_text(F.col("h")).alias("x"),
        text.cjk_count(F.col("c")).alias("n"), text.token_estimate(F.col("c")).alias("tok"), text.hrefs(F.col("p")).alias("a"), text.hash_of(F.col("t")).alias("hash"), text.jitter_minutes(F.col("t")).alias("j"),
    ).first()
    assert (r.k, r.l, r.w, r.e, r.x) == ("mytag1x", "mytagx", "a", "&lt;a b=&quot;c&quot;&gt;&amp;&#x27;", "A & b")
    assert (r.n, r.tok, r.a) == (2, 4, ["https://x.com/a", "/b"]) and 0 <= r.j < 60 and r.hash == text.string_hash("My-Tag_1 x")
    assert text.string_hash("hello") == 99162322 and text.truncate_to("漢字漢字", 3) == "漢字" and text.truncate_to("", 3) == ""


def test_page_signals(spark):
    page = '<p>' + "word " * 200 + '</p><a href="https://other.com/x">x</a><a href="https://me.com/y">y</a><script src="https://x.doubleclick.net/a.js"></script>'
    s = text.page_signals(F.col("h"), F.lit("me.com"))
    r = spark.createDataFrame([(page,)], "h string").select(*[c.alias(k) for k, c in s.items()]).withColumn("why", text.quality_reason(F.col("text_length"), F.col("outbound_ratio"), F.col("ad_scripts"))).first()
    assert r.outbound == 1 and r.ad_scripts == 1 and r.text_length > 900 and r.why is None


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype("f4").tolist(), i % 2) for i in range(30)] + [(99, [0.0] * 8, 0)]
    df = spark.createDataFrame(rows, "id long, vector array<float>, g int")
    m = {i: np.array(v) for i, v, _ in rows}
    q = m[3]
    got = df.select("id", vectors.dot(F.col("vector"), F.array(*map(F.lit, q.tolist()))).alias("d"), vectors.normalised(F.col("vector")).alias("u"), vectors.cosine(F.col("vector"), F.array(*map(F.lit, q.tolist()))).alias("c"), vectors.shortened(F.col("vector"), 4).alias("s"), vectors.from_blob(vectors.to_blob(F.col("vector"))).alias("back")).collect()
    for r in got:
        v = m[r.id]
        assert abs(r.d - v @ q) < 1e-9 and np.allclose(r.back, v)
        assert np.allclose(r.u, v / np.linalg.norm(v) if r.id != 99 else v) and (r.c == 0) == (r.id == 99)
        assert r.id == 99 or abs(np.linalg.norm(r.s) - 1) < 1e-9
    top = [r.id for r in vectors.nearest(df, q.tolist(), 5).collect()]
    assert top == sorted(m, key=lambda i: (-(m[i] @ q), i))[:5]
    c = {r.g: r.centroid for r in vectors.centroids(df, "g").collect()}
    assert np.allclose(c[1], np.mean([m[i] for i, _, g in rows if g == 1], 0))


def test_screening_and_metadata(spark):
    df = spark.createDataFrame([("blog.bad.com", 9, None), ("good.com", 2, None), ("good.com", 3, "short"), ("notbad.com", 3, None)], "h string, n long, why string")
    assert [r.s for r in df.select(text.screen(F.col("h"), F.col("n"), F.col("why"), ["bad.com"]).alias("s")).collect()] == ["blocked", "inactive", "short", None]
    meta = spark.createDataFrame([("a", "b", False), ("", "b", False), ("a", "b", True), ("a", None, True)], "r string, p string, x boolean")
    assert [r.m for r in meta.select(text.preferred(F.col("r"), F.col("p"), F.col("x")).alias("m")).collect()] == ["a", "b", "b", "a"]
    page = spark.createDataFrame([("Just a moment...", ""), ("Real", "<p>cf-challenge</p>"), ("Real", "x" * 30_000 + "cf-challenge"), (None, None)], "t string, h string")
    assert [r.c for r in page.select(text.is_challenge(F.col("t"), F.col("h"), ["just a moment..."], ["cf-challenge"]).alias("c")).collect()] == [True, True, False, False]
    emb = spark.createDataFrame([("T", " a  b ", "漢" * 2000), (None, None, "x" * 2000), (None, " ", None)], "t string, s string, b string").select(text.embedding_text(F.col("t"), F.col("s"), F.col("b")).alias("e")).collect()
    assert emb[0].e == "T\n\na b\n\n" + "漢" * 1200 and len(emb[1].e) == 1500 and emb[2].e is None
    long = "word " * 60
    pieces = spark.createDataFrame([(f"<p>{long}</p>", f"<p>{long}</p>"), (f"<p>{long}</p>", "<p>漢字</p>"), (f"<p>{long}</p>", "<b><i><u>漢</u></i></b>")], "a string, b string").select(text.chunk_problems(F.col("a"), F.col("b"), True).alias("p")).collect()
    assert [r.p for r in pieces] == [["echo"], [], ["tags"]]


def test_sequential_text_rules():
    html = "<p>one</p><div><p>two</p><br><p>three is longer</p></div>text<!-- c --><p>x</p>"
    for most in (1, 8, 20, 30, 1000):
        assert "".join(text.html_pieces(html, most)) == html
    assert text.html_pieces(html, 1000) == [html] and text.html_pieces("", 5) == [] and max(map(len, text.html_pieces(html, 40))) <= 60
    rules = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: a\nUser-agent: b\nDisallow: /\nAllow: /x # note\nnonsense\n"
    assert text.robots_allow(rules, "c", "/private/open/1") and not text.robots_allow(rules, "c", "/private/1") and text.robots_allow(rules, "B", "/x/y") and not text.robots_allow(rules, "a", "/y") and text.robots_allow("", "a", "/")
    assert text.salvaged_objects('noise {"id": 1, "t": "a}b"} {"id": 2, "x": {"y": 3}} {broken} {"id": 4') == [{"id": 1, "t": "a}b"}, {"y": 3}, {"id": 2, "x": {"y": 3}}]
