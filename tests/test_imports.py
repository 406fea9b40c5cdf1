"""Import readers, merging, feeds and exports on small files."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from foliospark.sources import imports as I


def rows(df):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: str(r["url"]))


@pytest.fixture
def file(tmp_path):
    def write(name, text):
        p = tmp_path / name
        p.write_text(text, encoding="utf-8")
        return str(p)

    return write


def test_browser_html(spark, file):
    page = '<!DOCTYPE NETSCAPE-Bookmark-file-1><DL><p><DT><A HREF="https://a.com" ADD_DATE="100" TAGS="x, y">A &amp; b</A><DT><H3>One</H3><DL><p><DT><H3>Two</H3><DL><p><DT><A HREF="https://b.com">B</A></DL><p><DT><A HREF="https://c.com" ADD_DATE="x">C</A></DL><p></DL>'
    a, b, c = rows(I.read_import(spark, "html", file("b.html", page)))
    assert (a["title"], a["tags"], a["addDate"], a["paths"]) == ("A & b", ["x", "y"], 100.0, [])
    assert b["paths"] == [["One", "Two"]] and c["paths"] == [["One"]] and c["addDate"] is None


def test_csv_formats(spark, file):
    a = rows(I.read_import(spark, "pipe-csv", file("a.csv", "title,url,time_added,tags,status\nA,https://a.com,100,x|y,unread\nB,https://b.com,200,,archive\n")))
    assert [r["archived"] for r in a] == [False, True] and a[0]["tags"] == ["x", "y"] and a[1]["tags"] == []
    b = rows(I.read_import(spark, "folder-csv", file("b.csv", 'URL,Title,Selection,Folder,Timestamp,Tags\nhttps://a.com,A,note,Unread,100,"[""x"",""y""]"\nhttps://b.com,B,,Archive,200,oops\nhttps://c.com,C,,Work,300,[]\n')))
    assert [(r["tags"], r["archived"], r["paths"], r["notes"]) for r in b] == [(["x", "y"], False, [], "note"), ([], True, [], None), ([], False, [["Work"]], None)]
    c = rows(I.read_import(spark, "reader-csv", file("c.csv", "Title,URL,ID,Document tags,Saved date,Reading progress,Location,Seen\nA,https://a.com,1,\"['x', 'it''s']\",2024-01-01 00:00:00+00:00,0,archive,True\nB,https://b.com,2,,2024-01-02 00:00:00+00:00,0,feed,True\nC,,3,,2024-01-02 00:00:00+00:00,0,new,True\n")))
    assert len(c) == 1 and c[0]["archived"] and c[0]["addDate"] == 1704067200.0 and c[0]["tags"][0] == "x"
    d = rows(I.read_import(spark, "note-csv", file("d.csv", "id,type,title,url,content,note,tags,created\n1,x,A,https://a.com,text,n,\"a, b\",2024-01-01T00:00:00Z\n2,x,B,,only text,,,2024-01-01T00:00:00Z\n3,x,C, , ,,,\n")))
    assert sorted(((r["title"], r["contentType"], r["url"], r["text"], r["tags"]) for r in d), key=str) == [("A", "link", "https://a.com", None, ["a", "b"]), ("B", "text", None, "only text", []), ("C", None, None, None, [])]
    e = rows(I.read_import(spark, "queue-csv", file("e.csv", "Title,Author,Publisher,URL,Tags,Word Count,In Queue,Favorited,Read,Highlight_Count,Last Interaction Date,File Id\nA,,,https://a.com,x;y,1,False,,,,2024-01-01T00:00:00Z,\nB,,,https://b.com,,1,True,,,,,\n")))
    assert [(r["tags"], r["archived"]) for r in e] == [(["x", "y"], True), ([], False)]


def test_json_formats(spark, file):
    a = rows(I.read_import(spark, "label-json", file("a.json", json.dumps([{"title": "A", "url": "https://a.com", "labels": ["x"], "savedAt": "2024-01-01T00:00:00Z", "state": "Archived"}, {"title": "B", "url": "https://b.com"}]))))
    assert [(r["tags"], r["archived"], r["addDate"]) for r in a] == [(["x"], True, 1704067200.0), ([], None, None)]
    tree = {"collections": [{"id": 1, "name": "Top/x", "links": [{"name": "A", "url": "https://a.com", "tags": [{"name": "t"}], "createdAt": "2024-01-01T00:00:00Z"}]}, {"id": 2, "name": "Sub", "parentId": 1, "links": [{"name": "B", "url": "https://b.com", "tags": []}]}]}
    b = rows(I.read_import(spark, "collection-json", file("b.json", json.dumps(tree))))
    assert [r["paths"] for r in b] == [[["Top/x"]], [["Top/x", "Sub"]]]
    tab = lambda u: {"url": u, "title": u, "lastAccessed": 5000}
    sessions = [{"date": 2, "windows": {"w": {"1": tab("old")}}}, {"date": 9, "windows": {"w": {"1": tab("x")}}}, {"date": 9, "windows": {"w": {"1": tab("a"), "2": tab("b")}, "v": {"3": tab("c")}}}]
    c = rows(I.read_import(spark, "session-json", file("c.json", json.dumps(sessions))))
    assert [r["url"] for r in c] == ["a", "b", "c"] and c[0]["addDate"] == 5.0
    native = {"bookmarks": [{"createdAt": 5, "title": "A", "tags": ["t"], "lists": ["m", "s"], "content": {"type": "link", "url": "https://a.com"}, "note": "n", "archived": False}], "lists": [{"id": "m", "name": "M", "type": "manual"}, {"id": "s", "name": "S", "type": "smart", "query": "x"}]}
    d = rows(I.read_import(spark, "native-json", file("d.json", json.dumps(native))))
    assert d[0]["listExternalIds"] == ["m"] and d[0]["contentType"] == "link"


def test_lines_and_unknown_source(spark, file):
    a = rows(I.read_import(spark, "line-text", file("a.txt", "https://a.com | Title | more\nnot a link\nhttps://b.com\n")))
    assert [(r["url"], r["title"]) for r in a] == [("https://a.com", "Title | more"), ("https://b.com", None)]
    with pytest.raises(ValueError):
        I.read_import(spark, "nothing", "x")


def test_merge_by_url(spark):
    data = [("A", "link", "u", None, ["x"], 200.0, "n1", False, [["p"]], None), (None, "link", "u", None, ["y", "x"], 100.0, "n2", True, [["q"]], ["l"]), ("T", "text", None, "words", [], 1.0, None, None, [], None), ("T", "text", None, "words", [], 1.0, None, None, [], None)]
    placed = spark.createDataFrame([(*r, k) for k, r in enumerate(data)], f"{I.ROW}, place long")
    got = I.merge_by_url(placed.repartition(3), "place").collect()
    one = next(r for r in got if r.url == "u")
    assert len(got) == 3 and (one.title, one.tags, one.addDate, one.notes, one.archived, one.paths, one.listExternalIds) == ("A", ["x", "y"], 100.0, "n1\n---\nn2", True, [["p"], ["q"]], ["l"])


def test_feeds(spark, file):
    rss = "<rss><channel><item><title>A</title><link>https://a.com</link><guid>1</guid><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate><category>x</category><category>y</category></item><item><title>B</title><link>https://b.com</link></item></channel></rss>"
    items = I.feed_items(spark, file("f.xml", rss))
    got = {r.guid: r for r in items.collect()}
    assert set(got) == {"1", "https://b.com"} and got["1"].categories == ["x", "y"] and str(got["1"].published) == "2024-01-01 10:00:00"
    assert I.since(items, F.expr("timestamp'2024-06-01'"), 5).count() == 1
    assert [r.guid for r in I.new_items(items, spark.createDataFrame([("1",)], "guid string")).collect()] == ["https://b.com"]
    page = spark.createDataFrame([('<link rel="alternate" type="application/rss+xml" href="/feed.xml"><link rel="stylesheet" href="x.css">',)], "h string")
    assert page.select(I.feed_links(F.col("h")).alias("f")).first().f == ["/feed.xml"]


def test_captured_answers(spark, file):
    hits = I.news_hits(spark, file("n.json", json.dumps({"hits": [{"title": "A", "url": "https://a.com", "created_at_i": 0, "points": 3}, {"title": "B", "url": None}]}))).collect()
    assert [(r.url, r.points) for r in hits] == [("https://a.com", 3)]
    repos = I.repository_items(spark, file("r.json", json.dumps({"items": [{"full_name": "a/b", "html_url": "u", "pushed_at": None, "created_at": "2024-01-01T00:00:00Z", "stargazers_count": 1}]}))).collect()
    assert str(repos[0].published) == "2024-01-01 00:00:00"


def test_exports(spark):
    docs = spark.createDataFrame([(5.0, "A <b>", ["x", "y"], ["l"], "link", "https://a.com/?q=1&r=2", None, None, False), (6.0, None, [], [], "asset", None, None, None, False), (7.0, "T", [], [], "text", None, "words", "n", True), (8.0, "J", [], [], "link", "javascript:alert(1)", None, None, False)], "createdAt double, title string, tags array<string>, lists array<string>, type string, url string, text string, note string, archived boolean")
    kept = I.native_records(docs).collect()
    assert [r.content.type if r.content else None for r in kept] == ["link", None, "text", "link"] and kept[2].content.url is None
    assert [r.value for r in I.browser_lines(docs).collect()] == ['    <DT><A HREF="https://a.com/?q=1&amp;r=2" ADD_DATE="5" TAGS="x,y">A &lt;b&gt;</A>']
