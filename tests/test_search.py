"""The search language and its matchers on the six-bookmark fixture."""

from __future__ import annotations

from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from foliospark.operators.search import Library, find, full_text, matching
from foliospark.plans.query_language import Age, Both, Leaf, age_limit, parse

FAV, ARCHIVED = Leaf("favourited"), Leaf("archived")


@pytest.mark.parametrize(
    ("query", "result", "text", "matcher"),
    [
        ("is:fav -is:archived", "full", "", Both("and", (FAV, Leaf("archived", None, True)))),
        ("(is:fav is:archived) or (#my-tag)", "full", "", Both("or", (Both("and", (FAV, ARCHIVED)), Leaf("tag", "my-tag")))),
        ("(is:fav or is:archived) and #my-tag", "full", "", Both("and", (Both("or", (FAV, ARCHIVED)), Leaf("tag", "my-tag")))),
        ("hello world", "full", "hello world", None),
        ("is:fav is:helloworld", "full", "is:helloworld", FAV),
        ("(is:archived) or ", "partial", "or", ARCHIVED),
        ("is:fav is: ( random", "partial", "is: ( random", FAV),
        ("age:<3d", "full", "", Leaf("age", Age(True, 3, "d"))),
        ("-age:>2y", "full", "", Leaf("age", Age(False, 2, "y"))),
        ("age:3d", "full", "age:3d", None),
        ("#a or foo", "full", "foo", Leaf("tag", "a")),
        ("foo android", "partial", "foo android", None),
        ('!tag:"two words"', "full", "", Leaf("tag", "two words", True)),
        ("is:fav and is:archived or is:tagged", "full", "", Both("or", (Both("and", (FAV, ARCHIVED)), Leaf("tagged")))),
        ("after:yesterday source:unknown", "full", "after:yesterday source:unknown", None),
        ("source:rss", "full", "", Leaf("source", "rss")),
        ("", "invalid", "", None),
        ('"quoted"', "invalid", '"quoted"', None),
    ],
)
def test_parse(query, result, text, matcher):
    parsed = parse(query)
    assert (parsed.result, parsed.text, parsed.matcher) == (result, text, matcher)


def test_ages_follow_the_calendar():
    now = datetime(2024, 3, 31, 12, tzinfo=UTC)
    assert age_limit(Age(True, 2, "w"), now) == datetime(2024, 3, 17, 12, tzinfo=UTC)
    assert age_limit(Age(True, 1, "m"), now) == datetime(2024, 3, 2, 12, tzinfo=UTC)  # 31 February runs on
    assert age_limit(Age(True, 1, "y"), now) == datetime(2023, 3, 31, 12, tzinfo=UTC)


@pytest.fixture(scope="module")
def lib(spark):
    day = lambda d: datetime(2024, 1, d, tzinfo=UTC)
    marks = [("b1", "link", False, False, day(1), None, "rss"), ("b2", "link", True, True, day(2), "example domain page", None), ("b3", "text", True, False, day(3), "third bookmark", "web"), ("b4", "link", False, True, day(4), "another example page", "web"), ("b5", "text", False, False, day(5), "fifth text", "api"), ("b6", "asset", True, False, day(6), "example asset", None)]
    return Library(
        spark.createDataFrame(marks, "id string, type string, archived boolean, favourited boolean, createdAt timestamp, title string, source string"),
        spark.createDataFrame([("b1", "https://example.com/page1", "example link", "success", 200), ("b2", "https://test.com/page2", None, "failure", 500), ("b4", "https://example.com/page3", None, "success", 404)], "id string, url string, title string, crawlStatus string, crawlStatusCode int"),
        spark.createDataFrame([("b6", "https://example.com/image.png")], "id string, sourceUrl string"),
        spark.createDataFrame([("t1", "tag1"), ("t2", "tag2"), ("t3", "important"), ("t4", "work"), ("t5", "unused")], "id string, name string"),
        spark.createDataFrame([("b1", "t1", "ai"), ("b2", "t2", "ai"), ("b4", "t3", "human"), ("b5", "t4", "human"), ("b6", "t3", "ai")], "bookmarkId string, tagId string, attachedBy string"),
        spark.createDataFrame([("l1", "list1", "manual", None), ("l2", "list2", "manual", None), ("l3", "favorites", "manual", None), ("l4", "work", "manual", None), ("l5", "empty", "manual", None), ("s1", "smart", "smart", "is:fav"), ("s2", "loop", "smart", "list:loop or #tag1"), ("s3", "texty", "smart", "words only"), ("s4", "broken", "smart", "is:fav and")], "id string, name string, type string, query string"),
        spark.createDataFrame([("b1", "l1"), ("b6", "l1"), ("b2", "l2"), ("b4", "l3"), ("b5", "l4")], "bookmarkId string, listId string"),
        spark.createDataFrame([("f1", "feed1"), ("f2", "feed2")], "id string, name string"),
        spark.createDataFrame([("b1", "f1"), ("b5", "f1"), ("b3", "f2")], "bookmarkId string, rssFeedId string"),
    )


@pytest.mark.parametrize(
    ("query", "plain", "negated"),
    [
        ("#tag1", "1", "23456"), ("list:list1", "16", "2345"), ("list:nothing", "", ""), ("list:empty", "", "123456"), ("is:archived", "236", "145"), ("is:fav", "24", "1356"), ("url:example.com", "146", "2"),
        ("title:example", "1246", "35"), ("after:2024-01-02", "23456", "1"), ("before:2024-01-02", "12", "3456"), ("is:link", "124", "356"), ("is:text", "35", "1246"), ("is:media", "6", "12345"), ("is:tagged", "12456", "3"),
        ("is:inlist", "12456", "3"), ("feed:feed1", "15", "2346"), ("is:broken", "24", "1"), ("source:web", "34", "1256"), ("list:smart", "24", "1356"), ("list:loop", "1", "23456"), ("list:texty", "", "123456"), ("#TAG1", "", "123456"),
    ],
)
def test_matchers(lib, query, plain, negated):
    for text, want in ((query, plain), ("-" + query, negated), ("!" + query, negated)):
        assert sorted(r.id[1:] for r in find(lib, text).collect()) == list(want)


@pytest.mark.parametrize(
    ("query", "want"),
    [("is:archived is:fav", "2"), ("is:archived or is:fav", "2346"), ("list:favorites or #work", "45"), ("(list:favorites or #work) and (is:archived or is:fav)", "4"), ("age:<3d", "456"), ("age:>3d", "123"), ("free text", "123456")],
)
def test_combinations(lib, query, want):
    assert sorted(r.id[1:] for r in find(lib, query, datetime(2024, 1, 7, tzinfo=UTC)).collect()) == list(want)


def test_lists_of_one_name_unite_and_bad_lists_raise(lib, spark):
    two = Library(**(vars(lib) | {"lists": lib.lists.union(spark.createDataFrame([("l6", "list1", "manual", None)], lib.lists.schema)), "in_lists": lib.in_lists.union(spark.createDataFrame([("b2", "l6")], lib.in_lists.schema))}))
    assert sorted(r.id for r in find(two, "list:list1").collect()) == ["b1", "b2", "b6"]
    with pytest.raises(ValueError):
        find(lib, "list:broken")


def test_patterns_and_plan(lib):
    assert sorted(r.id for r in matching(lib, Leaf("title", "ex%page")).collect()) == ["b2", "b4"]
    assert matching(lib, Leaf("title", "back\\slash")).count() == 0
    plan = find(lib, "is:fav #tag1 list:list1")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan


def test_full_text_needs_every_term(spark):
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "the dog"), (3, "cat cat THE"), (4, None)], "id int, text string")
    got = {r.id: r.score for r in full_text(docs, "the cat").collect()}
    assert set(got) == {1, 3} and got[3] > got[1] > 0
    assert full_text(docs.filter(F.lit(False)), "x").count() == 0
