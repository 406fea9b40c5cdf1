"""The library's logical tables as projections of the generic test tables, for Spark and as SQL text for the oracle."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Tables:
    """Lazy frames over one folder of Parquet tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def bookmarks(self) -> DataFrame:
        return self.raw("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("userId"),
            F.col("o_orderdate").alias("createdAt"),
            (F.col("o_orderstatus") == "F").alias("archived"),
            (F.col("o_orderpriority") == "1-URGENT").alias("favourited"),
            F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("source"),
            F.element_at(F.array(F.lit("link"), F.lit("text"), F.lit("asset")), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("type"),
            F.col("o_totalprice").alias("size"),
        )

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("tier"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))

    @cached_property
    def tags(self) -> DataFrame:
        return self.raw("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))

    @cached_property
    def tags_on(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("bookmarkId"), F.col("l_partkey").alias("tagId"), F.when(F.col("l_returnflag") == "A", "ai").otherwise("human").alias("attachedBy"))

    @cached_property
    def user_tags(self) -> DataFrame:
        """The tags that each user has on a bookmark, each once."""
        used = self.tags_on.select("bookmarkId", "tagId").join(self.bookmarks.select(F.col("id").alias("bookmarkId"), "userId"), "bookmarkId")
        return used.select("userId", F.col("tagId").alias("id")).distinct().join(self.tags, "id")

    @cached_property
    def lists(self) -> DataFrame:
        return self.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 10 == 0, "smart").otherwise("manual").alias("type"), F.when(F.col("s_suppkey") % 10 == 0, "is:fav -is:archived").alias("query"))

    @cached_property
    def in_lists(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_orderkey").alias("bookmarkId"), F.col("l_suppkey").alias("listId")).distinct()

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events")

    @cached_property
    def pages(self) -> DataFrame:
        return self.raw("pages")

    @cached_property
    def links(self) -> DataFrame:
        """Every third bookmark is a link; it takes the page of its number, and its crawl result from the price."""
        link = self.bookmarks.filter("type = 'link'")
        pages = self.pages.select("page_id", "url")
        n = pages.agg((F.max("page_id") + 1).alias("n"))
        numbered = link.crossJoin(F.broadcast(n)).select("id", F.pmod("id", "n").alias("page_id"), "size")  # n is one row
        code = (F.floor("size") % 6 * 100 + 1).cast("int")
        return numbered.join(pages, "page_id").select("id", "url", F.regexp_extract("url", r"//[^/]+/(\w+)", 1).alias("title"), F.when(code >= 500, "failure").otherwise("success").alias("crawlStatus"), code.alias("crawlStatusCode"))


    @cached_property
    def assets(self) -> DataFrame:
        """Every third bookmark is a file; the even ones were saved from the page of their number."""
        file = self.bookmarks.filter("type = 'asset'")
        pages = self.pages.select("page_id", F.col("url").alias("sourceUrl"))
        n = pages.agg((F.max("page_id") + 1).alias("n"))
        numbered = file.crossJoin(F.broadcast(n)).select("id", F.when(F.col("id") % 2 == 0, F.pmod("id", "n")).alias("page_id"))  # n is one row
        return numbered.join(pages, "page_id", "left").select("id", "sourceUrl")


#: The same tables in SQL.
SQL = {
    "bookmarks": """SELECT o_orderkey AS id, o_custkey AS userId, o_orderdate AS createdAt, o_orderstatus = 'F' AS archived, o_orderpriority = '1-URGENT' AS favourited,
        CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS source, CASE o_orderkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'text' ELSE 'asset' END AS type, o_totalprice AS size FROM orders""",
    "users": "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS tier, c_acctbal AS balance, c_nationkey AS nation FROM customer",
    "tags": "SELECT p_partkey AS id, p_name AS name FROM part",
    "tags_on": "SELECT l_orderkey AS bookmarkId, l_partkey AS tagId, CASE WHEN l_returnflag = 'A' THEN 'ai' ELSE 'human' END AS attachedBy FROM lineitem",
    "lists": "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 'smart' ELSE 'manual' END AS type FROM supplier",
    "assets": "SELECT o_orderkey AS id, url AS sourceUrl FROM orders LEFT JOIN pages ON o_orderkey % 2 = 0 AND page_id = o_orderkey % (SELECT max(page_id) + 1 FROM pages) WHERE o_orderkey % 3 = 2",
    "in_lists": "SELECT DISTINCT l_orderkey AS bookmarkId, l_suppkey AS listId FROM lineitem",
    "links": """SELECT id, url, regexp_extract(url, '//[^/]+/(\\w+)', 1) AS title, CASE WHEN code >= 500 THEN 'failure' ELSE 'success' END AS crawlStatus, code AS crawlStatusCode FROM (
        SELECT o_orderkey AS id, url, CAST(floor(o_totalprice) AS BIGINT) % 6 * 100 + 1 AS code FROM orders JOIN pages ON page_id = o_orderkey % (SELECT max(page_id) + 1 FROM pages) WHERE o_orderkey % 3 = 0)""",
}


def with_tables(sql: str, *names: str) -> str:
    """The SQL with the named logical tables in front."""
    own = ", " + sql.removeprefix("WITH ") if sql.startswith("WITH ") else " " + sql
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in names) + own
