"""What leaves the library: backups, list definitions, feeds, archives of tables, and the vector store's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import escape_html
from ..functions.urls import allowed
from .imports import native_records


def list_records(lists: DataFrame) -> DataFrame:
    """List definitions of an export: id, name, description, icon, type, query, parentId; what a list doesn't have is null."""
    have = {c: F.col(c).cast("string") for c in lists.columns}
    return lists.select(*[have.get(c, F.lit(None).cast("string")).alias(c) for c in ("id", "name", "description", "icon", "type", "query", "parentId")])


def backup(bookmarks: DataFrame, lists: DataFrame, in_lists: DataFrame) -> DataFrame:
    """Export records of all bookmarks that have content, with their memberships of manual lists.

    Memberships are grouped before the one join, so a bookmark is one row whatever the number of its lists.
    """
    manual = in_lists.join(lists.filter("type = 'manual'").select(F.col("id").alias("listId")), "listId", "left_semi")
    held = manual.groupBy(F.col("bookmarkId").alias("id")).agg(F.sort_array(F.collect_set(F.col("listId").cast("string"))).alias("lists"))
    rows = bookmarks.join(held, "id", "left").withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
    return native_records(rows).filter("content IS NOT NULL")


def write_backup(records: DataFrame, lists: DataFrame, path: str) -> None:
    """Lines of JSON, compressed, in as many files as there are partitions: `bookmarks` and `lists` under the path."""
    records.write.option("compression", "gzip").mode("overwrite").json(f"{path}/bookmarks")
    list_records(lists).write.option("compression", "gzip").mode("overwrite").json(f"{path}/lists")


def feed_entries(docs: DataFrame, asset_base: str) -> DataFrame:
    """What a list's feed shows of (id, type, url, assetId, title, createdAt, author, tags, description): links with an http(s) URL, and assets under the server's address."""
    kept = docs.filter(((F.col("type") == "link") & allowed(F.col("url"))) | (F.col("type") == "asset"))
    url = F.when(F.col("type") == "link", F.col("url")).otherwise(F.concat(F.lit(asset_base), F.col("assetId")))
    return kept.select(
        F.coalesce("title", F.lit("")).alias("title"), url.alias("link"), F.col("id").cast("string").alias("guid"), F.date_format("createdAt", "EEE, dd MMM yyyy HH:mm:ss 'GMT'").alias("pubDate"), F.col("createdAt").cast("timestamp").alias("at"),
        F.when(F.col("type") == "link", F.col("author")).alias("author"), F.coalesce("tags", F.array().cast("array<string>")).alias("categories"), F.coalesce("description", F.lit("")).alias("description"),
    )


def feed_document(entries: DataFrame, title: str, site: str, feed: str) -> DataFrame:
    """The lines of an RSS 2.0 file (place, at, value): the head, one for each entry, the end; in the file the newest entry comes first."""
    part = lambda name, c: F.coalesce(F.concat(F.lit(f"<{name}>"), escape_html(c), F.lit(f"</{name}>")), F.lit(""))
    groups = F.array_join(F.transform("categories", lambda x: F.concat(F.lit("<category>"), escape_html(x), F.lit("</category>"))), "")
    guid = F.concat(F.lit('<guid isPermaLink="false">'), escape_html(F.col("guid")), F.lit("</guid>"))
    item = F.concat(F.lit("<item>"), *[part(n, F.col(n)) for n in ("title", "link")], guid, part("pubDate", F.col("pubDate")), part("author", F.col("author")), groups, part("description", F.col("description")), F.lit("</item>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel>'), part("title", F.lit(title)), part("link", F.lit(site)), part("description", F.lit(feed)))
    edges = entries.sparkSession.range(2).select((2 * F.col("id") - 1).alias("place"), F.lit(None).cast("timestamp").alias("at"), F.when(F.col("id") == 0, head).otherwise("</channel></rss>").alias("value"))
    return edges.unionByName(entries.select(F.lit(0).cast("long").alias("place"), "at", item.alias("value")))


def write_feed(document: DataFrame, path: str) -> None:
    """One text file; a feed shows one list."""
    document.orderBy("place", F.desc_nulls_last("at"), "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def dump(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """An archive of a server's tables as a folder of Parquet; returns (table, rows) as read back."""
    out = None
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        n = df.sparkSession.read.parquet(f"{path}/{name}").agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"))
        out = n if out is None else out.unionByName(n)
    return out


def migrated(tables: dict[str, DataFrame], maps: dict[str, DataFrame], foreign: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """Tables for another server: own ids and foreign keys by id maps (old, new).

    foreign: for each table its columns and the map that each follows. Rows whose own key or target wasn't moved are left out.
    """
    out = {}
    for name, df in tables.items():
        columns = df.columns
        for column, kind in foreign.get(name, {}).items():
            m = maps[kind].select(F.col("old").alias("__old"), F.col("new").alias("__new"))
            df = df.join(m, df[column] == F.col("__old")).withColumn(column, F.col("__new")).drop("__old", "__new")
        out[name] = df.select(columns)
    return out


# --- vector store and stored files


def vector_changes(store: DataFrame, added: DataFrame | None = None, deleted: DataFrame | None = None, cleared: Column | None = None) -> DataFrame:
    """The vector store (id, userId, vector) after a clearing (a condition), deletions (id) and additions; of equal ids the added one stays."""
    out = store if cleared is None else store.filter(~F.coalesce(cleared, F.lit(False)))
    if deleted is not None:
        out = out.join(deleted.select("id"), "id", "left_anti")
    if added is not None:
        new = added.dropDuplicates(["id"]).select(store.columns)
        out = out.join(new.select("id"), "id", "left_anti").select(store.columns).unionByName(new)
    return out.select(store.columns)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """path, key (the last folder of the path: user and asset id come before the file), size and modificationTime of every stored file; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.col("length").alias("size"), "modificationTime")
    return files.withColumn("key", F.element_at(F.split("path", "/"), -2))
