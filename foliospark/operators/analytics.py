"""Counts, histograms, top lists and pages over the library's tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stored import Store

#: Rows of a page if none are asked for, and at most.
PAGE, MOST_PAGE = 20, 100


def top(df: DataFrame, key: Column | str, n: int, name: str = "key") -> DataFrame:
    """The n most frequent values, ties by value: partial counts, then a bounded top-k."""
    key = F.col(key) if isinstance(key, str) else key
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), name).limit(n)


def dense_histogram(df: DataFrame, bin_: Column, low: int, high: int) -> DataFrame:
    """Rows of every whole number from low to high, with zero where nothing falls."""
    counts = df.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = df.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("bin"))
    return bins.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def counts_if(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row of counts, in one pass."""
    return df.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def keyset_page(df: DataFrame, when: str, ident: str, size: int, newest: bool = True, cursor: tuple | None = None) -> DataFrame:
    """size + 1 rows from an inclusive cursor (when, id); the extra row is the next cursor. One total order: when, then id."""
    if cursor is not None:
        t, i = map(F.lit, cursor)
        more = F.col(when) < t if newest else F.col(when) > t
        edge = F.col(ident) <= i if newest else F.col(ident) >= i
        df = df.filter(more | ((F.col(when) == t) & edge))
    order = (F.desc(when), F.desc(ident)) if newest else (F.asc(when), F.asc(ident))
    return df.orderBy(*order).limit(size + 1)


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset(page * size).limit(size)


def page_size(asked: int | None) -> int:
    """Rows of a page: PAGE by default; more than MOST_PAGE or less than one isn't allowed."""
    if asked is not None and not 1 <= asked <= MOST_PAGE:
        raise ValueError(f"a page has 1 to {MOST_PAGE} rows")
    return asked or PAGE


def search_page(hits: DataFrame, docs: DataFrame, offset: int = 0, size: int | None = None, sort: str = "relevance") -> DataFrame:
    """One page of search hits (id, score) with their documents (id, createdAt, ...), `total` and `next`.

    The engine's order (score, then id) cuts the page; `sort` (relevance, asc, desc by creation) orders the rows inside
    it, in `place`. next: the offset of the next page, null on the last one. Hits without a document are dropped after
    the cut, as a page is cut from what the index holds.
    """
    n = page_size(size)
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    page = hits.orderBy(F.desc("score"), "id").offset(offset).limit(n)
    reached = page.agg((F.count(F.lit(1)) + offset).alias("reached"))
    order = {"relevance": [F.desc("score"), F.asc("id")], "asc": [F.asc("createdAt"), F.asc("id")], "desc": [F.desc("createdAt"), F.asc("id")]}[sort]
    rows = page.join(docs, "id").withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a page is MOST_PAGE rows at most
    edge = total.crossJoin(reached).select("total", F.when(F.col("reached") < F.col("total"), F.col("reached")).alias("next"))  # one row each
    return rows.crossJoin(F.broadcast(edge))


def first_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in the given order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def tag_list(tags: DataFrame, tags_on: DataFrame) -> DataFrame:
    """Every tag with its uses by people and by machine; unused ones as well."""
    uses = tags_on.groupBy("tagId").agg(F.count_if(F.col("attachedBy") == "ai").alias("ai"), F.count_if(F.col("attachedBy") == "human").alias("human"))
    both = tags.join(uses, tags["id"] == uses["tagId"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select("id", "name", zero("ai").alias("ai"), zero("human").alias("human"), (zero("ai") + zero("human")).alias("total"))


def documents(bookmarks: DataFrame, tags: DataFrame, tags_on: DataFrame, in_lists: DataFrame) -> DataFrame:
    """Nested documents: each child is grouped before its join, so children don't multiply. Tags by people come first."""
    order = lambda: F.struct((F.col("attachedBy") == "ai").alias("machine"), "name", "attachedBy")
    tagged = tags_on.dropDuplicates(["bookmarkId", "tagId"]).join(tags.withColumnRenamed("id", "tagId"), "tagId")
    tagged = tagged.groupBy("bookmarkId").agg(F.sort_array(F.collect_list(order())).alias("tags"))
    listed = in_lists.groupBy("bookmarkId").agg(F.sort_array(F.collect_set("listId")).alias("lists"))
    out = bookmarks.join(tagged.withColumnRenamed("bookmarkId", "id"), "id", "left").join(listed.withColumnRenamed("bookmarkId", "id"), "id", "left")
    names = F.transform(F.coalesce("tags", F.array().cast("array<struct<machine:boolean,name:string,attachedBy:string>>")), lambda t: F.struct(t["name"].alias("name"), t["attachedBy"].alias("attachedBy")))
    return out.withColumn("tags", names).withColumn("lists", F.coalesce("lists", F.array().cast("array<bigint>")))


def intersect_ids(frames: Sequence[DataFrame]) -> DataFrame:
    """Ids that every frame has."""
    out = frames[0].distinct()
    for f in frames[1:]:
        out = out.join(f, f.columns if f.columns == out.columns else "id", "left_semi")
    return out


def union_ids(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out.distinct()


def last_operation(ops: DataFrame, key: str, seq: str) -> DataFrame:
    """The last operation of each document; deletes come before adds."""
    return first_per(ops, [key], [F.desc(seq)])


def latency_histogram(df: DataFrame, value: str, buckets: Sequence[float]) -> DataFrame:
    """Cumulative counts up to each bound, and all: one pass, one row a bound."""
    counts = df.agg(*[F.count_if(F.col(value) <= b).alias(f"b{k}") for k, b in enumerate(buckets)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(f"b{k}").alias("n")) for k, b in enumerate(buckets)] + [F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n"))]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def climbed(nodes: DataFrame, store: Store) -> DataFrame:
    """id, top (the ancestor that was reached) and steps for the nodes (id, parentId); top is null for those under a root.

    Each round doubles the steps, so a tree of depth d takes log2(d) rounds. Every depth above a node's is some node's,
    so when a round brings no further node to a root, none will: what is left is on a cycle, below one, or below a
    parent that doesn't exist.
    """
    now = store.table(nodes.select("id", F.col("parentId").alias("top"), F.when(F.col("parentId").isNull(), 0).otherwise(1).cast("long").alias("steps")))
    under = now.filter("top IS NULL").count()
    while under:
        up = now.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("steps").alias("more"), F.lit(True).alias("there"))
        far = F.col("there").isNotNull()
        now = store.table(now.join(up, "top", "left").select("id", F.when(far, F.col("next")).otherwise(F.col("top")).alias("top"), (F.col("steps") + F.when(far, F.col("more")).otherwise(0)).alias("steps")))
        before, under = under, now.filter("top IS NULL").count()
        if under == before:
            break
    return now


def tree_paths(nodes: DataFrame, lost_to_root: bool = False) -> DataFrame:
    """id, depth, path (names joined by /) of the nodes (id, parentId, name) under roots, at any depth.

    Nodes that no root reaches (cycles, missing parents) are left out, or with lost_to_root each is a root itself.
    """
    store = Store(nodes.sparkSession, "tree")
    found = climbed(nodes, store)
    reached = F.col("top").isNull()
    found = found.select("id", reached.alias("reached"), F.when(reached, F.col("steps")).otherwise(0).alias("steps")) if lost_to_root else found.filter(reached).select("id", F.lit(True).alias("reached"), "steps")
    now = store.table(nodes.join(found, "id").select("id", F.when(F.col("reached"), F.col("parentId")).alias("top"), F.array("name").alias("names"), "steps"))
    most = now.agg(F.max("steps")).first()[0] or 0
    for _ in range(int(most).bit_length()):
        up = now.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("names").alias("before"))
        now = store.table(now.join(up, "top", "left").select("id", F.col("next").alias("top"), F.concat(F.coalesce("before", F.array().cast("array<string>")), "names").alias("names"), "steps"))
    return now.select("id", F.col("steps").cast("int").alias("depth"), F.array_join("names", "/").alias("path"))


def stats(bookmarks: DataFrame, now) -> DataFrame:
    """One pass over a user's bookmarks: all, by state, and by age of 7, 30 and 365 days before `now`."""
    t = F.lit(now)
    since = lambda days: F.col("createdAt") >= t - F.expr(f"INTERVAL {days} DAYS")
    return bookmarks.agg(F.count(F.lit(1)).alias("total"), F.count_if("archived").alias("archived"), F.count_if("favourited").alias("favourited"), F.coalesce(F.sum("size"), F.lit(0.0)).alias("size"), *[F.count_if(since(d)).alias(f"last_{d}") for d in (7, 30, 365)])
