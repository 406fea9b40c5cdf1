"""Changes to tables as rewrites: a new table from the old one and the change, without updates in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_tags(tags: DataFrame, tags_on: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tags without the sources of mapping (source, target), and uses that point to the targets, each once; use by people wins."""
    moved = tags_on.join(mapping, tags_on["tagId"] == mapping["source"], "left").withColumn("tagId", F.coalesce("target", "tagId"))
    uses = moved.groupBy("bookmarkId", "tagId").agg(F.max("attachedBy").alias("attachedBy"))  # human sorts after ai
    return tags.join(mapping, tags["id"] == mapping["source"], "left_anti"), uses


def retag(tags_on: DataFrame, found: DataFrame, tags: DataFrame, key) -> DataFrame:
    """Uses after a machine tagging (bookmarkId, name): names match tags by key; its old uses on those bookmarks go, people's stay."""
    known = tags.select(key(F.col("name")).alias("k"), "id").groupBy("k").agg(F.min("id").alias("tagId"))
    new = found.select("bookmarkId", key(F.col("name")).alias("k")).join(known, "k").select("bookmarkId", "tagId", F.lit("ai").alias("attachedBy")).distinct()
    done = found.select("bookmarkId").distinct()
    stay = tags_on.join(done.withColumn("ours", F.lit(True)), "bookmarkId", "left").filter("attachedBy <> 'ai' OR ours IS NULL").drop("ours")
    return stay.unionByName(new.join(stay, ["bookmarkId", "tagId"], "left_anti")).select("bookmarkId", "tagId", "attachedBy")


def missing_tags(found: DataFrame, tags: DataFrame, key) -> DataFrame:
    """Tags to create for a machine tagging (bookmarkId, name): names that match no tag by key, one for each key."""
    new = found.select(key(F.col("name")).alias("k"), "name").filter("k <> ''").groupBy("k").agg(F.min("name").alias("name"))
    return new.join(tags.select(key(F.col("name")).alias("k")), "k", "left_anti").select("name", "k")


def missing_seeds(seeds: DataFrame, existing: DataFrame) -> DataFrame:
    """Seeds whose name is new; none at all for a user without sources."""
    return seeds.join(existing.select("name"), "name", "left_anti").join(existing.agg(F.count(F.lit(1)).alias("have")).filter("have > 0"), F.lit(True), "left_semi")


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: str) -> DataFrame:
    """The table after changes: the latest row of each key."""
    both = table.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn", "__new")


def insert_new(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key isn't in the table yet, each key once."""
    return rows.dropDuplicates(key).join(table.select(*key), key, "left_anti")


def purge_cache(cache: DataFrame, cutoff: Column) -> DataFrame:
    """What stays: used, or if never used made, at the cutoff or later."""
    return cache.filter(F.coalesce("lastUsedAt", "createdAt") >= cutoff)


def stale_to_pending(items: DataFrame, now: Column, hours: int = 1) -> DataFrame:
    """Items that have been in work for longer than `hours` are pending again."""
    stuck = (F.col("status") == "processing") & (F.col("startedAt") < now - F.expr(f"INTERVAL {hours} HOURS"))
    return items.withColumn("status", F.when(stuck, "pending").otherwise(F.col("status")))


def archive_sessions(sessions: DataFrame, items: DataFrame, now: Column, days: int = 30) -> DataFrame:
    """Finished sessions of that age with their counts by status, frozen."""
    counts = items.groupBy("sessionId").pivot("status", ["pending", "processing", "completed", "failed"]).count().na.fill(0)
    old = sessions.filter(F.col("finishedAt").isNotNull() & (F.col("finishedAt") <= now - F.expr(f"INTERVAL {days} DAYS")))
    return old.join(counts, old["id"] == counts["sessionId"], "left").drop("sessionId").na.fill(0, ["pending", "processing", "completed", "failed"])


def claim(items: DataFrame, sessions: DataFrame, batch: int = 10, in_flight: int = 50) -> DataFrame:
    """The next items to work on: sessions that waited longest first, no more than may be in flight."""
    busy = items.filter("status = 'processing'").agg(F.count(F.lit(1)).alias("busy"))
    wait = items.filter("status = 'pending'").join(sessions.select(F.col("id").alias("sessionId"), "lastProcessedAt"), "sessionId")
    w = Window.orderBy(F.asc_nulls_first("lastProcessedAt"), "createdAt", "id")
    first = wait.orderBy(F.asc_nulls_first("lastProcessedAt"), "createdAt", "id").limit(batch)  # a batch is a few rows
    return first.withColumn("n", F.row_number().over(w)).join(busy, F.col("n") + F.col("busy") <= in_flight).drop("n", "busy")


def keep_with_feedback(old: DataFrame, new: DataFrame, feedback: DataFrame) -> DataFrame:
    """A briefing that is made again: old impressions with feedback stay, the rest is the new run's."""
    stay = old.join(feedback.select("impressionId"), "impressionId", "left_semi")
    return stay.unionByName(new.join(stay.select("candidateId"), "candidateId", "left_anti"))


def remap(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """Foreign keys by an id map (old, new): for a move to another server."""
    for c in columns:
        m = ids.select(F.col("old").alias("__old"), F.col("new").alias("__new"))
        df = df.join(m, df[c] == F.col("__old"), "left").withColumn(c, F.coalesce("__new", c)).drop("__old", "__new")
    return df


def dangling(files: DataFrame, assets: DataFrame) -> DataFrame:
    """Stored files that no asset names."""
    return files.join(assets, files["key"] == assets["id"], "left_anti")


def neighbour_tags(vectors: DataFrame, target: list[float], self_id, tags_on: DataFrame, tags: DataFrame, least: float = 0.75, near: int = 10, most: int = 100, budget: int = 1000) -> DataFrame:
    """Names of the tags of the nearest bookmarks, shortest first, as many as fit the budget with their separators."""
    from ..functions.vectors import nearest

    close = nearest(vectors, target, near + 1).filter((F.col("score") >= least) & (F.col("id") != F.lit(self_id))).limit(near)
    names = tags_on.join(close.select(F.col("id").alias("bookmarkId")), "bookmarkId", "left_semi").join(tags.select(F.col("id").alias("tagId"), "name"), "tagId").select("name").distinct().orderBy("name").limit(most)
    w = Window.orderBy(F.length("name"), "name")  # at most `most` rows
    used = F.sum(F.length("name")).over(w) + 2 * (F.row_number().over(w) > 1).cast("int")
    return names.withColumn("used", used).filter(F.col("used") <= budget).select("name")


def metrics(frames: dict[str, DataFrame]) -> DataFrame:
    """Gauges as rows (metric, labels, value) of frames with a `value` and label columns."""
    out = None
    for name, df in frames.items():
        labels = [x for c in df.columns if c != "value" for x in (F.lit(c), F.col(c).cast("string"))]
        rows = df.select(F.lit(name).alias("metric"), (F.create_map(*labels) if labels else F.create_map().cast("map<string,string>")).alias("labels"), F.col("value").cast("double").alias("value"))
        out = rows if out is None else out.unionByName(rows)
    return out


def profiles(samples: DataFrame, now: Column, half_life: float = 7.0, floor: float = 0.01) -> DataFrame:
    """Profile vectors of (userId, positive, vector, occurredAt): stable, recent (decayed) and negative, at unit length. A `weight` of the samples counts in all."""
    from ..functions.vectors import centroids, normalised
    from .recommend import decay, hours_between

    own = F.col("weight") if "weight" in samples.columns else F.lit(1.0)
    kinds = {
        "stable": (samples.filter("positive"), own),
        "recent": (samples.filter("positive").withColumn("w", decay(hours_between(F.col("occurredAt"), now) / 24, half_life)).filter(F.col("w") >= floor), F.col("w") * own),
        "negative": (samples.filter("NOT positive"), own),
    }
    out = samples.select("userId").distinct()
    for name, (df, w) in kinds.items():
        out = out.join(centroids(df, "userId", "vector", w).select("userId", normalised(F.col("centroid")).alias(name)), "userId", "left")
    return out
