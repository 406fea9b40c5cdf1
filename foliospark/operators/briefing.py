"""The recommender's tables around a briefing: collecting, the library's own evidence, reading a slate, feedback at the end of a window."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .analytics import first_per
from .recommend import PRIOR_MEAN, REWARDS, due, intake, rewards

#: Events that count for and against an article, and weights of samples other than 1.
POSITIVE = ("saved", "liked", "favourited", "highlighted", "read_full")
NEGATIVE = ("dismissed", "read_abandoned")
SAMPLE_WEIGHTS = {"saved": 1.2, "read_abandoned": 0.5}
#: Days after which the reward of an impression is final, and rows of an unread briefing that come again.
REWARD_DAYS, AGAIN = 7, 5
DISCOVERED = "discovered"


def slate_read(impressions: DataFrame, candidates: DataFrame, domains: DataFrame, clusters: DataFrame, events: DataFrame) -> DataFrame:
    """The rows that a briefing shows, by rank: impression, candidate, name of its domain and label of its cluster, and its events.

    impressions: id, briefingId, candidateId, domainId, rank, arm, score, shown. candidates: id, url, title, clusterId.
    domains: id, domain. clusters: id, label. events: impressionId, type. Domain and cluster can be missing.
    """
    kinds = events.groupBy("impressionId").agg(F.sort_array(F.collect_set("type")).alias("events"))
    rows = impressions.filter("shown").withColumnRenamed("id", "impressionId").join(candidates.withColumnRenamed("id", "candidateId"), "candidateId")
    rows = rows.join(domains.withColumnRenamed("id", "domainId"), "domainId", "left").join(clusters.select(F.col("id").alias("clusterId"), F.col("label").alias("clusterLabel")), "clusterId", "left")
    rows = rows.join(kinds, "impressionId", "left").withColumn("events", F.coalesce("events", F.array().cast("array<string>")))
    return rows.select("briefingId", "rank", "impressionId", "candidateId", "arm", "score", "url", "title", "domain", "clusterLabel", "events")


def profile_samples(events: DataFrame, impressions: DataFrame, candidates: DataFrame, since: Column, weights: dict[str, float] = SAMPLE_WEIGHTS) -> DataFrame:
    """(userId, positive, vector, occurredAt, weight) of a window's feedback, the input of the profiles: events of a sign on candidates that have a vector."""
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])
    sign = F.when(F.col("type").isin(*POSITIVE), True).when(F.col("type").isin(*NEGATIVE), False)
    seen = events.filter(F.col("occurredAt") >= since).withColumn("positive", sign).filter("positive IS NOT NULL")
    rows = seen.join(impressions.select(F.col("id").alias("impressionId"), "candidateId"), "impressionId").join(candidates.select(F.col("id").alias("candidateId"), F.col("embedding").alias("vector")).filter("vector IS NOT NULL"), "candidateId")
    return rows.select("userId", "positive", "vector", "occurredAt", F.coalesce(F.try_element_at(table, F.col("type")), F.lit(1.0)).alias("weight"))


@F.pandas_udf(T.StringType())
def profile_hash(stable: pd.Series, recent: pd.Series, negative: pd.Series) -> pd.Series:
    """Sixteen hexadecimal digits of three profile vectors to four decimals; a missing vector has its own mark."""

    def one(vectors) -> str:
        h = hashlib.sha256()
        for v in vectors:
            h.update(b"null" if v is None else (np.floor(np.asarray(v, float) * 1e4 + 0.5) / 1e4).astype("<f4").tobytes())
        return h.hexdigest()[:16]

    return pd.Series([one(x) for x in zip(stable, recent, negative, strict=True)])


def again(briefings: DataFrame, impressions: DataFrame, candidates: DataFrame, yesterday: Column, until: Column, most: int = AGAIN) -> DataFrame:
    """Candidates that are shown once more: the best ranks of yesterday's briefing that nobody opened, unless they were saved. Adds their new expiresAt.

    briefings: id, userId, day, state. impressions: briefingId, candidateId, rank, shown. candidates: id, userId, bookmarkId.
    """
    missed = first_per(briefings.filter((F.col("day") == yesterday) & (F.col("state") == "unobserved")), ["userId"], [F.asc("id")]).select(F.col("id").alias("briefingId"), "userId")
    place = F.row_number().over(Window.partitionBy("briefingId").orderBy("rank", "candidateId"))
    best = impressions.filter("shown").withColumn("__n", place).filter(F.col("__n") <= most)
    rows = missed.join(best, "briefingId").join(candidates.filter("bookmarkId IS NULL").select(F.col("id").alias("candidateId"), "userId"), ["candidateId", "userId"])
    return rows.select("userId", "candidateId", until.alias("expiresAt"))


def abandoned_reads(events: DataFrame, impressions: DataFrame, now: Column, days: int = REWARD_DAYS) -> DataFrame:
    """read_abandoned events (impressionId, type, occurredAt) for windows that close: articles that were opened to be read and never were.

    To be run after the delayed events of the window have been joined. impressions: id, createdAt, final.
    """
    closing = impressions.filter(~F.col("final") & (F.col("createdAt") < now - F.expr(f"INTERVAL {days} DAYS"))).select(F.col("id").alias("impressionId"))
    return rewards(events.join(closing, "impressionId", "left_semi")).filter("abandoned").select("impressionId", F.lit("read_abandoned").alias("type"), now.alias("occurredAt"))


def backfill_votes(bookmarks: DataFrame, domain: Column, excluded: tuple[str, ...] = (), limit: int = 5) -> DataFrame:
    """Votes for the domains of a library (id, positive): one for each bookmark and one more for a positive one; the number of bookmarks, the first ids.

    Domains that are excluded, or below one that is, hold no articles.
    """
    found = bookmarks.select("id", "positive", domain.alias("domain")).filter("domain <> ''")
    for host in excluded:
        found = found.filter((F.col("domain") != host) & ~F.col("domain").endswith("." + host))
    votes = F.sum(F.when(F.col("positive"), 2).otherwise(1))
    return found.groupBy("domain").agg(votes.alias("weight"), F.count(F.lit(1)).alias("articles"), F.slice(F.sort_array(F.collect_list("id")), 1, limit).alias("evidence"))


def bootstrap(bookmarks: DataFrame, highlights: DataFrame, progress: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A library as the recommender's first evidence: candidates, impressions and events, at the time of the bookmark.

    bookmarks: id, userId, url, title, createdAt, favourited. highlights: bookmarkId. progress: bookmarkId, percent.
    known: bookmarkId of candidates that have an impression already; they aren't made again. A bookmark is `saved`; the
    strongest thing its owner did with it (read, else highlighted, else favourited) is a second event and adds to the reward.
    """
    lit = highlights.select(F.col("bookmarkId").alias("id")).distinct().withColumn("lit", F.lit(True))
    read = progress.filter("percent >= 60").select(F.col("bookmarkId").alias("id")).distinct().withColumn("done", F.lit(True))
    rows = bookmarks.filter("url IS NOT NULL").join(known.select(F.col("bookmarkId").alias("id")), "id", "left_anti").join(lit, "id", "left").join(read, "id", "left")
    strong = F.when(F.col("done"), "read_full").when(F.col("lit"), "highlighted").when(F.col("favourited"), "favourited")
    extra = F.create_map(*[x for k in ("read_full", "highlighted", "favourited") for x in (F.lit(k), F.lit(REWARDS[k]))])
    rows = rows.withColumn("strong", strong).withColumn("key", F.sha2(F.concat_ws(":", F.lit("bootstrap"), "userId", "id"), 256))
    candidates = rows.select("key", "userId", F.col("id").alias("bookmarkId"), "url", "title", F.lit("promoted").alias("status"), F.lit("bootstrap").alias("origin"), "createdAt")
    reward = F.lit(REWARDS["saved"]) + F.coalesce(F.try_element_at(extra, F.col("strong")), F.lit(0.0))
    impressions = rows.select("key", "userId", F.col("key").alias("candidateKey"), F.lit("bootstrap").alias("source"), F.lit(False).alias("shown"), F.lit(False).alias("examined"), F.lit(True).alias("final"), reward.alias("reward"), "createdAt")
    kinds = F.array_compact(F.array(F.lit("saved"), F.col("strong")))
    events = rows.select(F.col("key").alias("impressionKey"), "userId", F.explode(kinds).alias("type"), F.col("createdAt").alias("occurredAt"))
    return candidates, impressions, events


def collect(sources: DataFrame, items: DataFrame, known: DataFrame, now: Column, cap: int) -> tuple[DataFrame, DataFrame]:
    """A day's intake: (new candidates, domains to register) from what the sources gave.

    sources: userId, id, tier (null: always due), lastFetchedAt, mean (null: the prior's), independent, enabled.
    items: sourceId, url (canonical), urlHash, titleHash, title, published, domain. known: userId, urlHash, titleHash.
    Sources that are due share the cap by their domains' means; each gives its newest items up to its quota; what the
    user has already, by URL or title, is left out after the quota, and so is a second item of one URL.
    """
    ready = sources.filter(F.col("enabled") & (F.col("tier").isNull() | due(F.coalesce("tier", F.lit("daily")), F.col("lastFetchedAt"), now)))
    pending = items.join(ready.select("userId", F.col("id").alias("sourceId")), "sourceId").filter("url IS NOT NULL")
    have = pending.groupBy("userId", F.col("sourceId").alias("id")).agg(F.count(F.lit(1)).alias("available"))
    shares = ready.join(have, ["userId", "id"]).select("userId", "id", F.coalesce("mean", F.lit(PRIOR_MEAN)).alias("weight"), "available", "independent")
    quotas = intake(shares, cap).select("userId", F.col("id").alias("sourceId"), "quota")
    place = F.row_number().over(Window.partitionBy("userId", "sourceId").orderBy(F.desc_nulls_last("published"), "url"))
    chosen = pending.withColumn("place", place).join(quotas, ["userId", "sourceId"]).filter("place <= quota").drop("place", "quota")
    fresh = first_per(chosen, ["userId", "urlHash"], [F.desc_nulls_last("published"), F.asc("sourceId"), F.asc_nulls_last("titleHash")])
    fresh = fresh.join(known.select("userId", "urlHash").distinct(), ["userId", "urlHash"], "left_anti")
    fresh = fresh.join(known.filter("titleHash IS NOT NULL").select("userId", "titleHash").distinct(), ["userId", "titleHash"], "left_anti")
    domains = pending.filter("domain <> ''").select("userId", "domain").distinct().withColumn("status", F.lit(DISCOVERED))
    return fresh.select("userId", "sourceId", "url", "urlHash", "titleHash", "title", "published", "domain"), domains


def intake_reserve(cap: int, floor: float = 0.2) -> int:
    """Places of a day's cap that sources independent of the profile get first."""
    return math.ceil(cap * floor)
