"""Rewrites of tables on small frames."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from foliospark.functions.text import tag_key
from foliospark.operators import maintenance as M

NOW = datetime(2024, 2, 1, tzinfo=UTC)


def bag(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_tags(spark):
    tags = spark.createDataFrame([(1, "ai"), (2, "A-I"), (3, "rust")], "id long, name string")
    on = spark.createDataFrame([(10, 1, "ai"), (10, 2, "human"), (11, 2, "ai"), (12, 3, "ai")], "bookmarkId long, tagId long, attachedBy string")
    left, uses = M.merge_tags(tags, on, spark.createDataFrame([(2, 1)], "source long, target long"))
    assert bag(left) == [(1, "ai"), (3, "rust")] and bag(uses) == [(10, 1, "human"), (11, 1, "ai"), (12, 3, "ai")]
    new = M.retag(on, spark.createDataFrame([(10, "RUST"), (11, "unknown")], "bookmarkId long, name string"), tags, tag_key)
    assert bag(new) == [(10, 2, "human"), (10, 3, "ai"), (12, 3, "ai")]


def test_seeds_upserts_inserts(spark):
    seeds = spark.createDataFrame([("a", 1), ("b", 2)], "name string, x long")
    have = spark.createDataFrame([("a",)], "name string")
    assert bag(M.missing_seeds(seeds, have)) == [("b", 2)] and M.missing_seeds(seeds, have.limit(0)).count() == 0
    t = spark.createDataFrame([(1, "old", 5), (2, "keep", 5)], "k long, v string, at long")
    c = spark.createDataFrame([(1, "new", 5), (2, "late", 3), (3, "add", 1)], "k long, v string, at long")
    assert bag(M.upsert(t, c, ["k"], "at")) == [(1, "new", 5), (2, "keep", 5), (3, "add", 1)]
    assert bag(M.insert_new(t, c.union(c), ["k"])) == [(3, "add", 1)]


def test_states(spark):
    ago = lambda **k: NOW - timedelta(**k)
    cache = spark.createDataFrame([(1, ago(days=9), ago(days=1)), (2, ago(days=9), None), (3, ago(days=1), None)], "id long, createdAt timestamp, lastUsedAt timestamp")
    assert [r[0] for r in bag(M.purge_cache(cache, F.lit(ago(days=5))))] == [1, 3]
    items = spark.createDataFrame([(i, "s1" if i < 4 else "s2", ["pending", "processing", "completed"][i % 3], ago(hours=i), ago(minutes=i)) for i in range(8)], "id long, sessionId string, status string, startedAt timestamp, createdAt timestamp")
    assert [(r[0], r[2]) for r in bag(M.stale_to_pending(items, F.lit(NOW)))] == [(i, "pending" if i % 3 == 0 or (i % 3 == 1 and i > 1) else ["", "processing", "completed"][i % 3]) for i in range(8)]
    sessions = spark.createDataFrame([("s1", ago(days=40), ago(days=1)), ("s2", None, None)], "id string, finishedAt timestamp, lastProcessedAt timestamp")
    done = M.archive_sessions(sessions, items, F.lit(NOW)).collect()
    assert [(r.id, r.pending, r.processing, r.completed, r.failed) for r in done] == [("s1", 2, 1, 1, 0)]
    assert [r.id for r in M.claim(items, sessions, 2).orderBy("id").collect()] == [3, 6] and M.claim(items, sessions, 2, in_flight=4).count() == 1


def test_runs_maps_files_metrics(spark):
    old = spark.createDataFrame([(1, 10), (2, 11)], "impressionId long, candidateId long")
    new = spark.createDataFrame([(3, 10), (4, 12)], "impressionId long, candidateId long")
    assert bag(M.keep_with_feedback(old, new, spark.createDataFrame([(1,)], "impressionId long"))) == [(1, 10), (4, 12)]
    moved = M.remap(spark.createDataFrame([("a", "b"), ("c", None)], "x string, y string"), spark.createDataFrame([("a", "A"), ("b", "B")], "old string, new string"), "x", "y")
    assert bag(moved.select("x", "y")) == [("A", "B"), ("c", None)]
    assert bag(M.dangling(spark.createDataFrame([("f1",), ("f2",)], "key string"), spark.createDataFrame([("f1",)], "id string"))) == [("f2",)]
    got = M.metrics({"users": spark.createDataFrame([(3,)], "value long"), "jobs": spark.createDataFrame([("crawl", 2)], "queue string, value long")}).collect()
    assert {(r.metric, tuple(sorted(r.labels.items())), r.value) for r in got} == {("users", (), 3.0), ("jobs", (("queue", "crawl"),), 2.0)}


def test_neighbours_and_profiles(spark):
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "id long, vector array<double>")
    tags = spark.createDataFrame([(1, "longer name"), (2, "ab"), (3, "abc")], "id long, name string")
    on = spark.createDataFrame([(2, 1), (2, 2), (2, 3), (3, 3)], "bookmarkId long, tagId long")
    assert [r.name for r in M.neighbour_tags(vec, [1.0, 0.0], 1, on, tags, budget=8).orderBy(F.length("name")).collect()] == ["ab", "abc"]
    samples = [(1, True, [1.0, 0.0], NOW), (1, True, [0.0, 1.0], NOW - timedelta(days=7)), (1, False, [0.0, 2.0], NOW), (2, False, [0.0, 1.0], NOW)]
    got = {r.userId: r for r in M.profiles(spark.createDataFrame(samples, "userId long, positive boolean, vector array<double>, occurredAt timestamp"), F.lit(NOW)).collect()}
    assert np.allclose(got[1].stable, [2**-0.5] * 2) and np.allclose(got[1].recent, np.array([1, 0.5]) / np.hypot(1, 0.5)) and got[1].negative == [0.0, 1.0] and got[2].stable is None
