"""Keyed state: streams in several batches agree with the table, and with plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from foliospark.streaming import keyed


def plain(hits, limit, window, sliding):
    out, log, reset, used = [], [], -1e18, 0
    for t in hits:
        if sliding:
            log = [x for x in log if x > t - window]
            ok = len(log) < limit
            log += [t] * ok
        else:
            if t > reset:
                reset, used = t + window, 0
            ok = used < limit
            used += ok
        out.append(ok)
    return out


@pytest.mark.parametrize("sliding", [False, True])
def test_limits_in_batch_and_stream(spark, tmp_path, sliding):
    rng = random.Random(3)
    rows = sorted((rng.uniform(0, 100), f"k{rng.randrange(3)}") for _ in range(120))
    schema = "key string, at double"
    source = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame([(key, at) for at, key in rows[k * 30 : (k + 1) * 30]], schema).coalesce(1).write.parquet(str(source / f"b{k}"))
    want = {}
    for key in ("k0", "k1", "k2"):
        hits = [at for at, k in rows if k == key]
        want |= {(key, at): ok for at, ok in zip(hits, plain(hits, 4, 10.0, sliding), strict=True)}
    table = spark.read.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
    assert {(r.key, r.at): r.allowed for r in keyed.limited_batch(table, 4, 10.0, sliding).collect()} == want
    got = []
    for k in range(4):  # one micro-batch after the other, state in the checkpoint
        (tmp_path / "feed").mkdir(exist_ok=True)
        for f in (source / f"b{k}").glob("part-*.parquet"):
            f.rename(tmp_path / "feed" / f"{k}-{f.name}")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "feed"))
        q = keyed.limited(stream, 4, 10.0, sliding).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, _: got.extend(df.collect())).trigger(availableNow=True).start()
        q.awaitTermination()
    assert {(r.key, r.at): r.allowed for r in got} == want


def test_failure_runs(spark):
    rows = [("k", float(i), f) for i, f in enumerate([True, True, False, True, True, True, True, True, False])]
    got = [(r.run, r.off) for r in keyed.failure_runs(spark.createDataFrame(rows, "key string, at double, failed boolean")).orderBy("at").collect()]
    assert [r for r, _ in got] == [1, 2, 0, 1, 2, 3, 4, 5, 0] and [o for _, o in got] == [False] * 7 + [True, True]


MARK = "event struct<type:string,targets:map<string,string>>, id string, type string, url string, title string, source string, favourited boolean, archived boolean, tags array<string>, feeds array<string>"


@pytest.mark.parametrize(
    ("condition", "want"),
    [
        ({"type": "alwaysTrue"}, "lt"), ({"type": "urlContains", "str": "example"}, "l"), ({"type": "urlContains", "str": "Example"}, ""), ({"type": "urlDoesNotContain", "str": "nothing"}, "l"), ({"type": "titleContains", "str": "Title"}, "l"),
        ({"type": "titleDoesNotContain", "str": "x"}, "l"), ({"type": "importedFromFeed", "feedId": "f1"}, "l"), ({"type": "bookmarkTypeIs", "bookmarkType": "text"}, "t"), ({"type": "bookmarkSourceIs", "source": "rss"}, "l"), ({"type": "hasTag", "tagId": "t1"}, "l"),
        ({"type": "isFavourited"}, "t"), ({"type": "isArchived"}, ""), ({"type": "and", "conditions": []}, "lt"), ({"type": "or", "conditions": []}, ""), ({"type": "or", "conditions": [{"type": "isFavourited"}, {"type": "hasTag", "tagId": "t1"}]}, "lt"),
    ],
)
def test_rule_conditions(spark, condition, want):
    added = ("bookmarkAdded", {})
    rows = [(added, "l", "link", "https://example.com", "A Title", "rss", False, False, ["t1"], ["f1"]), (added, "t", "text", None, None, None, True, False, [], None)]
    df = spark.createDataFrame(rows, MARK)
    assert "".join(sorted(r.id for r in df.filter(keyed.condition(condition)).collect())) == want


def test_rules_on_events_and_streams(spark, tmp_path):
    rows = [(("tagAdded", {"tagIds": "t1"}), "a", "link", "u", "T", "web", False, False, [], []), (("tagAdded", {"tagIds": "t2"}), "b", "link", "u", "T", "web", False, False, [], []), (("archived", {}), "c", "link", "u", "T", "web", False, True, [], [])]
    rules = [
        {"id": "r1", "event": {"type": "tagAdded", "tagIds": ["t1", "t9"]}, "condition": {"type": "alwaysTrue"}, "actions": [{"type": "addToList", "target": "l1"}, {"type": "favouriteBookmark"}]},
        {"id": "r2", "event": {"type": "archived"}, "condition": {"type": "isArchived"}, "actions": [{"type": "removeTag", "target": "t1"}]},
        {"id": "r3", "enabled": False, "event": {"type": "archived"}, "condition": {"type": "alwaysTrue"}, "actions": [{"type": "x"}]},
    ]
    want = {("r1", "a", "addToList", "l1"), ("r1", "a", "favouriteBookmark", ""), ("r2", "c", "removeTag", "t1")}
    df = spark.createDataFrame(rows, MARK)
    assert {tuple(r) for r in keyed.actions(df, rules).collect()} == want and keyed.actions(df, []).count() == 0
    df.write.parquet(str(tmp_path / "in"))
    got = []
    q = keyed.actions(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), rules).writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda d, _: got.extend(d.select(F.col("ruleId"), "bookmarkId", "action", "target").collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in got} == want


@pytest.mark.parametrize(("count", "seconds", "chunk"), [(5, 40.0, 50), (3, 1e9, 30), (4, 0.0, 40), (20, 7.0, 200)])
def test_batches_over_chunks(spark, count, seconds, chunk):
    """One buffer of many chunks, short ones and times that are missing, against a plain loop."""
    rng = random.Random(count)
    rows = [("one", i, float(rng.randrange(3000))) for i in range(700)] + [("two", i, float(i // 3)) for i in range(9)] + [("three", 1, 5.0), ("three", 2, None), ("three", 0, None)]
    rows += [("four", i, float(i) if i < 100 else None) for i in range(150)]
    want, now = {}, {}
    for b, q, at in sorted(rows, key=lambda r: (r[0], r[2] is None, r[2] or 0, r[1])):
        n, held, first = now.get(b, (0, 0, None))
        if held and (held == count or (at is not None and first is not None and at >= first + seconds)):
            n, held = n + 1, 0
        first = at if not held else first
        now[b] = (n, held + 1, first)
        want[b, q] = (at, n)
    mixed = rng.sample(rows, len(rows))
    got = keyed.batches(spark.createDataFrame(mixed, "buffer string, seq long, at double").repartition(5), count, seconds, chunk).collect()
    assert len(got) == len(rows) and {(r.buffer, r.seq): (r.at, r.batch) for r in got} == want


@pytest.mark.parametrize("cut", [1, 2, 3])
def test_batches_over_chunks_shorter_than_a_batch(spark, monkeypatch, cut):
    """Chunks of a few operations: a batch goes through several of them."""
    rows = [("b", i, float(i + 100 * (i // 17))) for i in range(60)]
    real = type(spark.range(1)).repartitionByRange
    parts = []
    monkeypatch.setattr(type(spark.range(1)), "repartitionByRange", lambda self, n, *by: parts.append(1) or real(self, 60 // cut, *by))
    got = sorted((r.seq, r.batch) for r in keyed.batches(spark.createDataFrame(rows, "buffer string, seq long, at double"), 8, 50.0).collect())
    want, batch, held, first = [], 0, 0, 0.0
    for _, i, at in rows:
        if held and (held == 8 or at >= first + 50):
            batch, held = batch + 1, 0
        first = at if not held else first
        held += 1
        want.append((i, batch))
    assert got == want and parts
