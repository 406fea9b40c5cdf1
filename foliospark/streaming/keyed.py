"""Keyed state over event streams: rate limits, counters, rules. The same functions serve batches, as one ordered pass per key."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stored import Store

OUT = "key string, at double, allowed boolean, left long"


def fixed_window(hits: Iterator[float], state: tuple[float, int], limit: int, window: float):
    """A window opens with a key's first hit and closes when a hit comes later than its end. Yields (allowed, left) and the state."""
    reset, used = state
    for at in hits:
        if at > reset:
            reset, used = at + window, 0
        used += used < limit + 1
        ok = used <= limit
        used = min(used, limit)
        yield ok, limit - used, (reset, used)


def sliding_log(hits: Iterator[float], log: list[float], limit: int, window: float):
    """Hits of the last `window` seconds count; refused hits aren't recorded."""
    for at in hits:
        log = [t for t in log if t > at - window]
        ok = len(log) < limit
        log = [*log, at] if ok else log
        yield ok, limit - len(log), log


def limited(stream: DataFrame, limit: int, window: float, sliding: bool = False) -> DataFrame:
    """Decisions on a stream of (key, at seconds): key, at, allowed, left. State is one small record a key; hits are ordered within a batch."""

    def run(key, batches, state: GroupState):
        hits = sorted(t for b in batches for t in b["at"])
        kept = json.loads(state.get[0]) if state.exists else ([] if sliding else [-1e18, 0])
        rows = []
        if sliding:
            for ok, left, kept in sliding_log(hits, kept, limit, window):  # noqa: B020
                rows.append((ok, left))
        else:
            for ok, left, kept in fixed_window(hits, tuple(kept), limit, window):  # noqa: B020
                rows.append((ok, left))
        state.update((json.dumps(list(kept)),))
        yield pd.DataFrame({"key": key[0], "at": hits, "allowed": [r[0] for r in rows], "left": [r[1] for r in rows]})

    return stream.groupBy("key").applyInPandasWithState(run, OUT, "state string", "append", GroupStateTimeout.NoTimeout)


def limited_batch(events: DataFrame, limit: int, window: float, sliding: bool = False) -> DataFrame:
    """The same decisions on a table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hits = sorted(pdf["at"])
        made = sliding_log(hits, [], limit, window) if sliding else fixed_window(hits, (-1e18, 0), limit, window)
        rows = [(ok, left) for ok, left, _ in made]
        return pd.DataFrame({"key": pdf["key"].iloc[0], "at": hits, "allowed": [r[0] for r in rows], "left": [r[1] for r in rows]})

    return events.select("key", "at").groupBy("key").applyInPandas(run, OUT)


def failure_runs(events: DataFrame, limit: int = 5) -> DataFrame:
    """For (key, at, failed): failures in a row after each event, and whether the key is switched off by then. Of equal times successes come first.

    Two window sums in one sort per key: the successes so far number the runs, the failures so far in a run count it.
    """
    so_far = lambda *by: Window.partitionBy(*by).orderBy("at", "failed").rowsBetween(Window.unboundedPreceding, 0)
    numbered = events.select("key", "at", "failed", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(so_far("key")).alias("__run"))
    counted = numbered.withColumn("run", F.sum(F.col("failed").cast("long")).over(so_far("key", "__run")))
    return counted.select("key", F.col("at").cast("double").alias("at"), "run", F.max(F.col("run") >= limit).over(so_far("key")).alias("off"))


#: Operations in a chunk of a table, about.
CHUNK = 200_000


def following(at: np.ndarray, count: int, seconds: float) -> np.ndarray:
    """For each operation, in order, where the batch that it opens has its end: the place of the next one's first. Without an end within `at`: len(at) or more."""
    n, known = len(at), int(len(at) - np.isnan(at).sum())  # operations without a time come last and close no batch by it
    own = np.arange(n)
    late = np.maximum(np.searchsorted(at[:known], at + seconds), own + 1)
    return np.minimum(own + count, np.where(late < known, late, n + count))


def batches(ops: DataFrame, count: int, seconds: float, chunk: int | None = None) -> DataFrame:
    """Adds `batch` to operations (buffer, seq, at seconds): a batch is closed by its count-th operation, or when one comes `seconds` after its first.

    Equal to a buffer that is flushed by size or by a timer. A stream does the same with a trigger of `seconds` and a
    limit on the rows of a trigger; this form is for tables and for one micro-batch, whose operations share one buffer.

    A buffer is cut into chunks by time. A batch that is open at a chunk's begin ends within its first `count` operations,
    so a chunk tells for each of these how it would be left if a batch began there; a pass over these short records, one
    for each chunk, finds what is open at each begin, and every chunk numbers its own.
    chunk: about so many operations are in a task's memory, and 10 * count at least.
    """
    store = Store(ops.sparkSession, "batches")
    rows = ops.select(F.col("buffer").cast("string").alias("buffer"), "seq", F.col("at").cast("double").alias("at"))
    parts = max(1, -(-rows.count() // max(chunk or CHUNK, 10 * count)))
    rows = store.table(rows.repartitionByRange(parts, "buffer", F.asc_nulls_last("at"), "seq").withColumn("chunk", F.spark_partition_id()))
    by = ["buffer", "chunk"]

    def times(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
        table = table.sort_by([("at", "ascending"), ("seq", "ascending")])
        return table, pc.fill_null(table["at"], float("nan")).to_numpy()

    def tell(table: pa.Table) -> pa.Table:
        _, at = times(table)
        n = len(at)
        after = following(at, count, seconds)
        to, made = np.where(after < n, after, np.arange(n)), (after < n).astype(np.int64)
        while (to[to] != to).any():  # twice as far each time
            made, to = made + made[to], to[to]
        few = min(count, n)
        own = [pa.array([x], t) for x, t in ((n, pa.int64()), (at[:few].tolist(), pa.list_(pa.float64())), (at[to[:few]].tolist(), pa.list_(pa.float64())), ((n - to[:few]).tolist(), pa.list_(pa.int64())), (made[:few].tolist(), pa.list_(pa.int64())))]
        return pa.table([table["buffer"].slice(0, 1), table["chunk"].slice(0, 1), *own], names=["buffer", "chunk", "n", "head", "first", "held", "made"])

    def open_at(table: pa.Table) -> pa.Table:
        """The batch that is open before each chunk, -1 if none, and how many operations the chunk adds to it."""
        table = table.sort_by("chunk")
        batch, held, first, begins = 0, 0, math.nan, []
        for n, head, firsts, helds, made in zip(*(table[c].to_pylist() for c in ("n", "head", "first", "held", "made")), strict=True):
            late = next((k for k, x in enumerate(head) if x >= first + seconds), count)
            own = min(count - held, late) if held else 0
            begins.append((own, batch if held else -1))
            if own >= n:
                held += n
                continue
            batch += (held > 0) + made[own]
            first, held = firsts[own], helds[own]
        return pa.table([table["buffer"], table["chunk"], *(pa.array(list(x), pa.int64()) for x in zip(*begins, strict=True))], names=["buffer", "chunk", "own", "batch"])

    def number(left: pa.Table, right: pa.Table) -> pa.Table:
        left, at = times(left)
        own, batch = right["own"][0].as_py(), right["batch"][0].as_py()
        after = following(at, count, seconds).tolist()
        starts = np.zeros(len(at), np.int64)
        k = own
        while k < len(at):
            starts[k] = 1
            k = after[k]
        return left.select(["buffer", "seq", "at"]).append_column("batch", pa.array(batch + np.cumsum(starts)))

    told = rows.groupBy(by).applyInArrow(tell, "buffer string, chunk int, n long, head array<double>, first array<double>, held array<long>, made array<long>")
    begins = told.groupBy("buffer").applyInArrow(open_at, "buffer string, chunk int, own long, batch long")
    return rows.groupBy(by).cogroup(begins.groupBy(by)).applyInArrow(number, "buffer string, seq long, at double, batch long")


def flush_order(ops: DataFrame) -> DataFrame:
    """What a flush of (buffer, batch, seq, id, op) does, in `turn`: the last operation of each document, deletions before additions."""
    own = Window.partitionBy("buffer", "batch", "id").orderBy(F.desc("seq"))
    last = ops.withColumn("__n", F.row_number().over(own)).filter("__n = 1").drop("__n")
    turn = Window.partitionBy("buffer", "batch").orderBy(F.when(F.col("op") == "delete", 0).otherwise(1), "seq")
    return last.withColumn("turn", F.row_number().over(turn))


def polls(feeds: DataFrame, now: Column, period: int = 60) -> DataFrame:
    """Jobs of an hourly poll: each feed (id, userId) in its own minute; one that has passed is meant for the next hour. key: the same within an hour."""
    from ..functions.text import jitter_minutes

    minute = jitter_minutes(F.col("id").cast("string"), period)
    hour = F.date_trunc("hour", now)
    wait = F.pmod(minute - F.minute(now), F.lit(period))
    return feeds.select("id", "userId", F.concat_ws("-", F.col("id").cast("string"), F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("key"), minute.alias("minute"), wait.alias("wait"))


# --- rules


def condition(rule: dict) -> Column:
    """A rule's condition as a column over bookmarks (id, type, url, title, source, favourited, tags array, feeds array).

    Text is compared as written; a URL condition and its opposite hold for links only.
    """
    kind = rule["type"]
    if kind in ("and", "or"):
        parts = [condition(c) for c in rule["conditions"]]
        return reduce(Column.__and__ if kind == "and" else Column.__or__, parts, F.lit(kind == "and")) if parts else F.lit(kind == "and")
    no = F.lit(False)
    has = lambda c, x: F.coalesce(F.array_contains(F.col(c), x), no)
    text = lambda c: F.coalesce(F.contains(F.col(c), F.lit(rule.get("str", ""))), no)
    link = F.col("type") == "link"
    return {
        "alwaysTrue": lambda: F.lit(True),
        "urlContains": lambda: link & text("url"),
        "urlDoesNotContain": lambda: link & F.col("url").isNotNull() & ~text("url"),
        "titleContains": lambda: text("title"),
        "titleDoesNotContain": lambda: F.col("title").isNotNull() & ~text("title"),
        "importedFromFeed": lambda: has("feeds", rule["feedId"]),
        "bookmarkTypeIs": lambda: F.col("type") == rule["bookmarkType"],
        "bookmarkSourceIs": lambda: F.coalesce(F.col("source") == rule["source"], no),
        "hasTag": lambda: has("tags", rule["tagId"]),
        "isFavourited": lambda: F.coalesce(F.col("favourited"), no),
        "isArchived": lambda: F.coalesce(F.col("archived"), no),
    }[kind]()


def event_matches(rule_event: dict) -> Column:
    """Whether an event row (type, targets map) is the rule's: the same kind, and the list, tag or feed that it names among the event's."""
    out = F.col("event.type") == rule_event["type"]
    for k, v in rule_event.items():
        if k != "type":
            many = v if isinstance(v, list) else [v]
            out = out & F.coalesce(F.element_at(F.col("event.targets"), F.lit(k)).isin(many), F.lit(False)) if many else out
    return out


def actions(events: DataFrame, rules: list[dict]) -> DataFrame:
    """Rows (ruleId, bookmarkId, action, target) of every enabled rule that an event sets off.

    events: (event struct<type, targets map>, id and the bookmark's columns), a stream or a table. Rules are compiled to
    columns, so all of them run in one pass.
    """
    made = []
    for r in rules:
        if r.get("enabled", True):
            todo = F.array(*[F.struct(F.lit(str(r["id"])).alias("ruleId"), F.lit(a["type"]).alias("action"), F.lit(str(a.get("target") or "")).alias("target")) for a in r["actions"]])
            made.append(F.when(event_matches(r["event"]) & condition(r["condition"]), todo).otherwise(F.array().cast("array<struct<ruleId:string,action:string,target:string>>")))
    if not made:
        made = [F.array().cast("array<struct<ruleId:string,action:string,target:string>>")]
    return events.select(F.col("id").alias("bookmarkId"), F.explode(F.flatten(F.array(*made))).alias("a")).select("a.ruleId", "bookmarkId", "a.action", "a.target")
