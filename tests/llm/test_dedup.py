from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact_dedup, near_dedup, substring_dedup
from foliospark.llm.bytesets import mix, prefix_hash, span_hash

LOW = {i: i + 32 for i in range(65, 91)}


def bag(df):
    return Counter(tuple(r) for r in df.collect())


# --- op2


def test_exact_against_brute_force(docs, rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[(t or "").translate(LOW)].append(d)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next((t or "").translate(LOW) for d, t, *_ in rows if d == r.doc_id)
        assert (r.keep_id, r.group_size) == (max(groups[text]), len(groups[text]))
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert sum(r.kept for r in got) == len(groups)


def test_exact_survives_digests_that_collide(docs):
    weak = exact_dedup.exact_dedup(docs, digest=lambda t: F.substring(F.unhex(F.sha2(F.encode(t, "UTF-8"), 256)), 1, 1))
    strong = exact_dedup.exact_dedup(docs)
    cols = ["doc_id", "keep_id", "group_size", "text_sha256"]
    assert bag(weak.select(cols)) == bag(strong.select(cols))
    assert weak.filter("kept").count() == strong.filter("kept").count()


def test_exact_in_many_batches(docs):
    cols = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert bag(exact_dedup.exact_dedup(docs, files_per_batch=1).select(cols[:3])) == bag(exact_dedup.exact_dedup(docs).select(cols[:3]))


def test_exact_odd_rows(odd, empty):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(odd).collect()}
    assert got == {(1, 1, 2, True), (None, 1, 2, False), (2, 2, 2, True), (None, 2, 2, False), (3, 3, 1, True)}
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == 3
    assert exact_dedup.kept_rows(empty).count() == 0


# --- op7


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([" ".join(w)] if w else [])


def brute_components(rows, percent=75):
    sets = {d: shingles(t) for d, t, *_ in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sets, {d: find(d) for d in ids}


def test_near_against_brute_force(docs, rows):
    sets, comp = brute_components(rows)
    got = near_dedup.near_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), comp[r.doc_id], r.doc_id == comp[r.doc_id])
    assert len(set(comp.values())) < len(comp) - 30


@pytest.mark.parametrize("cell", [5, 2048])
def test_near_chain_and_large_group(spark, monkeypatch, cell):
    """A chain whose ends don't link, and a group of near copies of one text: components hold whichever leader comes first, in cells of any size."""
    monkeypatch.setattr(near_dedup, "CELL", cell)
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    rows = []
    for k in range(12):  # each replaces four more words at the end
        rows.append((k, " ".join(base[: 100 - 4 * k] + [f"c{k}x{i}" for i in range(4 * k)])))
    for k in range(60):
        v = [f"q{i}" for i in range(120)]
        v[rng.randrange(120)] = f"edit{k}"
        rows.append((100 + k, " ".join(v)))
    _, comp = brute_components(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == comp


def test_near_odd_rows(odd, empty):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(odd).collect()), key=str)
    assert got == sorted([(1, 1, 1, True), (None, 1, None, False), (2, 0, 2, True), (None, 0, None, False), (3, 1, 3, True)], key=str)
    assert near_dedup.near_dedup(empty).count() == 0
    assert near_dedup.one_of_each(odd).columns == odd.columns and near_dedup.one_of_each(odd).count() == 5


def test_components_of_a_path(spark):
    from foliospark.llm.scratch import Scratch

    links = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(40)] + [(b"\xf0", b"\xf1")], "a binary, b binary")
    got = {bytes(r.node): bytes(r.comp) for r in near_dedup.components(links, Scratch(spark, "t"), "c").collect()}
    assert got == {bytes([i]): b"\0" for i in range(41)} | {b"\xf0": b"\xf0", b"\xf1": b"\xf0"}


# --- op1


def brute_cut(rows, length=50):
    seen, out = set(), {}
    for d, t in sorted({(d, t or "") for d, t, *_ in rows}):
        b = t.encode()
        gone = bytearray(len(b))
        own = [b[i : i + length] for i in range(len(b) - length + 1)]
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + length] = b"\1" * length
        seen.update(own)
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out[d] = (len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def test_substring_against_brute_force(docs, rows, monkeypatch):
    monkeypatch.setattr(substring_dedup, "TOGETHER", 500)
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 128 << 10)
    monkeypatch.setattr(substring_dedup, "PIECE", 1000)
    want = brute_cut(rows)
    got = substring_dedup.substring_dedup(docs, with_bytes=True, part_bytes=10_000, task_bytes=10_000).collect()
    got += substring_dedup.substring_dedup(docs, with_bytes=True, part_bytes=10_000, frequent=2).collect()  # every repeated anchor is frequent
    assert len(got) == 2 * len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id]
    assert sum(w[1] for w in want.values()) > 10_000


def test_substring_other_lengths(docs, rows):
    want = brute_cut(rows, 30)
    for r in substring_dedup.substring_dedup(docs, length=30, seed=10).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id][:4]
    with pytest.raises(ValueError):
        substring_dedup.substring_dedup(docs, length=60, seed=20)


def test_substring_odd_rows(spark, odd, empty):
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substring_dedup.substring_dedup(odd).collect())
    assert got == sorted([("1", 22, 0), ("None", 22, 0), ("2", 0, 0), ("None", 0, 0), ("3", 14, 0)])
    assert substring_dedup.substring_dedup(empty).count() == 0
    cut = substring_dedup.cut_rows(odd)
    assert cut.columns == odd.columns and cut.schema.simpleString() == odd.schema.simpleString() and cut.count() == 5
    assert cut.filter("doc_id = 2").first().text is None
    # a repeated row of one doc_id is no reason, a null doc_id is the largest
    text = "some words that are long enough to be fifty bytes and more"
    rows = [(5, text), (5, text), (None, text), (6, "é" + text)]
    got = sorted((str(r.doc_id), r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [("5", 0), ("5", 0), ("6", len(text)), ("None", len(text))]


def test_stage_keeps_characters_whole(spark):
    shared = "ü" * 40
    rows = [(1, "é" + shared, 41), (2, "á" + shared + "z", 42)]  # é and á end in different bytes and begin alike
    got = {r.doc_id: (r.text, r.n_chars) for r in substring_dedup.cut_rows(spark.createDataFrame(rows, "doc_id long, text string, n_chars long")).collect()}
    assert got == {1: ("é" + shared, 41), 2: ("áz", 2)}


def test_suffix_sort_orders_like_bytes():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.permutation(3900)
    group = np.sort(rng.integers(0, 7, 3900))
    h = prefix_hash(data)
    order = substring_dedup.suffix_sort(data, h, starts, group, 50)
    want = sorted(range(3900), key=lambda i: (group[i], data[starts[i] : starts[i] + 50].tobytes(), i))
    assert order.tolist() == want
    cls = substring_dedup.equal_runs(data, h, starts, group, order, 50)
    keys = [(group[i], data[starts[i] : starts[i] + 50].tobytes()) for i in order]
    assert [a != b for a, b in zip(keys, keys[1:], strict=False)] == (np.diff(cls) != 0).tolist()


def test_equal_hashes_are_verified():
    """With a hash that says that everything is equal, classes still follow the bytes."""
    data = np.frombuffer(b"abcabcabdabe" * 3, np.uint8)
    starts = np.array([0, 3, 6, 9])
    h = np.zeros(len(data) + 1, np.uint64)
    group = np.zeros(4, np.int64)
    order = substring_dedup.suffix_sort(data, h, starts, group, 3)
    cls = substring_dedup.equal_runs(data, h, starts, group, order, 3)
    found = defaultdict(set)
    for i, c in zip(order.tolist(), cls.tolist(), strict=True):
        found[c].add(bytes(data[starts[i] : starts[i] + 3]))
    assert sorted(map(sorted, found.values())) == [[b"abc"], [b"abd"], [b"abe"]]


def test_span_hash_is_independent_of_place():
    data = np.frombuffer(b"xxhello--hello!", np.uint8)
    h = prefix_hash(data)
    a, b = span_hash(h, np.array([2]), np.array([7])), span_hash(h, np.array([9]), np.array([14]))
    assert a == b and mix(a) == mix(b)
    assert pa.__version__


def test_substring_in_rounds(docs, rows, monkeypatch):
    """With little room for entries the parts are taken in rounds; entries are never a stored table, and nothing is lost."""
    names, real = [], substring_dedup.Scratch.table
    monkeypatch.setattr(substring_dedup.Scratch, "table", lambda self, df, name: names.append(name) or real(self, df, name))
    want = brute_cut(rows)
    for frequent in (substring_dedup.FREQUENT, 2):
        names.clear()
        got = substring_dedup.substring_dedup(docs, with_bytes=True, part_bytes=10_000, entry_bytes=20_000, frequent=frequent).collect()
        assert len(got) == len(rows) and sum(n.startswith("bits") for n in names) > 2 and "entries" not in names
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id]


def test_substring_rounds_follow_bytes_sent(docs, rows, monkeypatch):
    """What is expected of the entries can be far too little: after the first round the bytes sent count."""
    sent, real = [], substring_dedup.Scratch.table

    def table(self, df, name):
        out = real(self, df, name)
        if name.startswith("bits"):
            sent.append(out.agg(F.sum("sent")).first()[0] if "sent" in out.columns else None)
        return out

    monkeypatch.setattr(substring_dedup.Scratch, "table", table)
    monkeypatch.setattr(substring_dedup, "ENTRY_BYTES", 8)  # a fifth of the truth
    got = substring_dedup.substring_dedup(docs, with_bytes=True, part_bytes=2_000, entry_bytes=20_000).collect()
    want = brute_cut(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) == want[r.doc_id]
    assert len(sent) > 2 and max(x or 0 for x in sent[1:]) < 2 * 20_000


def test_tables_in_few_files(spark, docs, rows, monkeypatch):
    """With a shuffle partition for every few rows, the tables of the near-copy join have no file for each."""
    files, real = {}, near_dedup.Scratch.table

    def table(self, df, name):
        out = real(self, df, name)
        files[name] = len(out.inputFiles())
        return out

    monkeypatch.setattr(near_dedup.Scratch, "table", table)
    monkeypatch.setattr("foliospark.llm.scratch.FILES_A_CORE", 1)
    keys = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    _, comp = brute_components(rows)
    assert got == {d: comp[d] for d in got} and len(got) == len({d for d, *_ in rows})
    assert max(files.values()) <= spark.sparkContext.defaultParallelism, files
