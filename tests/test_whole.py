"""Registered queries over tables of a few rows, against plain loops: nothing of the input is left out."""

from __future__ import annotations

import pandas as pd
import pytest

from foliospark.plans import catalog


@pytest.fixture
def run(spark, tmp_path):
    """Rows of a query over the given tables."""

    def rows(name, **tables):
        for table, df in tables.items():
            df.to_parquet(tmp_path / f"{table}.parquet", coerce_timestamps="us")
        return sorted((tuple(r) for r in catalog.queries()[name](spark, str(tmp_path)).collect()), key=lambda r: [(x is None, x) for x in r])

    return rows


def test_escape_whole_pages(run):
    html = ["<a href=\"x\">it's & so</a>" * 100, "short", "x" * 300 + "<"]
    want = []
    for i, h in enumerate(html):
        for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("`", "&#x60;")):
            h = h.replace(sign, name)
        want.append((i, h))
    assert run("f14_escape", pages=pd.DataFrame({"page_id": range(3), "url": "u", "html": html})) == want


def events(n=300):
    """Events of twelve users, a few hours apart."""
    kind = ["view", "click", "purchase", "signup", "error"]
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(hours=5 * i + i % 3), i * i % 12, kind[(i * 7 + i // 11) % 5], float(i), "{}") for i in range(n)]
    return pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])


def test_labels_of_all_events(run):
    e, kinds = events(), {}
    for r in e.itertuples():
        kinds.setdefault(r.user_id, set()).add(r.event_type)
    want = sorted((u, "click" in k and not k & {"purchase", "signup"}) for u, k in kinds.items())
    assert run("r16_labels", events=e) == want


def test_delayed_events_of_all_views(run):
    e, first = events(), {}
    for i in e[e.event_type == "view"].itertuples():
        for r in e[(e.event_type != "view") & (e.user_id == i.user_id)].itertuples():
            if i.ts <= r.ts < i.ts + pd.Timedelta(days=7):
                key, at = (i.event_id, r.event_type), r.ts.value // 1000
                first[key] = min(first.get(key, at), at)
    assert any(i % 5 for i, _ in first)
    assert run("j11_delayed_events", events=e) == sorted((*k, at) for k, at in first.items())


def library():
    """Forty bookmarks of four users, tags and lists on them; ids lie far apart."""
    ids, tags, lists = [1 + 131 * i for i in range(40)], [*range(1, 25), 60, 99, 100, 750], [1, 2, 3, 8, 9, 100, 750]
    return {
        "orders": pd.DataFrame([(b, i % 4, pd.Timestamp("1995-01-01"), "F", "5-LOW", 1.0) for i, b in enumerate(ids)], columns=["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"]),
        "part": pd.DataFrame({"p_partkey": tags, "p_name": [f"tag {i % 20}" for i in range(len(tags))]}),
        "supplier": pd.DataFrame({"s_suppkey": lists, "s_name": [f"list {i}" for i in lists]}),
        "lineitem": pd.DataFrame([(ids[i * 7 % 38], tags[(i * i + i // 3) % len(tags)], lists[i * 5 % len(lists)], "ANR"[i % 3]) for i in range(200)], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"]),
    }


@pytest.mark.parametrize("name", ["j02_three_way", "j05_nested_documents", "j10_two_keys", "u05_merge_ignore_conflicts", "d02_merge_tags", "d04_merge_lists"])
def test_whole_library(run, name):
    t = library()
    users, names = dict(t["orders"][["o_orderkey", "o_custkey"]].values), dict(t["part"].values)
    on = [(b, k, "ai" if f == "A" else "human") for b, k, _, f in t["lineitem"].values]
    inside = {(b, m) for b, _, m, _ in t["lineitem"].values}
    if name == "j02_three_way":
        want = pd.Series([(users[b], names[k]) for b, k, _ in on]).value_counts()
        want = [(*x, n) for x, n in want.items()]
    elif name == "j05_nested_documents":
        want = [(b, "|".join(sorted(names[k] for k in {k for o, k, _ in on if o == b})), sum(o == b for o, _ in inside)) for b in users]
    elif name == "j10_two_keys":
        got = run(name, **t)
        assert sorted(x[:2] for x in got) == sorted(x[:2] for x in on) and all(m == (k if (b, k) in inside else None) for b, k, m in got)
        return
    elif name == "u05_merge_ignore_conflicts":
        want = {(b, 1 if k in (1, 2, 3, 4) else k) for b, k, _ in on}
    elif name == "d02_merge_tags":
        want = {}
        for b, k, by in on:
            key = (b, 1 if 2 <= k <= 20 else k)
            want[key] = max(by, want.get(key, ""))
        want = [(*k, by) for k, by in want.items()]
    else:
        want = {(b, 1 if m in (2, 3) else m) for b, m in inside}
    assert run(name, **t) == sorted(want)


def test_cjk_documents(run):
    texts = ["plain words", "漢字 and words", "ひらがなカタカナ", "한국어 글", "", "ﾊﾝｶｸ 𠀋 é"]
    ranges = [(0x3040, 0x30FF), (0x3400, 0x9FFF), (0xAC00, 0xD7AF), (0xFF00, 0xFFEF)]
    n = [sum(any(a <= ord(c) <= b for a, b in ranges) for c in x) for x in texts]
    docs = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})
    assert n[1:4] == [2, 8, 4] and run("f24_cjk_share", documents=docs) == list(enumerate(n))
    # in hundredths, as whole numbers: 150 for a CJK character, 35 for any other
    assert run("f21_token_estimate", documents=docs) == [(i, -(-(150 * k + 35 * (len(x) - k)) // 100)) for i, (x, k) in enumerate(zip(texts, n, strict=True))]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def users_tags():
    """The library with other names, and the (key, id) of each user's tags in order."""
    t = library()
    t["part"]["p_name"] = [["Re act", "re-acts", "reactor", "rust", "rusty", "Rus-t"][i % 6] + "x" * (i // 12) for i in range(len(t["part"]))]
    users, names, tags = dict(t["orders"][["o_orderkey", "o_custkey"]].values), dict(t["part"].values), {}
    for b, k in t["lineitem"][["l_orderkey", "l_partkey"]].values:
        tags.setdefault(users[b], set()).add((names[k].lower().replace(" ", "").replace("-", ""), k))
    return t, {u: sorted(x) for u, x in tags.items()}


def test_close_tags_of_the_library(run):
    t, tags = users_tags()
    want = []
    for u, rows in tags.items():
        head = None
        for r in rows:
            head = r if head is None or distance(head[0], r[0]) > 1 else head
            want.append((u, r[1], head[1]))
    assert len(tags) == 4 and any(i != h for _, i, h in want)
    assert run("wf11_close_tags", **t) == sorted(want)


def test_edit_distance_of_neighbours(run):
    t, tags = users_tags()
    want = [(x[0], y[0], distance(x[0], y[0])) for rows in tags.values() for x, y in zip(rows, rows[1:], strict=False)]
    assert run("f11_edit_distance", **t) == sorted(want)


def test_session_over_several_files(run, spark, tmp_path, monkeypatch):
    """Files are bounded in rows; the tabs of the latest session come from all of them, of equal dates in a file the later ones."""
    from foliospark.plans import queries_exchange
    from foliospark.sources import imports as I

    monkeypatch.setattr(queries_exchange, "FILE_ROWS", 40)
    e = events()
    assert run("s08_session_json", events=e) == sorted((f"t{r.event_id}", f"https://e.org/{r.event_id}", r.event_id) for r in e.itertuples() if r.user_id % 13 == max(e.user_id % 13))
    (tmp_path / "s").mkdir()
    for k, sessions in enumerate(([(9, "a"), (3, "b")], [(9, "c"), (9, "d")], [(4, "e")], [])):
        body = ", ".join(f'{{"date": {d}, "windows": {{"w": {{"1": {{"url": "https://{x}.org"}}}}}}}}' for d, x in sessions)
        (tmp_path / "s" / f"{k}.json").write_text(f"[{body}]")
    assert sorted(r.url for r in I.read_import(spark, "session-json", str(tmp_path / "s")).collect()) == ["https://a.org", "https://d.org"]


def test_backup_in_bounded_files(spark, tmp_path, monkeypatch):
    """A file has the lists of its own bookmarks, not all of them, and all memberships of manual lists come back."""
    import json

    from foliospark.plans import queries_exchange

    monkeypatch.setattr(queries_exchange, "FILE_ROWS", 10)
    written, real = [], queries_exchange.one_each
    monkeypatch.setattr(queries_exchange, "one_each", lambda *a: written.append(real(*a)) or written[-1])
    orders = pd.DataFrame([(i, 1, pd.Timestamp("2024-01-01"), "F", "1-URGENT", 5.0) for i in range(600)], columns=["o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_totalprice"])
    items = pd.DataFrame([(i, 1, s, "A") for i in range(600) for s in (i % 300, (7 * i) % 300)], columns=["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag"])
    lists = pd.DataFrame([(i, f"s{i}") for i in range(300)], columns=["s_suppkey", "s_name"])
    for name, df in (("orders", orders), ("lineitem", items), ("supplier", lists)):
        df.to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us")
    got = {r.title: r.lists for r in catalog.queries()["s05_native_json"](spark, str(tmp_path)).collect()}
    assert got == {str(i): ",".join(sorted({str(s) for s in (i % 300, (7 * i) % 300) if s % 10})) for i in range(600) if i % 3 < 2}
    files = [json.loads(x.value) for x in spark.read.text(written[0]).collect()]
    assert len(files) > 16 and max(len(f["lists"]) for f in files) < 150 and {x["id"] for f in files for x in f["lists"]} == {str(i) for i in range(300)}
