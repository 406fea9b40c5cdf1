from __future__ import annotations

import hashlib
import random
import zlib
from itertools import product

import pytest

from foliospark.llm import html_extract, matroska

M = matroska


# --- op4


def test_media_round_trip(docs, rows):
    texts = {d: t or "" for d, t, *_ in rows}
    got = matroska.media_columns(docs).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        assert by_text.setdefault(texts[r.doc_id], tuple(r)[1:]) == tuple(r)[1:]


def test_packet_table_covers_the_payload(docs):
    files = matroska.to_media(docs)
    packets = matroska.packet_table(files).toPandas()
    assert packets.error.isna().all()
    for doc, own in list(packets.drop_duplicates(["doc_id", "offset"]).groupby("doc_id"))[:40]:
        data = bytes(files.filter(files.doc_id == doc).first().media)
        assert b"".join(data[o : o + n] for o, n in zip(own.offset, own["size"], strict=True)) == M.read_back(data, M.parse(data))
        assert own.timestamp_ns.is_monotonic_increasing


def test_all_lacings():
    rng = random.Random(1)
    for kind, n in product((M.XIPH, M.FIXED, M.EBML_LACE), (1, 2, 5, 256)):
        frames = [bytes([k % 256]) * (40 if kind == M.FIXED else rng.randint(0, 700)) for k in range(n)]
        body = M.block_body(3, -7, frames, kind)
        info = M.element(M.SEGMENT, M.element(M.CLUSTER, M.element(M.TIMESTAMP, M.number(50)) + M.element(M.SIMPLE_BLOCK, body)))
        data = M.HEADER + info
        got = M.parse(data).packets
        assert [data[p.offset : p.offset + p.size] for p in got] == frames
        assert {(p.track, p.timestamp_ns, p.keyframe) for p in got} == {(3, 43_000_000, True)} and [p.lace for p in got] == list(range(n))


def test_unknown_sizes_groups_and_cues():
    block = M.block_body(1, 2, [b"frame"], 0)
    group = M.element(M.GROUP, M.element(M.BLOCK, block) + M.element(M.REFERENCE, b"\xff"))
    unknown = lambda ident, body: M.number(ident) + b"\x01" + b"\xff" * 7 + body
    cluster = unknown(M.CLUSTER, M.element(M.TIMESTAMP, M.number(1000)) + group)
    second = M.element(M.CLUSTER, M.element(M.TIMESTAMP, M.number(2000)) + M.element(0xEC, b"void") + M.element(M.SIMPLE_BLOCK, block))
    cues = M.element(M.CUES, M.element(M.CUE_POINT, M.element(M.CUE_TIME, M.number(2000)) + M.element(M.CUE_POSITIONS, M.element(M.CUE_TRACK, b"\1") + M.element(M.CUE_CLUSTER, M.number(len(cluster))))))
    parsed = M.parse(M.HEADER + unknown(M.SEGMENT, cluster + second + cues))
    assert [(p.timestamp_ns // 10**6, p.keyframe, p.cluster) for p in parsed.packets] == [(1002, False, 0), (2002, True, len(cluster))]
    assert parsed.cues == [(2000 * 10**6, 1, len(cluster))]


def test_broken_files_are_errors(spark):
    good = M.write_audio(b"x" * 2000)
    files = [(1, good), (2, good[:60]), (3, b"RIFF...."), (4, b""), (5, None), (6, good[:-20]), (None, good)]
    got = M.packet_table(spark.createDataFrame(files, "doc_id long, media binary")).toPandas()
    assert set(got[got.error.notna()].doc_id) == {2, 3, 4, 5, 6}
    assert len(got[got.doc_id == 1]) == len(got[got.doc_id.isna()]) == 4


def test_media_odd_rows(odd, empty):
    got = M.media_columns(odd).collect()
    assert sorted(r.payload_bytes for r in got) == [576] * 5 and M.media_columns(empty).count() == 0


def test_variable_length_integers():
    for n in (0, 1, 126, 127, 128, 16382, 16383, 2**21 - 2, 2**56 - 2):
        assert M.read_size(M.size_of(n), 0) == (n, len(M.size_of(n)))
    assert M.read_size(b"\xff", 0) == (None, 1)
    with pytest.raises(ValueError):
        M.read_size(b"\0", 0)


# --- op6

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head>
<body class="page header-fixed"><header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href=/x>Other</a></ul></nav>
<div id="cookie-notice">We use cookies.</div><!-- <p>comment</p> -->
<article><h1>A  title &amp; more</h1><p><b>Bold&nbsp;start<br><p>A paragraph with <a href="x">a link</a>, &eacute;t&#233; &lt;b&gt; and m<i>id</i>dle.</p>
<div class="ad">Buy this now.</div><p>Second
paragraph.</p></article>
<div class="comments"><p>A reader comment that is long enough to look like content.</p></div><form><p>Search here</p></form>
<aside><p>More to read here, with a long text too.</p></aside><footer>&copy; Site</footer>"""


def test_article_without_boilerplate():
    assert html_extract.main_text(PAGE) == "A title & more Bold start A paragraph with a link, été <b> and middle. Second paragraph."


def test_pages_without_an_article():
    body = "<html><body><div class=menu><a href=a>One</a> <a href=b>Two</a></div><div><p>%s</p><p>%s</p></div><div><a href=c>Next page</a></div></body></html>"
    text = "This is a sentence of the text. " * 5
    assert html_extract.main_text(body % (text, text)) == (text + text).strip().replace(". T", ". T")


def test_names_of_what_stands_beside():
    page = '<div class="layout has-sidebar no-ads"><div class="post-content with-comments"><p>%s</p></div><div class="post-comments"><p>%s</p></div></div>'
    text = "This is a sentence of the text. " * 5
    assert html_extract.main_text(page % (text, "A reader says something here. " * 5)) == text.strip()


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "<script>x", "<!-- open", "<html></html>", "</p></p>", "&", "<a><a><a>"])
def test_odd_pages(page):
    assert html_extract.main_text(page) in ("", "<", "&")


def test_deep_and_long_pages():
    assert isinstance(html_extract.main_text("<div>" * 5000 + "text" + "</div>" * 5000), str)
    long = "<article>" + "<p>word</p>" * 20_000 + "</article>"
    assert len(html_extract.main_text(long)) == 20_000 * 5 - 1


def test_minimum_cut_against_all_labellings():
    rng = random.Random(7)
    for _ in range(60):
        n = rng.randint(1, 7)
        odds = [rng.randint(-9, 9) for _ in range(n)]
        ties = {(i, j): rng.randint(0, 6) for i in range(n) for j in range(i) if rng.random() < 0.6}
        flow = html_extract.Flow(n + 2)
        for i, o in enumerate(odds):
            flow.edge(n, i, max(o, 0))
            flow.edge(i, n + 1, max(-o, 0))
        for (i, j), w in ties.items():
            flow.edge(i, j, w, w)
        cost = lambda keep: sum(max(o, 0) for o, k in zip(odds, keep, strict=True) if not k) + sum(max(-o, 0) for o, k in zip(odds, keep, strict=True) if k) + sum(w for (i, j), w in ties.items() if keep[i] != keep[j])  # noqa: E731, B023
        total = flow.run(n, n + 1)
        level = flow.levels(n)
        assert total == min(map(cost, product((False, True), repeat=n))) == cost([level[i] >= 0 for i in range(n)])


def test_extract_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE)]
    got = html_extract.extract(spark.createDataFrame([(*r, 5) for r in rows], "page_id long, url string, html string, text long")).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in got] == [(1, "u", len(got[0].text)), (2, None, 0), (None, "v", 0), (1, "u", len(got[0].text))]
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
