"""Inputs written to break an operator: words made to collide, unlabelled corpora, names that mislead, very long texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import html_extract, language_id, lm_score, near_dedup, packing, substring_dedup
from foliospark.llm.bytesets import KEY, SIP_STATE, flat, keyed_hash, new_key, prefix_hash, span_hash, words


def thue_morse(letters: int) -> tuple[str, str]:
    """Two words that every polynomial hash modulo a power of two takes for one, if they are long enough."""
    bits = [bin(k).count("1") & 1 for k in range(letters)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def sip(raw: bytes, key: tuple[int, int]) -> int:
    """SipHash-1-3 a byte string at a time."""
    full = (1 << 64) - 1
    v = [a ^ key[k % 2] for k, a in enumerate(SIP_STATE)]

    def turn(x, n):
        return ((x << n) | (x >> (64 - n))) & full

    def step():
        v[0] = (v[0] + v[1]) & full
        v[2] = (v[2] + v[3]) & full
        v[1], v[3] = turn(v[1], 13) ^ v[0], turn(v[3], 16) ^ v[2]
        v[0] = turn(v[0], 32)
        v[2] = (v[2] + v[1]) & full
        v[0] = (v[0] + v[3]) & full
        v[1], v[3] = turn(v[1], 17) ^ v[2], turn(v[3], 21) ^ v[0]
        v[2] = turn(v[2], 32)

    for k in range(0, len(raw) // 8 * 8 + 1, 8):
        block = int.from_bytes(raw[k : k + 8], "little") | ((len(raw) & 255) << 56 if k + 8 > len(raw) else 0)
        v[3] ^= block
        step()
        v[0] ^= block
    v[2] ^= 255
    for _ in range(3):
        step()
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def test_keyed_hash_is_siphash():
    rng = random.Random(3)
    some = [bytes(rng.randrange(33, 127) for _ in range(n)) for n in [*range(1, 40), 63, 64, 65, 200, 255, 256]]
    data = np.frombuffer(b" ".join(some), np.uint8)
    for key in (KEY, new_key()):
        h, start, end, n = words(data, np.array([0, len(data)]), key)
        assert h.tolist() == [sip(w, key) for w in some] and n.tolist() == [len(some)]
    long = np.frombuffer(b"x" * 300 + b"y" * 300 + b"x" * 300, np.uint8)
    h = keyed_hash(long, np.array([0, 300, 600]), np.array([300, 600, 900]), KEY)
    assert h[0] == h[2] != h[1]


@pytest.mark.parametrize("letters", [1024, 2048])
def test_words_that_collide_by_construction(spark, letters):
    one, two = thue_morse(letters)
    data = np.frombuffer((one + two).encode(), np.uint8)
    h = prefix_hash(data)
    assert span_hash(h, np.array([0]), np.array([letters])) == span_hash(h, np.array([letters]), np.array([2 * letters]))  # the pair does its work
    rest = " some other words that are the same"
    docs = spark.createDataFrame([(1, one + rest), (2, two + rest), (3, one), (4, two), (5, one + " x")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs).collect()}
    assert got[3] == 3 and got[4] == 4  # no shingle in common
    path = packing.vocabulary("byte_bpe_50k.json")
    enc = packing.WordCache(path)
    for text in (one, two, one + rest, two + rest):
        assert enc.encode([text])[0] == enc.whole(text)
    scored = {r.doc_id: r for r in lm_score.lm_score(docs, held_out=F.col("doc_id").isin(2, 4)).collect()}
    assert scored[4].n_known == 1 and scored[3].n_known == 2  # the end mark, and the word where it was learned


def test_index_grows_and_texts_of_many_words():
    index = packing.HashIndex(8)
    keys = np.random.default_rng(1).integers(1, 1 << 63, 50_000).astype(np.uint64)
    keys = np.unique(keys)
    for a in range(0, len(keys), 777):
        index.add(keys[a : a + 777], np.arange(a, min(a + 777, len(keys)), dtype=np.int32))
    assert (index.find(keys) == np.arange(len(keys))).all() and index.find(keys + np.uint64(1)).max() < 0
    assert 2 * index.count <= len(index.keys)


def test_many_distinct_words_end(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 2000)
    monkeypatch.setattr(packing, "LONG", 40_000)
    enc = packing.WordCache(packing.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(9)) for _ in range(30_000))
    assert enc.encode([text, "", text[:50_000]]) == [enc.whole(text), b"", enc.whole(text[:50_000])]
    odd = "a  b\n c 1 d  e f'll g " * 4000 + "漢 字 x y " * 3000
    assert enc.encode([odd])[0] == enc.whole(odd)
    assert len(packing.seams(text, 1000)) > 100 and "".join(packing.seams(odd, 1000)) == odd


def test_rows_without_ids_spread_over_groups(spark):
    docs = spark.createDataFrame([(None, "")] * 3000 + [(7, "a b c")] * 3000, "doc_id long, text string").repartition(4)
    got = packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"), group=500).collect()
    assert len(got) == 6000
    sizes: dict[int, int] = {}
    for r in got:
        sizes[r.sequence_id >> 32] = sizes.get(r.sequence_id >> 32, 0) + 1
    assert len(sizes) == 12 and max(sizes.values()) < 800


def test_pieces_of_a_document_share_a_group(spark):
    docs = spark.createDataFrame([(k, "word and more " * 3000) for k in range(40)], "doc_id long, text string")
    got = packing.pack(docs, packing.vocabulary("byte_bpe_50k.json"), group=60).collect()
    groups: dict[int, set] = {}
    for r in got:
        groups.setdefault(r.doc_id, set()).add(r.sequence_id >> 32)
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) > 3


def test_unlabelled_corpora_lose_nothing(spark):
    texts = ["some plain english text", "ein deutscher satz", "漢字かな", "été", None, "", "12 34 !?", "🙂"]
    for lang in (None, "en"):
        rows = [(k, t, lang if k == 0 and lang else None) for k, t in enumerate(texts)]
        kept = language_id.in_some_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
        assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3]
    got = language_id.language_id(spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string")).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_mixtures_against_a_plain_loop():
    """The set of languages and their proportions, text after text by the textbook."""
    rng = np.random.default_rng(9)
    words_, like = rng.integers(1, 40, 30), []
    for n in words_:
        like.append(rng.normal(-20, 4, (n, 4)) + rng.choice([0, 6], 4))
    weight = [rng.integers(1, 12, n).astype(float) for n in words_]
    got = language_id.mixtures(np.concatenate(like), np.concatenate(weight), words_)

    def fit(p, w, on, share):
        share = np.where(on, np.maximum(share, 1e-6), 0)
        share = share / share.sum()
        for _ in range(language_id.ROUNDS):
            joint = share * p
            share = (joint / joint.sum(1, keepdims=True) * w[:, None]).sum(0) / w.sum()
        return share, np.log((share * p).sum(1)).sum()

    for k, n in enumerate(words_):
        p = np.exp(like[k] - like[k].max(1, keepdims=True))
        on = np.ones(4, bool)
        share, best = fit(p, weight[k], on, np.full(4, 0.25))
        while on.sum() > 1:
            less = on.copy()
            less[np.where(on, share, np.inf).argmin()] = False
            new, fits = fit(p, weight[k], less, share)
            if fits + 0.5 * np.log(max(n, 2)) < best:
                break
            share, best, on = new, fits, less
        assert np.allclose(got[k], share, atol=1e-9)


SENTENCE = "This is a sentence of the article that goes on for a while, with commas, and then ends here. "


@pytest.mark.parametrize("name", ["main side-by-side", "form-factor-article", "article-body text-alert-free", "post search-results-article", "newsletter-article", "layout sidebar-right", "has-sidebar", "no-comments"])
def test_no_article_is_lost_for_a_name(name):
    body = f"<p>{SENTENCE * 2}</p><p>{SENTENCE * 3}</p>"
    want = f"{SENTENCE * 2}{SENTENCE * 3}".strip()
    for before, after in (("", ""), ("<nav><a href=x>Home</a></nav>", "<footer><p>Some site</p></footer><div class='comments-area'><div class='comment-body'><p>I read this with joy, thank you. It was very good to read indeed, and long enough.</p></div></div>")):
        assert html_extract.main_text(f"<html><body>{before}<div class='{name}'>{body}</div>{after}</body></html>") == want


@pytest.mark.parametrize("name", ["cookie-banner", "comment-body", "article-comments", "td-footer-wrapper", "wp-block-latest-comments", "js-cookie-consent-manager", "related-articles", "left-sidebar", "global-nav", "c-newsletter-cta", "adv-unit-top", "site-header"])
def test_boilerplate_by_its_name(name):
    for tag in ("article", "div"):
        page = f"<html><body><{tag}><p>{SENTENCE * 2}</p></{tag}><div class='{name}'><p>{SENTENCE.replace('article', 'notice') * 2}</p></div></body></html>"
        assert html_extract.main_text(page) == (SENTENCE * 2).strip()


def test_extraction_on_labelled_pages():
    """Pages put together from parts of known label: nearly every word comes out right."""
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 9))) for _ in range(n)).capitalize() + "."
    right = wrong = missed = 0
    for _ in range(200):
        paragraphs = [say(rng.randint(15, 60)) for _ in range(rng.randint(2, 8))]
        body = "".join(f"<p>{p}</p>" if rng.random() < 0.85 else f"<blockquote><p>{p}</p></blockquote>" for p in paragraphs)
        wrap = rng.choice(["<article>%s</article>", "<main>%s</main>", "<div class='post-content'>%s</div>", "<div id='story'>%s</div>", "<div class='layout sidebar-left'>%s</div>"])
        links = "".join(f"<li><a href='/{k}'>{say(2)}</a></li>" for k in range(8))
        parts = [f"<nav><ul>{links}</ul></nav>", f"<div class='cookie-notice'><p>{say(20)}</p></div>", f"<aside><h3>{say(3)}</h3><ul>{links}</ul></aside>", f"<footer><p>{say(9)}</p></footer>", f"<section class='comments'><p>{say(30)}</p></section>", f"<form><label>{say(2)}</label></form>"]
        rng.shuffle(parts)
        cut = rng.randint(0, len(parts))
        got = html_extract.main_text(f"<html><body>{''.join(parts[:cut])}{wrap % body}{''.join(parts[cut:])}</body></html>").split()
        want = " ".join(paragraphs).split()
        both = len([w for w in got if w in set(want)])
        right, wrong, missed = right + both, wrong + len(got) - both, missed + max(0, len(want) - both)
    assert wrong < 0.01 * right and missed < 0.01 * right


def test_scan_in_pieces_sees_every_window(monkeypatch):
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abc"), n)) for n in (10, 4000, 49, 50, 51, 700)]
    column = pa.array(texts)
    _, off, *whole = substring_dedup.scan(column, 50, 20)
    monkeypatch.setattr(substring_dedup, "PIECE", 300)
    _, _, *cut = substring_dedup.scan(column, 50, 20)

    def windows(cols):
        text, start, count, place, g, _ = cols
        return {(int(t), int(s + k), int(p), int(h)) for t, s, n, p, h in zip(text, start, count, place, g, strict=True) for k in range(n)}

    assert windows(cut) == windows(whole)
    assert sorted((t, s) for t, s, _, _ in windows(whole)) == [(t, int(off[t]) + k) for t, x in enumerate(texts) for k in range(len(x) - 49)]
    assert flat(column)[1].tolist() == off.tolist()


def test_equal_context_hashes_are_compared(monkeypatch):
    """With a context hash that is the same for all, entries still follow the bytes."""
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(300)) for _ in range(6)]
    texts += texts[:3]
    left = pa.table({"block": [1] * 9, "__loc_row": list(range(9)), "doc_id": list(range(9)), "text": texts})
    real = substring_dedup.anchors

    def flatter(*a):
        return (*real(*a)[:-1], np.zeros(len(real(*a)[0]), np.uint64))

    parts = 16
    work = substring_dedup.send_anchors(parts, 50, 20)
    sent = pa.Table.from_batches(list(work([left.append_column("window", pa.array([1] * 9)).to_batches()[0]])))
    rows = [substring_dedup.find_repeats(sent.filter(pa.compute.equal(sent["part"], p))) for p in sorted(set(sent["part"].to_pylist()))]
    told = pa.concat_tables(rows)
    told = told.append_column("copies", pa.nulls(told.num_rows, pa.list_(pa.int64())))
    good = substring_dedup.Block(left, told, parts, 50, 20)
    monkeypatch.setattr(substring_dedup, "anchors", flatter)
    bad = substring_dedup.Block(left, told, parts, 50, 20)
    for b in (good, bad):
        for k, e in enumerate(b.entry.tolist()):
            h = b.head[e]
            size = int(b.count[k]) + 49
            assert bytes(b.data[b.start[k] : b.start[k] + size]) == bytes(b.data[b.start[h] : b.start[h] + size])
    assert len(good.head) <= len(bad.head)
