from __future__ import annotations

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, language_id, license_scan, lm_score, packing

LOW = {i: i + 32 for i in range(65, 91)}


# --- op3


def test_language_held_out_accuracy(spark):
    rng = random.Random(2)
    alphabets = {"xx": "abcdefgh", "yy": "klmnopqr", "zz": "éèüstuvw"}

    def text(lang, n):
        return " ".join("".join(rng.choice(alphabets[lang]) for _ in range(rng.randint(2, 7))) for _ in range(n))

    rows = [(i, text(lang, rng.randint(3, 60)), lang) for i, lang in enumerate(rng.choice(["xx", "yy", "zz"]) for _ in range(300))]
    rows += [(1000, text("xx", 30) + " " + text("yy", 10), "xx"), (1001, None, "xx"), (1002, "12 !? 3", "yy"), (1003, "€ £ 5", "zz"), (None, text("yy", 9), None)]
    got = {r.doc_id: r for r in language_id.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows[:300] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows[:300])
    assert sum(got[i].lang_pred == lang for i, _, lang in held) >= 0.98 * len(held)
    assert got[1000].lang_pred == "xx" and 0.55 < got[1000].score < 0.9 and set(got[1000].shares) == {"xx", "yy"}
    assert [got[i].lang_pred for i in (1001, 1002, 1003)] == ["und"] * 3 and got[1001].score == 0
    assert got[None].lang_pred == "yy" and got[None].held_out is False
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_odd_rows(odd, empty, docs):
    assert language_id.language_id(empty).count() == 0
    assert {r.lang_pred for r in language_id.language_id(odd).collect()} == {"en", "und"}
    nothing = language_id.language_id(docs, held_out=F.lit(True)).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    kept = language_id.in_some_language(odd)
    assert kept.columns == odd.columns and kept.count() == 3


# --- op5


def test_license_templates_and_variants(spark):
    mit = license_scan.TEMPLATES["MIT"][-1]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore text."),
        (2, "Copyright (c) 2020 Somebody\n\n" + re.sub(r"\s+", " ", mit.replace("Software", "Library"))),
        (3, "This is a text about cooking.\nNothing else."),
        (4, "licensed under the apache license version 2 0"),
        (5, None),
        (6, ""),
        (7, "This work is licensed under the GNU\nGeneral Public License, version 3."),
        (8, "first part\n\nLicensed under CC BY-NC 4.0.\n\nlast"),
    ]
    got = {r.doc_id: r for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i].license for i in range(1, 9)] == ["MIT", "MIT", None, "Apache-2.0", None, None, "GPL-3.0", "CC-BY-NC-4.0"]
    assert got[1].dice == 1.0 and 0.8 <= got[2].dice < 1
    spans = {(r.doc_id, r.kind): rows[r.doc_id - 1][1][r.start : r.end] for r in license_scan.license_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[1, "line"] == "Released under the MIT License." and spans[7, "text"] == rows[6][1]


def test_license_bounds_lose_nothing():
    """Against every template, without the bounds on sizes."""
    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.5)
    rng = random.Random(4)
    for _ in range(300):
        words = rng.choice([t for ts in license_scan.TEMPLATES.values() for t in ts]).split()
        part = words[: rng.randint(1, len(words))] + ["other"] * rng.randint(0, 4)
        grams = license_scan.bigrams(" ".join(part))
        every = [(-2 * len(grams & t.grams) / (len(grams) + len(t.grams) or 1), t.name) for t in scanner.templates]
        want = min(every)
        found = scanner.best(grams)
        assert found == ((want[1], -want[0]) if -want[0] >= 0.5 - 1e-12 else None)


def test_license_odd_rows(odd, empty):
    assert license_scan.license_scan(empty).count() == 0
    assert license_scan.license_scan(odd).filter("license IS NULL").count() == 5


# --- op8


def test_first_fit_against_a_plain_loop():
    rng = random.Random(1)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 100) for _ in range(rng.randint(0, 200))), reverse=True)
        room, want = [], []
        for n in lengths:
            k = next((i for i, r in enumerate(room) if r >= n), None)
            if k is None:
                k = len(room)
                room.append(100)
            want.append((k, 100 - room[k]))
            room[k] -= n
        bins, offsets = packing.first_fit(lengths, 100)
        assert list(zip(bins, offsets, strict=True)) == want


@pytest.mark.parametrize("group", [50_000, 20])
def test_packing_is_a_partition(docs, rows, group):
    path = packing.vocabulary("byte_bpe_50k.json")
    library = packing.encoder(path).library
    got = packing.pack(docs, path, group=group).toPandas()
    want = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t, *_ in rows}
    assert got.doc_id.nunique() == len(want)
    for doc, own in got.drop_duplicates(["doc_id", "start"]).groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(want[doc]) == own.doc_tokens.iloc[0]
        for r in own.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(want[doc][r.start : r.start + r.length], "<u4").tobytes())
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 1024
    assert len(got.drop_duplicates(["doc_id", "start"])) + sum(-(-len(want[rows[k][0]]) // 1024) for k in (0, 1)) == len(got)


def test_packing_odd_rows(odd, empty):
    path = packing.vocabulary("byte_bpe_50k.json")
    got = packing.pack(odd, path).collect()
    assert len(got) == 5 and sorted(r.doc_tokens for r in got)[:2] == [1, 1]
    assert packing.pack(empty, path).count() == 0


def test_word_cache_equals_the_library():
    cache = packing.WordCache(packing.vocabulary("byte_bpe_50k.json"))
    rng = random.Random(9)
    pool = list("ab 's  \n\r\t.,!é1_×÷²\x0b\x1c\x85\xa0ßĀſ'漢🙂") + ["'re", "'ll", "  ", "\n\n", "<|endoftext|>", "the"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    want = [np.array(e.ids, "<u4").tobytes() for e in cache.library.encode_batch(texts, add_special_tokens=False)]
    assert cache.encode(texts) == want


# --- op9


def brute_lm(rows):
    fold = lambda d: zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [(d, [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None]) for d, t, *_ in rows]
    c = Counter(w for d, ws in tokens if not fold(d) for w in ws)
    n, v = sum(c.values()), len(c)
    pairs = Counter(p for d, ws in tokens if not fold(d) for p in zip(["<s>", *ws], ws, strict=False))
    return tokens, c, pairs, n, v, fold


def test_lm_against_brute_force(docs, rows):
    tokens, c, pairs, n, v, fold = brute_lm(rows)
    got = {r.doc_id: r for r in lm_score.lm_score(docs).collect()}
    # the weights, fitted again on the same table of deleted counts
    starts = c[None]
    cells = []
    for d, ws in tokens:
        if not fold(d):
            for a, b in zip(["<s>", *ws], ws, strict=False):
                k = (starts if a == "<s>" else c[a]) - 1
                x = (pairs[a, b] - 1) / max(k, 1)
                y = (c[b] - 1) / (n - 1)
                cells.append((int(lm_score.bucket(np.array([k]))[0]) * lm_score.STEPS + int(lm_score.level(np.array([x]))[0])) * lm_score.STEPS + int(lm_score.level(np.array([y]))[0]))
    count = Counter(cells)
    lam = lm_score.weights(np.array(list(count)), np.array(list(count.values()), float), v)
    assert np.allclose(lam.sum(1), 1)
    for d, ws in tokens:
        r = got[d]
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(c[w] > 0 for w in ws), n, fold(d))
        assert abs(r.base_score - base) < 1e-6 * max(1, -base)
        score = 0.0
        for a, b in zip(["<s>", *ws], ws, strict=False):
            k = starts if a == "<s>" else c[a]
            w = lam[int(lm_score.bucket(np.array([k]))[0])]
            score += math.log10(w[0] * (pairs[a, b] / k if k else 0) + w[1] * c[b] / n + w[2] / (v + 1))
        assert abs(r.score - score) < 1e-6 * max(1, -score)


def test_lm_beats_the_base_on_held_out_text(docs):
    r = lm_score.lm_score(docs).filter("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r.s > r.b


def test_lm_odd_rows(odd, empty, docs):
    got = lm_score.lm_score(odd).collect()
    assert len(got) == 5 and all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert lm_score.lm_score(empty).count() == 0
    nothing = lm_score.lm_score(docs, held_out=F.lit(True)).collect()
    assert {(r.train_tokens, r.n_known) for r in nothing} == {(0, 0)} and all(abs(r.score) < 1e-9 for r in nothing)


def test_lm_pieces_of_one_block(docs, monkeypatch):
    """Arrow batches that cut blocks give the same scores."""
    one = {r.doc_id: r.score for r in lm_score.lm_score(docs).collect()}
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        monkeypatch.setattr(lm_score, "BLOCK_BYTES", 80 << 10)
        two = {r.doc_id: r.score for r in lm_score.lm_score(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(abs(one[d] - two[d]) < 1e-6 * max(1, abs(one[d])) for d in one)


# --- op10


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(packing.vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary("word_bpe_49k.json"))


def test_bpe_equals_the_library(codec, library, rows):
    rng = random.Random(5)
    pool = list("abcdefgthei '!?\n\t\x0b\x1c\x85\xa0ΣσςİßÉéÀ数字한국어🙂👍🏽0123456789٣ ́‍　$<|>") + ["<|endoftext|>", "<|startoftext|>", "the", "'s", "'LL", "ing", "ΑΣ "]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 80))) for _ in range(2000)] + [t or "" for _, t, *_ in rows]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert bpe.LibraryDecoder(codec).feed(ids).decode() == library.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("chunk, open_", [(1, 6), (2, 4), (3, 50), (7, 9), (64, 64)])
def test_bpe_in_chunks_equals_the_library(codec, library, monkeypatch, chunk, open_):
    """Whatever the chunks: special tokens, short forms, marks, Hangul and long words across their ends."""
    monkeypatch.setattr(bpe, "CHUNK", chunk)
    monkeypatch.setattr(bpe, "OPEN", open_)
    rng = random.Random(chunk)
    pool = list("abe's '!?\n\t\xa0ΣσİßÉ数字한\u1112\u1161\u11ab🙂123\u0301\u0323\u200d$<|>") + ["<|endoftext|>", "<|startoftext|>", "<|endof", "'s", "'LL", "'re", "ing", "e\u0323\u0301", "ΑΣ ", "    ", "the the", "word" * 5, "!" * 9, "'" * 7]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(0, 60))) for _ in range(700)] + ["<|startoftext|", "'", "e", ""]
    for text, ids in zip(texts, codec.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_bpe_holds_little(codec, library):
    """A word without an end goes on as a stream: what is held doesn't grow with it."""
    d, most, out = bpe.Transducer(codec), 0, b""
    for k in range(60):
        for w in d.feed("abcdefgh" * 2000, k == 59):
            out += w if isinstance(w, bytes) else codec.packed(codec.merges.words([w.encode()])[0])
        most = max(most, len(d.held) + len(d.raw) + len(d.tail) + (len(d.open.held) if d.open else 0))
    assert most < 20_000
    assert np.frombuffer(out, "<u4").tolist() == library.encode("abcdefgh" * 120_000, add_special_tokens=False).ids


def test_bpe_stream_is_stable_whatever_the_chunks(codec, library):
    rng = random.Random(6)
    for word in ("a" * 9000, "the" * 4000, "".join(rng.choice("abcdehinorst") for _ in range(12000)), "hahaha" * 1500):
        want = library.encode(word, add_special_tokens=False).ids
        for size in (1, 700, 5000):
            raw = word.encode()
            assert list(codec.merges.stream(raw[i : i + size] for i in range(0, len(raw), size))) == want
    held = codec.merges.lookahead
    assert 10 < held < 5000


def test_lookahead_bounds_every_change():
    """Tokens that end before the lookahead zone don't change, whatever is appended: all strings of a small list."""
    merges = [(b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"c", b"aba"), (b"ba", b"c")]
    zone = bpe.sufficient_lookahead(merges)

    def tokens(s):
        out = [s[i : i + 1] for i in range(len(s))]
        for a, b in merges:
            i, new = 0, []
            while i < len(out):
                if i + 1 < len(out) and (out[i], out[i + 1]) == (a, b):
                    new.append(a + b)
                    i += 2
                else:
                    new.append(out[i])
                    i += 1
            out = new
        return out

    def ends(t):
        at, out = 0, []
        for x in t:
            at += len(x)
            out.append(at)
        return out

    rng = random.Random(8)
    for _ in range(3000):
        s = bytes(rng.choice(b"abc") for _ in range(rng.randint(zone, zone + 12)))
        more = bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 6)))
        sure = [e for e in ends(tokens(s)) if e < len(s) - zone]
        assert sure == ends(tokens(s + more))[: len(sure)]


def test_bpe_query_and_tables(spark, docs, rows, odd, empty, library):
    path = packing.vocabulary("word_bpe_49k.json")
    texts = {d: t or "" for d, t, *_ in rows}
    got = docs.select("doc_id", "text").mapInArrow(bpe.digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string").collect()
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_ids(odd, path)
    assert sorted(len(r.ids) for r in encoded.collect())[:2] == [0, 0]
    assert {r.doc_id: r.text for r in bpe.decode_ids(encoded, path).collect()}[3] == "the other text "
    assert bpe.encode_ids(empty, path).count() == 0


def test_decoder_state_machine(codec):
    ids = np.frombuffer(codec.encode(["Ünïcode 数字 🙂"])[0], "<u4").tolist()
    one, two = bpe.Decoder(codec), bpe.Decoder(codec)
    assert one.feed(ids) + one.finish() == "".join([*(two.feed([i]) for i in ids), two.finish()]) == "ünïcode 数字 🙂 "
    raw, joined, parts = np.array(ids, "<u4").tobytes(), bpe.LibraryDecoder(codec), bpe.LibraryDecoder(codec)
    assert joined.feed(raw) == b"".join(parts.feed(raw[k : k + 4]) for k in range(0, len(raw), 4))


def test_vocabulary_spec_is_checked(tmp_path):
    bad = tmp_path / "v.json"
    bad.write_text(json.dumps({"added_tokens": [], "model": {"type": "Unigram"}}))
    with pytest.raises(ValueError):
        bpe.Merges(str(bad))
