"""Packing (op8): documents into sequences of at most 1024 tokens.

First-fit decreasing with a tournament tree of bin capacities, run independently in randomised groups. A document of
n tokens is cut into whole sequences and one rest; the rests of a group are packed, longest first, each into the
leftmost sequence that still has room. Groups have a fixed expected size, so neither time nor memory of a task grows
with the input, and the place of a piece depends on its group alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import keyed_hash, new_key
from .memory import lean, slices
from .scratch import Scratch, with_locator

LIMIT = 1024
END_ID = 0
#: Pieces expected in one group.
GROUP = 50_000
#: Texts of other bytes (controls, U+0080 to U+00BF, from U+0280) are encoded by the library in one piece.
PLAIN = np.zeros(256, bool)
PLAIN[[9, 10, 13, *range(32, 127), *range(128, 192), *range(0xC3, 0xCA)]] = True
#: Classes of the vocabulary's published split pattern: letters 0, digits 1, white space 2, other signs 3.
CLASS = np.full(256, 3, np.uint8)
CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 0
CLASS[48:58] = 1
CLASS[[9, 10, 13, 32]] = 2
#: An apostrophe before these letters can begin a word of its own: such texts go to the library whole as well.
SHORT_FORMS = np.zeros(256, bool)
SHORT_FORMS[list(b"stmdrvl")] = True
#: Words that a worker remembers, and words handed to the library at once.
CACHE, TOGETHER = 1_000_000, 200
#: Longer texts are cut where one space stands between two letters; there the split pattern always begins a word.
LONG = 1 << 20
SEAM = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")

_encoders: dict[str, "WordCache"] = {}


def word_starts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the words of the split pattern start, for texts of PLAIN without short forms.

    A word is a run of one class, with one space before it. White space before a word leaves its last character: a space
    goes to the word, another one stays alone.
    """
    cls = CLASS[data]
    signs = np.flatnonzero((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))  # the multiplication and division signs
    cls[signs] = cls[signs + 1] = 3
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    first = first[:-1]
    run = first.copy()
    run[1:] |= cls[1:] != cls[:-1]
    space = cls == 2
    start = run & space
    word = run & ~space
    before = np.flatnonzero(word & ~first) - 1
    start[before[space[before]]] = True
    joined = np.zeros(len(data), bool)
    joined[before[data[before] == 32] + 1] = True
    return np.flatnonzero(start | (word & ~joined))


class HashIndex:
    """Numbers of 64-bit keys, by open addressing in numpy; look-ups and additions take whole arrays. Never over half full."""

    def __init__(self, most: int):
        self._empty(max(4, (2 * most - 1).bit_length()))

    def _empty(self, bits: int) -> None:
        self.bits, self.count = bits, 0
        self.keys = np.zeros(1 << bits, np.uint64)
        self.values = np.zeros(1 << bits, np.int32)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for new ones."""
        out = np.full(len(h), -1, np.int32)
        todo, place = np.arange(len(h)), self._place(h)
        while len(todo):
            there = self.keys[place]
            hit = there == h[todo]
            out[todo[hit]] = self.values[place[hit]]
            more = ~hit & (there != 0)
            todo, place = todo[more], (place[more] + 1) & ((1 << self.bits) - 1)
        return out

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """New keys, each once and not zero."""
        if 2 * (self.count + len(h)) > len(self.keys):
            full = np.flatnonzero(self.keys)
            old = self.keys[full], self.values[full]
            self._empty((2 * (len(full) + len(h)) - 1).bit_length())
            self.add(*old)
        self.count += len(h)
        todo, place = np.arange(len(h)), self._place(h)
        while len(todo):
            free = np.flatnonzero(self.keys[place] == 0)
            at, pick = np.unique(place[free], return_index=True)
            won = free[pick]
            self.keys[at], self.values[at] = h[todo[won]], values[todo[won]]
            more = np.ones(len(todo), bool)
            more[won] = False
            todo, place = todo[more], place[more]
            place = np.where(self.keys[place] != 0, (place + 1) & ((1 << self.bits) - 1), place)


class WordCache:
    """Token ids of whole texts by the tokenizers library, each distinct word of a task encoded once.

    The vocabulary's split pattern cuts a text into words that encode alike wherever they stand, so ids are looked up
    by word (by 64-bit hashes under a key that each worker draws for itself, so no text can be written for two of its
    words to share one). Texts that the numpy form of the pattern doesn't cover go to the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        self.key = new_key()
        self.clear()

    def clear(self) -> None:
        self.index = HashIndex(CACHE + CACHE // 4)
        self.ids = np.zeros(1 << 16, "<u4")
        self.ends = np.zeros(1 << 16, np.int64)  # ends[k]: where the ids of word k - 1 end
        self.words = 0

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str], keys: np.ndarray) -> None:
        at = self.ends[self.words]
        for a in range(0, len(words), TOGETHER * 64):
            some = words[a : a + TOGETHER * 64]
            lists = [some[i : i + TOGETHER] for i in range(0, len(some), TOGETHER)]
            for k, e in enumerate(self.library.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = at + np.searchsorted(np.array(e.word_ids), np.arange(1, len(lists[k]) + 1))
                if at + len(ids) > len(self.ids):
                    self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(ids)), "<u4")])
                if self.words + len(ends) >= len(self.ends):
                    self.ends = np.concatenate([self.ends, np.zeros(max(len(self.ends), len(ends)), np.int64)])
                self.ids[at : at + len(ids)] = ids
                self.ends[self.words + 1 : self.words + 1 + len(ends)] = ends
                self.words += len(ends)
                at += len(ids)
        self.index.add(keys, np.arange(self.words - len(words), self.words, dtype=np.int32))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        cut = [seams(t) for t in texts]
        chunks = [c for some in cut for c in some]
        found = iter([ids for i, j in batches(chunks) for ids in self.short(chunks[i:j])])
        return [b"".join([next(found) for _ in some]) for some in cut]

    def short(self, texts: list[str]) -> list[bytes]:
        """The ids of a bounded number of texts."""
        if self.words > CACHE:
            self.clear()
        raw = [t.encode() for t in texts]
        plain = []
        for r in raw:
            b = np.frombuffer(r, np.uint8)
            quote = np.flatnonzero(b[:-1] == 39)
            plain.append(bool(len(b)) and PLAIN[b].all() and not SHORT_FORMS[b[quote + 1]].any() and not any(s in r for s in self.special))
        own = [r for r, p in zip(raw, plain, strict=True) if p]
        if own:
            data = np.frombuffer(b"".join(own), np.uint8)
            off = np.concatenate([[0], np.cumsum([len(r) for r in own])])
            start = word_starts(data, off)
            end = np.append(start[1:], len(data))
            key = keyed_hash(data, start, end, self.key) | np.uint64(1)
            word = self.index.find(key)
            new = np.flatnonzero(word < 0)
            if len(new):
                keys, where = np.unique(key[new], return_index=True)
                some = new[where]
                text = data.tobytes()
                self.learn([text[a:b].decode() for a, b in zip(start[some].tolist(), end[some].tolist(), strict=True)], keys)
                word[new] = self.index.find(key[new])
            size = self.ends[word + 1] - self.ends[word]
            total = np.concatenate([[0], np.cumsum(size)])
            ids = self.ids[np.repeat(self.ends[word] - total[:-1], size) + np.arange(total[-1])].tobytes()
            cut = (4 * total[np.searchsorted(start, off)]).tolist()
            found = iter([ids[a:b] for a, b in zip(cut, cut[1:], strict=False)])
        return [next(found) if p else self.whole(t) if t else b"" for t, p in zip(texts, plain, strict=True)]


def seams(text: str, most: int = LONG) -> list[str]:
    """The text in parts of about `most` characters that encode alike alone; in one where it has no seam."""
    out, at = [], 0
    while len(text) - at > most and (m := SEAM.search(text, at + most)):
        out.append(text[at : m.start()])
        at = m.start()
    out.append(text[at:] if at else text)
    return out


def encoder(path: str) -> WordCache:
    """One per Python worker."""
    if path not in _encoders:
        _encoders[path] = WordCache(path)
    return _encoders[path]


def batches(texts: list[str], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= most):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])


def cut_pieces(path: str, limit: int = LIMIT, end_id: int = END_ID):
    """A mapInArrow function from (doc_id, text, deal) to the pieces of each document, each with its document's deal."""
    tail = np.array([end_id], "<u4").tobytes()
    schema = PIECES.append(pa.field("deal", pa.int64()))

    def run(it):
        enc = encoder(path)
        for batch in (part for whole in it for part in slices(whole, "text", LONG)):
            rows = []
            for doc, raw, deal in zip(batch.column(0).to_pylist(), enc.encode([t or "" for t in batch.column(1).to_pylist()]), batch.column(2).to_pylist(), strict=True):
                raw += tail
                n = len(raw) // 4
                rows += [(doc, s, min(limit, n - s), zlib.crc32(raw[4 * s : 4 * (s + limit)]), n, deal) for s in range(0, n, limit)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=schema)

    return lean(run)


def first_fit(lengths: list[int], limit: int = LIMIT) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; lengths must fall. A tournament tree finds the leftmost bin with room.

    A node of the tree holds the larger capacity of its two children, the leaves are the bins from left to right.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [limit] * (2 * leaves)
    bins, offsets = [], []
    for n in lengths:
        k = 1
        while k < leaves:
            k *= 2
            if room[k] < n:
                k += 1
        bins.append(k - leaves)
        offsets.append(limit - room[k])
        room[k] -= n
        while k > 1:
            k //= 2
            best = room[2 * k] if room[2 * k] >= room[2 * k + 1] else room[2 * k + 1]
            if room[k] == best:
                break
            room[k] = best
    return bins, offsets


def pack_group(limit: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True, na_position="first")
        bins, offsets = first_fit(pdf["length"].tolist(), limit)
        return pdf.assign(sequence_id=np.array(bins, np.int64) + (int(key[0]) << 32), offset=np.array(offsets, np.int64))[[*PIECES.names, "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, path: str, limit: int = LIMIT, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text has the end id alone. Rows that share a doc_id are documents of their own; a null doc_id
    stays null. Documents are dealt to groups by the place where they are stored, so neither repeated rows nor rows
    without an id meet in one group. Empty table: empty result. Columns other than doc_id and text are ignored.
    path: a vocabulary file of the tokenizers library that each executor has.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    rows = with_locator(docs, scratch, ["doc_id", "text"])
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.substring_index("__loc_file", "/", -1), "__loc_row").alias("deal"))
    pieces = scratch.table(rows.mapInArrow(cut_pieces(path, limit, end_id), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal long"), "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("g", F.pmod("deal", F.lit(groups))).drop("deal").repartition(max(8, groups // 4), "g")
    return dealt.groupBy("g").applyInPandas(pack_group(limit), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the pieces of all `documents`."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), vocabulary("byte_bpe_50k.json"))
