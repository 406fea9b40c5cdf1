"""BPE encoding and decoding (op10): a bounded-lookahead streaming transducer and an incremental decoder.

A text comes in chunks. The transducer passes on what no later chunk can change: the text before a possible special
token, before the last character that a combining mark could still change, the words before the last one, and inside a
word the tokens that end before the merge list's lookahead.

A merge list has a sufficient lookahead: appending text changes only tokens that end within so many bytes of the old
end (`sufficient_lookahead`). An open word's buffer is tokenized, the tokens that end before that zone are emitted and
the buffer goes on from the last emitted boundary; a boundary of the final result splits the input into parts that
tokenize independently, so what is emitted never changes. What a text holds is a chunk, the buffer of its open word and
a run of combining marks, whatever its length. Words that end inside a chunk are final at once; the texts of a batch
take turns, a chunk each, and their new words are merged together in numpy.

Decoding is a state machine over tokens: it holds the bytes of an unfinished character, or in the library's form whether
a separator is due.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .memory import lean, slices
from .packing import vocabulary

NO_RANK = np.int64(1 << 40)
#: Words of at most so many bytes are merged together in numpy; longer ones go through the stream.
SHORT = 64
CACHE = 300_000
#: Characters of a text that are taken at once, and of an unfinished word that goes on as a stream.
CHUNK, OPEN = 1 << 16, 4096


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes before the end of the input in which appended bytes can still change tokens.

    A rule (u, v) carries a change from the token that starts where v starts to the token u before it. The next rule
    of such a chain has a later rank, and its right side starts with the token at the new boundary, so with u. The
    longest chain, with the right side that holds the end, bounds the zone.
    """
    reach: dict[bytes, int] = {}
    most = max((len(u) + len(v) for u, v in merges), default=1)
    for u, v in merges:
        far = len(v)
        for k in range(1, len(v) + 1):
            far = max(far, reach.get(v[:k], 0))
        far += len(u)
        most = max(most, far)
        if far > reach.get(u, 0):
            reach[u] = far
    return most


class Merges:
    """A byte-level merge list with an end-of-word suffix on the last byte of a word."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("unk_token") or model.get("byte_fallback"):
            raise ValueError("a byte-level BPE vocabulary is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = dict(model["vocab"])
        letters = byte_letters()
        back = {c: i for i, c in enumerate(letters)}
        self.tokens: dict[int, str] = {i: t for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens |= {i: t for t, i in self.special.items()}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in letters], np.int64)
        self.width = max(self.tokens) + 1
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)

        def raw(t: str) -> bytes:
            end = bool(self.suffix) and t.endswith(self.suffix)
            return bytes(back[c] for c in (t[: -len(self.suffix)] if end else t)) + b"\xff" * end  # the suffix counts as a byte

        self.lookahead = sufficient_lookahead([(raw(a), raw(b)) for a, b in pairs])
        self.bytes = {i: bytes(back[c] for c in (t.removesuffix(self.suffix) if self.suffix else t)) for i, t in self.tokens.items() if i not in self.special.values()}

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Applies the list to each row of symbols (-1 pads the end): the leftmost pair of least rank first, again and again."""
        n, width = symbols.shape
        if width < 2:
            return symbols
        ranks = self.rank(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, width - 1)
        live = np.arange(n)
        out = symbols.copy()
        cols = np.arange(width)
        while len(live):
            at = ranks.argmin(1)
            least = ranks[np.arange(len(live)), at]
            more = least < NO_RANK
            out[live[~more]] = symbols[~more]
            live, symbols, ranks, at, least = live[more], symbols[more], ranks[more], at[more], least[more]
            if not len(live):
                break
            row = np.arange(len(live))
            symbols[row, at] = self.made[least]
            take = cols[None, :] + (cols[None, :] > at[:, None])
            symbols = np.where(take < width, np.take_along_axis(symbols, np.minimum(take, width - 1), 1), -1)
            shift = cols[None, : width - 1] + (cols[None, : width - 1] > at[:, None])
            ranks = np.where(shift < width - 1, np.take_along_axis(ranks, np.minimum(shift, width - 2), 1), NO_RANK)
            ranks[row, np.minimum(at, width - 2)] = np.where(at < width - 1, self.rank(symbols[row, np.minimum(at, width - 2)], symbols[row, np.minimum(at, width - 2) + 1]), NO_RANK)
            left = at > 0
            ranks[row[left], at[left] - 1] = self.rank(symbols[row[left], at[left] - 1], symbols[row[left], at[left]])
        return out

    def words(self, found: list[bytes]) -> list[np.ndarray]:
        """Token ids of whole words."""
        out: list[np.ndarray] = [None] * len(found)
        size = np.array([len(w) for w in found])
        for low, high in ((1, 4), (5, 8), (9, 12), (13, 16), (17, 24), (25, 32), (33, SHORT)):
            rows = np.flatnonzero((size >= low) & (size <= high))
            if not len(rows):
                continue
            width = int(size[rows].max())
            pad = np.frombuffer(b"".join(found[i].ljust(width, b"\0") for i in rows), np.uint8).reshape(len(rows), width)
            symbols = self.first[pad]
            symbols[np.arange(len(rows)), size[rows] - 1] = self.last[pad[np.arange(len(rows)), size[rows] - 1]]
            symbols[np.arange(width)[None, :] >= size[rows][:, None]] = -1
            merged = self.merge(symbols)
            for i, r in zip(rows.tolist(), merged, strict=True):
                out[i] = r[r >= 0]
        for i in np.flatnonzero(size > SHORT).tolist():
            out[i] = np.fromiter(self.stream([found[i]]), np.int64)
        return out

    def stream(self, chunks):
        """Token ids of one word that comes in chunks of bytes, each as soon as it is stable."""
        word = WordStream(self)
        for chunk in chunks:
            yield from word.feed(chunk).tolist()
        yield from word.finish().tolist()

    def one(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of one row and where each ends. Merges every pair of the least rank at once, left to right."""
        symbols, size = symbols.copy(), np.ones(len(symbols), np.int64)
        while len(symbols) > 1:
            ranks = self.rank(symbols[:-1], symbols[1:])
            least = ranks.min()
            if least == NO_RANK:
                break
            at = np.flatnonzero(ranks == least)
            if len(at) > 1 and (np.diff(at) == 1).any():  # aaa: the left pair goes first
                run = np.cumsum(np.r_[True, np.diff(at) != 1])
                first = at[np.searchsorted(run, run)]
                at = at[(at - first) % 2 == 0]
            symbols[at] = self.made[least]
            size[at] += size[at + 1]
            symbols, size = np.delete(symbols, at + 1), np.delete(size, at + 1)
        return symbols, np.cumsum(size)


class WordStream:
    """One word that comes in chunks of bytes. Holds a few times the lookahead."""

    def __init__(self, merges: Merges):
        self.merges, self.held = merges, b""
        self.hold = 2 * merges.lookahead + 64

    def feed(self, chunk: bytes) -> np.ndarray:
        out = [np.zeros(0, np.int64)]
        for k in range(0, len(chunk), self.hold):
            self.held += chunk[k : k + self.hold]
            if len(self.held) > 2 * self.hold:
                ids, ends = self.merges.one(self.merges.first[np.frombuffer(self.held, np.uint8)])
                sure = int(np.searchsorted(ends, len(self.held) - self.merges.lookahead - 1, "right"))
                out.append(ids[:sure])
                self.held = self.held[int(ends[sure - 1]) if sure else 0 :]
        return np.concatenate(out)

    def finish(self) -> np.ndarray:
        if not self.held:
            return np.zeros(0, np.int64)
        symbols = self.merges.first[np.frombuffer(self.held, np.uint8)]
        symbols[-1] = self.merges.last[self.held[-1]]
        return self.merges.one(symbols)[0]


#: The vocabulary's split pattern, and the characters that its pattern takes as white space.
SPACE = r"\t-\r \x85\xa0  -     　"
LETTERS, SIGNS = r"[\p{L}]+", rf"[^{SPACE}\p{{L}}\p{{N}}]+"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d|{LETTERS}|[\p{{N}}]|{SIGNS}"
#: A match that ends so many characters before the end of what is known can't change (a short form has three).
AHEAD = 3


@cache
def joining() -> frozenset[str]:
    """Characters that composition can tie to the one before them: marks, and second halves of composed characters."""
    out = {chr(c) for a, b in ((0x1161, 0x1176), (0x11A8, 0x11C3)) for c in range(a, b)}  # vowels and finals of Hangul
    for c in range(0x110000):
        if unicodedata.combining(chr(c)):
            out.add(chr(c))
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            out.add(chr(int(parts[1], 16)))
    return frozenset(out)


class Transducer:
    """A text in chunks to its parts: words as strings, finished ids as bytes."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.held = ""  # may begin a special token
        self.raw = ""  # may be changed by a mark
        self.tail = ""  # normalised, may belong to an unfinished word
        self.open: WordStream | None = None
        self.kind = ""

    def feed(self, chunk: str, last: bool = False) -> list[str | bytes]:
        out: list[str | bytes] = []
        held, at = self.held + chunk, 0
        if self.codec.special_at:
            while m := self.codec.special_at(held, at):
                self.plain(held[at : m.start()], True, out)
                out.append(self.codec.packed([self.codec.merges.special[m.group()]]))
                at = m.end()
        keep = 0 if last else self.codec.unfinished_special(held, at)
        self.held = held[len(held) - keep :]
        self.plain(held[at : len(held) - keep], last, out)
        return out

    def plain(self, part: str, closed: bool, out: list) -> None:
        """Text without special tokens; closed: the word before its end is finished."""
        raw = self.raw + part
        cut = len(raw)
        if not closed and raw:
            cut -= 1
            while cut and not raw[cut].isascii() and raw[cut] in joining():
                cut -= 1
        now, self.raw = raw[:cut], raw[cut:]
        if not now.isascii():
            now = unicodedata.normalize("NFC", now).replace("Σ", "σ")  # lower case goes letter by letter: no final sigma
        tail = self.tail + now.lower()
        self.tail = ""
        if self.open:
            m = self.codec.runs[self.kind](tail)
            end = m.end() if m else 0
            out.append(self.codec.packed(self.open.feed(tail[:end].encode())))
            if end == len(tail) and not closed:
                return
            out.append(self.codec.packed(self.open.finish()))
            self.open, tail = None, tail[end:]
        if closed:
            out += self.codec.find(tail)
            return
        rest = len(tail)
        for m in self.codec.each(tail):
            if m.end() > len(tail) - AHEAD:
                rest = m.start()
                break
            out.append(m.group())
        tail = tail[rest:]
        if len(tail) > OPEN:
            for kind, run in self.codec.runs.items():
                m = run(tail)
                if m and m.end() > OPEN - AHEAD:
                    self.open, self.kind = WordStream(self.codec.merges), kind
                    out.append(self.codec.packed(self.open.feed(m.group().encode())))
                    tail = tail[m.end() :]
                    if tail:
                        out.append(self.codec.packed(self.open.finish()))
                        self.open = None
                    break
        self.tail = tail


class Codec:
    """Encodes and decodes texts; keeps the tokens of up to CACHE words."""

    def __init__(self, path: str):
        import regex

        self.merges = Merges(path)
        pattern = regex.compile(PATTERN)
        self.find, self.each = pattern.findall, pattern.finditer
        self.runs = {kind: regex.compile(kind).match for kind in (LETTERS, SIGNS)}
        special = sorted(self.merges.special, key=len, reverse=True)
        if any(a != b and b.startswith(a) for a in special for b in special):
            raise ValueError("a special token begins another")
        self.special_at = regex.compile("|".join(map(regex.escape, special))).search if special else None
        self.beginnings = {t[:k] for t in special for k in range(1, len(t))}
        self.longest = max(map(len, special), default=0)
        self.ids: dict[str, bytes] = {}
        self.named = {i: t.encode() for i, t in self.merges.tokens.items()}

    @staticmethod
    def packed(ids) -> bytes:
        return np.asarray(ids).astype("<u4").tobytes()

    def unfinished_special(self, text: str, at: int) -> int:
        """Length of the longest end of text[at:] that begins a special token."""
        return next((k for k in range(min(self.longest - 1, len(text) - at), 0, -1) if text[len(text) - k :] in self.beginnings), 0)

    def learn(self, words: list[str]) -> None:
        for w, ids in zip(words, self.merges.words([w.encode() for w in words]), strict=True):
            self.ids[w] = self.packed(ids)

    def rounds(self, texts: list[str]) -> Iterator[list[tuple[int, bytes]]]:
        """The texts take turns, a chunk each: (text, its next ids as little-endian unsigned 32-bit integers)."""
        live = [(k, t, Transducer(self)) for k, t in enumerate(texts) if t]
        at = 0
        while live:
            if len(self.ids) > CACHE:
                self.ids.clear()
            parts = [(k, d.feed(t[at : at + CHUNK], at + CHUNK >= len(t))) for k, t, d in live]
            self.learn(list({w for _, p in parts for w in p if isinstance(w, str) and w not in self.ids}))
            get = self.ids.__getitem__
            yield [(k, b"".join([get(w) if isinstance(w, str) else w for w in p])) for k, p in parts]
            at += CHUNK
            live = [(k, t, d) for k, t, d in live if at < len(t)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        out: list[list[bytes]] = [[] for _ in texts]
        for turn in self.rounds(texts):
            for k, ids in turn:
                out[k].append(ids)
        return [b"".join(x) for x in out]


class Decoder:
    """Ids in pieces to text, each piece's as soon as its characters are complete."""

    def __init__(self, codec: Codec):
        self.codec = codec
        self.bytes = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        merges, out = self.codec.merges, []
        for i in ids:
            if i in merges.bytes:
                out.append(self.bytes.decode(merges.bytes[i]))
                if merges.suffix and merges.tokens[i].endswith(merges.suffix):
                    out.append(self.bytes.decode(b" "))
            else:
                out.append(self.bytes.decode(b"", True) + merges.tokens[i])
                self.bytes.reset()
        return "".join(out)

    def finish(self) -> str:
        return self.bytes.decode(b"", True)


class LibraryDecoder:
    """Ids in pieces to the bytes of what the library's decode gives where a file names no decoder: the tokens' letters, with a space between."""

    def __init__(self, codec: Codec):
        self.named, self.due = codec.named, b""

    def feed(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        before, self.due = self.due, b" "
        return before + b" ".join([self.named[i] for i in np.frombuffer(ids, "<u4").tolist()])


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One per Python worker."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(path: str):
    def run(it):
        c = codec(path)
        for batch in (part for whole in it for part in slices(whole, "text")):
            docs, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            n, of_ids, of_text, decoders = [0] * len(texts), [hashlib.sha256() for _ in texts], [hashlib.sha256() for _ in texts], [LibraryDecoder(c) for _ in texts]
            for turn in c.rounds(texts):
                for k, ids in turn:
                    n[k] += len(ids) // 4
                    of_ids[k].update(ids)
                    of_text[k].update(decoders[k].feed(ids))
            cols = docs, n, [h.hexdigest() for h in of_ids], [h.hexdigest() for h in of_text]
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(cols, OUT, strict=True)], schema=OUT)

    return lean(run)


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>: the operator's real output. Null counts as empty; other columns are ignored."""

    def run(it):
        c = codec(path)
        for batch in (part for whole in it for part in slices(whole, "text")):
            ids = [np.frombuffer(b, "<u4").astype(np.int32) for b in c.encode([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, ids array<int>")


def decode_ids(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of (doc_id, ids) by the incremental state machine. Null ids: empty text."""

    def run(it):
        c = codec(path)
        for batch in it:
            texts = []
            for ids in batch.column(1).to_pylist():
                d = Decoder(c)
                texts.append(d.feed(ids or []) + d.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(lean(run), "doc_id long, text string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: n_tokens and digests of every document's ids and decoded text.

    Null and empty texts have no tokens. Rows stay as they are, repeated ones too; a null doc_id stays null.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id AS long) AS doc_id", "text")
    return docs.mapInArrow(digests(vocabulary("word_bpe_49k.json")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
