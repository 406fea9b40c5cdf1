"""Suffix-array dedup (op1): removes bytes of every long string that an earlier document has too.

Every window of LENGTH bytes has one anchor, the leftmost least SEED-gram hash inside it, so equal windows have equal
anchors at the same offset. The corpus exchanges anchors only:

1. blocks (runs of stored rows of similar length, bounded in bytes) send the distinct anchors to parts (ranges of anchor
   hashes); a part returns which anchors more than one document has;
2. blocks send, for those anchors, the bytes around them (once per block for equal ones, with the least doc_id); a
   part sorts the suffixes that start at the windows, and equal neighbours in the suffix array give the least
   document of each window; it returns one bit per window;
3. blocks mark the windows and cut the text.

The suffix sort is a mergesort whose comparisons are logarithmic: prefix polynomial hashes and binary search find the
common extension of two suffixes, and neighbours that count as equal are verified byte by byte.

Copies of a whole text are not sent: all but the one with the least doc_id go without a window being looked at.

The windows of an anchor that very many blocks have are sent by themselves, each to the part of its own hash, so that no
part gets all that stands around a line which a third of all documents share.

A message holds the keys of one block for one part, so there are at most as many messages as keys, and only parts that
a block has keys for are visited. The numbers of parts and tasks follow the size of the text.

The larger a corpus, the more of its anchors repeat, up to all of them, and what stands around anchors is several times
the text. So step 2 goes round by round over ranges of parts, and entries pass through the shuffle only. The answers in step
1 tell about how many parts keep the entries of the first round within the size of the text; from then on the bytes that
parts were sent tell it.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import BASE, BASE_INV, TABLE, flat, mix, pack, pieces, powers, prefix_hash, span_hash, unpack
from .exchange import block_columns, by_piece, part_of, part_runs, unzipped, zipped
from .memory import lean_groups
from .scratch import Scratch, with_locator

LENGTH, SEED = 50, 20
#: Most bytes of a block of several rows, and text for one part and for one task.
BLOCK_BYTES, PART_BYTES, TASK_BYTES = 16 << 20, 16 << 20, 16 << 20
#: Bytes scanned at once.
PIECE = 1 << 18
#: Windows sorted at once in a task, unless a single anchor has more.
TOGETHER = 250_000
KEY_BYTES = 6
#: Pieces of blocks that have an anchor from which on it is frequent.
FREQUENT = 128
#: Bytes of an entry in the shuffle (41.6 measured over 0.1 GB), and windows of an anchor.
ENTRY_BYTES, WINDOWS = 42, 16
#: The first round, of which no bytes are known yet, has room for so many times what is expected: a key can have several entries in a block.
ROOM = 3


# --- anchors -------------------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, off: np.ndarray, length: int, seed: int):
    """Runs of windows with a common anchor: text index, first window start, number of windows, anchor place and hash, hash of the context."""
    n = len(data)
    empty = np.zeros(0, np.int64)
    none = (empty, empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64))
    if n < length:
        return none
    h = prefix_hash(data)
    g = h[seed:] - h[: n + 1 - seed]
    g *= powers(BASE_INV, n + 1)[: n + 1 - seed]
    g = mix(g)
    low = (g & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    have, want = 1, length - seed + 1
    while have < want:
        step = min(have, want - have)
        low = np.minimum(low[:-step], low[step:])
        have += step
    inside = np.zeros(n + 1, np.int32)  # above zero where a window of its text starts
    long_ = np.flatnonzero(np.diff(off) >= length)
    inside[off[long_]] += 1
    inside[off[long_ + 1] - length + 1] -= 1
    start = np.flatnonzero(np.cumsum(inside[: n - length + 1]))
    if not len(start):
        return none
    place = (low[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.searchsorted(off, start[np.flatnonzero(np.r_[True, np.diff(start) > 1])], "right") - 1  # of each run of starts
    text = np.repeat(text, np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(start) > 1]), len(start)]))
    new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])])
    first, count = start[new], np.diff(np.r_[new, len(start)])
    # least hashes lie close to zero: mixed again, they fall evenly into the parts
    return text[new], first, count, place[new], mix(g[place[new]] + np.uint64(SEED)), mix(span_hash(h, first, first + count + length - 1))


def scan(column, length: int, seed: int):
    """Anchor runs of all texts of a column, in text order, with places relative to the whole buffer.

    A text of over PIECE bytes is scanned in pieces that overlap by a window less a byte; a run can end at their seam.
    """
    data, off = flat(column)
    out = []

    def add(a: int, b: int, edges: np.ndarray, first: int) -> None:
        t, s, m, p, g, c = anchors(data[a:b], edges, length, seed)
        out.append(((t + first).astype(np.int32), (s + a).astype(np.int32), m.astype(np.uint8), (p + a).astype(np.int32), g, c))

    for i, j in pieces(off, PIECE):
        if off[j] - off[i] <= PIECE or j > i + 1:
            add(int(off[i]), int(off[j]), off[i : j + 1] - off[i], i)
        else:
            for a in range(int(off[i]), int(off[j]) - length + 1, PIECE):
                b = min(int(off[j]), a + PIECE + length - 1)
                add(a, b, np.array([0, b - a]), i)
    types = (np.int32, np.int32, np.uint8, np.int32, np.uint64, np.uint64)
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, t) for t in types]
    return data, off, *cols


def short_keys(g: np.ndarray) -> np.ndarray:
    return g >> np.uint64(64 - 8 * KEY_BYTES)


# --- 1: which anchors repeat ---------------------------------------------------------------------------------------

ANCHORS = "part int, block long, piece long, keys binary, several binary"
REPEATS = "block long, piece long, part int, repeats binary, due long"


def send_anchors(parts: int, length: int, seed: int):
    def work(block, piece, table):
        _, _, text, _, _, _, g, _ = scan(table["text"], length, seed)
        ids = table["doc_id"].to_numpy()[text] if len(text) else np.zeros(0, np.int64)
        order = np.lexsort((ids, g))
        g, ids = short_keys(g[order]), ids[order]
        first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
        keys = g[first]
        several = ids[first] != ids[np.r_[first[1:], len(g)] - 1] if len(g) else np.zeros(0, bool)
        rows = part_runs(keys, 8 * KEY_BYTES, parts)
        return pa.table(
            {
                "part": pa.array([p for p, _, _ in rows], pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "piece": pa.array([piece] * len(rows), pa.int64()),
                "keys": pa.array([pack(keys[a:z], KEY_BYTES) for _, a, z in rows], pa.binary()), "several": pa.array([np.packbits(several[a:z]).tobytes() for _, a, z in rows], pa.binary()),
            }
        )

    return by_piece(work)


def find_repeats(table: pa.Table, frequent: int | None = None) -> pa.Table:
    """Two bits per sent key, one list after the other: more than one document can have it, and it is frequent. due: about so many entries follow.

    Pieces hold different rows, so a key of two pieces counts as repeated. Frequent ones are those of many pieces.
    """
    blobs = table["keys"].to_pylist()
    lens = [len(b) // KEY_BYTES for b in blobs]
    _, at, n = np.unique(np.concatenate([unpack(b, KEY_BYTES) for b in blobs]), return_inverse=True, return_counts=True)
    several = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=k).astype(bool) for b, k in zip(table["several"].to_pylist(), lens, strict=True)])
    yes = (n > 1)[at]
    inside = np.zeros(len(n), bool)
    inside[at[several]] = True
    yes |= inside[at]
    often = (n >= (frequent or FREQUENT))[at]
    ends = np.cumsum(lens)
    bits = [zipped(np.packbits(yes[e - k : e]).tobytes() + np.packbits(often[e - k : e]).tobytes()) for e, k in zip(ends, lens, strict=True)]
    due = [int(yes[e - k : e].sum() + (WINDOWS - 1) * (yes & often)[e - k : e].sum()) for e, k in zip(ends, lens, strict=True)]
    return pa.table({"block": table["block"], "piece": table["piece"], "part": table["part"], "repeats": pa.array(bits, pa.binary()), "due": pa.array(due, pa.int64())})


# --- 2: windows around repeated anchors ----------------------------------------------------------------------------

ENTRIES = "part int, block long, n int, entries binary"
BITS = "block long, part int, bits binary, sent long"


def same_bytes(data: np.ndarray, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[x : x + size] and data[y : y + size] are equal, for each pair."""
    same = np.ones(len(x), bool)
    step = 8 if len(size) and size.min() >= 8 else 1
    word = np.ndarray(max(0, len(data) - step + 1), f"<u{step}", np.ascontiguousarray(data), strides=(1,))  # the bytes at each place
    for k in range(0, int(size.max()) if len(size) else 0, step):
        at = np.minimum(k, size - step)
        same &= word[x + at] == word[y + at]
    return same


def window_hashes(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    for a in range(0, len(start), 4096):
        out[a : a + 4096] = (TABLE[data[start[a : a + 4096, None] + np.arange(length)]] * powers(BASE, length)).sum(1, dtype=np.uint64)
    return mix(out)


class Block:
    """A block's rows in stored order, its anchor runs and which of them repeat. Two readings give the same.

    The windows of a frequent anchor are runs of their own, under the hash of the window instead of the anchor's: what
    stands around a line that a third of all documents share differs, and so does the part that it goes to.
    span: the range of parts whose runs count.
    """

    def __init__(self, left: pa.Table, right: pa.Table, parts: int, length: int, seed: int, span: tuple[int, int] | None = None):
        self.rows = left.sort_by("__loc_row")
        self.length = length
        at = self.rows["__loc_row"].to_numpy()
        got: dict[int, dict[int, bytes]] = {}
        least: dict[bytes, int] = {}
        for piece, part, bits, copies in zip(*(right[c].to_pylist() for c in ("piece", "part", "repeats", "copies")), strict=True):
            if copies is None:
                got.setdefault(piece, {})[part] = bits
            else:
                least |= {c["sha"]: c["least"] for c in copies}
        self.ids = self.rows["doc_id"].to_numpy()
        self.data, self.off, text, start, count, place, g, same = scan(self.rows["text"], length, seed)
        self.copy = np.zeros(len(at), bool)
        if least:
            for r, (a, z) in enumerate(zip(self.off.tolist(), self.off[1:].tolist(), strict=False)):
                self.copy[r] = self.ids[r] > least.get(hashlib.sha256(self.data[a:z]).digest(), self.ids[r])
        keys = short_keys(g)
        repeats, frequent = np.zeros((2, len(keys)), bool)
        starts = sorted(got)
        cuts = [*np.searchsorted(at, starts).tolist(), len(at)]
        for piece, a, z in zip(starts, cuts, cuts[1:], strict=False):
            lo, hi = np.searchsorted(text, [a, z])
            own, inverse = np.unique(keys[lo:hi], return_inverse=True)
            flags = np.zeros((2, len(own)), bool)
            for part, i, j in part_runs(own, 8 * KEY_BYTES, parts):
                bits = np.frombuffer(unzipped(got[piece][part]), np.uint8).reshape(2, -1)
                flags[:, i:j] = np.unpackbits(bits, axis=1, count=j - i)
            repeats[lo:hi], frequent[lo:hi] = flags[:, inverse]
        repeats &= ~self.copy[text] if len(text) else repeats
        cols = [x[repeats & ~frequent] for x in (text, start, count, place, g, same)]
        often = np.flatnonzero(repeats & frequent)
        if len(often):
            n = count[often].astype(np.int64)
            at = (np.repeat(start[often] - (np.cumsum(n) - n), n) + np.arange(n.sum())).astype(np.int32)
            window = window_hashes(self.data, at, length)
            alone = [np.repeat(text[often], n), at, np.ones(len(at), np.uint8), at, mix(window + np.uint64(length)), window]
            cols = [np.concatenate(c) for c in zip(cols, alone, strict=True)]
        if span:
            part = part_of(cols[4], 64, parts)
            cols = [c[(part >= span[0]) & (part < span[1])] for c in cols]
        self.text, self.start, self.count, self.place, self.g, same = cols
        del text, start, count, place, g, keys, cols
        # equal contexts of a block are one entry, with the least doc_id
        lead = self.place - self.start
        order = np.lexsort((self.ids[self.text] if len(self.text) else self.text, same, lead, self.count, self.g))
        new = np.ones(len(order), bool)
        if len(order):
            new[1:] = np.any([c[order[1:]] != c[order[:-1]] for c in (self.g, self.count, lead, same)], 0)
            at = np.flatnonzero(~new)
            for a in range(0, len(at), 1 << 18):  # one hash and other bytes: an entry of its own
                some = at[a : a + (1 << 18)]
                size = self.count[order[some]].astype(np.int64) + length - 1
                new[some] = ~same_bytes(self.data, self.start[order[some - 1]], self.start[order[some]], size)
        self.entry = np.empty(len(order), np.int32)
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]  # the run that stands for each entry
        self.parts = part_runs(self.g[self.head], 64, parts)


def send_entries(parts: int, length: int, seed: int, span: tuple[int, int] | None = None):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, right, parts, length, seed, span)
        out: dict[str, list] = {"part": [], "n": [], "entries": []}
        for p, i, j in b.parts:
            own = b.head[i:j]
            size = b.count[own].astype(np.int64) + length - 1
            at = np.repeat(b.start[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            cols = [b.g[own].astype("<u8"), b.ids[b.text[own]].astype("<i8"), b.count[own].astype("<u1"), (b.place[own] - b.start[own]).astype("<u1"), b.data[at]]
            out["part"].append(p)
            out["n"].append(len(own))
            out["entries"].append(zipped(b"".join(np.ascontiguousarray(c).tobytes() for c in cols)))
        n = len(out["part"])
        return pa.table({"part": pa.array(out["part"], pa.int32()), "block": pa.array([left["block"][0].as_py()] * n if left.num_rows else [], pa.int64()), "n": pa.array(out["n"], pa.int32()), "entries": pa.array(out["entries"], pa.binary())})

    return lean_groups(run)


# --- the suffix sort -----------------------------------------------------------------------------------------------


def extension(h: np.ndarray, x: np.ndarray, y: np.ndarray, differ: np.ndarray, limit: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, up to limit: binary search over prefix hashes.

    differ: where the hashes of the whole `limit` bytes differ; elsewhere the prefix is common in full.
    """
    common = np.full(len(x), limit)
    todo = np.flatnonzero(differ)
    got = np.zeros(len(todo), np.int64)
    step = 1 << (max(1, limit) - 1).bit_length()
    a, b = x[todo], y[todo]
    while step:
        can = got + step <= limit
        far = np.where(can, got + step, got)
        equal = can & (span_hash(h, a + got, a + far) == span_hash(h, b + got, b + far))
        got = np.where(equal, far, got)
        step //= 2
    common[todo] = got
    return common


def suffix_sort(data: np.ndarray, h: np.ndarray, starts: np.ndarray, group: np.ndarray, limit: int) -> np.ndarray:
    """Order of the suffixes by their first `limit` bytes within each group; `group` must not fall. Equal ones keep their order.

    A bottom-up mergesort of all groups at once: each element finds its place in the neighbouring run by binary search.
    """
    n = len(starts)
    if not n:
        return np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[first, n])
    full = span_hash(h, starts, starts + limit)

    def less(a: np.ndarray, b: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        """Whether suffix a goes before suffix b."""
        x, y = starts[a], starts[b]
        common = extension(h, x, y, full[a] != full[b], limit)
        k = np.minimum(common, limit - 1)
        return np.where(common == limit, or_equal, data[x + k] < data[y + k])

    begin, end = np.repeat(first, sizes), np.repeat(first + sizes, sizes)
    rel = np.arange(n) - begin
    order = np.arange(n)
    run = 1
    while run < sizes.max():
        side = rel // run
        low = begin + (side ^ 1) * run
        # two runs that are in order already stay: only the last of the one and the first of the other are compared
        second = np.flatnonzero((side & 1 == 1) & (rel % run == 0))
        second = second[~less(order[second - 1], order[second], np.ones(len(second), bool))]
        moved = np.zeros(n, bool)
        moved[second] = True
        pairs = begin + (side | 1) * run  # where the second run of an element's pair begins
        live = np.flatnonzero((pairs < end) & moved[np.minimum(pairs, n - 1)])
        lo, hi = low[live], np.minimum(low[live] + run, end[live])
        base = lo.copy()
        right = (side[live] & 1).astype(bool)
        while True:  # how many of the other run go before: the smaller ones, for a right run also the equal ones
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            before = less(order[mid], order[live[open_]], right[open_])
            lo[open_] = np.where(before, mid + 1, lo[open_])
            hi[open_] = np.where(before, hi[open_], mid)
        pair = begin[live] + (side[live] & ~1) * run
        place = pair + (rel[live] - side[live] * run) + (lo - base)
        merged = order.copy()
        merged[place] = order[live]
        order = merged
        run *= 2
    return order


def equal_runs(data: np.ndarray, h: np.ndarray, starts: np.ndarray, group: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """For the sorted suffixes, the number of the class of equal ones; verified byte by byte."""
    x, y = starts[order[:-1]], starts[order[1:]]
    full = span_hash(h, starts, starts + limit)[order]
    same = (group[order[1:]] == group[order[:-1]]) & (full[1:] == full[:-1])
    at = np.flatnonzero(same)
    step = 8 if limit >= 8 else 1
    word = np.ndarray(max(0, len(data) - step + 1), f"<u{step}", np.ascontiguousarray(data), strides=(1,))  # the bytes at each place
    for a in range(0, len(at), 1 << 18):
        some = at[a : a + (1 << 18)]
        differ = np.zeros(len(some), bool)
        for k in [*range(0, limit - step, step), limit - step]:
            differ |= word[x[some] + k] != word[y[some] + k]
        if differ.any():  # two strings with one hash: sort this group by its bytes
            bad = np.isin(group, np.unique(group[order[some[differ]]]))
            rows = np.flatnonzero(bad)
            by_bytes = sorted(rows.tolist(), key=lambda r: (group[r], data[starts[r] : starts[r] + limit].tobytes(), r))
            order[np.flatnonzero(bad[order])] = by_bytes
            xs, ys = starts[order[:-1]], starts[order[1:]]
            for i in np.flatnonzero(bad[order[:-1]] & bad[order[1:]]).tolist():
                same[i] = group[order[i]] == group[order[i + 1]] and bytes(data[xs[i] : xs[i] + limit]) == bytes(data[ys[i] : ys[i] + limit])
            return np.cumsum(np.r_[0, ~same])
    return np.cumsum(np.r_[0, ~same])


def mark(length: int, together: int = TOGETHER):
    """For each entry, a bit for each of its windows: a smaller document has it as well. sent: bytes of the message."""

    def run(table: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], []]
        for n, blob in zip(table["n"].to_pylist(), table["entries"].to_pylist(), strict=True):
            raw = unzipped(blob)
            cols[0].append(np.frombuffer(raw, "<u8", n))
            cols[1].append(np.frombuffer(raw, "<i8", n, 8 * n))
            cols[2].append(np.frombuffer(raw, "<u1", n, 16 * n))
            cols[3].append(np.frombuffer(raw, "<u1", n, 17 * n))
            cols[4].append(np.frombuffer(raw, np.uint8, -1, 18 * n))
        g, ids, count, lead, data = map(np.concatenate, cols)
        del cols
        count, lead = count.astype(np.int64), lead.astype(np.int64)
        size = count + length - 1
        begin = np.cumsum(size) - size
        bits = np.zeros(len(g), np.uint32)
        order = np.argsort(g, kind="stable")
        edges = np.flatnonzero(np.r_[True, g[order][1:] != g[order][:-1]])
        reach = np.cumsum(count[order])
        i = 0
        while i < len(edges):  # whole anchors, about `together` windows at once
            a = edges[i]
            i = max(i + 1, int(np.searchsorted(reach[np.r_[edges[1:], len(order)] - 1], (reach[a - 1] if a else 0) + together, "right")))
            some = order[a : edges[i] if i < len(edges) else len(order)]
            local = np.repeat(begin[some] - (np.cumsum(size[some]) - size[some]), size[some]) + np.arange(size[some].sum())
            text = data[local]
            h = prefix_hash(text)
            own = np.repeat(np.arange(len(some)), count[some])
            step = np.arange(len(own)) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
            start = (np.cumsum(size[some]) - size[some])[own] + step
            anchor = np.cumsum(np.r_[0, (g[some][1:] != g[some][:-1]).astype(np.int64)])[own]
            group = anchor * 256 + (lead[some][own] - step)
            # a window whose hash no other has equals none: it needs no place in the order
            key = mix(span_hash(h, start, start + length) ^ mix(group.astype(np.uint64)))
            by_key = np.argsort(key)
            twin = key[by_key[1:]] == key[by_key[:-1]]
            rest = by_key[np.r_[False, twin] | np.r_[twin, False]]
            if not len(rest):
                continue
            rest = rest[np.argsort(group[rest], kind="stable")]
            place = suffix_sort(text, h, start[rest], group[rest], length)
            cls = equal_runs(text, h, start[rest], group[rest], place, length)
            sorted_ = rest[place]
            docs = ids[some][own[sorted_]]
            heads = np.flatnonzero(np.r_[True, cls[1:] != cls[:-1]])
            least = np.minimum.reduceat(docs, heads)[cls]
            hit = docs > least
            np.bitwise_or.at(bits, some[own[sorted_[hit]]], np.uint32(1) << step[sorted_[hit]].astype(np.uint32))
        ends = np.cumsum(table["n"].to_numpy())
        return pa.table({"block": table["block"], "part": table["part"], "bits": pa.array([zipped(bits[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), table["n"].to_pylist(), strict=True)], pa.binary()), "sent": pc.binary_length(table["entries"]).cast(pa.int64())})

    return lean_groups(run)


# --- 3: cut --------------------------------------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string"


def whole_characters(part: np.ndarray, gone: np.ndarray) -> bytes:
    """The text without the characters of which every byte goes."""
    head = (part & 0xC0) != 0x80
    of = np.cumsum(head) - 1
    all_gone = np.logical_and.reduceat(gone, np.flatnonzero(head))
    return part[~all_gone[of]].tobytes()


def cut_text(parts: int, length: int, seed: int, with_bytes: bool, with_text: bool):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        b = Block(left, right.filter(pc.is_null(right["bits"])).drop_columns("bits"), parts, length, seed)
        got = {p: x for p, x in zip(right["part"].to_pylist(), right["bits"].to_pylist(), strict=True) if x is not None}
        bits = np.zeros(len(b.head), np.uint32)
        for p, i, j in b.parts:
            bits[i:j] = np.frombuffer(unzipped(got[p]), "<u4")
        # an entry's bits hold for its least document; a larger document of the block loses every window of the entry
        own = bits[b.entry]
        larger = b.ids[b.text] > b.ids[b.text[b.head]][b.entry] if len(b.entry) else np.zeros(0, bool)
        own[larger] = 0xFFFFFFFF
        begins = np.zeros(len(b.data), bool)  # where a window that goes begins
        for a in range(0, len(own), 1 << 15):
            masks = np.unpackbits(own[a : a + (1 << 15)].astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
            masks[np.arange(32)[None, :] >= b.count[a : a + (1 << 15), None]] = 0
            run_, step = np.nonzero(masks)
            begins[b.start[a + run_] + step] = True
        for r in np.flatnonzero(b.copy).tolist():
            begins[b.off[r] : max(b.off[r], b.off[r + 1] - length + 1)] = True
        out: dict[str, list] = {k: [] for k in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text")}
        for r, (a, z) in enumerate(zip(b.off.tolist(), b.off[1:].tolist(), strict=False)):
            part, spans = b.data[a:z], 0
            kept = text = part.tobytes()
            at = np.flatnonzero(begins[a:z])
            if len(at):
                cut = np.flatnonzero(np.r_[True, np.diff(at) > length])
                spans = len(cut)
                gone = np.zeros(len(part), bool)
                for i, j in zip(at[cut].tolist(), at[np.r_[cut[1:], len(at)] - 1].tolist(), strict=True):
                    gone[i : j + length] = True
                kept = part[~gone].tobytes()
                text = whole_characters(part, gone) if with_text else b""
            out["n_bytes"].append(len(part))
            out["n_removed"].append(len(part) - len(kept))
            out["n_spans"].append(spans)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept if with_bytes else None)
            out["kept_text"].append(text if with_text else None)
        types = {"kept_sha256": pa.string(), "kept": pa.binary(), "kept_text": pa.string()}
        ids = pc.if_else(b.rows["null_id"], pa.scalar(None, pa.int64()), b.rows["doc_id"])
        rest = {}
        if "rest" in b.rows.column_names:  # its fields can be null in the result
            own_ = b.rows["rest"].combine_chunks()
            rest["rest"] = pa.StructArray.from_arrays(own_.flatten(), fields=[f.with_nullable(True) for f in own_.type])
        return pa.table({"doc_id": ids, **{k: pa.array(v, types.get(k, pa.int64())) for k, v in out.items()}, **rest})

    return lean_groups(run)


def substring_dedup(
    docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_bytes: bool = False, with_text: bool = False, part_bytes: int | None = None, task_bytes: int | None = None, frequent: int = FREQUENT, entry_bytes: int | None = None, carry: tuple[str, ...] = ()
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept and kept_text, and `carry` (columns of docs) as a struct `rest`.

    kept (with_bytes) has the remaining bytes; kept_text (with_text) is the text without the characters that go whole.
    part_bytes, task_bytes: text for one part of the keys and for one task of the exchange. frequent: see FREQUENT.
    entry_bytes: bytes of entries that may be on disk at once, about; the bytes of all texts unless given.

    Texts are whole UTF-8 byte strings, null counts as empty; no match crosses documents. A byte goes when a string of
    `length` bytes over it also starts in a document with a smaller doc_id. Rows that share a doc_id are no reason for
    each other to lose bytes. A null doc_id counts as larger than any other and stays null. Empty table: empty result.
    Other columns are ignored. seed < length <= seed + 31.
    """
    if not seed < length <= seed + 31:
        raise ValueError("seed < length <= seed + 31")
    spark = docs.sparkSession
    scratch = Scratch(spark, "substring")
    placed = with_locator(docs, scratch, list(dict.fromkeys(("doc_id", "text", *carry))))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = placed.select(
        *block_columns(F.octet_length(text), BLOCK_BYTES), "__loc_row", F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("doc_id"),
        F.col("doc_id").isNull().alias("null_id"), text.alias("text"), *([F.struct(*carry).alias("rest")] if carry else []),
    )
    # whole copies: every one but the least doc_id goes; a block is told a digest once
    marked = scratch.table(rows.select("block", "doc_id", F.octet_length("text").alias("size"), F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("sha")), "marked")
    texts = marked.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.max("size").alias("once"), F.sum("size").alias("size"))
    total, once = (x or 0 for x in texts.agg(F.sum("size"), F.sum("once")).first())
    parts, tasks = (int(max(8, total // size)) for size in (part_bytes or PART_BYTES, task_bytes or TASK_BYTES))
    copies = marked.select("block", "sha").distinct().join(texts.filter("most > least").select("sha", "least"), "sha").groupBy("block").agg(F.collect_list(F.struct("sha", "least")).alias("copies"))
    copies = copies.select("block", F.lit(None).cast("long").alias("piece"), F.lit(None).cast("int").alias("part"), F.lit(None).cast("binary").alias("repeats"), F.lit(0).cast("long").alias("due"), "copies")

    by_part = lambda df, n: df.repartition(n, "part").groupBy("part")
    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    sent = rows.select("window", "block", "__loc_row", "doc_id", "text").mapInArrow(send_anchors(parts, length, seed), ANCHORS)
    repeats = by_part(sent, parts).applyInArrow(lean_groups(lambda table: find_repeats(table, frequent)), REPEATS).withColumn("copies", F.lit(None).cast(copies.schema["copies"].dataType))
    told = scratch.table(repeats.unionByName(copies), "told")
    scratch.drop("marked")
    # whole copies send no entries, though their anchors repeat
    due = (told.agg(F.sum("due")).first()[0] or 0) * ENTRY_BYTES * once // max(1, total)
    told = told.drop("due")
    both = told.withColumn("bits", F.lit(None).cast("binary"))
    most, a_part, k, end = max(1, entry_bytes or total), ROOM * due / parts, 0, 0
    while end < parts:
        left = parts - end
        rounds = min(left, max(1, math.ceil(left * a_part / most)))  # of about equal size
        span = end, end + -(-left // rounds) if k else end + left // rounds
        entries = by_block(rows.select("block", "__loc_row", "doc_id", "text")).cogroup(by_block(told)).applyInArrow(send_entries(parts, length, seed, span), ENTRIES)
        bits = scratch.table(by_part(entries, span[1] - span[0]).applyInArrow(mark(length), BITS), f"bits-{k}")
        k, end = k + 1, span[1]
        sent = (bits.agg(F.sum("sent")).first()[0] or 0) / (span[1] - span[0]) if end < parts else 0
        a_part = sent if k == 1 else max(a_part, sent)
        both = both.unionByName(
            bits.select("block", F.lit(None).cast("long").alias("piece"), "part", F.lit(None).cast("binary").alias("repeats"), F.lit(None).cast(copies.schema["copies"].dataType).alias("copies"), "bits")
        )
    result = RESULT + (f", rest {rows.schema['rest'].dataType.simpleString()}" if carry else "")
    return by_block(rows.drop("window")).cogroup(by_block(both)).applyInArrow(cut_text(parts, length, seed, with_bytes, with_text), result)


def cut_rows(docs: DataFrame) -> DataFrame:
    """`docs`, all rows and columns, with what stays of each text: the pipeline's stage. n_chars follows the text; a null text stays null."""
    names = docs.columns
    flag = next(c for c in ("no_text", *(f"no_text_{k}" for k in range(len(names)))) if c not in names)
    own = [c for c in names if c not in ("text", "n_chars")]
    cut = substring_dedup(docs.withColumn(flag, F.col("text").isNull()), with_text=True, carry=(*own, flag))
    text = F.when(~F.col(f"rest.{flag}"), F.col("kept_text"))
    new = {"text": text, "n_chars": F.length(F.coalesce(text, F.lit(""))).cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return cut.select(*[(new[c] if c in new else F.col(f"rest.`{c}`")).alias(c) for c in names])


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: what stays of every text of `documents`."""
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("kept", "kept_text")
