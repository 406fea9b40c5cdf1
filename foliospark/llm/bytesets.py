"""Whole-batch text arithmetic in numpy: flat byte buffers, words and their keyed hashes, polynomial prefix hashes.

The polynomial hashes are linear modulo 2**64, so texts with equal ones can be written down; whoever uses them compares
bytes where they are equal. Words are told apart by a keyed hash (SipHash-1-3) instead: with a key that is drawn for a
run, nobody can choose words that collide, and with the fixed KEY it takes some 2**32 trials to find a pair.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Multipliers of the splitmix64 finaliser and the odd base of the polynomial.
MIX_1 = np.uint64(0xBF58476D1CE4E5B9)
MIX_2 = np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

#: The four words of state that SipHash starts from, and the rotations of its round.
SIP_STATE = tuple(int.from_bytes(x, "big") for x in (b"somepseu", b"dorandom", b"lygenera", b"tedbytes"))
#: The key where hashes must be the same in every run (signatures).
KEY = (0x0706050403020100, 0x0F0E0D0C0B0A0908)
#: Words over so many bytes are hashed by BLAKE2b under the same key.
LONG_WORD = 256
TAIL = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)

TABLE = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 64, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.ones(256, dtype=bool)
IN_WORD[[32, 9, 10, 11, 12, 13]] = False

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept up to a few million entries."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 17)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 22:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= MIX_1
    x ^= x >> np.uint64(27)
    x *= MIX_2
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values one after the other, and the offsets of the values. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of values with about `most` bytes each, so that temporary arrays stay small."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = sum of TABLE[data[k]] * BASE**k for i <= k < j, modulo 2**64."""
    h = np.zeros(len(data) + 1, np.uint64)
    t = TABLE[data]
    t *= powers(BASE, len(data))
    np.cumsum(t, out=h[1:])
    return h


def span_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of data[start:end], independent of the place."""
    return (h[end] - h[start]) * powers(BASE_INV, len(h))[start]


def new_key() -> tuple[int, int]:
    """A key for one run, for the driver to draw: retried tasks must have the same."""
    raw = os.urandom(16)
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


def sip_round(v: list[np.ndarray]) -> None:
    def turn(x: np.ndarray, bits: int) -> np.ndarray:
        high = x << np.uint64(bits)
        high |= x >> np.uint64(64 - bits)
        return high

    a, b, c, d = v
    a = a + b
    b = turn(b, 13) ^ a
    a = turn(a, 32)
    c = c + d
    d = turn(d, 16) ^ c
    a = a + d
    d = turn(d, 21) ^ a
    c = c + b
    b = turn(b, 17) ^ c
    c = turn(c, 32)
    v[:] = [a, b, c, d]


def keyed_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """SipHash-1-3 of each data[start:end], eight bytes of all of them at a time."""
    out = np.empty(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the bytes at each place
    for at in range(0, len(start), 1 << 14):  # what fits the cache
        first, size = start[at : at + (1 << 14)], (end - start)[at : at + (1 << 14)]
        v = [np.full(len(first), x ^ key[k % 2], np.uint64) for k, x in enumerate(SIP_STATE)]
        whole = np.where(size > LONG_WORD, 0, size >> 3)
        for k in range(int(whole.max()) if len(whole) else 0):
            live = np.flatnonzero(whole > k)
            block = eight[first[live] + 8 * k]
            own = [x[live] for x in v]
            own[3] ^= block
            sip_round(own)
            own[0] ^= block
            for x, y in zip(v, own, strict=True):
                x[live] = y
        block = eight[first + 8 * whole] & TAIL[size & 7]
        block |= size.astype(np.uint64) << np.uint64(56)
        v[3] = v[3] ^ block
        sip_round(v)
        v[0] ^= block
        v[2] ^= np.uint64(0xFF)
        for _ in range(3):
            sip_round(v)
        out[at : at + (1 << 14)] = v[0] ^ v[1] ^ v[2] ^ v[3]
    secret = b"".join(k.to_bytes(8, "little") for k in key)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=secret).digest(), "little")
    return out


def words(data: np.ndarray, off: np.ndarray, key: tuple[int, int] = KEY) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keyed hash, start and end of every word (maximal run without white space) and the number of words of each value."""
    if len(data) == 0:
        e = np.zeros(0, np.int64)
        return e.astype(np.uint64), e, e, np.zeros(len(off) - 1, np.int64)
    m = IN_WORD[data]
    first = np.zeros(len(data) + 1, bool)
    first[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = m[:-1]
    before[first[:-1]] = False
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = m[1:]
    after[first[1:]] = False
    start, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    at = np.searchsorted(start, off)
    return keyed_hash(data, start, end, key), start, end, np.diff(at)


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of each value."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.view("<u8").ravel()
