"""Media columns (op4): Matroska files, their parser and packet tables.

`write_audio` stores a payload losslessly as 8-bit PCM: EBML header, segment information, one audio track, clusters of
simple blocks in all three lacings, and cues. `parse` reads variable-length EBML elements (sizes may be unknown),
clusters, simple blocks and block groups, laces and cues, and gives a table of packets with timestamps, tracks and
byte ranges; the payload is read back through those ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME, RATE = 576, 8000
LACED, BLOCKS = 8, 32

#: Element identifiers of the format.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK, NUMBER, UID, TYPE, LACING, CODEC = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES}
XIPH, FIXED, EBML_LACE = 1, 2, 3


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    cluster: int
    lace: int
    offset: int
    size: int


class Parsed(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]
    scale: int
    duration: float | None


# --- writing -------------------------------------------------------------------------------------------------------


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def size_of(n: int, width: int = 0) -> bytes:
    """n as a variable-length integer; all ones would mean an unknown size."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return number(ident) + size_of(len(body)) + body


def signed_size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if abs(n) < (1 << 7 * w - 1) - 1)
    return size_of(n + (1 << 7 * width - 1) - 1, width)


def block_body(track: int, at: int, frames: list[bytes], lacing: int) -> bytes:
    """A simple block: track, timestamp relative to the cluster, flags, lace sizes, frames."""
    lacing = lacing if len(frames) > 1 else 0
    head = size_of(track) + at.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1])
    if lacing:
        head += bytes([len(frames) - 1])
    if lacing == XIPH:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif lacing == EBML_LACE:
        head += size_of(len(frames[0]))
        for a, b in zip(frames, frames[1:-1], strict=False):
            head += signed_size(len(b) - len(a))
    return head + b"".join(frames)


def _head(samples: int) -> bytes:
    import struct

    info = element(SCALE, number(1_000_000)) + element(DURATION, struct.pack(">d", samples * 1000 / RATE)) + element(MUXING_APP, b"foliospark") + element(WRITING_APP, b"foliospark")
    audio = element(FREQUENCY, struct.pack(">f", RATE)) + element(CHANNELS, b"\1") + element(DEPTH, b"\x08")
    track = element(NUMBER, b"\1") + element(UID, b"\1") + element(TYPE, b"\2") + element(LACING, b"\1") + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)
    return element(INFO, info) + element(TRACKS, element(TRACK, track))


HEADER = element(
    EBML,
    element(EBML_VERSION, b"\1") + element(EBML_READ_VERSION, b"\1") + element(EBML_MAX_ID, b"\4") + element(EBML_MAX_SIZE, b"\x08") + element(DOC_TYPE, b"matroska") + element(DOC_VERSION, b"\4") + element(DOC_READ_VERSION, b"\2"),
)


def write_audio(payload: bytes, frame: int = FRAME) -> bytes:
    """The payload as an 8-bit mono PCM track; frames of `frame` bytes, LACED to a block, BLOCKS to a cluster."""
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    head = _head(len(payload))
    out, at, cues = [head], len(head), b""
    per = LACED * BLOCKS
    for c in range(0, len(frames), per):
        start = c * frame * 1000 // RATE
        body = element(TIMESTAMP, number(start))
        for k, b in enumerate(range(c, min(c + per, len(frames)), LACED)):
            time = b * frame * 1000 // RATE
            body += element(SIMPLE_BLOCK, block_body(1, time - start, frames[b : min(b + LACED, c + per)], k % 3 + 1))
        cluster = element(CLUSTER, body)
        cues += element(CUE_POINT, element(CUE_TIME, number(start)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, number(at))))
        out.append(cluster)
        at += len(cluster)
    out.append(element(CUES, cues))
    body = b"".join(out)
    return HEADER + number(SEGMENT) + size_of(len(body), 8) + body


# --- parsing -------------------------------------------------------------------------------------------------------


def read_size(data: bytes, at: int) -> tuple[int | None, int]:
    """A variable-length integer and the place after it; None for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError("not a variable-length integer")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError("cut off")
    n = int.from_bytes(data[at : at + width], "big") & ((1 << 7 * width) - 1)
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int | None, int]]:
    """(identifier, body, its size or None, start) of the elements in data[at:end]; stops at an unknown size."""
    while at < end:
        start, width = at, 9 - data[at].bit_length()
        if width > 4:
            raise ValueError("not an element identifier")
        ident, at = int.from_bytes(data[at : at + width], "big"), at + width
        size, at = read_size(data, at)
        if size is not None and at + size > end:
            raise ValueError("an element reaches over its parent")
        yield ident, at, size, start
        if size is None:
            return
        at += size


def lace(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame in the body of a block."""
    if not kind:
        return [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif kind == EBML_LACE and n > 1:
        first, at = read_size(data, at)
        sizes.append(first)
        for _ in range(n - 2):
            start = at
            raw, at = read_size(data, at)
            raw = raw if raw is not None else (1 << 7 * (at - start)) - 1
            sizes.append(sizes[-1] + raw - ((1 << 7 * (at - start) - 1) - 1))
    elif kind == FIXED:
        if (end - at) % n:
            raise ValueError("frames of one size don't fill the block")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laces reach over the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def parse(data: bytes) -> Parsed:
    """Packet table, tracks and cues of a Matroska file. ValueError where the bytes don't follow the format."""
    import struct

    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    info = {"scale": 1_000_000, "duration": None, "type": None}

    def uint(at: int, size: int) -> int:
        return int.from_bytes(data[at : at + size], "big")

    def real(at: int, size: int) -> float:
        return struct.unpack(">d" if size == 8 else ">f", data[at : at + size])[0] if size else 0.0

    def block(at: int, size: int, cluster: int, base: int, key: bool | None) -> None:
        end = at + size
        track, at = read_size(data, at)
        time, flags = int.from_bytes(data[at : at + 2], "big", signed=True), data[at + 2]
        key = bool(flags & 0x80) if key is None else key
        for k, (o, n) in enumerate(lace(data, at + 3, end, flags >> 1 & 3)):
            packets.append(Packet(track, (base + time) * info["scale"], key, cluster, k, o, n))

    def cluster(at: int, end: int, start: int) -> int:
        """Reads a cluster's children; returns where it ends, for one of unknown size before the next top element."""
        base = 0
        for ident, body, size, begin in elements(data, at, end):
            if ident in TOP:
                return begin
            if ident == TIMESTAMP:
                base = uint(body, size)
            elif ident == SIMPLE_BLOCK:
                block(body, size, start, base, None)
            elif ident == GROUP:
                inner = list(elements(data, body, body + size))
                key = all(i != REFERENCE for i, *_ in inner)
                for i, b, s, _ in inner:
                    if i == BLOCK:
                        block(b, s, start, base, key)
        return end

    def tree(at: int, end: int) -> dict[int, list]:
        out: dict[int, list] = {}
        for ident, body, size, _ in elements(data, at, end):
            out.setdefault(ident, []).append(tree(body, body + size) if ident in MASTERS else (body, size))
        return out

    def segment(at: int, end: int) -> None:
        base = at
        while at < end:
            ident, body, size, start = next(elements(data, at, end))
            stop = end if size is None else body + size
            if ident == CLUSTER:
                stop = cluster(body, stop, start - base)
            elif size is None:
                raise ValueError("only segments and clusters can have an unknown size")
            elif ident == INFO:
                t = tree(body, stop)
                info["scale"] = uint(*t[SCALE][0]) if SCALE in t else info["scale"]
                info["duration"] = real(*t[DURATION][0]) if DURATION in t else None
            elif ident == TRACKS:
                for t in tree(body, stop).get(TRACK, []):
                    audio = t.get(AUDIO, [{}])[0]
                    tracks[uint(*t[NUMBER][0])] = {
                        "type": uint(*t[TYPE][0]), "codec": data[t[CODEC][0][0] : sum(t[CODEC][0])].decode(),
                        "rate": real(*audio[FREQUENCY][0]) if FREQUENCY in audio else None, "channels": uint(*audio[CHANNELS][0]) if CHANNELS in audio else None, "depth": uint(*audio[DEPTH][0]) if DEPTH in audio else None,
                    }
            elif ident == CUES:
                for p in tree(body, stop).get(CUE_POINT, []):
                    for q in p[CUE_POSITIONS]:
                        cues.append((uint(*p[CUE_TIME][0]) * info["scale"], uint(*q[CUE_TRACK][0]), uint(*q[CUE_CLUSTER][0])))
            at = stop

    at = 0
    while at < len(data):
        ident, body, size, _ = next(elements(data, at, len(data)))
        stop = len(data) if size is None else body + size
        if ident == EBML:
            t = tree(body, stop)
            info["type"] = data[t[DOC_TYPE][0][0] : sum(t[DOC_TYPE][0])] if DOC_TYPE in t else b"matroska"
        elif ident == SEGMENT:
            if info["type"] not in (b"matroska", b"webm"):
                raise ValueError("not a Matroska file")
            segment(body, stop)
        at = stop
    if info["type"] is None:
        raise ValueError("not an EBML file")
    return Parsed(packets, tracks, cues, info["scale"], info["duration"])


def read_back(data: bytes, parsed: Parsed, track: int = 1) -> bytes:
    return b"".join([data[p.offset : p.offset + p.size] for p in parsed.packets if p.track == track])


# --- tables --------------------------------------------------------------------------------------------------------


def padded(text: str) -> bytes:
    raw = text.encode()
    return raw + b"\xff" * (-len(raw) % FRAME or (FRAME if not raw else 0))


def feature(parsed: Parsed, payload: bytes) -> str:
    x = np.frombuffer(payload, np.uint8)
    hist = np.bincount(x, minlength=256).astype(np.float64)
    level = np.arange(256) - 128.0
    mean, power = hist @ level / len(x), hist @ (level * level) / len(x)
    share = hist[hist > 0] / len(x)
    track = parsed.tracks[1]
    clusters = {p.cluster for p in parsed.packets}
    return f"codec={track['codec']};depth={track['depth']};packets={len(parsed.packets)};clusters={len(clusters)};cues={len(parsed.cues)};seconds={len(x) / RATE:.3f};mean={mean:.4f};rms={power**0.5:.4f};entropy={-(share * np.log2(share)).sum():.4f}"


def media_row(text: str) -> tuple:
    payload = padded(text)
    stored = write_audio(payload)
    parsed = parse(stored)
    back = read_back(stored, parsed)
    return (len(text.encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(parsed, back))


def _columns(rows: list[tuple], types: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each row.

    Null counts as empty: one frame of bytes 255. Equal texts have equal values; repeated rows stay, a null doc_id
    stays null. Empty table: empty result. Other columns are ignored.
    """
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(it):
        for batch in it:
            rows = [media_row(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *_columns(rows, types)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored file of each text."""

    def run(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([write_audio(padded(t or "")) for t in batch.column("text").to_pylist()], pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of (doc_id, media), and one row with `error` for a file that can't be parsed or is null."""
    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]

    def run(it):
        for batch in it:
            rows = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("no file")
                    rows += [(doc, *p, None) for p in parse(data).packets]
                except (ValueError, IndexError, KeyError) as e:
                    rows.append((doc, *[None] * 7, str(e) or "not a Matroska file"))
            yield pa.RecordBatch.from_arrays(_columns(rows, types), names=["doc_id", *Packet._fields, "error"])

    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(
        run, "doc_id long, track long, timestamp_ns long, keyframe boolean, cluster long, lace long, offset long, size long, error string"
    )


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: every row of `documents` through a Matroska file and back."""
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
