"""Exchange of keys between blocks of stored rows and parts of the key space.

A block is a run of stored rows of similar length with a bound in bytes; a part is a range of key hashes. A block sends
each part the distinct keys that it has there, once, and a part answers in the same order. There are at most as many
messages as keys, a frequent key is one entry a block, and only parts that a block has keys for are visited.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import functions as F

from .memory import lean


def part_of(keys: np.ndarray, bits: int, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)


def part_runs(keys: np.ndarray, bits: int, parts: int) -> list[tuple[int, int, int]]:
    """(part, begin, end) of the parts that sorted keys of so many bits fall into."""
    if not len(keys):
        return []
    part = part_of(keys, bits, parts)
    cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    return list(zip(part[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True))


def block_columns(size, most: int) -> list:
    """`window` and `block` of a row from its place and the bytes of its text: rows of one file, near each other, of one class of length.

    Lengths below 8 kB, 32 kB, 128 kB and so on are a class each; its window of rows holds `most` bytes at most.
    """
    top = F.lit(8 << 10) * F.pow(F.lit(4.0), F.ceil(F.log(4.0, F.greatest(size, F.lit(8 << 10)) / F.lit(float(8 << 10))))).cast("long")
    rows = F.greatest(F.floor(F.lit(most) / top), F.lit(1))
    return [rows.cast("long").alias("window"), F.xxhash64("__loc_file", rows, F.floor(F.col("__loc_row") / rows)).alias("block")]


def by_piece(work):
    """A mapInArrow function that calls work(block, piece, table) on each run of a block's rows in a task.

    Blocks of different classes of length lie side by side; of each class one is open.
    """

    def run(it):
        held: dict[int, tuple[int, int, list]] = {}
        for batch in it:
            block, window = batch.column("block").to_numpy(), batch.column("window").to_numpy()
            for kind in np.unique(window).tolist():
                rows = np.flatnonzero(window == kind)
                cut = np.flatnonzero(np.r_[True, np.diff(block[rows]) != 0])
                for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(rows)], strict=True):
                    some = pa.Table.from_batches([batch.take(pa.array(rows[a:z]))])
                    now = int(block[rows[a]])
                    if kind in held and held[kind][0] != now:
                        yield from work(*held[kind][:2], pa.concat_tables(held.pop(kind)[2])).to_batches()
                    held.setdefault(kind, (now, some["__loc_row"][0].as_py(), []))[2].append(some)
        for now, piece, tables in held.values():
            yield from work(now, piece, pa.concat_tables(tables)).to_batches()

    return lean(run)


def zipped(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unzipped(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)
