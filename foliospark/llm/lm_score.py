"""LM scoring (op9): a bigram model by deleted interpolation over the whole corpus.

P(w | v) = l2 c(v,w)/c(v) + l1 c(w)/N + l0 /(V+1), with one weight triple for each bucket of the context's frequency
c(v). The weights come from expectation-maximisation on held-out counts: each training token is scored with its own
occurrence deleted, so every training document serves as held-out data for the rest.

Counts are exchanged between blocks (runs of stored rows) and parts (ranges of key hashes): a block sends the sorted
distinct keys of each part once, with its own training counts; a part sums them and returns the totals in the same
order. A frequent word is one entry per block, so no part is hot. Keys are hashes of 64 bits (words) and 56 bits
(bigrams) under a secret key that is drawn for each run, so no text can be written for words to share one; the numbers
of parts and tasks follow the size of the text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import KEY, LOWER, flat, mix, new_key, pack, pieces, unpack, words
from .exchange import block_columns, by_piece, part_runs, unzipped, zipped
from .memory import lean, lean_groups
from .scratch import Scratch, with_locator

#: Most bytes of a block of several rows, and text for one part and for one task.
BLOCK_BYTES, PART_BYTES, TASK_BYTES = 8 << 20, 16 << 20, 16 << 20
#: Buckets of the context's frequency (by powers of two), and steps of a probability ratio in the EM table (a quarter of a decade).
BUCKETS, STEPS = 16, 48
END, START = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)  # fixed values: hashes of the two marks
EM_ROUNDS = 60


def tokens(column, key: tuple[int, int] = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens (words, then one end mark per text) and the number of tokens of each text."""
    data, off = flat(column)
    out, sizes = [], []
    for i, j in pieces(off, 1 << 18):
        h, _, _, n = words(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i], key)
        out.append(np.insert(h, np.cumsum(n), END))
        sizes.append(n + 1)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def bigrams(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """56-bit key of each token with the token before it; a text's first token follows the start mark."""
    before = np.empty_like(h)
    before[1:] = h[:-1]
    before[np.cumsum(sizes) - sizes] = START
    return mix(before * np.uint64(0x9E3779B97F4A7C15) + h) >> np.uint64(8)


def counts_blob(a: np.ndarray) -> bytes:
    return zipped(np.ascontiguousarray(a, "<u8").tobytes())


def counts_of(blob: bytes) -> np.ndarray:
    return np.frombuffer(unzipped(blob), "<u8").astype(np.int64)


FORWARD = "part int, block long, piece long, uni binary, uni_n binary, bi binary, bi_n binary"
RETURN = "block long, piece long, part int, uni_n binary, bi_n binary, n long, v long"


def send(parts: int, key: tuple[int, int]):
    """From rows (window, block, __loc_row, held, text) in stored order to the keys of each part."""

    def work(block, piece, table):
        h, sizes = tokens(table["text"], key)
        train = np.repeat(~table["held"].to_numpy(zero_copy_only=False), sizes)
        sent: dict[int, list] = {}
        for k, (keys, bits, width) in enumerate(((h, 64, 8), (bigrams(h, sizes), 56, 7))):
            keys, at = np.unique(keys, return_inverse=True)
            n = np.bincount(at, weights=train, minlength=len(keys))
            for p, a, z in part_runs(keys, bits, parts):
                sent.setdefault(p, [b"", counts_blob(n[:0])] * 2)[2 * k : 2 * k + 2] = pack(keys[a:z], width), counts_blob(n[a:z])
        rows = sorted(sent)
        return pa.table(
            {
                "part": pa.array(rows, pa.int32()), "block": pa.array([block] * len(rows), pa.int64()), "piece": pa.array([piece] * len(rows), pa.int64()),
                **{c: pa.array([sent[p][k] for p in rows], pa.binary()) for k, c in enumerate(("uni", "uni_n", "bi", "bi_n"))},
            }
        )

    return by_piece(work)


def total(table: pa.Table) -> pa.Table:
    """A part's totals, returned to each block in the order in which it sent the keys; a row with piece -1 has N and V."""
    out, stats = {}, (0, 0)
    for keys, n, width in (("uni", "uni_n", 8), ("bi", "bi_n", 7)):
        blobs = table[keys].to_pylist()
        lens = [len(b) // width for b in blobs]
        own = np.concatenate([counts_of(b) for b in table[n].to_pylist()])
        _, at = np.unique(np.concatenate([unpack(b, width) for b in blobs]), return_inverse=True)
        sums = np.bincount(at, weights=own)
        if keys == "uni":
            stats = (int(own.sum()), int((sums > 0).sum()))
        back = sums.astype(np.int64)[at]
        ends = np.cumsum(lens)
        out[n] = [counts_blob(back[e - k : e]) for e, k in zip(ends, lens, strict=True)]
    rows = table.num_rows
    add = lambda c, x: pa.array([*c.to_pylist(), x], c.type)
    return pa.table(
        {
            "block": add(table["block"], 0), "piece": add(table["piece"], -1), "part": add(table["part"], 0),
            "uni_n": pa.array([*out["uni_n"], None], pa.binary()), "bi_n": pa.array([*out["bi_n"], None], pa.binary()),
            "n": pa.array([0] * rows + [stats[0]], pa.int64()), "v": pa.array([0] * rows + [stats[1]], pa.int64()),
        }
    )


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(context.astype(float))[1], BUCKETS - 1)  # 0; 1; 2-3; 4-7; ...


def level(ratio: np.ndarray) -> np.ndarray:
    """Step of a probability: 0 for none, else a quarter of a decade below 1 each."""
    with np.errstate(divide="ignore"):
        return np.where(ratio > 0, 1 + np.clip(np.round(-4 * np.log10(ratio)), 0, STEPS - 2), 0).astype(np.int64)


SCORED = "kind int, doc_id long, held boolean, n_tokens long, n_known long, base_score double, blob binary, cells array<int>, cell_n array<long>"


def look_up(n_all: int, v_all: int, key: tuple[int, int]):
    """Joins a block's rows with the totals of its keys: for each text its counts, for the block a table of held-out counts."""
    floor = 0.5 * (v_all + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left = left.sort_by("__loc_row")
        at = left["__loc_row"].to_numpy()
        got = {}
        for piece, part, u, b in zip(*(right[c].to_pylist() for c in ("piece", "part", "uni_n", "bi_n")), strict=True):
            got.setdefault(piece, {})[part] = (u, b)
        starts = sorted(got)
        cuts = [*np.searchsorted(at, starts).tolist(), len(at)]
        docs: dict[str, list] = {k: [] for k in ("doc_id", "held", "n_tokens", "n_known", "base_score", "blob")}
        table = np.zeros(BUCKETS * STEPS * STEPS, np.int64)
        for piece, a, z in zip(starts, cuts, cuts[1:], strict=False):
            rows = left.slice(a, z - a)
            h, sizes = tokens(rows["text"], key)
            held = rows["held"].to_numpy(zero_copy_only=False)
            order = sorted(got[piece])
            known = []
            for k, keys in enumerate((h, bigrams(h, sizes))):
                there = np.concatenate([counts_of(got[piece][p][k]) for p in order])
                known.append(there[np.unique(keys, return_inverse=True)[1]])
            c1, c2 = known
            first = np.cumsum(sizes) - sizes
            context = np.empty_like(c1)
            context[1:] = c1[:-1]
            context[first] = c1[first + sizes - 1]  # as many starts as ends
            base = np.log10((c1 + 0.5) / (n_all + floor))
            train = np.repeat(~held, sizes)
            k, x, y = context[train] - 1, c2[train] - 1, c1[train] - 1
            cell = (bucket(k) * STEPS + level(x / np.maximum(k, 1))) * STEPS + level(y / max(n_all - 1, 1))
            table += np.bincount(cell, minlength=len(table))
            docs["doc_id"] += rows["doc_id"].to_pylist()
            docs["held"] += held.tolist()
            docs["n_tokens"] += sizes.tolist()
            docs["n_known"] += np.add.reduceat((c1 > 0).astype(np.int64), first).tolist()
            docs["base_score"] += np.add.reduceat(base, first).tolist()
            docs["blob"] += [counts_blob(np.concatenate([context[f : f + s], c2[f : f + s], c1[f : f + s]])) for f, s in zip(first.tolist(), sizes.tolist(), strict=True)]
        full = np.flatnonzero(table)
        n = len(docs["doc_id"])
        return pa.table(
            {
                "kind": pa.array([0] * n + [1], pa.int32()), "doc_id": pa.array([*docs["doc_id"], None], pa.int64()), "held": pa.array([*docs["held"], None], pa.bool_()),
                "n_tokens": pa.array([*docs["n_tokens"], None], pa.int64()), "n_known": pa.array([*docs["n_known"], None], pa.int64()), "base_score": pa.array([*docs["base_score"], None], pa.float64()),
                "blob": pa.array([*docs["blob"], None], pa.binary()), "cells": pa.array([None] * n + [full], pa.list_(pa.int32())), "cell_n": pa.array([None] * n + [table[full]], pa.list_(pa.int64())),
            }
        )

    return lean_groups(run)


def weights(cells: np.ndarray, n: np.ndarray, v_all: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weight triples (bigram, word, uniform) of the buckets, by expectation-maximisation on the table of held-out counts."""
    value = np.where(np.arange(STEPS) > 0, 10.0 ** (-(np.arange(STEPS) - 1) / 4), 0.0)
    at, p = cells // (STEPS * STEPS), np.stack([value[cells // STEPS % STEPS], value[cells % STEPS], np.full(len(cells), 1 / (v_all + 1))], 1)
    out = np.full((BUCKETS, 3), 1 / 3)
    out[0] = (0, 0.5, 0.5)  # a context that was never seen has no bigrams
    for _ in range(rounds):
        part = out[at] * p
        part *= (n / part.sum(1))[:, None]
        sums = np.stack([np.bincount(at, part[:, k], BUCKETS) for k in range(3)], 1)
        seen = sums.sum(1) > 0
        out[seen] = sums[seen] / sums[seen].sum(1, keepdims=True)
    empty = np.bincount(at, n, BUCKETS) == 0
    if (~empty[1:]).any():  # a bucket without held-out tokens takes the weights of the nearest one
        have = np.flatnonzero(~empty[1:]) + 1
        for b in np.flatnonzero(empty[1:]) + 1:
            out[b] = out[have[np.abs(have - b).argmin()]]
    if not v_all:
        out[:] = (0, 0, 1)  # nothing was learned
    out[:, 2] = np.maximum(out[:, 2], 1e-9)  # no token has probability zero
    return out / out.sum(1, keepdims=True)


def score(lam: np.ndarray, n_all: int, v_all: int):
    def run(it):
        for batch in it:
            scores = []
            for blob in batch.column("blob").to_pylist():
                k, c2, c1 = counts_of(blob).reshape(3, -1)
                w = lam[bucket(k)]
                scores.append(float(np.log10(w[:, 0] * c2 / np.maximum(k, 1) + w[:, 1] * c1 / max(n_all, 1) + w[:, 2] / (v_all + 1)).sum()))
            keep = [batch.column(c) for c in ("doc_id", "held", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays(
                [*keep, pa.array([n_all] * len(scores), pa.int64()), batch.column("base_score"), pa.array(scores, pa.float64())],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return lean(run)


def lm_score(docs: DataFrame, held_out=None, part_bytes: int | None = None, task_bytes: int | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability).

    held_out: a Boolean column of the documents that the model doesn't learn from. Null text counts as empty (one
    end mark); a null doc_id learns and stays null; repeated rows count each time. Without training rows every
    probability is 1 over the one unknown type. Empty table: empty result. Other columns are ignored.
    part_bytes, task_bytes: text for one part of the keys and for one task of the exchange.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    if held_out is None:
        held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = with_locator(docs, scratch, ["doc_id", "text"]).select(
        *block_columns(F.octet_length(text), BLOCK_BYTES), "__loc_row", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held"), text.alias("text")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, tasks = (int(max(8, size // each)) for each in (part_bytes or PART_BYTES, task_bytes or TASK_BYTES))
    by_block = lambda df: df.repartition(tasks, "block").groupBy("block")
    key = new_key()
    sent = rows.select("window", "block", "__loc_row", "held", "text").mapInArrow(send(parts, key), FORWARD)
    totals = scratch.table(sent.repartition(parts, "part").groupBy("part").applyInArrow(lean_groups(total), RETURN), "totals")
    n_all, v_all = (int(x or 0) for x in totals.filter("piece = -1").agg(F.sum("n"), F.sum("v")).first())
    counts = totals.filter("piece >= 0").select("block", "piece", "part", "uni_n", "bi_n")
    joined = scratch.table(by_block(rows.drop("window")).cogroup(by_block(counts)).applyInArrow(look_up(n_all, v_all, key), SCORED), "joined")
    scratch.drop("totals")
    table = joined.filter("kind = 1").select(F.explode(F.arrays_zip("cells", "cell_n")).alias("c")).groupBy("c.cells").agg(F.sum("c.cell_n").alias("n")).toPandas()
    lam = weights(table["cells"].to_numpy(np.int64), table["n"].to_numpy(np.float64), v_all)
    return joined.filter("kind = 0").select("doc_id", "held", "n_tokens", "n_known", "base_score", "blob").mapInArrow(
        score(lam, n_all, v_all), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: scores of all `documents`."""
    return lm_score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
