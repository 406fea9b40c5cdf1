"""Language ID (op3): the mixture of languages of each document.

Letters are read as byte trigrams (lower-cased, everything else one separator). The model is one table of trigram
counts per language over all training documents. A document's words are drawn from a mixture of languages:
expectation-maximisation over the words' n-gram likelihoods estimates the proportions, and languages are removed from
the set one after the other as long as the penalised likelihood (half the log of the words per free proportion) grows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import LOWER, flat, pieces
from .memory import lean, slices
from .scratch import Scratch

#: Trigram buckets, counts in a message, and messages of one sum before they meet.
BUCKETS, CHUNK, SALTS = 1 << 16, 1 << 12, 64
SMOOTH = 0.5
ROUNDS = 6
UNKNOWN = "und"

LETTER = np.zeros(256, bool)
LETTER[97:123] = True
LETTER[128:] = True


def grams(data: np.ndarray, off: np.ndarray):
    """Trigram bucket of each letter byte, start of each word among them, and the number of words of each text."""
    n = len(data)
    low = LOWER[data]
    letter = LETTER[low]
    c = np.zeros(n + 2, np.uint32)
    c[1:-1] = np.where(letter, low, 32)
    c[0] = c[-1] = 32
    before, after = c[:-2].copy(), c[2:].copy()
    first = off[:-1][off[:-1] < off[1:]]
    before[first] = 32
    after[off[1:][off[:-1] < off[1:]] - 1] = 32
    at = np.flatnonzero(letter)
    key = (before[at] << np.uint32(16)) | (c[1:-1][at] << np.uint32(8)) | after[at]
    bucket = (key * np.uint32(0x9E3779B1)) >> np.uint32(16)
    start = np.flatnonzero(before[at] == 32)
    words = np.diff(np.searchsorted(at[start], off)) if len(start) else np.zeros(len(off) - 1, np.int64)
    return bucket, start, words


def count_grams(it):
    """(lang, text) to messages (lang, chunk, salt, counts): this task's sums."""
    sums: dict[str, np.ndarray] = {}
    for batch in it:
        names = batch.column("lang")
        for lang in names.unique().to_pylist():
            data, off = flat(batch.column("text").filter(pc.equal(names, lang)))
            own = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for i, j in pieces(off, 1 << 18):
                own += np.bincount(grams(data[off[i] : off[j]], off[i : j + 1] - off[i])[0], minlength=BUCKETS)
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % SALTS
    rows = [(lang, k, salt, own[k * CHUNK : (k + 1) * CHUNK].tobytes()) for lang, own in sums.items() for k in range(BUCKETS // CHUNK)]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["lang", "chunk", "salt", "counts"])


def add_up(key, pdf: pd.DataFrame) -> pd.DataFrame:
    out = np.zeros(CHUNK, np.int64)
    for blob in pdf["counts"]:
        out += np.frombuffer(blob, np.int64)
    return pd.DataFrame({"lang": [key[0]], "chunk": [key[1]], "counts": [out.tobytes()]})


def learn(docs: DataFrame, training, scratch: Scratch) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the log-probabilities (bucket, language). Size: 512 kB per language, whatever the corpus."""
    rows = docs.filter(training & F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    sums = rows.mapInArrow(lean(count_grams), "lang string, chunk int, salt int, counts binary")
    sums = sums.groupBy("lang", "chunk", "salt").applyInPandas(add_up, "lang string, chunk int, counts binary")
    sums = scratch.table(sums.groupBy("lang", "chunk").applyInPandas(add_up, "lang string, chunk int, counts binary"), "grams").toPandas()
    langs = sorted(sums["lang"].unique())
    counts = np.zeros((BUCKETS, len(langs)))
    for lang, chunk, blob in sums.itertuples(index=False):
        counts[chunk * CHUNK : (chunk + 1) * CHUNK, langs.index(lang)] = np.frombuffer(blob, np.int64)
    return langs, np.log((counts + SMOOTH) / (counts.sum(0) + SMOOTH * BUCKETS)).astype(np.float32)


def mixtures(like: np.ndarray, weight: np.ndarray, words: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Proportions (text, language) from word log-likelihoods (word, language); each text has a word at least."""
    texts, langs = len(words), like.shape[1]
    head = np.cumsum(words) - words
    of = np.repeat(np.arange(texts), words)
    top = like.max(1, keepdims=True)
    p = np.exp(like - top)
    total = np.add.reduceat(weight, head)[:, None]

    def fit(share: np.ndarray, on: np.ndarray, of: np.ndarray, head: np.ndarray, p: np.ndarray, weight: np.ndarray, total: np.ndarray):
        """Runs the rounds from `share`; returns the proportions and the log-likelihood of each text."""
        share = np.where(on, np.maximum(share, 1e-6), 0)
        share /= share.sum(1, keepdims=True)
        for k in range(rounds + 1):
            joint = share[of] * p
            every = joint.sum(1)
            if k == rounds:
                return share, np.add.reduceat(np.log(np.maximum(every, 1e-300)), head)
            joint *= (weight / np.maximum(every, 1e-300))[:, None]
            share = np.add.reduceat(joint, head) / total
        raise AssertionError

    on = np.ones((texts, langs), bool)
    share, best = fit(np.full((texts, langs), 1 / langs), on, of, head, p, weight, total)
    todo = np.arange(texts)
    for size in range(langs, 1, -1):
        # without its least language, and with the rest fitted again
        some = np.zeros(texts, bool)
        some[todo] = True
        rows = some[of]
        w = words[todo]
        h = np.cumsum(w) - w
        less = on[todo].copy()
        least = np.where(less, share[todo], np.inf).argmin(1)
        less[np.arange(len(todo)), least] = False
        new, fits = fit(share[todo], less, np.repeat(np.arange(len(todo)), w), h, p[rows], weight[rows], total[todo])
        gain = fits + 0.5 * np.log(np.maximum(w, 2)) >= best[todo]
        took = todo[gain]
        share[took], best[took], on[took] = new[gain], fits[gain], less[gain]
        todo = took
        if not len(todo):
            break
    return share


def has_letter(column) -> np.ndarray:
    """Whether each text has a letter."""
    data, off = flat(column)
    out = np.zeros(len(off) - 1, bool)
    for i, j in pieces(off):
        own = i + np.flatnonzero(np.diff(off[i : j + 1]))
        if len(own):
            d = data[off[i] : off[j]]
            out[own] = np.add.reduceat((((d | 32) >= 97) & ((d | 32) <= 122) & (d < 128)).astype(np.int32), off[own] - off[i]) > 0
            for k in own[~out[own]].tolist():  # bytes above 127 can also be signs
                out[k] = any(c.isalpha() for c in data[off[k] : off[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(column, langs: list[str], logp: np.ndarray):
    """Predicted language index (-1: und), its proportion, and all proportions of each text."""
    letter = has_letter(column)
    data, off = flat(column)
    n = len(off) - 1
    pred, score, share = np.full(n, -1), np.zeros(n), np.zeros((n, len(langs)))
    for i, j in pieces(off, 1 << 18) if langs else []:
        d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
        bucket, start, words = grams(d, o)
        if not len(start):
            continue
        like = np.add.reduceat(logp[bucket], start, axis=0).astype(np.float64)
        weight = np.diff(np.r_[start, len(bucket)]).astype(np.float64)
        own = np.flatnonzero(words > 0)
        mix = mixtures(like, weight, words[own])
        share[i + own] = mix
        pred[i + own] = mix.argmax(1)
        score[i + own] = np.minimum(mix.max(1), 1.0)
    pred[~letter], score[~letter], share[~letter] = -1, 0.0, 0.0
    return pred, score, share


def held_out_fold():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, held_out=None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, shares (map from language to proportion, those above zero).

    Learns from text and lang of rows that aren't held out and have both. Null texts and texts without a letter are
    `und` with score 0, and so is every text when nothing could be learned. Ties go to the first language by name.
    A null doc_id isn't held out and stays null; repeated rows count each time. Empty table: empty result.
    """
    spark = docs.sparkSession
    held = held_out if held_out is not None else held_out_fold()
    langs, logp = learn(docs, ~held, Scratch(spark, "language"))
    model = spark.sparkContext.broadcast((langs, logp))

    def run(it):
        langs, logp = model.value
        for batch in (part for whole in it for part in slices(whole, "text")):
            pred, score, share = predict(batch.column("text"), langs, logp)
            names = [langs[k] if k >= 0 else UNKNOWN for k in pred.tolist()]
            shares = [[(langs[k], float(row[k])) for k in np.flatnonzero(row > 1e-4).tolist()] for row in share]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double, shares map<string,double>")


def in_some_language(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, whose text has a language: the pipeline's stage.

    Only null texts and texts without a letter go. Where nothing could be learned (no row with a label, or all of them
    held out) every text with a letter stays: not knowing its name is no reason to drop it.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, ~held_out_fold(), Scratch(spark, "language")))

    def run(it):
        langs, logp = model.value
        for batch in (part for whole in it for part in slices(whole, "text")):
            keep = predict(batch.column("text"), langs, logp)[0] >= 0 if langs else has_letter(batch.column("text"))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the language of every row of `documents`."""
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
