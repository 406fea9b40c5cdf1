"""MinHash near-dedup (op7): signature-coordinate inverted join, confirmed on full shingle sets.

Texts with the same shingle set are one class. Each class has a signature of K coordinates; every (coordinate, value)
pair is a token with a posting list of classes. Two sets of similarity 0.75 agree in at least T of the K coordinates
(all but a few of a million such pairs), so this is a T-occurrence join:

* prefix: a class whose tokens are ordered from rare to frequent needs postings for all but its last T-1 tokens only,
  and none if fewer than T of its tokens are shared at all; a passage that thousands of documents share stays out of
  the lists unless it makes up half of a document;
* skip: a list first links its members through one leader. Then only pairs that no chain of confirmed links joins
  count: a list names for each class the other components in it that have a member of enough collisions, and each
  such class meets the members of that component once, whatever the number of lists they share;
* collisions are counted on one-bit coordinates (BITS of them), and what passes the match threshold is confirmed by the
  sizes of intersection and union of the full sets.

Lists and components are cut into cells of bounded size, so neither is ever in one task as a whole.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesets import LOWER, flat, mix, pieces, words
from .memory import lean, lean_groups, slices
from .scratch import Scratch

WIDTH, PERCENT = 5, 75
K, T = 64, 32
#: One-bit coordinates for counting collisions, and how many of them two sets of similarity 0.75 agree in at least
#: (448 expected, a deviation of 7.5, so all but one of a million pairs).
BITS, AGREE = 512, 408
#: Most classes of a list or component on one side of a cell, and shingles of the classes there.
CELL, CELL_SHINGLES = 2048, 1 << 20

_rng = np.random.Generator(np.random.PCG64(75))
SEEDS = _rng.integers(0, 1 << 64, K, dtype=np.uint64)[:, None]
ODD = (_rng.integers(0, 1 << 64, K, dtype=np.uint64) | np.uint64(1))[:, None]
BIT_SEEDS = _rng.integers(0, 1 << 64, BITS, dtype=np.uint64)[:, None]
BIT_ODD = (_rng.integers(0, 1 << 64, BITS, dtype=np.uint64) | np.uint64(1))[:, None]


def chain(h: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each first one on. Word after word is mixed in, so that no sum of word hashes stands for another."""
    x = np.full(len(first), size, np.uint64)
    for k in range(size):
        x = mix(x ^ h[first + k])
    return x


def shingle_sets(column):
    """The sorted distinct 64-bit shingle hashes of each text."""
    data, off = flat(column)
    for i, j in pieces(off, 1 << 18):
        h, _, _, n = words(LOWER[data[off[i] : off[j]]], off[i : j + 1] - off[i])
        full = np.concatenate([chain(h, np.arange(a, min(a + (1 << 14), len(h) - WIDTH + 1)), WIDTH) for a in range(0, len(h) - WIDTH + 1, 1 << 14)] or [np.zeros(0, np.uint64)])
        end = 0
        for size in n.tolist():
            start, end = end, end + size
            if size >= WIDTH:
                yield np.unique(full[start : end - WIDTH + 1])
            elif size:
                yield chain(h, np.array([start]), size)
            else:
                yield np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def least(s: np.ndarray, seeds: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least hash of the set under each of the functions."""
    out = np.full((len(seeds), 1), np.iinfo(np.uint64).max, np.uint64)
    step = max(64, (1 << 17) // len(seeds))
    for a in range(0, len(s), step):
        out = np.minimum(out, ((s[a : a + step] ^ seeds) * odd).min(1, keepdims=True))
    return out.ravel()


def signature(s: np.ndarray) -> np.ndarray:
    return least(s, SEEDS, ODD).view(np.int64)


def sketch(s: np.ndarray) -> np.ndarray:
    """One bit of each of BITS coordinates, as 64-bit integers."""
    return np.packbits((mix(least(s, BIT_SEEDS, BIT_ODD)) & np.uint64(1)).astype(np.uint8)).view(np.int64)


@lean
def sign(it):
    for whole in it:
        for batch in slices(whole, "text"):
            sets = list(shingle_sets(batch.column("text")))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()), pa.array([signature(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "n_shingles", "class", "sig"],
            )


@lean
def full_sets(it):
    """(class, text) to (class, n, sketch, members); a text that isn't the class's own is left out."""
    for whole in it:
        for batch in slices(whole, "text"):
            sets = shingle_sets(batch.column("text"))
            own = [(c, s) for c, s in zip(batch.column("class").to_pylist(), sets, strict=True) if set_key(s) == c]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([c for c, _ in own], pa.binary()), pa.array([len(s) for _, s in own], pa.int64()),
                    pa.array([sketch(s) for _, s in own], pa.list_(pa.int64())), pa.array([s.tobytes() for _, s in own], pa.binary()),
                ],
                names=["class", "n", "sketch", "members"],
            )


def linked_sets(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two full sets (sorted) have the similarity."""
    x, y = (x, y) if len(x) <= len(y) else (y, x)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def confirm(percent: int):
    def run(it):
        for batch in it:
            keep = [linked_sets(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column("set_a"), batch.column("set_b"), strict=True)]
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    return lean(run)


def signs(column) -> np.ndarray:
    """A row of +1 and -1 for each sketch: their product is twice the agreeing coordinates less BITS."""
    raw = np.asarray(pc.list_flatten(column)).view(np.uint8).reshape(-1, BITS // 8)
    return np.unpackbits(raw, axis=1).astype(np.float32) * 2 - 1


def near(signs_a, n_a, signs_b, n_b, percent: int) -> np.ndarray:
    """Agreeing coordinates of every pair, 0 where they or the sizes rule a link out."""
    agree = (signs_a @ signs_b.T + BITS) / 2
    few = (agree < AGREE) | (100 * np.minimum(n_a[:, None], n_b[None, :]) < percent * np.maximum(n_a[:, None], n_b[None, :]))
    agree[few] = 0
    return agree


def shared_before(tokens, token: int, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Whether two classes share a list of a smaller token, for rows times cols: that list is where they meet."""
    values, owner = np.asarray(pc.list_flatten(tokens)), np.asarray(pc.list_parent_indices(tokens))
    low = values < token
    _, code, n = np.unique(values[low], return_inverse=True, return_counts=True)
    owner, code = owner[low][n[code] > 1], code[n[code] > 1]
    _, code = np.unique(code, return_inverse=True)
    out = np.zeros((len(rows), len(cols)), bool)
    for a in range(0, int(code.max()) + 1 if len(code) else 0, 1024):
        some = (code >= a) & (code < a + 1024)
        has = np.zeros((len(tokens), 1024), np.float32)
        has[owner[some], code[some] - a] = 1
        out |= has[rows] @ has[cols].T > 0
    return out


def meet(percent: int):
    """One cell of a list: for each class the other components in which it has a class of enough collisions.

    Of two components the smaller one's classes are named, so a large component isn't sent around. Two classes meet in
    the first of their common lists only.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        one, two = table["cell_i"][0].as_py(), table["cell_j"][0].as_py()
        side = table["own"].to_numpy()
        rows = np.flatnonzero(side == one)
        cols = np.flatnonzero(side == two)
        bits, n = signs(table["sketch"].combine_chunks()), table["n"].to_numpy()
        coded = pc.dictionary_encode(table["comp"].combine_chunks())
        comp, names, size = coded.indices.to_numpy(), coded.dictionary.to_pylist(), table["members"].to_numpy()
        of_comp = np.zeros(len(names), np.int64)
        of_comp[comp] = size
        place = np.empty(len(names), np.int64)
        place[sorted(range(len(names)), key=lambda c: (of_comp[c], names[c]))] = np.arange(len(names))
        rank = place[comp]
        found = set()
        token, tokens = table["token"][0].as_py(), table["tokens"].combine_chunks()
        for a in range(0, len(rows), 256):
            some = rows[a : a + 256]
            agree = near(bits[some], n[some], bits[cols], n[cols], percent)
            agree[comp[some][:, None] == comp[cols][None, :]] = 0
            if agree.any():
                agree[shared_before(tokens, token, some, cols)] = 0
            i, j = np.nonzero(agree)
            x, y = some[i], cols[j]
            x, y = np.where(rank[x] < rank[y], x, y), np.where(rank[x] < rank[y], y, x)
            head = np.full(len(names), -1)
            head[comp[y]] = y  # any member names the component
            found.update(zip(x.tolist(), head[comp[y]].tolist(), strict=True))
        classes, comps = table["class"], table["comp"]
        x, y = [p for p, _ in found], [p for _, p in found]
        return pa.table({"class": classes.take(pa.array(x, pa.int64())), "comp": comps.take(pa.array(y, pa.int64()))})

    return lean_groups(run)


def visit(percent: int):
    """One cell of a component: each visiting class is linked with the first member, by collisions, that is confirmed."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        guest = table["guest"].to_numpy(zero_copy_only=False)
        hosts, guests = np.flatnonzero(~guest), np.flatnonzero(guest)
        bits, n = signs(table["sketch"].combine_chunks()), table["n"].to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["members"].combine_chunks()]
        out = []
        for a in range(0, len(guests), 256):
            some = guests[a : a + 256]
            agree = near(bits[some], n[some], bits[hosts], n[hosts], percent)
            for k, row in zip(some.tolist(), agree, strict=True):
                order = np.argsort(-row, kind="stable")
                for m in hosts[order[: int((row > 0).sum())]].tolist():
                    if linked_sets(sets[k], sets[m], percent):
                        out.append((k, m))
                        break
        classes = table["class"]
        return pa.table({"a": classes.take(pa.array([k for k, _ in out], pa.int64())), "b": classes.take(pa.array([m for _, m in out], pa.int64()))})

    return lean_groups(run)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the least node of its component.

    Large-star and small-star in turn: each node's neighbours are tied to the least of them, until only stars are left.
    """
    edges = scratch.few(links.select("a", "b").filter("a <> b"), f"{name}-0")
    k = 0
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = scratch.few(large, f"{name}-{k}-large")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e"))
        k += 1
        edges = scratch.few(small.select("e.*").filter("a <> b").distinct(), f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}", f"{name}-{k - 1}-large")
        # stars: every node points to one other, which points nowhere
        ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 OR (out = 1 AND in = 1)").isEmpty():
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select("b", "b").distinct())


def linked(docs: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signed rows, classes, and confirmed links between classes that keep every component together."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    signed = scratch.table(rows.mapInArrow(sign, "doc_id long, n_shingles long, class binary, sig array<long>"), "signed")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("class").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")
    )
    classes = scratch.few(classes, "classes")
    tokens = classes.select("class", F.posexplode("sig")).select("class", F.xxhash64("pos", "col").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = tokens.join(frequent, "token").groupBy("class").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t")).filter(F.size("t") >= T)
    postings = scratch.few(shared.select("class", F.explode(F.slice("t", F.lit(1), F.size("t") - (T - 1))).alias("x")).select("class", F.col("x.token").alias("token")), "postings")
    texts = rows.join(postings.select("class").distinct().join(classes, "class").select("class", F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id").select("class", "text")
    sets = scratch.few(texts.mapInArrow(full_sets, "class binary, n long, sketch array<long>, members binary").dropDuplicates(["class"]), "sets")
    known = sets.select("class", "n", "sketch")

    # each list ties its members to one of them
    heads = postings.groupBy("token").agg(F.min(F.struct(F.xxhash64("class"), "class")).alias("h"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("token", F.col("h.class").alias("b"))
    pairs = postings.select("token", F.col("class").alias("a")).join(heads, "token").filter("a <> b").select("a", "b").distinct()
    ends = [known.select(F.col("class").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"sketch_{x}")) for x in "ab"]
    differ = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    pairs = pairs.join(ends[0], "a").join(ends[1], "b").filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (BITS - differ >= AGREE)).select("a", "b")
    full = pairs.join(sets.select(F.col("class").alias("a"), F.col("members").alias("set_a")), "a").join(sets.select(F.col("class").alias("b"), F.col("members").alias("set_b")), "b")
    links = scratch.few(full.mapInArrow(confirm(percent), "a binary, b binary"), "links-0")
    if links.isEmpty():
        comp = known.select(F.col("class").alias("node"), F.col("class").alias("comp"))
    else:
        comp = components(links, scratch, "comp-0")
        comp = known.select(F.col("class").alias("node")).join(comp, "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("members"))
    comp = scratch.few(comp.join(sizes, "comp").join(known.withColumnRenamed("class", "node"), "node"), "comp")

    # classes of different components that share a list
    lists = postings.groupBy("class").agg(F.collect_list("token").alias("tokens")).join(comp.withColumnRenamed("node", "class"), "class")
    lists = lists.select("class", "comp", "members", "n", "sketch", "tokens", F.explode("tokens").alias("token"))
    open_ = lists.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low <> high").select("token", F.ceil(F.col("m") / CELL).cast("int").alias("cells"))
    lists = lists.join(open_, "token").withColumn("own", F.pmod(F.xxhash64("class"), F.col("cells")).cast("int"))
    lists = lists.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    lists = lists.select("token", F.least("own", "other").alias("cell_i"), F.greatest("own", "other").alias("cell_j"), "own", "class", "comp", "members", "n", "sketch", "tokens")
    visits = lists.groupBy("token", "cell_i", "cell_j").applyInArrow(meet(percent), "class binary, comp binary").distinct()
    visits = scratch.few(visits, "visits")

    # they meet the members of that component, in cells
    members = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("host_n"))
    guests = visits.join(known.select("class", "n"), "class").groupBy("comp").agg(F.count(F.lit(1)).alias("guests"), F.sum("n").alias("guest_n")).join(members, "comp")
    cells = lambda rows, n: F.ceil(F.greatest(F.col(rows) / CELL, F.col(n) / CELL_SHINGLES)).cast("int")
    guests = guests.select("comp", cells("guests", "guest_n").alias("columns"), cells("hosts", "host_n").alias("rows"))
    guests = scratch.few(guests, "guests")
    of = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    hosts = comp.select("comp", F.col("node").alias("class")).join(guests, "comp").withColumn("i", of("rows")).withColumn("j", each("columns")).select("comp", "i", "j", "class", F.lit(False).alias("guest"))
    come = visits.select("comp", "class").join(guests, "comp").withColumn("j", of("columns")).withColumn("i", each("rows")).select("comp", "i", "j", "class", F.lit(True).alias("guest"))
    met = hosts.unionByName(come).join(sets, "class")
    more = scratch.few(met.groupBy("comp", "i", "j").applyInArrow(visit(percent), "a binary, b binary"), "links-1")
    if not more.isEmpty():
        links = links.union(more)
    elif links.isEmpty():
        return signed, classes, None
    return signed, classes, components(links, scratch, "comp-1")


def near_dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * intersection >= percent * union of their 5-word shingle sets (A-Z lower-cased; a
    text of fewer words has its whole sequence as its one shingle). Null, empty and wordless texts link with nothing.
    Rows that share a doc_id link like others; a row without doc_id is returned with a null component_id and kept
    false and links with nothing. Empty table: empty result. Other columns are ignored.
    percent: below 75 the number of coordinates would have to grow.
    """
    scratch = Scratch(docs.sparkSession, "near")
    signed, classes, comp = linked(docs, percent, scratch)
    if comp is not None:
        comp = scratch.few(comp, "labels")
        tied = comp.withColumnRenamed("node", "class").join(classes.select("class", "rep"), "class")
        least = tied.groupBy("comp").agg(F.min("rep").alias("component_id"))
        groups = tied.join(least, "comp").select("class", "component_id")
        single = classes.filter("copies > 1").join(comp.select(F.col("node").alias("class")), "class", "left_anti").select("class", F.col("rep").alias("component_id"))
        groups = groups.union(single)
    else:
        groups = classes.filter("copies > 1").select("class", F.col("rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "class").join(groups, "class", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    out = scratch.few(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))), "result")
    scratch.drop_all_but("result", "input")
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs`, with all their columns, that stand for their component: the pipeline's stage. Rows without doc_id stay."""
    gone = near_dedup(docs).filter("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: the component of every row of `documents`."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
