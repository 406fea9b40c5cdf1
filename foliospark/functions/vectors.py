"""Vectors as arrays of floats, accumulated in double: row by row by higher-order functions, against a target or a table as matrix products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalised(a: Column) -> Column:
    """Unit length; a zero vector stays zero. The norm is bound as a lambda's variable: it is computed once a vector, not for each element."""
    unit = lambda n: F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
    return F.element_at(F.transform(F.array(norm(a)), unit), 1)


def cosine(a: Column, b: Column) -> Column:
    """0 if one of them is zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def shortened(a: Column, size: int) -> Column:
    """The first coordinates, at unit length again."""
    return normalised(F.slice(a, 1, size))


@F.pandas_udf(T.ArrayType(T.FloatType()))
def from_blob(c: pd.Series) -> pd.Series:
    """Little-endian 32-bit floats."""
    return c.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))


@F.pandas_udf(T.BinaryType())
def to_blob(c: pd.Series) -> pd.Series:
    return c.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def matrix(column: pa.Array | pa.ChunkedArray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a length as rows in double, and where they are; others and nulls are left out."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dims), False).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(column.take(pa.array(rows)))
    return np.asarray(flat.to_numpy(zero_copy_only=False), np.float64).reshape(len(rows), dims), rows


def nearest(vectors: DataFrame, target: list[float], k: int, id_col: str = "id", vec_col: str = "vector") -> DataFrame:
    """The k vectors of largest dot product with the target, ties by id: Arrow batches times the target, k rows a task.

    Vectors of another length than the target's are another model's and not compared.
    """
    q = np.asarray(target, np.float64)

    def run(it):
        best: list[tuple[float, object]] = []
        kind = None
        for batch in it:
            kind = batch.schema.field(0).type
            m, rows = matrix(batch.column(1), len(q))
            scores = m @ q
            if len(scores) > k:  # all that reach the k-th score
                keep = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
                scores, rows = scores[keep], rows[keep]
            best = sorted([*best, *zip((-scores).tolist(), batch.column(0).take(pa.array(rows)).to_pylist(), strict=True)])[:k]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array([i for _, i in best], kind), pa.array([-s for s, _ in best], pa.float64())], names=[id_col, "score"])

    found = vectors.select(id_col, vec_col).mapInArrow(run, T.StructType([T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("score", T.DoubleType())]))
    return found.orderBy(F.desc("score"), id_col).limit(k)


#: Vectors in a block of a threshold join.
BLOCK = 4096


def within(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(a, b, score) of all vectors (id, vector) of two tables with a dot product of at least the threshold. Exact.

    Both sides are cut into blocks by a hash of the id, and a task multiplies one block with one block, whatever the
    sizes; a small side is one block. What is written are the pairs that pass.
    """
    sides = []
    blocks = [max(1, -(-df.count() // BLOCK)) for df in (left, right)]
    for df, own, other, k in ((left, *blocks, 0), (right, *blocks[::-1], 1)):
        mine, theirs = F.pmod(F.xxhash64("id"), F.lit(own)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(other - 1)))
        sides.append(df.select(F.col("id").alias(f"id{k}"), F.col("vector").alias(f"vector{k}"), mine.alias("ij"[k]), theirs.alias("ji"[k])))

    kinds = [to_arrow_type(df.schema["id"].dataType) for df in (left, right)]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:  # a side without rows has no columns
            return pa.table({"a": pa.array([], kinds[0]), "b": pa.array([], kinds[1]), "score": pa.array([], pa.float64())})
        out = []
        lengths = [set(pc.list_value_length(x).drop_null().to_pylist()) for x in (a["vector0"], b["vector1"])]
        for dims in lengths[0] & lengths[1]:
            (m, at), (n, to) = matrix(a["vector0"], dims), matrix(b["vector1"], dims)
            for s in range(0, len(m), 512):
                scores = m[s : s + 512] @ n.T
                i, j = np.nonzero(scores >= threshold)
                out.append((at[i + s], to[j], scores[i, j]))
        i, j, score = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"a": a["id0"].take(pa.array(i, pa.int64())), "b": b["id1"].take(pa.array(j, pa.int64())), "score": pa.array(score, pa.float64())})

    schema = T.StructType([T.StructField("a", left.schema["id"].dataType), T.StructField("b", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    return sides[0].groupBy("i", "j").cogroup(sides[1].groupBy("i", "j")).applyInArrow(run, schema)


def centroids(vectors: DataFrame, by: str, vec_col: str = "vector", weight: Column | None = None) -> DataFrame:
    """Weighted mean vector of each group: partial sums of each coordinate before the shuffle."""
    w = F.lit(1.0) if weight is None else weight
    parts = vectors.select(by, w.alias("w"), F.posexplode(vec_col))
    means = parts.groupBy(by, "pos").agg((F.sum(F.col("col").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    return means.groupBy(by).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("centroid"))
