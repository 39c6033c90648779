"""Nearest centroids by inner product, and their making."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.functions.vector import dot
from poolsieve.operators.kmeans import kmeans

#: Bytes of centroids that one pass may broadcast.
BROADCAST_BYTES = 64 << 20
#: Inner products that a worker holds at once.
SCORES = 4 << 20


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding", max_bytes: int = BROADCAST_BYTES, score: str | None = None) -> DataFrame:
    """``vectors`` with ``centroid_id`` of the largest inner product; of equals the smallest id.

    With ``score``, that column has the inner product.

    ``centroids`` has ``centroid_id`` and ``c``.  As many of them as fit in
    ``max_bytes`` are broadcast at a time; with more, each block's best goes on
    to the next pass, so any number works in bounded memory.  A null vector
    gets a null centroid.
    """
    first = centroids.select(F.size("c")).first()
    if first is None:
        out = vectors.withColumn("centroid_id", F.lit(None).cast("long"))
        return out if score is None else out.withColumn(score, F.lit(None).cast("double"))
    block = max(1, max_bytes // (8 * max(first[0], 1)))
    ids = sorted(r[0] for r in centroids.select(F.col("centroid_id").cast("long")).collect())
    out = vectors.withColumn("centroid_id", F.lit(None).cast("long")).withColumn("__best", F.lit(None).cast("double"))
    for lo in range(0, len(ids), block):
        part = centroids.where(F.col("centroid_id").between(ids[lo], ids[min(lo + block, len(ids)) - 1])).orderBy("centroid_id").collect()
        out = _pass(out, np.array([r["centroid_id"] for r in part], dtype=np.int64), np.array([r["c"] for r in part], dtype=np.float64), vector)
    return out.drop("__best") if score is None else out.withColumnRenamed("__best", score)


def _pass(df: DataFrame, ids: np.ndarray, matrix: np.ndarray, vector: str) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches):
        ids, matrix = shared.value
        for batch in batches:
            column = batch.column(vector)
            valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            best = np.array(batch.column("__best").to_numpy(zero_copy_only=False), dtype=np.float64)
            chosen = np.array(batch.column("centroid_id").fill_null(-1).to_numpy(zero_copy_only=False), dtype=np.int64)
            some = np.array(batch.column("centroid_id").is_valid().to_numpy(zero_copy_only=False))
            each = max(1, SCORES // max(1, len(ids)))
            for at in range(0, len(valid), each):
                rows = valid[at : at + each]
                x = np.asarray(column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(rows), -1)
                scores = x @ matrix.T
                k = scores.argmax(axis=1)
                top = scores[np.arange(len(rows)), k]
                better = rows[~some[rows] | (top > best[rows])]
                where = np.isin(rows, better)
                best[better], chosen[better], some[better] = top[where], ids[k[where]], True
            names = [n for n in batch.schema.names if n not in ("centroid_id", "__best")]
            yield pa.RecordBatch.from_arrays([batch.column(n) for n in names] + [pa.array(chosen, mask=~some), pa.array(best, mask=np.isnan(best))], [*names, "centroid_id", "__best"])

    fields = [f for f in df.schema if f.name not in ("centroid_id", "__best")]
    return df.mapInArrow(run, T.StructType([*fields, T.StructField("centroid_id", T.LongType()), T.StructField("__best", T.DoubleType())]))


def target_centroids(assigned: DataFrame) -> DataFrame:
    """The different centroids of the target vectors."""
    return assigned.select("centroid_id").where("centroid_id IS NOT NULL").distinct()


def centroid_groups(assigned: DataFrame, uid: str = "uid") -> DataFrame:
    """``centroid_id, n``, and one row for each id, in order: a group of any size is spread over tasks."""
    sizes = assigned.groupBy(F.col("centroid_id").alias("__of")).agg(F.count("*").alias("n"))
    return assigned.join(sizes, F.col("centroid_id").eqNullSafe(F.col("__of"))).select("centroid_id", "n", uid).orderBy("centroid_id", uid)


def train_centroids(vectors: DataFrame, k: int, vector: str = "embedding", iterations: int = 20, seed: int = 0, sample_ratio: float = 0.0) -> DataFrame:
    """``centroid_id, c`` by Lloyd's algorithm; with a ratio, on a sample with replacement."""
    rows = vectors if sample_ratio <= 0 else vectors.sample(withReplacement=True, fraction=sample_ratio, seed=seed)
    return kmeans(rows, k, vector, iterations, seed)


def inertia(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """``inertia``, one row: the sum of every vector's squared distance to its nearest centroid.

    |x - c|^2 = |x|^2 - 2 (x . c - |c|^2 / 2), so the nearest one has the largest
    inner product once both have one more component.
    """
    x, c = F.col(vector).cast("array<double>"), F.col("c")
    longer = vectors.select(F.concat(x, F.array(F.lit(1.0))).alias("x"), dot(x, x).alias("square"))
    shifted = centroids.select("centroid_id", F.concat(c, F.array(-dot(c, c) / 2)).alias("c"))
    near = nearest_centroid(longer, shifted, "x", score="best")
    return near.agg(F.sum(F.greatest(F.col("square") - 2 * F.col("best"), F.lit(0.0))).alias("inertia"))
