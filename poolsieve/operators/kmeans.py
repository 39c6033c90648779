"""Lloyd's k-means with the centroids in a table.

Any number of centroids works: they are never collected or broadcast.  Tasks read
their table, block by block, from the shared folder, for some thousands of vectors
at a time, and only if one of these needs it: each vector keeps an upper bound of
the distance to its centroid and a lower bound of that to all others, which the
moves of the centroids loosen (Hamerly's bounds).  While they do not meet, the
assignment cannot have changed and nothing is computed.

Sums of the vectors of each centroid are added up in tasks first, by chunk, and
then by a shuffle of those, so a centroid that a third of all vectors have is a few
rows for each task.  Chunks are added in the order of their numbers.  A centroid
without vectors takes over half of the largest cluster (its centroid is moved to
either side a little), the next one half of the next, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsieve.operators.threshold import order_statistic
from poolsieve.session import discard, written
from poolsieve.sources import files

#: Bytes of vectors that a task assigns at once, of centroids in a block, and of distances.
CHUNK_BYTES = 64 << 20
BLOCK_BYTES = 16 << 20
DISTANCE_BYTES = 32 << 20
#: How far an empty centroid and the one it is split from are moved, as a share.
SPLIT = 1 / 1024
#: Rounds in which first centroids are drawn.
ROUNDS = 8
#: Rounding that the bounds allow for, as a share of a distance.
SLACK = 1e-9

_STATE = "vector array<double>, centroid_id long, upper double, lower double"
_CENTROIDS = "centroid_id long, c array<double>, moved double"


def matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(len(column), -1)


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.ravel()))


@dataclass
class CentroidFiles:
    """A written table of centroids, read by tasks."""

    path: str

    def _open(self) -> Iterator[pq.ParquetFile]:
        for path, _ in files.listing(self.path):
            with files.open_input(path) as f:
                yield pq.ParquetFile(f)

    def moves(self) -> tuple[np.ndarray, np.ndarray]:
        """Ids in order, and how far each centroid moved last."""
        parts = [f.read(["centroid_id", "moved"]) for f in self._open()]
        table = pa.concat_tables(parts).sort_by("centroid_id")
        return table["centroid_id"].to_numpy(), table["moved"].to_numpy()

    def blocks(self, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and centroids, block by block; ids are in order within a block."""
        rows = max(1, BLOCK_BYTES // (8 * max(dim, 1)))
        for f in self._open():
            for batch in f.iter_batches(rows, columns=["centroid_id", "c"]):
                ids, c = batch.column("centroid_id").to_numpy(), matrix(batch.column("c"))
                order = np.argsort(ids)
                yield ids[order], c[order]


def nearest_two(x: np.ndarray, centroids: CentroidFiles) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the id of the nearest centroid, of equals the smallest, its distance, and that of the next one."""
    n = len(x)
    chosen, best, second = np.full(n, -1), np.full(n, np.inf), np.full(n, np.inf)
    squares = (x * x).sum(axis=1)
    for ids, c in centroids.blocks(x.shape[1]):
        norms = (c * c).sum(axis=1)
        each = max(1, DISTANCE_BYTES // (8 * len(ids)))
        for lo in range(0, n, each):
            rows = slice(lo, min(lo + each, n))
            d = np.maximum(squares[rows, None] - 2 * (x[rows] @ c.T) + norms, 0)
            k = d.argmin(axis=1)
            at = np.arange(len(k))
            near = d[at, k]
            d[at, k] = np.inf
            after = d.min(axis=1)
            wins = (near < best[rows]) | ((near == best[rows]) & (ids[k] < chosen[rows]))
            second[rows] = np.where(wins, np.minimum(best[rows], after), np.minimum(second[rows], near))
            best[rows], chosen[rows] = np.where(wins, near, best[rows]), np.where(wins, ids[k], chosen[rows])
    return chosen, np.sqrt(best), np.sqrt(second)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > CHUNK_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _assign(centroids: CentroidFiles):
    """Every vector's centroid and bounds, by the bounds before where they suffice."""

    def run(batches):
        ids, moved = None, None
        for rows in _chunks(batches):
            if ids is None:
                ids, moved = centroids.moves()
            x = matrix(rows["vector"])
            chosen, upper, lower = (rows[c].to_numpy().copy() for c in ("centroid_id", "upper", "lower"))
            known = chosen >= 0
            upper[known] += moved[np.searchsorted(ids, chosen[known])]
            lower -= moved.max(initial=0)
            look = np.flatnonzero(~known | ~(upper * (1 + SLACK) < lower * (1 - SLACK)))
            if len(look):
                chosen[look], upper[look], lower[look] = nearest_two(x[look], centroids)
            yield pa.RecordBatch.from_arrays([rows["vector"].combine_chunks(), pa.array(chosen), pa.array(upper), pa.array(lower)], ["vector", "centroid_id", "upper", "lower"])

    return run


def _partial_sums(batches):
    """``centroid_id, chunk, n, total`` of every chunk."""
    from pyspark import TaskContext

    for k, rows in enumerate(_chunks(batches)):
        x, chosen = matrix(rows["vector"]), rows["centroid_id"].to_numpy()
        order = np.argsort(chosen, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(chosen[order]) > 0])
        total, n = np.add.reduceat(x[order], first, axis=0), np.diff(np.r_[first, len(order)])
        chunk = np.full(len(first), TaskContext.get().partitionId() << 32 | k)
        yield pa.RecordBatch.from_arrays([pa.array(chosen[order][first]), pa.array(chunk), pa.array(n), _lists(total)], ["centroid_id", "chunk", "n", "total"])


def _sums(batches):
    """Sums of rows of equal ids that follow each other."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n, total = batch.column("centroid_id").to_numpy(), batch.column("n").to_numpy(), matrix(batch.column("total"))
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        ids, n, total = ids[first], np.add.reduceat(n, first), np.add.reduceat(total, first, axis=0)
        if held is not None:
            if held[0][0] == ids[0]:
                n[0], total[0] = n[0] + held[1][0], total[0] + held[2][0]
            else:
                yield _sum_batch(*held)
        if len(ids) > 1:
            yield _sum_batch(ids[:-1], n[:-1], total[:-1])
        held = ids[-1:], n[-1:].copy(), total[-1:].copy()
    if held is not None:
        yield _sum_batch(*held)


def _sum_batch(ids: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), _lists(total)], ["centroid_id", "n", "total"])


def _closer(centroids: CentroidFiles):
    """``far``, the squared distance to the nearest centroid, lowered by those of some more."""

    def run(batches):
        for rows in _chunks(batches):
            x = matrix(rows["vector"])
            _, near, _ = nearest_two(x, centroids)
            near[near * near <= SLACK * (x * x).sum(axis=1)] = 0
            far = np.minimum(rows["far"].to_numpy(), near * near)
            yield pa.RecordBatch.from_arrays([rows["vector"].combine_chunks(), rows["h"].combine_chunks(), pa.array(far)], ["vector", "h", "far"])

    return run


def first_centroids(vectors: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """``centroid_id, c``: ``k`` different vectors; all, if there are fewer.  ``vectors`` has ``vector``.

    They are drawn in ROUNDS rounds, each from the vectors far from those drawn
    before: the chance of one grows with its squared distance (exponential keys, of
    which the least are taken).  Draws depend on the seed and the vectors alone, not
    on how they are dealt.  Each vector meets each centroid once.
    """
    rounds = min(ROUNDS, k)
    state = written(vectors.select("vector", F.xxhash64("vector", F.lit(seed)).alias("h"), F.lit(float("inf")).alias("far")))
    chosen = None
    for r in range(rounds):
        want = k * (r + 1) // rounds - k * r // rounds
        unit = (F.shiftrightunsigned(F.xxhash64("h", F.lit(r)), 11) + 0.5) / float(1 << 53)
        key = unit if r == 0 else F.when(F.col("far") > 0, -F.log(unit) / F.col("far"))
        keys = state.select("vector", key.alias("key")).where("key IS NOT NULL")
        last = order_statistic(keys.select("key").distinct(), "key", want - 1)
        few = keys if last is None else keys.where(F.col("key") <= last)
        drawn = few.groupBy("key").agg(F.first("vector").alias("c"))
        place = drawn.select("key", (F.row_number().over(Window.orderBy("key")) + (k * r // rounds - 1)).cast("long").alias("centroid_id"))  # k keys
        new = written(drawn.join(place, "key").select("centroid_id", "c", F.lit(0.0).alias("moved")))
        chosen = new if chosen is None else chosen.unionByName(new)
        if r < rounds - 1:
            nearer = written(state.mapInArrow(_closer(CentroidFiles(new._written)), "vector array<double>, h long, far double"))
            discard(state)
            state = nearer
    discard(state)
    return chosen.select("centroid_id", "c")


def moved_centroids(centroids: DataFrame, sums: DataFrame) -> DataFrame:
    """``centroid_id, c, moved`` after one step; ``sums`` has ``centroid_id, n, total`` of the centroids that have vectors."""
    told = centroids.select("centroid_id", "c").join(sums, "centroid_id", "left")
    mean = F.when(F.col("n") > 0, F.transform("total", lambda t: t / F.col("n"))).otherwise(F.col("c"))
    told = written(told.select("centroid_id", F.col("c").alias("before"), F.coalesce("n", F.lit(0)).alias("n"), mean.alias("c")))
    # the first empty one is split from the largest, the next one from the next; ids and counts of k centroids
    empty = told.where("n = 0").select("centroid_id", F.row_number().over(Window.orderBy("centroid_id")).alias("turn"))
    if not empty.isEmpty():
        large = told.where("n > 1").select(F.col("centroid_id").alias("donor"), F.row_number().over(Window.orderBy(F.desc("n"), "centroid_id")).alias("turn"))
        pairs = empty.join(large, "turn").select("centroid_id", "donor")
        nudged = lambda up: F.transform("c", lambda x, i: x * F.when((i % 2 == 0) == F.lit(up), 1 + SPLIT).otherwise(1 - SPLIT))
        halves = pairs.join(told.select(F.col("centroid_id").alias("donor"), "c"), "donor")
        new = halves.select("centroid_id", nudged(True).alias("new")).unionByName(halves.select(F.col("donor").alias("centroid_id"), nudged(False).alias("new")))
        told = told.join(new, "centroid_id", "left").withColumn("c", F.coalesce("new", "c"))
    far = F.aggregate(F.zip_with("before", "c", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return told.select("centroid_id", "c", F.sqrt(far).alias("moved"))


def kmeans(vectors: DataFrame, k: int | None = None, vector: str = "embedding", iterations: int = 20, seed: int = 0, start: DataFrame | None = None) -> DataFrame:
    """``centroid_id, c`` after at most ``iterations`` of Lloyd's steps, fewer if no centroid moves any more.

    Begins with ``start`` (``centroid_id, c``) or with ``k`` different vectors.
    Null vectors are left out; all others have the same length.
    """
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("vector"))
    if start is None:
        start = first_centroids(rows, k, seed)
    now = written(start.select(F.col("centroid_id").cast("long").alias("centroid_id"), F.col("c").cast("array<double>").alias("c"), F.lit(0.0).alias("moved")))
    state = written(rows.select("vector", F.lit(-1).cast("long").alias("centroid_id"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")))
    for _ in range(iterations):
        if now.isEmpty():
            break
        new = written(state.mapInArrow(_assign(CentroidFiles(now._written)), _STATE))
        discard(state)
        state = new
        part = state.select("vector", "centroid_id").mapInArrow(_partial_sums, "centroid_id long, chunk long, n long, total array<double>")
        sums = part.repartition("centroid_id").sortWithinPartitions("centroid_id", "chunk").mapInArrow(_sums, "centroid_id long, n long, total array<double>")
        new = written(moved_centroids(now, sums))
        discard(now)
        now = new
        if now.where("moved > 0").isEmpty():
            break
    discard(state)
    return now.select("centroid_id", "c")


def assigned_counts(vectors: DataFrame, centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """``centroid_id, n, inertia`` of centroids that have vectors; inertia is of all vectors, rounded to six places."""
    rows = vectors.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("vector"), F.lit(-1).cast("long").alias("centroid_id"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower"))
    table = written(centroids.select("centroid_id", "c", F.lit(0.0).alias("moved")))
    near = rows.mapInArrow(_assign(CentroidFiles(table._written)), _STATE)
    per = near.groupBy("centroid_id").agg(F.count("*").alias("n"), F.sum(F.col("upper") * F.col("upper")).alias("part"))
    total = per.agg(F.round(F.sum("part"), 6).alias("inertia"))
    return per.drop("part").crossJoin(total)  # one row
