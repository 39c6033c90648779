"""Draws with replacement, by rank, and orders that are shuffled a little.

Draws come from MD5 of the seed and the draw's number, so they depend neither on
partitions nor on retries, and other engines can repeat them.

Ranks of rows in a group come from a directory: counts of the rows in runs of
places, and the counts of all runs before.  No task orders more than a run, so a
group that holds most rows is spread like others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places of a group that are ranked in one task.
RUN = 1 << 16
#: Bits of a draw.
BITS = 52


def unit(*parts: Column) -> Column:
    """A number from 0 to below 2**52, drawn by the text of its parts."""
    digits = F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts])), 1, BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def directory(rows: DataFrame, group: str, place: str) -> DataFrame:
    """``group, run, kept, before, total``: how many rows each run of places has, and those before it in the group."""
    counts = rows.groupBy(group, F.floor(F.col(place) / RUN).alias("run")).agg(F.count("*").alias("kept"))
    of = Window.partitionBy(group)  # one row for each run
    before = F.coalesce(F.sum("kept").over(of.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return counts.select(group, "run", "kept", before.alias("before"), F.sum("kept").over(of).alias("total"))


def with_rank(rows: DataFrame, group: str, place: str) -> DataFrame:
    """``rows`` with ``rank`` in their group, from 0, in the order of ``place``; places of a group are different."""
    there = directory(rows, group, place).select(F.col(group).alias("__group"), F.col("run").alias("__run"), "before")
    run = F.floor(F.col(place) / RUN)
    inside = F.row_number().over(Window.partitionBy(group, run).orderBy(place)) - 1  # a run at most
    placed = rows.withColumn("rank", inside).withColumn("__run", run)
    joined = placed.alias("r").join(there.alias("d"), F.col(f"r.{group}").eqNullSafe(F.col("d.__group")) & (F.col("r.__run") == F.col("d.__run")))
    return joined.select(*[F.col(f"r.{c}") for c in rows.columns], (F.col("before") + F.col("rank")).cast("long").alias("rank"))


def sample_per_file(rows: DataFrame, ratio: float, file: str = "file_root", place: str = "row_index", seed: int = 0) -> DataFrame:
    """``int(n * ratio)`` of the ``n`` rows that each file has, drawn with replacement; all rows for a ratio of 0 or less.

    Rows that a mask took out before count for nothing: draws are of ranks among
    those that are left.
    """
    if ratio <= 0:
        return rows
    runs = directory(rows, file, place).withColumn("draws", (F.col("total") * F.lit(float(ratio))).cast("long"))
    # each run makes its share of the file's draws
    first, end = (F.floor(F.col("draws") * c / F.col("total")).cast("long") for c in (F.col("before"), F.col("before") + F.col("kept")))
    numbers = runs.where(first < end).select(F.col(file).alias("__file"), "total", F.explode(F.sequence(first, end - 1)).alias("draw"))
    drawn = numbers.select("__file", F.pmod(unit(F.lit(seed), F.coalesce(F.col("__file").cast("string"), F.lit("")), F.col("draw")), F.col("total")).alias("__rank"))
    found = with_rank(rows, file, place)
    return found.join(drawn, F.col(file).eqNullSafe(F.col("__file")) & (F.col("rank") == F.col("__rank"))).select(*rows.columns)


def draw_shards(shards: DataFrame, weights: dict[str, float], n: int, seed: int = 0, source: str = "source", shard: str = "shard_id") -> DataFrame:
    """``draw, source, shard_id``: ``n`` shards drawn with replacement, each with a chance that is its source's weight.

    Weights need not sum to 1; sources without one, or with 0, are never drawn.
    There are few sources, and each has a number of shards; a draw finds its source
    by the sums of weights, and the shard by its rank there.
    """
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights are not negative")
    counts = {r[0]: r[1] for r in shards.where(F.col(source).isin(*weights)).groupBy(source).count().collect()}  # one row for each source
    named = [s for s in sorted(counts) if weights[s] > 0]
    whole = sum(weights[s] * counts[s] for s in named)
    if not whole:
        raise ValueError("no shard has a weight")
    x = unit(F.lit(seed), F.col("draw")) / float(1 << BITS) * whole
    choice, below = F.lit(None), 0.0
    picks = []
    for s in named:
        picks.append((s, below, below + weights[s] * counts[s]))
        below += weights[s] * counts[s]
    for s, lo, hi in reversed(picks):
        rank = F.least(F.floor((F.col("x") - lo) / weights[s]), F.lit(counts[s] - 1)).cast("long")
        pick = F.struct(F.lit(s).alias("source"), rank.alias("rank"))
        choice = pick if hi == picks[-1][2] else F.when(F.col("x") < hi, pick).otherwise(choice)
    draws = shards.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("x", x).select("draw", choice.alias("p")).select("draw", F.col("p.source").alias("__source"), F.col("p.rank").alias("__rank"))
    ranked = with_rank(shards.select(source, shard), source, shard)
    return draws.join(ranked, (F.col("__source") == F.col(source)) & (F.col("__rank") == F.col("rank"))).select("draw", source, shard)


def weighted_union(parts: list[tuple[DataFrame, float]], seed: int = 0) -> DataFrame:
    """Rows of several sources, each row drawn with replacement, ``weight`` times on average, also at a weight of 1."""
    drawn = [df.sample(withReplacement=True, fraction=float(w), seed=seed + k) for k, (df, w) in enumerate(parts)]
    return concatenation(drawn)


def concatenation(parts: list[DataFrame]) -> DataFrame:
    """All rows of several sources, as they are."""
    out = parts[0]
    for df in parts[1:]:
        out = out.unionByName(df)
    return out


def buffered(rows: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """The rows of every partition, in an order that a buffer of ``size`` rows makes; 0 leaves the order.

    Row ``i`` leaves as if at ``i`` and a random number below ``size``, so it is
    moved by less than ``size`` places either way, and no more than ``size`` rows and
    one batch are held.  The order depends on the seed, the partition's number and
    the order of its rows.
    """
    if size < 0:
        raise ValueError("a buffer has no negative size")
    if size < 2:
        return rows
    return rows.mapInArrow(_buffer(size, seed), rows.schema)


def _buffer(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rng = np.random.Generator(np.random.Philox(key=[seed % (1 << 64), TaskContext.get().partitionId()]))
        held, leave, seen = None, np.zeros(0), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            leave = np.r_[leave, np.arange(seen, seen + batch.num_rows) + rng.random(batch.num_rows) * size]
            seen += batch.num_rows
            # what comes later leaves at ``seen`` or after
            order = np.argsort(leave, kind="stable")
            ready = int(np.searchsorted(leave[order], seen))
            if ready:
                yield from held.take(pa.array(order[:ready])).combine_chunks().to_batches()
                rest = np.sort(order[ready:])
                held, leave = held.take(pa.array(rest)).combine_chunks(), leave[rest]
        if held is not None and len(held):
            yield from held.take(pa.array(np.argsort(leave, kind="stable"))).combine_chunks().to_batches()

    return run
