"""Groups of rows inside Arrow batches, and their blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: At most so many keys count as hot, those with more than this part of all rows, and LEAST rows at least.
HOT_KEYS = 100_000
LEAST = 1000
SALTS = 64


def join_salted(rows: DataFrame, keyed: DataFrame, keys: list[str], count: str, seed: list[str]) -> DataFrame:
    """Inner join with ``keyed``, which has one row for each of ``keys`` and the number of rows that have them.

    Hot keys, which are HOT_KEYS at most and so may be broadcast, are dealt to SALTS tasks by a hash of ``seed``.
    """
    total = keyed.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) > max(total // HOT_KEYS, LEAST)
    few = keyed.where(hot).select(*keys, F.lit(True).alias("__hot"))
    rows = rows.join(F.broadcast(few), keys, "left").withColumn("__salt", F.when(F.col("__hot"), F.pmod(F.xxhash64(*seed), F.lit(SALTS))).otherwise(0).cast("int")).drop("__hot")
    salted = keyed.withColumn("__salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return rows.join(salted.drop(count), [*keys, "__salt"]).drop("__salt")


def by_group(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Rows of equal long ``keys``, which follow each other, as one table each; single rows are left out."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = now if rest is None else pa.concat_tables([rest, now])
        ids = np.stack([np.asarray(now.column(c).to_numpy(), dtype=np.int64) for c in keys])
        edges = np.r_[0, np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1]
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if hi - lo > 1:
                yield now.slice(lo, hi - lo).combine_chunks()
        rest = now.slice(int(edges[-1]))
    if rest is not None and len(rest) > 1:
        yield rest.combine_chunks()


def deal_blocks(rows: DataFrame, keys: list[str], seed: list[str]) -> DataFrame:
    """Deal rows with a column ``blocks`` to tasks for every two blocks ``i <= j`` of their group.

    A row's own ``block`` comes from a hash of ``seed`` columns.  Groups of one
    block stay whole; the rows of a task follow each other.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64(*seed), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("other", "blocks")
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, *keys, "i", "j").sortWithinPartitions(*keys, "i", "j")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest index it is linked to, over any number of links."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            return label
