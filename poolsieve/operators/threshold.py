"""Order statistics by radix selection, and the score that a top fraction of rows reaches.

The bits of a number, made to sort as the numbers do, are found 16 at a time: a
pass counts the values of the next 16 bits among the rows whose leading bits are
known, as one histogram of 65,536 counts for each task, summed by a shuffle.  Once no
more rows than a histogram has counts share the leading bits, the rest of them is
fetched and ordered.  Four passes over one column at most find any position exactly,
whatever the size and the ties of the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGIT = 16
_SIGN = np.uint64(1 << 63)
#: The digit that rows without a number are counted under; it is none of a number.
_NONE = 1 << DIGIT


def _ascending(values: pa.Array) -> tuple[np.ndarray, int]:
    """Keys that sort as the numbers do, and how many are null or no number."""
    known = values.drop_null()
    if pa.types.is_floating(values.type):
        x = known.to_numpy(zero_copy_only=False).astype(np.float64)
        x = x[~np.isnan(x)] + 0.0  # one zero
        bits = x.view(np.uint64)
        keys = np.where(bits & _SIGN, ~bits, bits | _SIGN)
    else:
        keys = known.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) ^ _SIGN
    return keys, len(values) - len(keys)


def _number(key: int, floating: bool) -> float | int:
    bits = np.uint64(key)
    if floating:
        return float((bits ^ _SIGN if bits & _SIGN else ~bits).view(np.float64))
    return int((bits ^ _SIGN).view(np.int64))


def _histogram(prefix: int, done: int, descending: bool):
    """``digit, n`` of the rows that begin with ``prefix``, of ``done`` bits; the first pass counts rows without a number too."""
    flip = np.uint64(0xFFFFFFFFFFFFFFFF) if descending else np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_NONE + 1, dtype=np.int64)
        for batch in batches:
            keys, none = _ascending(batch.column(0))
            keys = keys ^ flip
            if done:
                keys = keys[keys >> np.uint64(64 - done) == np.uint64(prefix)]
            else:
                counts[_NONE] += none
            digits = (keys >> np.uint64(64 - DIGIT - done)) & np.uint64(_NONE - 1)
            counts[:_NONE] += np.bincount(digits.astype(np.int64), minlength=_NONE)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(counts[there])], ["digit", "n"])

    return run


def _rest(prefix: int, done: int, descending: bool):
    """``key`` of the rows that begin with ``prefix``."""
    flip = np.uint64(0xFFFFFFFFFFFFFFFF) if descending else np.uint64(0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = _ascending(batch.column(0))[0] ^ flip
            yield pa.RecordBatch.from_arrays([pa.array(keys[keys >> np.uint64(64 - done) == np.uint64(prefix)].view(np.int64))], ["key"])

    return run


def order_statistic(df: DataFrame, column: str | Column, place: int | None = None, fraction: float | None = None, descending: bool = False) -> float | int | None:
    """The number at ``place``, counted from 0, or at ``int(rows * fraction)``, in order.

    Null and NaN count as rows and come last in either order; None if the place falls on them, or on no row.
    """
    numbers = df.select(F.col(column) if isinstance(column, str) else column)
    floating = numbers.schema[0].dataType.typeName() in ("double", "float")
    prefix = 0
    for done in range(0, 64, DIGIT):
        told = numbers.mapInArrow(_histogram(prefix, done, descending), "digit int, n long").groupBy("digit").agg(F.sum("n").alias("n")).collect()  # 65,537 counts at most
        digits = np.array([r["digit"] for r in told], dtype=np.int64)
        counts = np.array([r["n"] for r in told], dtype=np.int64)
        if not done and fraction is not None:
            place = int(int(counts.sum()) * fraction)
        order = np.argsort(digits)
        order = order[digits[order] != _NONE]
        ends = np.cumsum(counts[order])
        at = int(np.searchsorted(ends, place, side="right"))
        if at == len(order):
            return None
        place -= int(ends[at] - counts[order[at]])
        prefix = prefix << DIGIT | int(digits[order[at]])
        if counts[order[at]] <= _NONE and done + DIGIT < 64:
            keys = numbers.mapInArrow(_rest(prefix, done + DIGIT, descending), "key long").collect()  # 65,536 at most
            prefix = sorted(r["key"] % (1 << 64) for r in keys)[place]
            break
    return _number(prefix ^ 0xFFFFFFFFFFFFFFFF if descending else prefix, floating)


def top_fraction_threshold(df: DataFrame, column: str, fraction: float) -> float | None:
    """The score at position ``int(rows * fraction)`` from the top, counted from 0.

    Null and NaN scores count as rows but come last; None if the position falls
    on them, or on no row at all.
    """
    if not 0 <= fraction < 1:
        raise ValueError("the fraction must be at least 0 and below 1")
    return order_statistic(df, F.col(column).cast("double"), fraction=fraction, descending=True)
