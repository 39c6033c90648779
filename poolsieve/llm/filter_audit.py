"""Filter interaction audit: what each filter removes in every order of the filters.

One pass over the documents tells which filters each fails, as a mask of bits.
Counts by part and mask (cells) are all that the orders need, so the corpus is
read once however many orders there are, and nothing but counts is shuffled.

The orders are visited by adjacent transpositions (the plain changes of bell
ringers): each differs from the one before by one swap of neighbours.  Only the
two swapped steps change, and only they are counted anew from the cells; the
counts of the others stay.  A filter's Shapley sum grows along the walk: a step's
count is added, times the orders that it stood for, when the step changes.

A text is a copy when a smaller id has the identical text, in any part and
whether removed or not.  Copies are found by SHA-256 and the least id of each
text, so a text that a third of all documents have is one partial minimum a task.

Null texts are empty, and thus identical to each other and to empty ones; a null
part is the empty string.  A document without an id is no copy, and none is a copy
of it; it has no labels.  Rows that repeat an id count again; neither is smaller.
Of repeated labels any 1 counts.  Texts are read whole; an empty table has no
parts, so no rows.  Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_COUNTS = ("n", "good", "toxic")
#: Parts whose orders are written out at once.
_PARTS_AT_ONCE = 64

_WORD = r"([^\x20\x09-\x0D]+)"


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions on a text alone, by letter; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.regexp_extract_all(text, F.lit(_WORD))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


#: The filter that needs all documents: the text is one of a smaller id.
COPY = "E"


def plain_changes(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of ``n`` filters by single swaps of neighbours, each with the step whose filter was swapped with the following one's."""
    order, toward = list(range(n)), [-1] * n
    yield order, None
    while True:
        # the largest that looks at a smaller neighbour moves; larger ones turn round
        able = [x for k, x in enumerate(order) if 0 <= k + toward[x] < n and order[k + toward[x]] < x]
        if not able:
            return
        x = max(able)
        k = order.index(x)
        j = k + toward[x]
        order[k], order[j] = order[j], order[k]
        for y in range(x + 1, n):
            toward[y] = -toward[y]
        yield order, min(j, k)


def walk(cells: np.ndarray, n: int) -> tuple[list[list[int]], dict[str, np.ndarray]]:
    """All orders, and for each ``(parts, orders, steps)`` counts, from ``cells`` of ``(parts, masks, counts)``.

    Masks have a bit for each filter; counts are of documents, good and toxic ones.
    """
    masks = np.arange(1 << n)
    fails = [(masks >> f & 1).astype(bool) for f in range(n)]
    all_fail = np.stack([cells[:, fails[f], 0].sum(axis=1) for f in range(n)], axis=1)
    only = np.stack([cells[:, 1 << f, 0] for f in range(n)], axis=1)
    total = cells[:, :, 0].sum(axis=1)

    removed = np.zeros((len(cells), n, cells.shape[2]), dtype=np.int64)
    kept = np.zeros((len(cells), n), dtype=np.int64)
    shapley = np.zeros((len(cells), n), dtype=np.int64)
    since = [0] * n

    def count(order: list[int], step: int) -> None:
        before = sum(1 << f for f in order[:step])
        removed[:, step] = cells[:, fails[order[step]] & ((masks & before) == 0)].sum(axis=1)
        kept[:, step] = (kept[:, step - 1] if step else total) - removed[:, step, 0]

    orders: list[list[int]] = []
    told: dict[str, list[np.ndarray]] = {c: [] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    last: list[int] = []
    for now, (order, swapped) in enumerate(plain_changes(n)):
        steps = range(n) if swapped is None else (swapped, swapped + 1)
        for step in steps:
            if swapped is not None:
                shapley[:, last[step]] += removed[:, step, 0] * (now - since[step])
                since[step] = now
            count(order, step)
        last = list(order)
        orders.append(last)
        for c, value in zip(told, (kept, removed[:, :, 0], all_fail[:, order] - removed[:, :, 0], only[:, order], removed[:, :, 1], removed[:, :, 2]), strict=True):
            told[c].append(value.copy())
    for step in range(n):
        shapley[:, last[step]] += removed[:, step, 0] * (len(orders) - since[step])
    out = {c: np.stack(v, axis=1) for c, v in told.items()}
    out["shapley"] = shapley[:, np.array(orders)]
    return orders, out


def _orders(letters: str):
    n = len(letters)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, _PARTS_AT_ONCE):
                parts = batch.slice(lo, _PARTS_AT_ONCE)
                cells = np.zeros((parts.num_rows, 1 << n, len(_COUNTS)), dtype=np.int64)
                for k, row in enumerate(parts.column("cells").to_pylist()):
                    for cell in row:
                        cells[k, cell["mask"]] = [cell[c] for c in _COUNTS]
                orders, counts = walk(cells, n)
                shape = (parts.num_rows, len(orders), n)
                name = np.repeat(np.arange(parts.num_rows), len(orders) * n)
                order = pa.array(["".join(letters[f] for f in o) for o in orders])
                at = np.broadcast_to(np.arange(len(orders))[None, :, None], shape).ravel()
                step = np.broadcast_to(np.arange(1, n + 1, dtype=np.int32), shape).ravel()
                yield pa.RecordBatch.from_arrays(
                    [parts.column("part").take(pa.array(name)), order.take(pa.array(at)), pa.array(step), *(pa.array(v.ravel()) for v in counts.values())],
                    ["part", "filter_order", "step", *counts],
                )

    return run


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    part: str = "lang",
    filters: Callable[[Column], Mapping[str, Column]] = text_filters,
) -> DataFrame:
    """``part, filter_order, step`` and counts, one row for each part, order of the filters and step.

    ``filters`` are failure conditions on the text, by letters; the filter COPY comes after them.
    """
    letters = "".join(filters(F.col("text"))) + COPY
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(part), F.lit("")).alias("part"))
    bits = sum((F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(filters(F.col("text")).values())), F.lit(0))
    rows = docs.select("doc_id", "part", bits.cast("int").alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    marks = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # a text's own document is the least id that has it; all others of an id fail as copies
    named, unnamed = rows.where("doc_id IS NOT NULL"), rows.where("doc_id IS NULL")
    own = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("own", F.lit(True))
    copy = F.when(F.col("own").isNull(), 1 << (len(letters) - 1)).otherwise(0)
    joined = named.join(own, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select("part", (F.col("mask") + copy).alias("mask"), "good", "toxic")
    whole = joined.unionByName(unnamed.select("part", "mask"), allowMissingColumns=True)
    count = [F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    cells = whole.groupBy("part", "mask").agg(*count)
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *_COUNTS)).alias("cells"))  # at most one for each mask
    kinds = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return by_part.mapInArrow(_orders(letters), f"part string, filter_order string, step int, {kinds}")
