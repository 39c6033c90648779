"""The largest inner products, exactly, without all pairs.

Candidates are dealt to cells around some of them; a cell has a centre and the
largest distance of a member to it.  No member's inner product with a query ``q`` is
above ``q . centre + |q| * radius``.  So:

1. every query meets the block of cells that holds the cell of the largest such
   bound, which gives its ``k`` best of there, and with them a score that others
   must reach;
2. it is sent to those other blocks alone that have a cell whose bound reaches that
   score, and there it meets those cells alone.

What is left out cannot be among the best, nor equal to them.  Where vectors gather
in groups most cells are left out, and fewer pairs are computed; where they point
everywhere (as random ones do) bounds tell little, all pairs are computed, and the
first step is the price.

Cells and their bounds are a table that tasks read by blocks; it is neither
collected nor broadcast.  Blocks of queries and blocks of candidates meet in tasks of
their own, and no more than ``k`` rows for each query leave one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from poolsieve.operators.kmeans import CentroidFiles, matrix, nearest_two
from poolsieve.operators.threshold import order_statistic
from poolsieve.session import written
from poolsieve.sources import files

#: Candidates of a cell on average, and rows of a side that one task compares.
CELL = 512
BLOCK = 8192
#: Inner products, or bounds, that a task holds at once.
SCORES = 4 << 20
#: Rounding that bounds and scores allow for, as a share of the vectors' lengths.
SLACK = 1e-9


def leading(a: np.ndarray, b: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, columns and inner products that hold the ``k`` largest of every row of ``a``, with their equals.

    A matrix product tells which can be among them, give or take its rounding.
    Those are added up one dimension after the other, as dot() does, so that
    equals stay equal.
    """
    rough = a @ b.T
    slack = 8 * a.shape[1] * np.finfo(np.float64).eps * np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1).max()
    least = np.partition(rough, len(b) - k, axis=1)[:, len(b) - k] if len(b) > k else np.full(len(a), -np.inf)
    row, column = np.nonzero(~(rough < (least - slack)[:, None]))  # what is not a number stays
    score = np.zeros(len(row))
    for x, y in zip(a.T, b.T, strict=True):
        score += x[row] * y[column]
    return row, column, score


@dataclass
class CellFiles:
    """The written table of cells, ``cell, block, c, radius``."""

    path: str

    def parts(self):
        """Blocks, centres and radii, some thousands of cells at a time."""
        for path, _ in files.listing(self.path):
            with files.open_input(path) as f:
                for batch in pq.ParquetFile(f).iter_batches(4096, columns=["block", "c", "radius"]):
                    yield batch.column("block").to_numpy(), matrix(batch.column("c")), batch.column("radius").to_numpy()


def _own_cell(centres: CentroidFiles):
    """Every candidate's cell, and its distance to the centre; those with components that are not finite have one of their own, without bounds."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"))
                finite = np.isfinite(x).all(axis=1)
                cell, far = np.full(len(x), -1), np.full(len(x), np.inf)
                cell[finite], far[finite], _ = nearest_two(x[finite], centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column("v"), pa.array(cell), pa.array(far)], [batch.schema.names[0], "v", "cell", "far"])

    return run


def _bounds(x: np.ndarray, c: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """The most that a member of each cell can reach with each row, a little more for rounding."""
    with np.errstate(invalid="ignore"):  # what is not a number bounds nothing
        length = np.linalg.norm(x, axis=1)[:, None]
        return x @ c.T + length * (radius + SLACK * (radius + np.linalg.norm(c, axis=1)))


def _to_blocks(cells: CellFiles, first: bool):
    """Every query to the block of its best cell; or, once it has ``reach``, to all others that can reach it."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("v"))
            best, home = np.full(len(x), -np.inf), np.zeros(len(x), dtype=np.int64)
            pairs: list[np.ndarray] = []
            for block, c, radius in cells.parts():
                each = max(1, SCORES // len(c))
                for lo in range(0, len(x), each):
                    bound = _bounds(x[lo : lo + each], c, radius)
                    if first:
                        k = bound.argmax(axis=1)
                        top = bound[np.arange(len(k)), k]
                        better = np.flatnonzero(top > best[lo : lo + each])
                        best[lo + better], home[lo + better] = top[better], block[k[better]]
                    else:
                        row, column = np.nonzero(~(bound < batch.column("reach").to_numpy()[lo : lo + each, None]))
                        pairs.append(np.unique(np.stack([row + lo, block[column]]), axis=1))
            if first:
                row, block = np.arange(len(x)), home
            else:
                row, block = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), dtype=np.int64)
                other = block != batch.column("home").to_numpy()[row]
                row, block = row[other], block[other]
            names = [n for n in batch.schema.names if n != "home"]
            taken = batch.select(names).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block)], [*names, "block"])

    return run


def _best(query: str, candidate: str, k: int):
    """The ``k`` best of a block for each query that was sent there, and the number of products it took."""

    def run(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out, pairs = [pd.DataFrame({query: [], candidate: [], "score": []})], 0
        if len(q) and len(c):
            a, bounded = matrix(pa.array(q["v"])), "reach" in q
            reach = q["reach"].to_numpy() if bounded else np.full(len(q), -np.inf)
            whole = c.sort_values(candidate)
            for cell in [x for _, x in whole.groupby("cell")] if bounded else [whole]:
                b, rows = matrix(pa.array(cell["v"])), np.arange(len(a))
                if bounded:
                    with np.errstate(invalid="ignore"):
                        middle = b.mean(axis=0)
                        radius = np.linalg.norm(b - middle, axis=1).max()
                    rows = np.flatnonzero(~(_bounds(a, middle[None], np.array([radius]))[:, 0] < reach))
                each = max(1, SCORES // len(b))
                for lo in range(0, len(rows), each):
                    some = rows[lo : lo + each]
                    pairs += len(some) * len(b)
                    row, column, score = leading(a[some], b, k)
                    there = ~(score < reach[some[row]])
                    out.append(pd.DataFrame({query: q[query].to_numpy()[some[row[there]]], candidate: cell[candidate].to_numpy()[column[there]], "score": score[there]}))
        found = pd.concat(out[1:] or out).sort_values([query, "score", candidate], ascending=[True, False, True])
        found = found.groupby(query, sort=False).head(k)
        if not len(found):  # a row that only tells the products
            found = pd.DataFrame({query: [None], candidate: [None], "score": [None]})
        found["pairs"] = [pairs] + [0] * (len(found) - 1)
        return found

    return run


def _cells(candidates: DataFrame, candidate: str, n: int, cell: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Candidates with their cells and blocks, and the table of cells, ``cell, block, c, radius``.

    A cell of more than ``block`` candidates, as copies of one vector make, is cut in pieces.
    """
    vectors = candidates.where("v IS NOT NULL").select(candidate, F.col("v").cast("array<double>").alias("v"))
    many = max(1, -(-n // cell))
    finite = F.forall("v", lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    hashed = vectors.where(finite).select("v", F.xxhash64("v").alias("h"))
    last = order_statistic(hashed.select("h").distinct(), "h", many - 1)
    drawn = (hashed if last is None else hashed.where(F.col("h") <= last)).groupBy("h").agg(F.first("v").alias("c"))
    place = drawn.select("h", (F.row_number().over(Window.orderBy("h")) - 1).cast("long").alias("centroid_id"))  # a hash for each cell
    centres = written(drawn.join(place, "h").select("centroid_id", "c", F.lit(0.0).alias("moved")))
    kind = candidates.schema[candidate].dataType.simpleString()
    own = written(vectors.mapInArrow(_own_cell(CentroidFiles(centres._written)), f"{candidate} {kind}, v array<double>, cell long, far double"))
    sizes = own.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"), F.max(F.size("v")).alias("dim")).withColumn("pieces", F.ceil(F.col("n") / block).cast("int"))
    # pieces to blocks in the order of their cells; a row for each piece
    cut = sizes.select("*", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    before = F.sum(F.col("n") / F.col("pieces")).over(Window.orderBy("cell", "piece")) - F.col("n") / F.col("pieces")
    placed = written(cut.select("cell", "piece", "pieces", "radius", "dim", F.floor(before / block).cast("long").alias("block")))
    middle = placed.join(centres.select(F.col("centroid_id").alias("cell"), "c"), "cell", "left")
    cells = written(middle.select("cell", "block", F.coalesce("c", F.array_repeat(F.lit(0.0), F.col("dim"))).alias("c"), "radius"))
    pieces = placed.select("cell", "pieces").distinct()
    dealt = own.join(pieces, "cell").withColumn("piece", F.pmod(F.xxhash64(candidate), F.col("pieces")).cast("int"))
    return dealt.join(placed.select("cell", "piece", "block"), ["cell", "piece"]).select(candidate, "v", "cell", "block"), cells


def nearest_candidates(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, k: int = 10, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """``query, candidate, score``: of all candidates each query's ``k`` of the largest inner products, of equals the smallest ids.

    Either side has its id and ``v``; with a null vector the score is null, and
    last.  Cells hold about ``cell`` candidates and blocks about ``block`` rows.
    Queries have different ids; so have candidates.
    """
    found, _ = searched(queries, candidates, query, candidate, k, block, cell)
    return found


def searched(queries: DataFrame, candidates: DataFrame, query: str, candidate: str, k: int = 10, block: int = BLOCK, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """As ``nearest_candidates``, and ``pairs``, one row: how many inner products were computed."""
    kinds = [df.schema[n].dataType.simpleString() for df, n in ((queries, query), (candidates, candidate))]
    order = [F.desc_nulls_last("score"), candidate]
    first = candidates.select(candidate).orderBy(candidate).limit(k)  # for queries without a vector
    without = queries.where("v IS NULL").select(query).crossJoin(F.broadcast(first)).select(query, candidate, F.lit(None).cast("double").alias("score"))
    asked = queries.where("v IS NOT NULL").select(query, F.col("v").cast("array<double>").alias("v"))
    result = f"{query} {kinds[0]}, {candidate} {kinds[1]}, score double, pairs long"

    def met(sent: DataFrame, here: DataFrame) -> DataFrame:
        # blocks of queries by a hash of their ids; a candidate meets each block of queries that was sent there
        turns = sent.groupBy("block").agg(F.ceil(F.count("*") / block).cast("int").alias("turns"))
        left = sent.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64(query), F.col("turns")).cast("int")).drop("turns")
        right = here.join(turns, "block").withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1))).drop("turns")
        return compared(left, right)

    def compared(left: DataFrame, right: DataFrame) -> DataFrame:
        found = left.groupBy("block", "turn").cogroup(right.groupBy("block", "turn")).applyInPandas(_best(query, candidate, k), result)
        return found.withColumn("score", F.nanvl("score", F.lit(None).cast("double")))

    n = candidates.where("v IS NOT NULL").count()
    if n <= block:  # all queries meet the one block there is
        here = candidates.where("v IS NOT NULL").select(candidate, F.col("v").cast("array<double>").alias("v"), F.lit(0).cast("long").alias("cell"), F.lit(0).cast("long").alias("block"))
        turns = max(1, -(-queries.count() // block))
        dealt = asked.withColumn("block", F.lit(0).cast("long")).withColumn("turn", F.pmod(F.xxhash64(query), F.lit(turns)).cast("int"))
        both = compared(dealt, here.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(turns - 1)))))
    else:
        here, cells = _cells(candidates, candidate, n, cell, block)
        here, table, base = written(here), CellFiles(cells._written), f"{query} {kinds[0]}, v array<double>"
        home = written(asked.mapInArrow(_to_blocks(table, True), f"{base}, block long"))
        near = written(met(home, here))
        ranked = near.where(F.col(query).isNotNull()).withColumn("__rank", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
        reach = ranked.groupBy(query).agg(F.max(F.when(F.col("__rank") == k, F.col("score"))).alias("reach"))
        again = home.withColumnRenamed("block", "home").join(reach, query, "left").withColumn("reach", F.coalesce("reach", F.lit(float("-inf"))))
        sent = written(again.mapInArrow(_to_blocks(table, False), f"{base}, reach double, block long"))
        both = near.unionByName(written(met(sent, here)))
    nulls = candidates.where("v IS NULL").select(candidate).orderBy(candidate).limit(k)
    if n < k:  # so few have vectors that others take part, last
        both = both.select(query, candidate, "score", "pairs").unionByName(asked.select(query).crossJoin(F.broadcast(nulls)).select(query, candidate, F.lit(None).cast("double").alias("score"), F.lit(0).cast("long").alias("pairs")))
    rank = F.row_number().over(Window.partitionBy(query).orderBy(*order))
    best = both.where(F.col(query).isNotNull()).drop("pairs").withColumn("__rank", rank).where(F.col("__rank") <= k).drop("__rank")
    return best.unionByName(without), both.agg(F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"))
