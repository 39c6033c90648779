"""From a subset of ids and input shards to new shards.

The subset is a multiset: a sample goes out as many times as its id is there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from poolsieve.functions.uid import copy_key
from poolsieve.operators.draws import buffered
from poolsieve.operators.id_filter import may_match
from poolsieve.session import written
from poolsieve.sources.names import number_regex


@dataclass(frozen=True)
class ReshardOptions:
    shard_size: int = 10_000
    max_bytes: int = 3_000_000_000
    shard_format: str = "{:08d}.tar"
    stats_format: str = "{}_stats.json"
    #: Names of the input; None takes every tar whose name ends in a number.
    input_format: str | None = None
    input_stats_format: str | None = None
    shard_table: str | None = None
    write_shard_table: bool = False
    first_shard: int = 0
    num_shards: int | None = None
    #: Tasks that read tars, each a contiguous range of them; None deals single tars.
    num_workers: int | None = None
    shuffle_seed: int | None = None
    shuffle_buffer: int = 0
    apply_blur: bool = False
    inject_blur: bool = False
    blur_map: bool = False
    webp_quality: int = 100
    dry_run: bool = False
    overwrite: bool = False

    def check(self) -> None:
        if (self.apply_blur or self.inject_blur) and not self.blur_map:
            raise ValueError("blurring needs a blur map")
        if self.shard_size < 1 or (self.num_workers is not None and self.num_workers < 1):
            raise ValueError("shard size and number of workers must be positive")
        if self.shuffle_buffer < 0:
            raise ValueError("a buffer has no negative size")
        for form in (self.shard_format, self.input_format, self.input_stats_format):
            if form is not None:
                number_regex(form)


def shard_sizes(tars: DataFrame, stats: DataFrame, table: DataFrame | None = None) -> DataFrame:
    """``shard_id, size`` of shards that have a tar; the table's size goes before that of the stats."""
    both = tars.join(stats.select("shard_id", F.col("successes").alias("stat")), "shard_id", "left")
    if table is None:
        return both.where("stat IS NOT NULL").select("shard_id", F.col("stat").alias("size"))
    joined = both.join(table.select("shard_id", F.col("size").alias("told")), "shard_id", "left")
    return joined.select("shard_id", F.coalesce("told", "stat").alias("size")).where("size IS NOT NULL")


def in_range(shards: DataFrame, options: ReshardOptions) -> DataFrame:
    kept = shards.where(F.col("shard_id") >= options.first_shard)
    return kept if options.num_shards is None else kept.where(F.col("shard_id") < options.first_shard + options.num_shards)


def shard_offsets(shards: DataFrame) -> DataFrame:
    """``data_start``: samples in the shards before.  One row for each shard, so one ordered pass is small."""
    before = Window.orderBy("shard_id").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("data_start", F.coalesce(F.sum("size").over(before), F.lit(0)))


def with_worker(shards: DataFrame, workers: int) -> DataFrame:
    """``worker_id`` and ``data_start`` of every shard.

    Cuts are at every ``ceil(total / workers)`` samples below the total.
    """
    total, n = shards.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    each = max(1, -(-total // max(1, min(workers, n))))
    last = max(-(-total // each) - 1, 0)
    return shard_offsets(shards).withColumn("worker_id", F.least(F.floor(F.col("data_start") / each), F.lit(last)))


def worker_plan(shards: DataFrame, workers: int) -> DataFrame:
    """Contiguous ranges of shards of about equal size; workers without shards are left out."""
    return with_worker(shards, workers).groupBy("worker_id").agg(F.min("shard_id").alias("first_shard"), F.count("*").alias("shards"), F.sum("size").alias("rows"))


def multiset_join(samples: DataFrame, subset: DataFrame, ids: int | None = None) -> DataFrame:
    """Every sample once for each time its id is in the subset, with ``copy`` and ``out_key``.

    With ``ids``, the rows of the subset, samples are filtered before they are shuffled.
    """
    if ids is not None:
        samples = may_match(samples, subset, ids)
    times = subset.groupBy("uid").agg(F.count("*").cast("int").alias("times"))
    joined = samples.join(times, "uid")
    return joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))).withColumn("out_key", copy_key(F.col("uid"), F.col("copy"))).drop("times")


def missing_rows(samples: DataFrame, subset: DataFrame) -> DataFrame:
    """Rows of the subset without a sample."""
    return subset.join(samples.select("uid").distinct(), "uid", "left_anti")


def missing_count(samples: DataFrame, subset: DataFrame) -> int:
    """How many rows of the subset have no sample; each side is aggregated before it is shuffled."""
    times = subset.groupBy("uid").agg(F.count("*").alias("times"))
    return times.join(samples.select("uid").distinct(), "uid", "left_anti").agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]


def with_output_shard(rows: DataFrame, order: list[str], shard_size: int, buffer: int = 0, seed: int = 0, seen: Observation | None = None) -> DataFrame:
    """``out_shard``: without gaps, by position in the global order of ``order``, of which a ``buffer`` moves rows a little.

    The rows are range-partitioned and written once, with the partition and the
    position in it; the counts of the partitions, which are one number each, come
    from what was written, so they belong to it whatever the sampled bounds were.
    Give ids and places only: payloads are joined to the result.  ``seen`` gets
    the number of rows, ``output_rows``, counted where they are written.
    """
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = rows.repartitionByRange(parts, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    # the partition in the upper bits, the position below
    moved = buffered(ranged, buffer, seed).withColumn("__at", F.monotonically_increasing_id())
    placed = written(moved if seen is None else moved.observe(seen, F.count(F.lit(1)).alias("output_rows")))
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    start, starts = 0, []
    for k, n in sorted(placed.groupBy(part.alias("k")).count().collect()):
        starts.append((k, start))
        start += n
    table = F.broadcast(rows.sparkSession.createDataFrame(starts, "__part long, __start long"))
    found = placed.withColumn("__part", part).join(table, "__part")
    return found.withColumn("out_shard", F.floor((F.col("__start") + row) / shard_size).cast("long")).drop("__part", "__start", "__at")


def shard_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("out_shard").agg(F.count("*").alias("successes"))


def invert_blur_map(blur_map: DataFrame) -> DataFrame:
    """``shard_id, parquet`` from ``parquet, shards``."""
    return blur_map.select("parquet", F.explode("shards").alias("shard_id"))


def attach_parquet(shards: DataFrame, blur_map: DataFrame) -> DataFrame:
    """Every shard with its box table, null without one."""
    return shards.join(invert_blur_map(blur_map), "shard_id", "left")


def without_table(shards: DataFrame, blur_map: DataFrame) -> DataFrame:
    """``missing``, one row: how many shards no box table covers."""
    return attach_parquet(shards, blur_map).agg(F.sum(F.col("parquet").isNull().cast("long")).alias("missing"))


def attach_boxes(samples: DataFrame, boxes: DataFrame) -> DataFrame:
    """Samples with ``face_bboxes``; those without boxes are kept as they are."""
    found = boxes.select("parquet", "uid", "face_bboxes")
    return samples.join(found, ["parquet", "uid"], "left").withColumn("blurred", F.coalesce(F.size("face_bboxes") > 0, F.lit(False)))


def reconcile(samples: DataFrame, subset: DataFrame, out: DataFrame, expected: int | None = None) -> DataFrame:
    """One row of counts, and what does not add up."""
    counted = {"samples": samples, "subset_rows": subset, "output_rows": out, "missing_rows": missing_rows(samples, subset)}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, df in counted.items()]
    row = reduce(DataFrame.unionByName, parts).agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in counted])
    row = row.withColumn("consistent", F.col("subset_rows") - F.col("missing_rows") == F.col("output_rows"))
    return row if expected is None else row.withColumn("unprocessed", F.lit(expected) - F.col("samples"))
