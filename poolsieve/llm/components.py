"""Connected components as DataFrame joins, and the lineage cuts that loops need."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``, which all executors share; on one machine, where it is unset, the warehouse."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir") + "/_cuts"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a compressed table to the folder that all executors share, and read it.

    The table goes when it is discarded, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{_folder(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    target, system = _target(spark, path)
    system.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``cut`` made and nothing reads any more."""
    target, system = _target(table.sparkSession, table._cut)
    system.delete(target, True)
    system.cancelDeleteOnExit(target)


def _target(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its smallest node.

    Alternates large-star and small-star steps: every node sends its larger
    neighbours, then its smaller ones, to the smallest node it knows.  Both
    steps are a partial aggregation and a join, so a node with very many
    neighbours is never gathered in one place.  Null ends are ignored, as are
    loops, except that a loop alone makes its node a component.
    """
    nodes = edges.select(F.explode(F.array(a, b)).alias("node")).where("node IS NOT NULL").distinct()
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").distinct())
    state = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every edge goes from a larger to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        last, now = now, cut(small)
        discard(last)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    return nodes.join(now, nodes["node"] == now["u"], "left").select("node", F.coalesce("v", "node").alias("component"))
