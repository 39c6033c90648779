"""The filters that look at one row at a time, over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.operators.filters import FilterParams, basic_condition, check_params, select_uids

#: Filters without a statistic over the whole pool.
STATELESS = ("no_filter", "basic_filter", "clip_score", "laion2b")


def stream_pool(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.parquet*").parquet(folder)


def select_uids_stream(name: str, pool: DataFrame, params: FilterParams | None = None) -> DataFrame:
    """As ``select_uids``; a fraction needs the whole pool and is refused."""
    params = params or FilterParams()
    check_params(name, params)
    if name not in STATELESS or params.fraction is not None:
        raise ValueError(f"{name} with these parameters needs the whole pool")
    return select_uids(name, pool, params)


def kept_by_window(pool: DataFrame, time: str, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """How many samples arrive and pass the basic filter in each window of event time; late rows beyond ``delay`` are left out."""
    return pool.withWatermark(time, delay).groupBy(F.window(time, window)).agg(F.count("*").alias("n"), F.sum(basic_condition(FilterParams()).cast("long")).alias("kept"))


