"""A session with the settings the engine is tuned for, and tables that cut a plan."""

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName("poolsieve").config(map=SETTINGS | {k.replace("__", "."): v for k, v in extra.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; on one machine, where that is unset, one in the warehouse."""
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_written"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose folder goes when the driver ends."""
    folder = f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"
    _at_exit(spark, folder)
    return f"{folder}/{name}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder, for rows that must not change when they are read again.

    It goes when it is discarded, or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _at_exit(spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made and nothing reads any more."""
    for table in tables:
        target, system = _hadoop(table.sparkSession, table._written)
        system.delete(target, True)
        system.cancelDeleteOnExit(target)


def _at_exit(spark: SparkSession, path: str) -> None:
    target, system = _hadoop(spark, path)
    system.deleteOnExit(target)


def _hadoop(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())
