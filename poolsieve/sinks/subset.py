"""Writers: sorted subsets, tar shards, manifests."""

from __future__ import annotations

import io
import json
import time
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsieve.functions.uid import uid_bin
from poolsieve.sources import files
from poolsieve.sources.formats import register


def sorted_ids(uids: DataFrame) -> DataFrame:
    """``uid_bin`` in unsigned order over all partitions; duplicates stay."""
    return uids.select(uid_bin(F.col("uid")).alias("uid_bin")).where("uid_bin IS NOT NULL").orderBy("uid_bin")


def write_npy(uids: DataFrame, path: str) -> int:
    """Sort the ids and write one ``.npy`` file of ``u8,u8`` pairs; returns their number.

    Every executor writes its part of the order beside the file, and then, at the
    place that the parts before it leave, to the file itself, which appears under its
    name when it is whole.  The driver sees names and counts only.  Where files cannot
    be written in place (object stores), one task puts the parts behind each other.
    """
    spark, job = register(uids.sparkSession), uuid.uuid4().hex
    folder, temp = f"{path}.parts-{job}", f"{path}.whole-{job}"
    try:
        sorted_ids(uids).write.format("pool_npy").mode("append").save(folder)
        with files.open_input(files.join(folder, "parts.json")) as f:
            parts = json.loads(f.read())
        total = sum(n for _, n in parts)
        header = io.BytesIO()
        np.lib.format.write_array_header_1_0(header, {"descr": np.lib.format.dtype_to_descr(np.dtype("u8,u8")), "fortran_order": False, "shape": (total,)})
        begin, local = header.getvalue(), files.is_local(path)
        at = len(begin)
        rows = []
        for name, n in parts:
            rows.append((name, at))
            at += 16 * n

        def place(batches):
            for batch in batches:
                for name, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    files.copy_at(files.join(folder, name), temp, at)
                yield batch

        def behind_each_other(batches):
            with files.open_output(temp) as out:
                out.write(begin)
                for batch in batches:
                    for name in batch.column(0).to_pylist():
                        with files.open_input(files.join(folder, name)) as part:
                            while data := part.read(8 << 20):
                                out.write(data)
                    yield batch

        todo = spark.createDataFrame(rows, "name string, at long")
        if local:
            files.lay_out(temp, begin, at)
            todo = todo.repartition(max(1, len(rows)))
        else:
            todo = todo.repartition(1).sortWithinPartitions("at")
        todo.mapInArrow(place if local else behind_each_other, "name string, at long").write.format("noop").mode("overwrite").save()
        files.move(temp, path)
    finally:
        files.remove(folder, missing_ok=True)
        if files.size(temp) is not None:
            files.delete(temp)
    return total


def write_tars(rows: DataFrame, folder: str, pattern: str = "{:08d}.tar", max_bytes: int = 3_000_000_000, stats: str = "{}_stats.json") -> DataFrame:
    """Write ``out_shard, out_key, fields`` rows as tar shards to a folder that all executors share.

    A shard of more than ``max_bytes`` goes on in another, and the numbers of all
    that follow move up, so they stay without gaps.  What failed or repeated tasks
    leave goes with the job's own folder; nothing appears under its name before all
    tasks are done.  Returns ``name, successes`` of what was written; stats go beside
    the tars, under ``stats`` of the tar's name without its ending.
    """
    spark, manifest = register(rows.sparkSession), files.join(folder, f"_shards-{uuid.uuid4().hex}.jsonl")
    dealt = rows.where("out_shard IS NOT NULL").select(F.col("out_shard").cast("long").alias("out_shard"), "out_key", "fields").repartition("out_shard").sortWithinPartitions("out_shard", "out_key")
    dealt.write.format("pool_tar").mode("append").options(shard_format=pattern, stats_format=stats, max_bytes=max_bytes, manifest=manifest).save(folder)
    with files.open_input(manifest) as f:
        done = [json.loads(line) for line in f.read().decode().splitlines()]  # one line for each shard
    files.delete(manifest)
    return spark.createDataFrame([(r["name"], r["successes"]) for r in done], "name string, successes long")


def write_json(path: str, record: dict) -> None:
    """A manifest, shard table or training record."""
    with files.open_output(path) as f:
        f.write(json.dumps(record, indent=2, default=str, sort_keys=True).encode())


def write_shard_table(sizes: DataFrame, path: str) -> bool:
    """``name, size`` of every shard as one JSON object, unless there is such a file; returns whether it was written."""
    if files.size(path) is not None:
        return False
    write_json(path, {r["name"]: r["size"] for r in sizes.select("name", "size").collect()})  # one row for each shard
    return True


def append_results(results: DataFrame, folder: str) -> None:
    """Lines behind those that are there; each tells when its run wrote it, and its place in the run."""
    at = F.lit(time.time_ns())
    results.withColumn("written_at", at).withColumn("written_place", F.monotonically_increasing_id()).write.mode("append").json(folder)


def write_table(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Refuses to write over what is there unless told to."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
