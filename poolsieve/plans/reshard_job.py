"""Resharding from end to end: tars and a subset in, tars, stats and a manifest out.

Headers and JSON members are read first, and all that is decided is decided on
ids and places: which samples go out, how often, to which shard.  Then every tar
with a chosen sample is read once, and its samples go to their shards.
"""

from __future__ import annotations

import dataclasses
import json
import re
import tarfile
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from poolsieve.functions.uid import uid_hex
from poolsieve.operators import reshard
from poolsieve.operators.id_filter import may_match
from poolsieve.operators.reshard import ReshardOptions
from poolsieve.session import written
from poolsieve.sinks.subset import write_json, write_shard_table, write_tars
from poolsieve.sources import files
from poolsieve.sources.boxes import lookup_boxes
from poolsieve.sources.metadata import list_tars, read_blur_map, read_shard_stats, read_shard_table, read_subset
from poolsieve.sources.names import name_glob, number_regex
from poolsieve.sources.tar import group_members, read_index, tar_members

#: From the ending and bytes of an image, its boxes and the quality asked for, to the new ending and bytes.
Codec = Callable[[str, bytes, list, int], tuple[str, bytes]]
IMAGES = ("jpg", "jpeg", "png", "webp")

_WANTED = "array<struct<place: long, out_shard: long, out_key: string, boxes: array<array<double>>>>"


def boxes_of(spark: SparkSession, shards: DataFrame, wanted: DataFrame, map_path: str, input_dir: str) -> tuple[DataFrame, int]:
    """``shard_name, uid, face_bboxes`` of the samples ``shard_name, uid`` by the map's tables, and how many shards no table covers.

    Tables are in the map's folder; of those sorted by id only row groups with such
    an id are read.  Entries of other input folders are left out.
    """
    found = read_blur_map(spark, map_path, input_dir)
    folder = map_path.rsplit("/", 1)[0] if "/" in map_path else "."
    paths = [(r[0], files.join(folder, r[0])) for r in found.select("parquet").distinct().collect()]  # one row for each table
    missing = reshard.without_table(shards, found).first()[0] or 0
    tables = spark.createDataFrame(paths, "parquet string, path string")
    names = shards.select("shard_id", "name").join(reshard.invert_blur_map(found), "shard_id").join(tables, "parquet").select(F.col("name").alias("shard_name"), "path")
    asked = wanted.select("shard_name", "uid").distinct().join(names, "shard_name")
    return asked.join(lookup_boxes(asked), ["path", "uid"]).select("shard_name", "uid", "face_bboxes"), missing


def _payload(options: ReshardOptions, codec: Codec | None):
    """Chosen samples of each tar, as ``out_shard, out_key, fields``; a sample that fails is left out and told by a row without a shard."""

    def changed(fields: dict[str, bytes], boxes: list) -> dict[str, bytes]:
        out = {}
        for ending, data in fields.items():
            if options.inject_blur and ending == "json":
                data = json.dumps(json.loads(data) | {"face_bboxes": boxes}).encode()
            if options.apply_blur and codec is not None and ending in IMAGES:
                ending, data = codec(ending, data, boxes, options.webp_quality)
            out[ending] = data
        return out

    kinds = [pa.int64(), pa.string(), pa.map_(pa.string(), pa.binary()), pa.string()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["out_shard", "out_key", "fields", "failed"])

    def run(batches):
        for tars in batches:
            for path, wanted in zip(tars.column("path").to_pylist(), tars.column("wanted").to_pylist(), strict=True):
                by_place: dict[int, list[dict]] = {}
                for w in wanted:
                    by_place.setdefault(w["place"], []).append(w)
                rows, size = [], 0
                try:
                    with files.open_input(path) as stream:
                        for place, (_, fields) in enumerate(group_members(tar_members(stream))):
                            for w in by_place.pop(place, []):
                                try:
                                    out = changed(fields, w["boxes"]) if w["boxes"] else fields
                                    rows.append((w["out_shard"], w["out_key"], list(out.items()), None))
                                    size += sum(map(len, out.values()))
                                except Exception as e:  # the next sample may be fine
                                    rows.append((None, w["out_key"], None, f"{type(e).__name__}: {e}"))
                            if size > 1 << 26:
                                yield batch(rows)
                                rows, size = [], 0
                            if not by_place:
                                break
                except (tarfile.TarError, EOFError, OSError) as e:
                    rows += [(None, w["out_key"], None, f"{type(e).__name__}: {e}") for ws in by_place.values() for w in ws]
                if rows:
                    yield batch(rows)

    return run


def run(
    spark: SparkSession,
    input_dir: str,
    subset_path: str,
    output_dir: str,
    options: ReshardOptions | None = None,
    shard_boxes: DataFrame | None = None,
    blur_map_path: str | None = None,
    codec: Codec | None = None,
) -> dict:
    """Write the subset's samples to ``output_dir``, which all executors share; returns the manifest.

    ``shard_boxes`` has ``shard_name, uid, face_bboxes``; with ``blur_map_path``
    they are read by that map.  Blurring the images themselves is ``codec``'s.  A
    dry run counts and writes nothing.
    """
    began = time.monotonic()
    options = options or ReshardOptions()
    options.check()
    if not options.dry_run and not files.is_empty(output_dir):
        if not options.overwrite:
            raise ValueError(f"{output_dir} is not empty")
        files.clear(output_dir)
    tars = written(reshard.in_range(list_tars(spark, input_dir, options.input_format), options))
    # counters are observed in the passes that write, in their last stage, where a task that runs again counts once
    subset = read_subset(spark, subset_path).select(uid_hex(F.col("uid_bin")).alias("uid"))
    counts: dict = {"subset_rows": subset.count()}
    indexed, ordered = Observation(), Observation()
    pattern = "*.tar" if options.input_format is None else name_glob(options.input_format)
    index = read_index(spark, input_dir, pattern, options.first_shard, options.num_shards, name_format=options.input_format).withColumn("uid", F.lower("uid"))
    index = index.observe(indexed, F.count_if(F.col("damaged").isNull()).alias("samples"), F.count_if(F.col("damaged").isNotNull()).alias("damaged_shards"))
    samples = written(may_match(index.where("damaged IS NULL").select("shard_name", "place", "uid"), subset, counts["subset_rows"]))
    told = {"damaged_shards": indexed.get["damaged_shards"]}
    counts["samples"] = indexed.get["samples"]
    chosen = reshard.multiset_join(samples, subset)
    order = ["uid", "copy", "shard_name", "place"]
    if options.shuffle_seed is not None:
        chosen = chosen.withColumn("__order", F.xxhash64("out_key", F.lit(options.shuffle_seed)))
        order = ["__order", "out_key", "shard_name", "place"]
    placed = reshard.with_output_shard(chosen, order, options.shard_size, options.shuffle_buffer, options.shuffle_seed or 0, ordered)
    if options.blur_map and blur_map_path is not None:
        shard_boxes, told["shards_without_boxes"] = boxes_of(spark, tars, placed, blur_map_path, input_dir)
    sizes = _sizes(spark, input_dir, tars, options)
    expected = sizes.agg(F.sum("size")).first()[0] if sizes is not None else None
    counts |= {"output_rows": ordered.get["output_rows"], "missing_rows": reshard.missing_count(samples, subset)}
    counts["consistent"] = counts["subset_rows"] - counts["missing_rows"] == counts["output_rows"]
    if expected is not None:
        counts["unprocessed"] = expected - counts["samples"]
    if sizes is not None and options.num_workers is not None:
        told["workers"] = [r.asDict() for r in reshard.worker_plan(sizes, options.num_workers).orderBy("worker_id").collect()]
    if shard_boxes is not None:
        boxed = shard_boxes.where(F.size("face_bboxes") > 0).select("shard_name", F.lower("uid").alias("uid"), F.col("face_bboxes").cast("array<array<double>>").alias("boxes")).dropDuplicates(["shard_name", "uid"])
        with_boxes = Observation()
        placed = written(placed.join(boxed, ["shard_name", "uid"], "left").observe(with_boxes, F.count("boxes").alias("blurred")))
        told["blurred"] = with_boxes.get["blurred"]
    else:
        placed = placed.withColumn("boxes", F.lit(None).cast("array<array<double>>"))
    manifest = dataclasses.asdict(options) | counts | told | {"input_dir": input_dir, "subset_file": subset_path, "output_shard_format": options.shard_format}
    if not options.dry_run:
        # at most the copies that one tar's samples have
        wanted = placed.groupBy("shard_name").agg(F.collect_list(F.struct("place", "out_shard", "out_key", "boxes")).cast(_WANTED).alias("wanted"))
        work = tars.select("shard_id", "path", F.col("name").alias("shard_name")).join(wanted, "shard_name").select("shard_id", "path", "wanted")
        rows = _dealt(work, sizes, options.num_workers).mapInArrow(_payload(options, codec), "out_shard long, out_key string, fields map<string,binary>, failed string")
        done = write_tars(rows, output_dir, options.shard_format, options.max_bytes, options.stats_format)
        manifest |= {f"output_{k}": v or 0 for k, v in done.agg(F.count("*").alias("shard_count"), F.sum("successes").alias("count")).first().asDict().items()}
        manifest["failed_rows"] = manifest["output_rows"] - manifest["output_count"]
        files.copy(subset_path, files.join(output_dir, "sample_ids.npy"))
        if options.write_shard_table and sizes is not None:
            write_shard_table(sizes.join(tars.select("shard_id", "name"), "shard_id"), options.shard_table or files.join(input_dir, "sizes.json"))
        manifest["seconds"] = round(time.monotonic() - began, 1)
        write_json(files.join(output_dir, "meta.json"), manifest)
    return manifest


def _dealt(work: DataFrame, sizes: DataFrame | None, workers: int | None) -> DataFrame:
    """``path, wanted`` by the tasks that read them: single tars, or a contiguous range of them, in order, for each of ``workers``.

    Ranges have about as many samples each; a tar without a size goes by its number.
    """
    if workers is None:
        return work.select("path", "wanted").repartition(max(1, min(work.count(), 100_000)))
    worker = F.pmod("shard_id", F.lit(workers))
    if sizes is not None:
        work = work.join(reshard.with_worker(sizes, workers).select("shard_id", "worker_id"), "shard_id", "left")
        worker = F.coalesce("worker_id", worker)
    return work.repartitionById(workers, worker.cast("int")).sortWithinPartitions("shard_id").select("path", "wanted")


def _sizes(spark: SparkSession, input_dir: str, tars: DataFrame, options: ReshardOptions) -> DataFrame | None:
    """``shard_id, size`` as the table or the stats tell; None where neither is there."""
    table = read_shard_table(spark, options.shard_table) if options.shard_table and files.size(options.shard_table) is not None else None
    form = options.input_stats_format
    if any(form is None or re.search(number_regex(form), n) for n in files.names(input_dir, "_stats.json" if form is None else "")):
        return reshard.shard_sizes(tars, read_shard_stats(spark, input_dir, form), table)
    return None if table is None else tars.join(table.select("shard_id", "size"), "shard_id").select("shard_id", "size")
