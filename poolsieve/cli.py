"""Command line: select samples, reshard, roll scores up."""

from __future__ import annotations

import argparse
import dataclasses
import importlib

from poolsieve.operators import rollup
from poolsieve.operators.filters import FILTERS, FilterParams, select_uids
from poolsieve.operators.reshard import ReshardOptions
from poolsieve.plans import reshard_job
from poolsieve.session import build_session
from poolsieve.sinks.subset import write_npy
from poolsieve.sources.metadata import read_pool, read_results, read_tasks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    p = sub.add_parser("select", help="write the ids that a filter keeps")
    p.add_argument("--name", required=True, choices=sorted(FILTERS))
    p.add_argument("--metadata-dir", required=True)
    p.add_argument("--save-path", required=True)
    p.add_argument("--threshold", type=float)
    p.add_argument("--fraction", type=float)
    p.add_argument("--arch", choices=["b32", "l14"])
    p.add_argument("--scale")
    p.add_argument("--lexicon", help="Parquet with a column word")
    p.add_argument("--centroids", help="Parquet with centroid_id and c")
    p.add_argument("--targets", help="Parquet with centroid_id")

    p = sub.add_parser("reshard", help="write the samples of a subset as new shards")
    p.add_argument("-i", "--input-dir", required=True)
    p.add_argument("-o", "--output-dir", required=True)
    p.add_argument("-s", "--subset-file", required=True)
    p.add_argument("--shard-size", type=int, default=ReshardOptions.shard_size)
    p.add_argument("--shard-format", dest="input_format", help="names of the input's tars, as {:08d}.tar; without it, all that end in a number")
    p.add_argument("--shard-stats-format", dest="input_stats_format", help="names of their stats, as {:08d}_stats.json")
    p.add_argument("--output-shard-format", dest="shard_format", default=ReshardOptions.shard_format)
    p.add_argument("--output-shard-stats-format", "--stats-format", dest="stats_format", default=ReshardOptions.stats_format, help="from a shard's number, as {:08d}_stats.json, or by {} from its name without .tar")
    p.add_argument("--first-shard", type=int, default=0)
    p.add_argument("-n", "--num-shards", type=int)
    p.add_argument("--shuffle-seed", type=int, help="a random order of all samples")
    p.add_argument("--shuffle-buffer", "--shuffle-bufsize", type=int, default=ReshardOptions.shuffle_buffer, help="rows that a partition's order is shuffled within; 0 leaves the order")
    p.add_argument("-j", "--num-workers", type=int, help="tasks that read contiguous ranges of tars; without it, one for each tar")
    p.add_argument("--max-bytes", type=int, default=ReshardOptions.max_bytes)
    p.add_argument("--shard-table", help="JSON of shard sizes")
    p.add_argument("--write-shard-table", action="store_true")
    p.add_argument("--blur-map", "--blur-metadata-map", help="JSON of box tables and their shards")
    p.add_argument("--apply-blur", action="store_true", help="by the codec of --codec")
    p.add_argument("--inject-blur", "--inject-blur-metadata", action="store_true")
    p.add_argument("--webp-quality", "--reencode-webp-quality", type=int, default=ReshardOptions.webp_quality)
    p.add_argument("--codec", help="module:function that blurs an image")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--overwrite", action="store_true")

    p = sub.add_parser("scores", help="roll result lines up to groups of datasets")
    p.add_argument("--results", required=True)
    p.add_argument("--tasks", help="YAML of tasks; names the main metrics")
    p.add_argument("--expected", type=int, default=rollup.SCORED_TASKS)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "select":
        tables = {k: spark.read.parquet(v) for k in ("lexicon", "centroids", "targets") if (v := getattr(args, k))}
        params = FilterParams(threshold=args.threshold, fraction=args.fraction, arch=args.arch, scale=args.scale, **tables)
        print(write_npy(select_uids(args.name, read_pool(spark, args.metadata_dir), params), args.save_path), "ids written")
    elif args.command == "reshard":
        names = [f.name for f in dataclasses.fields(ReshardOptions) if f.name != "blur_map"]
        options = ReshardOptions(**{n: getattr(args, n) for n in names}, blur_map=args.blur_map is not None)
        codec = None
        if args.codec:
            module, _, function = args.codec.partition(":")
            codec = getattr(importlib.import_module(module), function)
        spark.sparkContext.setLogLevel("INFO" if args.verbose else "ERROR" if args.quiet else "WARN")
        told = reshard_job.run(spark, args.input_dir, args.subset_file, args.output_dir, options, blur_map_path=args.blur_map, codec=codec)
        if not args.quiet:
            for k, v in told.items():
                print(f"{k}: {v}")
    else:
        results = rollup.last_wins(read_results(spark, args.results))
        if args.tasks:
            results = rollup.main_metric(results.drop("main_metric"), read_tasks(spark, args.tasks))
        for row in rollup.group_scores(results, rollup.published_groups(spark), args.expected).orderBy("grouping").collect():
            print(f"{row.grouping}: {row.score}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
