"""Results of evaluation tasks, and what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The published groups of evaluation datasets.
DATASET_GROUPS = {
    "ImageNet dist. shifts": ["ImageNet Sketch", "ImageNet v2", "ImageNet-A", "ImageNet-O", "ImageNet-R", "ObjectNet"],
    "VTAB": [
        "Caltech-101", "CIFAR-100", "CLEVR Counts", "CLEVR Distance", "Describable Textures", "EuroSAT", "KITTI Vehicle Distance",
        "Oxford Flowers-102", "Oxford-IIIT Pet", "PatchCamelyon", "RESISC45", "SVHN", "SUN397",
    ],
    "Retrieval": ["Flickr", "MSCOCO", "WinoGAViL"],
}
#: Training constants of the published scales.
SCALES = [
    ("debug", 1024, 1e-4, 128_000, 500, "ViT-B-32", None),
    ("small", 4096, 5e-4, 12_800_000, 500, "ViT-B-32", None),
    ("medium", 4096, 5e-4, 128_000_000, 500, "ViT-B-32", None),
    ("large", 8192, 5e-4, 1_280_000_000, 500, "ViT-B-16", None),
    ("xlarge", 90112, 1e-3, 12_800_000_000, 10_000, "ViT-L-14", 0.95),
]
SCORED_TASKS = 38
FAMILIES = ("retrieval", "wilds", "fairness", "misc")


def scales(spark) -> DataFrame:
    return spark.createDataFrame(SCALES, "scale string, batch_size long, learning_rate double, train_num_samples long, warmup long, model string, beta2 double")


def scale_config(spark, scale: str) -> dict:
    names = [s[0] for s in SCALES]
    if scale not in names:
        raise ValueError(f"unknown scale {scale}; there are {names}")
    return scales(spark).where(F.col("scale") == scale).first().asDict()


def training_record(spark, scale: str, checkpoint: str, data_dir: str) -> dict:
    """What a training run tells of itself, for evaluation and submission; ``write_json`` writes it."""
    return {"scale": scale, "checkpoint": checkpoint, "scale_config": scale_config(spark, scale), "data_dir": data_dir}


def record_path(checkpoint: str) -> str:
    """The place of a run's record: two folders above its checkpoint."""
    parts = checkpoint.split("/")
    if len(parts) < 3:
        raise ValueError(f"{checkpoint} is in no run's folder")
    return "/".join([*parts[:-2], "info.json"])


def text_table(table: DataFrame, most: int = 1000) -> str:
    """A small report as aligned text, in order of its first column; longer ones are an error."""
    rows = table.orderBy(table.columns[0]).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has {most} rows at most")
    cells = [table.columns, *[["" if v is None else str(v) for v in r] for r in rows]]
    widths = [max(map(len, column)) for column in zip(*cells, strict=True)]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)


def derived(scale_rows: DataFrame, world_size: int, accumulation: int, checkpoints: int) -> DataFrame:
    """Batch of one worker, and samples between checkpoints."""
    per = F.floor(F.col("batch_size") / (world_size * accumulation)).cast("long")
    return scale_rows.select("scale", per.alias("per_worker_batch"), F.floor(F.col("train_num_samples") / checkpoints).cast("long").alias("samples_per_checkpoint"))


def last_wins(results: DataFrame, key: str = "dataset", order: str = "line_no") -> DataFrame:
    """The last line of each dataset, by a partial aggregation."""
    rest = [c for c in results.columns if c != key]
    return results.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*results.columns)


def main_metric(results: DataFrame, tasks: DataFrame) -> DataFrame:
    """Results of known tasks with ``main_metric``: the task's named metric, by default acc1."""
    named = tasks.select("key", F.coalesce("main_metric", F.lit("acc1")).alias("metric"))
    return results.join(named, "key").withColumn("main_metric", F.element_at("metrics", F.col("metric"))).drop("metric")


def pending(tasks: DataFrame, results: DataFrame) -> DataFrame:
    """Tasks without a result."""
    return tasks.join(results.select("key"), "key", "left_anti")


def family(key):
    prefix = F.split(key, "/")[0]
    return F.when(prefix.isin(*FAMILIES), prefix).otherwise("classification")


def group_scores(results: DataFrame, groups: DataFrame, expected: int | None = None) -> DataFrame:
    """``grouping, score``: the mean of each group of datasets, and of all.

    With ``expected``, another number of scored datasets is an error.
    """
    scored = results.where("main_metric IS NOT NULL")
    if expected is not None and (n := scored.count()) != expected:
        raise ValueError(f"{n} scored datasets, not {expected}")
    each = scored.join(groups, "dataset").groupBy("grouping").agg(F.avg("main_metric").alias("score"))
    return each.unionByName(scored.agg(F.avg("main_metric").alias("score")).select(F.lit("Average").alias("grouping"), "score"))


def published_groups(spark) -> DataFrame:
    rows = [(g, d) for g, ds in DATASET_GROUPS.items() for d in ds] + [("ImageNet", "ImageNet 1k")]
    return spark.createDataFrame(rows, "grouping string, dataset string")


def overall_mean(results: DataFrame) -> DataFrame:
    return results.agg(F.avg("main_metric").alias("average"), F.count("main_metric").alias("scored"))


def resumed(results: DataFrame, training: dict, cached: dict | None) -> DataFrame:
    """Results to go on from; those of another training run are an error."""
    if cached is not None and cached != training:
        names = sorted(k for k in cached.keys() | training.keys() if cached.get(k) != training.get(k))
        raise ValueError(f"the cached results are of another run: {', '.join(names)} differ")
    return results


#: What a submission must tell.
REQUIRED = ("method_name", "author", "email", "hf_username", "hf_repo_name")


def check_submission(fields: dict) -> None:
    """Raise ValueError where a required field is missing or empty."""
    missing = [k for k in REQUIRED if not str(fields.get(k) or "").strip()]
    if missing:
        raise ValueError(f"a submission needs {', '.join(missing)}")


def submission(results: DataFrame, scale: str, dataset_size: int | None, train_num_samples: int, name: str) -> DataFrame:
    """The record of a run, as one row; sending it is not this engine's business."""
    if not name:
        raise ValueError("a submission needs a name")
    maps = results.agg(F.map_from_entries(F.collect_list(F.struct("key", "main_metric"))).alias("scores"), F.avg("main_metric").alias("average"))
    return maps.select(F.lit(name).alias("name"), F.lit(scale).alias("scale"), F.lit(dataset_size or train_num_samples).alias("dataset_size"), "scores", "average")


def by_dataset(results: DataFrame) -> DataFrame:
    """One row for each dataset and metric."""
    return results.select("key", "dataset", F.explode("metrics").alias("metric", "value"))


def running(results: DataFrame) -> DataFrame:
    """The running mean of scores, in order of lines."""
    order = Window.partitionBy("key").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("mean_so_far", F.avg("main_metric").over(order))
