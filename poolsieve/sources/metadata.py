"""Pool metadata, embeddings, subsets and the small JSON files around shards."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsieve.functions.uid import padded_uid_bin, uid_hex
from poolsieve.schemas import RESULTS, TASKS
from poolsieve.session import written
from poolsieve.sources import files
from poolsieve.sources.formats import SPLIT_BYTES, register
from poolsieve.sources.names import name_glob, number_regex


def read_pool(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """All files of the folder with ".parquet" in their names; only the columns asked for are read."""
    df = spark.read.option("pathGlobFilter", "*.parquet*").parquet(folder)
    return df.select(*columns) if columns else df


def with_position(df: DataFrame) -> DataFrame:
    """``file_root, row_index`` of every row, to join with embeddings beside the file."""
    root = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.parquet.*$", "")
    return df.select("*", root.alias("file_root"), F.col("_metadata.row_index").alias("row_index"))


def read_embeddings(spark: SparkSession, folder: str, key: str = "l14_img", pattern: str = "*.npz", split: int = SPLIT_BYTES) -> DataFrame:
    """``file_root, row_index, vector`` of one matrix in each ``.npz`` file.

    A task reads about ``split`` bytes; files and rows that a filter leaves out are not read.
    """
    return register(spark).read.format("pool_npz").option("key", key).option("pattern", pattern).option("split", split).load(folder)


def gather_embeddings(pool: DataFrame, embeddings: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows of ``pool`` (``file_root, row_index`` and more) that ``keep`` holds for, with their vectors, in order of file and row."""
    rows = pool if keep is None else pool.where(keep)
    return attach_embeddings(rows, embeddings).orderBy("file_root", "row_index")


def attach_embeddings(pool: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Row by row, by position in the file."""
    return pool.join(embeddings, ["file_root", "row_index"])


#: Ids of a subset that one task reads.
SPLIT = 4 << 20


def read_subset(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """``uid_bin`` of every entry of a ``.npy`` or raw file of 16-byte ids (two little-endian halves).

    Tasks read ``split`` ids each.
    """
    return register(spark).read.format("pool_npy").schema("uid_bin binary").option("split", 16 * split).load(path)


def _shard_id(path):
    return F.regexp_extract(path, r"(\d+)(_stats\.json|\.tar)$", 1).cast("long")


def _numbered(path: Column, pattern: str | None) -> Column:
    """The number in a file's name; null if the name is none of ``pattern``'s."""
    if pattern is None:
        return _shard_id(path)
    number = F.regexp_extract(F.element_at(F.split(path, "/"), -1), number_regex(pattern), 1)
    return F.when(number != "", number.cast("long"))


def read_shard_stats(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``shard_id, successes`` of ``*_stats.json`` files, or of those with names of ``pattern``."""
    glob = "*_stats.json" if pattern is None else name_glob(pattern)
    files = spark.read.schema("successes long").option("multiLine", True).option("pathGlobFilter", glob).json(folder)
    found = files.select(_numbered(F.col("_metadata.file_path"), pattern).alias("shard_id"), "successes").where("successes IS NOT NULL")
    return found if pattern is None else found.where("shard_id IS NOT NULL")


def list_tars(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """``shard_id, name, bytes, path`` of the tar files, or of those with names of ``pattern``; contents are not read."""
    glob = "*.tar" if pattern is None else name_glob(pattern)
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "length")
    found = files.select(_numbered(F.col("path"), pattern).alias("shard_id"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "path")
    return found if pattern is None else found.where("shard_id IS NOT NULL")


def shard_count(tars: DataFrame) -> int:
    """How many shards there are from 0 on without a gap."""
    gap = tars.join(tars.select((F.col("shard_id") - 1).alias("shard_id")), "shard_id", "left_anti").agg(F.min("shard_id")).first()[0]
    if tars.where("shard_id = 0").isEmpty():
        raise ValueError("no shard 0")
    return gap + 1


def read_shard_table(spark: SparkSession, path: str) -> DataFrame:
    """``name, shard_id, size`` of a JSON object of sizes; empty if it cannot be parsed."""
    text = spark.read.option("wholetext", True).text(path)
    rows = text.select(F.explode(F.from_json("value", "map<string,long>")).alias("name", "size"))
    return rows.select("name", F.regexp_extract("name", r"(\d+)(\.tar)?$", 1).cast("long").alias("shard_id"), "size")


def read_blur_map(spark: SparkSession, path: str, input_dir: str | None = None) -> DataFrame:
    """``entry, parquet, shards`` of a JSON object of entries; with ``input_dir``, of those entries only that name it."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", "map<string,struct<parquet: string, shards: array<string>>>")).alias("entry", "v"))
    if input_dir is not None:
        named = input_dir.rstrip("/")
        folder = lambda s: F.regexp_replace(s, "/[^/]*$", "")
        entries = entries.where(F.exists("v.shards", lambda s: ~s.contains("/") | F.lit(named).endswith(folder(s)) | folder(s).endswith(named)))
    return entries.select("entry", "v.parquet", F.transform("v.shards", lambda s: F.regexp_extract(s, r"(\d+)(\.tar)?$", 1).cast("long")).alias("shards"))


def read_boxes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``parquet, uid, face_bboxes`` of box tables; ids that lost leading zeros get them back."""
    rows = spark.read.parquet(*paths)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return rows.select(name.alias("parquet"), uid_hex(padded_uid_bin(F.col("uid"))).alias("uid"), "face_bboxes")


#: Bytes of result lines that one task orders.
RESULT_BYTES = 32 << 20


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Result lines with their numbers, whatever metrics they name.

    Lines are numbered in the order of writing: by the time that their run wrote
    them, else that of their file, then by their place.  They are range-partitioned
    by that order and written once, with their places in the partitions, to which the
    counts of the partitions before, one number each, are added.
    """
    rows = spark.read.schema(f"{RESULTS}, written_at long, written_place long").json(path)
    file = F.unix_micros("_metadata.file_modification_time") * 1000
    rows = rows.select("*", F.coalesce("written_at", file).alias("__at"), F.col("_metadata.file_path").alias("__file"), F.coalesce("written_place", F.monotonically_increasing_id()).alias("__place"))
    order = [F.col("__at"), F.when(F.col("written_at").isNull(), F.col("__file")), F.col("__place")]
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0  # contents are not read
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RESULT_BYTES))
    # the partition in the upper bits, the place in it below
    placed = written(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("__line", F.monotonically_increasing_id()))
    part, place = F.shiftright("__line", 33), F.col("__line").bitwiseAND(F.lit((1 << 33) - 1))
    start, starts = 0, []
    for k, n in sorted(placed.groupBy(part.alias("k")).count().collect()):
        starts.append((k, start))
        start += n
    table = F.broadcast(spark.createDataFrame(starts, "__part long, __start long"))
    rows = placed.withColumn("__part", part).join(table, "__part").withColumn("line_no", F.col("__start") + place)
    rows = rows.drop("written_at", "written_place", "__at", "__file", "__place", "__part", "__start", "__line")
    return rows.withColumn("main_metric", F.element_at("metrics", F.lit("main_metric")))


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The task table of a YAML file: one row for each key."""
    import yaml

    content = "\n".join(r[0] for r in spark.read.text(path).coalesce(1).collect())
    names = [c.split(" ")[0] for c in TASKS.split(", ")]
    rows = [tuple({"key": k, **v}.get(n) for n in names) for k, v in yaml.safe_load(content).items()]
    return spark.createDataFrame(rows, TASKS)


def verify_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """``name, ok, present``: whether size and SHA-256 of each expected file are as told."""
    files = spark.read.format("binaryFile").load(folder)
    found = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("found_size"), F.sha2("content", 256).alias("found_sha256"))
    joined = expected.join(found, "name", "left")
    same = (F.col("found_sha256") == F.lower("sha256")) & F.coalesce(F.col("found_size") == F.col("size"), F.col("size").isNull())
    return joined.select("name", F.coalesce(same, F.lit(False)).alias("ok"), F.col("found_sha256").isNotNull().alias("present"))


def input_shard_spec(names: DataFrame) -> DataFrame:
    """``prefix, spec``: brace ranges of the shard names ``name`` (without ``.tar``).

    Ranges begin at 0 and keep the zeros of the names' numbers.
    """
    digits = F.regexp_extract("name", r"(\d+)$", 1)
    parts = names.select(F.regexp_replace("name", r"\d+$", "").alias("prefix"), digits.alias("digits")).where("digits <> ''")
    ranges = parts.groupBy("prefix").agg(F.max(F.col("digits").cast("long")).alias("last"), F.min(F.length("digits")).alias("width"))
    spec = F.concat("prefix", F.lit("{"), F.repeat(F.lit("0"), F.col("width")), F.lit(".."), F.lpad(F.col("last").cast("string"), F.greatest("width", F.length(F.col("last").cast("string"))), "0"), F.lit("}.tar"))
    return ranges.select("prefix", spec.alias("spec"))


def joined_spec(specs: DataFrame) -> str:
    """All ranges as one string, in order of prefix; there are few."""
    return "::".join(r[0] for r in specs.orderBy("prefix").select("spec").collect())


def manifest_spec(manifest: str) -> str:
    """The brace range that a reshard manifest (JSON text) tells."""
    meta = json.loads(manifest)
    first, last = (meta["output_shard_format"].format(n).removesuffix(".tar") for n in (0, meta["output_shard_count"] - 1))
    return f"{{{first}..{last}}}.tar"


def shard_spec(source: str) -> str:
    """The training spec of a source: of every part between ``::``.

    A ``.tar`` part is taken as it is; a folder with a manifest gives the range
    that it tells; of any other folder the tars are grouped by name.
    """
    specs = []
    for part in source.split("::"):
        if part.endswith(".tar"):
            specs.append(part)
        elif files.size(files.join(part, "meta.json")) is not None:
            with files.open_input(files.join(part, "meta.json")) as f:
                specs.append(files.join(part, manifest_spec(f.read().decode())))
        else:
            last: dict[str, tuple[int, int]] = {}
            for name in files.names(part, ".tar"):
                prefix, digits = re.fullmatch(r"(.*?)(\d*)\.tar", name).groups()
                if digits:
                    n, width = last.get(prefix, (-1, len(digits)))
                    last[prefix] = (max(n, int(digits)), min(width, len(digits)))
            if not last:
                raise ValueError(f"{part} has no shards")
            specs += [files.join(part, f"{p}{{{0:0{w}d}..{n:0{w}d}}}.tar") for p, (n, w) in sorted(last.items())]
    return "::".join(specs)
