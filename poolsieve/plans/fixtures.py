"""Views that give the test tables the shape of the engine's inputs, for Spark and as SQL."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolsieve.functions.vector import dot
from poolsieve.operators.centroids import nearest_centroid, target_centroids
from poolsieve.operators.metrics import nearest_candidates
from poolsieve.session import scratch as scratch
from poolsieve.sources import files


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_POOL = [
    "doc_id", "md5(cast(doc_id AS string)) AS uid", "text", "lang", "source",
    "100 + (doc_id * 37) % 901 AS original_width", "100 + (doc_id * 91) % 701 AS original_height",
    "((doc_id * 7919) % 101) / cast(101.0 AS double) AS clip_b32_similarity_score",
    "((doc_id * 104729) % 10007) / cast(10007.0 AS double) AS clip_l14_similarity_score",
]


def write_matrices(vectors: DataFrame, folder: str, parts: int = 4) -> None:
    """Each part's rows as a table, and its vectors as the matrix ``v`` of an ``.npz`` file beside it."""

    def run(batches):
        import io

        import pyarrow as pa
        import pyarrow.parquet as pq

        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            name, out = uuid.uuid4().hex, io.BytesIO()
            flat = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            np.savez(out, v=flat.reshape(len(rows), -1))
            with files.open_output(files.join(folder, f"{name}.npz")) as f:
                f.write(out.getvalue())
            with files.open_output(files.join(folder, f"{name}.parquet")) as f:
                pq.write_table(rows, f)
        yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64())], ["n"])

    vectors.repartition(parts, "vec_id").mapInArrow(run, "n long").collect()


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*_POOL)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each label the vector of the lowest id."""
    return vectors(spark, sf_dir).groupBy(F.col("label").cast("long").alias("centroid_id")).agg(F.min_by("embedding", "vec_id").cast("array<double>").alias("c"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_centroid(vectors(spark, sf_dir), centroids(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_centroids(nearest_centroid(vectors(spark, sf_dir).where("vec_id IN (10, 20, 30)"), centroids(spark, sf_dir)))


def pool_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pool(spark, sf_dir).join(vectors(spark, sf_dir).select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


def lexicon(spark: SparkSession, sf_dir: str, least: int = 9) -> DataFrame:
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word"))
    return words.where(F.col("word").rlike("^[a-z]+$") & (F.length("word") >= least)).distinct()


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pool(spark, sf_dir).select("doc_id", "uid", F.floor(F.col("doc_id") / 37).alias("shard_id"))
    return rows.where("shard_id % 7 <> 3")


def subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "documents").select("doc_id")
    times = F.expr("CASE WHEN doc_id % 15 = 0 THEN 3 WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END")
    there = ids.withColumn("n", times).where("n > 0").select(F.md5(F.col("doc_id").cast("string")).alias("uid"), F.explode(F.expr("sequence(1, n)"))).select("uid")
    return there.unionByName(ids.where("doc_id < 5").select(F.md5(F.concat(F.lit("missing-"), F.col("doc_id").cast("string"))).alias("uid")))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).groupBy("shard_id").agg(F.count("*").alias("size"))


def blur_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shards(spark, sf_dir).where("shard_id % 4 <> 3").withColumn("parquet", F.format_string("boxes-%d", F.floor(F.col("shard_id") / 4)))
    return found.groupBy("parquet").agg(F.sort_array(F.collect_list("shard_id")).alias("shards"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).where("doc_id % 5 = 0 AND shard_id % 4 <> 3")
    box = F.array(F.array(F.col("doc_id").cast("double"), F.lit(0.0)))
    return rows.select(F.format_string("boxes-%d", F.floor(F.col("shard_id") / 4)).alias("parquet"), "uid", box.alias("face_bboxes"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's inner product with each of the ten or so centroids."""
    c = centroids(spark, sf_dir).groupBy().agg(F.sort_array(F.collect_list(F.struct("centroid_id", "c"))).alias("cs"))
    return vectors(spark, sf_dir).crossJoin(F.broadcast(c)).withColumn("logits", F.transform("cs", lambda s: dot(F.col("embedding"), s["c"]))).drop("cs")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from poolsieve.operators.metrics import predictions as predict

    groups = ["vec_id % 5 AS region", "2002 + vec_id % 4 AS year", "vec_id % 2 AS gender", "vec_id % 7 AS race", "int(vec_id % 7 <> 1) AS race_binary", "vec_id % 9 AS age"]
    more = ["(vec_id * 3) % 7 AS pred_race", "(vec_id * 5) % 2 AS pred_gender", "(vec_id * 2) % 9 AS pred_age", "(vec_id * 11) % 22 AS pred_toxic"]
    return predict(scores(spark, sf_dir)).selectExpr("vec_id", "label AS target", "pred", "top", *groups, *more)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).selectExpr("cast(floor(vec_id / 10) AS long) AS instance", "vec_id AS candidate", "label % 2 = 0 AS truth", "(vec_id * 7919) % 101 AS score")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return joined.groupBy(F.col("source").alias("dataset")).agg(F.avg("quality").alias("main_metric"))


def pairs(spark: SparkSession, sf_dir: str, query: str, candidate: str, k: int = 10) -> DataFrame:
    """Images (even ids) with captions (odd ids), the ``k`` best of all candidates for every query; the caption after an image is its own."""
    rows = vectors(spark, sf_dir)
    sides = {name: rows.where(f"vec_id % 2 = {odd}").select(F.col("vec_id").alias(name), F.col("embedding").alias("v")) for odd, name in enumerate(("image", "caption"))}
    found = nearest_candidates(sides[query], sides[candidate], query, candidate, k)
    return found.withColumn("relevant", F.col("caption") == F.col("image") + 1)


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several result lines for each event type."""
    return table(spark, sf_dir, "events").selectExpr("concat('task/', event_type) AS key", "concat(event_type, '-', user_id % 7) AS dataset", "event_id AS line_no", "map('acc1', value, 'other', value * 2) AS metrics")


WORDS_SQL = r"len(regexp_extract_all(text, '[^\s\x{1c}-\x{1f}\x{85}\p{Z}]+'))"
SQL = {
    "pool": """SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS uid, text, lang, source, 100 + (doc_id * 37) % 901 AS original_width, 100 + (doc_id * 91) % 701 AS original_height,
      ((doc_id * 7919) % 101) / CAST(101.0 AS DOUBLE) AS clip_b32_similarity_score, ((doc_id * 104729) % 10007) / CAST(10007.0 AS DOUBLE) AS clip_l14_similarity_score FROM documents""",
    "centroids": "SELECT label AS centroid_id, arg_min(CAST(embedding AS DOUBLE[]), vec_id) AS c FROM embeddings GROUP BY label",
    "scored": "SELECT vec_id, label, centroid_id, list_dot_product(CAST(embedding AS DOUBLE[]), c) AS s FROM embeddings, centroids",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, centroid_id) AS r FROM scored",
    "assigned": "SELECT vec_id, CAST(centroid_id AS BIGINT) AS centroid_id FROM ranked WHERE r = 1",
    "targets": "SELECT DISTINCT centroid_id FROM assigned WHERE vec_id IN (10, 20, 30)",
    "samples": "SELECT doc_id, md5(CAST(doc_id AS VARCHAR)) AS uid, doc_id // 37 AS shard_id FROM documents WHERE (doc_id // 37) % 7 <> 3",
    "subset": """SELECT md5(CAST(doc_id AS VARCHAR)) AS uid FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT md5(CAST(doc_id AS VARCHAR)) FROM documents, range(2) WHERE doc_id % 15 = 0
      UNION ALL SELECT md5('missing-' || CAST(doc_id AS VARCHAR)) FROM documents WHERE doc_id < 5""",
    "shards": "SELECT shard_id, count(*) AS size FROM samples GROUP BY shard_id",
    "preds": """SELECT vec_id, target, pred, top, vec_id % 5 AS region, 2002 + vec_id % 4 AS year, vec_id % 2 AS gender, vec_id % 7 AS race, CAST(vec_id % 7 <> 1 AS INT) AS race_binary, vec_id % 9 AS age,
      (vec_id * 3) % 7 AS pred_race, (vec_id * 5) % 2 AS pred_gender, (vec_id * 2) % 9 AS pred_age, (vec_id * 11) % 22 AS pred_toxic
      FROM (SELECT vec_id, any_value(label) AS target, min(centroid_id) FILTER (r = 1) AS pred, list(centroid_id) FILTER (r <= 5) AS top FROM ranked GROUP BY vec_id)""",
    "results": "SELECT source AS dataset, avg(quality) AS main_metric FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "pairs": """SELECT a.vec_id AS image, b.vec_id AS caption, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score, b.vec_id = a.vec_id + 1 AS relevant
      FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1""",
    "lines": "SELECT 'task/' || event_type AS key, event_type || '-' || CAST(user_id % 7 AS VARCHAR) AS dataset, event_id AS line_no, value AS acc1, value * 2 AS other FROM events",
    "boxes": "SELECT 'boxes-' || CAST(shard_id // 4 AS VARCHAR) AS parquet, uid, doc_id FROM samples WHERE doc_id % 5 = 0 AND shard_id % 4 <> 3",
}
NEEDS = {"scored": ["centroids"], "ranked": ["scored"], "assigned": ["ranked"], "targets": ["assigned"], "shards": ["samples"], "preds": ["ranked"], "boxes": ["samples"]}


def with_views(body: str, *names: str) -> str:
    """A query with the views it needs in front."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n" + body
