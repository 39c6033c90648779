"""Registered queries over the test tables, and their SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from poolsieve.functions.text import article_prompt, ceil_div, char_count, duration, json_with, one_line, or_default, percent, shard_name, token_count, word_count
from poolsieve.functions.uid import high, low, uid_bin, uid_hex
from poolsieve.functions.vector import argmax, is_in, mask_from
from poolsieve.operators import centroids as cen
from poolsieve.operators import draws, metrics, reshard, rollup
from poolsieve.operators.filters import FilterParams, caption_condition, select_uids
from poolsieve.operators.kmeans import assigned_counts, kmeans
from poolsieve.operators.synsets import RULES, first_synsets, parse_index, vocabulary
from poolsieve.operators.threshold import top_fraction_threshold
from poolsieve.plans import fixtures as fx
from poolsieve.plans.fixtures import WORDS_SQL, with_views
from poolsieve.sinks.subset import append_results, write_npy, write_tars
from poolsieve.sources.boxes import lookup_boxes, write_boxes
from poolsieve.sources.metadata import gather_embeddings, input_shard_spec, read_embeddings, read_pool, read_results, read_shard_stats, read_subset, with_position
from poolsieve.session import written
from poolsieve.sources.tar import read_index, read_samples

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *views: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_views(sql, *views) if views else sql
        return f

    return add


ENGLISH = "lang = 'en'"
BASIC = f"{ENGLISH} AND {WORDS_SQL} > 2 AND length(text) > 5 AND least(original_width, original_height) >= 200 AND greatest(original_width, original_height) / CAST(least(original_width, original_height) AS DOUBLE) <= 3.0"
CAPTION = rf"{ENGLISH} AND len(regexp_extract_all(text, '[^ \n\r\t\x{{0b}}\x{{0c}}\x{{00}}]+|\n')) > 1 AND length(text) > 5"


def top(column: str, fraction: float, of: str = "pool") -> str:
    return f"(SELECT percentile_disc((CAST(floor(n * {fraction}) AS BIGINT) + 0.5) / n) WITHIN GROUP (ORDER BY {column} DESC) FROM {of}, (SELECT count(*) AS n FROM {of}) GROUP BY n)"


@query("SELECT uid FROM pool", "pool")
def no_filter(spark, d):
    return select_uids("no_filter", fx.pool(spark, d))


@query(f"SELECT uid FROM pool WHERE {BASIC}", "pool")
def basic_filter(spark, d):
    return select_uids("basic_filter", fx.pool(spark, d))


@query("SELECT uid FROM pool WHERE clip_b32_similarity_score >= 0.28", "pool")
def clip_b32_threshold(spark, d):
    return select_uids("clip_score", fx.pool(spark, d), FilterParams(threshold=0.28, arch="b32"))


def _nth(column: str, fraction: float) -> str:
    return f"(SELECT {column} FROM pool ORDER BY {column} DESC LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * {fraction}) AS BIGINT) FROM pool))"


@query(f"SELECT uid FROM pool WHERE clip_l14_similarity_score >= {_nth('clip_l14_similarity_score', 0.3)}", "pool")
def clip_l14_fraction(spark, d):
    return select_uids("clip_score", fx.pool(spark, d), FilterParams(fraction=0.3, arch="l14"))


@query(f"SELECT uid FROM pool WHERE clip_b32_similarity_score >= {_nth('clip_b32_similarity_score', 0.3)}", "pool")
def clip_b32_fraction_ties(spark, d):
    return select_uids("clip_score", fx.pool(spark, d), FilterParams(fraction=0.3, arch="b32"))


@query(f"SELECT {_nth('clip_l14_similarity_score', 0.3)} AS l14, {_nth('clip_b32_similarity_score', 0.3)} AS b32", "pool")
def fraction_thresholds(spark, d):
    pool = fx.pool(spark, d)
    return spark.range(1).select(F.lit(top_fraction_threshold(pool, "clip_l14_similarity_score", 0.3)).alias("l14"), F.lit(top_fraction_threshold(pool, "clip_b32_similarity_score", 0.3)).alias("b32"))


@query(f"SELECT uid FROM pool WHERE {ENGLISH} AND clip_b32_similarity_score >= 0.28", "pool")
def laion2b(spark, d):
    return select_uids("laion2b", fx.pool(spark, d))


_LEXICON = r"SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]+') AND length(w) >= 6"


@query(rf"SELECT uid FROM pool SEMI JOIN (SELECT DISTINCT uid FROM (SELECT uid, unnest(regexp_extract_all(lower(text), '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) AS word FROM pool WHERE {ENGLISH}) SEMI JOIN ({_LEXICON}) USING (word)) USING (uid)", "pool")
def text_based(spark, d):
    return select_uids("text_based", fx.pool(spark, d), FilterParams(lexicon=fx.lexicon(spark, d, 6)))


@query(f"SELECT uid FROM pool WHERE {CAPTION}", "pool")
def caption_filter(spark, d):
    return fx.pool(spark, d).where(caption_condition(FilterParams())).select("uid")


@query("SELECT vec_id, centroid_id FROM assigned", "assigned")
def nearest_centroid(spark, d):
    return fx.assigned(spark, d).select("vec_id", "centroid_id")


@query("SELECT CAST(centroid_id AS BIGINT) AS centroid_id FROM targets", "targets")
def target_centroids(spark, d):
    return fx.targets(spark, d)


@query("SELECT centroid_id, n, vec_id FROM assigned JOIN (SELECT centroid_id, count(*) AS n FROM assigned GROUP BY centroid_id) USING (centroid_id)", "assigned")
def centroid_groups(spark, d):
    return cen.centroid_groups(fx.assigned(spark, d), "vec_id")


def _image_params(spark, d, **more):
    return FilterParams(scale="small", centroids=fx.centroids(spark, d), targets=fx.targets(spark, d), **more)


@query(f"SELECT uid FROM pool JOIN assigned ON doc_id = vec_id SEMI JOIN targets USING (centroid_id) WHERE {CAPTION}", "pool", "targets")
def image_based(spark, d):
    return select_uids("image_based", fx.pool_vectors(spark, d), _image_params(spark, d))


@query(
    f"SELECT uid FROM pool JOIN assigned ON doc_id = vec_id SEMI JOIN targets USING (centroid_id) WHERE {CAPTION} AND clip_l14_similarity_score >= {_nth('clip_l14_similarity_score', 0.3)}",
    "pool", "targets",
)
def image_based_intersect(spark, d):
    # the fraction is of the whole pool, also where rows have no vector
    return select_uids("image_based_intersect_clip_score", fx.pool_vectors(spark, d), _image_params(spark, d, fraction=0.3, arch="l14", pool=fx.pool(spark, d)))


@query(f"SELECT uid FROM (SELECT uid FROM pool WHERE {BASIC}) INTERSECT SELECT uid FROM pool WHERE clip_b32_similarity_score >= 0.28", "pool")
def subset_intersection(spark, d):
    from poolsieve.operators.filters import intersect

    return intersect(basic_filter(spark, d), clip_b32_threshold(spark, d))


_HALF = "CAST(('0x' || substr(uid, {0}, 16)) AS UBIGINT)"


@query(f"SELECT uid, CAST(CAST({_HALF.format(1)} AS HUGEINT) AS VARCHAR) AS hi, CAST(CAST({_HALF.format(17)} AS HUGEINT) AS VARCHAR) AS lo, row_number() OVER (ORDER BY uid) AS place FROM pool", "pool")
def subset_sorted_halves(spark, d):
    ids = fx.pool(spark, d).select(uid_bin(F.col("uid")).alias("b")).select("b", uid_hex(F.col("b")).alias("uid"))
    placed = reshard.with_output_shard(ids, ["b"], 1)
    return placed.select("uid", high(F.col("uid")).cast("string").alias("hi"), low(F.col("uid")).cast("string").alias("lo"), (F.col("out_shard") + 1).alias("place"))


_TIMES = "SELECT uid, count(*) AS times FROM subset GROUP BY uid"


@query(f"SELECT uid, shard_id, copy, uid || '-' || CAST(copy AS VARCHAR) AS out_key FROM (SELECT uid, shard_id, CAST(unnest(range(times)) AS INT) AS copy FROM samples JOIN ({_TIMES}) USING (uid))", "samples", "subset")
def subset_multiset_join(spark, d):
    return reshard.multiset_join(fx.samples(spark, d).drop("doc_id"), fx.subset(spark, d))


@query(f"SELECT uid, shard_id, copy, uid || '-' || CAST(copy AS VARCHAR) AS out_key FROM (SELECT uid, shard_id, CAST(unnest(range(times)) AS INT) AS copy FROM samples JOIN ({_TIMES}) USING (uid))", "samples", "subset")
def subset_filtered_join(spark, d):
    subset = fx.subset(spark, d)
    return reshard.multiset_join(fx.samples(spark, d).drop("doc_id"), subset, ids=subset.count())


@query("SELECT count(*) AS missing FROM subset ANTI JOIN samples USING (uid)", "samples", "subset")
def subset_missing_count(spark, d):
    return reshard.missing_rows(fx.samples(spark, d), fx.subset(spark, d)).agg(F.count("*").alias("missing"))


@query(
    f"""SELECT (SELECT count(*) FROM samples) AS samples, (SELECT count(*) FROM subset) AS subset_rows, (SELECT sum(times)::BIGINT FROM samples JOIN ({_TIMES}) USING (uid)) AS output_rows,
    (SELECT count(*) FROM subset ANTI JOIN samples USING (uid)) AS missing_rows, true AS consistent""",
    "samples", "subset",
)
def reconciliation(spark, d):
    s, u = fx.samples(spark, d), fx.subset(spark, d)
    return reshard.reconcile(s, u, reshard.multiset_join(s, u))


@query("SELECT shard_id, size, CAST(coalesce(sum(size) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_start FROM shards", "shards")
def shard_offsets(spark, d):
    return reshard.shard_offsets(fx.shards(spark, d))


@query(
    """SELECT worker_id, min(shard_id) AS first_shard, count(*) AS shards, CAST(sum(size) AS BIGINT) AS rows FROM (
      SELECT shard_id, size, max(k) AS worker_id
      FROM (SELECT shard_id, size, coalesce(sum(size) OVER (ORDER BY shard_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS data_start FROM shards) s
      JOIN (SELECT k, cut FROM (SELECT total, CAST(ceil(total / least(4, n)) AS BIGINT) AS each FROM (SELECT sum(size) AS total, count(*) AS n FROM shards)),
        LATERAL (SELECT unnest(range(0, total::BIGINT, each)) AS cut, unnest(range(0, 4)) AS k) WHERE cut IS NOT NULL) cuts ON cut <= data_start
      GROUP BY shard_id, size) GROUP BY worker_id""",
    "shards",
)
def worker_plan(spark, d):
    return reshard.worker_plan(fx.shards(spark, d), 4)


_OUT = f"SELECT uid, (row_number() OVER (ORDER BY uid, copy) - 1) // 50 AS out_shard FROM (SELECT uid, unnest(range(times)) AS copy FROM samples JOIN ({_TIMES}) USING (uid))"


@query(f"SELECT CAST(out_shard AS BIGINT) AS out_shard, count(*) AS successes, lpad(CAST(out_shard AS VARCHAR), 8, '0') || '.tar' AS name FROM ({_OUT}) GROUP BY out_shard", "samples", "subset")
def output_shard_counts(spark, d):
    rows = reshard.multiset_join(fx.samples(spark, d), fx.subset(spark, d))
    return reshard.shard_counts(reshard.with_output_shard(rows, ["uid", "copy"], 50)).withColumn("name", shard_name(F.col("out_shard")))


@query("SELECT shard_id, size, CASE WHEN shard_id % 4 <> 3 THEN 'boxes-' || CAST(shard_id // 4 AS VARCHAR) END AS parquet FROM shards", "shards")
def blur_map_invert(spark, d):
    return reshard.attach_parquet(fx.shards(spark, d), fx.blur_map(spark, d)).select("shard_id", "size", "parquet")


@query("SELECT s.uid, b.uid IS NOT NULL AS blurred, CAST(b.doc_id AS DOUBLE) AS left FROM samples s LEFT JOIN boxes b USING (uid)", "samples", "boxes")
def box_lookup(spark, d):
    s = fx.samples(spark, d).join(reshard.invert_blur_map(fx.blur_map(spark, d)), "shard_id", "left")
    return reshard.attach_boxes(s, fx.boxes(spark, d)).select("uid", "blurred", F.try_element_at(F.try_element_at("face_bboxes", F.lit(1)), F.lit(1)).alias("left"))


@query("SELECT s.uid, CAST(b.doc_id AS DOUBLE) AS left FROM samples s JOIN boxes b USING (uid)", "samples", "boxes")
def box_point_lookup(spark, d):
    """The boxes of all samples, from tables sorted by id of which only row groups with such an id are read."""
    tables = write_boxes(fx.boxes(spark, d), fx.scratch(spark, "boxes"), 64)
    wanted = fx.samples(spark, d).join(reshard.invert_blur_map(fx.blur_map(spark, d)), "shard_id").join(tables, "parquet")
    return lookup_boxes(wanted).select("uid", F.col("face_bboxes")[0][0].alias("left"))


@query("SELECT avg(CAST(pred = target AS DOUBLE)) AS acc1, avg(CAST(list_contains(top, target) AS DOUBLE)) AS acc5 FROM preds", "preds")
def acc_topk(spark, d):
    return metrics.accuracy(fx.predictions(spark, d))


@query("SELECT avg(r) AS mean_per_class_recall FROM (SELECT target, avg(CAST(pred = target AS DOUBLE)) AS r FROM preds GROUP BY target)", "preds")
def mean_per_class_recall(spark, d):
    return metrics.mean_per_class_recall(fx.predictions(spark, d))


@query(
    """SELECT sum(tp) / CAST(sum(t) AS DOUBLE) AS acc, avg(CASE WHEN t > 0 THEN tp / CAST(t AS DOUBLE) ELSE 0 END) AS recall_macro, avg(2.0 * tp / CAST(t + p AS DOUBLE)) AS f1_macro FROM (
    SELECT c, coalesce(sum(CAST(target = c AS INT)), 0) AS t, coalesce(sum(CAST(pred = c AS INT)), 0) AS p, coalesce(sum(CAST(target = c AND pred = c AS INT)), 0) AS tp
    FROM preds, (SELECT DISTINCT target AS c FROM preds UNION SELECT DISTINCT pred FROM preds) GROUP BY c)""",
    "preds",
)
def macro_f1_recall(spark, d):
    return metrics.macro_scores(fx.predictions(spark, d))


def _recall(query: str, candidate: str) -> str:
    ranked = f"SELECT {query}, relevant, row_number() OVER (PARTITION BY {query} ORDER BY score DESC, {candidate}) AS r FROM pairs"
    return f"SELECT avg(CAST(h1 AS DOUBLE)) AS recall_1, avg(CAST(h5 AS DOUBLE)) AS recall_5, avg(CAST(h10 AS DOUBLE)) AS recall_10, '{query}' AS query FROM (SELECT max(relevant AND r <= 1) AS h1, max(relevant AND r <= 5) AS h5, max(relevant AND r <= 10) AS h10 FROM ({ranked}) GROUP BY {query})"


@query(f"{_recall('image', 'caption')} UNION ALL {_recall('caption', 'image')}", "pairs")
def retrieval_recall(spark, d):
    both = [metrics.retrieval_recall(fx.pairs(spark, d, q, c), q, c).withColumn("query", F.lit(q)) for q, c in (("image", "caption"), ("caption", "image"))]
    return both[0].unionByName(both[1])


_JACCARD = """SELECT instance, count(*) AS n, coalesce(sum(CAST(truth AND chosen AS INT)) / CAST(nullif(sum(CAST(truth OR chosen AS INT)), 0) AS DOUBLE), 0) AS score FROM (
  SELECT *, r <= need OR need = 0 AS chosen FROM (SELECT vec_id // 10 AS instance, label % 2 = 0 AS truth, sum(CAST(label % 2 = 0 AS INT)) OVER (PARTITION BY vec_id // 10) AS need,
  row_number() OVER (PARTITION BY vec_id // 10 ORDER BY (vec_id * 7919) % 101 DESC, vec_id) AS r FROM embeddings)) GROUP BY instance"""


@query(
    f"""SELECT avg(score) AS avg_jaccard_score, avg(score) FILTER (n = 5) AS jaccard_score_5, avg(score) FILTER (n = 6) AS jaccard_score_6, avg(score) FILTER (n = 10) AS jaccard_score_10,
    avg(score) FILTER (n = 12) AS jaccard_score_12, avg(score) FILTER (n <= 6) AS jaccard_score_5_6, avg(score) FILTER (n >= 10) AS jaccard_score_10_12 FROM ({_JACCARD})"""
)
def jaccard_by_bucket(spark, d):
    return metrics.jaccard_buckets(metrics.association_jaccard(fx.candidates(spark, d)))


@query("SELECT region, count(*) AS n, avg(CAST(list_contains(top, target) AS DOUBLE)) AS acc FROM preds GROUP BY region", "preds")
def top5_by_group(spark, d):
    return metrics.group_accuracy(fx.predictions(spark, d), ["region"], F.array_contains("top", F.col("target").cast("long")))


@query("SELECT g AS region, coalesce(n, 0) AS n, acc FROM range(7) t(g) LEFT JOIN (SELECT region, count(*) AS n, avg(CAST(pred = target AS DOUBLE)) AS acc FROM preds GROUP BY region) ON g = region", "preds")
def group_accuracy(spark, d):
    return metrics.group_accuracy(fx.predictions(spark, d), ["region"], F.col("pred") == F.col("target"), spark.range(7).toDF("region"))


@query("SELECT min(a) AS worst_acc FROM (SELECT avg(CAST(pred = target AS DOUBLE)) AS a FROM preds GROUP BY region)", "preds")
def worst_group(spark, d):
    return metrics.worst_group(metrics.group_accuracy(fx.predictions(spark, d), ["region"], F.col("pred") == F.col("target")))


@query(
    """SELECT (SELECT avg(CAST(pred = target AS DOUBLE)) FROM preds) AS acc_avg, (SELECT min(a) FROM (SELECT avg(CAST(pred = target AS DOUBLE)) AS a FROM preds GROUP BY year)) AS acc_worst_year,
    (SELECT min(a) FROM (SELECT avg(CAST(pred = target AS DOUBLE)) AS a FROM preds WHERE region <> 4 GROUP BY region)) AS acc_worst_region""",
    "preds",
)
def worst_year_region(spark, d):
    return metrics.year_region(fx.predictions(spark, d), F.col("pred") == F.col("target"), [4])


def _multi() -> str:
    parts = [
        ("acc_race", "'race_binary:' || race_binary", "CAST(pred_race <> 1 AS INT) = race_binary"),
        ("acc_gender", "'race_binary:' || race_binary", "pred_gender = gender"),
        ("acc_age", "'race_binary:' || race_binary", "pred_age = age"),
        ("acc_gender_x", "'race:' || race || '_gender:' || gender", "pred_gender = gender"),
        ("toxicity_crime", "'race:' || race", "pred_toxic >= 18"),
        ("toxicity_nonhuman", "'race:' || race", "pred_toxic >= 14 AND pred_toxic < 18"),
    ]
    return " UNION ALL ".join(f"SELECT '{m}' AS metric, {g} AS name, count(*) AS n, avg(CAST({h} AS DOUBLE)) AS acc FROM preds GROUP BY 1, 2 UNION ALL SELECT '{m}', 'avg', count(*), avg(CAST({h} AS DOUBLE)) FROM preds" for m, g, h in parts)


@query(_multi(), "preds")
def multilabel_groups(spark, d):
    return metrics.multilabel_groups(fx.predictions(spark, d))


@query("SELECT lang, count(*) AS n, avg(CAST(toxic AS DOUBLE)) AS acc FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def toxicity_by_group(spark, d):
    rows = fx.table(spark, d, "labels").join(fx.table(spark, d, "documents").select("doc_id", "lang"), "doc_id")
    return metrics.group_accuracy(rows, ["lang"], F.col("toxic"))


@query(
    "SELECT CAST(gender AS INT) AS gender, "
    + ", ".join(f"round(100 * avg(CAST(pred_gender = gender AS DOUBLE)) FILTER (race = {k}), 1) AS race_{k}" for k in range(7))
    + " FROM preds GROUP BY gender",
    "preds",
)
def fairness_pivot(spark, d):
    per = metrics.group_accuracy(fx.predictions(spark, d), ["gender", "race"], F.col("pred_gender") == F.col("gender"))
    out = metrics.report(per, "gender", "race", "acc")
    return out.select(F.col("gender").cast("int").alias("gender"), *[F.col(c).alias(f"race_{c}") for c in out.columns[1:]])


@query("SELECT 'group-' || substr(dataset, 4, 1) AS grouping, avg(main_metric) AS score FROM results GROUP BY 1 UNION ALL SELECT 'Average', avg(main_metric) FROM results", "results")
def score_rollup(spark, d):
    results = fx.results(spark, d)
    groups = results.select(F.concat(F.lit("group-"), F.substring("dataset", 4, 1)).alias("grouping"), "dataset")
    return rollup.group_scores(results, groups)


@query("SELECT avg(main_metric) AS average, count(main_metric) AS scored FROM results", "results")
def overall_mean(spark, d):
    return rollup.overall_mean(fx.results(spark, d))


@query("SELECT dataset, arg_max(key, line_no) AS key, max(line_no) AS line_no, arg_max(acc1, line_no) AS acc1 FROM lines GROUP BY dataset", "lines")
def results_last_wins(spark, d):
    return rollup.last_wins(fx.log_lines(spark, d)).select("dataset", "key", "line_no", F.element_at("metrics", F.lit("acc1")).alias("acc1"))


@query("SELECT key, dataset, line_no, CASE key WHEN 'task/click' THEN other ELSE acc1 END AS main_metric FROM lines WHERE key IN ('task/click', 'task/view')", "lines")
def task_dim_join(spark, d):
    tasks = spark.createDataFrame([("task/click", "other"), ("task/view", None), ("task/none", None)], "key string, main_metric string")
    return rollup.main_metric(fx.log_lines(spark, d), tasks).select("key", "dataset", "line_no", "main_metric")


@query("SELECT key FROM (VALUES ('task/click'), ('task/none')) t(key) ANTI JOIN lines USING (key)", "lines")
def pending_tasks(spark, d):
    return rollup.pending(spark.createDataFrame([("task/click",), ("task/none",)], "key string"), fx.log_lines(spark, d))


@query("SELECT dataset, 'acc1' AS metric, count(*) AS n, avg(acc1) AS mean FROM lines GROUP BY dataset UNION ALL SELECT dataset, 'other', count(*), avg(other) FROM lines GROUP BY dataset", "lines")
def metrics_exploded(spark, d):
    return rollup.by_dataset(fx.log_lines(spark, d)).groupBy("dataset", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


@query("SELECT source AS prefix, source || '{000..' || lpad(CAST(max(doc_id % 900) AS VARCHAR), 3, '0') || '}.tar' AS spec FROM (SELECT regexp_replace(source, '[0-9]+$', '') || '-' AS source, doc_id FROM documents) GROUP BY source")
def input_shard_spec_query(spark, d):
    names = fx.table(spark, d, "documents").select(F.concat(F.regexp_replace("source", r"\d+$", ""), F.lit("-"), F.lpad((F.col("doc_id") % 900).cast("string"), 3, "0")).alias("name"))
    return input_shard_spec(names)


@query("SELECT source AS scale, count(*) // 16 AS per_worker_batch, CAST(sum(n_chars) // 8 AS BIGINT) AS samples_per_checkpoint FROM documents GROUP BY source")
def scale_derived(spark, d):
    """Batches and checkpoints of a scale for each source, which has its rows as a batch and its characters as samples."""
    rows = fx.table(spark, d, "documents").groupBy(F.col("source").alias("scale")).agg(F.count("*").alias("batch_size"), F.sum("n_chars").alias("train_num_samples"))
    return rollup.derived(rows, 8, 2, 8)


@query(
    rf"""SELECT doc_id, CAST({WORDS_SQL} AS INT) AS words, CAST(len(regexp_extract_all(text, '[^ \n\r\t\x{{0b}}\x{{0c}}\x{{00}}]+|\n')) AS INT) AS tokens, CAST(length(text) AS INT) AS chars, sha256(text) AS digest,
    CASE WHEN lower(text)[1] IN ('a', 'e', 'i', 'o', 'u') THEN 'An ' ELSE 'A ' END || substr(lower(lang), 1, 2) AS prompt, printf('%dh %dm %ds', n_chars // 3600, n_chars % 3600 // 60, n_chars % 60) AS time, round(100 * (doc_id % 7 / 7.0::DOUBLE), 1) AS share FROM documents"""
)
def scalar_functions(spark, d):
    rows, text = fx.table(spark, d, "documents"), F.col("text")
    prompt = F.concat(F.element_at(F.split(article_prompt(text), " ", 2), 1), F.lit(" "), F.substring(F.lower("lang"), 1, 2))
    return rows.select(
        "doc_id", word_count(text).alias("words"), token_count(text).alias("tokens"), char_count(text).alias("chars"), F.sha2(text, 256).alias("digest"), prompt.alias("prompt"),
        duration(F.col("n_chars")).alias("time"), percent(F.col("doc_id") % 7 / 7.0).alias("share"),
    )


@query("SELECT doc_id, replace(text, chr(10), ' ') AS line, CASE WHEN text LIKE '%a%' THEN text ELSE lang END AS told, CAST(ceil(n_chars / 100.0) AS BIGINT) AS hundreds FROM documents")
def caption_lines(spark, d):
    rows = fx.table(spark, d, "documents")
    return rows.select("doc_id", one_line(F.col("text")).alias("line"), or_default(F.when(F.col("text").contains("a"), F.col("text")), F.col("lang")).alias("told"), ceil_div(F.col("n_chars"), F.lit(100)).alias("hundreds"))


@query("SELECT shard_id, size FROM shards WHERE shard_id >= 2 AND shard_id < 7", "shards")
def shards_in_range(spark, d):
    return reshard.in_range(fx.shards(spark, d), reshard.ReshardOptions(first_shard=2, num_shards=5))


@query("SELECT vec_id, min(centroid_id) FILTER (m = 1) AS pred, max(CAST(centroid_id IN (0, 3) AND m = 1 AS INT)) = 1 AS among FROM (SELECT vec_id, centroid_id, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, centroid_id) AS m FROM scored WHERE centroid_id < 6) GROUP BY vec_id", "scored")
def masked_classes(spark, d):
    masked = fx.scores(spark, d).withColumn("masked", mask_from(F.col("logits"), F.lit(6)))
    pred = argmax(F.col("masked"))
    return masked.select("vec_id", pred.alias("pred"), is_in(F.array(pred), F.array(F.lit(0), F.lit(3)).cast("array<long>"))[0].alias("among"))


@query("SELECT dataset, line_no, avg(line_no % 10) OVER (PARTITION BY key ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS mean_so_far FROM lines", "lines")
def running_mean(spark, d):
    return rollup.running(fx.log_lines(spark, d).withColumn("main_metric", (F.col("line_no") % 10).cast("double"))).select("dataset", "line_no", "mean_so_far")


@query("""SELECT doc_id, '{"uid":' || CAST(doc_id AS VARCHAR) || ',"ok":true,"boxes":[[' || CAST(doc_id % 7 AS VARCHAR) || ',2]]}' AS document FROM documents""")
def json_fields(spark, d):
    text = F.format_string('{"uid": %d, "ok": true, "boxes": "old"}', F.col("doc_id"))
    return fx.table(spark, d, "documents").select("doc_id", json_with(text, boxes=F.array(F.array(F.col("doc_id") % 7, F.lit(2).cast("long")))).alias("document"))


@query("SELECT source, count(*) AS n FROM (SELECT source FROM documents UNION ALL SELECT lang FROM documents UNION ALL SELECT event_type FROM events) GROUP BY source")
def source_concatenation(spark, d):
    rows = fx.table(spark, d, "documents")
    parts = [rows.select("source"), rows.select(F.col("lang").alias("source")), fx.table(spark, d, "events").select(F.col("event_type").alias("source"))]
    return draws.concatenation(parts).groupBy("source").agg(F.count("*").alias("n"))


_DRAWN = "CAST(('0x' || substr(md5({0}), 1, 13)) AS BIGINT)"


@query(
    f"""WITH kept AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE length(text) > 500),
    drawn AS (SELECT source, {_DRAWN.format("'7:' || source || ':' || CAST(k AS VARCHAR)")} % n AS r FROM (SELECT DISTINCT source, n FROM kept), LATERAL (SELECT unnest(range(0, CAST(floor(n * 0.7::DOUBLE) AS BIGINT))) AS k))
    SELECT source, doc_id, count(*) AS times FROM kept JOIN drawn USING (source, r) GROUP BY ALL"""
)
def draws_per_file(spark, d):
    """Seven tenths of the rows that a mask leaves of each source, drawn with replacement."""
    rows = fx.table(spark, d, "documents").where(F.length("text") > 500).select("source", "doc_id")
    return draws.sample_per_file(rows, 0.7, "source", "doc_id", seed=7).groupBy("source", "doc_id").agg(F.count("*").alias("times"))


@query(
    f"""WITH shards AS (SELECT DISTINCT lang AS source, doc_id // 37 AS shard_id FROM documents WHERE lang IS NOT NULL),
    ranked AS (SELECT source, shard_id, row_number() OVER (PARTITION BY source ORDER BY shard_id) - 1 AS r FROM shards),
    weighed AS (SELECT source, count(*) AS n, CASE source WHEN 'de' THEN 1.0::DOUBLE WHEN 'en' THEN 2.5::DOUBLE WHEN 'fr' THEN 0.25::DOUBLE END AS w FROM shards GROUP BY source),
    sums AS (SELECT source, n, w, sum(w * n) OVER (ORDER BY source) AS hi, sum(w * n) OVER (ORDER BY source) - w * n AS lo FROM weighed WHERE w IS NOT NULL),
    draws AS (SELECT k AS draw, {_DRAWN.format("'3:' || CAST(k AS VARCHAR)")} / 4503599627370496.0::DOUBLE * (SELECT max(hi) FROM sums) AS x FROM range(1000) t(k))
    SELECT draw, source, shard_id FROM (SELECT draw, source, least(CAST(floor((x - lo) / w) AS BIGINT), n - 1) AS r FROM draws JOIN sums ON x >= lo AND x < hi) JOIN ranked USING (source, r)"""
)
def weighted_shard_draws(spark, d):
    """A thousand shards drawn with replacement by the weights of their sources; one source has none."""
    rows = fx.table(spark, d, "documents").where("lang IS NOT NULL")
    shards = rows.select(F.col("lang").alias("source"), F.floor(F.col("doc_id") / 37).alias("shard_id")).distinct()
    return draws.draw_shards(shards, {"de": 1.0, "en": 2.5, "fr": 0.25}, 1000, seed=3)


@query("SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, true AS near FROM documents")
def buffered_order(spark, d):
    """All documents in an order that a buffer of 100 rows shuffles: each is there, none is moved by 100 places."""
    ordered = fx.table(spark, d, "documents").select("doc_id").repartitionByRange(4, "doc_id").sortWithinPartitions("doc_id")
    low = F.lit((1 << 33) - 1)
    placed = written(ordered.withColumn("at", F.monotonically_increasing_id()))
    again = placed.repartition(4, F.shiftright("at", 33)).sortWithinPartitions("at").withColumn("i", F.monotonically_increasing_id().bitwiseAND(low))
    moved = draws.buffered(again, 100, seed=5).withColumn("j", F.monotonically_increasing_id().bitwiseAND(low))
    return moved.agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids"), (F.max(F.abs(F.col("i") - F.col("j"))) < 100).alias("near"))


@query("SELECT region, avg(CAST(pred = target AS DOUBLE)) AS acc, count(*) AS n FROM (SELECT pred, target, (vec_id * 3) % 11 AS region FROM preds) GROUP BY region", "preds")
def metadata_by_position(spark, d):
    places = fx.vectors(spark, d).selectExpr("vec_id AS position", "(vec_id * 3) % 11 AS place_region")
    joined = metrics.by_position(fx.predictions(spark, d).drop("region").withColumnRenamed("vec_id", "position"), places)
    return metrics.group_accuracy(joined.withColumnRenamed("place_region", "region"), ["region"], F.col("pred") == F.col("target"))


@query("SELECT 'lang' AS objective, list(lang ORDER BY lang) AS classes, ['a ' || min(lang) || ' text'] AS templates FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def objective_regroup(spark, d):
    langs = fx.table(spark, d, "documents").select("lang").where("lang IS NOT NULL").distinct()
    lines = langs.select(F.hash("lang").cast("long").alias("h"), F.concat(F.lit("lang:"), "lang").alias("line"), F.lit(True).alias("class"), "lang")
    placed = lines.withColumn("place", F.row_number().over(Window.orderBy("lang")).cast("long")).select("place", "line", "class")  # a few languages
    return metrics.objectives(placed.unionByName(langs.agg(F.concat(F.lit("lang:a "), F.min("lang"), F.lit(" text")).alias("line")).select(F.lit(0).cast("long").alias("place"), "line", F.lit(False).alias("class"))))


@query("SELECT count(*) AS ids, count(DISTINCT uid) AS different, min(uid) AS first, max(uid) AS last FROM subset", "subset")
def subset_file_round_trip(spark, d):
    """Written as one sorted ``.npy`` file and read in splits."""
    path = fx.scratch(spark, "subset.npy")
    write_npy(fx.subset(spark, d), path)
    ids = read_subset(spark, path, split=100).select(uid_hex(F.col("uid_bin")).alias("uid"))
    return ids.agg(F.count("*").alias("ids"), F.count_distinct("uid").alias("different"), F.min("uid").alias("first"), F.max("uid").alias("last"))


@query("SELECT shard_id, count(*) AS successes, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM (SELECT doc_id // 37 AS shard_id, coalesce(text, '') AS text FROM documents) GROUP BY shard_id")
def tar_round_trip(spark, d):
    """Every document as a sample of a tar shard, and back."""
    folder = fx.scratch(spark, "tars")
    rows = fx.pool(spark, d).select(F.floor(F.col("doc_id") / 37).alias("out_shard"), F.col("uid").alias("out_key"), F.create_map(F.lit("txt"), F.coalesce("text", F.lit("")).cast("binary")).alias("fields"))
    write_tars(rows, folder)
    sizes = read_samples(spark, folder).select(F.regexp_extract("shard_name", r"(\d+)", 1).cast("long").alias("shard_id"), F.octet_length(F.col("fields")["txt"]).cast("long").alias("bytes"))
    stats = read_shard_stats(spark, folder)
    return sizes.groupBy("shard_id").agg(F.sum("bytes").alias("bytes")).join(stats, "shard_id")


@query("SELECT vec_id, label FROM embeddings")
def npz_round_trip(spark, d):
    """Vectors as matrices beside their tables, and back by place: each meets its own row."""
    folder = fx.scratch(spark, "npz")
    fx.write_matrices(fx.vectors(spark, d), folder)
    pool = with_position(read_pool(spark, folder, ["vec_id", "label", "embedding"]))
    same = F.forall(F.zip_with("embedding", "vector", lambda a, b: a.cast("float") == b), lambda x: x)
    return gather_embeddings(pool, read_embeddings(spark, folder, "v")).where(same).select("vec_id", "label")


@query("SELECT dataset, arg_max(acc1, line_no) AS acc1 FROM lines GROUP BY dataset", "lines")
def result_file_order(spark, d):
    """Two runs' lines, the second behind the first; the last of each dataset wins."""
    folder, lines = fx.scratch(spark, "results"), fx.log_lines(spark, d)
    last = lines.groupBy("dataset").agg(F.max("line_no").alias("line_no"))
    append_results(lines.join(last, ["dataset", "line_no"], "left_anti").drop("line_no"), folder)
    append_results(lines.join(last, ["dataset", "line_no"]).drop("line_no"), folder)
    return rollup.last_wins(read_results(spark, folder)).select("dataset", F.element_at("metrics", F.lit("acc1")).alias("acc1"))


@query(f"SELECT (a.recall_1 + b.recall_1) / 2 AS mean_recall_1 FROM ({_recall('image', 'caption')}) a, ({_recall('caption', 'image')}) b", "pairs")
def mean_of_recalls(spark, d):
    """The mean of both directions of retrieval."""
    return metrics.mean_recall(*[metrics.retrieval_recall(fx.pairs(spark, d, q, c), q, c) for q, c in (("image", "caption"), ("caption", "image"))])


@query("SELECT printf('%08d.tar', shard_id) AS shard_name, count(*) AS samples, max(place) AS last_place, min(uid) AS first_uid, max(uid) AS last_uid FROM (SELECT md5(CAST(doc_id AS VARCHAR)) AS uid, dense_rank() OVER (ORDER BY doc_id // 200) - 1 AS shard_id, row_number() OVER (PARTITION BY doc_id // 200 ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1 AS place FROM documents) GROUP BY shard_id")
def tar_index(spark, d):
    """Every document with its JSON member as a sample of a tar shard, and the index of the shards, read in parts of 50,000 bytes without the texts."""
    folder = fx.scratch(spark, "tars")
    fields = F.create_map(F.lit("txt"), F.coalesce("text", F.lit("")).cast("binary"), F.lit("json"), F.to_json(F.struct("uid")).cast("binary"))
    write_tars(fx.pool(spark, d).select(F.floor(F.col("doc_id") / 200).alias("out_shard"), F.col("uid").alias("out_key"), fields.alias("fields")), folder)
    index = read_index(spark, folder, split=50_000)
    return index.groupBy("shard_name").agg(F.count("*").alias("samples"), F.max("place").alias("last_place"), F.min("uid").alias("first_uid"), F.max("uid").alias("last_uid"))


def _rules(pos: str) -> str:
    return ", ".join(f"({k}, '{old}', '{new}')" for k, (old, new) in enumerate(RULES[pos], 1))


@query(
    rf"""WITH RECURSIVE words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[^\s\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]+')) AS word FROM documents),
    lemmas AS (SELECT w AS lemma, CASE WHEN length(w) % 2 = 0 THEN 'n' ELSE 'v' END AS pos, 1000 * length(w) + ascii(w) AS o
      FROM (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '\s+')) AS w FROM benchmark) WHERE regexp_full_match(w, '[a-z]+')),
    rules(pos, i, old, new) AS (SELECT 'n', * FROM (VALUES {_rules('n')}) UNION ALL SELECT 'v', * FROM (VALUES {_rules('v')})),
    forms AS (SELECT word, pos, word AS form, CAST([] AS INT[]) AS path FROM words, (VALUES ('n'), ('v')) p(pos)
      UNION ALL SELECT word, f.pos, substr(form, 1, length(form) - length(old)) || new, list_append(path, CAST(i AS INT)) FROM forms f JOIN rules r ON f.pos = r.pos AND suffix(form, old) WHERE length(word) <= 200),
    best AS (SELECT word, arg_min((lemma, f.pos, o), (f.pos, greatest(len(path) - 1, 0), path)) AS b FROM forms f JOIN lemmas l ON f.form = l.lemma AND f.pos = l.pos GROUP BY word)
    SELECT word, b[1] AS lemma, b[2] AS pos, CAST(b[3] AS BIGINT) AS offset FROM best"""
)
def first_synset(spark, d):
    """The first synset of every word of the documents, in an index whose lines are made of the benchmark's words."""
    lemma = fx.table(spark, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("w")).where(F.col("w").rlike("^[a-z]+$")).distinct()
    pos = F.when(F.length("w") % 2 == 0, "n").otherwise("v")
    lines = lemma.select(F.format_string("%s %s 1 2 @ ~ 1 0 %08d  ", "w", pos, 1000 * F.length("w") + F.ascii("w")).alias("value"))
    return first_synsets(vocabulary(fx.table(spark, d, "documents")), parse_index(lines))


def _lloyd(steps: int) -> str:
    """The views ``c0`` to ``c<steps>`` of Lloyd's steps from the centroids of the labels, and ``a<k>`` of who belongs to whom."""
    views = ["v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)", "c0 AS (SELECT CAST(centroid_id AS BIGINT) AS centroid_id, c FROM centroids)"]
    for k in range(steps + 1):
        views.append(f"a{k} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(centroid_id, (d, centroid_id)) AS centroid_id, min(d) AS d FROM (SELECT vec_id, e, centroid_id, list_sum(list_transform(list_zip(e, c), lambda x: (x[1] - x[2]) ** 2)) AS d FROM v, c{k}) GROUP BY vec_id)")
        views.append(f"c{k + 1} AS MATERIALIZED (SELECT c.centroid_id, coalesce(m.c, c.c) AS c FROM c{k} c LEFT JOIN (SELECT centroid_id, list(x ORDER BY i) AS c FROM (SELECT centroid_id, i, avg(e[i]) AS x FROM a{k}, range(1, (SELECT max(len(e)) FROM v) + 1) r(i) GROUP BY ALL) GROUP BY centroid_id) m USING (centroid_id))")
    return ", " + ",\n".join(views) + "\n"


@query(with_views(_lloyd(20) + "SELECT centroid_id, count(*) AS n, round(any_value(total), 6) AS inertia FROM a20, (SELECT sum(d) AS total FROM a20) GROUP BY centroid_id", "centroids"))
def kmeans_inertia(spark, d):
    """Twenty Lloyd's steps from a vector of each label: how many vectors each centroid has then, and the squared distances of all vectors to their nearest in sum."""
    vectors = fx.vectors(spark, d)
    return assigned_counts(vectors, kmeans(vectors, start=fx.centroids(spark, d)))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
