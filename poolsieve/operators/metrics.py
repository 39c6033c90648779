"""Scores of predictions: classification, retrieval, association, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from poolsieve.functions.vector import argmax, jaccard, top_k
from poolsieve.operators.inner_product import nearest_candidates as nearest_candidates


def predictions(logits: DataFrame, k: int = 5) -> DataFrame:
    """Adds ``pred`` and ``top`` from ``logits``."""
    return logits.withColumn("pred", argmax(F.col("logits"))).withColumn("top", top_k(F.col("logits"), k))


def accuracy(preds: DataFrame) -> DataFrame:
    """``acc1, acc5``; acc5 is null with fewer than five classes.  Needs ``target, pred, top``."""
    hit1, hit5 = (F.col("pred") == F.col("target")).cast("double"), F.array_contains("top", F.col("target").cast("long")).cast("double")
    return preds.agg(F.avg(hit1).alias("acc1"), F.when(F.max(F.size("top")) >= 5, F.avg(hit5)).alias("acc5"))


def mean_per_class_recall(preds: DataFrame) -> DataFrame:
    """Over the classes that occur as targets."""
    each = preds.groupBy("target").agg(F.avg((F.col("pred") == F.col("target")).cast("double")).alias("recall"))
    return each.agg(F.avg("recall").alias("mean_per_class_recall"))


def macro_scores(preds: DataFrame) -> DataFrame:
    """Accuracy, and recall and F1 averaged over all classes that occur; an undefined one counts 0."""
    cells = preds.groupBy("target", "pred").agg(F.count("*").alias("n"))
    sides = F.explode(F.array(F.struct(F.col("target").alias("c"), F.col("n").alias("t"), F.lit(0).cast("long").alias("p")), F.struct(F.col("pred").alias("c"), F.lit(0).cast("long").alias("t"), F.col("n").alias("p"))))
    hit = F.when(F.col("target") == F.col("pred"), F.col("n")).otherwise(0)
    per = cells.withColumn("hit", hit).select("hit", sides.alias("s")).groupBy("s.c").agg(F.sum("s.t").alias("t"), F.sum("s.p").alias("p"), F.sum(F.when(F.col("s.t") > 0, F.col("hit")).otherwise(0)).alias("tp"))
    recall, f1 = F.coalesce(F.try_divide("tp", "t"), F.lit(0.0)), F.coalesce(F.try_divide(2 * F.col("tp"), F.col("t") + F.col("p")), F.lit(0.0))
    return per.agg(F.try_divide(F.sum("tp"), F.sum("t")).alias("acc"), F.avg(recall).alias("recall_macro"), F.avg(f1).alias("f1_macro"))


def retrieval_recall(scores: DataFrame, query: str, candidate: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """Share of queries with a relevant candidate among the first k.  Needs ``score, relevant``."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), candidate))
    per = scores.withColumn("rank", rank).groupBy(query).agg(*[F.max((F.col("relevant") & (F.col("rank") <= k)).cast("double")).alias(f"recall_{k}") for k in ks])
    return per.agg(*[F.avg(f"recall_{k}").alias(f"recall_{k}") for k in ks])


def association_jaccard(candidates: DataFrame) -> DataFrame:
    """``instance, n, score``: overlap of the best-scored candidates with the true ones, as many as are true.

    Where none is true, all candidates are taken, as an empty cut from the end means.
    """
    rank = F.row_number().over(Window.partitionBy("instance").orderBy(F.desc("score"), "candidate"))
    need = F.sum(F.col("truth").cast("int")).over(Window.partitionBy("instance"))
    ranked = candidates.withColumn("rank", rank).withColumn("need", need)
    chosen = F.when((F.col("rank") <= F.col("need")) | (F.col("need") == 0), F.col("candidate"))
    per = ranked.groupBy("instance").agg(F.count("*").alias("n"), F.collect_set(F.when(F.col("truth"), F.col("candidate"))).alias("t"), F.collect_set(chosen).alias("p"))
    return per.select("instance", "n", F.coalesce(jaccard(F.col("t"), F.col("p")), F.lit(0.0)).alias("score"))


def jaccard_buckets(scores: DataFrame) -> DataFrame:
    """Mean overall and by number of candidates."""
    buckets = {f"jaccard_score_{k}": F.col("n") == k for k in (5, 6, 10, 12)} | {"jaccard_score_5_6": F.col("n") <= 6, "jaccard_score_10_12": F.col("n") >= 10}
    return scores.agg(F.avg("score").alias("avg_jaccard_score"), *[F.avg(F.when(c, F.col("score"))).alias(k) for k, c in buckets.items()])


def group_accuracy(preds: DataFrame, groups: list[str], hit: Column, domain: DataFrame | None = None) -> DataFrame:
    """``n, acc`` for each group; groups of ``domain`` without rows have n 0 and a null score."""
    per = preds.groupBy(*groups).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("acc"))
    return per if domain is None else domain.join(per, groups, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def worst_group(per_group: DataFrame, without: list | None = None, group: str | None = None) -> DataFrame:
    """The least score of groups that have rows and are not left out."""
    rows = per_group.where("n > 0")
    if without:
        rows = rows.where(~F.col(group).isin(*without))
    return rows.agg(F.min("acc").alias("worst_acc"))


def year_region(preds: DataFrame, hit: Column, without_regions: list | None = None) -> DataFrame:
    """Accuracy, the worst year's and the worst region's, from one pass over the rows."""
    cells = preds.groupBy("year", "region").agg(F.count("*").alias("n"), F.sum(hit.cast("double")).alias("h"))
    years = cells.groupBy("year").agg((F.sum("h") / F.sum("n")).alias("acc")).agg(F.min("acc").alias("acc_worst_year"))
    regions = cells.groupBy("region").agg(F.sum("n").alias("n"), (F.sum("h") / F.sum("n")).alias("acc"))
    total = cells.agg((F.sum("h") / F.sum("n")).alias("acc_avg"))
    worst = worst_group(regions, without_regions, "region").withColumnRenamed("worst_acc", "acc_worst_region")
    return total.crossJoin(years).crossJoin(worst)  # one row each


def multilabel_groups(preds: DataFrame) -> DataFrame:
    """The six group reports of face predictions, ``metric, name, n, acc``.

    Needs ``race_binary, race, gender, age`` and ``pred_race, pred_gender,
    pred_age, pred_toxic``.  Names of combined groups list the fields last to first.
    """
    by_binary, by_race = ["race_binary"], ["race"]
    toxic = F.col("pred_toxic")
    parts = [
        ("acc_race", by_binary, (F.col("pred_race") != 1).cast("int") == F.col("race_binary")),
        ("acc_gender", by_binary, F.col("pred_gender") == F.col("gender")),
        ("acc_age", by_binary, F.col("pred_age") == F.col("age")),
        ("acc_gender_x", ["gender", "race"], F.col("pred_gender") == F.col("gender")),
        ("toxicity_crime", by_race, toxic >= 18),
        ("toxicity_nonhuman", by_race, (toxic >= 14) & (toxic < 18)),
    ]
    # every metric's rows at once: one pass, one partial aggregation
    label = lambda groups: F.concat_ws("_", *[F.concat(F.lit(f"{g}:"), F.col(g).cast("string")) for g in reversed(groups)])
    each = [F.struct(F.lit(metric).alias("metric"), name.alias("name"), hit.cast("double").alias("hit")) for metric, groups, hit in parts for name in (label(groups), F.lit("avg"))]
    return preds.select(F.explode(F.array(*each)).alias("x")).groupBy("x.metric", "x.name").agg(F.count("*").alias("n"), F.avg("x.hit").alias("acc"))


def mean_recall(text: DataFrame, image: DataFrame, k: int = 1) -> DataFrame:
    """``mean_recall_k``, one row: the mean of both directions' recall at ``k``."""
    both = text.select(f"recall_{k}").unionByName(image.select(f"recall_{k}"))
    return both.agg((F.sum(f"recall_{k}") / 2).alias(f"mean_recall_{k}"))


def by_position(preds: DataFrame, metadata: DataFrame, position: str = "position") -> DataFrame:
    """Predictions with the group metadata of the same place in the evaluation set."""
    return preds.join(metadata, position)


def objectives(templates: DataFrame) -> DataFrame:
    """``objective, classes, templates`` of a multi-label task's lists, in their order.

    ``templates`` has ``place``, ``class`` (whether the line names a class, else a
    template) and ``line``, which is ``objective:text``.  They are few.
    """
    named = templates.select("place", F.split("line", ":", 2)[0].alias("objective"), F.split("line", ":", 2)[1].alias("text"), F.col("class").alias("is_class"))
    kept = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("place", "text")))), lambda s: s["text"])
    return named.groupBy("objective").agg(kept(F.col("is_class")).alias("classes"), kept(~F.col("is_class")).alias("templates"))


def report(per_group: DataFrame, rows: str, columns: str, value: str) -> DataFrame:
    """A table of percentages, one column for each value of ``columns``."""
    return per_group.groupBy(rows).pivot(columns).agg(F.round(100 * F.first(value), 1))


#: The report of each family of tasks, by the first part of a task's key.
REPORTS = {
    "classification": accuracy,
    "retrieval": retrieval_recall,
    "wilds": group_accuracy,
    "fairness": multilabel_groups,
    "misc": association_jaccard,
}


def report_of(key: str):
    """The function that scores the task ``key``; tasks of no named family are classifications."""
    return REPORTS.get(key.split("/")[0] if "/" in key else "classification", accuracy)
