"""K-means against numpy, with any number of blocks and chunks; order statistics by radix selection."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.operators import kmeans as km
from poolsieve.operators.threshold import order_statistic, top_fraction_threshold
from poolsieve.plans.queries import QUERIES


def lloyd(x, c, steps):
    """Centroids after each step, and the inertia before it."""
    told = []
    for _ in range(steps):
        d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        told.append(d.min(axis=1).sum())
        new = np.array([x[own == k].mean(axis=0) if (own == k).any() else c[k] for k in range(len(c))])
        n = np.bincount(own, minlength=len(c))
        donors = [k for k in sorted(range(len(c)), key=lambda k: (-n[k], k)) if n[k] > 1]
        up = np.where(np.arange(c.shape[1]) % 2 == 0, 1 + km.SPLIT, 1 - km.SPLIT)
        for k, donor in zip(np.flatnonzero(n == 0), donors, strict=False):
            mean = x[own == donor].mean(axis=0)
            new[k], new[donor] = mean * up, mean * (2 - up)
        if (new == c).all():
            break
        c = new
    return c, told


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(12, 6)) * 4
    return middle[rng.integers(0, 12, 900)] + rng.normal(size=(900, 6))


def frame(spark, x, parts=4):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(parts)


def centres(df):
    return np.array([r.c for r in df.orderBy("centroid_id").collect()])


def started(spark, c):
    return spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(c)], "centroid_id long, c array<double>")


def test_first_centroids_do_not_depend_on_partitions(spark, points):
    first = [centres(km.first_centroids(frame(spark, points, parts).select(F.col("embedding").alias("vector")), 15, seed=2)) for parts in (2, 5)]
    assert first[0].shape == (15, 6) and (first[0] == first[1]).all() and len({*map(tuple, first[0].tolist())}) == 15


def test_like_numpy(spark, points, monkeypatch):
    """With many blocks, chunks and slices."""
    for name, value in (("CHUNK_BYTES", 20_000), ("BLOCK_BYTES", 150), ("DISTANCE_BYTES", 4000)):
        monkeypatch.setattr(km, name, value)
    df, first = frame(spark, points), points[::61]
    want, told = lloyd(points, first, 5)
    made = km.kmeans(df, start=started(spark, first), iterations=5)
    assert np.allclose(centres(made), want, rtol=1e-12)
    assert all(a > b for a, b in zip(told, told[1:], strict=False))


def test_inertia_falls_every_step(spark, points):
    df, first = frame(spark, points), started(spark, points[:10])
    fallen = [km.assigned_counts(df, km.kmeans(df, iterations=k, start=first)).first().inertia for k in range(1, 4)]
    assert fallen[0] > fallen[1] > fallen[2] and fallen == pytest.approx(lloyd(points, points[:10], 4)[1][1:], abs=1e-5)


def test_empty_clusters_are_split_from_the_largest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 4)) + 10, rng.normal(size=(30, 4)) - 10, rng.normal(size=(5, 4))])
    start = np.concatenate([x[:1], x[60:61], np.full((1, 4), 500.0), x[-1:], np.full((1, 4), 600.0)])
    begin = spark.createDataFrame([(k, c.tolist()) for k, c in enumerate(start)], "centroid_id long, c array<double>")
    got = centres(km.kmeans(frame(spark, x), start=begin, iterations=6))
    want, _ = lloyd(x, start, 6)
    assert np.allclose(got, want, rtol=1e-12) and np.abs(got).max() < 20


def test_bounds_leave_out_most_vectors_and_change_nothing(spark, points, tmp_path):
    """Near the end of the steps few vectors are looked at again."""
    a, b = (lloyd(points, points[:12], k)[0] for k in (9, 10))
    table = lambda cs, moved: km.written(spark.createDataFrame([(k, row.tolist(), float(m)) for k, (row, m) in enumerate(zip(cs, moved, strict=True))], km._CENTROIDS))
    moved = np.sqrt(((a - b) ** 2).sum(axis=1))
    before, after = table(a, moved * 0), table(b, moved)
    looked = []
    whole = km.nearest_two

    def counting(x, files):
        looked.append(len(x))
        return whole(x, files)

    batch = km.pa.RecordBatch.from_arrays([km._lists(points), km.pa.array(np.full(900, -1)), km.pa.array(np.zeros(900)), km.pa.array(np.zeros(900))], ["vector", "centroid_id", "upper", "lower"])
    km.nearest_two = counting
    try:
        state = list(km._assign(km.CentroidFiles(before._written))([batch]))
        again = km.pa.Table.from_batches(list(km._assign(km.CentroidFiles(after._written))(state)))
    finally:
        km.nearest_two = whole
    assert looked[0] == 900 and sum(looked[1:]) < 300
    assert (again["centroid_id"].to_numpy() == ((points[:, None] - b[None]) ** 2).sum(axis=2).argmin(axis=1)).all()


def test_odd_input(spark):
    schema = "vec_id long, embedding array<float>"
    assert km.kmeans(spark.createDataFrame([], schema), 3).collect() == []
    few = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [5.0, 5.0])], schema)
    assert sorted(map(tuple, centres(km.kmeans(few, 10)).tolist())) == [(1.0, 2.0), (5.0, 5.0)]


def test_query_has_the_inertia(spark):
    sf = "/root/testdata/sf0.001"
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    x = np.array([r.embedding for r in vectors.collect()], dtype=np.float64)
    by_label = {}
    for r in sorted(vectors.collect(), key=lambda r: r.vec_id):
        by_label.setdefault(r.label, r.embedding)
    c, _ = lloyd(x, np.array([by_label[k] for k in sorted(by_label)], dtype=np.float64), 20)
    got = QUERIES["kmeans_inertia"](spark, sf).collect()
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert {r.centroid_id: r.n for r in got} == dict(enumerate(np.bincount(d.argmin(axis=1)).tolist()))
    assert all(abs(r.inertia - d.min(axis=1).sum()) < 1e-5 for r in got)


def test_order_statistics(spark):
    rng = np.random.default_rng(4)
    numbers = [*rng.normal(size=500).tolist(), *([0.25] * 40), 0.0, -0.0, float("inf"), float("-inf"), 5e-324, -5e-324]
    df = spark.createDataFrame([(x,) for x in [*numbers, None, float("nan")]], "x double").repartition(5)
    for descending in (False, True):
        ordered = sorted(numbers, reverse=descending)
        for place in (0, 1, 77, 250, 300, len(numbers) - 1):
            assert order_statistic(df, "x", place, descending=descending) == ordered[place]
        assert order_statistic(df, "x", len(numbers), descending=descending) is None
    longs = sorted([*map(int, rng.integers(-(2**63), 2**63 - 1, 200)), -(2**63), 2**63 - 1, 0, -1])
    whole = spark.createDataFrame([(x,) for x in longs] + [(None,)], "x long")
    assert [order_statistic(whole, "x", k) for k in (0, 1, 100, len(longs) - 1)] == [longs[k] for k in (0, 1, 100, len(longs) - 1)]
    assert order_statistic(whole, "x", 0, descending=True) == 2**63 - 1


def test_order_statistic_takes_four_jobs(spark):
    """However large the table is and however many ties it has."""
    tracker = spark.sparkContext.statusTracker()
    for n, name in ((1000, "few"), (3_000_000, "many")):
        spark.sparkContext.setJobGroup(f"radix-{name}", "")
        df = spark.range(n).select(F.when(F.col("id") % 3 > 0, 0.5).otherwise(F.col("id") / n).alias("s"))
        assert top_fraction_threshold(df, "s", 0.5) == 0.5
        stages = sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(f"radix-{name}"))
        assert stages <= 4 * 3  # a pass is two stages, of which the second job sees the first one's again
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
