"""Draws with replacement, weighted shards and the shuffle buffer."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.operators import draws
from poolsieve.operators.reshard import with_output_shard


@pytest.fixture
def rows(spark):
    places = [("a", k) for k in range(0, 4000, 3)] + [("b", k) for k in range(10)] + [(None, 7 * k) for k in range(5)] + [("c", 5)]
    return spark.createDataFrame(places, "file_root string, row_index long").repartition(5)


def test_ranks_over_many_runs(rows, monkeypatch):
    monkeypatch.setattr(draws, "RUN", 64)
    got = {(r.file_root, r.row_index): r["rank"] for r in draws.with_rank(rows, "file_root", "row_index").collect()}
    want = {}
    for f in ("a", "b", None, "c"):
        mine = sorted(k for g, k in got if g == f)
        want |= {(f, k): n for n, k in enumerate(mine)}
    assert got == want and len(got) == rows.count()


@pytest.mark.parametrize("run", [64, 1 << 16])
def test_files_give_exactly_their_share_after_a_mask(rows, monkeypatch, run):
    monkeypatch.setattr(draws, "RUN", run)
    kept = rows.where("row_index % 2 = 0 OR file_root = 'b'")
    there = Counter(r.file_root for r in kept.collect())
    for ratio in (0.1, 0.5, 0.99, 1.0, 2.5):
        drawn = draws.sample_per_file(kept, ratio, seed=3)
        got = Counter(r.file_root for r in drawn.collect())
        assert got == {f: int(n * ratio) for f, n in there.items() if int(n * ratio)}
    assert draws.sample_per_file(kept, 2.5, seed=3).exceptAll(draws.sample_per_file(kept.repartition(2), 2.5, seed=3)).isEmpty()
    assert {(r.file_root, r.row_index) for r in drawn.collect()} <= {(r.file_root, r.row_index) for r in kept.collect()}
    for off in (0, -1, -0.5):
        assert draws.sample_per_file(kept, off).count() == kept.count()


def test_draws_are_even(spark):
    df = spark.range(100).select(F.lit("f").alias("file_root"), F.col("id").alias("row_index"))
    times = Counter(r.row_index for r in draws.sample_per_file(df, 200.0).collect())
    assert sum(times.values()) == 20_000 and len(times) == 100
    assert sum((n - 200) ** 2 / 200 for n in times.values()) < 160  # chi-square of 99 degrees


def test_shards_are_drawn_by_weight(spark):
    shards = spark.createDataFrame([(s, k) for s, n in (("x", 50), ("y", 10), ("z", 200), ("off", 30), ("none", 5)) for k in range(n)], "source string, shard_id long")
    weights = {"x": 1, "y": 10, "z": 0.5, "off": 0, "absent": 3}
    got = draws.draw_shards(shards, weights, 20_000, seed=1).collect()
    assert sorted(r.draw for r in got) == list(range(20_000))
    share = Counter(r.source for r in got)
    assert share.keys() == {"x", "y", "z"}
    for s, w in (("x", 50), ("y", 100), ("z", 100)):
        assert share[s] == pytest.approx(20_000 * w / 250, rel=0.05)
    each = Counter((r.source, r.shard_id) for r in got)
    assert len(each) == 260 and max(each[("y", k)] for k in range(10)) < 1.2 * min(each[("y", k)] for k in range(10))
    for bad in ({"x": -1}, {"off": 0}, {"absent": 1}):
        with pytest.raises(ValueError):
            draws.draw_shards(shards, bad, 5)


def test_a_weight_of_one_is_drawn_too(spark):
    df = spark.range(20_000)
    for weight in (1, 0.3, 2.5):
        got = Counter(r.id for r in draws.weighted_union([(df, weight)]).collect())
        assert sum(got.values()) == pytest.approx(20_000 * weight, rel=0.05)
        assert max(got.values()) > 1 and len(got) < 20_000 * (1 - np.exp(-weight)) * 1.05
    both = draws.weighted_union([(df, 1), (df.selectExpr("id + 50000 AS id"), 3)])
    assert both.where("id >= 50000").count() == pytest.approx(3 * both.where("id < 50000").count(), rel=0.1)
    assert draws.concatenation([df, df]).count() == 40_000


@pytest.mark.parametrize("size", [0, 1, 2, 50, 700, 5000])
def test_a_buffer_moves_rows_a_little(spark, size):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        got = [r.id for r in draws.buffered(spark.range(0, 1000, 1, 1), size, seed=2).collect()]
        again = [r.id for r in draws.buffered(spark.range(0, 1000, 1, 1), size, seed=2).collect()]
        other = [r.id for r in draws.buffered(spark.range(0, 1000, 1, 1), size, seed=3).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == list(range(1000)) and got == again
    moved = [abs(k - x) for k, x in enumerate(got)]
    if size < 2:
        assert got == list(range(1000))
    else:
        assert max(moved) < size and (got != other) and sum(moved) > 0


def test_output_shards_of_a_buffered_order(spark):
    rows = spark.range(500).select(F.format_string("%032x", "id").alias("uid"))
    plain = {r.uid: r.out_shard for r in with_output_shard(rows, ["uid"], 10).collect()}
    moved = {r.uid: r.out_shard for r in with_output_shard(rows, ["uid"], 10, buffer=40, seed=1).collect()}
    assert plain == {f"{k:032x}": k // 10 for k in range(500)}
    assert sorted(moved.values()) == sorted(plain.values()) and moved != plain
    assert all(abs(moved[u] - plain[u]) <= 4 for u in plain)
    with pytest.raises(ValueError):
        draws.buffered(rows, -1)
