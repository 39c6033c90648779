import hashlib
import io
import json
import tarfile

import pytest

from poolsieve.operators import id_filter, reshard
from poolsieve.plans.reshard_job import run
from poolsieve.sinks.subset import write_npy


def uid(i):
    return hashlib.md5(str(i).encode()).hexdigest()


@pytest.mark.parametrize("words", [None, 700, 10])
def test_filter_loses_nothing_and_turns_away_most(spark, monkeypatch, words):
    if words:
        monkeypatch.setattr(id_filter, "MAX_WORDS", words)  # more ids a word; with 10 words no filter is worth it
    samples = spark.createDataFrame([(uid(i), i % 9) for i in range(20_000)] + [(None, 1), (uid(3), 77)], "uid string, shard_id long")
    subset = spark.createDataFrame([(uid(i),) for i in range(0, 20_000, 10)] + [(uid(0),), (uid("absent"),), (None,)], "uid string")
    passed = id_filter.may_match(samples, subset, 2003)
    rows = [r.uid for r in passed.collect()]
    assert {uid(i) for i in range(0, 20_000, 10)} <= set(rows)
    if words is None:
        assert None not in rows and len(rows) < 2000 + 0.04 * 18_000
    if words == 10:
        assert len(rows) == 20_002
    want, got = (sorted(map(tuple, reshard.multiset_join(samples, subset, ids).collect())) for ids in (None, 2003))
    assert want == got and len(want) == 2001
    assert reshard.missing_count(samples, subset) == 2 == reshard.missing_count(passed, subset)


def test_filter_runs_before_the_shuffle(spark, tmp_path):
    spark.createDataFrame([(uid(i), i) for i in range(100)], "uid string, n long").write.parquet(str(tmp_path / "s"))
    samples, subset = spark.read.parquet(str(tmp_path / "s")), spark.createDataFrame([(uid(1),)], "uid string")
    plan = reshard.multiset_join(samples, subset, 1)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftSemi" in plan and plan.index("Join Inner") < plan.index("Join LeftSemi")


def test_empty_sides(spark):
    none = spark.createDataFrame([], "uid string")
    one = spark.createDataFrame([(uid(1),)], "uid string")
    assert id_filter.may_match(one, none, 0).collect() == [] and id_filter.may_match(none, one, 1).collect() == []
    assert reshard.missing_count(none, one) == 1 and reshard.missing_count(one, none) == 0


def test_the_job_counts_in_its_passes(spark, tmp_path):
    """Counts of the manifest by brute force; most samples are turned away where they are read."""
    (tmp_path / "in").mkdir()
    for shard in range(3):
        with tarfile.open(tmp_path / "in" / f"{shard:08d}.tar", "w") as tar:
            for i in range(shard * 40, shard * 40 + 40):
                for ending, data in (("json", json.dumps({"uid": uid(i)}).encode()), ("jpg", b"x" * 50)):
                    info = tarfile.TarInfo(f"{i:06d}.{ending}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    asked = [uid(i) for i in range(0, 120, 6)] + [uid(6)] * 2 + [uid("absent")] * 3
    write_npy(spark.createDataFrame([(u,) for u in asked], "uid string"), str(tmp_path / "s.npy"))
    done = run(spark, str(tmp_path / "in"), str(tmp_path / "s.npy"), str(tmp_path / "out"), reshard.ReshardOptions(shard_size=7))
    told = {k: done[k] for k in ("samples", "subset_rows", "output_rows", "missing_rows", "consistent", "damaged_shards", "output_count", "failed_rows")}
    assert told == {"samples": 120, "subset_rows": 25, "output_rows": 22, "missing_rows": 3, "consistent": True, "damaged_shards": 0, "output_count": 22, "failed_rows": 0}
