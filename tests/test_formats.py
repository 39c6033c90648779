"""The Spark data sources: splits, pruning, pushed filters, and commits that leave nothing behind."""

import io
import json
import os
import random
import subprocess
import sys
import tarfile

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.sinks.subset import write_npy, write_tars
from poolsieve.sources import files
from poolsieve.sources.formats import NpySource, TarReader, TarSource, register
from poolsieve.sources.tar import group_members, read_index, read_samples, tar_members

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def add(tar, name, data):
    info = tarfile.TarInfo(name)
    info.size = len(data)
    tar.addfile(info, io.BytesIO(data))


def inner_tar():
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as tar:
        add(tar, "inner/1.txt", b"headers inside a content are no headers")
    return out.getvalue()


@pytest.fixture(scope="module")
def shards(tmp_path_factory):
    folder, rng = tmp_path_factory.mktemp("shards"), random.Random(0)
    for k, mode in enumerate(["w", "w", "w:gz", "w"]):
        with tarfile.open(folder / f"{k:05d}.tar", mode, format=tarfile.GNU_FORMAT if k else tarfile.PAX_FORMAT) as tar:
            for j in range(60):
                name = f"{'long-folder/' * 15 if j % 9 == 0 else 'd/'}{k}-{j:04d}"
                add(tar, f"{name}.JSON", json.dumps({"uid": f"{100 * k + j:032x}"}).encode())
                add(tar, f"{name}.bin", inner_tar() if j % 7 == 0 else rng.randbytes(rng.randrange(4000)))
                if j % 5 == 0:
                    add(tar, f"{name}.bin", b"a new sample of the same name")
                if j % 8 == 0:
                    add(tar, f"noending{j}", b"x")
    # cut in the middle of a content, and one without an end mark
    whole = (folder / "00003.tar").read_bytes()
    (folder / "00003.tar").write_bytes(whole[: len(whole) * 2 // 3 + 100])
    (folder / "00004.tar").write_bytes((folder / "00001.tar").read_bytes().rstrip(b"\0"))
    (folder / "other.txt").write_text("no tar")
    return str(folder)


def by_hand(folder):
    out, damaged = [], {}
    for name in sorted(n for n in os.listdir(folder) if n.endswith(".tar")):
        with open(f"{folder}/{name}", "rb") as f:
            try:
                for place, (key, fields) in enumerate(group_members(tar_members(f))):
                    out.append((name, place, key, json.loads(fields["json"])["uid"] if "json" in fields else None, sorted(fields.items())))
            except (tarfile.TarError, EOFError, OSError):
                damaged[name] = True
    return sorted(out, key=str), damaged


@pytest.mark.parametrize("split", [3000, 20_000, 1 << 30])
def test_tars_in_any_number_of_parts(spark, shards, split):
    want, damaged = by_hand(shards)
    assert len(damaged) == 2 and any(len(w[2]) > 100 for w in want)
    got = register(spark).read.format("pool_tar").option("split", split).load(shards)
    rows = [r for r in got.collect() if r.damaged is None]
    assert sorted([(r.shard_name, r.place, r.key, r.uid, sorted((e, bytes(b)) for e, b in r.fields.items())) for r in rows], key=str) == want
    assert {r.shard_name for r in got.where("damaged IS NOT NULL").collect()} == damaged.keys()
    parts = sum(-(-os.path.getsize(f"{shards}/{n}") // split) for n in os.listdir(shards) if n.endswith(".tar"))
    assert got.rdd.getNumPartitions() == (parts if split < 1 << 20 else 1)  # small files share a task


def test_small_parts_of_many_files_share_tasks(spark, tmp_path, monkeypatch):
    """A table's tasks do not grow with its parts, and each file is opened by few of them."""
    for k in range(20):
        with tarfile.open(tmp_path / f"{k:05d}.tar", "w") as tar:
            for j in range(20 + k):
                add(tar, f"{k}-{j:04d}.json", json.dumps({"uid": f"{100 * k + j:032x}"}).encode())
                add(tar, f"{k}-{j:04d}.bin", bytes(3000))
    want = sorted(w[:4] for w in by_hand(str(tmp_path))[0])
    told = lambda: sorted((r.shard_name, r.place, r.key, r.uid) for r in read_index(spark, str(tmp_path), split=2000).collect())
    assert told() == want
    monkeypatch.setattr("poolsieve.sources.formats.FEW_BYTES", 100_000)
    monkeypatch.setattr("poolsieve.sources.formats.OPEN_BYTES", 1000)
    reader = TarReader(str(tmp_path), "*.tar", 2000, ["shard_name", "place", "key", "uid"], {})
    whole = sum(-(-p.stat().st_size // 2000) for p in tmp_path.glob("*.tar"))
    for most in (1, 7, 50):
        monkeypatch.setattr("poolsieve.sources.formats.SMALL_TASKS", most)
        groups = reader.partitions()
        assert whole > 1000 and len(groups) <= most + most // 4 + 1
        spans = [(s.path, s.part, s.stop) for g in groups for s in g.splits]
        assert sum(stop - part for _, part, stop in spans) == whole and len(spans) <= len(groups) + 20
        assert sorted(r for g in groups for b in reader.read(g) for r in zip(*b.to_pydict().values(), strict=True)) == want


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_tars_read_only_what_is_asked_for(spark, shards):
    want, _ = by_hand(shards)
    index = read_index(spark, shards, split=5000)
    assert sorted((r.shard_name, r.place, r.key, r.uid) for r in index.where("damaged IS NULL").collect() if r.uid) == sorted(w[:4] for w in want if w[3])
    assert "fields" not in plan(index)
    one = read_samples(spark, shards, split=5000).where(F.col("uid").isin(f"{103:032x}", f"{7:032x}", "none"))
    assert "PushedFilters: [In(uid" in plan(one)
    assert {(r.uid, len(r.fields)) for r in one.collect()} == {(f"{103:032x}", 2), (f"{7:032x}", 2)}
    named = read_samples(spark, shards).where("shard_name = '00001.tar' AND key = 'd/1-0003'")
    assert named.rdd.getNumPartitions() == 1 and [r.uid for r in named.collect()] == [f"{103:032x}"]
    assert read_samples(spark, shards).where("shard_name = 'none'").collect() == []
    some = read_index(spark, shards, first_shard=1, num_shards=2).select("shard_name").distinct().collect()
    assert {r[0] for r in some} == {"00001.tar", "00002.tar"}
    with pytest.raises(Exception, match="no columns"):
        spark.read.format("pool_tar").schema("key string, size long").load(shards).collect()


def test_matrices_by_ranges_of_rows(spark, tmp_path):
    rng = np.random.default_rng(0)
    made = {}
    for name, save, kind in [("a", np.savez, np.float32), ("b", np.savez_compressed, np.float16), ("c", np.savez, np.float64)]:
        made[name] = rng.normal(size=(1000, 8)).astype(kind)
        save(tmp_path / f"{name}.npz", v=made[name], other=np.zeros(3))
    np.savez(tmp_path / "empty.npz", v=np.zeros((0, 8)))
    df = register(spark).read.format("pool_npz").option("key", "v").option("split", 3000).load(str(tmp_path))
    rows = df.collect()
    assert len(rows) == 3000 and len({(r.file_root, r.row_index) for r in rows}) == 3000
    assert all(r.vector == made[r.file_root][r.row_index].astype(np.float32).tolist() for r in rows)
    tasks = df.where("file_root = 'a'").groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == -(-os.path.getsize(tmp_path / "a.npz") // 3000) > 5 and sum(r[1] for r in tasks) == 1000
    part = df.where("row_index > 9 AND row_index <= 12 AND row_index < 100 AND file_root IN ('a', 'b', 'z')").select("file_root", "row_index")
    assert "PushedFilters: [" in plan(part) and "GreaterThan(row_index,9)" in plan(part)
    assert sorted(map(tuple, part.collect())) == [(f, k) for f in "ab" for k in (10, 11, 12)]
    assert df.where("row_index = 5").count() == 3
    no_vectors = spark.read.format("pool_npz").schema("row_index long").option("key", "v").load(str(tmp_path))
    assert no_vectors.agg(F.sum("row_index")).first()[0] == 3 * 999 * 500


def test_ids_are_found_by_bisection(spark, tmp_path):
    ids = sorted(random.Random(1).randbytes(16) for _ in range(500))
    ids = sorted(ids + [ids[7]] * 3 + [b"\0" * 16, b"\xff" * 16])
    uids = spark.createDataFrame([(x.hex(),) for x in ids], "uid string").repartition(3)
    path = str(tmp_path / "ids.npy")
    assert write_npy(uids, path) == len(ids) and os.listdir(tmp_path) == ["ids.npy"]
    df = register(spark).read.format("pool_npy").option("split", 1000).option("sorted", "true").load(path)
    assert [bytes(r.uid_bin) for r in df.orderBy("place").collect()] == ids
    wanted = [ids[0], ids[7], ids[8], ids[-1], b"\1" * 16]
    for sorted_file in ("true", "false"):
        found = spark.read.format("pool_npy").option("split", 1000).option("sorted", sorted_file).load(path).where(F.col("uid_bin").isin(*[F.lit(x) for x in wanted]))
        assert "PushedFilters: [In(uid_bin" in plan(found)
        assert sorted(r.place for r in found.collect()) == [k for k, x in enumerate(ids) if x in wanted]
    assert [r.place for r in df.where("place >= 20 AND place < 23").orderBy("place").collect()] == [20, 21, 22]
    assert write_npy(uids.where("false"), str(tmp_path / "none.npy")) == 0 and np.load(tmp_path / "none.npy").shape == (0,)


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    text = F.when(F.col("id") < 95, F.lit("x")).otherwise(F.raise_error(F.lit("no more"))).cast("binary")
    rows = spark.range(0, 100, 1, 2).select(F.expr("id div 10").alias("out_shard"), F.col("id").cast("string").alias("out_key"), F.create_map(F.lit("txt"), text).alias("fields"))
    with pytest.raises(Exception, match="no more"):
        register(spark)
        rows.write.format("pool_tar").mode("append").save(str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="no more"):
        write_tars(rows, str(tmp_path / "out"))
    assert os.listdir(tmp_path / "out") == []
    with pytest.raises(Exception, match="no more"):
        write_npy(spark.range(9).select(F.raise_error(F.lit("no more")).cast("string").alias("uid")), str(tmp_path / "ids.npy"))
    assert os.listdir(tmp_path) == ["out"]


def test_a_task_that_outlives_an_abort_leaves_nothing(tmp_path):
    out = str(tmp_path / "out")
    schema = T.StructType([T.StructField("out_shard", T.LongType()), T.StructField("out_key", T.StringType()), T.StructField("fields", T.MapType(T.StringType(), T.BinaryType()))])
    rows = pa.RecordBatch.from_arrays([pa.array([0]), pa.array(["k"]), pa.array([[("txt", b"x")]], pa.map_(pa.string(), pa.binary()))], schema.names)
    writer = TarSource({"path": out}).writer(schema, False)
    assert [s[3] for s in writer.write(iter([rows])).shards] == [1]
    writer.abort([])
    with pytest.raises(OSError):
        writer.write(iter([rows]))
    assert os.listdir(out) == []
    parts = NpySource({"path": out + "/parts"}).writer(T.StructType([T.StructField("uid_bin", T.BinaryType())]), False)
    parts.abort([])
    with pytest.raises(OSError):
        parts.write(iter([pa.RecordBatch.from_arrays([pa.array([bytes(16)])], ["uid_bin"])]))
    assert os.listdir(out) == []


RETRIED = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
from poolsieve.sinks.subset import write_npy, write_tars
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3").getOrCreate()
spark.sparkContext.setLogLevel("OFF")

def first_time(where):
    def run(batches):
        rows = 0
        for batch in batches:
            for at in range(batch.num_rows):
                yield batch.slice(at, 1)
                rows += 1
                if rows == 40 and not os.path.exists(where):
                    open(where, "w").close()
                    os._exit(1)  # the worker dies in the middle of its rows
    return run

n = 300
rows = spark.range(n).select(F.expr("id div 50").alias("out_shard"), F.col("id").cast("string").alias("out_key"), F.create_map(F.lit("txt"), F.col("id").cast("string").cast("binary")).alias("fields"))
dealt = rows.repartition(2, "out_shard").sortWithinPartitions("out_shard")
dealt.write  # a narrow task that reads, dies and is run again
from poolsieve.sources.formats import NpySource, TarReader, TarSource, register
register(spark)
dealt.mapInArrow(first_time({folder!r} + "/died"), dealt.schema).write.format("pool_tar").mode("append").save({folder!r} + "/out")
ids = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 32).alias("uid")).repartition(2)
print(write_npy(ids.mapInArrow(first_time({folder!r} + "/died-too"), "uid string"), {folder!r} + "/ids/s.npy"))
"""


def test_a_task_that_dies_leaves_no_orphan(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(RETRIED.format(repo=REPO, folder=str(tmp_path)))
    done = subprocess.run([sys.executable, str(script)], cwd=REPO, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
    assert (tmp_path / "died").exists() and (tmp_path / "died-too").exists()
    out = sorted(os.listdir(tmp_path / "out"))
    assert out == sorted([f"{k:08d}.tar" for k in range(6)] + [f"{k:08d}_stats.json" for k in range(6)])
    names = [m.name for k in range(6) for m in tarfile.open(tmp_path / "out" / f"{k:08d}.tar")]
    assert sorted(names) == sorted(f"{k}.txt" for k in range(300))
    assert os.listdir(tmp_path / "ids") == ["s.npy"] and len(np.load(tmp_path / "ids" / "s.npy")) == 300


def test_overwriting(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").alias("out_shard"), F.col("id").cast("string").alias("out_key"), F.create_map(F.lit("txt"), F.lit("x").cast("binary")).alias("fields"))
    target = str(tmp_path / "t")
    for n, left in ((20, 20), (3, 3)):
        register(spark)
        rows.where(f"id < {n}").repartition("out_shard").sortWithinPartitions("out_shard").write.format("pool_tar").mode("overwrite").option("shard_format", "s-{:03d}.tar").save(target)
        assert files.names(target, ".tar") == [f"s-{k:03d}.tar" for k in range(left)]
    with pytest.raises(Exception, match="written from"):
        rows.drop("out_key").write.format("pool_tar").mode("append").save(target)
