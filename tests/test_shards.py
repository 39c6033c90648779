import bisect
import fnmatch
import io
import json
import re
import tarfile

import numpy as np
import pytest
from hypothesis import HealthCheck, example, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolsieve import cli
from poolsieve.functions.lang import first_bytes, model_detector
from poolsieve.functions.uid import uid_hex
from poolsieve.operators import draws, metrics, reshard, rollup
from poolsieve.plans.reshard_job import _dealt, run
from poolsieve.sinks.subset import append_results, write_json, write_npy, write_table, write_tars
from poolsieve.sources import metadata as md
from poolsieve.sources.names import name_glob, number_regex, stats_name
from poolsieve.sources.tar import group_members, read_samples
from poolsieve.streaming.filters import select_uids_stream, stream_pool

QUICK = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def test_npy_is_what_numpy_writes(spark, tmp_path):
    rng = np.random.default_rng(0)
    uids = [rng.bytes(16).hex() for _ in range(700)]
    uids += uids[:50] + ["bad"]
    df = spark.createDataFrame([(u,) for u in uids], "uid string").repartition(5)
    assert write_npy(df, str(tmp_path / "s.npy")) == 750
    want = np.array([(int(u[:16], 16), int(u[16:], 16)) for u in uids[:-1]], dtype=np.dtype("u8,u8"))
    want.sort()
    got = np.load(tmp_path / "s.npy")
    assert got.dtype == np.dtype("u8,u8") and (got == want).all()
    want.tofile(tmp_path / "raw.bin")
    for name in ("s.npy", "raw.bin"):
        back = md.read_subset(spark, str(tmp_path / name)).select(uid_hex(F.col("uid_bin")).alias("u"))
        assert sorted(r.u for r in back.collect()) == sorted(uids[:-1])
    np.save(tmp_path / "wrong.npy", np.arange(4))
    with pytest.raises(Exception, match="not pairs"):
        md.read_subset(spark, str(tmp_path / "wrong.npy")).collect()


def test_group_members():
    files = [("a/1.jpg", b"1"), ("a/1.JSON", b"2"), ("noending", b"x"), ("a/2.jpg", b"3"), ("a/2.jpg", b"4"), ("a/1.seg.png", b"5"), (".hidden", b"6")]
    assert list(group_members(files)) == [("a/1", {"jpg": b"1", "json": b"2"}), ("a/2", {"jpg": b"3"}), ("a/2", {"jpg": b"4"}), ("a/1", {"seg.png": b"5"})]


def write_tar(path, samples):
    with tarfile.open(path, "w") as tar:
        for key, fields in samples:
            for ending, data in fields.items():
                info = tarfile.TarInfo(f"{key}.{ending}")
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))


def test_reshard_tars(spark, tmp_path):
    (tmp_path / "in").mkdir()
    uids = [f"{i:032x}" for i in range(23)]
    for shard in range(3):
        mine = uids[shard * 8 : shard * 8 + 8]
        write_tar(tmp_path / "in" / f"{shard:08d}.tar", [(f"k{u[-4:]}", {"json": json.dumps({"uid": u}).encode(), "jpg": u.encode()}) for u in mine])
        (tmp_path / "in" / f"{shard:08d}_stats.json").write_text(json.dumps({"successes": len(mine)}))
    with open(tmp_path / "in" / "00000002.tar", "r+b") as f:
        f.truncate(9 * 1024)  # a damaged end
    samples = read_samples(spark, str(tmp_path / "in"))
    there = {r.uid for r in samples.collect()}
    assert set(uids[:16]) <= there and len(there) < 23
    subset = spark.createDataFrame([(u,) for u in [uids[1]] * 3 + [uids[5], uids[9], "f" * 32]], "uid string")
    rows = reshard.multiset_join(samples, subset)
    placed = reshard.with_output_shard(rows, ["uid", "copy"], 2)
    done = write_tars(placed, str(tmp_path / "out")).collect()
    assert sorted((r.name, r.successes) for r in done) == [("00000000.tar", 2), ("00000001.tar", 2), ("00000002.tar", 1)]
    again = read_samples(spark, str(tmp_path / "out"))
    assert sorted(r.key for r in again.collect()) == sorted([f"{uids[1]}-{k}" for k in range(3)] + [f"{uids[5]}-0", f"{uids[9]}-0"])
    assert {bytes(r.fields["jpg"]).decode() for r in again.collect()} == {uids[1], uids[5], uids[9]}
    report = reshard.reconcile(samples, subset, rows).first()
    assert (report.subset_rows, report.output_rows, report.missing_rows, report.consistent) == (6, 5, 1, True)
    stats = md.read_shard_stats(spark, str(tmp_path / "in"))
    tars = md.list_tars(spark, str(tmp_path / "in"))
    assert md.shard_count(tars) == 3
    table = tmp_path / "sizes.json"
    table.write_text(json.dumps({"00000001.tar": 99}))
    sizes = reshard.shard_sizes(tars, stats, md.read_shard_table(spark, str(table)))
    assert {r.shard_id: r.size for r in sizes.collect()} == {0: 8, 1: 99, 2: 7}
    table.write_text("not json")
    assert md.read_shard_table(spark, str(table)).collect() == []


@QUICK
@example(sizes=[1, 0], workers=1)
@example(sizes=[0, 0, 0], workers=4)
@given(sizes=st.lists(st.integers(0, 50), min_size=1, max_size=30), workers=st.integers(1, 9))
def test_worker_plan(spark, sizes, workers):
    shards = spark.createDataFrame(list(enumerate(sizes)), "shard_id long, size long")
    plan = reshard.worker_plan(shards, workers).orderBy("worker_id").collect()
    assert sum(p.shards for p in plan) == len(sizes) and sum(p.rows for p in plan) == sum(sizes)
    at = 0
    for p in plan:
        assert p.first_shard == at and p.rows == sum(sizes[at : at + p.shards])
        at += p.shards
    assert len(plan) <= workers
    # the rule told by its cuts
    each = max(1, -(-sum(sizes) // min(workers, len(sizes))))
    starts = [sum(sizes[:i]) for i in range(len(sizes))]
    cuts = [*[bisect.bisect_left(starts, c) for c in range(0, sum(sizes), each)], len(sizes)]
    if sum(sizes):
        assert [(p.first_shard, p.shards) for p in plan] == [(a, z - a) for a, z in zip(cuts, cuts[1:]) if z > a]
    offsets = {r.shard_id: r.data_start for r in reshard.shard_offsets(shards).collect()}
    assert offsets == {i: sum(sizes[:i]) for i in range(len(sizes))}


@QUICK
@given(times=st.lists(st.integers(0, 4), min_size=1, max_size=20), size=st.integers(1, 7))
def test_multiset_join(spark, times, size):
    samples = spark.createDataFrame([(f"u{i:02d}",) for i in range(len(times))], "uid string")
    subset = spark.createDataFrame([(f"u{i:02d}",) for i, n in enumerate(times) for _ in range(n)], "uid string")
    rows = reshard.multiset_join(samples, subset)
    want = sorted(f"u{i:02d}-{k}" for i, n in enumerate(times) for k in range(n))
    placed = {r.out_key: r.out_shard for r in reshard.with_output_shard(rows, ["uid", "copy"], size).collect()}
    assert placed == {k: n // size for n, k in enumerate(want)}


def test_npz_rows_meet_their_parquet_rows(spark, tmp_path):
    for name in ("p0", "p1"):
        rows = spark.createDataFrame([(f"{name}-{i}",) for i in range(7)], "uid string").coalesce(1)
        rows.toPandas().to_parquet(tmp_path / f"{name}.parquet")
        np.savez(tmp_path / f"{name}.npz", l14_img=np.arange(14, dtype=np.float16).reshape(7, 2) + (100 if name == "p1" else 0))
    pool = md.with_position(md.read_pool(spark, str(tmp_path), ["uid"]))
    got = md.attach_embeddings(pool, md.read_embeddings(spark, str(tmp_path))).collect()
    assert {r.uid: r.vector[0] for r in got} == {f"p{k}-{i}": 100.0 * k + 2 * i for k in (0, 1) for i in range(7)}


def test_blur_map_and_boxes(spark, tmp_path):
    path = tmp_path / "map.json"
    path.write_text(json.dumps({"x": {"parquet": "b0", "shards": ["in/00000000.tar", "in/00000002.tar"]}}))
    shards = spark.createDataFrame([(i, 5) for i in range(3)], "shard_id long, size long")
    assert {r.shard_id: r.parquet for r in reshard.attach_parquet(shards, md.read_blur_map(spark, str(path))).collect()} == {0: "b0", 1: None, 2: "b0"}
    samples = spark.createDataFrame([("b0", "u"), ("b0", "v"), ("b0", "w"), (None, "u")], "parquet string, uid string")
    boxes = spark.createDataFrame([("b0", "u", [[1.0]]), ("b0", "v", [])], "parquet string, uid string, face_bboxes array<array<double>>")
    assert sorted((r.parquet or "", r.uid, r.blurred) for r in reshard.attach_boxes(samples, boxes).collect()) == [("", "u", False), ("b0", "u", True), ("b0", "v", False), ("b0", "w", False)]
    with pytest.raises(ValueError):
        reshard.ReshardOptions(apply_blur=True).check()


def test_shard_specs(spark):
    names = spark.createDataFrame([("a/0000",), ("a/0012",), ("b/7",), ("b/x",), ("a/0003",)], "name string")
    assert md.joined_spec(md.input_shard_spec(names)) == "a/{0000..0012}.tar::b/{0..7}.tar"
    assert md.manifest_spec(json.dumps({"output_shard_count": 12, "output_shard_format": "{:05d}.tar"})) == "{00000..00011}.tar"


def test_results(spark, tmp_path):
    tasks = tmp_path / "t.yml"
    tasks.write_text("retrieval/a:\n  name: A\n  size: 3\n  main_metric: r1\n  time: 1\nb:\n  name: B\n  size: 4\n  time: 2\n  tags: [x]\n")
    dim = md.read_tasks(spark, str(tasks))
    log = tmp_path / "r.jsonl"
    log.write_text("\n".join(json.dumps(x) for x in [
        {"key": "b", "dataset": "B", "metrics": {"acc1": 0.1, "acc5": None}}, {"key": "retrieval/a", "dataset": "A", "metrics": {"r1": 0.5, "acc1": 0.9}},
        {"key": "b", "dataset": "B", "metrics": {"acc1": 0.3}}, {"key": "zz", "dataset": "Z", "metrics": {"acc1": 1.0}},
    ]))
    results = rollup.main_metric(rollup.last_wins(md.read_results(spark, str(log)).drop("main_metric")), dim)
    assert {r.dataset: r.main_metric for r in results.collect()} == {"A": 0.5, "B": 0.3}
    groups = spark.createDataFrame([("g", "A"), ("g", "B"), ("h", "Z")], "grouping string, dataset string")
    assert {r.grouping: r.score for r in rollup.group_scores(results, groups, 2).collect()} == {"g": 0.4, "Average": 0.4}
    with pytest.raises(ValueError):
        rollup.group_scores(results, groups, 38)
    assert rollup.pending(dim, results.limit(0)).count() == 2
    assert {r[0] for r in dim.select(rollup.family(F.col("key"))).collect()} == {"retrieval", "classification"}
    append_results(results.select("key", "dataset", "metrics"), str(tmp_path / "out"))
    append_results(results.select("key", "dataset", "metrics"), str(tmp_path / "out"))
    assert md.read_results(spark, str(tmp_path / "out")).count() == 4
    assert rollup.submission(results, "small", None, 12_800_000, "mine").first().dataset_size == 12_800_000
    assert rollup.scale_config(spark, "xlarge")["batch_size"] == 90112
    with pytest.raises(ValueError):
        rollup.scale_config(spark, "huge")
    assert rollup.published_groups(spark).count() == 23


def test_verify_and_tables(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.bin").write_bytes(b"abc")
    digest = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    want = spark.createDataFrame([("a.bin", 3, digest), ("b.bin", 1, digest), ], "name string, size long, sha256 string")
    assert {r.name: (r.ok, r.present) for r in md.verify_files(spark, str(tmp_path / "f"), want).collect()} == {"a.bin": (True, True), "b.bin": (False, False)}
    write_table(want, str(tmp_path / "t"))
    with pytest.raises(Exception, match="already exists"):
        write_table(want, str(tmp_path / "t"))
    write_table(want, str(tmp_path / "t"), overwrite=True)
    write_json(str(tmp_path / "m.json"), {"a": 1})
    assert json.loads((tmp_path / "m.json").read_text()) == {"a": 1}


def test_metric_edges(spark):
    preds = spark.createDataFrame([(0, 0, [0, 1]), (0, 1, [1, 0]), (2, 0, [0, 1])], "target int, pred long, top array<long>")
    a = metrics.accuracy(preds).first()
    assert abs(a.acc1 - 1 / 3) < 1e-12 and a.acc5 is None
    m = metrics.macro_scores(preds).first()
    assert abs(m.recall_macro - (0.5 + 0 + 0) / 3) < 1e-12 and abs(m.f1_macro - 0.5 / 3) < 1e-12
    assert metrics.mean_per_class_recall(preds).first()[0] == 0.25
    none = spark.createDataFrame([(1, 1, False, 3), (1, 2, False, 5), (2, 1, True, 1), (2, 2, False, 0)], "instance long, candidate long, truth boolean, score long")
    assert {r.instance: r.score for r in metrics.association_jaccard(none).collect()} == {1: 0.0, 2: 1.0}


def test_streaming_filter(spark, tmp_path):
    pool = spark.createDataFrame([(f"u{i}", "three small words", "en", 300, 300, i / 10.0, 0.5) for i in range(10)], "uid string, text string, lang string, original_width long, original_height long, clip_b32_similarity_score double, clip_l14_similarity_score double")
    pool.repartition(3).write.parquet(str(tmp_path / "pool"))
    stream = select_uids_stream("laion2b", stream_pool(spark, str(tmp_path / "pool"), pool.schema))
    q = stream.writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.uid for r in spark.table("kept").collect()) == [f"u{i}" for i in range(3, 10)]
    with pytest.raises(ValueError):
        select_uids_stream("text_based", stream)


def test_reshard_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    uids = [f"{i:032x}" for i in range(20)]
    for shard in range(2):
        write_tar(tmp_path / "in" / f"{shard:08d}.tar", [(f"k{u[-4:]}", {"json": json.dumps({"uid": u}).encode(), "jpg": u.encode()}) for u in uids[shard * 10 : shard * 10 + 10]])
    chosen = spark.createDataFrame([(u,) for u in uids[3:15] + uids[3:5]], "uid string")
    write_npy(chosen, str(tmp_path / "s.npy"))
    boxes = spark.createDataFrame([("00000000.tar", uids[4], [[1.0, 2.0]])], "shard_name string, uid string, face_bboxes array<array<double>>")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "s.npy"), str(tmp_path / "out"))
    dry = run(*args, reshard.ReshardOptions(dry_run=True))
    assert dry["output_rows"] == 14 and not (tmp_path / "out").exists()
    options = reshard.ReshardOptions(shard_size=5, shuffle_seed=1, inject_blur=True, blur_map=True)
    done = run(*args, options, boxes)
    assert (done["output_shard_count"], done["output_count"], done["consistent"]) == (3, 14, True)
    rows = read_samples(spark, str(tmp_path / "out")).collect()
    assert sorted(r.key for r in rows) == sorted([f"{u}-0" for u in uids[3:15]] + [f"{u}-1" for u in uids[3:5]])
    told = [json.loads(bytes(r.fields["json"])) for r in rows if r.uid == uids[4]]
    assert told == [{"uid": uids[4], "face_bboxes": [[1.0, 2.0]]}] * 2
    assert md.manifest_spec((tmp_path / "out" / "meta.json").read_text()) == "{00000000..00000002}.tar"
    with pytest.raises(ValueError):
        run(*args)
    assert run(*args, reshard.ReshardOptions(overwrite=True, num_shards=1))["output_count"] == 9
    assert metrics.report_of("wilds/x") is metrics.group_accuracy and metrics.report_of("imagenet") is metrics.accuracy


def test_model_detector(spark):
    detect = model_detector(lambda: lambda texts: ["__label__en" if "the" in t and "\n" not in t else "__label__xx" for t in texts])
    df = spark.createDataFrame([("a\nthe",), ("b",), (None,)], "text string").select("text", detect(F.col("text")).alias("l"))
    assert {r.text: r.l for r in df.collect()} == {"a\nthe": "en", "b": "xx", None: None}


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_million_rows_fill_their_shards(spark, adaptive):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = spark.range(1_000_000).select(F.md5(F.col("id").cast("string")).alias("uid"), F.repeat(F.lit("x"), 20).alias("payload"))
        placed = reshard.with_output_shard(rows, ["uid"], 10_000)
        per = placed.groupBy("out_shard").agg(F.count("*").alias("n"), F.min("uid").alias("lo"), F.max("uid").alias("hi")).orderBy("out_shard").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert [(r.out_shard, r.n) for r in per] == [(k, 10_000) for k in range(100)]
    assert all(a.hi < b.lo for a, b in zip(per, per[1:]))


def test_large_shards_go_on_without_gaps(spark, tmp_path):
    rows = [(shard, f"{shard}-{k}", {"bin": bytes(600)}) for shard in range(3) for k in range(4)]
    done = write_tars(spark.createDataFrame(rows, "out_shard long, out_key string, fields map<string,binary>"), str(tmp_path / "o"), "{:04d}.tar", max_bytes=1500)
    assert sorted((r.name, r.successes) for r in done.collect()) == [(f"{k:04d}.tar", (3, 1)[k % 2]) for k in range(6)]
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == sorted([f"{k:04d}.tar" for k in range(6)] + [f"{k:04d}_stats.json" for k in range(6)])
    assert [r.key for r in read_samples(spark, str(tmp_path / "o"), "0002.tar").collect()] == ["1-0", "1-1", "1-2"]


def test_subsets_are_read_in_splits(spark, tmp_path):
    ids = np.arange(1000, dtype="<u8").repeat(2).view(np.dtype("u8,u8"))
    np.save(tmp_path / "s.npy", ids)
    got = md.read_subset(spark, f"file:{tmp_path}/s.npy", split=37).select(uid_hex(F.col("uid_bin")).alias("u"))
    assert sorted(r.u for r in got.collect()) == [f"{k:016x}{k:016x}" for k in range(1000)]
    np.save(tmp_path / "none.npy", ids[:0])
    assert md.read_subset(spark, str(tmp_path / "none.npy")).collect() == []


def test_damage_is_told_and_workers_planned(spark, tmp_path):
    (tmp_path / "in").mkdir()
    uids = [f"{i:032x}" for i in range(12)]
    for shard in range(2):
        write_tar(tmp_path / "in" / f"{shard:08d}.tar", [(f"k{u[-4:]}", {"json": json.dumps({"uid": u}).encode(), "jpg": u.encode() * 40}) for u in uids[shard * 6 : shard * 6 + 6]])
        (tmp_path / "in" / f"{shard:08d}_stats.json").write_text('{"successes": 6}')
    with open(tmp_path / "in" / "00000001.tar", "r+b") as f:
        f.truncate(7 * 1024)
    write_npy(spark.createDataFrame([(u,) for u in uids], "uid string"), str(tmp_path / "s.npy"))
    (tmp_path / "map.json").write_text(json.dumps({"x": {"parquet": "b.parquet", "shards": ["in/00000000.tar"]}, "y": {"parquet": "c.parquet", "shards": ["elsewhere/00000001.tar"]}}))
    spark.createDataFrame([(uids[2].lstrip("0"), [[1.0, 2.0]]), (uids[3], [])], "uid string, face_bboxes array<array<double>>").toPandas().to_parquet(tmp_path / "b.parquet")
    blur = lambda ending, data, boxes, quality: ("webp", b"blurred %d" % quality)
    options = reshard.ReshardOptions(shard_size=4, num_workers=2, apply_blur=True, inject_blur=True, blur_map=True, webp_quality=55, write_shard_table=True, shard_table=str(tmp_path / "sizes.json"))
    done = run(spark, str(tmp_path / "in"), str(tmp_path / "s.npy"), str(tmp_path / "out"), options, blur_map_path=str(tmp_path / "map.json"), codec=blur)
    assert done["damaged_shards"] == 1 and done["shards_without_boxes"] == 1 and done["blurred"] == 1 and done["failed_rows"] == 0
    assert 6 < done["output_count"] < 12 and done["unprocessed"] == 12 - done["samples"]
    assert [w["worker_id"] for w in done["workers"]] == [0, 1]
    rows = {r.uid: r.fields for r in read_samples(spark, str(tmp_path / "out")).collect()}
    assert bytes(rows[uids[2]]["webp"]) == b"blurred 55" and "jpg" not in rows[uids[2]] and json.loads(bytes(rows[uids[2]]["json"]))["face_bboxes"] == [[1.0, 2.0]]
    assert "jpg" in rows[uids[3]]
    assert json.loads((tmp_path / "sizes.json").read_text()) == {"00000000.tar": 6, "00000001.tar": 6}
    assert md.shard_spec(f"{tmp_path}/out::x/y.tar::{tmp_path}/in") == f"{tmp_path}/out/{{00000000..0000000{done['output_shard_count'] - 1}}}.tar::x/y.tar::{tmp_path}/in/{{00000000..00000001}}.tar"


@QUICK
@given(number=st.integers(0, 10**6), width=st.integers(0, 7), before=st.text("ab-.[{*", max_size=4), behind=st.sampled_from([".tar", "-x.tar", "{y}.tar"]))
def test_names_of_numbered_files(number, width, before, behind):
    double = lambda t: t.replace("{", "{{").replace("}", "}}")
    form = double(before) + (f"{{:0{width}d}}" if width else "{}") + double(behind)
    name = form.format(number)
    assert int(re.search(number_regex(form), name)[1]) == number and fnmatch.fnmatch(name, name_glob(form))
    for other in ("0" + name, name + "x", before + f"{number:0{width + 7}d}x" + behind, before + "0" + f"{number:0{max(width, 1)}d}" + behind):
        assert re.search(number_regex(form), other) is None or form.format(int(re.search(number_regex(form), other)[1])) == other
    for wrong in ("x.tar", "{}-{}.tar", "{:>8}.tar", "{:8.2f}.tar"):
        with pytest.raises(ValueError):
            number_regex(wrong)


def test_job_by_named_shards_and_worker_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    uids = [f"{i:032x}" for i in range(24)]
    for shard in range(6):
        samples = [(f"k{u[-4:]}", {"json": json.dumps({"uid": u}).encode()}) for u in uids[shard * 4 : shard * 4 + 4]]
        write_tar(tmp_path / "in" / f"part-{shard:03d}-a.tar", samples)
        (tmp_path / "in" / f"count-{shard:03d}.json").write_text('{"successes": 4}')
        write_tar(tmp_path / "in" / f"{shard:08d}.tar", samples)  # of another form
    (tmp_path / "in" / "count-x.json").write_text('{"successes": 99}')
    write_npy(spark.createDataFrame([(u,) for u in uids], "uid string"), str(tmp_path / "s.npy"))
    argv = ["reshard", "-i", str(tmp_path / "in"), "-o", str(tmp_path / "out"), "-s", str(tmp_path / "s.npy"), "--shard-format", "part-{:03d}-a.tar", "--shard-stats-format", "count-{:03d}.json"]
    argv += ["--output-shard-format", "o{:04d}.tar", "--output-shard-stats-format", "n{:06d}.json", "--shard-size", "10", "-j", "4", "-q", "--first-shard", "1", "-n", "4"]
    assert cli.main(argv) == 0
    made = {p.name for p in (tmp_path / "out").iterdir() if p.name[0] in "on"}
    assert made == {"o0000.tar", "o0001.tar", "n000000.json", "n000001.json"}
    assert sorted(r.uid for r in read_samples(spark, str(tmp_path / "out")).collect()) == uids[4:20]
    meta = json.loads((tmp_path / "out" / "meta.json").read_text())
    assert meta["unprocessed"] == 0 and [(w["first_shard"], w["shards"]) for w in meta["workers"]] == [(k, 1) for k in range(1, 5)]
    with pytest.raises(ValueError):
        reshard.ReshardOptions(input_format="x.tar").check()
    assert stats_name("{}_stats.json", "a.tar", 3) == "a_stats.json" and stats_name("{:04d}.json", "a.tar", 3) == "0003.json"


@pytest.mark.parametrize("workers", [1, 3, 40])
def test_workers_read_contiguous_ranges(spark, workers):
    sizes = [(k, (k * 7) % 5 + 1) for k in range(30)]
    work = spark.createDataFrame([(k, str(k), [k]) for k in range(32)], "shard_id long, path string, wanted array<long>").repartition(7)
    dealt = _dealt(work, spark.createDataFrame(sizes, "shard_id long, size long"), workers)
    assert dealt.rdd.getNumPartitions() == workers
    parts = [[int(r.path) for r in part] for part in dealt.rdd.glom().collect()]
    plan = {p.worker_id: (p.first_shard, p.shards) for p in reshard.worker_plan(spark.createDataFrame(sizes, "shard_id long, size long"), workers).collect()}
    assert sorted(x for p in parts for x in p) == list(range(32))
    for k, part in enumerate(parts):
        first, n = plan.get(k, (0, 0))
        assert [x for x in part if x < 30] == list(range(first, first + n)) and part == sorted(part)
    single = _dealt(work, None, None)
    assert sorted(int(r.path) for r in single.collect()) == list(range(32))


def test_bounds_of_a_detector(spark):
    assert [first_bytes("aéz", n) for n in range(5)] == ["", "a", "a", "aé", "aéz"]
    detect = model_detector(lambda: lambda texts: [str(len(t.encode())) for t in texts], least_bytes=2, most_bytes=1000)
    rows = [("é" * 700,), ("x",), ("xy",), (None,), ("a" + "é" * 700,), ("",)]
    got = [r.l for r in spark.createDataFrame(rows, "t string").coalesce(1).select(detect(F.col("t")).alias("l")).collect()]
    assert got == ["1000", None, "2", None, "999", None]


def test_training_record_and_text_table(spark, tmp_path):
    record = rollup.training_record(spark, "small", "runs/a/checkpoints/epoch_1.pt", "data")
    write_json(f"{tmp_path}/info.json", record)
    assert json.loads((tmp_path / "info.json").read_text())["scale_config"]["train_num_samples"] == 12_800_000
    assert rollup.record_path("runs/a/checkpoints/epoch_1.pt") == "runs/a/info.json"
    with pytest.raises(ValueError):
        rollup.record_path("epoch_1.pt")
    with pytest.raises(ValueError):
        rollup.training_record(spark, "none", "a/b/c", "d")
    table = spark.createDataFrame([("b", 1.5), ("a", None)], "label string, score double")
    assert rollup.text_table(table) == "label  score\na\nb      1.5"
    with pytest.raises(ValueError):
        rollup.text_table(table, most=1)


def test_order_of_results(spark, tmp_path):
    line = lambda v: spark.createDataFrame([("k", "D", {"acc1": v})], "key string, dataset string, metrics map<string,double>")
    for v in (0.1, 0.9, 0.4):
        append_results(line(v), str(tmp_path / "r"))
    rows = md.read_results(spark, str(tmp_path / "r"))
    assert [r.metrics["acc1"] for r in rows.orderBy("line_no").collect()] == [0.1, 0.9, 0.4]
    assert rollup.last_wins(rows).first().metrics["acc1"] == 0.4
    with pytest.raises(ValueError):
        rollup.resumed(rows, {"lr": 1}, {"lr": 2})
    with pytest.raises(ValueError):
        rollup.check_submission({"method_name": "m", "author": ""})


def test_result_lines_are_numbered_by_several_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(md, "RESULT_BYTES", 4000)
    for run_no in range(3):
        append_results(spark.range(500, numPartitions=3).selectExpr("'k' AS key", "'D' AS dataset", f"map('acc1', cast({500 * run_no} + id AS double)) AS metrics"), str(tmp_path / "r"))
    rows = md.read_results(spark, str(tmp_path / "r"))
    assert sorted((r.line_no, r.metrics["acc1"]) for r in rows.collect()) == [(k, float(k)) for k in range(1500)]
    assert rows.select(F.spark_partition_id()).distinct().count() > 1 and "Window" not in rows._jdf.queryExecution().toString()
    (tmp_path / "none").mkdir()
    assert md.read_results(spark, str(tmp_path / "none")).count() == 0


def test_samples_of_files(spark):
    rows = spark.createDataFrame([(f, k) for f, n in (("a", 10), ("b", 3), ("c", 1)) for k in range(n)], "file_root string, row_index long")
    got = {r.file_root: r["count"] for r in draws.sample_per_file(rows, 0.5).groupBy("file_root").count().collect()}
    assert got == {"a": 5, "b": 1}
    assert draws.sample_per_file(rows, 0).count() == 14


def test_small_reports(spark):
    lines = spark.createDataFrame([(0, "race:white", True), (1, "race:black", True), (2, "age:young", True), (3, "race:a photo of a {} person", False), (4, "age:x: {}", False)], "place long, line string, class boolean")
    assert {r.objective: (r.classes, r.templates) for r in metrics.objectives(lines).collect()} == {"race": (["white", "black"], ["a photo of a {} person"]), "age": (["young"], ["x: {}"])}
    one = lambda x: spark.createDataFrame([(x,)], "recall_1 double")
    assert metrics.mean_recall(one(0.5), one(0.25)).first()[0] == 0.375
    from poolsieve.operators.filters import lexicon_of

    entities = spark.createDataFrame([("n0012",), (" n7 ",)], "line string")
    assert sorted(r.word for r in lexicon_of(entities, spark.createDataFrame([("dog", 12), ("cat", 8), ("owl", 7)], "word string, offset long")).collect()) == ["dog", "owl"]
    from poolsieve.operators.threshold import top_fraction_threshold

    for rows in ([i % 977 for i in range(3000)], [i % 2 for i in range(3000)], [5] * 3000):
        df = spark.createDataFrame([(float(x),) for x in rows], "s double")
        for fraction in (0.0, 0.1, 0.5, 0.99):
            assert top_fraction_threshold(df, "s", fraction) == sorted(map(float, rows), reverse=True)[int(3000 * fraction)]
