"""Box tables by point lookup."""

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from poolsieve.sources import boxes as bx


def table(spark, n, name):
    rows = spark.range(n).select(F.lit(name).alias("parquet"), F.format_string("%032x", F.col("id") * 7).alias("uid"), F.array(F.array(F.col("id").cast("double"), F.lit(1.0))).alias("face_bboxes"))
    return rows.repartition(3)


def test_only_groups_with_wanted_ids_are_read(spark, tmp_path, monkeypatch):
    both = table(spark, 1000, "a").unionByName(table(spark, 300, "b"))
    told = {r.parquet: r.path for r in bx.write_boxes(both, str(tmp_path), 50).collect()}
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith("_")) == ["a.parquet", "b.parquet"]
    assert pq.ParquetFile(told["a"]).num_row_groups == 20
    ask = [(told["a"], f"{7 * k:032x}") for k in (0, 3, 49, 50, 999)] + [(told["b"], f"{7 * 299:032x}"), (told["b"], f"{5:032x}"), (told["a"], "f" * 32), (None, "0" * 32), (told["a"], None), (told["a"], f"{21:032x}")]
    got = {(r.path, r.uid): r.face_bboxes for r in bx.lookup_boxes(spark.createDataFrame(ask, "path string, uid string")).collect()}
    assert got == {(told["a"], f"{7 * k:032x}"): [[float(k), 1.0]] for k in (0, 3, 49, 50, 999)} | {(told["b"], f"{7 * 299:032x}"): [[299.0, 1.0]]}
    # bytes: three of the twenty groups hold the ids, and one is read whose bounds hold an id that is not there
    read = []
    whole = pq.ParquetFile.read_row_group

    def counting(self, i, *args, columns=None, **more):
        read.append((i, columns[0], self.metadata.row_group(i).total_byte_size))
        return whole(self, i, *args, columns=columns, **more)

    monkeypatch.setattr(pq.ParquetFile, "read_row_group", counting)
    ids = sorted(f"{x:032x}" for x in (0, 21, 7 * 50, 7 * 999, 7 * 500 + 1))
    out = list(bx._lookup([pa.RecordBatch.from_pydict({"path": [told["a"]] * 5, "uid": ids})]))
    assert sum(b.num_rows for b in out) == 4
    assert [(i, c) for i, c, _ in read] == [(0, "uid"), (0, "face_bboxes"), (1, "uid"), (1, "face_bboxes"), (10, "uid"), (19, "uid"), (19, "face_bboxes")]


def test_ids_without_leading_zeros(spark, tmp_path):
    pq.write_table(pa.table({"uid": ["abc", "0", "f" * 32, None], "face_bboxes": [[[1.0]], [[2.0]], None, [[3.0]]]}), tmp_path / "t.parquet")
    path = str(tmp_path / "t.parquet")
    ask = spark.createDataFrame([(path, "abc".rjust(32, "0")), (path, "0" * 32), (path, "f" * 32), (path, "e" * 32)], "path string, uid string")
    assert {r.uid: r.face_bboxes for r in bx.lookup_boxes(ask).collect()} == {"abc".rjust(32, "0"): [[1.0]], "0" * 32: [[2.0]], "f" * 32: None}
    assert bx.lookup_boxes(ask.where("false")).collect() == []
