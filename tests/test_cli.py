import json

import numpy as np
import pytest

from poolsieve import cli
from poolsieve.operators.rollup import DATASET_GROUPS


def test_select(spark, tmp_path, capsys):
    rows = [(f"{i:032x}", i / 10) for i in range(10)]
    spark.createDataFrame(rows, "uid string, clip_l14_similarity_score double").write.parquet(str(tmp_path / "pool"))
    assert cli.main(["select", "--name", "clip_score", "--arch", "l14", "--threshold", "0.7", "--metadata-dir", str(tmp_path / "pool"), "--save-path", str(tmp_path / "s.npy")]) == 0
    assert "3 ids" in capsys.readouterr().out and np.load(tmp_path / "s.npy")["f1"].tolist() == [7, 8, 9]
    with pytest.raises(ValueError):
        cli.main(["select", "--name", "laion2b", "--threshold", "0.7", "--metadata-dir", str(tmp_path / "pool"), "--save-path", "x"])


def test_scores(spark, tmp_path, capsys):
    names = sorted({d for ds in DATASET_GROUPS.values() for d in ds} | {"ImageNet 1k"})
    lines = [json.dumps({"key": n, "dataset": n, "metrics": {"main_metric": 0.5}}) for n in names]
    (tmp_path / "r.jsonl").write_text("\n".join([*lines, json.dumps({"key": "x", "dataset": "none", "metrics": {"acc1": 1.0}})]))
    assert cli.main(["scores", "--results", str(tmp_path / "r.jsonl"), "--expected", str(len(names))]) == 0
    assert capsys.readouterr().out.splitlines() == ["Average: 0.5", "ImageNet: 0.5", "ImageNet dist. shifts: 0.5", "Retrieval: 0.5", "VTAB: 0.5"]
    with pytest.raises(ValueError):
        cli.main(["scores", "--results", str(tmp_path / "r.jsonl")])
