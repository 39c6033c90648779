import itertools
import re

import pytest
from pyspark.sql import functions as F

from poolsieve.llm.decontaminate import decontaminate
from poolsieve.llm.minhash import minhash_dedup
from poolsieve.llm.secrets import find_secrets
from poolsieve.llm.toxicity import toxicity

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = [(None, None, None, None, None), (None, "", "en", "s", 0), (9000, "token=abcdef0123456789", None, None, None), (9001, docs.first().text, "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    before = {r.doc_id: r.text for r in docs.collect()}
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    expect = [
        lambda d: {r.doc_id for r in toxicity(d, labels).where("predicted = 0").collect()},
        lambda d: {r.doc_id for r in minhash_dedup(d).where("kept").collect()},
        lambda d: {r.doc_id for r in decontaminate(d, items).where("NOT contaminated").collect()},
        lambda d: {r.doc_id for r in d.collect()},
    ]
    for (name, stage), want in zip(pipeline.STAGES[:-1], expect, strict=True):
        ids = want(docs)
        out = pipeline.cut(stage(spark, docs, SF))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert {r.doc_id for r in out.collect()} == ids, name
        docs = out
    texts = {r.doc_id: r for r in docs.collect()}
    assert texts[9000].text == "[SECRET]" and texts[9000].n_chars == 8
    assert docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").count() == 0
    assert find_secrets(docs).where(F.exists("spans", lambda s: s["kind"] != "network")).count() == 0
    assert all(before[i] is None or r.text == before[i] or "[SECRET]" in r.text for i, r in texts.items() if i is not None)
    last = pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == docs.count()


def test_clashing_names_repeated_ids_and_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    first = docs.orderBy("doc_id").first()
    words = " ".join(f"new{i}" for i in range(40))
    odd = [(first.doc_id, words, "en", "s", 1), (first.doc_id, words, "en", "s", 1), (first.doc_id, None, "en", "s", None), (None, words, "en", "s", 1), (None, words, "en", "s", 1)]
    more = docs.unionByName(spark.createDataFrame(odd, docs.schema)).selectExpr("*", "'x' AS predicted", "'y' AS contaminated", "'z' AS spans", "1 AS score", "2 AS kept", "'q' AS node", "3 AS n_words")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, more, SF)
        assert out.columns == more.columns and out.dtypes == more.dtypes, name
        assert out.where("predicted = 'x' AND contaminated = 'y' AND spans = 'z' AND score = 1 AND kept = 2 AND node = 'q' AND n_words = 3").count() == out.count() > 0, name
        if name == "near_duplicates":
            same = [r.text for r in out.where(F.col("doc_id") == first.doc_id).collect()]
            assert sorted(same, key=str) == sorted([first.text, words, None], key=str)
            assert out.where("doc_id IS NULL").count() == 2
        assert stage(spark, more.limit(0), SF).collect() == [], name
    assert pipeline.STAGES[-1][1](spark, more, SF).count() == more.count()
    assert pipeline.STAGES[-1][1](spark, more.limit(0), SF).collect() == []


def test_stages_against_brute_force(spark):
    """What contamination and near-duplicate stages keep, by sets and windows of words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    lower = str.maketrans({c: c + 32 for c in range(65, 91)})
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    sets = {}
    for i, t in rows.items():
        w = re.findall("[^\x20\x09-\x0d]+", t.translate(lower))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    group = {i: i for i in rows}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(rows)
    for i, j in itertools.combinations(ids, 2):
        a, b = sets[i], sets[j]
        if a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            x, y = sorted((root(i), root(j)))
            group[y] = x
    assert {r.doc_id for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()} == {i for i in ids if root(i) == i}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = word.findall((r.text or "").translate(lower))
        for k in range(len(w) - min(13, len(w)) + 1 if w else 0):
            windows.setdefault(min(13, len(w)), set()).add(tuple(w[k : k + 13]))
    clean = set()
    for i, t in rows.items():
        w = word.findall(t.translate(lower))
        hit = {k + d for n, found in windows.items() for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in found for d in range(n)}
        if not hit or 20 * len(hit) < len(w):
            clean.add(i)
    assert {r.doc_id for r in pipeline.drop_contaminated(spark, docs, SF).collect()} == clean


def test_repeated_ids_that_are_no_numbers(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in ("one", "two"))
    rows = [("doc-b", a), ("doc-b", a), ("doc-b", b), ("doc-a", a + " end"), ("doc-c", "z " * 200_000), ("doc-d", "z " * 200_000), (None, a), ("doc-c", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "'en' AS lang", "'s' AS source", "1 AS n_chars")
    out = sorted(((r.doc_id, r.text) for r in pipeline.drop_near_duplicates(spark, docs, SF).collect()), key=str)
    assert out == sorted([("doc-a", a + " end"), ("doc-b", b), ("doc-c", "z " * 200_000), (None, a), ("doc-c", None)], key=str)
