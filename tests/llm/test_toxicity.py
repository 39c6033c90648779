import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from poolsieve.llm.kernels import ALNUM, LOWER, word_slices
from poolsieve.llm.toxicity import ORDER, fit, toxicity, training_rows

SF = "/root/testdata/sf0.01"


def auc(y, s):
    order = np.argsort(np.argsort(s, kind="stable")) + 1
    y = np.array(y)
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def cases(spark):
    rng = random.Random(0)
    vocab = [f"w{i}" for i in range(2000)]
    docs, labels = [], []
    for i in range(900):
        n, bad = rng.randrange(5, 200), rng.random() < 0.2
        w = [rng.choice(vocab) for _ in range(n)]
        if bad:
            for _ in range(max(1, n // 25)):
                w[rng.randrange(n)] = rng.choice(["nasty", "Vile", "awful"])
        docs.append((i, " ".join(w)))
        if i % 2 == 0:
            labels.append((i, int(bad)))
        if i < 60:
            labels.append((i, None))
    docs += [(None, "nasty vile"), (5000, None), (5001, ""), (5002, "w1 " * 60_000), (3, docs[3][1])]
    truth = {i: any(x in t.lower().split() for x in ("nasty", "vile", "awful")) for i, t in docs if i is not None and t}
    return docs, labels, truth, spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS score", "0 AS toxic").repartition(3), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels, truth, d, lab = cases(spark)
    got = toxicity(d, lab).collect()
    assert len(got) == len(docs)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert auc([truth[r.doc_id] for r in held], [r.score for r in held]) > 0.97
    joined = toxicity(d, lab, max_labels=0).collect()
    assert sorted((str(r.doc_id), round(r.score, 9)) for r in joined) == sorted((str(r.doc_id), round(r.score, 9)) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark):
    docs, labels, truth, d, lab = cases(spark)
    other = spark.createDataFrame([(i, 1 - y if y is not None and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels], "doc_id long, toxic int")
    a, b = ({(str(r.doc_id), round(r.score, 9)) for r in toxicity(d, x).collect()} for x in (lab, other))
    assert a == b


def test_empty(spark):
    docs, labels, truth, d, lab = cases(spark)
    assert toxicity(d.limit(0), lab).collect() == []
    assert {r.score for r in toxicity(d, lab.limit(0)).collect()} == {toxicity(d, lab.limit(0)).first().score}


def test_join_beyond_the_broadcast_scores_alike(spark):
    docs, labels, truth, d, lab = cases(spark)
    told = lambda df: sorted((str(r.doc_id), r.held_out, round(r.score, 9), r.predicted) for r in df.collect())
    whole = told(toxicity(d, lab))
    assert told(toxicity(d, lab, max_bytes=0)) == whole


def brute(texts):
    """The two models by dictionaries: log ratio of a word."""
    spell = lambda w: [("\x02" * (ORDER - 1) + w + "\x03")[k : k + ORDER] for k in range(len(w) + 1)]
    top = [Counter(), Counter()]
    for t, y in texts:
        for w in t.split():
            top[y].update(spell(w))
    lower, longer = {}, top[0].keys() | top[1].keys()
    for n in range(ORDER - 1, 0, -1):
        longer = lower[n] = Counter(g[1:] for g in longer)

    def discount(c):
        n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75

    def backed(c, g, less):
        of = [v for x, v in c.items() if x[:-1] == g[:-1] and v]
        return less if not of else max(c[g] - discount(c), 0) / sum(of) + discount(c) * len(of) / sum(of) * less

    def q(g):
        return backed(lower[len(g)], g, q(g[1:])) if g else 1 / (len(lower[1]) + 1)

    return lambda w: sum(math.log(backed(top[1], g, q(g[1:])) / backed(top[0], g, q(g[1:]))) for g in spell(w))


def test_ratios_against_dictionaries(spark):
    """All counts matter, however rare."""
    texts = [("plain talk of rare birds", 0), ("plain words of few birds", 0), ("plain ones", 0), ("plain vile talk", 1), ("mean vile birds", 1), ("vile", 1), ("a1 \u00e9t\u00e9 \u65e5\u672c", 1)]
    rows = spark.createDataFrame([(t, y, False) for t, y in texts], "text string, toxic int, cal boolean")
    model = fit(rows)
    ratio = brute([(t.encode().decode("latin-1"), y) for t, y in texts])
    for t in [t for t, _ in texts] + ["rare vile ones unheard plain few", "birds mean talk " + "x" * 300, "\u00e9t\u00e9 vi viles \u65e5"]:
        (_, _, words), = word_slices(pa.array([t]), ALNUM, LOWER)
        assert np.allclose(model.shared.value.of(words), [ratio(w.encode().decode("latin-1")) for w in t.split()], atol=1e-5)
    once = next(iter(word_slices(pa.array(["mean"]), ALNUM, LOWER)))[2]
    assert model.shared.value.of(once)[0] > 0


def test_kept_columns_with_the_names_of_results(spark):
    docs, labels, truth, d, lab = cases(spark)
    got = toxicity(d.selectExpr("*", "'x' AS predicted", "1 AS k1", "2 AS __x"), lab, keep=["doc_id", "predicted", "k1", "score"])
    assert got.columns == ["doc_id", "k1", "held_out", "score", "predicted"]
    assert got.where("predicted IN (0, 1) AND k1 = 1").count() == len(docs)


def test_only_a_bounded_sample_is_not_counted(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('w', id) AS text")
    labels = spark.range(3000).selectExpr("id AS doc_id", "int(id % 2) AS toxic")
    n = {c: r for c, r in training_rows(docs, labels, calibration=50).groupBy("cal").count().collect()}
    assert n[True] + n[False] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(3000))
    assert 20 < n[True] < 90
