import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from poolsieve.functions.text import article_prompt, duration, entity_offset, json_with, objective, or_default, template, token_count, word_count
from poolsieve.functions.uid import copy_key, high, low, uid_bin, uid_hex
from poolsieve.functions.vector import argmax, is_in, jaccard, mask_from, top_k
from poolsieve.operators.centroids import centroid_groups, nearest_centroid, train_centroids
from poolsieve.operators.filters import FILTERS, FilterParams, check_params, select_uids
from poolsieve.operators.metrics import nearest_candidates
from poolsieve.operators.threshold import top_fraction_threshold
from poolsieve.plans.queries import QUERIES

POOL = "uid string, text string, lang string, original_width long, original_height long, clip_b32_similarity_score float, clip_l14_similarity_score double"


def pool(spark, rows):
    return spark.createDataFrame(rows, POOL)


def row(uid="a", text="three small words", lang="en", w=200, h=600, b32=0.5, l14=0.5):
    return (uid, text, lang, w, h, b32, l14)


def kept(df):
    return sorted(r[0] for r in df.collect())


def test_basic_filter_bounds(spark):
    rows = [
        row("ok"), row("two", "two words"), row("short", "a b c"), row("nbsp", "one\xa0two\x1cthree"), row("zero", "one\u200btwo three"), row("null", None), row("lang", lang="fr"), row("nolang", lang=None),
        row("small", w=199), row("wide", h=601), row("flat", w=0, h=0), row("nowidth", w=None),
    ]
    assert kept(select_uids("basic_filter", pool(spark, rows))) == ["nbsp", "ok"]


def test_scores_are_inclusive_and_nan_is_out(spark):
    rows = [row("at", b32=0.7), row("over", b32=0.71), row("under", b32=0.69), row("nan", b32=float("nan")), row("null", b32=None)]
    assert kept(select_uids("clip_score", pool(spark, rows), FilterParams(threshold=0.7, arch="b32"))) == ["at", "over"]


def test_fraction_threshold(spark):
    rng = np.random.default_rng(0)
    scores = np.round(rng.random(3000), 3).tolist() + [float("nan")] * 30 + [None] * 20
    df = spark.createDataFrame([(s,) for s in scores], "s double")
    ordered = sorted((s for s in scores if s is not None and not math.isnan(s)), reverse=True)
    for f in (0.0, 0.1, 0.3333, 0.5, 0.9, 0.98):
        n = int(len(scores) * f)
        assert top_fraction_threshold(df, "s", f) == ordered[n]
    assert top_fraction_threshold(df, "s", 0.99) is None
    assert top_fraction_threshold(df.limit(0), "s", 0.1) is None
    for f in (1.0, -0.1):
        with pytest.raises(ValueError):
            top_fraction_threshold(df, "s", f)


def test_fraction_keeps_one_more_and_ties(spark):
    rows = [row(str(i), l14=i / 10) for i in range(10)]
    assert len(kept(select_uids("clip_score", pool(spark, rows), FilterParams(fraction=0.3, arch="l14")))) == 4
    assert kept(select_uids("clip_score", pool(spark, [row(l14=float("nan"))] * 3), FilterParams(fraction=0.3, arch="l14"))) == []


BAD = [
    ("nothing", {}), ("clip_score", {}), ("clip_score", {"threshold": 0.1}), ("clip_score", {"threshold": 0.1, "fraction": 0.1, "arch": "b32"}), ("clip_score", {"fraction": 1.0, "arch": "b32"}),
    ("clip_score", {"threshold": 0.1, "arch": "b16"}), ("basic_filter", {"fraction": 0.1}), ("basic_filter", {"threshold": 0.1}), ("basic_filter", {"arch": "b32"}), ("basic_filter", {"scale": "small"}),
    ("laion2b", {"threshold": 0.3}), ("image_based", {}), ("image_based", {"scale": "tiny"}), ("image_based", {"scale": "small"}), ("image_based_intersect_clip_score", {"scale": "small"}), ("text_based", {}),
]


@pytest.mark.parametrize(("name", "params"), BAD)
def test_parameters_are_checked(name, params):
    with pytest.raises(ValueError):
        check_params(name, FilterParams(**params))


def test_all_filters_are_registered():
    assert set(FILTERS) == {"no_filter", "basic_filter", "clip_score", "laion2b", "text_based", "image_based", "image_based_intersect_clip_score"}


def test_uids(spark):
    uids = ["139e4a9b22a614771f06c700a8ebe150", "6e356964a967af455c8016b75d691203", "f" * 32, "8" + "0" * 31, "0" * 32, "zz", "abc", None, "F" * 32]
    df = spark.createDataFrame([(u,) for u in uids], "uid string").select("uid", uid_bin(F.col("uid")).alias("b"))
    good = df.where("b IS NOT NULL").select("b", uid_hex(F.col("b")).alias("h"))
    rows = good.select("h", high(F.col("h")).alias("hi"), low(F.col("h")).alias("lo")).collect()
    assert {(r.h, int(r.hi), int(r.lo)) for r in rows} == {(u.lower(), int(u[:16], 16), int(u[16:], 16)) for u in uids if u and len(u) == 32}
    assert [r.h for r in good.orderBy("b").collect()] == sorted(u.lower() for u in uids if u and len(u) == 32)
    assert df.select(copy_key(F.lit("u"), F.lit(3)).alias("k")).first().k == "u-3"


def test_scalars(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first().x
    assert get(word_count(F.lit("a\x85b c\u2003d\x1fe"))) == 5
    assert get(token_count(F.lit("a b\n\nc"))) == 5
    assert get(article_prompt(F.lit("Apple"))) == "An apple" and get(article_prompt(F.lit("Pear"))) == "A pear"
    assert get(objective(F.lit("race:a photo: x"))) == "race" and get(template(F.lit("race:a photo: x"))) == "a photo: x"
    assert get(entity_offset(F.lit(" n00012345\n"))) == 12345
    assert get(duration(F.lit(3725))) == "1h 2m 5s"
    assert get(or_default(F.lit(""), F.lit("d"))) == "d" and get(or_default(F.lit("v"), F.lit("d"))) == "v"
    assert get(json_with(F.lit('{"uid": "u", "n": 1}'), boxes=F.lit("[]"), uid=F.lit("w"))) == '{"n":1,"boxes":"[]","uid":"w"}'
    document = F.lit('{"a": 1.5, "b": true, "c": {"d": [1, null]}, "e": null, "faces": 0}')
    assert get(json_with(document, faces=F.array(F.array(F.lit(1.0), F.lit(2.5))))) == '{"a":1.5,"b":true,"c":{"d":[1,null]},"e":null,"faces":[[1,2.5]]}'
    assert get(json_with(F.lit("{}"), faces=F.lit(3))) == '{"faces":3}'
    scores = F.array(*[F.lit(x) for x in (0.1, 0.9, 0.9, 0.3)])
    assert get(argmax(scores)) == 1 and get(top_k(scores, 3)) == [1, 2, 3]
    assert get(mask_from(scores, F.lit(2))) == [0.1, 0.9, -1e9, -1e9]
    assert get(is_in(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == [False, True]
    assert get(jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2)))) == 0.5 and get(jaccard(F.array().cast("array<int>"), F.array().cast("array<int>"))) is None


def test_nearest_centroid_in_blocks(spark):
    rng = np.random.default_rng(1)
    x, c = rng.standard_normal((50, 8)), rng.standard_normal((11, 8))
    c[7] = c[3]
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)], "id long, embedding array<double>").repartition(3)
    centroids = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "centroid_id long, c array<double>")
    want = {i: int((x[i] @ c.T).argmax()) for i in range(50)} | {99: None}
    for size in (1 << 20, 3 * 64):
        assert {r.id: r.centroid_id for r in nearest_centroid(vectors, centroids, max_bytes=size).collect()} == want
    assert {r.centroid_id for r in nearest_centroid(vectors, centroids.limit(0)).collect()} == {None}


def test_retrieval_ranks_all_candidates(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 8)).astype(np.float32)
    x[1::2] = x[::2] + rng.standard_normal((350, 8)) * 0.5
    x[601] = x[301] = x[41]
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r["query"]: r for r in QUERIES["retrieval_recall"](spark, str(tmp_path)).collect()}
    x = x.astype(np.float64)
    for query, a, b in (("image", x[::2], x[1::2]), ("caption", x[1::2], x[::2])):
        ranks = [[int(c) for c in np.lexsort((np.arange(350), -(a[i] * b).cumsum(axis=1)[:, -1]))].index(i) for i in range(350)]
        for k in (1, 5, 10):
            assert abs(got[query][f"recall_{k}"] - np.mean(np.array(ranks) < k)) < 1e-9
    side = lambda lo, name: spark.createDataFrame([(i, None if i == 4 else x[i].tolist()) for i in range(lo, 60, 2)], f"{name} long, v array<double>")
    told = [sorted(nearest_candidates(side(0, "q"), side(1, "c"), "q", "c", k=3, block=n).select("q", "c").collect()) for n in (7, 1000)]
    assert told[0] == told[1] and len(told[0]) == 90 and [r.c for r in told[0] if r.q == 4] == [1, 3, 5]


def test_retrieval_ties_and_odd_values(spark):
    # equal inner products, components that are not finite, and more candidates than are asked for
    rows = [(0, [1.0, 1e16, 1.0]), (1, [1.0, 0.0, 0.0]), (2, None), (3, [float("inf"), 0.0, 0.0])]
    found = [(10, [1.0, 1.0, -1.0]), (11, [0.0, 1.0, 0.0]), (12, [1.0, 0.0, 0.0]), (13, None), (14, [1.0, 0.0, 0.0]), (15, [float("nan"), 0.0, 0.0])]
    q, c = spark.createDataFrame(rows, "q long, v array<double>"), spark.createDataFrame(found, "c long, v array<double>")
    for k in (2, 4, 9):
        want = set()
        for i, v in rows:
            scored = []
            for j, w in found:
                s = None if v is None or w is None else sum(x * y for x, y in zip(v, w, strict=True))
                scored.append((s is None or s != s, -(s or 0.0), j))
            want |= {(i, x[2]) for x in sorted([(bad, 0.0 if bad else s, j) for bad, s, j in scored])[:k]}
        for block in (2, 1000):
            got = nearest_candidates(q, c, "q", "c", k=k, block=block).collect()
            assert {(r.q, r.c) for r in got} == want and len(got) == len(want)


def test_centroid_groups(spark):
    assigned = spark.createDataFrame([(3, 1), (1, 1), (2, None), (2, 0)], "uid long, centroid_id long")
    assert [tuple(r) for r in centroid_groups(assigned).collect()] == [(None, 1, 2), (0, 1, 2), (1, 2, 1), (1, 2, 3)]


def test_kmeans_separates_clusters(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (np.eye(4)[i % 4] * 9 + rng.standard_normal(4) * 0.1).tolist()) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    made = train_centroids(df, 4, seed=3)
    assert made.count() == 4
    groups = {}
    for r in nearest_centroid(df, made).collect():
        groups.setdefault(r.centroid_id, set()).add(r.id % 4)
    assert all(len(g) == 1 for g in groups.values())
