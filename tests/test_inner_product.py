"""The exact search for the largest inner products: equal rows, fewer pairs where vectors gather in groups."""

import numpy as np
import pytest

from poolsieve.operators.inner_product import searched


def side(spark, name, x, null=()):
    return spark.createDataFrame([(i, None if i in null else v.tolist()) for i, v in enumerate(x)], f"{name} long, v array<double>").repartition(3)


def brute(q, c, k):
    out = set()
    for i, v in enumerate(q):
        score = (v * c).cumsum(axis=1)[:, -1]
        out |= {(i, int(j)) for j in np.lexsort((np.arange(len(c)), -score))[:k]}
    return out


def made(kind, n, dim=6):
    rng = np.random.default_rng(1)
    if kind == "groups":
        middle = rng.normal(size=(20, dim)) * 8
        return [middle[rng.integers(0, 20, n)] + rng.normal(size=(n, dim)) * 0.3 for _ in range(2)]
    if kind == "copies":  # a third are one vector, and there are many ties
        x = [rng.integers(-2, 3, (n, dim)).astype(float) for _ in range(2)]
        for a in x:
            a[:: 3] = x[0][1]
        return x
    return [rng.normal(size=(n, dim)) for _ in range(2)]


@pytest.mark.parametrize(("kind", "block", "cell"), [("groups", 100, 20), ("copies", 60, 15), ("random", 4000, 100)])
def test_like_brute_force(spark, kind, block, cell):
    q, c = made(kind, 600)
    found, _ = searched(side(spark, "q", q), side(spark, "c", c), "q", "c", 5, block, cell)
    got = found.collect()
    assert len(got) == 3000 and {(r.q, r.c) for r in got} == brute(q, c, 5)


def test_fewer_pairs_where_vectors_gather(spark):
    share = []
    for n in (400, 1600):
        q, c = made("groups", n)
        found, pairs = searched(side(spark, "q", q), side(spark, "c", c), "q", "c", 5, 64, 16)
        assert {(r.q, r.c) for r in found.collect()} == brute(q, c, 5)
        share.append(pairs.first().pairs / n**2)
    assert share[1] < share[0] < 0.7


def test_empty_sides(spark):
    some, none = made("random", 4)[0], np.zeros((0, 6))
    assert searched(side(spark, "q", none), side(spark, "c", some), "q", "c")[0].collect() == []
    assert searched(side(spark, "q", some), side(spark, "c", none), "q", "c")[0].collect() == []
    got = searched(side(spark, "q", some, {0, 1, 2, 3}), side(spark, "c", some, {0, 1, 2, 3}), "q", "c", 2)[0].collect()
    assert sorted((r.q, r.c, r.score) for r in got) == [(i, j, None) for i in range(4) for j in range(2)]
