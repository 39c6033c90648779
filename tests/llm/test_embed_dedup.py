import numpy as np

from poolsieve.llm.embed_dedup import embedding_dedup, plan, rotations


def brute(rows, threshold=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links = {k: set() for k in range(len(good))}
    for k, (_, a) in enumerate(good):
        for m, (_, b) in enumerate(good[:k]):
            if len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                links[k].add(m)
                links[m].add(k)
    return good, links


def cases():
    rng = np.random.default_rng(0)
    rows, nxt = [], 0
    for size in (1, 2, 3, 10, 40, 150):
        base = rng.standard_normal(64)
        for _ in range(size):
            rows.append((nxt, (base + rng.standard_normal(64) * 0.2).astype(np.float32).tolist()))
            nxt += 1
    rows += [(nxt + k, rng.standard_normal(64).astype(np.float32).tolist()) for k in range(300)]
    nxt += 300
    rows += [(nxt + k, rows[5][1]) for k in range(60)]
    rows += [(5000, None), (5001, []), (5002, [0.0] * 64), (5003, [1.0, None] * 32), (5004, [float("nan")] * 64), (5005, [float("inf")] * 64), (5006, [1.0, 0.0]), (5007, [2.0, 0.1]), (None, rows[0][1]), (5008, [1e-30] * 64), (5009, [3e30] * 64)]
    return rows


def test_against_brute_force(spark):
    rows = cases()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS weight", "2 AS keys").repartition(3)
    good, links = brute(rows)
    for block in (1024, 32):
        got = embedding_dedup(df, block=block).collect()
        assert len(got) == len(rows)
        by = {r.vec_id: r for r in got}
        want = {good[k][0]: len(v) for k, v in links.items()}
        assert all(by[i].n_links <= n for i, n in want.items())
        assert sum(by[i].n_links for i in want) >= 0.97 * sum(want.values())
        assert all(r.n_links == 0 and r.kept for i, r in by.items() if i not in want)
        assert by[5006].component_id == by[5007].component_id == 5006 and by[5009].component_id == 5008
        for r in got:
            assert r.kept == (r.vec_id == r.component_id)
    assert embedding_dedup(df.limit(0)).collect() == []


def test_repeated_ids(spark):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 64)).tolist()
    got = embedding_dedup(spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (3, a)], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1)]


def test_estimate_is_unbiased():
    rng = np.random.default_rng(2)
    o, q = rng.standard_normal((2, 64))
    o, q = o / np.linalg.norm(o), 0.6 * o / np.linalg.norm(o) + 0.2 * q
    got = []
    for turn in rotations(64, 400):
        code = np.sign(turn @ o) / 8
        got.append(code @ (turn @ q) / (code @ (turn @ o)))
    assert abs(np.mean(got) - o @ q) < 0.01


def test_plan_grows_slowly():
    assert plan(1000)[0] < plan(10**6)[0] and plan(10**9)[1] < 500
