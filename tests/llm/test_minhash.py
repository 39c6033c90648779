import random
import re

from poolsieve.llm.components import components
from poolsieve.llm.minhash import minhash_dedup

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, size):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(max(len(w) - size + 1, 1))} if w else set()


def closure(nodes, links):
    comp = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(comp[a], comp[b])
            if comp[a] != m or comp[b] != m:
                comp[a] = comp[b] = m
                changed = True
    return comp


def brute(docs, size, percent):
    sets = [(i, shingles(t, size)) for i, t in docs]
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[:k] if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b)]
    comp = closure({i for i, _ in docs if i is not None}, links)
    return sorted(((i, len(s), comp.get(i), i is None or comp[i] == i) for i, s in sets), key=str)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)] + [(200, i) for i in range(201, 400)] + [(7, 7), (None, 3)]
    want = closure({x for e in edges if None not in e for x in e} | {3}, [e for e in edges if None not in e])
    got = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(tuple(r) for r in got.collect()) == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_against_brute_force(spark):
    rng = random.Random(2)
    vocab = [f"w{i}" for i in range(300)]
    docs = [(None, "a b c d"), (None, None), (1, None), (2, ""), (3, " \n "), (4, "one"), (5, "One"), (6, "one two"), (7, "one two\tthree")]
    nxt = 10
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(40, 200))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(9))
            docs.append((nxt, " ".join(w).title() if rng.random() < 0.3 else "\n".join(w)))
            nxt += rng.choice([1, 2, 7])
    chain = [rng.choice(vocab) for _ in range(150)]
    for i in range(40):  # each like the next, the ends unlike
        docs.append((1000 - i, " ".join(chain)))
        chain = chain[4:] + [rng.choice(vocab) for _ in range(4)]
    docs += [(2000 + i, docs[20][1]) for i in range(50)] + [docs[15], docs[15]]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS node").repartition(3)
    got = sorted((tuple(r) for r in minhash_dedup(df, shingle=3, percent=85).collect()), key=str)
    assert got == brute(docs, 3, 85)
    assert minhash_dedup(df.limit(0)).collect() == []


def test_loose_bucket(spark):
    """Pairs that share buckets but not the first leader's component are still compared."""
    rng = random.Random(4)
    common = [f"c{i}" for i in range(300)]
    docs = []
    for i in range(12):
        tail = [f"t{i}_{k}" for k in range(45)]
        docs += [(2 * i, " ".join(common + tail)), (100 - i, " ".join(common + tail[:-2] + ["x"]))]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((tuple(r) for r in minhash_dedup(df, shingle=3, percent=85).collect()), key=str)
    assert got == brute(docs, 3, 85)


def test_repeated_ids(spark):
    docs = [(1, "a b c d e f"), (1, "q r s t u v w"), (2, "a b c d e f"), (3, "q r s t u v w"), (4, "a b c d e f"), (5, "q r s t u v w")]
    got = minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 6
    comp = {r.doc_id: r.component_id for r in got}
    assert comp[1] == 1 and sorted({comp[2], comp[3]}) in ([1, 2], [1, 3])


def test_blocks(spark):
    """Large loose groups, split in blocks."""
    rng = random.Random(6)
    base = [f"c{i}" for i in range(120)]
    docs = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(12)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(500)}"
        docs.append((i * 7 % 150, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (2048, 16):
        got = sorted((tuple(r) for r in minhash_dedup(df, shingle=3, percent=85, block=block).collect()), key=str)
        assert got == brute(docs, 3, 85)


def test_patterns_that_cancel_out(spark):
    turn = str.maketrans("ab", "ba")
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    long = " ".join(word)
    docs = [(1, word), (2, word.translate(turn)), (3, long), (4, long.translate(turn)), (5, long + " c"), (6, "x " + word), (7, "x " + word.translate(turn))]
    got = minhash_dedup(spark.createDataFrame(docs, "doc_id long, text string"), shingle=3, percent=85)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, 3, 85)
