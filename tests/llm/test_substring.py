import hashlib
import random
import re

from poolsieve.llm.substring import COVER, PERIOD, dedup_substrings

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(docs):
    least, words = {}, []
    for doc_id, text in docs:
        w = WORD.findall(text or "")
        words.append(w)
        if doc_id is not None:
            for i in range(len(w) - 49):
                k = tuple(w[i : i + 50])
                least[k] = min(least.get(k, doc_id), doc_id)
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - 49):
            if doc_id is not None and least[tuple(w[i : i + 50])] < doc_id:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def test_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["é", "日", "x\xa0y", "A", "a"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 80, 200)]
    docs = [(None, shared[4]), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "x " * 300), (5, "x " * 49), (6, "x " * 50)]
    for i in range(80):
        parts = [text(rng.randrange(70)) for _ in range(2)]
        parts.insert(1, rng.choice(shared))
        if rng.random() < 0.3:
            w = rng.choice(shared[2:]).split()
            w[rng.randrange(len(w))] = "odd"
            parts.append(" ".join(w))
        docs.append((rng.randrange(10, 60), rng.choice([" ", "\n", "  "]).join(parts)))
    docs += [(70 + i, docs[20][1]) for i in range(9)] + [docs[30], docs[30], (90, shared[0]), (91, shared[0])]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS d1", "2 AS n_words").repartition(3)
    got = dedup_substrings(df)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == sorted(brute(docs), key=str)
    assert got.where("n_removed <> coalesce(aggregate(removed, 0L, (a, x) -> a + x.words), 0)").count() == 0
    assert dedup_substrings(df.limit(0)).collect() == []


def test_patterns_that_cancel_out(spark):
    turn = str.maketrans("ab", "ba")
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    head = [f"w{i}" for i in range(49)]
    many = [f"{x}{k}" for k in range(40) for x in "xy"]
    long = ["ab"[bin(i).count("1") % 2] for i in range(4096)]
    docs = [(1, " ".join([*head, word])), (2, " ".join([*head, word.translate(turn)])), (3, " ".join(many)), (4, " ".join(long)), (5, " ".join(long).translate(turn)), (6, "same " * 3000), (7, "same " * 60)]
    got = dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(brute(docs))


def test_hot_windows_are_dealt(spark):
    rng = random.Random(4)
    line = " ".join(f"l{i}" for i in range(55))
    docs = [(i, " ".join([f"a{rng.randrange(10**6)}" for _ in range(6)] + [line] + [f"b{rng.randrange(10**6)}" for _ in range(5)])) for i in range(1200)]
    got = dedup_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(7))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(brute(docs))
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).collect() == []
