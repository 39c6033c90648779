import hashlib
import random
import re

import pytest

from poolsieve.llm.decontaminate import decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(13, len(v))
            for j in range(len(v) - n + 1) if n else ():
                for i in range(len(w) - n + 1):
                    if w[i : i + n] == v[j : j + n]:
                        hit.update(range(i, i + n))
                        found.add("" if item is None else str(item))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def cases():
    rng = random.Random(5)
    vocab = ["a", "b", "Été", "dd", "e1", "ff", "GG", "日本"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([20, 13, 30, 14, 4, 12, 1, 7])]
    items[6] = (6, "rare!")
    items += [(8, None), (9, ""), (10, "..."), (None, "null item words here"), (3, items[3][1]), (11, "x " * 20)]
    docs = [(None, "a b"), (1, None), (2, ""), (3, "no match at all"), (3, "no match at all"), (4, "x " * 40), (5, "RARE"), (6, "null item-words here")]
    for i in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            t = rng.choice(items)[1] or ""
            w = t.split()
            a = rng.randrange(len(w) + 1)
            parts += [", ".join(w[a : a + rng.randrange(25)]), "  ".join(rng.choice(vocab) for _ in range(rng.randrange(9)))]
        docs.append((100 + i, "\n".join(parts)))
    docs.append((200, " ".join(rng.choice(vocab) for _ in range(300_000))))
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, limit):
    docs, items = cases()
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item", "2 AS n_words")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "3 AS doc_id")
    got = sorted((tuple(r) for r in decontaminate(d, b, max_broadcast_bytes=limit).collect()), key=str)
    small = [x for x in docs if x[0] != 200]
    assert [r for r in got if r[0] != 200] == sorted(brute(small, items), key=str)
    assert len([r for r in got if r[0] == 200]) == 1


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_empty_tables(spark, limit):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(none, items, max_broadcast_bytes=limit).collect() == []
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in decontaminate(one, items, max_broadcast_bytes=limit - 1).collect()] == [(1, 2, 0, 0)]
