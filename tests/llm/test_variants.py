"""Spelling variants against a brute-force version, and keys that collide."""

import random
import re
import zlib
from collections import Counter

import pytest

from poolsieve.llm import variants
from poolsieve.llm.variants import near_words, roots, spelling_variants

SCHEMA = "doc_id long, text string"
ABC = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100))) + "ABC"


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, count = {}, {}
    for w in n:
        others = [x for x in n if near(w, x)]
        count[w] = len(others)
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n[w], count[w], None if form[w] is None else n[form[w]]) for w in n}


def result(df):
    return [tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()]


def misspell(rng, w):
    i = rng.randrange(len(w))
    kind = rng.randrange(4)
    c = rng.choice(ABC)
    return [w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w[:i] + w[i] + w[i:]][kind]


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice(ABC) for _ in range(rng.randrange(4, 9))) for _ in range(25)] + ["aaaaaaa", "aabbaabb", "zzzzzz", "bookkeeper"]
    rows = []
    for d in range(120):
        words = [rng.choice(base) for _ in range(30)]
        words = [misspell(rng, w) if rng.random() < 0.3 and w else w for w in words] + [misspell(rng, misspell(rng, "aaaaaaa")), misspell(rng, "bookkeeper")]
        rows.append((d if d % 10 else None, rng.choice([" ", "-", "3", "\n"]).join(words)))
    rows += [(7, None), (8, ""), (9, "12 ?")] + rows[:5]
    want = brute(rows)
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[2] != r[1] for r in want)
    got = result(spelling_variants(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert len(got) == len(set(got)) and set(got) == want


def test_keys_that_collide_are_told_apart(spark, monkeypatch):
    """With primes as small as this most keys are shared by strangers."""
    rng = random.Random(4)
    text = " ".join(misspell(rng, rng.choice(["abcdef", "ghijkl", "mnopqr"])) for _ in range(2000))
    rows = [(1, text)]
    words = {w: c for w, _, _, c, _, _ in brute(rows)}
    batch = variants.pa.RecordBatch.from_pylist([{"word": w, "wid": k} for k, w in enumerate(words)])
    monkeypatch.setattr(variants, "_PRIMES", (7, 5))
    monkeypatch.setattr(variants, "_BASES", (3, 2))
    names, counts = list(words), list(words.values())
    table = variants.pa.Table.from_batches(list(variants._not_alone(variants.pa.Table.from_batches(variants._deletions([batch])).sort_by("key").to_batches(max_chunksize=7))))
    wid = table.column("wid").to_pylist()
    table = table.append_column("word", variants.pa.array([names[k] for k in wid])).append_column("n", variants.pa.array([counts[k] for k in wid]))
    got = Counter()
    for b in variants._settle(table.to_batches(max_chunksize=11)):
        for w, k in zip(b.column("word").to_pylist(), b.column("near").to_pylist(), strict=True):
            got[w] += k
    assert got == Counter({w: c for w in words if (c := sum(near(w, x) for x in words))})


def test_long_runs_of_letters_and_words(spark):
    """A word of very many equal letters has few keys; one of very many different ones has all."""
    rng = random.Random(5)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    words = ["a" * 50_000, "a" * 49_999, "a" * 25_000 + "b" + "a" * 24_999, long, long[:500] + long[501:], long + "x"]
    rows = [(w, 3 + k) for k, w in enumerate(words)]
    got = {r.word: (r.n_near, r.best) for r in near_words(spark.createDataFrame(rows, "word string, n long")).collect()}
    want = {}
    for w, _ in rows:
        others = [x for x in rows if near(w, x[0])]
        want[w] = (len(others), min(others, key=lambda x: (-x[1], x[0]))[0])
    assert got == want and len(got) == 6


def test_chains_and_empty_tables(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("v", "w5")]
    got = {r.word: r.root for r in roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}
    empty = spelling_variants(spark.createDataFrame([], "text string, doc_id long, word string, n long"))
    assert empty.collect() == []
    clash = spark.createDataFrame([(k, "Hello hello hellos hellos hellos", "x", 9) for k in range(4)], "doc_id long, text string, word string, key long")
    assert set(result(spelling_variants(clash))) == brute([(k, "Hello hello hellos hellos hellos") for k in range(4)])


@pytest.mark.parametrize("ids", ["string", "long"])
def test_ids_of_any_type(spark, ids):
    rows = [(k % 7, f"anderes andreas andreas {'word' * 3}") for k in range(60)]
    got = result(spelling_variants(spark.createDataFrame(rows, SCHEMA).selectExpr(f"cast(doc_id AS {ids}) AS doc_id", "text")))
    assert set(got) == brute(rows)
