"""The audit against filters that are applied one after the other, and the walk over orders."""

import itertools
import re
from collections import Counter

import numpy as np

from poolsieve.llm.filter_audit import audit_filters, plain_changes, walk

DOCS = "doc_id long, text string, lang string"
LABELS = "doc_id long, quality int, toxic int"


def test_every_order_once_by_single_swaps():
    for n in range(1, 7):
        seen = [list(o) for o, _ in plain_changes(n)]
        assert len(seen) == len({*map(tuple, seen)}) == len(list(itertools.permutations(range(n))))
        swaps = [s for _, s in plain_changes(n)]
        for a, b, s in zip(seen, seen[1:], swaps[1:], strict=False):
            assert a[:s] == b[:s] and a[s + 2 :] == b[s + 2 :] and a[s] == b[s + 1] and a[s + 1] == b[s]


def test_walk_counts_as_fresh_counts():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 9, (3, 16, 3))
    orders, counts = walk(cells, 4)
    removed = Counter()
    for k, order in enumerate(orders):
        for p in range(3):
            left = dict(enumerate(cells[p]))
            for step, f in enumerate(order):
                gone = [m for m in left if m >> f & 1]
                assert counts["removed"][p, k, step] == sum(left[m][0] for m in gone)
                assert counts["good_lost"][p, k, step] == sum(left[m][1] for m in gone)
                removed[p, f] += sum(left.pop(m)[0] for m in gone)
                assert counts["kept"][p, k, step] == sum(c[0] for c in left.values())
    for k, order in enumerate(orders):
        assert all(counts["shapley"][p, k, s] == removed[p, f] for p in range(3) for s, f in enumerate(order))
    # over all orders the filters share what all of them remove
    assert all(counts["shapley"][p, 0].sum() == len(orders) * (cells[p, :, 0].sum() - cells[p, 0, 0]) for p in range(3))


def fails(rows):
    out = []
    for doc, text, _ in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        f = ""
        f += "A" if len(words) < 200 else ""
        f += "B" if 100 * len({*words}) < 50 * len(words) else ""
        f += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
        f += "D" if re.search("[#$%&*|]", text) else ""
        f += "E" if doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in rows) else ""
        out.append(f)
    return out


def brute(rows, labels):
    told = fails(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = set()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], f) for r, f in zip(rows, told, strict=True) if (r[2] or "") == part]
        found, shapley = [], Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = [x for x in mine if f in x[1]]
                found.append((order, step, f, len(left), len(gone), len(failing) - len(gone), sum(x[1] == f for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone)))
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in found}
    return out


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def test_against_filters_in_turn(spark):
    many = " ".join(f"word{k}" for k in range(210))
    texts = [many, many, many + " #", many + " $", "short", "SHORT TEXT", "a b " * 300, "A B " * 300, "A B " * 300 + "%", "", None, many + " x", "very long " * 100_000 + many, "short", many]
    rows = [(k, t, ["en", "de", None, ""][k % 4]) for k, t in enumerate(texts * 3)]
    rows += [(None, many, "en"), (None, many, "en"), (4, "short", "en"), (4, "short", "fr"), (4, "other #", None), (-1, many + " x", "fr")]
    labels = [(k, k % 2, k % 3 % 2) for k in range(30)] + [(3, None, 1), (3, 1, None), (3, 1, 1), (None, 1, 1), (700, 1, 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = audit_filters(docs, spark.createDataFrame(labels, LABELS)).select(*COLUMNS).collect()
    want = brute(rows, labels)
    assert len(got) == len(want) == 600 * 4 and {tuple(r) for r in got} == want


def test_empty_tables_and_clashing_names(spark):
    none = spark.createDataFrame([], LABELS)
    assert audit_filters(spark.createDataFrame([], DOCS), none).collect() == []
    rows = [(1, "a", "en", 7, "x", "y"), (2, "a", None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, mask int, part string, digest string")
    got = audit_filters(docs, none).select(*COLUMNS).collect()
    assert {tuple(r) for r in got} == brute([r[:3] for r in rows], [])
