"""Fingerprints: sums of paragraphs, edits without the text, and neighbours over any number of blocks."""

import random
from hashlib import sha256

import pytest

from poolsieve.llm import fingerprints as fp

SCHEMA = "doc_id long, text string"


def prints(texts):
    return fp.pack(fp.hash_texts(texts))


def test_order_and_sums():
    a, b = "one. two\nthree!\n", "four\n\nfive"
    assert prints(["x\ny\nz"]) == prints(["z\nx\ny"]) != prints(["x\ny\nz\n"])
    assert len({*prints(["", "\n", "x", "x\n", "x x", "x\nx", "X"])}) == 7
    assert (fp.hash_texts([a + b]) == fp.hash_texts([a]) + fp.hash_texts([b])).all()
    again = fp.unpack(prints([a + b]))
    assert fp.pack(again) == prints([a + b])
    # the narrow lanes wrap round at very many repeats, the wide ones still tell
    assert prints(["a\n" * 65536]) != prints(["b\n" * 65536])


def test_likeness_estimates_shared_sentences():
    rng = random.Random(1)
    words = lambda: " ".join(f"w{rng.randrange(1000)}" for _ in range(8))
    base = [words() for _ in range(200)]
    for kept in (0, 50, 100, 150, 200):
        other = base[:kept] + [words() for _ in range(200 - kept)]
        rng.shuffle(other)
        got = fp._alike(fp.hash_texts([". ".join(base) + "."]), fp.hash_texts(["\n".join(f"{x}." for x in other)]))[0]
        assert got == pytest.approx(kept / 200, abs=0.25)
    one, none = fp.hash_texts(["a\n" * 3]), fp.hash_texts([""])
    assert fp._alike(none, none)[0] == 1 and fp._alike(one, none)[0] == 0 and fp._alike(one, one)[0] == 1


def test_columns_and_edits(spark):
    rows = [(k, f"line {k}\nshared line\n" + "more words here. " * k) for k in range(50)] + [(50, None), (51, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = fp.fingerprints(df)
    told = {r.doc_id: (r.n_chars, r.fingerprint) for r in got.collect()}
    assert told == {k: (len(t or ""), prints([t or ""])[0]) for k, t in rows}
    # take the shared line out of some, put lines in by very many edits of one id
    edits = [(k, "shared line\n", -1) for k in range(0, 50, 7)] + [(3, f"new {j % 5}\n", 1) for j in range(4000)] + [(99, "nowhere", 1), (None, "x", 1)]
    after = fp.changed(got, spark.createDataFrame(edits, "doc_id long, text string, sign int").repartition(3))
    want = {k: (t or "").replace("shared line\n", "") if k < 50 and k % 7 == 0 else (t or "") for k, t in rows}
    want[3] = "".join(f"new {j % 5}\n" for j in range(4000)) + want[3]
    assert {r.doc_id: r.fingerprint for r in after.collect()} == {k: prints([t])[0] for k, t in want.items()}
    pair = got.alias("a").join(got.alias("b"), fp.F.expr("a.doc_id = b.doc_id - 1"), "left").select(fp.F.col("a.doc_id").alias("k"), fp.likeness("a.fingerprint", "b.fingerprint").alias("s"))
    found = {r.k: r.s for r in pair.collect()}
    assert found[50] == 1.0 and found[51] is None and all(0 <= s <= 1 for s in found.values() if s is not None)


def brute(rows):
    """Descending ids, none last; of one id the larger hash first."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, n = fp.hash_texts([text]), fp.hash_texts([edited]), fp.hash_texts([after])
        out.append((i, len(text), sha256(edited.encode()).hexdigest(), fp.pack(a)[0], fp.pack(e)[0], round(fp._alike(a, e)[0], 12), round(fp._alike(a, n)[0], 12)))
    return sorted(out, key=str)


@pytest.mark.parametrize("per_block", [1, 16])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours(spark, monkeypatch, per_block, kind):
    monkeypatch.setattr(fp, "SAMPLE_PER_BLOCK", per_block)
    monkeypatch.setattr(fp, "_CHARS_AT_ONCE", 500)
    rng = random.Random(2)
    pieces = ["Ein Satz. ", "zwei\n", "drei? ", "\n", "x" * 700, "日本語。\n"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(9)))) for k in rng.sample(range(10, 99), 70)]
    rows += [(5, None), (6, ""), (7, "very long. " * 20_000)] + [(8, "same row")] * 30 + [(8, f"other {k}") for k in range(5)] + [(None, f"no id {k % 3}") for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr(f"cast(doc_id AS {kind}) AS doc_id", "text")
    order = df.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").orderBy(fp.F.desc_nulls_last("doc_id"), fp.F.desc("h"))
    want = brute([(r.doc_id, r.text) for r in order.collect()])
    got = fp.edited_fingerprints(df.repartition(5))
    assert sorted([(*r[:5], round(r[5], 12), round(r[6], 12)) for r in got.collect()], key=str) == want


def test_small_tables(spark):
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).collect() == []
    one = fp.edited_fingerprints(spark.createDataFrame([(None, "abcd")], SCHEMA)).collect()
    assert len(one) == 1 and one[0].edited_sha256 == sha256(b"abab").hexdigest() and one[0].near_next == 1
    clash = spark.createDataFrame([(1, "a", "b", 3), (2, "c", None, None)], "doc_id long, text string, h string, block int")
    assert fp.edited_fingerprints(clash).count() == 2
