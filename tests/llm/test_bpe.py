import hashlib
import json
import random
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from poolsieve.llm.bpe import MergeAutomaton, Tokenizer, bpe_decode, bpe_encode, read_spec, token_digests

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
SPEC = read_spec(PATH)
REAL = tokenizers.Tokenizer.from_file(PATH)
OURS = Tokenizer(json.loads(SPEC))


def ids(text):
    import numpy as np

    return np.frombuffer(OURS.encode(text), dtype=np.int32).tolist()


def greedy(symbols, merges):
    """Merges applied one after another, each from the left."""
    s = list(symbols)
    for a, b in merges:
        out, i = [], 0
        while i < len(s):
            if i + 1 < len(s) and s[i] == a and s[i + 1] == b:
                out.append(a + b)
                i += 2
            else:
                out.append(s[i])
                i += 1
        s = out
    return s


def test_automaton_on_random_merges():
    rng = random.Random(0)
    for _ in range(150):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(12)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        auto = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        for _ in range(30):
            s = "".join(rng.choice("aabc") for _ in range(rng.randrange(14)))
            assert [auto.labels[t] for t in auto.encode(s)] == greedy(s, merges)


CASES = ["", " ", "Hello, World's don't I'LL they've", "a\x1cb\x1f c\x85d\xa0e", "ΣΑΣ ΑΣ. İstanbul", "é café Å", "日本語テキスト 한국어", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|endoftext", "12345 1,000.50 ½", "🙂👍🏽 naïve", "aaaaaaaaaaaaaaaaaaaaaaaaa" * 30, "​ zero​width", "...!!! -- ***", "\x00\x01", "'s's't", "ﬁ ǅ ẞ"]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    e = REAL.encode(text, add_special_tokens=False)
    assert ids(text) == e.ids
    assert OURS.decode(e.ids) == REAL.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8", max_codepoint=0x2FF), st.sampled_from("theandingof' .,<|>\ńéΣ日😀")), max_size=80))
def test_any_text(text):
    assert ids(text) == REAL.encode(text, add_special_tokens=False).ids


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(200)
    docs = docs.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-1, "a b"), (-1, "a b"), (-2, "Wort " * 100_000)], docs.schema)).selectExpr("*", "1 AS n_tokens", "2 AS token_ids")
    rows = docs.collect()
    want = []
    for r in rows:
        e = REAL.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((r.doc_id, len(e), sha(" ".join(map(str, e))), sha(REAL.decode(e, skip_special_tokens=False))))
    assert sorted(map(tuple, token_digests(docs, SPEC, ["doc_id"]).collect()), key=str) == sorted(want, key=str)
    assert token_digests(docs, SPEC, ["doc_id", "n_tokens"]).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert token_digests(docs.limit(0), SPEC, ["doc_id"]).collect() == []
    assert bpe_encode(docs, SPEC).columns == ["doc_id", "text", "n_tokens", "token_ids"]
    twice = bpe_decode(bpe_encode(docs, SPEC, decoded="one"), SPEC, out="two")
    assert twice.where("one IS DISTINCT FROM two").count() == 0


def test_words_are_walked_together():
    """The steps of Python for a text of many words are far fewer than its words."""
    rng = random.Random(1)
    text = " ".join({"".join(rng.choice("thandersioué") for _ in range(rng.randrange(4, 12))) for _ in range(50_000)})
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    OURS.forget()
    sys.setprofile(count)
    try:
        got = ids(text)
    finally:
        sys.setprofile(None)
    assert got == REAL.encode(text, add_special_tokens=False).ids
    assert calls < len(text.split()) // 2


@pytest.mark.parametrize("few", [1, 32, 1000])
def test_many_words_at_once_on_random_merges(monkeypatch, few):
    monkeypatch.setattr("poolsieve.llm.bpe.FEW", few)
    rng = random.Random(3)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(14)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                tokens.append(a + b)
                merges.append((a, b))
        auto = MergeAutomaton({t: i for i, t in enumerate(tokens)}, merges)
        words = ["".join(rng.choice("aabc") for _ in range(rng.randrange(14))) for _ in range(rng.choice([1, 31, 32, 33, 90]))] + ["ab" * 40, ""]
        rng.shuffle(words)
        found, counts = auto.walk(np.array(["abc".index(c) for w in words for c in w], np.int64), np.array([len(w) for w in words]))
        got = [[auto.labels[t] for t in part] for part in np.split(found, np.cumsum(counts)[:-1])]
        assert got == [greedy(w, merges) for w in words]


def rows_of(tokenizer, texts):
    found, bounds = tokenizer.encode_all(texts)
    assert bounds[0] == 0 and bounds[-1] == len(found)
    return [found[a:b].tolist() for a, b in zip(bounds, bounds[1:])]


def test_few_long_words_are_walked_by_themselves():
    """Arrays of few words would take many calls for each position."""
    rng = random.Random(9)
    texts = ["".join(rng.choice("thandersiou") for _ in range(3000)) for _ in range(8)]
    calls = 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    OURS.forget()
    OURS.automaton.have_arcs(np.array([0]), np.array([1]))
    sys.setprofile(count)
    try:
        found = OURS.encode_all(texts)[0]
    finally:
        sys.setprofile(None)
    assert found.tolist() == [i for t in texts for i in REAL.encode(t, add_special_tokens=False).ids]
    assert calls < 20 * 8 * 3000


@pytest.mark.parametrize("few", [2, 1000])
def test_many_texts_at_once(monkeypatch, few):
    monkeypatch.setattr("poolsieve.llm.bpe.FEW", few)
    OURS.forget()
    parts = ["'s", "'re", "'ll", "''s", "'", "don't", "...'ve", "'S", "<|endoftext|>", "<|startoftext|>", "x<|endoftext|>'s", "<|endoftext|", "1½２", "é", "e\u0301", "Σ", "İ", "日本", "🙂", "\x1c", "\x85", "\u2028", "\u2001", " ", "  ", "\n", "\u0301", "ab", "The", "a" * 90, "\u00ff", "\U000e0001"]
    rng = random.Random(5)
    texts = [None, "", " ", *CASES, *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)), "b" * 5000]
    want = [REAL.encode(t or "", add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time all pieces are kept
        assert rows_of(OURS, texts) == want
    assert rows_of(OURS, []) == [] and rows_of(OURS, [None]) == [[]]


def test_kept_pieces_are_few(monkeypatch):
    monkeypatch.setattr("poolsieve.llm.bpe.MAX_KEPT", 40)
    OURS.forget()
    rng = random.Random(7)
    for size in (10, 39, 60, 5, 30, 30):
        texts = ["".join(rng.choice("abcdé") for _ in range(6)) for _ in range(size)]
        assert rows_of(OURS, texts) == [REAL.encode(t, add_special_tokens=False).ids for t in texts]
        assert OURS.kept is None or len(OURS.kept[0]) == len(OURS.kept[2]) <= 40
    OURS.forget()


def test_another_pattern_and_missing_symbols():
    spec = json.loads(SPEC)
    told = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]
    told["Regex"] = told["Regex"].replace("[\\p{N}]|", r"[\p{N}]+|").replace(r"[^\s\p{L}\p{N}]+", r"[^\s\p{L}\p{N}]")
    model = spec["model"]
    gone = {t for t in model["vocab"] if t in ("q", "z</w>") or len(t.removesuffix("</w>")) > 1 and set("qz") & set(t.removesuffix("</w>"))}
    model["vocab"] = {f"<gone{i}>" if t in gone else t: i for t, i in model["vocab"].items()}
    model["merges"] = [m for m in model["merges"] if not gone & {*m, "".join(m)}]
    real, ours = tokenizers.Tokenizer.from_str(json.dumps(spec)), Tokenizer(spec)
    texts = [*CASES, "1234 ... x<|endoftext|>99", "quick aqua", "ab 12"]
    assert rows_of(ours, texts) == [real.encode(t, add_special_tokens=False).ids for t in texts]
