"""Benchmark decontamination by winnowing.

Fingerprints are the hashes of K consecutive words; of every W consecutive
fingerprints the smallest is kept (the rightmost of equals).  Any shared run
of K + W - 1 words therefore keeps the same fingerprint on both sides, so a
lookup of kept fingerprints misses no shared window of that length.  Each hit
is extended to the whole windows around it, which are confirmed word by word.

Items shorter than the window length are one window of their own length and
are fingerprinted whole (K = their length, W = 1).

Two ways to join, with equal results:

* benchmark texts up to ``max_broadcast_bytes`` (checked by a count first) are
  compiled once and broadcast; documents are then read once, without a shuffle;
* beyond that, kept fingerprints are joined (broadcast up to MAX_PRINTS of
  them), and the windows near the hits by a shuffle; only texts with hits move.
  Rows are numbered as they are written once, so null or repeated document ids
  need no care, and windows that many documents have are dealt to many tasks.

Null or empty texts have no words.  A null item id is written as an empty
string.  Repeated items count once per distinct id.  Texts are read whole,
however long; equal rows get equal results; an empty table gives an empty
result.  Only the named columns are read, so others may have any name; a kept
column that is called as a result is gives way to it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.llm.components import cut
from poolsieve.llm.groups import join_salted
from poolsieve.llm.kernels import ALNUM, LOWER, Words, word_slices

WINDOW = 13
K = 5
W = WINDOW - K + 1
#: A document is contaminated from this share of hit words on: 1 / 20.
SHARE = 20
MAX_BROADCAST_BYTES = 8 << 20

_RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _winnow(words: Words) -> np.ndarray:
    """Positions of the kept fingerprints of every row that has a whole window."""
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    grams = words.grams(np.arange(n + W - 1), K)
    least, at = grams[:n].copy(), np.arange(n)
    for j in range(1, W):
        nearer = grams[j : n + j] <= least
        least[nearer] = grams[j : n + j][nearer]
        at[nearer] = np.flatnonzero(nearer) + j
    kept = np.zeros(len(words), dtype=bool)
    kept[at[words.row_ends()[:n] - np.arange(n) >= WINDOW]] = True
    return np.flatnonzero(kept)


def _starts_near(words: Words, hits: np.ndarray) -> np.ndarray:
    """Starts of the whole windows that hold one of the fingerprints at ``hits``."""
    near = np.zeros(len(words), dtype=bool)
    first = np.repeat(words.bounds[:-1], words.counts())
    left = words.row_ends()
    for back in range(W):
        s = hits - back
        s = s[s >= first[hits]]
        near[s[left[s] - s >= WINDOW]] = True
    return np.flatnonzero(near)


def _item_windows(words: Words, row: int) -> tuple[int, range]:
    lo, hi = int(words.bounds[row]), int(words.bounds[row + 1])
    length = min(WINDOW, hi - lo)
    return length, range(lo, hi - length + 1) if length else range(0)


class _Index:
    """Sorted hashes behind a small bit table that turns most lookups away."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(hashes)
        self.bits = np.zeros(1 << 20, dtype=bool)
        self.bits[self.sorted & np.uint64((1 << 20) - 1)] = True

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Positions in ``hashes`` of those that are held."""
        at = np.flatnonzero(self.bits[hashes & np.uint64((1 << 20) - 1)])
        if not len(at) or not len(self.sorted):
            return at[:0]
        there = np.searchsorted(self.sorted, hashes[at])
        there[there == len(self.sorted)] = 0
        return at[self.sorted[there] == hashes[at]]


class Matcher:
    """Benchmark items compiled for lookup."""

    def __init__(self, items: list[tuple[str, str | None]]):
        self.windows: dict[bytes, list[str]] = {}
        prints, by_length = [], {}
        texts = pa.array([t for _, t in items], type=pa.string())
        for lo, hi, words in word_slices(texts, ALNUM, LOWER):
            prints.append(words.grams(_winnow(words), K))
            for row in range(hi - lo):
                length, starts = _item_windows(words, row)
                for s in starts:
                    self.windows.setdefault(words.text(s, length), []).append(items[lo + row][0])
                if len(starts):
                    by_length.setdefault(length, []).append(words.grams(np.arange(starts.start, starts.stop), length))
        self.windows = {k: sorted(set(v)) for k, v in self.windows.items()}
        self.prints = _Index(np.concatenate(prints) if prints else np.zeros(0, dtype=np.uint64))
        self.by_length = {n: _Index(np.concatenate(h)) for n, h in sorted(by_length.items())}

    def spans(self, words: Words) -> Iterator[tuple[int, int, list[str]]]:
        """Every occurrence of an item's window: first word, length, item ids."""
        for length, index in self.by_length.items():
            if length == WINDOW:
                kept = _winnow(words)
                starts = _starts_near(words, kept[self.prints.find(words.grams(kept, K))])
            else:
                starts = np.flatnonzero(words.row_ends() - np.arange(len(words)) >= length)
            for s in starts[index.find(words.grams(starts, length))].tolist():
                found = self.windows.get(words.text(s, length))
                if found:
                    yield s, length, found


def _digest_items(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _covered(n_words: int, spans: list[tuple[int, int]]) -> int:
    change = np.zeros(n_words + 1, dtype=np.int64)
    for s, length in spans:
        change[s] += 1
        change[s + length] -= 1
    return int((np.cumsum(change[:-1]) > 0).sum())


def _rows_of(words: Words, matcher: Matcher) -> list[tuple[int, int, set[str]]]:
    counts = words.counts()
    spans: dict[int, list] = {}
    items: dict[int, set] = {}
    for s, length, found in matcher.spans(words):
        row = int(np.searchsorted(words.bounds, s, side="right")) - 1
        spans.setdefault(row, []).append((s - int(words.bounds[row]), length))
        items.setdefault(row, set()).update(found)
    return [(int(n), _covered(int(n), spans[r]) if r in spans else 0, items.get(r, set())) for r, n in enumerate(counts)]


def _result_arrays(rows: list[tuple[int, int, set[str]]]) -> list[pa.Array]:
    return [
        pa.array([n for n, _, _ in rows], pa.int64()),
        pa.array([h for _, h, _ in rows], pa.int64()),
        pa.array([len(i) for _, _, i in rows], pa.int64()),
        pa.array([_digest_items(i) for _, _, i in rows], pa.string()),
        pa.array([h > 0 and SHARE * h >= n for n, h, _ in rows], pa.bool_()),
    ]


_NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


_compiled: dict[str, Matcher] = {}


def _matcher(name: str, items: list[tuple[str, str | None]]) -> Matcher:
    """The matcher called ``name``, compiled once in each worker; it takes the place of another one."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Matcher(items)
    return _compiled[name]


def _by_broadcast(docs: DataFrame, items: list[tuple[str, str | None]], keep: list[str], text: str) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def run(batches):
        matcher = _matcher(name, shared.value)
        for batch in batches:
            rows = []
            for _, _, words in word_slices(batch.column(text), ALNUM, LOWER):
                rows += _rows_of(words, matcher)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _result_arrays(rows), keep + _NAMES)

    schema = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(_RESULT).fields)
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def _prints(batches):
    """Kept fingerprints, and whole short windows, of each text."""
    for batch in batches:
        for lo, hi, words in word_slices(batch.column("text"), ALNUM, LOWER):
            at = _winnow(words)
            rows = words.rows()[at]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(lo + rows)), pa.array(words.grams(at, K).view(np.int64)), pa.array(np.full(len(at), WINDOW, dtype=np.int32)), pa.array((at - words.bounds[rows]).astype(np.int32))],
                ["row", "print", "length", "at"],
            )


def _short_prints(lengths: list[int]):
    def run(batches):
        for batch in batches:
            for lo, hi, words in word_slices(batch.column("text"), ALNUM, LOWER):
                for n in lengths:
                    at = np.flatnonzero(words.row_ends() - np.arange(len(words)) >= n)
                    rows = words.rows()[at]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").take(pa.array(lo + rows)), pa.array(words.grams(at, n).view(np.int64)), pa.array(np.full(len(at), n, dtype=np.int32)), pa.array((at - words.bounds[rows]).astype(np.int32))],
                        ["row", "print", "length", "at"],
                    )

    return run


def _item_rows(batches):
    """Each item's windows with the fingerprints kept in them."""
    for batch in batches:
        ids = batch.column("item").to_pylist()
        for lo, hi, words in word_slices(batch.column("text"), ALNUM, LOWER):
            kept = _winnow(words)
            prints = {}
            for p, h in zip(kept.tolist(), words.grams(kept, K).view(np.int64).tolist(), strict=True):
                prints[p] = h
            out = []
            for row in range(hi - lo):
                length, starts = _item_windows(words, row)
                whole = words.grams(np.arange(starts.start, starts.stop), length).view(np.int64).tolist() if len(starts) else []
                for s, h in zip(starts, whole, strict=True):
                    marks = [prints[p] for p in range(s, s + W) if p in prints] if length == WINDOW else [h]
                    out.append((ids[lo + row], length, words.text(s, length).decode(), marks))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(pa.int64()))], ["item", "length", "window", "prints"])


def _windows_at(batches):
    """The windows around the hits of each text."""
    for batch in batches:
        hits = batch.column("hits").to_pylist()
        for lo, hi, words in word_slices(batch.column("text"), ALNUM, LOWER):
            long = [int(words.bounds[r]) + h["at"] for r in range(hi - lo) for h in hits[lo + r] if h["length"] == WINDOW]
            out = [(s, WINDOW) for s in _starts_near(words, np.array(sorted(long), dtype=np.int64)).tolist()] if long else []
            out += [(int(words.bounds[r]) + h["at"], h["length"]) for r in range(hi - lo) for h in hits[lo + r] if h["length"] < WINDOW]
            rows = (np.searchsorted(words.bounds, [s for s, _ in out], side="right") - 1).tolist() if out else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array([lo + r for r in rows], pa.int64())),
                    pa.array([n for _, n in out], pa.int32()),
                    pa.array([words.text(s, n).decode() for s, n in out], pa.string()),
                    pa.array([s - int(words.bounds[r]) for (s, _), r in zip(out, rows, strict=True)], pa.int32()),
                ],
                ["row", "length", "window", "at"],
            )


def _sizes(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(_word_counts(batch.column("text")), pa.int64())], ["row", "n_words"])


def _totals(batches):
    for batch in batches:
        counts, spans, items = (batch.column(c).to_pylist() for c in ("n_words", "spans", "items"))
        rows = [(n, _covered(n, [(x["at"], x["length"]) for x in s or []]), set(i or [])) for n, s, i in zip(counts, spans, items, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *_result_arrays(rows)], ["row", *_NAMES])


def _word_counts(texts: pa.Array) -> list[int]:
    """Number of words of each text."""
    return [int(n) for _, _, words in word_slices(texts, ALNUM, LOWER) for n in words.counts()]


#: Fingerprints that may be broadcast.
MAX_PRINTS = 2_000_000


def _by_shuffle(docs: DataFrame, items: DataFrame, keep: list[str], text: str) -> DataFrame:
    named = cut(docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row")))
    texts = named.select("row", "text")
    rows = cut(items.mapInArrow(_item_rows, "item string, length int, window string, prints array<long>"))
    wanted = rows.select("length", F.explode("prints").alias("print")).distinct()
    if wanted.count() <= MAX_PRINTS:
        wanted = F.broadcast(wanted)
    lengths = sorted(r[0] for r in rows.select("length").distinct().collect())  # at most WINDOW values
    kind = "row long, print long, length int, at int"
    prints = texts.mapInArrow(_prints, kind)
    if short := [n for n in lengths if n < WINDOW]:
        prints = prints.unionByName(texts.mapInArrow(_short_prints(short), kind))
    # at most a text's own positions
    hits = prints.join(wanted, ["length", "print"], "left_semi").groupBy("row").agg(F.collect_set(F.struct("at", "length")).alias("hits"))
    found = cut(texts.join(hits, "row").mapInArrow(_windows_at, "row long, length int, window string, at int"))
    # a window leads to the list of its items by the list's digest, so windows of many items stay small
    lists = rows.groupBy("length", "window").agg(F.sort_array(F.collect_set("item")).alias("items")).withColumn("list", F.sha2(F.to_json("items"), 256))
    lists = cut(lists)
    common = found.groupBy("length", "window").agg(F.count("*").alias("n"))
    windows = lists.select("length", "window", "list").join(common, ["length", "window"])
    matched = cut(join_salted(found, windows, ["length", "window"], "n", ["row"]).select("row", "at", "length", "list"))
    spans = matched.groupBy("row").agg(F.collect_set(F.struct("at", "length")).alias("spans"))
    named_lists = matched.select("row", "list").distinct()
    known = lists.select("list", "items").dropDuplicates(["list"]).join(named_lists.groupBy("list").agg(F.count("*").alias("n")), "list")
    own = join_salted(named_lists, known, ["list"], "n", ["row"]).groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    told = texts.mapInArrow(_sizes, "row long, n_words long").join(spans, "row", "left").join(own, "row", "left")
    totals = told.mapInArrow(_totals, "row long, " + _RESULT)
    return named.select("row", "kept").join(totals, "row").select("kept.*", *_NAMES)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: list[str] | None = None,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
) -> DataFrame:
    """``keep`` columns of every document with its words, hit words, items and verdict.

    ``n_hit`` counts the words inside any occurrence of a window of 13 item
    words (or of a whole shorter item); ``contaminated`` holds from a twentieth
    of the words on.  ``items_sha256`` is the digest of the matched item ids,
    sorted as strings and joined by commas.
    """
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in _NAMES]
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length(F.coalesce("text", F.lit(""))) + F.octet_length("item") + 32)).first()[0] or 0
    if size <= max_broadcast_bytes:
        return _by_broadcast(docs, [tuple(r) for r in items.collect()], keep, text)
    return _by_shuffle(docs, items, keep, text)
