"""Removal of long word sequences that an earlier document already has.

A window is 50 consecutive words.  A word is removed when a window over it
also starts in a document with a smaller id; windows are judged on the input.

Comparing all windows would move every word of the corpus.  Instead, runs of
20 words are hashed only at positions whose residue modulo 31 is in a
difference cover: for any two residues some shift below 31 brings both into
the cover, so two equal windows of 50 words always share an aligned anchor.
Anchors that only one word sequence has end there; around the others the words
of the whole windows are compared, by 128 bits of BLAKE2.  A window that a
document has several times is one row.

Copies: documents with the same word sequence are settled by a digest.  All
but those with the smallest id lose every word (from 50 words on), and only
the smallest takes part in the window search.

Null or empty texts have no words; an empty table gives an empty result.  Texts
are read whole, however long.  Only the two named columns are read, so others
may have any name.  A document without an id keeps all its
words and takes none from others.  Rows that repeat id and text are equal and
do not affect each other; rows that share an id but not the text are separate
rows of one document id, so neither is smaller.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsieve.llm.components import cut
from poolsieve.llm.groups import join_salted
from poolsieve.llm.kernels import NOT_SPACE, Words, as_long, pieces, word_slices

WINDOW = 50
PERIOD = 31
#: Every residue modulo 31 is a difference of two of these.
COVER = (1, 5, 11, 24, 25, 27)
ANCHOR = WINDOW - PERIOD + 1

_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_NOTHING = hashlib.sha256(b"").hexdigest()


def _positions(words: Words) -> np.ndarray:
    """Each word's position in its row."""
    return np.arange(len(words)) - np.repeat(words.bounds[:-1], words.counts())


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """First words of the anchors, and their hashes, of rows that have a window."""
    at = np.arange(len(words))
    left = words.row_ends() - at
    long = np.repeat(words.counts() >= WINDOW, words.counts())
    at = at[long & (left >= ANCHOR) & _IN_COVER[_positions(words) % PERIOD]]
    return at, words.grams(at, ANCHOR)


def _describe(batches):
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
            d1, d2 = words.digests()
            whole = [hashlib.sha256(words.text(int(a), int(n))).hexdigest() if n else _NOTHING for a, n in zip(words.bounds[:-1], words.counts(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), as_long(d1), as_long(d2), pa.array(words.counts()), pa.array(whole)], ["doc_id", "d1", "d2", "n_words", "whole"])


def _anchor_rows(batches):
    for batch in batches:
        for _, _, words in word_slices(batch.column(0), NOT_SPACE):
            at, h = _anchors(words)
            row = words.rows()[at]
            order = np.lexsort((h, row))
            h, row = h[order], row[order]
            new = np.ones(len(h), dtype=bool)
            new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            d1, _ = words.digests()
            yield pa.RecordBatch.from_arrays([as_long(h[new]), as_long(d1[row[new]])], ["h", "d1"])


def _packed(batches):
    """Texts compressed, for a shuffle."""
    for batch in pieces(batches):
        pack = zstandard.ZstdCompressor(level=1)
        ids = batch.column(0)
        for lo, hi, words in word_slices(batch.column(1), NOT_SPACE):
            d1, d2 = words.digests()
            part = batch.column(1).slice(lo, hi - lo).to_pylist()
            long = words.counts() >= WINDOW
            packed = pa.array([pack.compress(t.encode()) for t, keep in zip(part, long, strict=True) if keep], pa.binary())
            rows = pa.array(np.flatnonzero(long))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).take(rows), as_long(d1[long]), as_long(d2[long]), packed], ["doc_id", "d1", "d2", "packed"])


def _unpack(column: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(x).decode() for x in column.to_pylist()], pa.large_string())


def _window_rows(batches):
    """The different windows of each text that hold a shared anchor, by a digest of their words, and their starts."""
    for batch in batches:
        shared, bounds = batch.column("shared").values.to_numpy(zero_copy_only=False), batch.column("shared").offsets.to_numpy()
        for lo, hi, words in word_slices(_unpack(batch.column("packed")), NOT_SPACE):
            at, h = _anchors(words)
            h, row = h.view(np.int64), words.rows()[at]
            edge = np.searchsorted(row, np.arange(hi - lo + 1))
            near = np.zeros(len(words), dtype=bool)
            first, end = np.repeat(words.bounds[:-1], words.counts()), words.row_ends()
            for r in range(hi - lo):
                hit = at[edge[r] : edge[r + 1]][np.isin(h[edge[r] : edge[r + 1]], shared[bounds[lo + r] : bounds[lo + r + 1]])]
                for back in range(PERIOD):
                    s = hit - back
                    near[s[s >= words.bounds[r]]] = True
            s = np.flatnonzero(near)
            s = s[end[s] - s >= WINDOW]
            told, place = words.joined()
            w = np.frombuffer(b"".join([blake2b(told[a : z - 1], digest_size=16).digest() for a, z in zip(place[s].tolist(), place[s + WINDOW].tolist(), strict=True)]), dtype=np.int64).reshape(-1, 2)
            row = words.rows()[s]
            order = np.lexsort((w[:, 1], w[:, 0], row))
            w, row, at = w[order], row[order], (s - first[s]).astype(np.int32)[order]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]).any(axis=1) | (row[1:] != row[:-1])
            rows = pa.array(lo + row[new])
            starts = pa.ListArray.from_arrays(pa.array(np.r_[np.flatnonzero(new), len(w)].astype(np.int32)), pa.array(at))
            yield pa.RecordBatch.from_arrays([pa.array(w[new, 0]), pa.array(w[new, 1]), batch.column("doc_id").take(rows), batch.column("d1").take(rows), starts], ["w1", "w2", "doc_id", "d1", "starts"])


def _spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Window starts as disjoint runs of words ``(first, words)``."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) > WINDOW) + 1
    a, z = starts[np.r_[0, new]], starts[np.r_[new - 1, len(starts) - 1]] + WINDOW
    return list(zip(a.tolist(), (z - a).tolist(), strict=True))


def _remove(batches):
    for batch in batches:
        starts = batch.column("starts").to_pylist()
        spans, removed, kept = [], [], []
        for lo, hi, words in word_slices(_unpack(batch.column("packed")), NOT_SPACE):
            for r in range(hi - lo):
                found = _spans(np.array(starts[lo + r]))
                a, n = int(words.bounds[r]), int(words.bounds[r + 1] - words.bounds[r])
                parts, at = [], 0
                for s, k in [*found, (n, 0)]:
                    if s > at:
                        parts.append(words.text(a + at, s - at))
                    at = s + k
                spans.append([{"first": s, "words": k} for s, k in found])
                removed.append(sum(k for _, k in found))
                kept.append(hashlib.sha256(b" ".join(parts)).hexdigest())
        kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "d1", "d2")] + [pa.array(removed, pa.int64()), pa.array(kept, pa.string()), pa.array(spans, kind)], ["doc_id", "d1", "d2", "n_removed", "kept", "spans"])


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256, removed`` for every document.

    ``removed`` lists the removed runs of words, ``kept_sha256`` is the digest
    of the other words joined by one space.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    named = docs.where("doc_id IS NOT NULL")
    about = cut(docs.mapInArrow(_describe, f"doc_id {id_type}, d1 long, d2 long, n_words long, whole string"))
    first = about.where("doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("first_id"))

    anchors = named.select("text").mapInArrow(_anchor_rows, "h long, d1 long")
    several = cut(anchors.groupBy("h").agg(F.min("d1").alias("least"), F.max("d1").alias("most"), F.count("*").alias("n")).where("least <> most").select("h", "n"))
    shared = join_salted(anchors, several, ["h"], "n", ["d1"]).groupBy("d1").agg(F.collect_set("h").alias("shared"))  # at most a document's own anchors
    look = shared.join(first, "d1").select("d1", "d2", F.col("first_id").alias("doc_id"), "shared")

    packed = named.mapInArrow(_packed, f"doc_id {id_type}, d1 long, d2 long, packed binary")
    near = cut(packed.join(look, ["doc_id", "d1", "d2"]))
    windows = cut(near.mapInArrow(_window_rows, f"w1 long, w2 long, doc_id {id_type}, d1 long, starts array<int>"))
    least = cut(windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n")).where("least < most").drop("most"))
    repeats = join_salted(windows, least, ["w1", "w2"], "n", ["doc_id", "d1"]).where("doc_id > least").groupBy("doc_id", "d1").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    hit = repeats.join(first.withColumnRenamed("first_id", "doc_id"), ["doc_id", "d1"]).select("doc_id", "d1", "d2", "starts")
    span = "array<struct<first: int, words: int>>"
    done = near.drop("shared").join(hit, ["doc_id", "d1", "d2"]).mapInArrow(_remove, f"doc_id {id_type}, d1 long, d2 long, n_removed long, kept string, spans {span}").dropDuplicates(["doc_id", "d1", "d2"])

    whole = (F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW)
    joined = about.join(first, ["d1", "d2"], "left").join(done, ["doc_id", "d1", "d2"], "left")
    return joined.select(
        "doc_id",
        "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(_NOTHING)).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("first"), F.col("n_words").cast("int").alias("words")))).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {span})"))).alias("removed"),
    )
