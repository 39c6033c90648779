"""Document fingerprints: homomorphic hashes of the multiset of a text's paragraphs.

A fingerprint is a sum over paragraphs (lines), so their order does not matter,
that of two texts put behind each other is the sum of theirs, and paragraphs are
added to it or taken from it without the text (``changed``).  It has two parts:

* WIDE lanes of 64 bits, the sums modulo 2**64 of the words of each non-empty
  line's SHA-256 and, for each line break, of that of the break.  Texts with
  equal lanes have the same lines and as many breaks, but for a collision.
* NARROW lanes of 16 bits, the sums modulo 2**16 of signs, which are the bits of
  the SHA-256 of each sentence of the lines.  The cosine of two such vectors
  estimates that of the two multisets of sentences, with an error of about
  1 / sqrt(NARROW) whatever the texts' length.  A sentence may be repeated 32767
  times before a lane wraps round; then the estimate is off, equality is not.

A fingerprint is written as the base64 of the lanes, big-endian, wide ones first.
``likeness`` is 1 for equal fingerprints, 0 where one has no sentence, and else
the cosine, 0 at least.

Documents meet the next one by a descending order of ids without moving a text
twice: a bounded sample of ids cuts the order in blocks, each document goes to
its block, packed, and the documents at the cuts also to the block before.

Null and empty texts have no lines and one fingerprint, and are alike.  Texts are
read whole, however long; an empty table gives an empty result; only the two named
columns are read.  Documents without an id come last in the order.  Documents of
one id follow each other by a hash of their text, descending; equal rows stay rows.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from poolsieve.llm.components import cut
from poolsieve.llm.kernels import pieces

WIDE = 4
NARROW = 128
#: Ids sampled for each block, and blocks for each shuffle partition.
SAMPLE_PER_BLOCK = 16
BLOCKS_PER_PARTITION = 4

#: A sentence ends with its marks or its line; blanks before it are not part of it.
SENTENCE = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+")
_BREAK = sha256(b"\n").digest()
#: Characters of text handled at once; a longer text is handled by itself.
_CHARS_AT_ONCE = 1 << 20


def _digests(parts: Iterable[str]) -> np.ndarray:
    return np.frombuffer(b"".join([sha256(p.encode()).digest() for p in parts]), dtype=np.uint8).reshape(-1, 32)


def _sums(values: np.ndarray, counts: list[int]) -> np.ndarray:
    """Sums of consecutive rows, ``counts`` of them each."""
    out = np.zeros((len(counts), values.shape[1]), dtype=values.dtype)
    counts = np.array(counts)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some], axis=0)
    return out


def hash_texts(texts: list[str]) -> np.ndarray:
    """Fingerprints as rows of WIDE lanes, then NARROW ones, all kept modulo 2**64 until they are packed."""
    lines = [[x for x in t.split("\n") if x] for t in texts]
    breaks = np.array([t.count("\n") for t in texts], dtype=np.uint64)
    wide = _sums(_digests(x for some in lines for x in some).view(">u8").astype(np.uint64), [len(x) for x in lines])
    wide += breaks[:, None] * np.frombuffer(_BREAK, dtype=">u8").astype(np.uint64)
    sentences = [[x for s in SENTENCE.findall(t) if (x := s.lstrip(" \t"))] for t in texts]
    bits = np.unpackbits(_digests(x for some in sentences for x in some)[:, : NARROW // 8], axis=1)
    signs = bits.view(np.int8) * 2 - 1
    narrow = _sums(signs.astype(np.int32), [len(x) for x in sentences])
    return np.concatenate([wide, narrow.astype(np.int64).view(np.uint64)], axis=1)


def pack(lanes: np.ndarray) -> list[str]:
    wide, narrow = lanes[:, :WIDE].astype(">u8").view(np.uint8), lanes[:, WIDE:].astype(np.uint16).astype(">u2").view(np.uint8)
    return [base64.b64encode(row.tobytes()).decode() for row in np.concatenate([wide.reshape(len(lanes), -1), narrow.reshape(len(lanes), -1)], axis=1)]


def unpack(fingerprints: Iterable[str]) -> np.ndarray:
    flat = np.frombuffer(b"".join([base64.b64decode(x) for x in fingerprints]), dtype=np.uint8).reshape(-1, 8 * WIDE + 2 * NARROW)
    wide = np.ascontiguousarray(flat[:, : 8 * WIDE]).view(">u8").astype(np.uint64)
    narrow = np.ascontiguousarray(flat[:, 8 * WIDE :]).view(">i2").astype(np.int64).view(np.uint64)
    return np.concatenate([wide, narrow], axis=1)


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints, row by row."""
    x, y = (m[:, WIDE:].astype(np.uint16).view(np.int16).astype(np.int64) for m in (a, b))
    size = np.sqrt((x * x).sum(axis=1).astype(np.float64)) * np.sqrt((y * y).sum(axis=1).astype(np.float64))
    cosine = (x * y).sum(axis=1) / np.where(size > 0, size, 1)
    equal = (a[:, :WIDE] == b[:, :WIDE]).all(axis=1) & (x == y).all(axis=1)
    return np.where(equal, 1.0, np.clip(cosine, 0, 1))


@F.pandas_udf(DoubleType())
def _likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if known.any():
        out[known] = _alike(unpack(a[known]), unpack(b[known]))
    return pd.Series(out)


def likeness(a: Column | str, b: Column | str) -> Column:
    """Likeness of two fingerprints, 0 to 1; null where one is null."""
    return _likeness(a, b)


def _texts_at_once(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if k > lo and size + len(t) > _CHARS_AT_ONCE:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _describe(batches):
    for batch in pieces(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        for lo, hi in _texts_at_once(texts):
            told = pa.array(pack(hash_texts(texts[lo:hi])))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(t) for t in texts[lo:hi]], pa.int64()), told], ["doc_id", "n_chars", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every document; nothing is shuffled."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return docs.mapInArrow(_describe, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_chars long, fingerprint string")


def _sum_by_id(batches):
    """Sums of lanes of ids that follow each other; a batch's own rows of an id are added up wherever they are."""
    held, total = None, None
    for batch in batches:
        ids = batch.column(0).to_pylist()
        if not ids:
            continue
        lanes = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64).reshape(len(ids), -1)
        number = {x: k for k, x in enumerate(dict.fromkeys(ids))}
        sums = np.zeros((len(number), lanes.shape[1]), dtype=np.uint64)
        np.add.at(sums, [number[x] for x in ids], lanes)
        names = list(number)
        if total is not None:
            if held in number:
                sums[number[held]] += total
            else:
                names, sums = [held, *names], np.concatenate([total[None], sums])
        held, total = names[-1], sums[-1].copy()
        yield _lane_batch(batch.schema, names[:-1], sums[:-1])
    if total is not None:
        yield _lane_batch(batch.schema, [held], total[None])


def _lane_batch(schema: pa.Schema, ids: list, lanes: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array([row.tobytes() for row in lanes], pa.binary())], ["doc_id", "lanes"])


def _edit_lanes(batches):
    for batch in pieces(batches):
        ids, texts, sign = batch.column(0), [t or "" for t in batch.column(1).to_pylist()], batch.column(2).to_numpy()
        for lo, hi in _texts_at_once(texts):
            lanes = hash_texts(texts[lo:hi]) * sign[lo:hi].astype(np.int64).view(np.uint64)[:, None]
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array([row.tobytes() for row in lanes], pa.binary())], ["doc_id", "lanes"])


def _add(batches):
    for batch in pieces(batches):
        lanes = unpack(batch.column(1).to_pylist())
        more = batch.column(2).to_pylist()
        some = np.flatnonzero([x is not None for x in more])
        if len(some):
            lanes[some] += np.frombuffer(b"".join([more[k] for k in some]), dtype=np.uint64).reshape(len(some), -1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pack(lanes))], ["doc_id", "fingerprint"])


def changed(prints: DataFrame, edits: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` after paragraphs are inserted and deleted, without the texts.

    ``prints`` has one row for each id; ``edits`` has ``doc_id, text, sign``: texts
    that are put in (sign 1) or taken out (-1), with the line breaks that go with
    them.  Edits of ids that are not in ``prints`` are left out, as are those without one.
    """
    kind = prints.schema["doc_id"].dataType.simpleString()
    lanes = f"doc_id {kind}, lanes binary"
    rows = edits.where("doc_id IS NOT NULL").select(F.col("doc_id").cast(kind).alias("doc_id"), "text", F.col("sign").cast("long").alias("sign"))
    part = rows.mapInArrow(_edit_lanes, lanes).mapInArrow(_sum_by_id, lanes)  # an id of very many edits is one row a batch
    total = part.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_sum_by_id, lanes)
    return prints.select("doc_id", "fingerprint").join(total, "doc_id", "left").mapInArrow(_add, f"doc_id {kind}, fingerprint string")


def _place(key: tuple) -> tuple:
    """Ids without a value come before all others in the ascending order."""
    return (key[0] is not None, *(key if key[0] is not None else (0, key[1])))


def _to_blocks(cuts: list[tuple]):
    """Every document to its block, and those whose keys are cuts also to the block before, where they are the next one.

    Block k holds the keys above cut k - 1, up to cut k; the last cut is the greatest key.
    """

    def run(batches):
        for batch in pieces(batches):
            zip_ = zstandard.ZstdCompressor(level=1)
            ids, h, texts = batch.column(0), batch.column(1), batch.column(2)
            block, row, tail = [], [], []
            for k, key in enumerate(zip(ids.to_pylist(), h.to_pylist(), strict=True)):
                place = _place(key)
                at = bisect_left(cuts, place)
                block.append(at)
                row.append(k)
                tail.append(False)
                if cuts[at] == place:
                    block.append((at + 1) % len(cuts))
                    row.append(k)
                    tail.append(True)
            row = pa.array(row, pa.int64())
            packed = pa.array([zip_.compress((t or "").encode()) for t in texts.to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), pa.array(tail), ids.take(row), h.take(row), packed.take(row)], ["block", "tail", "doc_id", "h", "packed"])

    return run


def _pairs(batches) -> Iterator[tuple[pa.Array, list[str]]]:
    """Ids of some documents that follow each other, and their texts with the next one's behind them."""
    zip_ = zstandard.ZstdDecompressor()
    ids: list = []
    texts: list[str] = []
    size, block = 0, None
    done = False
    for batch in pieces(batches, 64):
        for number, tail, doc_id, data in zip(*(batch.column(c).to_pylist() for c in ("block", "tail", "doc_id", "packed")), strict=True):
            if number != block:
                ids, texts, size, block, done = [], [], 0, number, False
            if done:
                continue  # copies of the next document
            text = zip_.decompress(data).decode()
            texts.append(text)
            size += len(text)
            done = tail
            if ids and (tail or size > _CHARS_AT_ONCE):
                yield pa.array(ids, batch.schema.field("doc_id").type), texts
                ids, texts, size = [], [text], len(text)
            ids.append(doc_id)


def _edited(batches):
    """Half of every text replaced by the next one's; only the lines that change are hashed again."""
    for ids, texts in _pairs(batches):
        heads, tails, new = [], [], []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            half = len(text) // 2
            keep = len(text) - half
            line = text.rfind("\n", 0, keep) + 1
            heads.append(text[:line])
            tails.append(text[line:])
            new.append(text[line:keep] + after[:half])
        lanes = hash_texts([*heads, *tails, *new, texts[-1]])
        n = len(ids)
        own, edited = lanes[:n] + lanes[n : 2 * n], lanes[:n] + lanes[2 * n : 3 * n]
        digest = [sha256((h + x).encode()).hexdigest() for h, x in zip(heads, new, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array(digest),
                pa.array(pack(own)),
                pa.array(pack(edited)),
                pa.array(_alike(own, edited)),
                pa.array(_alike(own, np.concatenate([own[1:], lanes[-1:]]))),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every document.

    The edited text has its last half replaced by the beginning of the next
    document's, in descending order of ids; the first follows the last.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    keys = cut(docs.select("doc_id", "h"))
    spark = docs.sparkSession
    blocks = BLOCKS_PER_PARTITION * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    sample = keys.orderBy(F.xxhash64("doc_id", "h")).limit(SAMPLE_PER_BLOCK * blocks).collect()
    known = keys.where("doc_id IS NOT NULL")
    last = known.agg(F.max(F.struct("doc_id", "h"))).first()[0] or keys.agg(F.max(F.struct("doc_id", "h"))).first()[0]
    if last is None:
        return spark.createDataFrame([], f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    cuts = sorted({*sorted(_place(tuple(r)) for r in sample)[SAMPLE_PER_BLOCK - 1 :: SAMPLE_PER_BLOCK], _place(tuple(last))})
    rows = docs.mapInArrow(_to_blocks(cuts), f"block int, tail boolean, doc_id {kind}, h long, packed binary")
    order = [F.col("block"), F.col("tail"), F.col("doc_id").desc_nulls_last(), F.col("h").desc(), F.col("packed")]
    rows = rows.repartition(F.col("block")).sortWithinPartitions(*order)
    return rows.mapInArrow(_edited, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
