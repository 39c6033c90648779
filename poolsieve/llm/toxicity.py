"""Toxicity by class-conditional Kneser-Ney language models.

The models spell words: every word is its bytes behind ORDER - 1 start marks and
before an end mark, and each byte has the ORDER - 1 symbols before it as its
context.  In the toxic and in the ordinary class, with absolute discounts from
the counts of counts,

    p(x | h) = max(c(h, x) - D, 0) / c(h) + D * types(h) / c(h) * q(x | h')

where h' is h without its first symbol.  The backoff q is shared by the classes:
q of a shorter context is the same formula over continuation counts, the number
of different symbols that come before an n-gram in either class, down to the
even distribution.  So an expression that one class has once or never is as
likely there as its parts are in the language.  Contexts that a class does not
have leave all to q.  No count is dropped, however rare.

A document's log-likelihood difference is the sum of log p_toxic - log
p_ordinary.  Its inputs to the score are length-normalised, by symbol: the
difference of the whole text, and that of the one, two and four words for which
it is largest, as a few toxic words weigh little among thousands of others.
Logistic regression on held-back training documents, which also sees the number
of words, as the largest of many is larger, maps them to a probability.

N-grams are summed by the cluster and kept in a table with one entry for each
n-gram of full length and each context: an n-gram's log ratio, and what a context
gives to n-grams it does not have, for which q cancels out.  The table is
broadcast while it has at most MAX_BYTES (counted first); beyond that, the
n-grams of every document are joined to it by a shuffle, with equal scores.  A
context has 256 followers at most, so no key of the fit is hot.  The labels are
broadcast while they are at most MAX_LABELS rows; beyond that, texts are
compressed and joined to them by a shuffle.  About CALIBRATION training documents
at most are held back for the logistic fit; all others are counted.

Null and empty texts have no words and get the score of a document without
evidence.  Texts are read whole, however long.  Repeated documents are scored
each, and learned from each.  Labels that are null are ignored; several for one
document count as toxic if any is.  Documents without an id are scored, but not
learned from.  Without both classes among the labels every score is the share of
toxic ones.  Words that tie count alike, whichever of them is taken.  An empty
table gives an empty result.  A kept column that is called as a result is gives
way to it.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.llm.components import cut
from poolsieve.llm.kernels import ALNUM, LOWER, Words, as_long, word_slices

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.7
#: Symbols of an n-gram; more than 7 would not fit a key.
ORDER = 6
START, END = 2, 3
#: Bytes of the table that may be broadcast, and those of one entry.
MAX_BYTES = 192 << 20
ENTRY = 12
#: Bytes of the table that the driver gathers at once.
GATHERED = 16 << 20
MAX_LABELS = 2_000_000
CALIBRATION = 20_000
#: One training document in so many is held back for the logistic fit, fewer where those are more than CALIBRATION.
HELD_BACK = 6
#: Different n-grams that a worker holds before it hands on their counts.
COUNTED = 1_000_000
#: Words spelled at once.
SPELLED = 1 << 17
#: Words whose ratios are inputs beside that of the whole text: the best one, two and four.
BEST = (1, 2, 4)
#: Nats of a word's ratio beyond which it counts in the mean excess.
MARGIN = 2.0
FEATURES = 4 + len(BEST)


def fold(doc_id: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id is the empty text."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id, F.lit(""))) % folds).cast("int")


def _spelled(words: Words, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all n-grams of the words ``which``, and their number for each of them.

    A key is the n-gram's symbols, the last one lowest, below its length in the highest byte.
    """
    size = words.ends[which] - words.starts[which]
    begin = np.cumsum(size + ORDER) - (size + ORDER)
    symbols = np.full(int((size + ORDER).sum()), START, dtype=np.uint64)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    symbols[np.repeat(begin + ORDER - 1, size) + inside] = words.data[np.repeat(words.starts[which], size) + inside]
    symbols[begin + ORDER - 1 + size] = END
    key = np.full(len(symbols) - ORDER + 1 if len(which) else 0, ORDER << 56, dtype=np.uint64)
    for k in range(ORDER):
        key |= symbols[k : k + len(key)] << np.uint64(8 * (ORDER - 1 - k))
    inside = np.arange((size + 1).sum()) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
    return key[np.repeat(begin, size + 1) + inside], size + 1


def _contexts(keys: np.ndarray) -> np.ndarray:
    """Keys of the n-grams without their last symbols."""
    return ((keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | np.uint64((ORDER - 1) << 56)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys = keys[order]
    new = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts[order], new) if len(keys) else counts


def _count(batches):
    """Counts of n-grams by class, over about a million of them at a time."""
    held: dict[int, list] = {0: [], 1: []}
    size = 0

    def told():
        for k, parts in held.items():
            if parts:
                keys, n = _summed(*map(np.concatenate, zip(*parts, strict=True)))
                none = np.zeros(len(n), dtype=np.int64)
                yield pa.RecordBatch.from_arrays([as_long(keys), pa.array(none if k else n), pa.array(n if k else none)], ["key", "c0", "c1"])
                parts.clear()

    for batch in batches:
        toxic = np.asarray(batch.column("toxic").to_numpy(zero_copy_only=False), dtype=np.int64)
        for lo, hi, words in word_slices(batch.column("text"), ALNUM, LOWER):
            of = np.repeat(toxic[lo:hi], words.counts())
            for k in (0, 1):
                mine = np.flatnonzero(of == k)
                _, first, n = np.unique(words.hashes()[mine], return_index=True, return_counts=True)
                for at in range(0, len(first), SPELLED):
                    keys, grams = _spelled(words, mine[first[at : at + SPELLED]])
                    held[k].append(_summed(keys, np.repeat(n[at : at + SPELLED], grams)))
                    size += len(held[k][-1][0])
            if size >= COUNTED:
                yield from told()
                size = 0
    yield from told()


def _unpack(batches):
    for batch in batches:
        unpack = zstandard.ZstdDecompressor()
        texts = [unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("cal"), pa.array(texts, pa.string())], ["toxic", "cal", "text"])


def _pack(batches):
    for batch in batches:
        pack = zstandard.ZstdCompressor(level=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())], ["doc_id", "packed"])


def training_rows(docs: DataFrame, labels: DataFrame, max_labels: int = MAX_LABELS, calibration: int = CALIBRATION) -> DataFrame:
    """``text, toxic, cal`` of the documents to learn from; ``cal`` marks those held back."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    labels = labels.where(fold("doc_id", FOLDS) != HELD_OUT)
    n = labels.count()
    labels = labels.withColumn("cal", F.pmod(F.xxhash64("doc_id"), F.lit(max(HELD_BACK, -(-n // calibration)))) == 0)
    docs = docs.where((fold("doc_id", FOLDS) != HELD_OUT) & F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")
    if n <= max_labels:
        return docs.join(F.broadcast(labels), "doc_id").select("text", "toxic", "cal")
    packed = docs.mapInArrow(_pack, T.StructType([docs.schema["doc_id"], T.StructField("packed", T.BinaryType())]))
    return packed.join(labels, "doc_id").select("toxic", "cal", "packed").mapInArrow(_unpack, "toxic int, cal boolean, text string")


@dataclass
class Ratios:
    """Log ratios of n-grams and contexts, by sorted keys."""

    keys: np.ndarray
    ratio: np.ndarray

    def of(self, words: Words) -> np.ndarray:
        """log p_toxic - log p_ordinary of every word."""
        if not len(words) or not len(self.keys):
            return np.zeros(len(words))
        _, first, where = np.unique(words.hashes(), return_index=True, return_inverse=True)
        out = np.zeros(len(first))
        for at in range(0, len(first), SPELLED):
            keys, grams = _spelled(words, first[at : at + SPELLED])
            value, known = self._find(keys)
            other = ~known
            value[other] = self._find(_contexts(keys[other]))[0]
            out[at : at + SPELLED] = np.bincount(np.repeat(np.arange(len(grams)), grams), value, len(grams))
        return out[where]

    def _find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = self.keys[at] == wanted
        return np.where(known, self.ratio[at], 0.0), known

    def features(self, words: Words) -> np.ndarray:
        """One row for each document: 1, number of words, the ratio by symbol of the whole text and of its best words, and the mean excess."""
        n, ratio, size = words.counts(), self.of(words), (words.ends - words.starts + 1).astype(np.float64)
        x = [np.ones(len(n)), np.log1p(n) / 5, _row_sums(ratio, words) / np.maximum(_row_sums(size, words), 1)]
        row, each = words.rows(), ratio / size
        order = np.lexsort((-each, row))
        rank = np.arange(len(order)) - words.bounds[:-1][row]  # rows stay in place
        for k in BEST:
            best = rank < k
            x.append(np.bincount(row[best], each[order][best], len(n)) / k)
        x.append(10 * _row_sums(np.maximum(ratio - MARGIN, 0), words) / np.maximum(n, 1))
        return np.stack(x, axis=1)


def _ratios(table: pa.Table | pa.StructArray) -> Ratios:
    keys, ratio = (np.asarray(table.column(c) if isinstance(table, pa.Table) else table.field(c)) for c in ("key", "ratio"))
    order = np.argsort(keys)
    return Ratios(keys[order].view(np.uint64), ratio[order])


@dataclass
class Model:
    """The table of log ratios, broadcast too if it is small, and the logistic regression; without a table a share alone."""

    weights: np.ndarray
    table: DataFrame | None = None  # key, ratio
    shared: Broadcast | None = None


def _row_sums(values: np.ndarray, words: Words) -> np.ndarray:
    return np.bincount(words.rows(), values, len(words.bounds) - 1)


def _discount(n1: int, n2: int) -> float:
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


def _empty(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.array([math.log(share / (1 - share))] + [0.0] * (FEATURES - 1)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _tally(df: DataFrame, column: str) -> tuple[int, float]:
    """Sum of the counts, and the discount from their counts of counts."""
    total, n1, n2 = df.agg(F.sum(column), F.sum(F.expr(f"int({column} = 1)")), F.sum(F.expr(f"int({column} = 2)"))).first()
    return total or 0, _discount(n1 or 0, n2 or 0)


def _suffix(n: int) -> Column:
    """The key of the last ``n`` symbols."""
    return F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)).bitwiseOR(F.lit(n << 56))


def _prefix(n: int) -> Column:
    """The key of the context of an n-gram of ``n`` symbols."""
    return F.shiftright(F.col("key").bitwiseAND(F.lit((1 << 8 * n) - 1)), 8).bitwiseOR(F.lit((n - 1) << 56))


def _gathered(table: DataFrame, entries: int) -> Ratios:
    """The table's entries; a part of them at a time, as the driver holds little besides."""
    parts = -(-entries * ENTRY // GATHERED) or 1
    keys, ratio, at = np.zeros(entries, np.int64), np.zeros(entries, np.float32), 0
    for k in range(parts):
        part = table.where(F.pmod(F.xxhash64("key"), F.lit(parts)) == k).toArrow()
        keys[at : at + len(part)], ratio[at : at + len(part)] = part.column("key").to_numpy(), part.column("ratio").to_numpy()
        at += len(part)
    order = np.argsort(keys)
    return Ratios(keys[order].view(np.uint64), ratio[order])


def fit(rows: DataFrame, max_bytes: int = MAX_BYTES) -> Model:
    """Learn from ``text, toxic, cal`` rows."""
    counted = rows.where("NOT cal").select("text", "toxic").mapInArrow(_count, "key long, c0 long, c1 long")
    top = cut(counted.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")))
    (total0, d0), (total1, d1) = (_tally(top, c) for c in ("c0", "c1"))
    if not total0 or not total1:
        return _empty(rows.agg(F.avg("toxic")).first()[0] or 0.0)
    lower, longer = {}, top
    for n in range(ORDER - 1, 0, -1):
        longer = lower[n] = cut(longer.groupBy(_suffix(n).alias("key")).agg(F.count("*").alias("c")))
    backoff, shorter = F.lit(1.0 / (lower[1].count() + 1)), None
    for n in range(1, ORDER):
        d, context = _tally(lower[n], "c")[1], Window.partitionBy("h")
        here = lower[n].withColumn("h", _prefix(n))
        here = here.select("key", "c", F.sum("c").over(context).alias("total"), F.count("*").over(context).alias("types"))
        if shorter is not None:
            here, backoff = here.withColumn("s", _suffix(n - 1)).join(shorter, "s"), F.col("q")
        q = F.greatest(F.col("c") - d, F.lit(0.0)) / F.col("total") + d * F.col("types") / F.col("total") * backoff
        shorter = here.select(F.col("key").alias("s"), q.alias("q"))
    by_context = top.groupBy(_prefix(ORDER).alias("h")).agg(*[F.sum(f"c{k}").alias(f"h{k}") for k in (0, 1)], *[F.sum(F.expr(f"int(c{k} > 0)")).alias(f"t{k}") for k in (0, 1)])
    left = [F.when(F.col(f"h{k}") > 0, d * F.col(f"t{k}") / F.col(f"h{k}")).otherwise(1.0).alias(f"b{k}") for k, d in enumerate((d0, d1))]
    by_context = cut(by_context.select("h", "h0", "h1", *left))
    own = [F.when(F.col(f"h{k}") > 0, F.greatest(F.col(f"c{k}") - d, F.lit(0.0)) / F.col(f"h{k}")).otherwise(0.0) + F.col(f"b{k}") * F.col("q") for k, d in enumerate((d0, d1))]
    whole = top.withColumn("h", _prefix(ORDER)).withColumn("s", _suffix(ORDER - 1)).join(by_context, "h").join(shorter, "s")
    table = cut(whole.select("key", (F.log(own[1]) - F.log(own[0])).cast("float").alias("ratio")).unionByName(by_context.select(F.col("h").alias("key"), (F.log("b1") - F.log("b0")).cast("float").alias("ratio"))))
    model, entries = Model(np.zeros(FEATURES), table), table.count()
    if entries * ENTRY <= max_bytes:
        model.shared = rows.sparkSession.sparkContext.broadcast(_gathered(table, entries))
    return _calibrate(model, rows.where("cal"))


_NAMES = [f"x{k}" for k in range(FEATURES)]


def _named(batch: pa.RecordBatch, keep: list[str], parts: list[np.ndarray]) -> pa.RecordBatch:
    x = np.concatenate(parts) if parts else np.zeros((0, FEATURES))
    return pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(c)) for c in x.T], [*keep, *_NAMES])


def features(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and the inputs of the logistic regression of every document."""
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.DoubleType()) for c in _NAMES])
    docs = docs.select(*dict.fromkeys([*keep, text]))
    none = Ratios(np.zeros(0, np.uint64), np.zeros(0))
    if model.table is None or model.shared is not None:  # nothing to join
        shared = model.shared

        def run(batches):
            ratios = none if shared is None else shared.value
            for batch in batches:
                yield _named(batch, keep, [ratios.features(words) for _, _, words in word_slices(batch.column(text), ALNUM, LOWER)])

        return docs.mapInArrow(run, schema)

    def ask(batches):
        for batch in batches:
            for lo, _, words in word_slices(batch.column(text), ALNUM, LOWER):
                for r, (a, z) in enumerate(zip(words.bounds[:-1], words.bounds[1:], strict=True)):
                    first = a + np.unique(words.hashes()[a:z], return_index=True)[1]
                    for at in range(0, len(first), SPELLED):
                        keys = np.unique(_spelled(words, first[at : at + SPELLED])[0])
                        keys = np.unique(np.concatenate([keys, _contexts(keys)]))
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), batch.column("__row")[lo + r].as_py())), as_long(keys)], ["__row", "key"])

    def told(batches):
        for batch in batches:
            parts, found = [], batch.column("__told")
            for r in range(batch.num_rows):
                mine = found.slice(r, 1).flatten()
                own = _ratios(mine) if len(mine) else none
                parts += [own.features(words) for _, _, words in word_slices(batch.column(text).slice(r, 1), ALNUM, LOWER)]
            yield _named(batch, keep, parts)

    docs = cut(docs.withColumn("__row", F.monotonically_increasing_id()))
    asked = docs.select("__row", text).mapInArrow(ask, "__row long, key long")
    # at most the n-grams of a document
    found = asked.distinct().join(model.table, "key").groupBy("__row").agg(F.collect_list(F.struct("key", "ratio")).alias("__told"))
    return docs.join(found, "__row", "left").mapInArrow(told, schema)


def _calibrate(model: Model, rows: DataFrame) -> Model:
    found = features(rows.select("text", "toxic"), model, ["toxic"]).toArrow()
    x = np.stack([found.column(c).to_numpy() for c in _NAMES], axis=1) if len(found) else np.zeros((0, FEATURES))
    y = found.column("toxic").to_numpy().astype(np.float64) if len(found) else np.zeros(0)
    order = np.lexsort((*x.T, y))  # the same sums in every run
    x, y = x[order], y[order]
    model.weights = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([-3.0, 0.0, 1.0, 1.0, *[0.0] * (FEATURES - 4)])
    return model


def score_documents(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``score`` of every document."""
    keep_as = [f"k{k}" for k in range(len(keep))]  # a column may be called as an input is
    docs = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, keep_as, strict=True)], F.col(text).alias("__text"))
    x = features(docs, model, keep_as, "__text")
    logit = sum((F.col(c) * float(w) for c, w in zip(_NAMES[1:], model.weights[1:], strict=True)), F.lit(float(model.weights[0])))
    score = 1 / (1 + F.exp(-F.greatest(F.least(logit, F.lit(30.0)), F.lit(-30.0))))
    return x.select(*[F.col(k).alias(c) for c, k in zip(keep, keep_as, strict=True)], score.alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None, threshold: float = THRESHOLD, max_labels: int = MAX_LABELS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``keep`` columns, ``held_out``, ``score`` and ``predicted`` of every document."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("held_out", "score", "predicted")]
    model = fit(training_rows(docs, labels, max_labels), max_bytes)
    scored = score_documents(docs.withColumn("__fold", fold("doc_id", FOLDS)), model, [*keep, "__fold"])
    return scored.select(*keep, (F.col("__fold") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
