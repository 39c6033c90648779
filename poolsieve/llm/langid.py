"""Language identification by sparse multinomial logistic regression.

Features are the character 1-, 2- and 3-grams of the whole text, hashed to DIM
places, as (1 + log count) * idf, scaled to unit length.  Characters are lower
case; whatever is not a letter is one blank.  Document frequencies cover every
document that may be learned from and are summed by the cluster.

The regression is fitted on the driver by follow-the-regularised-leader with
elastic-net penalties (FTRL-Proximal), which keeps most weights at exactly
zero, on a sample of about SAMPLE documents that favours no language; a part
of it is held back to fit one temperature for the probabilities.  A hash of id
and text draws it, so that it does not depend on how the rows are split.

Null texts and texts without letters are ``und`` with score 0, and so is every
text if there is nothing to learn from.  Texts are read whole, however long.
Repeated rows are predicted each; copies under other ids are drawn each, repeats of
one row together, and at most twice the sample is taken.  Of languages that tie, the
first in order is taken.  An empty table gives an empty result.  A kept column
that is called as a result is gives way to it.  Documents without an id are scored;
their id counts as the empty text in the fold.  Null languages are not learned.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.llm.kernels import pieces

DIM = 1 << 14
ORDERS = (1, 2, 3)
FOLDS, HELD_OUT = 4, 2
#: Documents that the fit may see, about, over all languages.
SAMPLE = 4000
#: One sampled document in so many sets the temperature.
HELD_BACK = 5
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.001
UNKNOWN = "und"

_ROWS = 64
_CHARS = 1 << 20
_FACTORS = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """True where a code point is a letter."""
    found = np.zeros(0x110000, dtype=bool)
    found[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return found


def _slices(texts: list[str | None]):
    """Rows ``lo`` to ``hi``, few at a time, with their characters in one array."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and hi - lo < _ROWS and (hi == lo or size < _CHARS):
            size += len(texts[hi] or "")
            hi += 1
        lowered = [(t or "").lower() for t in texts[lo:hi]]
        chars = np.frombuffer("".join(lowered).encode("utf-32-le", "replace"), dtype=np.uint32)
        yield lo, hi, chars, np.cumsum([0, *map(len, lowered)])
        lo = hi


def features(texts: list[str | None]):
    """Counts of the hashed n-grams: ``(lo, hi, counts, has letters)`` for few rows at a time."""
    letters = _letters()
    for lo, hi, chars, bounds in _slices(texts):
        rows = np.repeat(np.arange(hi - lo), np.diff(bounds))
        is_letter = letters[chars]
        some = np.zeros(hi - lo, dtype=bool)
        some[rows[is_letter]] = True
        chars = np.where(is_letter, chars, 0x20)
        keep = np.ones(len(chars), dtype=bool)  # one blank between words
        if len(chars):
            keep[1:] = (chars[1:] != 0x20) | (chars[:-1] != 0x20) | (rows[1:] != rows[:-1])
        chars, rows = chars[keep], rows[keep]
        counts = np.zeros((hi - lo) * DIM, dtype=np.float64)
        h = np.zeros(len(chars), dtype=np.uint32)
        for order in ORDERS:
            n = len(chars) - order + 1
            if n <= 0:
                break
            h = (h[:n] ^ chars[order - 1 :].astype(np.uint32)) * _FACTORS[order - 1]
            h ^= h >> np.uint32(15)
            inside = rows[:n] == rows[order - 1 :]
            counts += np.bincount(rows[:n][inside] * DIM + (h[inside] % np.uint32(DIM)).astype(np.int64), minlength=len(counts))
        yield lo, hi, counts.reshape(hi - lo, DIM), some


def _frequencies(batches):
    """How many documents of the partition hold each feature; feature -1 counts the documents."""
    total, n = np.zeros(DIM, dtype=np.int64), 0
    for batch in pieces(batches):
        for lo, hi, counts, _ in features(batch.column(0).to_pylist()):
            total += (counts > 0).sum(axis=0)
            n += hi - lo
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[total[at], n])], ["feature", "df"])


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (DIM + 1, languages), the last row the intercept
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return _weigh(counts, self.idf) @ self.weights[:-1] + self.weights[-1]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not self.langs:
            return langs, scores
        for lo, _, counts, some in features(texts):
            p = _softmax(self.logits(counts) / self.temperature)
            best = p.argmax(axis=1)
            for r in np.flatnonzero(some).tolist():
                langs[lo + r], scores[lo + r] = self.langs[best[r]], min(p[r, best[r]], 1.0)
        return langs, scores


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _ftrl(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int) -> np.ndarray:
    """FTRL-Proximal over sparse rows ``(features, values)``."""
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return float(-np.log(np.maximum(p, 1e-300)).mean())

    a, b, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def _sparse(batches):
    for batch in pieces(batches):
        at, n, lang = [], [], batch.column("lang").to_pylist()
        for _, _, counts, _ in features(batch.column("text").to_pylist()):
            for row in counts:
                f = np.flatnonzero(row)
                at.append(f)
                n.append(row[f])
        yield pa.RecordBatch.from_arrays([batch.column("u"), pa.array(lang, pa.string()), batch.column("part"), pa.array(at, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.float32()))], ["u", "lang", "part", "at", "n"])


def fold(doc_id: str) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``doc_id, text, lang``, leaving out the held-out fold."""
    rows = docs.where((fold("doc_id") != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    df, n = np.zeros(DIM), 0
    for f, c in rows.select("text").mapInArrow(_frequencies, "feature long, df long").groupBy("feature").agg(F.sum("df")).collect():  # DIM + 1 rows at most
        if f < 0:
            n = c
        else:
            df[f] = c
    idf = np.log((1 + n) / (1 + df)) + 1
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return Model([], idf, np.zeros((DIM + 1, 0)), 1.0)
    each = max(1, sample // len(sizes))
    share = F.create_map(*[x for k, c in sizes.items() for x in (F.lit(k), F.lit(min(1.0, each / c)))])
    u = F.pmod(F.xxhash64(F.lit(11), F.col("doc_id").cast("string"), "text"), F.lit(1 << 52)) / F.lit(float(1 << 52)) / share[F.col("lang")]
    part = F.pmod(F.xxhash64("text"), F.lit(HELD_BACK)).cast("int")
    chosen = rows.select(u.alias("u"), "lang", part.alias("part"), "text").where("u < 1").mapInArrow(_sparse, "u double, lang string, part int, at array<int>, n array<float>")
    found = chosen.orderBy("u", "lang", "part").limit(2 * max(sample, len(sizes))).collect()  # about `sample` rows
    found.sort(key=lambda r: (r.lang, len(r.at), r.at, r.n))
    langs = sorted(sizes)
    y = np.array([langs.index(r.lang) for r in found], dtype=np.int64)
    data = []
    for r in found:
        at = np.array(r.at, dtype=np.int64)
        x = np.log1p(np.array(r.n)) * idf[at]
        data.append((np.r_[at, DIM], np.r_[x / max(np.linalg.norm(x), 1e-12), 1.0]))
    back = np.array([r.part == 0 for r in found], dtype=bool)
    train = [d for d, b in zip(data, back, strict=True) if not b]
    weights = _ftrl(train, y[~back], len(langs))
    logits = np.array([x @ weights[at] for (at, x), b in zip(data, back, strict=True) if b]).reshape(-1, len(langs))
    return Model(langs, idf, weights, _temperature(logits, y[back]))


def identify(docs: DataFrame, keep: list[str] | None = None, sample: int = SAMPLE) -> DataFrame:
    """``keep`` columns, ``held_out``, ``lang_pred`` and ``score`` of every document."""
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in ("held_out", "lang_pred", "score")] + ["__fold"]
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, sample))
    docs = docs.withColumn("__fold", fold("doc_id"))

    def run(batches):
        for batch in pieces(batches):
            langs, scores = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores)], [*keep, "lang_pred", "score"])

    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    found = docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
    return found.select(*[c for c in keep if c != "__fold"], (F.col("__fold") == HELD_OUT).alias("held_out"), "lang_pred", "score")
