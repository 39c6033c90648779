"""Spelling variants: words of a corpus that are one edit apart, each tied to its commonest neighbour.

Two words are near if exactly one inserted, deleted or replaced code point
tells them apart.  Deleting one code point of either, or none of the shorter,
then gives the same string, so words are keyed by their deletions:

1. prefix and suffix polynomial hashes, modulo two primes of 31 bits, give the
   hash of a word without its i-th code point in a few operations on integers,
   for all words and places of a batch at once.  Deletions within a run of equal
   letters are equal and share a row, which holds the run's first and last place;
2. the keys are radix-partitioned (by their leading bits) and sorted; those that
   only one word has end there;
3. words are fetched for the others, and within equal keys only rows whose
   deletions are equal strings stay together.

Words with the same deletion at the same place are replacements of each other;
a word that is itself the deletion is one letter short of all others of its key.
Neither kind of group is written out as pairs: each word gets the size of its
groups and the commonest other member.  A key's words differ by one inserted
letter, so their number is bounded by the alphabet and the length of a word,
whatever the corpus holds.

Forms have at least twice the count of their words, so chains of forms have no
cycles and at most log2 of the largest count in links; they are followed by
doubling.

Null and empty texts have no words; texts are read whole, however long, and an
empty table gives an empty result.  Only the two named columns are read.  A
document without an id counts as one whose id is the empty string.  Rows that
repeat count again.  Of equally common neighbours the smallest in code-point
order counts.  A word is held whole in a task, with some 60 bytes for each letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolsieve.llm.components import cut, discard

#: What a word is made of, the least code points and occurrences of one, and the share of runs misspelt on purpose.
LETTERS = r"[A-Za-zÀ-ÿ]"
LEAST_CHARS = 5
LEAST_COUNT = 3
MISSPELT = 97
#: A form is at least so many times as common as its word.
COMMONER = 2

_PRIMES = (2147483647, 2147483629)
_BASES = (1103515245, 1664525)
#: Leading bits of a 62-bit key that deal it to a partition.
_RADIX = 16
#: Letters hashed at once; a longer word is handled by itself.
_LETTERS_AT_ONCE = 1 << 18
#: Rows of whole keys settled at once.
_ROWS_AT_ONCE = 1 << 14

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", misspelt: int = MISSPELT) -> DataFrame:
    """``word, n``: lower-cased words of the corpus with one code point of every ``misspelt``-th run deleted."""
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{LEAST_CHARS},}})"))).alias("run"))
    low = runs.select("d", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _UPPER, _LOWER)).otherwise(F.col("run")).alias("run"))
    hashed = low.select("run", F.crc32(F.concat("d", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.col("h") % F.length("run")
    short = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", (at + 2).cast("int"), F.length("run")))
    words = hashed.select(F.when(F.col("h") % misspelt == 0, short).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_CHARS)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _powers(base: int, p: int, n: int) -> np.ndarray:
    """``base ** k % p`` for k below ``n``, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step) % np.uint64(p)
        have, step = have + more, step * step % p
    return out


def _keys(letters: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 62-bit keys of every word without each of its letters, and of every whole word."""
    first = np.repeat(start, size)
    place = np.arange(len(letters)) - first
    without, whole = np.zeros(len(letters), np.uint64), np.zeros(len(start), np.uint64)
    for base, prime in zip(_BASES, _PRIMES, strict=True):
        p = np.uint64(prime)
        sums = np.zeros(len(letters) + 1, np.uint64)
        np.cumsum((letters + np.uint64(1)) * _powers(base, prime, int(size.max(initial=0)))[place] % p, out=sums[1:])
        total = sums[start + size] - sums[start]
        prefix = sums[:-1] - sums[first]
        suffix = (np.repeat(sums[start + size], size) - sums[1:]) % p * np.uint64(pow(base, -1, prime)) % p
        without = (without << np.uint64(31)) | (prefix + suffix) % p
        whole = (whole << np.uint64(31)) | total % p
    return without.view(np.int64), whole.view(np.int64)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, first, last, wid`` for every run of equal letters of every word, and with places -1 for the word itself."""
    for batch in batches:
        words, wid = batch.column("word").to_pylist(), batch.column("wid").to_numpy()
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        lo = 0
        while lo < len(words):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + _LETTERS_AT_ONCE, side="right")))
            size = sizes[lo:hi]
            start = np.cumsum(size) - size
            letters = np.frombuffer("".join(words[lo:hi]).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            without, whole = _keys(letters, start, size)
            new = np.ones(len(letters), dtype=bool)
            new[1:] = letters[1:] != letters[:-1]
            new[start] = True
            at = np.flatnonzero(new)
            last = np.r_[at[1:], len(letters)] - 1
            owner = np.repeat(np.arange(hi - lo), size)[at]
            none = np.full(hi - lo, -1)
            columns = (
                np.r_[without[at], whole],
                np.r_[at - start[owner], none].astype(np.int32),
                np.r_[last - start[owner], none].astype(np.int32),
                np.r_[wid[lo:hi][owner], wid[lo:hi]],
            )
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "first", "last", "wid"])
            lo = hi


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows those whose key the row before or behind has too."""
    held, before = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = pa.Table.from_batches([batch])
        now = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
        key = now.column("key").to_numpy()
        same = np.zeros(len(key), dtype=bool)
        same[1:] = key[1:] == key[:-1]
        same[0] = key[0] == before
        same[:-1] |= same[1:] & (key[1:] == key[:-1])
        held, before = now.slice(len(key) - 1), (key[-2] if len(key) > 1 else before)
        yield from now.slice(0, len(key) - 1).filter(pa.array(same[:-1])).to_batches()
    if held is not None and held.column("key")[0].as_py() == before:
        yield from held.to_batches()


def _whole_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Sorted rows in tables of some size that hold all rows of their keys."""
    held: list[pa.Table] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < _ROWS_AT_ONCE:
            continue
        now = pa.concat_tables(held).combine_chunks()
        key = now.column("key").to_numpy()
        end = int(np.searchsorted(key, key[-1]))  # keys are sorted, so the last one may go on
        if end:
            yield now.slice(0, end)
        held, rows = [now.slice(end)], len(now) - end
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def _first_of(group: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in ``order`` by group: the position of each group's first row, its size, and each row's group number."""
    g = group[order]
    new = np.ones(len(g), dtype=bool)
    new[1:] = g[1:] != g[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.r_[first, len(g)]), np.cumsum(new) - 1


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, near, best_n, best``: what each key tells of its words."""
    for rows in _whole_keys(batches):
        words = np.array(rows.column("word").to_pylist(), dtype=object)
        key, first, last, n = (rows.column(c).to_numpy() for c in ("key", "first", "last", "n"))
        # equal keys count only where the strings are equal
        left = pa.array([w if a < 0 else w[:a] + w[a + 1 :] for w, a in zip(words, first.tolist(), strict=True)], pa.large_string())
        text = left.dictionary_encode().indices.to_numpy()
        group = np.unique(np.stack([key, text.astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        rank = np.unique(words, return_inverse=True)[1]
        _, once = np.unique(np.stack([group, first.astype(np.int64), rank]), axis=1, return_index=True)
        group, first, last, n, rank, words = (x[once] for x in (group, first, last, n, rank, words))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # rows, their near words, the best of them

        deleted = np.flatnonzero(first >= 0)
        if len(deleted):
            # runs of letters stand at each place of theirs that another row of the group names
            span = int(last.max()) + 1
            places = np.unique(np.r_[group[deleted] * span + first[deleted], group[deleted] * span + last[deleted]])
            lo = np.searchsorted(places, group[deleted] * span + first[deleted])
            hi = np.searchsorted(places, group[deleted] * span + last[deleted], side="right")
            row = np.repeat(deleted, hi - lo)
            place = np.arange(len(row)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            order = np.lexsort((rank[row], -n[row], place))
            begin, size, number = _first_of(place, order)
            row = row[order]
            best, second = row[begin], row[np.minimum(begin + 1, len(row) - 1)]
            several = size[number] > 1
            top = np.where(row == best[number], second[number], best[number])
            out.append((row[several], size[number][several] - 1, top[several]))

        whole = np.flatnonzero(first < 0)
        if len(whole) and len(deleted):
            order = np.lexsort((rank[deleted], -n[deleted], group[deleted]))
            longer = deleted[order]
            begin, size, _ = _first_of(group[deleted], order)
            have = group[longer[begin]]
            at = np.minimum(np.searchsorted(have, group[whole]), len(have) - 1)
            found = have[at] == group[whole]
            short, at = whole[found], at[found]
            out.append((short, size[at], longer[begin[at]]))
            of = np.full(int(group.max()) + 1, -1)
            of[group[short]] = short
            longer = longer[of[group[longer]] >= 0]
            out.append((longer, np.ones(len(longer), dtype=np.int64), of[group[longer]]))
        if out:
            row, near, best = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(words[row], pa.string()), pa.array(near, pa.int64()), pa.array(n[best], pa.int64()), pa.array(words[best], pa.string())], ["word", "near", "best_n", "best"])


def _by_key(rows: DataFrame) -> DataFrame:
    """Radix-partitioned by the leading bits of the keys, and sorted."""
    return rows.repartition(F.shiftright("key", 62 - _RADIX)).sortWithinPartitions("key")


def near_words(words: DataFrame) -> DataFrame:
    """``word, n_near, best, best_n`` of distinct words ``word, n`` that have near words."""
    words = words.select("word", "n", F.xxhash64("word").alias("wid"))
    keys = _by_key(words.select("word", "wid").mapInArrow(_deletions, "key long, first int, last int, wid long"))
    shared = keys.mapInArrow(_not_alone, "key long, first int, last int, wid long")
    told = _by_key(shared.join(words, "wid").drop("wid")).mapInArrow(_settle, "word string, near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), "best"))
    return told.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.best").alias("best"), (-F.col("b.less")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for rows ``word, form`` without cycles: the last form that a word leads to."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = cut(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(now)
        now = new
        if now.where("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", misspelt: int = MISSPELT) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the corpus."""
    words = cut(word_counts(docs, doc_id, text, misspelt))
    found: Column = F.col("best_n") >= COMMONER * F.col("n")
    joined = words.join(near_words(words), "word", "left")
    told = cut(joined.select("word", F.when(found, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(found, F.col("best_n")).alias("form_n")))
    ends = roots(told.where("form IS NOT NULL"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
