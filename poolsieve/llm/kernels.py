"""Vectorised text kernels shared by the Arrow-batched operators.

A batch of texts is handled as one flat byte array, in slices of whole rows,
so no Python object is made per word.  Hashes have 64 bits.  Every byte is mixed
with its place before it is summed, and every word before it is chained, so
no pattern of bytes or words cancels out.  They propose matches; callers
confirm on the words, on a cryptographic digest of them, or on a second hash
that is independent of the first.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa

#: Bytes of text handled at once; a longer row is a slice of its own.
SLICE_BYTES = 1 << 20

#: Seeds of the two independent hashes.
_SEEDS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03))
_STEPS = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))

WHITESPACE = bytes([0x20, *range(0x09, 0x0E)])

#: Byte tables: identity, and A-Z lower-cased.
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

#: True where a byte belongs to a word.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[list(WHITESPACE)] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on all of them."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


#: Places in a word whose values are kept in a table; a power of two.
_PLACES = 32


def _values(code: np.ndarray, which: int) -> np.ndarray:
    """A mixed value for every place and byte, ``place * 256 + byte``."""
    return mix(mix(code.astype(np.uint64) * _STEPS[which] + _SEEDS[which]))


@lru_cache(maxsize=2)
def _spread(which: int) -> np.ndarray:
    return _values(np.arange(_PLACES * 256), which)


class Words:
    """The words of consecutive rows: byte spans, hashes, and each row's range of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, table: np.ndarray = SAME):
        self.data = data if table is SAME else table[data]
        #: For bytes.translate: what is in no word becomes a space.
        self.blank = np.where(is_word[SAME], SAME, 0x20).astype(np.uint8).tobytes()
        inside = is_word[data]
        first, last = inside.copy(), inside.copy()
        if len(data):
            first[1:] &= ~inside[:-1]
            last[:-1] &= ~inside[1:]
            rows = offsets[1:-1]
            rows = rows[(rows > 0) & (rows < len(data))]
            first[rows] = inside[rows]
            last[rows - 1] = inside[rows - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: Row r has the words bounds[r] .. bounds[r + 1] - 1.
        self.bounds = np.searchsorted(self.starts, offsets)
        self._hashes: dict[int, np.ndarray] = {}

    def __len__(self) -> int:
        return len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def row_ends(self) -> np.ndarray:
        """For each word, the index after the last word of its row."""
        return np.repeat(self.bounds[1:], self.counts())

    def rows(self) -> np.ndarray:
        """For each word, its row."""
        return np.repeat(np.arange(len(self.bounds) - 1), self.counts())

    def _inside(self) -> np.ndarray:
        """The positions of all bytes of words."""
        size = self.ends - self.starts
        return np.arange(size.sum()) + np.repeat(self.starts - (np.cumsum(size) - size), size)

    def hashes(self, which: int = 0) -> np.ndarray:
        """The sum over a word's bytes of a mixed value for each byte and its place, mixed again with the length."""
        if which not in self._hashes:
            place = np.zeros(len(self.data), dtype=np.int64)
            size, inside = self.ends - self.starts, self._inside()
            place[inside] = inside - np.repeat(self.starts, size)
            code = (place << 8) + self.data
            values = _spread(which)[code & (_PLACES * 256 - 1)]
            far = np.flatnonzero(place >= _PLACES)
            values[far] = _values(code[far], which)
            sums = np.zeros(len(self.data) + 1, dtype=np.uint64)
            np.cumsum(values, out=sums[1:])
            self._hashes[which] = mix(sums[self.ends] - sums[self.starts] + size.astype(np.uint64))
        return self._hashes[which]

    def grams(self, start: np.ndarray, length: np.ndarray | int, which: int = 0) -> np.ndarray:
        """Hashes of the runs of ``length`` words that begin at ``start``; costs a few steps for each word of a run."""
        if not np.isscalar(length):
            out = np.zeros(len(start), dtype=np.uint64)
            for n in np.unique(length).tolist():
                out[length == n] = self.grams(start[length == n], n, which)
            return out
        words, step = self.hashes(which), _STEPS[which]
        out = np.full(len(start), np.uint64(length) + _SEEDS[1 - which], dtype=np.uint64)
        for k in range(length):
            out ^= words[start + k]
            out *= step
            out ^= out >> np.uint64(32)
        return mix(out)

    def text(self, start: int, length: int) -> bytes:
        """The words themselves, joined by one space."""
        if not length:
            return b""
        whole = self.data[self.starts[start] : self.ends[start + length - 1]].tobytes()
        return b" ".join(whole.translate(self.blank).split())

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of BLAKE2 over the words of every row, joined by one space."""
        told = b"".join([blake2b(self.text(int(a), int(n)), digest_size=16).digest() for a, n in zip(self.bounds[:-1], self.counts(), strict=True)])
        both = np.frombuffer(told, dtype=np.uint64).reshape(-1, 2)
        return both[:, 0].copy(), both[:, 1].copy()

    def joined(self) -> tuple[bytes, np.ndarray]:
        """All words joined by one space, and where each begins; the last entry is one beyond the end."""
        at = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(self.ends - self.starts + 1, out=at[1:])
        out = np.full(at[-1], 0x20, dtype=np.uint8)
        inside = self._inside()
        out[inside + np.repeat(at[:-1] - self.starts, self.ends - self.starts)] = self.data[inside]
        return out.tobytes(), at


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows ``(lo, hi, bytes, offsets)`` of about ``limit`` bytes; null counts as empty."""
    if len(texts) == 0:
        return
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        hi = min(hi, len(texts))
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def word_slices(texts: pa.Array, is_word: np.ndarray, table: np.ndarray = SAME, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, data, offsets in slices(texts, limit):
        yield lo, hi, Words(data, offsets, is_word, table)


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches cut into few rows each, for code that makes Python strings of them."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def as_long(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit hashes as Spark longs."""
    return pa.array(values.view(np.int64))
