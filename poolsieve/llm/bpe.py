"""BPE encoding and decoding by a tokenization automaton.

The automaton reads tokens and accepts exactly the token sequences that the
merge list produces.  It starts as one state that every base symbol loops on.
Each merge ``u v -> w``, in order of priority, is one gadget on it: the arcs on
``u`` are redirected to a copy of their target that lacks the arc on ``v``, and
beside each of them an arc on ``w`` leads to where ``u v`` led before.

All arcs on one token lead to one state, so a state is known by the token read
last, and it is the chain of copies made of it: its own, then those its right
part had been through when the token came to be.  An arc therefore exists
unless a copy in that chain dropped it, or dropped the left part it grew from
before it did.  The gadgets are kept as arrays, which are made once and sent to
the workers; the transition table is filled from them as it is used.

Over base symbols every string has one accepted path, and so has each prefix
of it.  Encoding walks the positions of a word and keeps the one state each
prefix leads to; decoding emits the labels of the arcs.  All the words of a
slice are walked at once, one position after another; the few longest of them
are walked by themselves, as arrays of few words cost more than they save.

The text side does what the tokenizer file names: added tokens are cut out of
the raw text, the rest is NFC, each white-space run a space, lower case, and
split by the pattern; each piece is spelled in byte symbols, the last of which
carries the word-end mark.  Pieces are cut from the bytes of a slice by the kinds
of their characters, and equal pieces of a slice are walked once.

Null texts count as empty; empty texts have no tokens.  Texts are read whole,
however long.  Rows that repeat, with or without an id, are encoded each and
alike, and nothing ties: a text has one path.  An empty table gives an empty
result.  Kept columns may have any name; one that is called as a result is gives
way to it.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from poolsieve.llm.kernels import pieces

#: Pieces that a worker keeps encoded, and entries of its transition tables: by arrays of pairs, a power of two, and by single pairs.
MAX_KEPT = 300_000
TABLE_SLOTS = 1 << 19
MAX_TABLE = 250_000
#: Bytes of text encoded at once; a longer row is a slice of its own.
SLICE_BYTES = 4 << 20
#: From so many words on they are walked at once, fewer each by itself; about as fast at 1,400.
FEW = 1000

_SPACE = "\t\n\v\f\r \x85\xa0  -     　"

#: Kinds of characters; those from NUMBER on are pieces of their own.
SPACE, LETTER, OTHER, NUMBER, ADDED = range(5)
#: The pattern of pieces that is cut by kinds; others are left to the regex module.
_BY_KINDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The byte that begins an added token in a slice; its id follows in four bytes.
_ADDED = 0xFF

def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(other)) for b in range(256)]


class PairTable:
    """Values by pairs of tokens, packed as ``a << 20 | b``, looked up for whole arrays."""

    def __init__(self, known: dict[int, int]):
        keys, values = np.fromiter(known.keys(), np.int64, len(known)), np.fromiter(known.values(), np.int32, len(known))
        bits = max(4, (4 * len(known)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo, slot = np.arange(len(keys)), self._slot(keys)
        while todo.size:
            at = slot[todo]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[todo[free]]
            put = self.keys[at] == keys[todo]
            self.values[at[put]] = values[todo[put]]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return slots(keys, self.shift)

    def get(self, keys: np.ndarray, missing: int) -> np.ndarray:
        slot = self._slot(keys)
        held = self.keys[slot]
        out = np.where(held == keys, self.values[slot], np.int32(missing))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        while todo.size:
            at = (slot[todo] + 1) & self.mask
            slot[todo], held = at, self.keys[at]
            same = held == keys[todo]
            out[todo[same]] = self.values[at[same]]
            todo = todo[~same & (held >= 0)]
        return out


def slots(keys: np.ndarray, shift: np.uint64) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)


class MergeAutomaton:
    """Tokens are ints; ``labels`` are their strings."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], added: tuple[int, ...] = ()):
        """``added`` are further tokens that are symbols of their own."""
        self.labels = {i: s for s, i in vocab.items()}
        made = {a + b for a, b in merges}
        #: For each token: when its merge ran, and its parts; base symbols are there from the start.
        self.born: dict[int, int] = {i: -1 for s, i in vocab.items() if s not in made}
        self.parts: dict[int, tuple[int, int]] = {}
        #: When the arc on v was dropped from the state after u.
        self.dropped: dict[tuple[int, int], int] = {}
        #: Tokens that no string leads to, as their parts never meet.
        self.idle: set[int] = set()
        self.table: dict[int, bool] = {}
        for time, (a, b) in enumerate(merges):
            self._gadget(time, vocab[a], vocab[b], vocab[a + b])
        self.symbols = {self.labels[t]: t for t in self.born}
        self._flatten(added)

    def _gadget(self, time: int, u: int, v: int, w: int) -> None:
        if not all(t in self.born or t in self.idle for t in (u, v)) or w in self.born or w in self.idle:
            raise ValueError("a merge comes before those of its parts, or makes a token again")
        if u in self.born and v in self.born and self._arc(u, v, time - 1):
            self.born[w] = time
            self.parts[w] = (u, v)
            self.dropped[u, v] = time
        else:
            self.idle.add(w)

    def _flatten(self, added: tuple[int, ...]) -> None:
        """The gadgets as arrays, and a trie of the tokens' symbols, the last one first."""
        n = max([*self.labels, *added], default=0) + 1
        self.born_at, self.left, self.right = (np.full(n, -1, np.int32) for _ in range(3))
        for w, (u, v) in self.parts.items():
            self.born_at[w], self.left[w], self.right[w] = self.born[w], u, v
        self.drops = PairTable({u << 20 | v: time for (u, v), time in self.dropped.items()})
        spelled: dict[int, tuple[int, ...]] = {}
        child: dict[int, int] = {}
        ends = [-1]
        for t in [*self.born, *added]:  # parts come before what is made of them
            spelled[t] = spelled[self.parts[t][0]] + spelled[self.parts[t][1]] if t in self.parts else (t,)
            node = 0
            for symbol in reversed(spelled[t]):
                node = child.setdefault(node << 20 | symbol, len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = t
        #: For each node of the trie the token that ends there, or -1.
        self.ends = np.array(ends, np.int32)
        self.children = PairTable(child)
        #: The tokens by their symbols, as characters.
        self.tokens = {"".join(map(chr, symbols)): t for t, symbols in spelled.items()}
        self.seen: tuple[np.ndarray, np.ndarray] | None = None

    def _arc(self, last: int, token: int, now: int) -> bool:
        """Whether, after the gadgets up to ``now``, the state after ``last`` has an arc on ``token``."""
        while True:
            state, until = last, now
            while True:
                if self.dropped.get((state, token), until + 1) <= until:
                    return False
                if state not in self.parts:
                    break
                until = min(until, self.born[state] - 1)
                state = self.parts[state][1]
            if token not in self.parts:
                return True
            now = min(now, self.born[token])
            token = self.parts[token][0]

    def _arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``_arc`` after all gadgets, for arrays of pairs."""
        never = np.iinfo(np.int32).max
        out = np.zeros(len(last), bool)
        row, now = np.arange(len(last)), np.full(len(last), never - 1, np.int32)
        while row.size:
            left = np.ones(len(row), bool)  # pairs that no copy refuses
            walk, state, until = np.arange(len(row)), last, now
            while walk.size:
                on = self.drops.get(state.astype(np.int64) << 20 | token[walk], never) > until
                left[walk[~on]] = False
                on &= self.right[state] >= 0
                walk, state, until = walk[on], state[on], until[on]
                until, state = np.minimum(until, self.born_at[state] - 1), self.right[state]
            row, last, token, now = row[left], last[left], token[left], now[left]
            base = self.left[token] < 0
            out[row[base]] = True
            row, last, token, now = row[~base], last[~base], token[~base], now[~base]
            now, token = np.minimum(now, self.born_at[token]), self.left[token]
        return out

    def has_arc(self, last: int, token: int) -> bool:
        """The final table, filled on first use."""
        if len(self.table) >= MAX_TABLE:
            self.table.clear()
        known = self.table[last << 20 | token] = self._arc(last, token, len(self.parts) + len(self.idle))
        return known

    def have_arcs(self, last: np.ndarray, token: np.ndarray) -> np.ndarray:
        """The final table for arrays of pairs; a pair stays until another takes its slot."""
        if self.seen is None:
            self.seen = np.full(TABLE_SLOTS, -1, np.int64), np.zeros(TABLE_SLOTS, bool)
        held, known = self.seen
        keys = last.astype(np.int64) << 20 | token
        slot = slots(keys, np.uint64(65 - TABLE_SLOTS.bit_length()))
        out = known[slot]
        new = np.flatnonzero(held[slot] != keys)
        if new.size:
            out[new] = self._arcs(last[new], token[new])
            held[slot[new]] = keys[new]
            new = new[held[slot[new]] == keys[new]]  # of several new pairs in a slot one stays
            known[slot[new]] = out[new]
        return out

    def forget(self) -> None:
        self.table.clear()
        self.seen = None

    def walk(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of words that lie one behind another in ``symbols``, and each word's number of tokens."""
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        #: For each position the last token of the prefix that ends there, and where that token begins.
        last, came = np.zeros(len(symbols), np.int32), np.zeros(len(symbols), np.int64)
        order = np.argsort(-lengths, kind="stable")
        first, size = bounds[order], lengths[order]
        together = int(size[FEW - 1]) if len(size) >= FEW else 0
        for place in range(together):
            origin = first[: np.searchsorted(-size, -place)]
            stop = begin = origin + place
            node = np.zeros(len(origin), np.int64)
            while stop.size:  # each prefix has a path, so this ends
                node = self.children.get(node << 20 | symbols[begin], 0).astype(np.int64)
                token = self.ends[node]
                ok = token >= 0
                ask = np.flatnonzero(ok & (begin > origin))
                ok[ask] = self.have_arcs(last[begin[ask] - 1], token[ask])
                last[stop[ok]], came[stop[ok]] = token[ok], begin[ok]
                on = ~ok
                stop, origin, node, begin = stop[on], origin[on], node[on], begin[on] - 1
        for word in order[: np.searchsorted(-size, -together)]:
            self._walk_on(symbols, bounds[word], bounds[word + 1], together, last, came)
        closes = np.zeros(len(symbols), bool)
        first, stop = bounds[:-1][lengths > 0], bounds[1:][lengths > 0] - 1
        while stop.size > FEW // 50:
            closes[stop] = True
            stop = came[stop] - 1
            first, stop = first[stop >= first], stop[stop >= first]
        for begin, at in zip(first.tolist(), stop.tolist()):
            back, found = came[begin : at + 1].tolist(), []
            while at >= begin:
                found.append(at)
                at = back[at - begin] - 1
            closes[found] = True
        before = np.concatenate([[0], np.cumsum(closes)])[bounds]
        return last[closes], np.diff(before)

    def _walk_on(self, symbols: np.ndarray, first: int, end: int, place: int, last: np.ndarray, came: np.ndarray) -> None:
        """The rest of one word, from ``place`` on, by single steps."""
        word, find, table, arc = "".join(map(chr, symbols[first:end].tolist())), self.tokens.get, self.table.get, self.has_arc
        tokens, begins = last[first : first + place].tolist(), []
        for stop in range(place, len(word)):
            begin = stop
            while True:
                token = find(word[begin : stop + 1])
                if token is not None:
                    if begin == 0:
                        break
                    before = tokens[begin - 1]
                    ok = table(before << 20 | token)
                    if ok is None:
                        ok = arc(before, token)
                    if ok:
                        break
                begin -= 1
            tokens.append(token)
            begins.append(begin)
        last[first:end], came[first + place : end] = tokens, np.array(begins, np.int64) + first

    def encode(self, word: str, end: str = "") -> list[int]:
        """The tokens of the one accepted path over the characters of ``word``, the last of which has ``end`` behind it.

        Characters that the vocabulary lacks are left out.
        """
        told = [self.symbols.get(c) for c in word[:-1]] + [self.symbols.get(c + end) for c in word[-1:]]
        symbols = np.array([s for s in told if s is not None], np.int64)
        return self.walk(symbols, np.array([len(symbols)]))[0].tolist()


class Tokenizer:
    """A tokenizer file's text side around its automaton."""

    def __init__(self, spec: dict):
        model = spec["model"]
        end = model["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton(model["vocab"], merges, tuple(self.added.values()))
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.labels = labels_of(spec)
        #: The symbol of each byte, within a piece and at its end; -1 if the vocabulary lacks it.
        self.inner, self.outer = (np.array([self.automaton.symbols.get(s + e, -1) for s in byte_symbols()], np.int64) for e in ("", end))
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = None if pattern == _BY_KINDS else regex.compile(pattern.replace(r"\s", _SPACE))
        #: The kind of each character.
        self.kinds = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for kind, told in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, f"[{_SPACE}]+")):
            for m in regex.finditer(told, every):
                self.kinds[m.start() : m.end()] = kind
        self.forget()

    def forget(self) -> None:
        """Drop what was kept, so that an idle worker is small."""
        self.kept: tuple[pa.Array, np.ndarray, np.ndarray] | None = None
        self.automaton.forget()

    def _plain(self, text: str) -> bytes:
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return lowered.encode()

    def _spelled(self, text: str | None) -> bytes:
        """The bytes of which pieces are cut, with added tokens by their ids."""
        if not text:
            return b""
        if self.cut is None or not any(s in text for s in self.added):
            return self._plain(text)
        mark = {s: bytes([_ADDED, *(0x80 | i >> k & 63 for k in (18, 12, 6, 0))]) for s, i in self.added.items()}
        return b"".join([mark[p] if k % 2 else self._plain(p) for k, p in enumerate(self.cut.split(text))])

    def _kinds_of(self, data: np.ndarray) -> np.ndarray:
        """The kind of the character that each byte belongs to; spaces end ``data``."""
        kind = self.kinds[:256][data]
        lead = np.flatnonzero(data >= 0xC2)
        value = data[lead]
        for least, over, size, bits in ((0xC2, 0xE0, 2, 0x1F), (0xE0, 0xF0, 3, 0x0F), (0xF0, _ADDED, 4, 0x07), (_ADDED, 0x100, 5, 0)):
            at = lead[(value >= least) & (value < over)]
            if not at.size:
                continue
            of: np.ndarray | int = ADDED
            if least != _ADDED:
                code = (data[at] & bits).astype(np.int32)
                for k in range(1, size):
                    code = code << 6 | data[at + k] & 0x3F
                of = self.kinds[code]
            for k in range(size):
                kind[at + k] = of
        return kind

    def _pieces(self, rows: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of all rows, and how many each row has."""
        data = np.frombuffer(b" ".join([*rows, b"   "]), np.uint8)
        kind = self._kinds_of(data)
        whole = (data & 0xC0) != 0x80
        starts = (kind != SPACE) & whole
        starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] >= NUMBER)
        if self.pieces is None:
            quote = np.flatnonzero(starts & (data == ord("'")))
            a, b = data[quote + 1], data[quote + 2]
            short = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            long = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            starts[quote[short | long] + 1] = False
            after = np.concatenate([quote[short] + 2, quote[long] + 3])
            starts[after] |= kind[after] != SPACE
        ends = np.cumsum([len(r) + 1 for r in rows])
        counts = np.diff(np.searchsorted(np.flatnonzero(starts), ends), prepend=0)
        inside = kind != SPACE
        data, starts = data[inside], np.flatnonzero(starts[inside])
        offsets = np.append(starts, len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def _matched(self, rows: list[bytes]) -> tuple[pa.Array, np.ndarray]:
        """The same by another pattern than that of the kinds."""
        found: list[list[bytes]] = []
        for row in rows:
            parts = re.split(rb"(\xff[\x80-\xbf]{4})", row)
            found.append([p for k, part in enumerate(parts) for p in ([part] if k % 2 else [m.encode() for chunk in re.split(f"[{_SPACE}]+", part.decode()) for m in self.pieces.findall(chunk)])])
        return pa.array([p for f in found for p in f], pa.binary()), np.array([len(f) for f in found], np.int64)

    def _walked(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of pieces, and each piece's number of them."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        symbols = self.inner[data]
        symbols[offsets[1:] - 1] = self.outer[data[offsets[1:] - 1]]
        mark = np.flatnonzero(data == _ADDED)
        for k in range(1, 5):
            symbols[mark + k] = -1
        symbols[mark] = sum((data[mark + k].astype(np.int64) & 63) << 6 * (4 - k) for k in range(1, 5))
        there = symbols >= 0
        lengths = np.diff(np.concatenate([[0], np.cumsum(there)])[offsets])
        return self.automaton.walk(symbols[there], lengths)

    def _ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for distinct pieces, of which the latest are kept."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        known, ids, counts = self.kept or (pa.array([], pa.binary()), np.zeros(0, np.int32), np.zeros(0, np.int64))
        place = pc.index_in(words, value_set=known)
        new = words.filter(place.is_null())
        place = place.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = np.arange(len(known), len(known) + len(new))
        if len(new):
            new_ids, new_counts = self._walked(new)
            known, ids, counts = pa.concat_arrays([known, new]), np.concatenate([ids, new_ids]), np.concatenate([counts, new_counts])
        out = gathered(ids, counts, place), counts[place]
        self.kept = (known, ids, counts) if len(known) <= MAX_KEPT else (words, *out) if len(words) <= MAX_KEPT else None
        return out

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The token ids of all texts, and where those of each begin and end."""
        words, counts = (self._pieces if self.pieces is None else self._matched)([self._spelled(t) for t in texts])
        coded = words.dictionary_encode()
        ids, sizes = self._ids(coded.dictionary)
        which = coded.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes[which])])
        return gathered(ids, sizes, which), bounds[np.concatenate([[0], np.cumsum(counts)])]

    def encode(self, text: str | None) -> bytes:
        """Token ids as 32-bit integers."""
        return self.encode_all([text])[0].tobytes()

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.labels[i] for i in ids])


def gathered(values: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that ``which`` names, one behind another; run k has ``sizes[k]`` values."""
    taken = sizes[which]
    first = (np.cumsum(sizes) - sizes)[which]
    return values[np.repeat(first - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())]


@lru_cache(maxsize=1)
def _tokenizer(spec: str) -> Tokenizer:
    return Tokenizer(json.loads(spec))


def labels_of(spec: dict) -> list[str]:
    """The labels by id, without the automaton."""
    labels = {i: s for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
    return [labels.get(i, "") for i in range(max(labels) + 1)]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _decoded(ids: np.ndarray, bounds: np.ndarray, labels: pa.Array) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(bounds.astype(np.int32), labels.take(pa.array(ids))), " ")


def _slices(batches: Iterator[pa.RecordBatch], text: str) -> Iterator[pa.RecordBatch]:
    """Batches cut into rows of about ``SLICE_BYTES`` of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo] - sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def bpe_encode(docs: DataFrame, spec: str, text: str = "text", out: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the column ``out``: the token ids of each whole text.

    With ``decoded``, that column has the ids' labels, one space between; this
    saves another pass of ``bpe_decode``.  ``spec`` is the content of a
    tokenizer file; the automaton made of it is a few MB, whatever the corpus,
    and goes to the workers by broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(_tokenizer(spec))
    added = [out] + [decoded] * (decoded is not None)
    names = [c for c in docs.columns if c not in added]

    def run(batches):
        tokenizer = shared.value
        labels = pa.array(tokenizer.labels, pa.string()) if decoded is not None else None
        for batch in _slices(batches, text):
            ids, bounds = tokenizer.encode_all(batch.column(text).to_pylist())
            columns = [pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids))]
            if decoded is not None:
                columns.append(_decoded(ids, bounds, labels))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + columns, names + added)
        tokenizer.forget()

    fields = [T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(decoded or "", T.StringType())][: len(added)]
    return docs.select(*names).mapInArrow(run, T.StructType([docs.schema[c] for c in names] + fields))


def bpe_decode(tokens: DataFrame, spec: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the column ``out``: the labels of the ids, one space between."""
    shared = tokens.sparkSession.sparkContext.broadcast(labels_of(json.loads(spec)))
    names = [c for c in tokens.columns if c != out]

    def run(batches):
        labels = pa.array(shared.value, pa.string())
        for batch in pieces(batches):
            column = batch.column(ids)
            bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            texts = _decoded(column.flatten().to_numpy(zero_copy_only=False), bounds, labels)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [texts], names + [out])

    schema = T.StructType([tokens.schema[c] for c in names] + [T.StructField(out, T.StringType())])
    return tokens.mapInArrow(run, schema)


def token_digests(docs: DataFrame, spec: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` with the number and digests of each text's tokens and of their decoding."""
    keep = [c for c in keep if c not in ("n_tokens", "ids_sha256", "decoded_sha256")]
    both = bpe_encode(docs.select(*dict.fromkeys([*keep, text])), spec, text, "__ids", "__decoded")
    return both.select(
        *keep,
        F.size("__ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("__ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2(F.col("__decoded"), 256).alias("decoded_sha256"),
    )
