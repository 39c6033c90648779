"""MinHash near-dedup with tensored banding.

A document is the set of its distinct shingles (runs of words).  Two small
collections of M keys are computed, each key from HALF minhashes; every pair
of one key from either collection is the key of one table.  M * M tables thus
cost 2 * M * HALF minhashes instead of M * M * 2 * HALF.  A pair of similarity
s meets in a table with probability (1 - (1 - s**HALF)**M)**2, which is
0.99993 at 0.85 for M = 8 and HALF = 2, and more above.

Documents with equal shingles are settled first by a 128-bit digest of them (64
bits of the set, 64 of a second hash over every shingle of the text), so groups of copies of any size are one node.
Pairs of nodes that share a table key are confirmed on their full sets, by a
hash of the shingles that is independent of the one the keys are made of:

1. every node is compared with the smallest node of each of its buckets, which
   settles most of them with one comparison for each node;
2. in buckets whose nodes are then not all of one component, all pairs of
   different components are compared inside a task, by counting common shingles
   as a product of incidence matrices.  Buckets of more than BLOCK nodes are
   split in blocks and every two blocks meet in a task of their own.  A pair
   that shares several tables is compared in the first of them only, and a
   task returns a spanning forest of the links it finds, not the pairs.

No bucket is capped, and no pair whose ends are already linked is compared.

Null or empty texts and texts without words have the empty set, which links
with nothing; texts are read whole, however long, and an empty table gives an
empty result.  Only the two named columns are read.  A document without an id keeps its row; it has no component and is kept.  Where rows share an id but not the set, the one with the smallest digest
stands for the id, and its component holds for all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsieve.llm.components import components, cut
from poolsieve.llm.groups import by_group, deal_blocks, forest
from poolsieve.llm.kernels import LOWER, NOT_SPACE, Words, as_long, mix, pieces, word_slices

#: Keys of each collection, and minhashes of each key.
M = 8
HALF = 2
#: Words of a shingle, and the least similarity, where a caller names none.
SHINGLE = 5
SIMILARITY = 80

#: Nodes of a bucket that one task compares, and columns of an incidence matrix at a time.
BLOCK = 2048
_COLUMNS = 2048

_SEEDS = mix(np.arange(1, 2 * M * HALF + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def _shingles(words: Words, size: int, which: int) -> list[np.ndarray]:
    """Shingle hashes of every row, in the order of the text."""
    counts = words.counts()
    n = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
    ends = np.cumsum(n)
    start = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(words.bounds[:-1], n)
    length = np.repeat(np.minimum(counts, size), n)
    return np.split(words.grams(start, length, which), ends[:-1]) if len(ends) else []


def _full_sets(words: Words, size: int) -> list[np.ndarray]:
    """Sorted distinct shingles of every row, to confirm on; independent of the hashes that sketches are made of."""
    return [np.unique(x) for x in _shingles(words, size, 1)]


def _sketch(size: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, words in word_slices(batch.column(1), NOT_SPACE, LOWER):
                sets = [np.unique(x) for x in _shingles(words, size, 0)]
                n = np.array([len(x) for x in sets])
                full = n > 0
                s1, s2 = np.zeros(hi - lo, np.uint64), np.zeros(hi - lo, np.uint64)
                keys = np.zeros((hi - lo, 2 * M), np.int64)
                if full.any():
                    flat = np.concatenate([x for x in sets if len(x)])
                    at = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    s1[full] = np.add.reduceat(mix(flat ^ np.uint64(0x5851F42D4C957F2D)), at)
                    s2[full] = [mix(x).sum(dtype=np.uint64) for x in _shingles(words, size, 1) if len(x)]
                    for k in range(2 * M):
                        key = np.full(int(full.sum()), k, dtype=np.uint64)
                        for seed in _SEEDS[k * HALF : (k + 1) * HALF]:
                            key = mix(key ^ np.minimum.reduceat((flat ^ (seed >> np.uint64(7))) * seed, at))
                        keys[full, k] = key.view(np.int64)
                lists = pa.ListArray.from_arrays(np.arange(0, (hi - lo + 1) * 2 * M, 2 * M, dtype=np.int32), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), as_long(s1), as_long(s2), pa.array(n, pa.int64()), lists], ["doc_id", "s1", "s2", "n", "halves"])

    return run


def _packed(batches):
    for batch in pieces(batches):
        pack = zstandard.ZstdCompressor(level=1)
        texts = [pack.compress(t.encode()) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["node", "packed"])


def _confirm(size: int, percent: int):
    """Of pairs of nodes with their texts, those similar enough."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = dict(zip(a, batch.column("text_a").to_pylist(), strict=True)) | dict(zip(b, batch.column("text_b").to_pylist(), strict=True))
            nodes = list(texts)
            column = pa.array([unpack.decompress(texts[x]).decode() for x in nodes], pa.large_string())
            sets = [x for _, _, words in word_slices(column, NOT_SPACE, LOWER) for x in _full_sets(words, size)]
            sets = dict(zip(nodes, sets, strict=True))
            linked = []
            for x, y in zip(a, b, strict=True):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                linked.append(100 * both >= percent * (len(sets[x]) + len(sets[y]) - both))
            keep = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set."""
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    flat = [np.concatenate(x) for x in (left, right)]
    rows = [np.repeat(np.arange(len(x)), [len(v) for v in x]) for x in (left, right)]
    both = np.intersect1d(flat[0], flat[1])
    sides = []
    for values, row in zip(flat, rows, strict=True):
        at = np.minimum(np.searchsorted(both, values), max(len(both) - 1, 0))
        held = both[at] == values if len(both) else np.zeros(len(values), bool)
        order = np.argsort(at[held], kind="stable")
        sides.append((at[held][order], row[held][order]))
    for lo in range(0, len(both), _COLUMNS):
        part = []
        for (at, row), n in zip(sides, out.shape, strict=True):
            a, z = np.searchsorted(at, [lo, lo + _COLUMNS])
            m = np.zeros((n, min(_COLUMNS, len(both) - lo)), dtype=np.float32)
            m[row[a:z], at[a:z] - lo] = 1
            part.append(m)
        out += part[0] @ part[1].T
    return out


def _within(size: int, percent: int):
    """Links between different components of each ``(t, key, i, j)``, as a forest."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for rows in by_group(batches, ["t", "key", "i", "j"]):
            t, i, j = (rows.column(c)[0].as_py() for c in "tij")
            block, comp = rows.column("block").to_numpy(), rows.column("comp").to_pylist()
            comp = np.unique(np.array(comp), return_inverse=True)[1]
            n = rows.column("n").to_numpy()
            halves = rows.column("halves").combine_chunks().flatten().to_numpy().reshape(len(rows), -1)
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            todo = comp[left][:, None] != comp[right][None, :]
            for k in [*range(t // M), *range(M, M + t % M)]:  # they met in an earlier table
                todo &= halves[left, k][:, None] != halves[right, k][None, :]
            todo &= (100 * n[left][:, None] >= percent * n[right][None, :]) & (100 * n[right][None, :] >= percent * n[left][:, None])
            if i == j:
                todo = np.triu(todo, 1)
            a, b = np.flatnonzero(todo.any(axis=1)), np.flatnonzero(todo.any(axis=0))
            if not len(a):
                continue
            texts = rows.column("packed").take(pa.array(np.concatenate([left[a], right[b]]))).to_pylist()
            column = pa.array([unpack.decompress(x).decode() for x in texts], pa.large_string())
            sets = [x for _, _, words in word_slices(column, NOT_SPACE, LOWER) for x in _full_sets(words, size)]
            common = _common(sets[: len(a)], sets[len(a) :])
            union = n[left[a]][:, None] + n[right[b]][None, :] - common
            x, y = np.nonzero(todo[np.ix_(a, b)] & (100 * common.astype(np.float64) >= percent * union))
            root = forest(len(rows), left[a][x], right[b][y])
            out = np.flatnonzero(root != np.arange(len(rows)))
            node = rows.column("node").combine_chunks()
            yield pa.RecordBatch.from_arrays([node.take(pa.array(out)), node.take(pa.array(root[out]))], ["a", "b"])

    return run


def minhash_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every document.

    Documents are linked when 100 * intersection >= percent * union of their
    shingle sets; the component is the smallest id reachable over links.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    about = cut(docs.mapInArrow(_sketch(shingle), f"doc_id {kind}, s1 long, s2 long, n long, halves array<long>"))
    ids = about.where("n > 0 AND doc_id IS NOT NULL").drop("n")
    own = F.struct("s1", "s2")
    twice = ids.groupBy("doc_id").agg(F.min(own).alias("own"), F.max(own).alias("other")).where("own <> other").select("doc_id", "own.*")
    repeated = not twice.isEmpty()
    if repeated:
        ids = ids.join(twice, ["doc_id", "s1", "s2"], "left_semi").unionByName(ids.join(twice, "doc_id", "left_anti"))
    counts = about.groupBy("s1", "s2").agg(F.first("n").alias("n"))
    nodes = ids.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("halves").alias("halves"))
    nodes = cut(nodes.join(counts, ["s1", "s2"]))

    key = F.expr(f"flatten(transform(slice(halves, 1, {M}), (u, i) -> transform(slice(halves, {M + 1}, {M}), (v, j) -> xxhash64(i, j, u, v))))")
    tables = nodes.select("node", F.posexplode(key).alias("t", "key"))
    several = tables.groupBy("t", "key").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    buckets = cut(tables.join(several, ["t", "key"]).select("t", "key", "node", "leader"))

    sizes = nodes.select("node", "n")
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(_packed, f"node {kind}, packed binary")
    texts = cut(texts.join(buckets.select("node").distinct(), "node", "left_semi").dropDuplicates())
    if repeated:
        texts = _own_texts(texts, twice.withColumnRenamed("doc_id", "node"), shingle, kind)

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Links among distinct pairs ``(a, b)``; sizes too far apart are turned away first."""
        sized = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
        near = sized.where(F.col("na") * 100 >= F.col("nb") * percent).where(F.col("nb") * 100 >= F.col("na") * percent).select("a", "b")
        with_text = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
        return with_text.mapInArrow(_confirm(shingle, percent), f"a {kind}, b {kind}")

    links = cut(confirmed(buckets.where("node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()))
    comp = cut(components(links).toDF("node", "comp"))
    here = buckets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    left = here.groupBy("t", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x1"), F.bit_xor(F.xxhash64("node", F.lit(2))).alias("x2"))
    left = left.where("lo < hi AND c > 2").withColumn("blocks", F.ceil(F.col("c") / block).cast("int"))
    # of buckets with the same nodes, the first holds the first meeting of each pair
    left = left.groupBy("c", "x1", "x2").agg(F.min(F.struct("t", "key", "blocks")).alias("x")).select("x.*")
    places = here.join(left, ["t", "key"]).groupBy("node").agg(F.first("comp").alias("comp"), F.collect_list(F.struct("t", "key", "blocks")).alias("places"))  # at most M * M
    rows = places.join(texts, "node").join(nodes.select("node", "n", "halves"), "node").select("*", F.inline("places")).drop("places")
    more = deal_blocks(rows, ["t", "key"], ["node", "key"]).mapInArrow(_within(shingle, percent), f"a {kind}, b {kind}")
    comp = components(comp.toDF("a", "b").unionByName(more))

    node_of = ids.select("doc_id", "s1", "s2").distinct().join(nodes.select("s1", "s2", "node"), ["s1", "s2"])
    comp_of = node_of.join(comp.toDF("node", "component"), "node", "left").select("doc_id", F.coalesce("component", "node").alias("component"))
    joined = about.select("doc_id", F.col("n").alias("n_shingles")).join(comp_of, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _own_texts(texts: DataFrame, twice: DataFrame, shingle: int, kind: str) -> DataFrame:
    """Where an id has several texts, only one whose set is the node's."""

    def digest(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            column = pa.array([unpack.decompress(x).decode() for x in batch.column("packed").to_pylist()], pa.large_string())
            parts = list(_sketch(shingle)([pa.RecordBatch.from_arrays([batch.column("node"), column], ["doc_id", "text"])]))
            s1, s2 = (pa.concat_arrays([x.column(c) for x in parts]) if parts else pa.array([], pa.int64()) for c in ("s1", "s2"))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("packed"), s1, s2], ["node", "packed", "s1", "s2"])

    several = texts.join(twice, "node", "left_semi").mapInArrow(digest, f"node {kind}, packed binary, s1 long, s2 long")
    first = several.join(twice, ["node", "s1", "s2"], "left_semi").groupBy("node").agg(F.min("packed").alias("packed"))
    return cut(texts.join(twice, "node", "left_anti").unionByName(first))
