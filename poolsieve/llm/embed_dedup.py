"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated by a random orthogonal matrix; its code is the sign
of each coordinate, and the stored correction factor f is the inner product of
the rotated vector and the unit vector that the code stands for.  For another
rotated vector q, <code, q> / f estimates <o, q> without bias, and

    EPSILON * sqrt((1 - f * f) / (f * f)) / sqrt(dim - 1)

bounds its error but for a tail that EPSILON sets.  Only pairs whose upper
bound reaches the threshold, from both ends, are computed exactly; only those
at or above it are links.

Pairs come from the codes too: TABLES groups of BITS code bits (from as many
rotations as that takes) are bucket keys.  BITS grows with the logarithm of
the number of vectors, so that a bucket of unlike vectors holds BUCKET on
average, and the number of tables follows from it for a recall of RECALL at
the threshold itself; closer pairs are found more surely.  Nothing is fitted.

The code bits of all tables travel with a vector, not the keys themselves: they
tell whether a pair has met in a table before.

Equal vectors are one node with a weight.  A bucket of more than BLOCK nodes
is split in blocks, and every two blocks meet in a task of their own, so no
task holds a whole large bucket and no pair is skipped.  A pair that meets in
several tables counts in the first of them only.

Null vectors, zero vectors, those with null or non-finite components, and rows
without an id link with nothing; an empty table gives an empty result, and only
the two named columns are read.  Vectors of different lengths do not link.
Rows that repeat an id are one node of the components; each still counts its
own links, the other rows with its vector among them.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsieve.llm.components import components, cut
from poolsieve.llm.groups import by_group, deal_blocks, forest
from poolsieve.llm.kernels import mix

THRESHOLD = 0.9
EPSILON = 4.0
RECALL = 0.98
BUCKET = 32
BLOCK = 1024
SEED = 20240521

_COLUMNS = ["d1", "d2", "links", "a", "b"]


def plan(n: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Bits of a bucket key and number of tables for ``n`` vectors."""
    bits = max(4, round(math.log2(max(n, 1) / BUCKET)) if n > BUCKET else 4)
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - agree))


def rotations(dim: int, count: int) -> np.ndarray:
    """``count`` random orthogonal matrices, the same everywhere."""
    rng = np.random.default_rng([SEED, dim])
    out = []
    for _ in range(count):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.stack(out)


def _matrix(column: pa.ListArray, rows: np.ndarray, dim: int) -> np.ndarray:
    flat = column.take(pa.array(rows)).flatten()
    return np.asarray(flat.to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def _encode(bits: int, tables: int):
    def run(batches):
        turn: dict[int, np.ndarray] = {}
        weights: dict[int, np.ndarray] = {}
        for batch in batches:
            column = batch.column("vector")
            sizes = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
            n = len(sizes)
            d = np.zeros((2, n), np.uint64)
            keys, code, factor, ok = np.zeros((n, tables), np.int64), [None] * n, np.zeros(n), np.zeros(n, bool)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                if dim not in turn:
                    turn[dim] = rotations(dim, -(-bits * tables // dim))
                    weights[dim] = mix(np.arange(1, 2 * dim + 1, dtype=np.uint64)).reshape(2, dim) | np.uint64(1)
                rows = np.flatnonzero(sizes == dim)
                x = _matrix(column, rows, dim)
                fine = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
                rows, x = rows[fine], x[fine]
                if not len(rows):
                    continue
                raw = (x + 0.0).view(np.uint64)  # + 0.0: the zeros are equal
                for k in (0, 1):
                    d[k, rows] = mix((mix(raw ^ weights[dim][k]) * weights[dim][1 - k]).sum(axis=1, dtype=np.uint64))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                turned = np.concatenate([unit @ m.T for m in turn[dim]], axis=1)
                signs = turned > 0
                for t in range(tables):
                    part = signs[:, t * bits : (t + 1) * bits].astype(np.int64)
                    keys[rows, t] = part @ (1 << np.arange(bits, dtype=np.int64)) + (dim << 40)
                factor[rows] = np.abs(turned[:, :dim]).sum(axis=1) / math.sqrt(dim)
                for r, c in zip(rows.tolist(), np.packbits(signs, axis=1), strict=True):
                    code[r] = c.tobytes()
                ok[rows] = True
            lists = pa.ListArray.from_arrays(np.arange(0, (n + 1) * tables, tables, dtype=np.int32), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), column, pa.array(d[0].view(np.int64)), pa.array(d[1].view(np.int64)), lists, pa.array(code, pa.binary()), pa.array(factor), pa.array(ok)],
                ["vec_id", "vector", "d1", "d2", "keys", "code", "factor", "ok"],
            )

    return run


def _pairs(x: np.ndarray, code: np.ndarray, factor: np.ndarray, left: np.ndarray, right: np.ndarray, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs between the nodes ``left`` and ``right``, or within, if they are the same."""
    dim = x.shape[1]
    x = x / np.abs(x).max(axis=1, keepdims=True)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    turned = (unit @ turn.T).astype(np.float32)
    signs = ((code.astype(np.float32) * 2 - 1) / math.sqrt(dim)).astype(np.float32)
    slack = EPSILON * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / math.sqrt(max(dim - 1, 1)) + 1e-5
    forth = signs[left] @ turned[right].T / factor[left, None] + slack[left, None]
    back = (signs[right] @ turned[left].T / factor[right, None] + slack[right, None]).T
    maybe = (forth >= threshold) & (back >= threshold)
    if left is right:
        maybe = np.triu(maybe, 1)
    i, j = np.nonzero(maybe)
    i, j = left[i], right[j]
    out_i, out_j = [], []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        hit = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        out_i.append(a[hit])
        out_j.append(b[hit])
    none = np.zeros(0, np.int64)
    return (np.concatenate(out_i) if out_i else none), (np.concatenate(out_j) if out_j else none)


def _first_meeting(bits: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """Whether the pairs have no equal key in a table before ``t``; ``bits`` is by node, table and bit."""
    out = np.ones(len(a), dtype=bool)
    for at in range(0, len(a), 1 << 14):
        x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        out[at : at + len(x)] = ~(bits[x, :t] == bits[y, :t]).all(axis=2).any(axis=1)
    return out


def _compare(threshold: float, bits: int, tables: int):
    """Links within each ``(t, key, i, j)``, whose rows follow each other."""

    def run(batches):
        turn: dict[int, np.ndarray] = {}
        for rows in by_group(batches, ["t", "key", "i", "j"]):
            t, i, j = (rows.column(c)[0].as_py() for c in ("t", "i", "j"))
            column = rows.column("vector").combine_chunks()
            dim = len(column[0])
            if dim not in turn:
                turn[dim] = rotations(dim, 1)[0]
            x = _matrix(column, np.arange(len(rows)), dim)
            code = np.unpackbits(np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(rows), -1), axis=1)
            block = rows.column("block").to_numpy()
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            a, b = _pairs(x, code[:, :dim], rows.column("factor").to_numpy(), left, left if i == j else right, turn[dim], threshold)
            if not len(a):
                continue
            new = _first_meeting(code[:, : bits * tables].reshape(len(rows), tables, bits), a, b, t)
            weight = rows.column("weight").to_numpy()
            links = np.bincount(a[new], weight[b[new]], len(rows)) + np.bincount(b[new], weight[a[new]], len(rows))
            root = forest(len(rows), a, b)
            out = np.flatnonzero((links > 0) | (root != np.arange(len(rows))))
            node, out_rows = rows.column("vec_id").combine_chunks(), pa.array(out)
            yield pa.RecordBatch.from_arrays(
                [rows.column("d1").combine_chunks().take(out_rows), rows.column("d2").combine_chunks().take(out_rows), pa.array(links[out].astype(np.int64)), node.take(out_rows), node.take(pa.array(root[out]))],
                _COLUMNS,
            )

    return run


def embedding_dedup(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row.

    ``n_links`` counts the other rows found at ``threshold`` or more.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("vector"))
    bits, tables = plan(rows.count(), threshold)
    id_type, kind = (rows.schema[c].dataType.simpleString() for c in ("vec_id", "vector"))
    about = cut(rows.mapInArrow(_encode(bits, tables), f"vec_id {id_type}, vector {kind}, d1 long, d2 long, keys array<long>, code binary, factor double, ok boolean"))
    about = about.withColumn("ok", F.col("ok") & F.col("vec_id").isNotNull())
    one = [F.first(c).alias(c) for c in ("vector", "keys", "code", "factor")]
    nodes = cut(about.where("ok").groupBy("d1", "d2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), *one))

    spread = nodes.select("d1", "d2", F.posexplode("keys").alias("t", "key"))
    large = spread.groupBy("t", "key").agg(F.count("*").alias("c")).where(f"c > {block}").select("t", "key", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    split = spread.join(large, ["t", "key"]).groupBy("d1", "d2").agg(F.map_from_entries(F.collect_list(F.struct("t", "blocks"))).alias("split"))
    dealt = nodes.join(split, ["d1", "d2"], "left").select("*", F.posexplode("keys").alias("t", "key"))
    dealt = dealt.withColumn("blocks", F.coalesce(F.expr("split[t]"), F.lit(1))).select("t", "key", "blocks", "d1", "d2", "vec_id", "weight", "vector", "code", "factor")
    found = deal_blocks(dealt, ["t", "key"], ["d1", "d2", "t"]).mapInArrow(_compare(threshold, bits, tables), f"d1 long, d2 long, links long, a {id_type}, b {id_type}")
    found = cut(found)

    links = found.groupBy("d1", "d2").agg(F.sum("links").alias("links"))
    same = about.where("ok").join(nodes.select("d1", "d2", F.col("vec_id").alias("node"), "weight"), ["d1", "d2"]).select("vec_id", "node", "d1", "d2", "weight")
    ties = same.where("vec_id <> node").join(nodes.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("a"), F.col("node").alias("b"))
    comp = components(found.select("a", "b").where("a <> b").unionByName(ties)).toDF("node", "component")
    counts = same.join(links, ["d1", "d2"], "left").groupBy("vec_id", "d1", "d2").agg((F.first("weight") - 1 + F.coalesce(F.first("links"), F.lit(0))).alias("n_links"), F.min("node").alias("node"))
    # an id with several vectors is in the component of any of them
    where = counts.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = where.groupBy("vec_id").agg(F.min("component").alias("component"))
    out = about.select("vec_id", "d1", "d2", "ok").join(counts.select("vec_id", "d1", "d2", "n_links"), ["vec_id", "d1", "d2"], "left").join(least, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.when(F.col("ok"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
