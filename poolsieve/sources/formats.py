"""Tar shards, matrices and subsets of ids as Spark data sources.

``register(spark)`` makes three formats known to ``spark.read.format`` and
``df.write.format``:

* ``pool_tar``: samples of tar shards, and shards of samples;
* ``pool_npz``: the rows of one matrix in each ``.npz`` file;
* ``pool_npy``: the 16-byte ids of a ``.npy`` or raw file.

Files are split by size, so a large one is read by several tasks.  Planning lists
the folder and opens nothing.  Columns are pruned by the schema that the reader is
given (``spark.read.schema``): contents that no column needs are passed over.
Equality and ``IN`` on names and ids, and ranges of rows, are pushed down, by file
before tasks are made and by sample before its contents are read.
"""

from __future__ import annotations

import bisect
import fnmatch
import io
import json
import re
import struct
import tarfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from poolsieve.sources import files
from poolsieve.sources.names import number_regex, stats_name
from poolsieve.sources.tar import group_members, sample_uid, tar_members

#: Bytes of a file that one task reads.
SPLIT_BYTES = 128 << 20
#: Bytes that opening a file counts for.
OPEN_BYTES = 1 << 20
#: Tasks that parts smaller than SPLIT_BYTES are read in, of files of more than FEW_BYTES together; where parts are more, neighbours share a task.
SMALL_TASKS = 128
FEW_BYTES = 16 << 20
#: Bytes of contents in one batch.
BATCH_BYTES = 16 << 20
#: Renames and small files that a commit has under way at once.
COMMIT_THREADS = 32


@dataclass
class FileSplit(InputPartition):
    """Of the ``parts`` that a file is read in, those from ``part`` to before ``stop``."""

    path: str
    size: int
    part: int
    stop: int
    parts: int

    def span(self, n: int) -> tuple[int, int]:
        """Their share of ``n`` rows or bytes."""
        return n * self.part // self.parts, n * self.stop // self.parts

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    @property
    def last(self) -> bool:
        return self.stop == self.parts


@dataclass
class SplitGroup(InputPartition):
    """Small splits that one task reads."""

    splits: list[FileSplit]


@dataclass
class _Reader(DataSourceReader):
    """Splits files by size, puts small ones together, and keeps the filters that a subclass names as ``EXACT`` sets and ``RANGES``."""

    path: str
    pattern: str
    split: int
    columns: list[str]
    options: dict[str, str]
    sets: dict[str, set] = field(default_factory=dict)
    low: dict[str, int] = field(default_factory=dict)
    high: dict[str, int] = field(default_factory=dict)

    EXACT: ClassVar[tuple[str, ...]] = ()
    RANGES: ClassVar[tuple[str, ...]] = ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in self.EXACT and isinstance(f, EqualTo | In):
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.sets[name] = self.sets.get(name, values) & values
            elif name in self.RANGES and isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                self.low[name] = max(self.low.get(name, 0), f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.high[name] = min(self.high.get(name, f.value + 1), f.value + 1)
            elif name in self.RANGES and isinstance(f, LessThan | LessThanOrEqual):
                stop = f.value + isinstance(f, LessThanOrEqual)
                self.high[name] = min(self.high.get(name, stop), stop)
            elif not (isinstance(f, IsNotNull) and (name in self.RANGES or name in self.sets)):
                yield f

    def passes(self, column: str, value) -> bool:
        return column not in self.sets or value in self.sets[column]

    def file_passes(self, name: str) -> bool:
        return True

    def read(self, group: SplitGroup | None) -> Iterator[pa.RecordBatch]:
        for split in group.splits if group is not None else []:  # where no file is left, one task is made without any
            yield from self.rows(split)

    def rows(self, split: FileSplit) -> Iterator[pa.RecordBatch]:
        raise NotImplementedError

    def partitions(self) -> list[SplitGroup]:
        found = []
        for path, size in files.listing(self.path):
            name = path.rsplit("/", 1)[-1]
            if (path == self.path or fnmatch.fnmatch(name, self.pattern)) and self.file_passes(name):
                found.append((path, size, max(1, -(-size // self.split))))
        most, total = self.split, sum(size for _, size, _ in found)
        if total > FEW_BYTES and sum(parts for _, _, parts in found) > SMALL_TASKS:
            # each task has a cost of its own, and walks a file from its beginning
            most = max(most, min(SPLIT_BYTES, -(-(total + OPEN_BYTES * len(found)) // SMALL_TASKS)))
        out: list[SplitGroup] = []
        room = 0
        for path, size, parts in found:
            for k in range(parts):
                need = size // parts
                if k and need <= room:
                    out[-1].splits[-1].stop = k + 1
                    room -= need
                    continue
                if need + OPEN_BYTES > room:
                    out.append(SplitGroup([]))
                    room = most
                out[-1].splits.append(FileSplit(path, size, k, k + 1, parts))
                room -= need + OPEN_BYTES
        return out


class _Source(DataSource):
    READER: type[_Reader]
    PATTERN: str
    SCHEMA: str

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        unknown = set(schema.names) - {c.strip().split(" ")[0] for c in _columns(self.SCHEMA)}
        if unknown:
            raise ValueError(f"{self.name()} has no columns {sorted(unknown)}")
        o = self.options
        return self.READER(o["path"], o.get("pattern", self.PATTERN), int(o.get("split", SPLIT_BYTES)), schema.names, dict(o))


def _columns(schema: str) -> list[str]:
    """The columns of a schema text, of which types may hold commas."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


# tar shards

_TAR_TYPES = {"shard_name": pa.string(), "place": pa.int64(), "key": pa.string(), "uid": pa.string(), "fields": pa.map_(pa.string(), pa.binary()), "damaged": pa.string()}


class TarReader(_Reader):
    """Samples, in the order of each tar, and a row with ``damaged`` for a tar that cannot be read to its end.

    Every task walks the headers from the tar's beginning, as only they tell where
    samples begin, and reads the contents of samples that begin in its parts.  A
    compressed tar is one task's.  The options ``first_shard`` and ``num_shards`` leave
    out tars by the numbers of their names; with ``name_format`` (as ``part-{:05d}.tar``)
    names of another form are left out too.
    """

    EXACT = ("shard_name", "key", "uid")

    def file_passes(self, name: str) -> bool:
        first, n = int(self.options.get("first_shard", 0)), self.options.get("num_shards")
        form = self.options.get("name_format")
        number = re.search(r"(\d+)\.tar$" if form is None else number_regex(form), name)
        if (first or n is not None or form is not None) and number is None:
            return False
        inside = number is None or first <= int(number[1]) < (first + int(n) if n is not None else int(number[1]) + 1)
        return inside and self.passes("shard_name", name)

    def rows(self, split: FileSplit) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        try:
            for place, key, uid, fields in self._samples(split):
                rows.append((split.name, place, key, uid, list(fields.items()), None))
                size += sum(len(x) for x in fields.values())
                if len(rows) == 4096 or size > BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        except (tarfile.TarError, EOFError, OSError) as e:
            # the last part goes by all headers, so it meets what others do
            if split.last and not self.sets.keys() & {"key", "uid"} and "damaged" in self.columns:
                rows.append((split.name, -1, None, None, None, str(e) or "damaged"))
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(_TAR_TYPES, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], _TAR_TYPES[c]) for c in self.columns], self.columns)

    def _samples(self, split: FileSplit) -> Iterator[tuple[int, str, str | None, dict[str, bytes]]]:
        needs_uid, needs_fields = "uid" in self.columns or "uid" in self.sets, "fields" in self.columns
        with files.open_input(split.path) as stream:
            plain = stream.read(262)[257:262] == b"ustar"
            stream.seek(0)
            if not plain:
                if split.part:
                    return
                wanted = (lambda _: True) if needs_fields else (lambda name: needs_uid and name.lower().endswith(".json"))
                for place, (key, fields) in enumerate(group_members(tar_members(stream, wanted))):
                    uid = sample_uid(fields)
                    if self.passes("key", key) and self.passes("uid", uid):
                        yield place, key, uid, fields if needs_fields else {}
                return
            lo, hi = split.span(split.size)
            content = lambda m: _content(stream, m)
            for place, (key, members) in enumerate(group_members(tar_headers(stream, None if split.last else hi))):
                first = next(iter(members.values()))
                if not lo <= first.offset < (hi if not split.last else split.size) or not self.passes("key", key):
                    continue
                uid = sample_uid({"json": content(members["json"])}) if needs_uid and "json" in members else None
                if self.passes("uid", uid):
                    yield place, key, uid, {e: content(m) for e, m in members.items()} if needs_fields else {}


def tar_headers(stream, stop: int | None = None) -> Iterator[tuple[str, tarfile.TarInfo]]:
    """Names and headers of a plain tar's regular files; contents are not read.

    Ends once a sample that begins at ``stop`` or later must have begun; without
    ``stop`` the end mark is looked for, too.
    """
    beyond = None
    with tarfile.open(fileobj=stream, mode="r:") as tar:
        for member in tar:
            tar.members = []  # nothing is looked up again
            if not member.isfile():
                continue
            yield member.name, member
            if stop is not None and member.offset >= stop:
                stem = _stem(member.name)
                if beyond is not None and stem != beyond:
                    return
                beyond = stem
        stream.seek(max(0, stream.seek(0, 2) - 512))
        if any(stream.read(512)):
            raise tarfile.ReadError("there is no end mark")


def _stem(name: str) -> str:
    folder, _, base = name.rpartition("/")
    return f"{folder}/{base.split('.')[0]}"


def _content(stream, member: tarfile.TarInfo) -> bytes:
    stream.seek(member.offset_data)
    data = stream.read(member.size)
    if len(data) != member.size:
        raise tarfile.ReadError("a member is cut short")
    return data


@dataclass
class TarMessage(WriterCommitMessage):
    """Shards that a task wrote: ``out_shard, part, file, samples``."""

    shards: list[tuple[int, int, str, int]]


@dataclass
class TarWriter(DataSourceArrowWriter):
    """Rows ``out_shard, out_key, fields``, of which those of a shard follow each other in one partition, as tars.

    Tasks write to a folder of the job's own below the target, under names of their
    own.  The commit numbers what the successful tasks wrote, without gaps, moves it
    and deletes the job's folder with all that failed tasks left there; an abort
    deletes that folder only.  The driver makes the folder, so that a task which
    outlives an abort finds none and leaves nothing.
    """

    path: str
    pattern: str
    stats: str
    max_bytes: int
    overwrite: bool
    names: list[str]
    manifest: str | None
    job: str = field(default_factory=lambda: uuid.uuid4().hex)

    @property
    def temporary(self) -> str:
        return files.join(self.path, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> TarMessage:
        done: list[tuple[int, int, str, int]] = []
        shard = tar = out = None
        part = count = size = 0
        name = ""

        def close() -> None:
            tar.close()
            out.close()
            done.append((shard, part, name, count))

        for batch in iterator:
            batch = batch.rename_columns(self.names)
            for to, key, fields in zip(*(batch.column(c).to_pylist() for c in ("out_shard", "out_key", "fields")), strict=True):
                if tar is not None and (to != shard or size >= self.max_bytes):
                    close()
                    part = part + 1 if to == shard else 0
                    tar = None
                if tar is None:
                    shard, count, size, name = to, 0, 0, uuid.uuid4().hex
                    out = files.open_output(files.join(self.temporary, name), make_folder=False)
                    tar = tarfile.open(fileobj=out, mode="w|")
                for ending, data in fields:
                    info = tarfile.TarInfo(f"{key}.{ending}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    size += len(data)
                count += 1
        if tar is not None:
            close()
        return TarMessage(done)

    def commit(self, messages: list[TarMessage | None]) -> None:
        done = sorted(s for m in messages if m is not None for s in m.shards)
        if self.overwrite:
            for path, _ in files.listing(self.path):
                files.delete(path)

        def publish(numbered: tuple[int, tuple[int, int, str, int]]) -> str:
            k, (_, _, temp, count) = numbered
            name = self.pattern.format(k)
            files.move(files.join(self.temporary, temp), files.join(self.path, name))
            with files.open_output(files.join(self.path, stats_name(self.stats, name, k))) as f:
                f.write(json.dumps({"successes": count}).encode())
            return json.dumps({"name": name, "successes": count})

        with ThreadPoolExecutor(COMMIT_THREADS) as pool:
            lines = list(pool.map(publish, enumerate(done)))
        if self.manifest:
            with files.open_output(self.manifest) as f:
                f.write("\n".join(lines).encode())
        self.abort(messages)

    def abort(self, messages: list[TarMessage | None]) -> None:
        files.remove(self.temporary, missing_ok=True)


class TarSource(_Source):
    """Reads ``SCHEMA``; writes ``out_shard, out_key, fields``, with the options ``shard_format``, ``stats_format`` and ``max_bytes``."""

    READER, PATTERN = TarReader, "*.tar"
    SCHEMA = "shard_name string, place long, key string, uid string, fields map<string,binary>, damaged string"

    @classmethod
    def name(cls) -> str:
        return "pool_tar"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if {*schema.names} != {"out_shard", "out_key", "fields"}:
            raise ValueError("tars are written from out_shard, out_key and fields")
        o = self.options
        out = TarWriter(o["path"], o.get("shard_format", "{:08d}.tar"), o.get("stats_format", "{}_stats.json"), int(o.get("max_bytes", 3_000_000_000)), overwrite, schema.names, o.get("manifest"))
        files.make(out.temporary)
        return out


# matrices


def npy_header(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, order and type of a ``.npy`` stream, which is then at its data."""
    read = np.lib.format.read_array_header_1_0 if np.lib.format.read_magic(f) == (1, 0) else np.lib.format.read_array_header_2_0
    return read(f)


class NpzReader(_Reader):
    """Rows of the matrix ``key`` of every file; a stored matrix is read by ranges of rows, a compressed one by one task."""

    EXACT, RANGES = ("file_root",), ("row_index",)

    def file_passes(self, name: str) -> bool:
        return self.passes("file_root", name.removesuffix(".npz"))

    def rows(self, split: FileSplit) -> Iterator[pa.RecordBatch]:
        key, root = self.options.get("key", "l14_img"), split.name.removesuffix(".npz")
        with files.open_input(split.path) as stream, zipfile.ZipFile(stream) as archive, archive.open(f"{key}.npy") as member:
            (shape, by_column, kind) = npy_header(member)
            if by_column or kind.hasobject or len(shape) != 2:
                raise ValueError(f"{split.path}: {key} is no matrix in row order")
            stored = archive.getinfo(f"{key}.npy").compress_type == zipfile.ZIP_STORED
            if not stored and split.part:
                return
            lo, hi = split.span(shape[0]) if stored else (0, shape[0])
            lo, hi = max(lo, self.low.get("row_index", 0)), min(hi, self.high.get("row_index", hi))
            if hi <= lo:
                return
            width = shape[1] * kind.itemsize
            if "vector" in self.columns:
                member.seek(member.tell() + lo * width)
            each = max(1, (4 << 20) // max(1, width))
            for at in range(lo, hi, each):
                n = min(each, hi - at)
                columns = {"file_root": pa.array([root]).take(pa.array(np.zeros(n, dtype=np.int64))), "row_index": pa.array(np.arange(at, at + n))}
                if "vector" in self.columns:
                    part = np.frombuffer(member.read(n * width), dtype=kind).astype(np.float32)
                    offsets = np.arange(n + 1, dtype=np.int32) * shape[1]
                    columns["vector"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(part))
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)


class NpzSource(_Source):
    READER, PATTERN = NpzReader, "*.npz"
    SCHEMA = "file_root string, row_index long, vector array<float>"

    @classmethod
    def name(cls) -> str:
        return "pool_npz"


# subsets of ids


def ids_begin(stream) -> int:
    """Where the ids of a ``.npy`` or raw file begin."""
    if stream.read(6) != b"\x93NUMPY":
        return 0
    stream.seek(0)
    _, _, kind = npy_header(stream)
    if kind != np.dtype("u8,u8"):
        raise ValueError(f"the subset holds {kind}, not pairs of unsigned 64-bit numbers")
    return stream.tell()


class NpyReader(_Reader):
    """``uid_bin`` of every id.  In a sorted file, which ``sorted`` says, ids outside an equality or ``IN`` are found by bisection."""

    EXACT, RANGES = ("uid_bin",), ("place",)

    def rows(self, split: FileSplit) -> Iterator[pa.RecordBatch]:
        with files.open_input(split.path) as stream:
            begin = ids_begin(stream)
            if (split.size - begin) % 16:
                raise ValueError("a raw subset is a whole number of 16-byte ids")
            lo, hi = split.span((split.size - begin) // 16)
            lo, hi = max(lo, self.low.get("place", 0)), min(hi, self.high.get("place", hi))
            wanted = self.sets.get("uid_bin")
            if wanted is not None and self.options.get("sorted", "false") == "true":
                yield from self._found(stream, begin, lo, hi, sorted(bytes(x) for x in wanted))
                return
            stream.seek(begin + 16 * lo)
            for at in range(lo, hi, 65536):
                n = min(65536, hi - at)
                ids = np.frombuffer(stream.read(16 * n), dtype="<u8").astype(">u8").tobytes()
                batch = self._batch(ids, np.arange(at, at + n))
                yield batch if wanted is None else batch.filter(pa.compute.is_in(batch.column("uid_bin"), pa.array([bytes(x) for x in wanted], pa.binary())))

    def _batch(self, ids: bytes, places: np.ndarray) -> pa.RecordBatch:
        fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(places), [None, pa.py_buffer(ids)])
        columns = {"uid_bin": fixed.cast(pa.binary()), "place": pa.array(places)}
        return pa.RecordBatch.from_arrays([columns[c] for c in self.columns], self.columns)

    def _found(self, stream, begin: int, lo: int, hi: int, wanted: list[bytes]) -> Iterator[pa.RecordBatch]:
        def at(k: int) -> bytes:
            stream.seek(begin + 16 * k)
            return struct.pack(">QQ", *struct.unpack("<QQ", stream.read(16)))

        for x in wanted:
            places = np.arange(bisect.bisect_left(range(hi), x, lo, key=at), bisect.bisect_right(range(hi), x, lo, key=at))
            if len(places):
                yield self._batch(x * len(places), places)


class NpySource(_Source):
    READER, PATTERN = NpyReader, "*"
    SCHEMA = "uid_bin binary, place long"

    @classmethod
    def name(cls) -> str:
        return "pool_npy"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        if schema.names != ["uid_bin"]:
            raise ValueError("ids are written from uid_bin alone")
        return PartWriter(files.make(self.options["path"]))


@dataclass
class PartMessage(WriterCommitMessage):
    part: int
    file: str
    ids: int


@dataclass
class PartWriter(DataSourceArrowWriter):
    """The ids of each partition as a file of little-endian halves, in a folder of parts with a list of what counts.

    ``parts.json`` lists the successful tasks' files in the order of the partitions;
    others are deleted.  ``sinks.subset.write_npy`` makes one file of them.
    """

    path: str

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartMessage:
        from pyspark import TaskContext

        name, ids = uuid.uuid4().hex, 0
        with files.open_output(files.join(self.path, name), make_folder=False) as out:
            for batch in iterator:
                out.write(np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=">u8").astype("<u8").tobytes())
                ids += batch.num_rows
        return PartMessage(TaskContext.get().partitionId(), name, ids)

    def commit(self, messages: list[PartMessage | None]) -> None:
        parts = sorted((m.part, m.file, m.ids) for m in messages if m is not None)
        kept = {name for _, name, _ in parts}
        for path, _ in files.listing(self.path):
            if path.rsplit("/", 1)[-1] not in kept:
                files.delete(path)
        with files.open_output(files.join(self.path, "parts.json")) as f:
            f.write(json.dumps([[name, n] for _, name, n in parts]).encode())

    def abort(self, messages: list[PartMessage | None]) -> None:
        files.remove(self.path, missing_ok=True)


def register(spark: SparkSession) -> SparkSession:
    """Make the formats known to a session; filters are pushed down from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (TarSource, NpzSource, NpySource):
        spark.dataSource.register(source)
    return spark
