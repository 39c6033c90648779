"""Box tables by point lookup: of tables sorted by id, only the row groups that hold an id asked for are read.

Ids asked for are dealt by table and sorted, so a task goes through a table once,
with one row group and one batch of ids held.  A row group whose bounds are not
known, or are of ids that lost their leading zeros, is read like one that fits.
Ids are in lower case, in the tables too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolsieve.sources import files

_BOXES = pa.list_(pa.list_(pa.float64()))
#: Rows of a group when tables are written.
GROUP_ROWS = 10_000


def _bounds(table: pq.ParquetFile) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest id of each row group; all ids where they are not known."""
    at = table.schema_arrow.get_field_index("uid")
    low, high = [], []
    for g in range(table.num_row_groups):
        told = table.metadata.row_group(g).column(at).statistics
        known = told is not None and told.has_min_max and len(told.min) == len(told.max) == 32
        low.append(told.min if known else "")
        high.append(told.max if known else "g" * 32)
    return np.array(low), np.array(high)


def _found(table: pq.ParquetFile, bounds: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Ids of ``wanted``, which are sorted and different, that the table has, with their boxes."""
    low, high = bounds
    first, end = np.searchsorted(wanted, low), np.searchsorted(wanted, high, side="right")
    for g in np.flatnonzero(first < end):
        rows = table.read_row_group(int(g), columns=["uid"])
        ids = np.array([x.rjust(32, "0").lower() if x is not None else "" for x in rows["uid"].to_pylist()])
        here = np.flatnonzero(np.isin(ids, wanted))
        if len(here):
            boxes = table.read_row_group(int(g), columns=["face_bboxes"])["face_bboxes"].combine_chunks()
            yield ids[here], boxes.take(pa.array(here)).cast(_BOXES)


def _lookup(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    path, stream, table, bounds = None, None, None, None
    for batch in batches:
        paths = np.array(batch.column("path").to_pylist())
        for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.r_[0, np.flatnonzero(paths[1:] != paths[:-1]) + 1, len(paths)] if len(paths) else np.zeros(1, int)), strict=True):
            if paths[lo] != path:
                if stream is not None:
                    stream.close()
                path = str(paths[lo])
                stream = files.open_input(path)
                table = pq.ParquetFile(stream)
                bounds = _bounds(table)
            for ids, boxes in _found(table, bounds, np.unique(np.array(batch.column("uid").slice(lo, hi - lo).to_pylist()))):
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(ids)), pa.array(ids), boxes], ["path", "uid", "face_bboxes"])
    if stream is not None:
        stream.close()


def lookup_boxes(wanted: DataFrame) -> DataFrame:
    """``path, uid, face_bboxes`` for the rows ``path, uid`` that the box table at ``path`` has; ids are 32 lower-case digits."""
    asked = wanted.select("path", "uid").where("path IS NOT NULL AND uid IS NOT NULL").distinct()
    return asked.repartition("path").sortWithinPartitions("path", "uid").mapInArrow(_lookup, "path string, uid string, face_bboxes array<array<double>>")


def write_boxes(boxes: DataFrame, folder: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One table sorted by id for each ``parquet`` of ``parquet, uid, face_bboxes``; returns ``parquet, path``.

    A table appears under its name when it is whole, so a task may run again.
    """

    def run(batches):
        import uuid

        name = out = writer = temp = None

        def close():
            writer.close()
            out.close()
            files.move(temp, files.join(folder, f"{name}.parquet"))
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([files.join(folder, f"{name}.parquet")])], ["parquet", "path"])

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            for table in dict.fromkeys(batch.column("parquet").to_pylist()):
                if table != name:
                    if name is not None:
                        yield close()
                    name, temp = table, files.join(folder, f"_{uuid.uuid4().hex}")
                    out = files.open_output(temp)
                    writer = pq.ParquetWriter(out, rows.select(["uid", "face_bboxes"]).schema)
                mine = rows.filter(pa.compute.equal(rows["parquet"], table)).select(["uid", "face_bboxes"])
                writer.write_table(mine, row_group_size=group_rows)
        if name is not None:
            yield close()

    sorted_rows = boxes.select("parquet", "uid", "face_bboxes").where("parquet IS NOT NULL").repartition("parquet").sortWithinPartitions("parquet", "uid")
    done = sorted_rows.mapInArrow(run, "parquet string, path string").collect()  # one row for each table
    return boxes.sparkSession.createDataFrame(done, "parquet string, path string")
