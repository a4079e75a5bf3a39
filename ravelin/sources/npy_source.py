"""Dense matrices in NumPy's binary format, written and read in parallel.

A matrix is a folder of `.npy` files, each a run of its rows, and an index that
the driver writes when all tasks have finished. Files carry their task's
attempt and only what the index names is read, so a repeated task, or a job
that fails half way, leaves nothing that counts; what an aborted job has
written is removed. A reader takes ranges of rows by their place in a file.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ravelin.plans.staging import file_store

SCHEMA = "row long, values array<double>"
INDEX = "_matrix.json"
#: Bytes of values that a task holds, and a file's at most unless a row is longer; rows of a range that is read.
FILE_BYTES, RANGE_ROWS = 1 << 25, 1 << 16


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, int, int, int]]


@dataclass
class Rows(InputPartition):
    file: str
    first: int
    begin: int
    end: int


class NpyWriter(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self._folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        store, root = file_store(self._folder)
        store.create_dir(root)
        attempt = TaskContext.get().taskAttemptId()
        done: list[tuple[str, int, int, int]] = []
        held: list[np.ndarray] = []
        first, size = 0, 0

        def flush() -> None:
            name = f"rows-{first:012d}-{attempt}-{uuid.uuid4().hex[:8]}.npy"
            block = np.concatenate(held)
            data = io.BytesIO()
            np.lib.format.write_array(data, block, allow_pickle=False)
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(data.getbuffer())
            done.append((name, first, len(block), block.shape[1]))

        for rb in iterator:
            rows, lists = np.asarray(rb.column(0)), rb.column(1)
            if not len(rb):
                continue
            widths = np.unique(np.asarray(lists.value_lengths()))
            if len(widths) > 1 or lists.null_count or (held and held[0].shape[1] != widths[0]):
                raise ValueError("the rows of a matrix have one length")
            values = np.asarray(lists.flatten(), np.float64).reshape(len(rb), widths[0])
            # A file holds consecutive rows; runs of a batch are taken one by one.
            for run in np.split(np.arange(len(rb)), np.flatnonzero(np.diff(rows) != 1) + 1):
                if held and (rows[run[0]] != first + sum(map(len, held)) or size >= FILE_BYTES):
                    flush()
                    held.clear()
                if not held:
                    first, size = int(rows[run[0]]), 0
                held.append(values[run])
                size += held[-1].nbytes
        if held:
            flush()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: f[1])
        store, root = file_store(self._folder)
        ends = [0]
        for _, first, rows, width in files:
            if first != ends[-1] or width != files[0][3]:
                raise ValueError(f"rows of a matrix run from 0 without gaps, in one length: row {first} follows {ends[-1] - 1}")
            ends.append(first + rows)
        store.create_dir(root)
        with store.open_output_stream(f"{root}/{INDEX}") as out:
            out.write(json.dumps({"rows": ends[-1], "columns": files[0][3] if files else 0, "files": [f[:3] for f in files]}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = file_store(self._folder)
        for name, *_ in (f for m in messages if m for f in m.files):
            if store.get_file_info(f"{root}/{name}").is_file:
                store.delete_file(f"{root}/{name}")


class NpyReader(DataSourceReader):
    def __init__(self, folder: str, first: int, last: int | None):
        self._folder, self._first, self._last = folder, first, last

    def partitions(self) -> list[Rows]:
        store, root = file_store(self._folder)
        with store.open_input_stream(f"{root}/{INDEX}") as f:
            files = json.loads(f.read())["files"]
        out = []
        for name, first, rows in files:
            begin = max(0, self._first - first)
            end = rows if self._last is None else min(rows, self._last + 1 - first)
            out += [Rows(name, first, at, min(end, at + RANGE_ROWS)) for at in range(begin, end, RANGE_ROWS)]
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as there is none
            return
        store, root = file_store(self._folder)
        with store.open_input_file(f"{root}/{partition.file}") as f:
            version = np.lib.format.read_magic(f)
            shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
            width = shape[1]
            f.seek(f.tell() + partition.begin * width * kind.itemsize)
            values = np.frombuffer(f.read((partition.end - partition.begin) * width * kind.itemsize), kind)
        n = partition.end - partition.begin
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) + partition.first + partition.begin), lists], names=["row", "values"])


class Npy(DataSource):
    @classmethod
    def name(cls) -> str:
        return "npy_matrix"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"])

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("first", 0)), int(self.options["last"]) if "last" in self.options else None)


def write_matrix(rows: DataFrame, folder: str, row: str = "row", values: str = "values") -> None:
    """Write (row, values) as `.npy` files to a new folder.

    Row numbers run from 0 without gaps, once each, and all rows have one
    length, without nulls; otherwise nothing is left and ValueError says why. A
    table without rows gives an empty index. Rows are dealt by range, so a file
    is a stretch of the matrix; other columns are not written.
    """
    rows.sparkSession.dataSource.register(Npy)
    chosen = rows.select(F.col(row).cast("long").alias("row"), F.col(values).cast("array<double>").alias("values"))
    chosen.repartitionByRange("row").sortWithinPartitions("row").write.format("npy_matrix").mode("append").save(folder)


def read_matrix(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """(row, values) of a matrix, or of its rows from `first` to `last`; only the bytes of these are read."""
    spark.dataSource.register(Npy)
    options = {"first": str(first)} | ({} if last is None else {"last": str(last)})
    return spark.read.format("npy_matrix").options(**options).load(folder)
