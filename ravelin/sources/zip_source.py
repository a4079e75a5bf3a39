"""ZIP archives as a data source: a member a partition, streamed by ranges of bytes.

The driver reads only the central directories, which say where each member
lies; a task opens its archive for random access, seeks to its member and
inflates it block by block, so neither an archive nor a member is ever held
whole, whatever its size.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ravelin.plans.staging import file_store

SCHEMA = "path string, member string, line long, value string"
#: Lines of an Arrow batch at most, and letters that are read at once.
LINES, BYTES = 8192, 1 << 20


@dataclass
class Member(InputPartition):
    path: str
    name: str


def members(path: str, ending: str, skip: list[str], first_only: bool) -> list[str]:
    """Names in the central directory that end so and hold no word of `skip`, in order of name."""
    store, place = file_store(path)
    with store.open_input_file(place) as f, zipfile.ZipFile(f) as z:
        names = sorted(n for n in z.namelist() if n.lower().endswith(ending) and not any(w in n.lower() for w in skip))
    return names[:1] if first_only else names


class ZipReader(DataSourceReader):
    def __init__(self, options: dict):
        self._paths = json.loads(options["paths"])
        self._choice = options.get("ending", ""), json.loads(options.get("skip", "[]")), options.get("first_only") == "true"

    def partitions(self) -> list[Member]:
        return [Member(p, n) for p in self._paths for n in members(p, *self._choice)]

    def read(self, partition: Member | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # as there is none
            return
        store, place = file_store(partition.path)

        def batch(first: int, held: list[str]) -> pa.RecordBatch:
            n = len(held)
            return pa.RecordBatch.from_arrays([pa.array([partition.path] * n), pa.array([partition.name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())], names=["path", "member", "line", "value"])

        with store.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(partition.name) as member:
            first, rest, lines = 0, [], io.TextIOWrapper(member, "utf-8", errors="replace")
            while block := lines.read(BYTES):
                held = block.split("\n")
                if len(held) == 1:  # within a line
                    rest.append(block)
                    continue
                held[0], rest = "".join([*rest, held[0]]), [held.pop()]
                for at in range(0, len(held), LINES):
                    yield batch(first + at, held[at : at + LINES])
                first += len(held)
            if last := "".join(rest):
                yield batch(first, [last])


class ZipLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "zip_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ZipReader:
        return ZipReader(self.options)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files that a path or pattern names, a name each, in order."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.globStatus(place) or []
    out = []
    for status in found:
        inner = fs.listStatus(status.getPath()) if status.isDirectory() else [status]
        out += [str(s.getPath().toString()) for s in inner if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    if not out:
        raise FileNotFoundError(f"no file at {path}")
    return sorted(out)


def zip_lines(spark: SparkSession, path: str, ending: str = "", skip: list[str] = (), first_only: bool = False) -> DataFrame:
    """(path, member, line, value): the lines, from 0, of the chosen members of the ZIP files at `path`.

    Names end in `ending` and hold no word of `skip`, both in lower case; with
    `first_only` an archive gives its first such member. Bytes that are no
    UTF-8 become replacement marks. An empty member gives no rows; a missing
    path is an error, a damaged archive too.
    """
    spark.dataSource.register(ZipLines)
    return spark.read.format("zip_lines").options(paths=json.dumps(files(spark, path)), ending=ending, skip=json.dumps([w.lower() for w in skip]), first_only=str(first_only).lower()).load()
