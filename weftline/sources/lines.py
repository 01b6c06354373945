"""JSON lines as a Spark data source of its own, and copy jobs over it: what a job writes is there as a whole or not at all."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal
from uuid import uuid4

import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import DataType, DateType, DecimalType, StructType, TimestampNTZType, TimestampType

FORMAT, STAGED = "weftline_lines", "_staged"


def _place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address (local, HDFS, S3, ...) and the path on it."""
    return fs.FileSystem.from_uri(f"file://{path[5:]}" if path.startswith("file:/") and not path.startswith("file://") else path)


def _files(path: str) -> list[str]:
    system, root = _place(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.endswith(".jsonl"))


def _plain(value: object) -> object:
    return value.isoformat() if isinstance(value, (date, datetime)) else str(value) if isinstance(value, Decimal) else value


def _typed(value: object, kind: DataType) -> object:
    if value is None:
        return None
    if isinstance(kind, (TimestampType, TimestampNTZType)):
        return datetime.fromisoformat(value)
    if isinstance(kind, DateType):
        return date.fromisoformat(value)
    return Decimal(value) if isinstance(kind, DecimalType) else value


@dataclass
class _File(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    path: str
    rows: int


class _Reader(DataSourceReader):
    """A partition for each file."""

    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in _files(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if not partition.path:
            return
        system, _ = _place(self.path)
        with system.open_input_stream(partition.path) as f:
            left = b""
            while chunk := f.read(1 << 20):
                *lines, left = (left + chunk).split(b"\n")
                yield from map(self._row, lines)
            if left:
                yield self._row(left)

    def _row(self, line: bytes) -> tuple:
        values = json.loads(line)
        return tuple(_typed(values.get(f.name), f.dataType) for f in self.schema)


class _Writer(DataSourceWriter):
    """Each task writes a staged file; when all have ended their files are moved into place, and after that, to overwrite, the old ones go. A failed job's files go unread."""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> _Written:
        system, root = _place(self.path)
        system.create_dir(f"{root}/{STAGED}", recursive=True)
        name, n = f"{root}/{STAGED}/{uuid4().hex}.jsonl", 0
        with system.open_output_stream(name) as f:
            for n, row in enumerate(rows, 1):
                f.write(json.dumps({k: _plain(v) for k, v in row.asDict(recursive=True).items() if v is not None}, ensure_ascii=False).encode() + b"\n")
        return _Written(name, n)

    def commit(self, messages: list[_Written | None]) -> None:
        system, root = _place(self.path)
        old = _files(self.path) if self.overwrite else []
        for m in messages:
            if m and m.rows:
                system.move(m.path, f"{root}/{m.path.rsplit('/', 1)[1]}")
        for path in old:
            system.delete_file(path)
        self._clean(messages)

    def abort(self, messages: list[_Written | None]) -> None:
        self._clean(messages)

    def _clean(self, messages: list[_Written | None]) -> None:
        """Staged files of this job's tasks alone; others may be writing."""
        system, _ = _place(self.path)
        for m in messages:
            if m and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class Lines(DataSource):
    """spark.read.format("weftline_lines").schema(...).load(folder), and df.write.format("weftline_lines").mode(...).save(folder)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], overwrite)


def load(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    spark.dataSource.register(Lines)
    return spark.read.format(FORMAT).schema(schema).load(path)


def copy_job(source: DataFrame, path: str, columns: list[str] | None = None, where: str | None = None, mode: str = "append", keys: list[str] | None = None) -> None:
    """Copy columns of rows that fit into a folder. ``mode``: append; overwrite; or replace, which takes the place of rows with the same ``keys`` (so a job that runs again
    changes nothing; of rows that repeat a key one is kept). A job that fails leaves the folder as it was."""
    spark = source.sparkSession
    spark.dataSource.register(Lines)
    rows = source.where(where) if where else source
    rows = rows.select(*columns) if columns else rows
    if mode == "replace":
        rows = rows.dropDuplicates(keys)
        rows = load(spark, path, rows.schema).join(rows.select(*keys), keys, "left_anti").select(*rows.columns).unionByName(rows)
    rows.write.format(FORMAT).mode("append" if mode == "append" else "overwrite").save(path)
