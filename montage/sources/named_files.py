"""Data sources over whole files: text files under names of their own, and subtitles and JSON read with faults set aside.

`named_text` writes rows (file, line) as text files below a folder. All lines of a file must come to one task in their
order, as `write_files` sees to; a task streams them out and holds none. Files are written beside their place and moved
there when all tasks have ended, so a failed job leaves nothing behind and no half-written file is ever seen.

`srt_files` and `json_files` read every file below a folder in tasks of some `splitBytes` of files. A file that cannot be
read, decoded or parsed gives one row with the reason in `error` and nulls besides; the others are not affected.

Folders are those of any file system that pyarrow can open: local or shared paths, file://, hdfs://, s3://, gs://.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from montage.sources.subtitles import ENCODINGS


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path inside it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- writing --------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    folder: str
    files: list[str]


class _TextWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        disk, root = opened(self.path)
        folder, files, out, now = f"{root}/{self.staging}/{uuid4().hex}", [], None, None
        try:
            for batch in iterator:
                for file, line in zip(batch.column("file").to_pylist(), batch.column("line").to_pylist(), strict=True):
                    if file != now:
                        if out is not None:
                            out.close()
                        parts = file.split("/")
                        if file.startswith("/") or "" in parts or ".." in parts or "." in parts:
                            raise ValueError(f"not a name of a file below the folder: {file!r}")
                        disk.create_dir(posixpath.dirname(f"{folder}/{file}"), recursive=True)
                        out, now = disk.open_output_stream(f"{folder}/{file}"), file
                        files.append(file)
                    out.write((line + "\n").encode("utf-8"))
        finally:
            if out is not None:
                out.close()
        if len(files) != len(set(files)):
            raise ValueError("the lines of a file must come together")
        return _Written(folder, files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        disk, root = opened(self.path)
        done = [m for m in messages if isinstance(m, _Written)]
        every = [f for m in done for f in m.files]
        if len(every) != len(set(every)):
            self.abort(messages)
            raise ValueError("the lines of a file must come to one task")
        if not self.overwrite and (there := [f for f in every if disk.get_file_info(f"{root}/{f}").type != fs.FileType.NotFound]):
            self.abort(messages)
            raise FileExistsError(f"{there[0]} exists already")
        for folder in {posixpath.dirname(f"{root}/{f}") for f in every}:
            disk.create_dir(folder, recursive=True)
        for m in done:
            for f in m.files:
                disk.move(f"{m.folder}/{f}", f"{root}/{f}")
        self._clear(disk, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear(*opened(self.path))

    def _clear(self, disk: fs.FileSystem, root: str) -> None:
        if disk.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            disk.delete_dir(f"{root}/{self.staging}")


class NamedText(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_text"

    def schema(self) -> str:
        return "file string, line string"

    def writer(self, schema: StructType, overwrite: bool) -> _TextWriter:
        return _TextWriter(self.options["path"], overwrite)


def write_files(lines: DataFrame, path: str, *order: str, overwrite: bool = False) -> None:
    """Rows (file, line) as text files below `path`, the lines of a file in the order of the columns `order`.

    A file that exists already is an error unless `overwrite`. A file is written by one task, which holds none of it.
    """
    lines.sparkSession.dataSource.register(NamedText)
    placed = lines.repartition("file").sortWithinPartitions("file", *order).select("file", "line")
    placed.write.format("named_text").option("path", path).mode("overwrite" if overwrite else "append").save()


# ---- reading --------------------------------------------------------------------------------------------------------


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _WholeFiles(DataSourceReader):
    """Files by the bytes of `splitBytes` to a task; a larger file is a task of its own."""

    def __init__(self, options: Mapping[str, str], pattern: str):
        self.path, self.pattern = options["path"], options.get("pattern", pattern)
        self.split = int(options.get("splitBytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        disk, root = opened(self.path)
        info = disk.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else disk.get_file_info(fs.FileSelector(root, recursive=True))
        parts: list[list[str]] = [[]]
        size = 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)), key=lambda f: f.path):
            if parts[-1] and size + f.size > self.split:
                parts.append([])
                size = 0
            parts[-1].append(f.path)
            size += f.size
        return [_Files(p) for p in parts]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        disk, _ = opened(self.path)
        for path in partition.paths:
            try:
                with disk.open_input_stream(path) as f:
                    rows = self.parse(f.read())
            except (OSError, ValueError) as e:
                yield self.failed(path, f"{type(e).__name__}: {e}"[:500])
                continue
            for row in rows:
                yield (path, *row, None)


def decode(data: bytes) -> str:
    """Text in the first of ENCODINGS that fits, without a byte-order mark; ValueError if none does."""
    for name in ENCODINGS:
        try:
            return data.decode(name).lstrip("﻿")
        except UnicodeDecodeError:
            continue
    raise ValueError(f"the text is in none of {', '.join(ENCODINGS)}")


_CUE = re.compile(r"\s*(\d+)\s*\n\s*([\d:,.]+)\s*-->\s*([\d:,.]+)[^\n]*\n(.*)", re.DOTALL)


def seconds(code: str) -> float:
    """Seconds of hh:mm:ss,mmm; ValueError where it is none."""
    hours, minutes, rest = code.replace(",", ".").split(":")
    return int(hours) * 3600 + int(minutes) * 60 + float(rest)


class _Srt(_WholeFiles):
    def parse(self, data: bytes) -> list[tuple]:
        rows = []
        for cue in re.split(r"\n\s*\n", decode(data).replace("\r", "")):
            if (m := _CUE.match(cue)) and (text := m[4].replace("\n", " ").strip()):
                rows.append((int(m[1]), seconds(m[2]), seconds(m[3]), text))
        return rows

    def failed(self, path: str, why: str) -> tuple:
        return (path, None, None, None, None, why)


class _Json(_WholeFiles):
    def parse(self, data: bytes) -> list[tuple]:
        return [(json.dumps(json.loads(data.decode("utf-8-sig")), ensure_ascii=False),)]

    def failed(self, path: str, why: str) -> tuple:
        return (path, None, why)


class SrtFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srt_files"

    def schema(self) -> str:
        return "media string, seg_index int, start double, end double, text string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Srt(self.options, "*.srt")


class JsonFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_files"

    def schema(self) -> str:
        return "path string, value string, error string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Json(self.options, "*.json")


def _read(spark: SparkSession, kind: type[DataSource], path: str, options: dict[str, Any]) -> DataFrame:
    spark.dataSource.register(kind)
    return spark.read.format(kind.name()).options(**options).load(path)


def read_subtitles(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """media (path), seg_index, start, end, text of every cue with text below `path`; for a broken file one row with `error`.

    Options: pattern (of names, *.srt), splitBytes (of files a task).
    """
    return _read(spark, SrtFiles, path, options)


def read_json_files(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """path, value (the whole document), error of every JSON file below `path`. Options: pattern (*.json), splitBytes."""
    return _read(spark, JsonFiles, path, options)
