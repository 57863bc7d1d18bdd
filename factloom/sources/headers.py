"""Page files by their heads: a data source that reads the first bytes of each file, and bodies for the files that are wanted."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .pages import HEADER_BYTES, MAX_FILE_BYTES, check_root

SCHEMA = "path string, source_no int, page_no long, length long, head binary, bytes_read long, reject_reason string"


class Folder(InputPartition):
    def __init__(self, root: int, path: str):
        self.root, self.path = root, path


class HeadReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = options["roots"].split("\n")
        self.pattern = re.compile(options.get("pattern", r"page_(\d+)\.md$"))
        self.head = int(options.get("headBytes", HEADER_BYTES))
        self.most = int(options.get("maxBytes", MAX_FILE_BYTES))

    def partitions(self) -> list[Folder]:
        """One per folder: only folders are listed here, each task lists the files of its own."""
        out = []
        for number, root in enumerate(self.roots):
            system, path = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
            found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
            out += [Folder(number, path), *[Folder(number, f.path) for f in found if f.type == fs.FileType.Directory]]
        return out

    def read(self, partition: Folder) -> Iterator[tuple]:
        root = self.roots[partition.root]
        system = fs.FileSystem.from_uri(root)[0] if "://" in root else fs.LocalFileSystem()
        for info in system.get_file_info(fs.FileSelector(partition.path, allow_not_found=True)):
            number = self.pattern.search(info.path) if info.type == fs.FileType.File else None
            if not number:
                continue
            page = int(number[1]) if number.groups() and len(number[1]) < 19 else None
            row = (info.path, partition.root, page, info.size)
            if self.most and info.size > self.most:
                yield (*row, None, 0, "oversized")
                continue
            try:
                with system.open_input_file(info.path) as file:
                    head = file.read(self.head)
            except OSError as problem:
                yield (*row, None, 0, f"read_error: {type(problem).__name__}")
                continue
            yield (*row, head, len(head), None)


class PageHeads(DataSource):
    """``spark.read.format("page_heads")`` with the options roots (one a line), pattern, headBytes and maxBytes (0: any size)."""

    @classmethod
    def name(cls) -> str:
        return "page_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> HeadReader:
        return HeadReader(self.options)


def scan_heads(spark: SparkSession, roots: list[str], forbidden: tuple[str, ...] = (), head_bytes: int = HEADER_BYTES, max_bytes: int = MAX_FILE_BYTES,
               pattern: str = r"page_(\d+)\.md$") -> DataFrame:
    """One row per page file: its first bytes, or why it was not read (``oversized``, ``read_error``).  No body is loaded."""
    spark.dataSource.register(PageHeads)
    options = {"roots": "\n".join(check_root(r, forbidden) for r in roots), "headBytes": head_bytes, "maxBytes": max_bytes, "pattern": pattern}
    return spark.read.format("page_heads").options(**options).load()


def with_bodies(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with ``content``, the whole bytes of each, read where the row is; null if the file is gone."""
    at = files.columns.index(path)
    names = [*files.columns, "content"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one file at a time is in memory
                place = batch.column(at)[i].as_py()
                system, name = fs.FileSystem.from_uri(place) if "://" in place else (fs.LocalFileSystem(), place)
                try:
                    with system.open_input_file(name) as file:
                        body = file.read()
                except OSError:
                    body = None
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in batch.columns], pa.array([body], pa.binary())], names=names)

    return files.mapInArrow(work, f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in files.schema)}, content binary")


def rejects(files: DataFrame) -> DataFrame:
    """Counters of the files that were not read."""
    return files.where("reject_reason IS NOT NULL").groupBy(F.split("reject_reason", ":")[0].alias("reject_reason")).agg(F.count("*").alias("files"))
