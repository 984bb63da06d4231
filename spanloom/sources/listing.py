"""Folder listings made by tasks.

``FolderListing`` is a partitioned data source: the driver lists the root folder only, its sub-folders are dealt to
partitions, and each task lists what lies below its own.  Paths come as rows and never pass through the driver.
Folders are opened with ``pyarrow.fs``, which knows local paths, HDFS and the common object stores by their uri.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TASKS_PER_CORE = 4  # partitions of a listing, for each core of the session
READ_BYTES = 1 << 24  # content that one batch of files holds, about
_ROWS = 10_000


def open_folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an absolute path or a uri, and the path inside it."""
    system, inner = pafs.FileSystem.from_uri(path)
    return system, inner.rstrip("/") or "/"


def local_path(path: str) -> str:
    """A uri as it is, anything else as an absolute path."""
    return path if "://" in path or path.startswith("file:") else os.path.abspath(path)


@dataclass
class _Folders(InputPartition):
    paths: list[str]
    own: bool  # the root's own files; the others' folders with all below them


class _Reader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, parts: int):
        self.path, self.recursive, self.parts = path, recursive, parts

    def partitions(self) -> list[InputPartition]:
        system, root = open_folder(self.path)
        below = sorted(x.path for x in system.get_file_info(pafs.FileSelector(root)) if x.type == pafs.FileType.Directory)
        parts = min(len(below), self.parts) if self.recursive else 0
        return [_Folders([root], True), *(_Folders(below[i::parts], False) for i in range(parts))]

    def read(self, partition: _Folders) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(self.path)
        for path in partition.paths:
            found = system.get_file_info(pafs.FileSelector(path, recursive=not partition.own))
            if not partition.own:
                found = [system.get_file_info(path), *found]
            elif self.recursive:
                found = [x for x in found if x.type == pafs.FileType.File]
            for i in range(0, len(found), _ROWS):
                part = [x for x in found[i:i + _ROWS] if x.type in (pafs.FileType.File, pafs.FileType.Directory)]
                yield pa.record_batch(
                    [pa.array([x.path for x in part], pa.string()), pa.array([x.path[len(root.rstrip("/")) + 1:] for x in part], pa.string()),
                     pa.array([x.type == pafs.FileType.Directory for x in part], pa.bool_()),
                     pa.array([x.size or 0 for x in part], pa.int64())], names=["path", "below", "is_folder", "length"])


class FolderListing(DataSource):
    """Options ``path``, ``recursive`` and ``partitions``; a folder without files is listed too."""

    @classmethod
    def name(cls) -> str:
        return "spanloom_listing"

    def schema(self) -> str:
        return "path string, below string, is_folder boolean, length bigint"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("recursive", "true") == "true",
                       int(self.options.get("partitions", "64")))


def listing(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """``path, below, is_folder, length`` of all files and folders below ``root``; ``below`` is the path from there."""
    spark.dataSource.register(FolderListing)
    return (spark.read.format("spanloom_listing").option("recursive", str(recursive).lower())
            .option("partitions", TASKS_PER_CORE * spark.sparkContext.defaultParallelism).load(local_path(root)))


def read_files(spark: SparkSession, files: DataFrame, root: str) -> DataFrame:
    """``content`` for rows with a ``path`` of a listing of ``root``, read where the row is; other columns stay.

    Rows are dealt by their path first, so that folders of very different size don't leave tasks idle.  A
    batch holds about ``READ_BYTES`` of content; a file must fit a row.
    """
    uri = local_path(root)
    columns = [c for c in files.columns if c != "content"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(uri)
        for batch in batches:
            first, held, size = 0, [], 0
            for i, path in enumerate(batch["path"].to_pylist()):
                with system.open_input_stream(path) as stream:
                    held.append(stream.read())
                size += len(held[-1])
                if size >= READ_BYTES or i + 1 == batch.num_rows:
                    yield pa.record_batch([*batch.slice(first, len(held)).columns, pa.array(held, pa.binary())],
                                          names=[*batch.schema.names, "content"])
                    first, held, size = i + 1, [], 0

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*columns).schema)
    # A number of its own: paths are so few bytes that adaptive execution would put them all into one task.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.select(*columns).repartition(parts, "path").mapInArrow(run, f"{schema}, content binary")


def write_files(files: DataFrame, root: str) -> int:
    """Write one file per row of ``below, content`` under ``root``, from the tasks; returns how many.

    Folders are made as needed, null content is an empty file.  A file is written anew if its task runs twice,
    with the same content, so nothing has to be committed; ``below`` must be unique.
    """
    uri = local_path(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = open_folder(uri)
        for batch in batches:
            for below, content in zip(batch["below"].to_pylist(), batch["content"].to_pylist()):
                folder = f"{top}/{below}".rpartition("/")[0]
                system.create_dir(folder, recursive=True)
                with system.open_output_stream(f"{top}/{below}") as out:
                    out.write(content or b"")
            yield pa.record_batch([pa.array([batch.num_rows], pa.int64())], names=["n"])

    written = files.select("below", F.col("content").cast("binary")).mapInArrow(run, "n bigint")
    return written.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
