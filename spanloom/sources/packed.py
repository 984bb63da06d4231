"""Many documents in few files, with an index by document.

A task writes its documents one after the other into one data file, and where each lies into an index file of
its own.  Files count only once a manifest names them: it is written by the driver when all tasks are done, as
one small file.  A task that is lost or runs twice leaves files that no manifest names; a job that fails removes
what it wrote.  So there are as many data files as tasks, whatever the number of documents, and readers never
see half a job.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition,
                                    WriterCommitMessage)

from spanloom.sources.listing import local_path, open_folder

READ_BYTES = 1 << 24


@dataclass
class _Written(WriterCommitMessage):
    name: str | None
    documents: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = open_folder(self.path)
        name, ids, begins, lengths, at = uuid.uuid4().hex, [], [], [], 0
        stream = None
        for batch in iterator:
            if stream is None and batch.num_rows:
                system.create_dir(f"{root}/data", recursive=True)
                system.create_dir(f"{root}/index", recursive=True)
                stream = system.open_output_stream(f"{root}/data/{name}.txt")
            ids.append(batch.column(0))
            for text in batch.column(1).cast(pa.binary()):
                body = text.as_py()
                begins.append(at if body is not None else None)
                lengths.append(len(body) if body is not None else None)
                if body is not None:
                    stream.write(body + b"\n")
                    at += len(body) + 1
        if stream is None:
            return _Written(None, 0)
        stream.close()
        table = pa.table({"doc_id": pa.chunked_array(ids), "begin": pa.array(begins, pa.int64()),
                          "length": pa.array(lengths, pa.int64())})
        with system.open_output_stream(f"{root}/index/{name}.parquet") as out:
            pq.write_table(table, out)
        return _Written(name, len(begins))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_folder(self.path)
        system.create_dir(f"{root}/manifest", recursive=True)
        earlier = [x.path for x in system.get_file_info(pafs.FileSelector(f"{root}/manifest"))]
        parts = {m.name: m.documents for m in messages if m and m.name}
        with system.open_output_stream(f"{root}/manifest/{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps({"parts": parts}).encode())
        for path in earlier if self.overwrite else ():
            system.delete_file(path)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, root = open_folder(self.path)
        for message in messages:
            for path in (f"{root}/data/{message.name}.txt", f"{root}/index/{message.name}.parquet") if message and message.name else ():
                if system.get_file_info(path).type == pafs.FileType.File:
                    system.delete_file(path)


@dataclass
class _Part(InputPartition):
    name: str


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [_Part(name) for name in parts_of(self.path)] or [_Part("")]

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        if not partition.name:
            return
        system, root = open_folder(self.path)
        with system.open_input_file(f"{root}/index/{partition.name}.parquet") as source:
            index = pq.read_table(io.BytesIO(source.read())).combine_chunks()
        begins, lengths = index["begin"].to_pylist(), index["length"].to_pylist()
        with system.open_input_stream(f"{root}/data/{partition.name}.txt") as stream:
            texts, size, first = [], 0, 0
            for i, (begin, length) in enumerate(zip(begins, lengths)):
                texts.append(None if begin is None else stream.read(length + 1)[:-1].decode())
                size += length or 0
                if size >= READ_BYTES or i + 1 == len(begins):
                    ids = index["doc_id"].slice(first, len(texts)).combine_chunks()
                    yield pa.record_batch([ids, pa.array(texts, pa.string())], names=["doc_id", "text"])
                    texts, size, first = [], 0, i + 1


class PackedDocuments(DataSource):
    """``doc_id, text``; option ``id_type`` names the type of the ids that are read."""

    @classmethod
    def name(cls) -> str:
        return "spanloom_packed"

    def schema(self) -> str:
        return f"doc_id {self.options.get('id_type', 'string')}, text string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite)


def parts_of(path: str) -> dict[str, int]:
    """The committed parts below ``path`` with their number of documents."""
    system, root = open_folder(local_path(path))
    found = system.get_file_info(pafs.FileSelector(f"{root}/manifest", allow_not_found=True))
    parts: dict[str, int] = {}
    for manifest in found:
        with system.open_input_stream(manifest.path) as stream:
            parts |= json.loads(stream.read())["parts"]
    return parts


def write_packed(docs: DataFrame, path: str, mode: str = "append") -> None:
    """``doc_id, text`` rows as packed files; null texts stay null.  ``overwrite`` replaces what was committed."""
    docs.sparkSession.dataSource.register(PackedDocuments)
    (docs.select("doc_id", F.col("text").cast("string")).write.format("spanloom_packed").mode(mode)
     .option("path", local_path(path)).save())


def read_packed(spark: SparkSession, path: str, id_type: str = "string") -> DataFrame:
    """``doc_id, text`` of all committed documents, one task per packed file."""
    spark.dataSource.register(PackedDocuments)
    return spark.read.format("spanloom_packed").option("id_type", id_type).load(local_path(path))
