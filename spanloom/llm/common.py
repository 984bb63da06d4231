"""Helpers the corpus operators share: tables, word cutting, shared folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.session import shuffles_removed

WHITESPACE = b" \t\n\x0b\x0c\r"  # the bytes between words: [\x20\x09-\x0D]
BITMAP_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none."""
    return text.encode().split() if text else []


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def spread(df: DataFrame) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; files go when the result is no longer used.

    The session names the folder in ``spark.checkpoint.dir``.  A local session without
    one gets a temporary folder; on a cluster a missing setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    with shuffles_removed(spark):
        return df.checkpoint()


def split_by_keys(rows: DataFrame, found: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose ``keys`` may be in ``found``, and those whose keys are certainly not.

    Keys are hashed into a bitmap of ``BITMAP_BITS``, at most 8 MB whatever the data, which is
    broadcast; so rows without a partner need not move to be told so.  Rows of the first kind are
    still to be joined.  The more keys, the more rows are of the first kind; no result depends on it.
    """
    bucket, bits = fresh(rows, "_bucket"), fresh(rows, "_bits")

    def slot(df: DataFrame) -> F.Column:
        return F.pmod(F.xxhash64(*(df[k] for k in keys)), F.lit(BITMAP_BITS)) + 1

    table = found.groupBy(F.bitmap_bucket_number(slot(found)).alias(bucket)).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot(found))).alias(bits))
    at = F.bitmap_bit_position(slot(rows)).cast("int")
    marked = rows.join(F.broadcast(table), F.bitmap_bucket_number(slot(rows)) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, at % 8) == 1, F.lit(False))
    return marked.where(hit).drop(bucket, bits), marked.where(~hit).drop(bucket, bits)


def map_batches(df: DataFrame, cook: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch],
                schema: str) -> DataFrame:
    """``mapInArrow`` over single batches; ``cook`` returns a batch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield cook(batch)
        pa.default_memory_pool().release_unused()  # a worker outlives its tasks

    return df.mapInArrow(run, schema)


def in_share(doc_id: str, modulus: int, rest: int) -> F.Column:
    """Whether crc32 of the id as text leaves ``rest``."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(modulus)) == rest, F.lit(False))
