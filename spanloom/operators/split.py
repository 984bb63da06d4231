"""Train / validation / test split of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ratios, seed and split names.
TRAIN_RATIO, VALIDATION_RATIO, TEST_RATIO = 0.11, 0.78, 0.11
SEED = 42
SPLITS = ("TRAIN", "VALIDATION", "TEST")

_BUCKET_DIGITS = 3  # 16^3 = 4096 hash buckets


def _check(train: float, validation: float, test: float) -> None:
    if abs(train + validation + test - 1) > 1e-9:
        raise ValueError("Ratios must sum to 1.")


def shuffle_key(doc_id: Column, seed: int) -> Column:
    """A seeded pseudo-random order of documents, the same on every run."""
    return F.md5(F.concat(F.lit(f"{seed}-"), doc_id.cast("string")))


def split_cuts(docs: DataFrame, train: float = TRAIN_RATIO, validation: float = VALIDATION_RATIO,
               test: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """One row ``train, validation``: the last (key, id) of the first two splits, of exact size.

    Sizes are ``int(n * ratio)``, the remainder goes to TEST.  The rank over all documents is the
    rank inside a hash bucket plus the number of documents in smaller buckets.  Buckets are
    even (the hash is uniform over distinct ids) and their table has at most 4096 rows, so it
    is broadcast.  Only ids are read.
    """
    _check(train, validation, test)
    ids = (docs.select("doc_id").distinct()
           .withColumn("_key", shuffle_key(F.col("doc_id"), seed))
           .withColumn("_bucket", F.substring("_key", 1, _BUCKET_DIGITS)))
    counts = ids.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 4096 rows reach these unpartitioned windows.
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding,
                                                  Window.unboundedFollowing)
    offsets = counts.select("_bucket",
                            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                            F.sum("_n").over(whole).alias("_all"))
    inside = Window.partitionBy("_bucket").orderBy("_key", "doc_id")
    rank = F.col("_before") + F.row_number().over(inside)
    cut_train = F.floor(F.col("_all") * F.lit(train))
    cut_validation = cut_train + F.floor(F.col("_all") * F.lit(validation))
    place = F.struct("_key", "doc_id")
    return (ids.join(F.broadcast(offsets), "_bucket").withColumn("_rank", rank)
            .agg(F.max(F.when(F.col("_rank") <= cut_train, place)).alias("train"),
                 F.max(F.when(F.col("_rank") <= cut_validation, place)).alias("validation")))


def split_of(doc_id: Column, cuts: DataFrame, seed: int = SEED) -> Column:
    """The split of a document id, from ``split_cuts`` as scalar subqueries: no join, no shuffle."""
    place = F.struct(shuffle_key(doc_id, seed).alias("_key"), doc_id.alias("doc_id"))
    return (F.when(place <= cuts.select("train").scalar(), SPLITS[0])
            .when(place <= cuts.select("validation").scalar(), SPLITS[1]).otherwise(SPLITS[2]))


def split_map(docs: DataFrame, train: float = TRAIN_RATIO, validation: float = VALIDATION_RATIO,
              test: float = TEST_RATIO, seed: int = SEED) -> DataFrame:
    """``doc_id, split`` of every document, sizes as in ``split_cuts``."""
    cuts = split_cuts(docs, train, validation, test, seed)
    return docs.select("doc_id").distinct().select("doc_id", split_of(F.col("doc_id"), cuts, seed).alias("split"))


def split_by_hash(docs: DataFrame, train: float = TRAIN_RATIO,
                  validation: float = VALIDATION_RATIO, test: float = TEST_RATIO,
                  seed: int = SEED) -> DataFrame:
    """Add ``split`` by a threshold on the hash: no shuffle at all, sizes only approximate."""
    _check(train, validation, test)
    share = (F.conv(F.substring(shuffle_key(F.col("doc_id"), seed), 1, 13), 16, 10).cast("double")
             / F.lit(float(16 ** 13)))
    return docs.withColumn("split", F.when(share < train, SPLITS[0])
                           .when(share < train + validation, SPLITS[1]).otherwise(SPLITS[2]))


def assign_split(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add ``split`` to any table with a ``doc_id``; rows without an entry get null."""
    return df.join(mapping, "doc_id", "left")
