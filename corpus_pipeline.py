"""Documents to training sequences: rules, near copies, repeats, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last
return the columns of ``documents``.  Null texts and ids are treated as the operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import decontam, packing, rules, simhash, substrings
from spanloom.llm.common import cut_lineage, fresh, split_by_keys, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the trees keep."""
    return rules.keep_good(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group that SimHash links, with the operator's shingle and radius.

    Rows without an id all stay; of rows that repeat an id one stays.  Null and empty texts are one group.
    """
    groups = cut_lineage(simhash.near_duplicates(docs, shingle=simhash.SHINGLE, max_bits=simhash.MAX_BITS)
                         .select("doc_id", "component_id").where("doc_id is not null"))
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    rows = groups.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("component_id").alias("least"))
    doubtful = rows.where("rows > 1 or least <> doc_id").select("doc_id")  # copies and repeated rows
    check, single = split_by_keys(docs, doubtful, "doc_id")
    kept = check.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(check.where("doc_id is null")).unionByName(single)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents that had words and have none left go."""
    had, word = fresh(docs, "_had"), F.lit(r"[^\x20\x09-\x0D]")
    cut = (substrings.cut_repeats(docs.withColumn(had, F.coalesce(F.rlike("text", word), F.lit(False))))
           .where(~F.col(had) | F.rlike("text", word)).drop(had))
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; items too short to be one drop nothing."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), least_chars=decontam.CHARS_PER_ERROR)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality_rules), ("near-dedup", near_dedup),
          ("substring dedup", substring_dedup), ("benchmark decontamination", decontaminate), ("packing", pack)]

# Learned trees decide in the first stage, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents; what a stage returns is checkpointed for the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
