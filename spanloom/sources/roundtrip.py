"""Write each file format from whole tables, read it back and compare inside Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import profile, split
from spanloom.operators.entity_eval import as_entities
from spanloom.operators.predict import explode_sentences
from spanloom.plans import corpus
from spanloom.session import stage, staging_path
from spanloom.sources import readers, sinks


def _digest(df: DataFrame, *columns: str) -> DataFrame:
    """Row count and an order-free checksum."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0)).alias("checksum"))


def _compare(name: str, before: DataFrame, after: DataFrame, *columns: str) -> DataFrame:
    sides = [_digest(df, *columns).withColumn("side", F.lit(s))
             for s, df in (("written", before), ("read", after))]
    total = sides[0].unionByName(sides[1]).agg(
        F.max(F.when(F.col("side") == "written", F.col("n"))).alias("n_written"),
        F.max(F.when(F.col("side") == "read", F.col("n"))).alias("n_read"),
        (F.count_distinct("checksum") == 1).alias("same"))
    return total.select(F.lit(name).alias("format"), "*")


def check(spark: SparkSession, notes: DataFrame, spans: DataFrame) -> DataFrame:
    """``format, n_written, n_read, same`` for the text, JSON, CSV, TSV and Parquet paths."""
    prepared = corpus.prepared_sentences(notes, spans)
    rows = stage(prepared, "sentences")  # computed once; the formats are compared with what was staged
    sentences = rows.withColumn("split", split.split_of(F.col("doc_id"), split.split_cuts(rows)))

    text = staging_path(spark, "split-text")
    sinks.write_split_sentences(sentences, text)
    read = readers.read_sentences(spark, text)

    entities = sentences.select("doc_id", "sent_id", as_entities(
        F.col("tokens"), F.col("tags")).alias("entities"))
    json = staging_path(spark, "entities")
    sinks.write_entity_lines(entities, json, "gzip")

    counts = profile.tag_counts(explode_sentences(rows))
    csv, tsv = staging_path(spark, "counts-csv"), staging_path(spark, "counts-tsv")
    sinks.write_table(counts, csv)
    sinks.write_table(counts, tsv, "\t")
    table = "tag string, n bigint"
    parquet = staging_path(spark, "sentences-parquet")
    rows.write.option("compression", "zstd").parquet(parquet)

    return reduce(DataFrame.unionByName, (
        _compare("sentence text", sentences, read, "tokens", "tags"),
        _compare("entity json", entities, readers.read_entity_lines(spark, json, "bigint"),
                 "doc_id", "sent_id", "entities"),
        _compare("csv", counts, spark.read.schema(table).option("header", "true").csv(csv), "tag", "n"),
        _compare("tsv", counts, spark.read.schema(table).option("header", "true")
                 .option("sep", "\t").csv(tsv), "tag", "n"),
        _compare("parquet", rows, spark.read.parquet(parquet), "doc_id", "sent_id", "tokens", "tags")))
