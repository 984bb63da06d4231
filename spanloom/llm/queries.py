"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import (decontam, hardneg, langid, lexical, licences, lm, packing, quality, rules, secretscan, simhash,
                          substrings, urls)
from spanloom.llm.common import table
from spanloom.llm.oracle import ORACLE as ORACLE

# Fixed values of the contract: host, path, verdict.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"),
             ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"), licences.known_digests(spark))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_repeats(table(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_language(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge_urls(table(spark, sf_dir, "pages"), rules)


def op11_hard_negative_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    component = lambda x: F.when(F.isnan(x) | x.isin(float("inf"), float("-inf")), None).otherwise(
        F.floor(256 * x.cast("double")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"),
                                                     F.transform("embedding", component).alias("vector"))
    return hardneg.mine(rows, F.col("vec_id") % 50 == 0)


def op12_ranked_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secretscan.find_secrets(table(spark, sf_dir, "documents"))
    kinds = [rule.kind for rule in secretscan.BASE_RULES]

    def of_kind(*wanted: str) -> F.Column:
        return F.filter("spans", lambda x: x["kind"].isin(*wanted))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    return found.select("doc_id", *[F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in kinds],
                        F.sha2(joined(of_kind(*kinds)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_license_scan, op2_quality_classifier, op3_simhash_near_dedup, op4_packing,
                            op5_substring_dedup, op6_quality_rules, op7_benchmark_decontamination,
                            op8_language_id, op9_lm_scoring, op10_url_filters, op11_hard_negative_mining,
                            op12_ranked_lexical_search, op13_secret_scans)}
