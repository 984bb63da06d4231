"""Counts over labels, tags and concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(labelled: DataFrame) -> DataFrame:
    """``label, n``: occurrences over all spans."""
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def tag_counts(lines: DataFrame, *by: str) -> DataFrame:
    """``tag, n``: lines per tag."""
    return lines.groupBy(*by, "tag").agg(F.count(F.lit(1)).alias("n"))


def tag_chars(lines: DataFrame, *by: str) -> DataFrame:
    """``tag, n_chars``: characters of all tokens per tag."""
    return lines.groupBy(*by, "tag").agg(F.sum(F.length("token")).alias("n_chars"))


def parent_rollup(labelled: DataFrame) -> DataFrame:
    """``parent, label, concept, level, n``: span counts at all levels.

    ``level`` 0 = concept, 1 = label, 3 = parent, 7 = everything.
    """
    return (labelled.rollup("parent", "label", "concept")
            .agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("n")))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def class_weights(lines: DataFrame) -> DataFrame:
    """``tag, n, weight`` with weight = lines / (tags * lines of the tag)."""
    counts = tag_counts(lines)
    # One row per tag is left; the totals come as a scalar subquery over that.
    numerator = counts.select(F.sum("n") / F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", numerator / F.col("n"))
