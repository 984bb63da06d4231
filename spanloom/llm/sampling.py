"""Bounded training samples of documents; the only place where rows are not all used."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TARGETS = 1 << 16  # targets whose sizes are broadcast; of more a hash-chosen part is looked at


def training_texts(docs: DataFrame, targets: DataFrame, limit: int, max_chars: int, id_col: str = "doc_id",
                   text_col: str = "text", balanced: bool = False) -> DataFrame:
    """``text, target`` of at most ``limit`` documents, chosen by a hash of the id.

    ``targets`` has ``id_col, target``; null targets are left out, of several for one id the
    least counts.  ``balanced`` takes turns over the targets, so rare ones are not missed.
    Texts that are null, empty or over ``max_chars`` are not trained on; of several texts of one id
    one counts, chosen by its hash.  So there are at most ``limit`` rows, whatever the ids.  The chosen ids, and
    the hashes of their texts, are broadcast to scans of the texts; no text moves that is not chosen.
    """
    known = targets.where("target is not null").groupBy(id_col).agg(F.min("target").alias("target"))

    def share(column: str) -> F.Column:
        return F.pmod(F.xxhash64(column), F.lit(1 << 30)) / (1 << 30)

    # By their hash, targets (or all rows) are thinned to about twice the limit before they are ranked.
    if balanced:
        sizes = known.groupBy("target").agg(F.count("*").alias("size"))
        part = TARGETS / max(sizes.count(), TARGETS)
        few = sizes.where(share("target") < part / 2) if part < 1 else sizes
        ranked = (known.join(F.broadcast(few), "target").where(share(id_col) * F.col("size") < 2 * limit)
                  .withColumn("turn", F.row_number().over(Window.partitionBy("target").orderBy(F.xxhash64(id_col), id_col))))
    else:
        size = known.agg(F.count("*").alias("size")).scalar()
        ranked = known.where(share(id_col) * size < 2 * limit).withColumn("turn", F.lit(0))
    chosen = ranked.orderBy("turn", F.xxhash64(id_col), id_col).limit(limit).select(id_col, "target")
    # Two scans: the first finds one text of each chosen id by its hash, the second fetches it.
    texts = (docs.select(id_col, F.col(text_col).alias("text"), F.xxhash64(text_col).alias("pick"))
             .where(F.length("text").between(1, max_chars)).join(F.broadcast(chosen), id_col))
    picks = texts.groupBy(id_col).agg(F.min("pick").alias("pick"))
    return texts.join(F.broadcast(picks), [id_col, "pick"]).select("text", "target").dropDuplicates()
