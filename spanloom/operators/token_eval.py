"""Token-level evaluation: pairing gold with predicted tags and scoring the pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at
from spanloom.functions.tags import strip_prefix


def last_per_token(df: DataFrame, tag: str, order: str) -> DataFrame:
    """``token, tag``: the tag at the highest ``order`` of each token.

    ``order`` is any comparable column, so a struct of keys of any type and size gives corpus
    order.  The first step reduces to (token, tag) before and after the shuffle.
    """
    latest = df.groupBy("token", tag).agg(F.max(order).alias("_at"))
    return latest.groupBy("token").agg(F.max_by(tag, "_at").alias(tag))


def pairs_by_token(gold: DataFrame, pred: DataFrame, order: str = "at") -> DataFrame:
    """``token, true, pred``: last gold and last predicted tag of each predicted token.

    Equals the many-to-many join on the token followed by keep-last, without
    ever forming the pairs.
    """
    return last_per_token(gold, "true", order).join(last_per_token(pred, "pred", order),
                                                    "token", "right")


def drop_outside(df: DataFrame, tag: str, every_column: bool = True) -> DataFrame:
    """Rows left when ``O`` counts as missing and rows with a missing value are dropped.

    With ``every_column`` a token that is spelled ``O`` is dropped as well.
    """
    present = (F.col(tag) != vocab.OUTSIDE) & F.col("token").isNotNull()
    return df.where(present & (F.col("token") != vocab.OUTSIDE) if every_column else present)


def pairs_by_token_no_outside(gold: DataFrame, pred: DataFrame, order: str = "at",
                              every_column: bool = True) -> DataFrame:
    """Last non-outside gold and predicted tag of each token that has both."""
    g = last_per_token(drop_outside(gold, "true", every_column), "true", order)
    p = last_per_token(drop_outside(pred, "pred", every_column), "pred", order)
    return g.join(p, "token", "inner")


def pair_counts_by_token(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """``token, true, pred, n_pairs``: the many-to-many token join with multiplicities.

    Each side is counted by (token, tag) before the join, so the join meets at
    most tags x tags rows per token however often the token occurs.
    """
    g = gold.groupBy("token", "true").agg(F.count(F.lit(1)).alias("_g"))
    p = pred.groupBy("token", "pred").agg(F.count(F.lit(1)).alias("_p"))
    return g.join(p, "token", "right").select(
        "token", "true", "pred", (F.coalesce("_g", F.lit(1)) * F.col("_p")).alias("n_pairs"))


def pair_counts_in_rows(rows: DataFrame) -> DataFrame:
    """``pair_counts_by_token`` for rows that hold both tags: one pass, no join.

    A token has at most as many counts as there are tags, so they fit its row.
    """
    side = F.inline(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("tag")) for c in ("true", "pred")]))
    counts = rows.select("token", side).groupBy("token", "side", "tag").agg(F.count(F.lit(1)).alias("n"))
    lists = counts.groupBy("token").agg(*[
        F.collect_list(F.when(F.col("side") == c, F.struct(F.col("tag").alias(c), F.col("n").alias(f"n_{c}")))).alias(c)
        for c in ("true", "pred")])
    return (lists.select("token", "pred", F.inline("true")).select("token", "true", "n_true", F.inline("pred"))
            .select("token", "true", "pred", (F.col("n_true") * F.col("n_pred")).alias("n_pairs")))


def pairs_by_position(gold: DataFrame, pred: DataFrame,
                      keys: tuple[str, ...] = ("doc_id", "sent_id", "tok_idx")) -> DataFrame:
    """Gold and predicted tag of the same token, from two token tables; rows of either side stay."""
    sides = (gold.select(*keys, F.col("token").alias("_gold_token"), "true"),
             pred.select(*keys, F.col("token").alias("_pred_token"), "pred"))
    return sides[0].join(sides[1], list(keys), "full").select(
        *keys, F.coalesce("_gold_token", "_pred_token").alias("token"), "true", "pred")


def last_pairs(rows: DataFrame, order: str = "at", outside: bool = True) -> DataFrame:
    """``token, true, pred`` of ``pairs_by_token`` for rows that hold both tags, in one pass.

    Without ``outside`` it equals ``pairs_by_token_no_outside``: outside tags, and tokens spelled
    like one, count as missing, and tokens without both tags are left out.
    """
    side = F.explode(F.array(*[F.struct(F.lit(c).alias("side"), F.col(c).alias("tag")) for c in ("true", "pred")]))
    tags = rows.select("token", order, side.alias("_x")).select("token", order, "_x.*")
    if not outside:
        tags = tags.where((F.col("tag") != vocab.OUTSIDE) & (F.col("token") != vocab.OUTSIDE))
    latest = tags.groupBy("token", "side", "tag").agg(F.max(order).alias("_at"))
    both = latest.groupBy("token").agg(*[
        F.max_by(F.when(F.col("side") == c, F.col("tag")), F.when(F.col("side") == c, F.col("_at"))).alias(c)
        for c in ("true", "pred")])
    return both if outside else both.dropna(subset=["true", "pred"])


def pairs_in_rows(tagged: DataFrame, *carry: str) -> DataFrame:
    """The same from sentence rows that hold ``tokens``, ``gold`` and ``pred`` arrays: no shuffle."""
    keys = (*carry, "doc_id", "sent_id")
    at = F.col("tok_idx")
    return (explode_at(tagged, [*keys, "gold", "pred"], "tokens", "tok_idx", "token")
            .select(*keys, "tok_idx", "token", F.get("gold", at).alias("true"), F.get("pred", at).alias("pred")))


def strip_pairs(pairs: DataFrame, mode: str = "all") -> DataFrame:
    """Class instead of tag on both sides."""
    return (pairs.withColumn("true", strip_prefix(F.col("true"), mode))
            .withColumn("pred", strip_prefix(F.col("pred"), mode)))


def pair_counts(pairs: DataFrame, *by: str) -> DataFrame:
    """``true, pred, n``: the one pass over the data; all scores derive from it."""
    return pairs.groupBy(*by, "true", "pred").agg(F.count(F.lit(1)).alias("n"))


def confusion(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """``true, pred, n`` for every pair of ``labels``, zeros included; other tags are ignored."""
    grid = (counts.sparkSession.range(1)
            .select(F.explode(vocab.literal_array(labels)).alias("true"))
            .select("true", F.explode(vocab.literal_array(labels)).alias("pred"))
            .withColumn("n", F.lit(0).cast("bigint")))
    listed = counts.where(F.col("true").isin(*labels) & F.col("pred").isin(*labels))
    return (listed.select("true", "pred", "n").unionByName(grid)
            .groupBy("true", "pred").agg(F.sum("n").alias("n")))


def confusion_wide(counts: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """One row per true label, one column per predicted label."""
    return (confusion(counts, labels).groupBy("true").pivot("pred", list(labels))
            .agg(F.sum("n")))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))


def class_scores(counts: DataFrame, labels: tuple[str, ...] | None = None,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """``tag, tp, predicted, support, precision, recall, f1``, 0 where undefined.

    Without ``labels`` every tag of either side gets a row; with them exactly
    those do, though predictions of pairs outside the list still count.
    """
    hit = F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0)
    zero = F.lit(0).cast("bigint")
    sides = [
        F.struct(F.col("true").alias("tag"), hit.alias("tp"), zero.alias("predicted"),
                 F.col("n").alias("support")),
        F.struct(F.col("pred").alias("tag"), zero.alias("tp"), F.col("n").alias("predicted"),
                 zero.alias("support"))]
    if labels is not None and by:  # every value of ``by`` gets every label, without counting a second time
        sides += [F.struct(F.lit(x).alias("tag"), *[zero.alias(c) for c in ("tp", "predicted", "support")]) for x in labels]
    rows = counts.select(*by, F.inline(F.array(*sides))).where(F.col("tag").isNotNull())
    if labels is not None:
        rows = rows.where(F.col("tag").isin(*labels))
        if not by:
            rows = rows.unionByName(counts.sparkSession.range(1).select(
                F.explode(vocab.literal_array(labels)).alias("tag"),
                zero.alias("tp"), zero.alias("predicted"), zero.alias("support")))
    sums = rows.groupBy(*by, "tag").agg(*[F.sum(c).alias(c) for c in ("tp", "predicted", "support")])
    scored = (sums.withColumn("precision", _ratio(F.col("tp"), F.col("predicted")))
              .withColumn("recall", _ratio(F.col("tp"), F.col("support"))))
    return scored.withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def _f1(p: Column, r: Column) -> Column:
    return _ratio(2 * p * r, p + r)


def average_scores(scores: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``average, precision, recall, f1, support`` for macro, micro and weighted.

    ``scores`` is ``class_scores`` without a label list.
    """
    def weighted(c: str) -> Column:
        return _ratio(F.sum(F.col(c) * F.col("support")), F.sum("support"))

    sums = scores.groupBy(*by).agg(
        F.sum("support").alias("support"),
        *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")],
        _ratio(F.sum("tp"), F.sum("predicted")).alias("micro_precision"),
        _ratio(F.sum("tp"), F.sum("support")).alias("micro_recall"),
        *[weighted(c).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")])
    sums = sums.withColumn("micro_f1", _f1(F.col("micro_precision"), F.col("micro_recall")))
    kinds = F.array(*[F.struct(F.lit(k).alias("average"),
                               *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")],
                               F.col("support"))
                      for k in ("macro", "micro", "weighted")])
    return sums.select(*by, F.inline(kinds))


def scores_wide(scores: DataFrame, labels: tuple[str, ...]) -> DataFrame:
    """Measures as rows, labels as columns."""
    named = scores.select("tag", F.col("precision").alias("Precision"), F.col("recall").alias("Recall"),
                          F.col("f1").alias("F1-score"), F.col("support").cast("double").alias("Support"))
    return (named.unpivot("tag", ["Precision", "Recall", "F1-score", "Support"], "measure", "value")
            .groupBy("measure").pivot("tag", list(labels)).agg(F.first("value")))
