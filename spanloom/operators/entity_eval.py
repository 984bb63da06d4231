"""Entity-level evaluation: run merging, alignment, grading and scores.

Sentences are rows holding arrays, so merging, aligning and grading are
expressions inside the row; the only shuffle of a scoring job is the final
aggregate over a handful of entity types (plus one sentence-key join when gold
and predictions are separate tables).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at, inline_rows, let, run_starts
from spanloom.functions.batches import merged_rows, merged_runs
from spanloom.functions.tags import either_contains, repair_label, run_key, same_ignoring_case
from spanloom.operators.ordered import CHUNK_LINES, by_bucket, chunk_of, run_numbers, split_rows


def as_entities(tokens: Column, tags: Column) -> Column:
    """Token and tag arrays -> ``array<struct<entity_type, surface_string>>``."""
    return F.zip_with(tags, tokens, lambda t, w: F.struct(t.alias("entity_type"), w.alias("surface_string")))


def _continues(previous: Column, current: Column) -> Column:
    """``current`` is an inside tag of the class of the tag before it."""
    return (current.startswith("I-") & (previous != vocab.OUTSIDE)
            & (F.substr(previous, F.lit(3)) == F.substr(current, F.lit(3))))


def merge_runs(types: Column, surfaces: Column, mode: str = "suffix") -> Column:
    """Merge token rows into entities: ``struct<types, surfaces>``, aligned with the input.

    ``suffix``: neighbours whose types share the last three characters merge when
    the type has a listed ending, whatever their prefixes; the merged type is
    those three characters.  Other inside rows vanish, the rest stays.
    ``bio``: an entity is a begin tag with its inside tags; an inside tag with no
    fitting predecessor begins one.
    """
    if mode not in ("suffix", "bio"):
        raise ValueError(f"unknown mode {mode!r}")
    return merged_runs(types, surfaces, mode, vocab.OUTSIDE, vocab.RUN_SUFFIXES)


def explode_runs(merged: DataFrame) -> DataFrame:
    """``doc_id, sent_id, pos, entity_type, surface_string`` from a ``runs`` column."""
    runs = merged.select("doc_id", "sent_id", "runs.*")
    return (explode_at(runs, ["doc_id", "sent_id", "surfaces"], "types", "pos", "entity_type")
            .select("doc_id", "sent_id", "pos", "entity_type",
                    F.get("surfaces", F.col("pos")).alias("surface_string")))


def merge_runs_flat(rows: DataFrame, mode: str = "suffix", lines: int = CHUNK_LINES) -> DataFrame:
    """``merge_runs`` on flat ``doc_id, sent_id, pos, entity_type, surface_string`` rows of sentences of any size.

    Sentences whose positions lie below ``lines`` are gathered in packed buckets and merged whole.  The rows of others
    are numbered by run with a carried scan; only rows that may merge are gathered, run by run, since
    their surfaces end up in one string anyway.  The result has the rows of ``explode_runs``.
    """
    if mode not in ("suffix", "bio"):
        raise ValueError(f"unknown mode {mode!r}")
    key = ["doc_id", "sent_id"]
    rows = rows.select(*key, "pos", "entity_type", "surface_string").dropna(subset=[*key, "pos"])
    large = rows.where(chunk_of(F.col("pos"), lines) != 0).select(*key).distinct()
    long, short = split_rows(rows, large, *key)
    if mode == "bio":  # a row without a type is in no run
        short = short.where(F.col("entity_type").isNotNull())

    def merged(table: pa.Table) -> Iterator[pa.RecordBatch]:
        return merged_rows(table, key, mode, vocab.OUTSIDE, vocab.RUN_SUFFIXES)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in short.schema)
    return by_bucket(short, key, merged, schema).unionByName(_merge_scanned(long, mode, lines))


def _merge_scanned(rows: DataFrame, mode: str, lines: int) -> DataFrame:
    """``merge_runs_flat`` for sentences that do not fit a row."""
    kind = F.col("entity_type")
    if mode == "suffix":
        state, starts = run_key(kind), lambda before, now: ~before.eqNullSafe(now)
        merges = F.coalesce(run_key(kind).isin(*{x[-3:] for x in vocab.RUN_SUFFIXES}), F.lit(False))
    else:
        state, starts = kind, lambda before, now: ~_continues(before, now)
        merges = kind != vocab.OUTSIDE
    key = ["doc_id", "sent_id"]
    numbered = run_numbers(rows, key, "pos", state, starts, "_run", lines)
    marked = numbered.withColumn("_merges", merges)
    kept = ~kind.startswith("I-") if mode == "suffix" else F.lit(True)
    alone = marked.where(~F.col("_merges")).select(
        *key, "pos", F.when(kept, kind).alias("entity_type"), F.when(kept, F.col("surface_string")).alias("surface_string"))
    runs = (marked.where("_merges").groupBy(*key, "_run")
            .agg(F.array_sort(F.collect_list(F.struct("pos", "entity_type", "surface_string"))).alias("_x"))
            .select(*key, F.col("_x.pos").alias("_pos"),
                    merge_runs(F.col("_x.entity_type"), F.col("_x.surface_string"), mode).alias("_m")))
    merged = (explode_at(runs, [*key, "_m"], "_pos", "_i", "pos")
              .select(*key, "pos", F.get("_m.types", F.col("_i")).alias("entity_type"),
                      F.get("_m.surfaces", F.col("_i")).alias("surface_string")))
    return alone.unionByName(merged)


# type, partial, exact and strict grade of each case a pair may be in, see ``grade``.
_CASES = ((None,) * 4, ("SPU",) * 4, ("MIS",) * 4, ("COR",) * 4,
          ("COR", "PAR", "INC", "INC"), ("COR", "INC", "INC", "INC"),  # types agree; texts overlap, or don't
          ("COR", "COR", "COR", "INC"), ("INC", "COR", "COR", "INC"),  # texts agree; types but for case, or not
          ("INC", "PAR", "INC", "INC"), ("INC",) * 4)  # neither; texts overlap, or don't


def grade(gold_type: Column, gold: Column, pred_type: Column, pred: Column) -> Column:
    """``struct<type, partial, exact, strict>`` of one aligned pair.

    The pair's case is found once and its four grades looked up: the generated code stays small enough to be compiled.
    """
    no_gold = gold_type.isNull() & gold.isNull()
    no_pred = pred_type.isNull() & pred.isNull()

    def either(found: Column, case: int) -> Column:
        return F.when(found, F.lit(case)).otherwise(F.lit(case + 1))

    same_text = gold == pred
    case = (F.when(no_gold, F.when(no_pred, F.lit(0)).otherwise(F.lit(1))).when(no_pred, F.lit(2))
            .when(gold_type == pred_type, F.when(same_text, F.lit(3)).otherwise(either(either_contains(gold, pred), 4)))
            .when(same_text, either(same_ignoring_case(gold_type, pred_type), 6))
            .otherwise(either(either_contains(gold, pred), 8)))
    table = F.array(*[F.struct(*[F.lit(g).cast("string").alias(m) for m, g in zip(vocab.MODES, grades)]) for grades in _CASES])
    return F.get(table, case)


def join_sentences(gold: DataFrame, pred: DataFrame,
                   keys: tuple[str, ...] = ("doc_id", "sent_id")) -> DataFrame:
    """Gold sentences with the predicted ones of the same key; missing ones have no entities.

    Both sides hold ``entities``; the result has the four parallel arrays of ``aligned_pairs``.
    """
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.col("entities.entity_type").alias(f"{name}_types"),
                         F.col("entities.surface_string").alias(f"{name}_surfaces"))

    none = F.array().cast("array<string>")
    return side(gold, "gold").join(side(pred, "pred"), list(keys), "left").withColumns(
        {c: F.coalesce(c, none) for c in ("pred_types", "pred_surfaces")})


def aligned_pairs(sentences: DataFrame, mode: str = "suffix", by: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, sent_id, pos`` and the four pair columns, paired by position; ``by`` columns (a model, say) stay.

    ``sentences`` has ``gold_types, gold_surfaces, pred_types, pred_surfaces``.
    Predicted rows beyond the gold length are dropped.
    """
    keys = [*by, "doc_id", "sent_id"]
    merged = sentences.select(
        *keys, merge_runs(F.col("gold_types"), F.col("gold_surfaces"), mode).alias("g"),
        merge_runs(F.col("pred_types"), F.col("pred_surfaces"), mode).alias("p"))
    at = F.col("pos")
    return (explode_at(merged, [*keys, "g", "p"], "g.types", "pos", "entity_type_gold")
            .select(*keys, "pos", "entity_type_gold",
                    F.get("g.surfaces", at).alias("surface_string_gold"),
                    F.get("p.types", at).alias("entity_type_pred"),
                    F.get("p.surfaces", at).alias("surface_string_pred")))


def graded_pairs(pairs: DataFrame) -> DataFrame:
    """Add ``type, partial, exact, strict``."""
    columns = ("entity_type_gold", "surface_string_gold", "entity_type_pred", "surface_string_pred")
    return pairs.withColumn("_grade", grade(*map(F.col, columns))).select("*", "_grade.*").drop("_grade")


def grade_counts(graded: DataFrame, count_spurious: bool = False, include_outside: bool = True,
                 mode: str = "suffix", by: tuple[str, ...] = ()) -> DataFrame:
    """``Measure, Type, Partial, Exact, Strict, entity_type``, one row per type and grade (and value of ``by``).

    By default a row belongs to its gold type, so spurious rows belong to none
    and SPU stays 0; ``count_spurious`` puts them under the predicted type.
    All twenty counters come from one pass with map-side partial sums.  Names are
    repaired only in ``suffix`` mode, which is what cuts them.
    """
    owner = (F.coalesce("entity_type_gold", "entity_type_pred") if count_spurious
             else F.col("entity_type_gold"))
    rows = graded.withColumn("entity_type", owner).where(F.col("entity_type").isNotNull())
    if not include_outside:
        rows = rows.where(F.col("entity_type") != vocab.OUTSIDE)
    counters = [F.count_if(F.col(m) == g).alias(f"{g}_{m}") for g in vocab.GRADES for m in vocab.MODES]
    wide = rows.groupBy(*by, "entity_type").agg(*counters)
    measures = F.array(*[F.struct(F.lit(g).alias("Measure"),
                                  *[F.col(f"{g}_{m}").alias(m.capitalize()) for m in vocab.MODES])
                         for g in vocab.GRADES])
    name = F.col("entity_type")
    return wide.select(*by, F.inline(measures), (repair_label(name) if mode == "suffix" else name).alias("entity_type"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _f1(p: str, r: str) -> Column:
    return _ratio(2 * F.col(p) * F.col(r), F.col(p) + F.col(r))


def _with_overall(rows: DataFrame, name: str, by: tuple[str, ...], *sums: Column) -> DataFrame:
    """``sums`` per value of ``name`` and, as ``Overall``, per group of ``by``."""
    totals = rows.groupingSets([[*by, name], [*by]], *by, name).agg(*sums, F.grouping(name).alias("_total"))
    return totals.withColumn(name, F.when(F.col("_total") == 1, "Overall").otherwise(F.col(name))).drop("_total")


def entity_metrics(counts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per type and ``Overall`` (of each value of ``by``): each grade averaged over the four modes, then P/R/F1."""
    over_modes = F.col("Type") + F.col("Partial") + F.col("Exact") + F.col("Strict")
    sums = _with_overall(counts, "entity_type", by, *[
        (F.sum(F.when(F.col("Measure") == g, over_modes).otherwise(0)) / 4).alias(g) for g in vocab.GRADES])
    cor, inc, par, mis, spu = (F.col(g) for g in vocab.GRADES)
    return (sums
            .withColumn("POS", cor + inc + par + mis)
            .withColumn("ACT", cor + inc + par + spu)
            .withColumn("Exact_Precision", _ratio(cor, F.col("ACT")))
            .withColumn("Exact_Recall", _ratio(cor, F.col("POS")))
            .withColumn("Exact_F1", _f1("Exact_Precision", "Exact_Recall"))
            .withColumn("Partial_Precision", _ratio(cor + 0.5 * par, F.col("ACT")))
            .withColumn("Partial_Recall", _ratio(cor + 0.5 * par, F.col("POS")))
            .withColumn("Partial_F1", _f1("Partial_Precision", "Partial_Recall"))
            .select(*by, "entity_type", "POS", "ACT", "Exact_Precision", "Exact_Recall", "Exact_F1",
                    "Partial_Precision", "Partial_Recall", "Partial_F1"))


def mode_metrics(counts: DataFrame) -> DataFrame:
    """``entity_type, mode, precision, recall, f1`` from the counts of a single mode.

    A partial match is worth one half in the modes that know it.
    """
    long = counts.unpivot(["entity_type", "Measure"], [m.capitalize() for m in vocab.MODES],
                          "mode", "n")
    sums = long.groupBy("entity_type", "mode").agg(
        *[F.sum(F.when(F.col("Measure") == g, F.col("n")).otherwise(0)).cast("double").alias(g)
          for g in vocab.GRADES])
    return _mode_scores(sums.withColumn("mode", F.lower("mode")), "entity_type", "mode")


def _mode_scores(sums: DataFrame, *keys: str) -> DataFrame:
    cor, inc, par, mis, spu = (F.col(g) for g in vocab.GRADES)
    return (sums.withColumn("precision", _ratio(cor + 0.5 * par, cor + inc + par + spu))
            .withColumn("recall", _ratio(cor + 0.5 * par, cor + inc + par + mis))
            .withColumn("f1", _f1("precision", "recall"))
            .select(*keys, "precision", "recall", "f1"))


def span_array(tokens: Column, tags: Column) -> Column:
    """``array<struct<start, end, label, text>>``: the entity spans of a tagged sentence.

    A span starts at a begin tag, or at an inside tag that does not continue the
    tag before; ``end`` is exclusive.
    """
    def spans(bound: Column, words: Column) -> Column:
        def span(starts: Column) -> Column:
            return F.transform(starts, lambda s, p: F.struct(
                s.alias("start"),
                F.coalesce(F.get(starts, p + 1), F.size(bound)).alias("end")))

        def named(cuts: Column) -> Column:
            inside = F.filter(cuts, lambda c: F.get(bound, c["start"]) != vocab.OUTSIDE)
            return F.transform(inside, lambda c: F.struct(
                c["start"].alias("start"), c["end"].alias("end"),
                F.substr(F.get(bound, c["start"]), F.lit(3)).alias("label"),
                F.array_join(F.slice(words, c["start"] + 1, c["end"] - c["start"]), " ").alias("text")))

        starts = run_starts(bound, lambda before, now: ~_continues(before, now))
        return let(let(starts, span), named)

    return let(tokens, lambda words: let(tags, lambda bound: spans(bound, words)))


def bio_spans(sentences: DataFrame, tags: str) -> DataFrame:
    """``doc_id, sent_id, start, end, label, text`` from ``tokens`` and a tag array column."""
    return inline_rows(sentences, ["doc_id", "sent_id"], span_array(F.col("tokens"), F.col(tags)), "start")


def graded_entities(tagged: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Graded pairs of the BIO entities of a sentence, aligned on their first token.

    ``tagged`` has ``tokens, gold, pred``; outside rows count as no entity, and
    unmatched entities of either side are kept.
    """
    pairs = aligned_pairs(tagged.select(
        *by, "doc_id", "sent_id", F.col("gold").alias("gold_types"), F.col("tokens").alias("gold_surfaces"),
        F.col("pred").alias("pred_types"), F.col("tokens").alias("pred_surfaces")), "bio", by)

    def entity_only(side: str) -> dict[str, Column]:
        inside = F.col(f"entity_type_{side}") != vocab.OUTSIDE
        return {f"{c}_{side}": F.when(inside, F.col(f"{c}_{side}")) for c in ("surface_string", "entity_type")}

    return graded_pairs(pairs.withColumns({**entity_only("gold"), **entity_only("pred")}))


def span_scores(graded: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``label, tp, predicted, support, precision, recall, f1`` on exact spans, and ``Overall`` (of each ``by``).

    ``graded`` is ``graded_entities``: both sides share the sentence's tokens, so
    spans agree in start, end and label exactly when the strict grade is COR.
    """
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    hit = F.when(F.col("strict") == "COR", one).otherwise(zero)
    sides = F.array(
        F.struct(F.col("entity_type_gold").alias("label"), hit.alias("tp"), zero.alias("predicted"),
                 one.alias("support")),
        F.struct(F.col("entity_type_pred").alias("label"), zero.alias("tp"), one.alias("predicted"),
                 zero.alias("support")))
    rows = graded.where(F.col("strict").isNotNull()).select(*by, F.inline(sides)).where(F.col("label").isNotNull())
    flags = [F.sum(c).alias(c) for c in ("tp", "predicted", "support")]
    sums = _with_overall(rows.groupBy(*by, "label").agg(*flags), "label", by, *flags)
    return (sums.withColumn("precision", _ratio(F.col("tp").cast("double"), F.col("predicted")))
            .withColumn("recall", _ratio(F.col("tp").cast("double"), F.col("support")))
            .withColumn("f1", _f1("precision", "recall")))


def _count_modes(graded: DataFrame, *keys: str) -> DataFrame:
    """``keys, mode`` and one column per grade; twenty counters in one pass."""
    wide = graded.groupBy(*keys).agg(*[F.count_if(F.col(m) == g).alias(f"{g}_{m}")
                                       for g in vocab.GRADES for m in vocab.MODES])
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), *[F.col(f"{g}_{m}").alias(g) for g in vocab.GRADES])
                      for m in vocab.MODES])
    return wide.select(*keys, F.inline(modes))


def muc_by_sentence(tagged: DataFrame) -> DataFrame:
    """``doc_id, sent_id, mode`` and one column per grade, counted inside the sentence row.

    ``tagged`` has ``tokens, gold, pred``; pairs are those of ``graded_entities``.
    """
    def inside(side: Column, i: Column) -> tuple[Column, Column]:
        kind = F.get(side["types"], i)
        return F.when(kind != vocab.OUTSIDE, kind), F.when(kind != vocab.OUTSIDE, F.get(side["surfaces"], i))

    def grades(gold: Column, pred: Column) -> Column:
        return F.transform(gold["types"], lambda _, i: grade(*inside(gold, i), *inside(pred, i)))

    def count(letters: Column, name: str) -> Column:
        return (F.length(letters) - F.length(F.translate(letters, name[0], ""))).alias(name)

    def counts(bound: Column) -> Column:
        # One string of initials per mode, so that counting needs no lambda: the grades differ in their first letter.
        letters = F.array(*[F.array_join(F.transform(bound[m], lambda x: F.substr(x, F.lit(1), F.lit(1))), "")
                            for m in vocab.MODES])
        return let(letters, lambda each: F.array(*[
            F.struct(F.lit(m).alias("mode"), *[count(F.get(each, F.lit(i)), g) for g in vocab.GRADES])
            for i, m in enumerate(vocab.MODES)]))

    merged = tagged.select("doc_id", "sent_id", *[merge_runs(F.col(c), F.col("tokens"), "bio").alias(f"_{c}") for c in ("gold", "pred")])
    return inline_rows(merged, ["doc_id", "sent_id"], let(grades(F.col("_gold"), F.col("_pred")), counts), "mode")


def muc_scores(graded: DataFrame) -> DataFrame:
    """``mode, COR…SPU, precision, recall, f1`` pooled over all sentences."""
    return _mode_scores(_count_modes(graded), "mode", *vocab.GRADES)
