"""Corpus preparation: notes and spans -> clean, windowed, split token lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.bio import bio_lines_unbounded, explode_lines, label_spans, line_docs
from spanloom.operators.lines import LOOK_BACK_PASSES, dedupe_lines_chain, dedupe_struct, window_docs
from spanloom.operators.split import split_cuts, split_of


def _cleaned(notes: DataFrame, labelled: DataFrame, passes: tuple[int, ...]) -> DataFrame:
    """``doc_id, tokens, tags``: tagged and de-duplicated inside the document row."""
    kept = line_docs(notes, labelled).select("doc_id", dedupe_struct(F.col("lines"), passes).alias("lines"))
    return kept.select("doc_id", "lines.*")


def prepared_lines(notes: DataFrame, spans: DataFrame, passes: tuple[int, ...] = LOOK_BACK_PASSES) -> DataFrame:
    """``doc_id, line_no, token, tag`` after labelling, tagging and the de-duplication passes.

    A note stays one row until the very end, with its text, its spans and its lines.
    """
    return explode_lines(_cleaned(notes, label_spans(spans), passes))


def prepared_lines_unbounded(notes: DataFrame, spans: DataFrame,
                             passes: tuple[int, ...] = LOOK_BACK_PASSES) -> DataFrame:
    """The same lines without gathering the spans of a note, for notes that have spans too many for a row."""
    return dedupe_lines_chain(bio_lines_unbounded(notes, label_spans(spans)), passes)


def prepared_docs(notes: DataFrame, spans: DataFrame, passes: tuple[int, ...] = LOOK_BACK_PASSES) -> DataFrame:
    """``doc_id, tokens, tags``: the same lines, one row per document."""
    return _cleaned(notes, label_spans(spans), passes)


def prepared_sentences(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, sent_id, tokens, tags``: the windows of every document as rows."""
    return window_docs(_cleaned(notes, label_spans(spans), LOOK_BACK_PASSES))


def split_sentences(notes: DataFrame, spans: DataFrame, *splits: str,
                    cuts: DataFrame | None = None) -> DataFrame:
    """``split`` and the sentences of the given splits.

    The split follows from the document id and two cut keys, so documents and spans of other
    splits are left out where they are read, before any text moves.
    """
    cuts = split_cuts(notes) if cuts is None else cuts
    wanted = split_of(F.col("doc_id"), cuts).isin(*splits)
    rows = prepared_sentences(notes.where(wanted), spans.where(wanted))
    return rows.select(split_of(F.col("doc_id"), cuts).alias("split"), "*")
