"""Character spans over notes -> labelled token lines (B-/I-/O)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at, inline_rows, running_total
from spanloom.functions.batches import lines_of, word_count, words_of
from spanloom.functions.text import cut, is_number, pieces, substring_span, word_pieces
from spanloom.operators.ordered import CHUNK_LINES, chunk_of, running_before, split_rows, value_before

PIECE_CHARS = 1 << 12  # characters of a note in one row of ``note_pieces``, and of a cell
_CHARS_PER_CHUNK = 1 << 16
ROW_CHARS, ROW_SPANS = 1 << 20, 1 << 16  # of notes that are tagged in their row


def label_spans(spans: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """Add ``label``: numbers -> DEC, mapped concepts -> their label, anything else -> SUB.

    Without ``vocabulary`` the fixed 49-row table is broadcast.  A caller's own
    ``concept, label`` table gets no hint, so Spark broadcasts it only below its
    size threshold.  Null concepts are dropped here, see ``null_concepts``.
    """
    table = vocabulary if vocabulary is not None else F.broadcast(vocab.concept_table(spans.sparkSession))
    mapped = table.select("concept", F.col("label").alias("_mapped"))
    return (spans.where(F.col("concept").isNotNull())
            .join(mapped, "concept", "left")
            .withColumn("label", F.when(is_number(F.col("concept")), F.lit(vocab.NUMBER_LABEL))
                        .otherwise(F.coalesce("_mapped", F.lit(vocab.DEFAULT_LABEL))))
            .drop("_mapped"))


def null_concepts(spans: DataFrame) -> DataFrame:
    """The quarantine side of ``label_spans``: spans that carry no concept."""
    return spans.where(F.col("concept").isNull())


def broken_spans(spans: DataFrame) -> DataFrame:
    """Spans without a begin or an end; they place no text."""
    return spans.where(F.col("begin").isNull() | F.col("end").isNull())


def concept_parents(spans: DataFrame) -> DataFrame:
    """Add ``parent``, null for concepts outside the vocabulary."""
    table = F.broadcast(vocab.concept_table(spans.sparkSession))
    return spans.join(table.select("concept", "parent"), "concept", "left")


def _segment(begin: Column, end: Column, label: Column) -> Column:
    return F.struct(begin.cast("int").alias("b"), end.cast("int").alias("e"), label.alias("l"))


def line_arrays(text: Column, spans: Column) -> Column:
    """``struct<tokens, tags>``: all lines of a note from its text and its sorted spans; see ``lines_of``."""
    return lines_of(text, spans["begin"], spans["end"], spans["label"], vocab.OUTSIDE)


def gather_spans(labelled: DataFrame) -> DataFrame:
    """``doc_id, spans``: the sorted spans of each note, without the note text.

    Spans without both offsets are left out, see ``broken_spans``.
    """
    placed = labelled.where(F.col("begin").isNotNull() & F.col("end").isNotNull())
    return placed.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("begin", "end", "ann_id", "label"))).alias("spans"))


def line_docs(notes: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, lines``: a ``struct<tokens, tags>`` per note, notes without spans included.

    Only the narrow span rows are grouped; the text meets them in a one-to-one
    join and everything after that stays inside the row.
    """
    empty = F.array().cast("array<struct<begin:int,end:int,ann_id:bigint,label:string>>")
    narrow = labelled.select("doc_id", F.col("begin").cast("int"), F.col("end").cast("int"),
                             F.col("ann_id").cast("bigint"), "label")
    return notes.join(gather_spans(narrow), "doc_id", "left").select(
        "doc_id", line_arrays(F.coalesce("text", F.lit("")), F.coalesce("spans", empty)).alias("lines"))


def bio_docs(notes: DataFrame, labelled: DataFrame) -> DataFrame:
    """``doc_id, tokens, tags``: one row per note; see ``line_docs``."""
    return line_docs(notes, labelled).select("doc_id", "lines.*")


def explode_lines(docs: DataFrame) -> DataFrame:
    """``doc_id, line_no, token, tag``; ``line_no`` counts from 1 in document order."""
    return (explode_at(docs, ["doc_id", "tags"], "tokens", "_pos", "token")
            .select("doc_id", (F.col("_pos") + 1).alias("line_no"), "token",
                    F.get("tags", F.col("_pos")).alias("tag")))


def span_texts(notes: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, ann_id, surface``: the characters each span covers."""
    places = spans.groupBy("doc_id").agg(F.collect_list(F.struct("ann_id", "begin", "end")).alias("_spans"))
    texts = notes.join(places, "doc_id").select("doc_id", "_spans", pieces(F.col("text")).alias("_parts"))
    cuts = F.transform("_spans", lambda s: F.struct(s["ann_id"].alias("ann_id"), F.lit(True).alias("_is"),
                                                    cut(F.col("_parts"), s["begin"], s["end"]).alias("surface")))
    return inline_rows(texts, ["doc_id"], cuts, "_is").drop("_is")


def note_pieces(notes: DataFrame, chars: int = PIECE_CHARS) -> DataFrame:
    """``doc_id, piece, begin, text``: notes in rows of about ``chars`` characters that end between words."""
    cut_up = notes.select("doc_id", word_pieces(F.col("text"), chars).alias("_parts"))
    ends = running_total(F.transform("_parts", lambda x: F.length(x).cast("bigint")))
    return (explode_at(cut_up.withColumn("_ends", ends), ["doc_id", "_ends"], "_parts", "piece", "text")
            .select("doc_id", "piece", (F.get("_ends", F.col("piece")) - F.length("text")).alias("begin"), "text"))


def _ordered_segments(pieces: DataFrame, labelled: DataFrame, annotated_only: bool) -> DataFrame:
    """``doc_id, seg, part, b, e, label``: gap (part 0) and span (1) of every span, then the tail (2)."""
    order = ["begin", "end", "ann_id", "label"]
    stretch = F.floor(F.col("begin") / _CHARS_PER_CHUNK)
    spans = labelled.where(F.col("begin").isNotNull() & F.col("end").isNotNull()).select("doc_id", *order)
    placed = value_before(spans, "doc_id", stretch, order, "end", "before")
    placed = running_before(placed, "doc_id", stretch, order, F.lit(1), "seg")
    none = F.lit(None).cast("string")
    inner = placed.select("doc_id", "seg", F.posexplode(F.array(
        _segment(F.coalesce("before", F.lit(0)), F.col("begin"), none),
        _segment(F.col("begin"), F.col("end"), F.col("label")))).alias("part", "_s"))
    last = spans.groupBy("doc_id").agg(F.max_by("end", F.struct(*order)).alias("_from"), F.count(F.lit(1)).alias("_n"))
    lengths = pieces.groupBy("doc_id").agg(F.max(F.col("begin") + F.length("text")).alias("_length"))
    tail = lengths.join(last, "doc_id", "inner" if annotated_only else "left").select(
        "doc_id", F.coalesce("_n", F.lit(0)).alias("seg"), F.lit(2).alias("part"),
        _segment(F.coalesce("_from", F.lit(0)), F.col("_length"), none).alias("_s"))
    # A span may reach beyond the text, but no further than to its end is looked for pieces.
    return (inner.unionByName(tail).join(lengths, "doc_id")
            .select("doc_id", "seg", "part", F.greatest(F.col("_s.b"), F.lit(0)).cast("bigint").alias("b"),
                    F.least(F.col("_s.e"), F.col("_length")).cast("bigint").alias("e"), F.col("_s.l").alias("label"))
            .where("e > b"))


def _cells(begin: Column, end: Column, chars: int) -> Column:
    return F.sequence(F.floor(begin / chars), F.floor((end - 1) / chars))


def bio_lines_pieces(pieces: DataFrame, labelled: DataFrame, chars: int = PIECE_CHARS,
                     annotated_only: bool = False) -> DataFrame:
    """The lines of ``bio_docs`` as flat rows, from texts given as ``note_pieces`` rows.

    Neither a text nor the spans of a note ever are one row.  The axis of a note is divided into cells of
    ``chars`` characters; pieces and segments meet in the cells they touch, and a pair that meets in several
    counts in the first it shares.  Pieces end between words, so each pair's words are whole; how many lines
    come before them follows from narrow rows of counts, words per segment and piece, summed in chunks of segments.
    """
    segs = _ordered_segments(pieces, labelled, annotated_only)
    long = F.length("text")
    parts = pieces.withColumn("_end", F.col("begin") + long).select(
        "*", F.explode(_cells(F.col("begin"), F.col("_end"), chars)).alias("_cell"))
    touched = segs.select("*", F.explode(_cells(F.col("b"), F.col("e"), chars)).alias("_cell"))
    first = F.greatest(F.floor(F.col("b") / chars), F.floor(F.col("begin") / chars))
    inside = substring_span(F.col("text"), F.greatest(F.col("b") - F.col("begin"), F.lit(0)),
                            F.least(F.col("e"), F.col("_end")) - F.col("begin"))
    key = ["doc_id", "seg", "part"]
    pairs = (touched.join(parts, ["doc_id", "_cell"])
             .where((F.col("_cell") == first) & (F.col("b") < F.col("_end")) & (F.col("e") > F.col("begin"))))
    met = pairs.select(*key, "piece", "label", words_of(inside).alias("tokens")).where(F.size("tokens") > 0)
    counts = pairs.select(*key, "piece", word_count(inside).alias("_n")).where("_n > 0")
    placed = counts.withColumn("_chunk", chunk_of(F.col("seg"), CHUNK_LINES))
    at = Window.partitionBy("doc_id", "_chunk")

    def words_before(window: Window) -> Column:
        return F.coalesce(F.sum("_n").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    inner = placed.withColumn("_local", words_before(at.orderBy("seg", "part", "piece"))).withColumn(
        "_inner", words_before(Window.partitionBy("doc_id", "_chunk", "seg", "part").orderBy("piece")))
    # Only notes with so many spans have a second chunk; for the others nothing is summed a second time.
    many = (labelled.where(F.col("begin").isNotNull() & F.col("end").isNotNull()).groupBy("doc_id")
            .agg(F.count(F.lit(1)).alias("_spans")).where(F.col("_spans") >= CHUNK_LINES).select("doc_id"))
    totals = placed.join(many, "doc_id", "left_semi").groupBy("doc_id", "_chunk").agg(F.sum("_n").alias("_n"))
    base = totals.select("doc_id", "_chunk", words_before(Window.partitionBy("doc_id").orderBy("_chunk")).alias("_base"))
    outer = (inner.join(base, ["doc_id", "_chunk"], "left")
             .select(*key, "piece", "_inner", (F.col("_local") + F.coalesce("_base", F.lit(0))).alias("_outer")))
    numbered = met.join(outer, [*key, "piece"])
    tag = F.when(F.col("label").isNull(), F.lit(vocab.OUTSIDE)).otherwise(
        F.concat(F.when(F.col("_inner") + F.col("_pos") == 0, F.lit("B-")).otherwise(F.lit("I-")), F.col("label")))
    return (explode_at(numbered, ["doc_id", "_inner", "_outer", "label"], "tokens", "_pos", "token")
            .select("doc_id", (F.col("_outer") + F.col("_pos") + 1).cast("int").alias("line_no"),
                    "token", tag.alias("tag")))


def bio_lines_unbounded(notes: DataFrame, labelled: DataFrame, annotated_only: bool = True,
                        chars: int = ROW_CHARS, spans: int = ROW_SPANS) -> DataFrame:
    """The lines of ``bio_docs`` as flat rows, for notes of any size with any number of spans.

    Notes of at most ``chars`` characters and ``spans`` spans are tagged in their row; only larger ones, and such
    as share an id, are cut into pieces.  By default only notes that have spans are returned.
    """
    sizes = notes.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max(F.length("text")).alias("_chars"))
    counts = labelled.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_spans"))
    large = (sizes.where((F.col("_n") > 1) | (F.col("_chars") > chars)).select("doc_id")
             .unionByName(counts.where(F.col("_spans") > spans).select("doc_id")))
    (long, short), (many, few) = (split_rows(rows.where(F.col("doc_id").isNotNull()), large, "doc_id") for rows in (notes, labelled))
    if annotated_only:
        annotated = few.where(F.col("begin").isNotNull() & F.col("end").isNotNull()).select("doc_id").distinct()
        short = short.join(annotated, "doc_id", "left_semi")
    pieced = bio_lines_pieces(note_pieces(long), many, annotated_only=annotated_only)
    return bio_lines(short, few).unionByName(pieced)


def bio_lines(notes: DataFrame, labelled: DataFrame) -> DataFrame:
    """Flat lines of all notes whose spans fit a row; see ``bio_lines_unbounded`` for others."""
    return explode_lines(bio_docs(notes, labelled))
