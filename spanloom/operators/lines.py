"""De-duplication, windows and ordering of labelled lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at, let
from spanloom.functions.batches import without_repeats
from spanloom.functions.text import entity_and_tag, is_blank
from spanloom.operators.ordered import CHUNK_LINES, chunk_of, running_before, with_halo

# Look-back of the two passes, window size and step.
LOOK_BACK_PASSES = (5, 4)
WINDOW_SIZE = 50
WINDOW_STEP = 50


def _watched(slot: Column | int) -> Column | bool:
    """Slots of the look-back buffer (0 = oldest) that are compared."""
    return (slot % 4 == 0) | (slot % 4 == 3)


def dedupe_docs(docs: DataFrame, passes: tuple[int, ...] = LOOK_BACK_PASSES) -> DataFrame:
    """Apply the passes to ``doc_id, tokens, tags`` rows, each on the output of the one before.

    A pass drops labelled lines that repeat the token of a labelled line at a watched slot.  The buffer holds
    the last ``look_back`` input lines of the document (fewer at its start), dropped ones included.
    """
    kept = docs.withColumn("_kept", dedupe_struct(F.struct("tokens", "tags"), passes))
    return kept.withColumns({c: F.col(f"_kept.{c}") for c in ("tokens", "tags")}).drop("_kept")


def dedupe_struct(lines: Column, passes: tuple[int, ...] = LOOK_BACK_PASSES) -> Column:
    """The same on a ``struct<tokens, tags>``; on one made in Arrow batches, lines don't leave the batch in between."""
    return without_repeats(lines, passes, vocab.OUTSIDE)


def renumber(lines: DataFrame, chunk: int = CHUNK_LINES) -> DataFrame:
    """Close the gaps of ``line_no`` (1, 2, 3, … per document)."""
    return (running_before(lines, "doc_id", chunk_of(F.col("line_no"), chunk), ["line_no"],
                           F.lit(1), "_rank")
            .withColumn("line_no", (F.col("_rank") + 1).cast("int")).drop("_rank"))


def dedupe_lines(lines: DataFrame, look_back: int, chunk: int = CHUNK_LINES) -> DataFrame:
    """``kept_lines`` on flat ``doc_id, line_no, token, tag`` rows of any document length.

    ``line_no`` must count 1, 2, 3, … per document.
    """
    around = with_halo(lines, "doc_id", "line_no", look_back, chunk)
    w = Window.partitionBy("doc_id", "_chunk").orderBy("line_no")
    i = F.col("line_no") - 1
    base = F.greatest(i - look_back, F.lit(0))
    labelled = F.col("tag") != vocab.OUTSIDE

    def repeats(distance: int) -> Column:
        slot = i - distance - base
        return ((slot >= 0) & _watched(slot)
                & (F.lag("token", distance).over(w) == F.col("token"))
                & (F.lag("tag", distance).over(w) != vocab.OUTSIDE))

    repeated = reduce(lambda a, b: a | b, [repeats(d) for d in range(1, look_back + 1)])
    return (around.withColumn("_drop", labelled & F.coalesce(repeated, F.lit(False)))
            .where(~F.col("_drop") & ~F.col("_halo"))
            .drop("_drop", "_halo", "_chunk"))


def dedupe_lines_chain(lines: DataFrame, passes: tuple[int, ...] = LOOK_BACK_PASSES,
                       chunk: int = CHUNK_LINES) -> DataFrame:
    """All passes on flat rows, renumbered after each."""
    return reduce(lambda df, n: renumber(dedupe_lines(df, n, chunk), chunk), passes, lines)


def fixed_windows(lines: DataFrame, size: int = WINDOW_SIZE) -> DataFrame:
    """Add ``window_id``: non-overlapping blocks of ``size`` lines, the short last one kept."""
    return lines.withColumn("window_id", F.floor((F.col("line_no") - 1) / size).cast("int"))


def sliding_windows(lines: DataFrame, size: int, step: int) -> DataFrame:
    """One row per line and window that covers it; windows start every ``step`` lines."""
    p = F.col("line_no") - 1
    high = F.floor(p / step).cast("int")
    low = F.greatest(F.lit(0), F.ceil((p - size + 1) / step).cast("int"))
    return (lines.withColumn("_low", low).withColumn("_high", high)
            .where("_low <= _high")
            .select("*", F.explode(F.sequence("_low", "_high")).alias("window_id"))
            .drop("_low", "_high"))


def window_docs(docs: DataFrame, size: int = WINDOW_SIZE, step: int = WINDOW_STEP) -> DataFrame:
    """``doc_id, sent_id, tokens, tags``: windows cut inside the document row, no shuffle."""
    n = F.size("tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>"))
    window = {c: F.slice(c, F.col("_start") + 1, F.lit(size)) for c in ("tokens", "tags")}
    return (explode_at(docs, ["doc_id", "tokens", "tags"], starts, "sent_id", "_start")
            .select("doc_id", "sent_id", *[v.alias(c) for c, v in window.items()]))


def collapse_blank_array(raw: Column) -> Column:
    """Keep at most one blank line in a row, the first."""
    return let(raw, lambda all_lines: F.filter(
        all_lines, lambda x, i: ~((i > 0) & is_blank(x) & is_blank(F.get(all_lines, i - 1)))))


def parse_raw_array(raw: Column) -> Column:
    """Raw text lines -> ``array<struct<token, tag>>``, blank lines left out."""
    return F.transform(F.filter(raw, lambda x: ~is_blank(x)), entity_and_tag)


def first_seen(df: DataFrame, value: str, *order: str) -> DataFrame:
    """``value`` and the ``order`` columns of its first occurrence, for each distinct value."""
    return df.groupBy(value).agg(F.min(F.struct(*order)).alias("_first")).select(value, "_first.*")
