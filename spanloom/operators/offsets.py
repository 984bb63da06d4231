"""Offsets in UTF-16 units, as annotation tools of that string model write them, to offsets in characters.

Characters beyond the basic plane take two units.  A note's index holds the places of these characters, in
units and in order; the rank of an offset among them, found by bisection, is what it has to be lowered by.  Notes
without such characters have no index.  The spans of a note meet its index as one row, never the text, so an index
is not repeated for every span.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.arrays import explode_at
from spanloom.functions.batches import lowered, wide_places

_WIDE = r"[\x{10000}-\x{10FFFF}]"


def wide_index(notes: DataFrame) -> DataFrame:
    """``doc_id, places`` of the notes that need an index."""
    return notes.where(F.rlike("text", F.lit(_WIDE))).select("doc_id", wide_places(F.col("text")).alias("places"))


def by_doc(spans: DataFrame) -> DataFrame:
    """``doc_id, spans``: the rows of a note as one array of structs; rows without a note stay single."""
    alone = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("_alone")
    rest = F.struct(*[c for c in spans.columns if c != "doc_id"])
    return spans.groupBy("doc_id", alone).agg(F.collect_list(rest).alias("spans")).drop("_alone")


def from_utf16(spans: DataFrame, notes: DataFrame, *columns: str) -> DataFrame:
    """``spans`` with ``columns`` (``begin`` and ``end`` unless named) counted in characters of their note.

    An offset inside a character that takes two units becomes that character's own; null stays null.
    """
    columns = columns or ("begin", "end")
    indexed = by_doc(spans).join(wide_index(notes), "doc_id", "left")
    mapped = indexed.select("doc_id", "spans", *[lowered(F.col(f"spans.{c}").cast("array<bigint>"), F.col("places")).alias(f"_{c}")
                                                 for c in columns])
    rows = explode_at(mapped, ["doc_id", *[f"_{c}" for c in columns]], "spans", "_at", "_span")
    return rows.select(*[
        F.col("doc_id") if c == "doc_id" else
        F.get(f"_{c}", F.col("_at")).cast(spans.schema[c].dataType).alias(c) if c in columns else F.col(f"_span.{c}")
        for c in spans.columns])
