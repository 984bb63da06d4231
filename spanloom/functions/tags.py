"""Tag functions: prefixes, renames, endings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import vocab


def replace_values(value: Column, mapping: dict[str, str]) -> Column:
    """Map listed values, leave the others as they are."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    return F.coalesce(F.element_at(table, value), value)


def display_pred(tag: Column) -> Column:
    return replace_values(tag, vocab.DISPLAY_PRED)


def display_gold(tag: Column) -> Column:
    return replace_values(tag, vocab.DISPLAY_GOLD)


def strip_prefix(tag: Column, mode: str = "all") -> Column:
    """``B-X``/``I-X`` -> ``X``; mode ``listed`` strips only the fixed list."""
    if mode == "listed":
        return replace_values(tag, {t: t[2:] for t in vocab.LISTED_STRIP})
    if mode == "all":
        return F.regexp_replace(tag, "^[BI]-", "")
    raise ValueError(f"unknown mode {mode!r}")


def has_run_suffix(entity_type: Column) -> Column:
    return F.rlike(entity_type, F.lit(f"(?:{'|'.join(vocab.RUN_SUFFIXES)})\\z"))


def run_key(entity_type: Column) -> Column:
    return F.right(entity_type, F.lit(3))


def repair_label(entity_type: Column) -> Column:
    return F.replace(entity_type, F.lit(vocab.REPAIR_FROM), F.lit(vocab.REPAIR_TO))


def either_contains(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def same_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)
