"""Scalar text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions.arrays import let, running_total

# First and last code points of the characters that a Unicode-aware
# whitespace split separates on.
WHITESPACE_RANGES = (
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
    (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
)
WHITESPACE = "".join(chr(c) for first, last in WHITESPACE_RANGES for c in range(first, last + 1))


def _class(ranges: tuple[tuple[int, int], ...]) -> str:
    """The inside of a character class; single characters stay single, they match faster."""
    return "".join(f"\\x{{{first:x}}}" + (f"-\\x{{{last:x}}}" if last > first else "")
                   for first, last in ranges)


_WS = _class(WHITESPACE_RANGES)
# Whitespace that ``\s`` does not match by default.
_RARE = f"[{_class(((0x1C, 0x1F), *WHITESPACE_RANGES[2:]))}]"

_DIGITS = r"\p{Nd}(?:_?\p{Nd})*"
# The grammar of a decimal floating point literal with optional surrounding
# whitespace, as a general-purpose scripting language reads it.
NUMBER_PATTERN = (
    rf"^[{_WS}]*[+-]?(?:(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?"
    rf"|[iI][nN][fF](?:[iI][nN][iI][tT][yY])?|[nN][aA][nN])[{_WS}]*\z"
)
# Which part of a concept name is its term, and which characters a file name keeps.
LAST_BRACKET_PATTERN = r"\(([^()]+)\)[^()]*\z"
NAME_DROP_PATTERN = r"[^\p{L}\p{N}.-]"

# Text is indexed in pieces of 2^9 characters, see ``cut``.
_PIECE_BITS = 9
_PIECE = 1 << _PIECE_BITS


def trim_all(text: Column) -> Column:
    """Trim every kind of Unicode whitespace at both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    return trim_all(text) == ""


def plain_spaces(text: Column) -> Column:
    """Turn rare whitespace characters into spaces, one for one, so offsets stay valid.

    Matching words against the full whitespace class is several times slower
    than against the default one; most texts only pay for the test here.
    """
    return let(text, lambda t: F.when(F.rlike(t, F.lit(_RARE)), F.regexp_replace(t, _RARE, " "))
               .otherwise(t))


def plain_words(text: Column) -> Column:
    """``words`` of a text that went through ``plain_spaces``."""
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def words(text: Column) -> Column:
    """Whitespace-separated words as an array."""
    return plain_words(plain_spaces(text))


def words_with_offsets(text: Column) -> Column:
    """``array<struct<token, begin>>``; ``begin`` counts characters from 0."""
    def locate(parts: Column, lead: Column) -> Column:
        ends = running_total(F.transform(parts, lambda c: F.length(c).cast("bigint")))
        return let(lead, lambda first: let(ends, lambda end: F.transform(
            parts,
            lambda c, i: F.struct(
                F.rtrim(c, F.lit(" \t\n\x0b\f\r")).alias("token"),
                (first + F.coalesce(F.get(end, i - 1), F.lit(0))).cast("int").alias("begin")))))

    return let(plain_spaces(text), lambda t: let(
        F.regexp_extract_all(t, F.lit(r"\S+\s*"), F.lit(0)),
        lambda parts: locate(parts, F.length(F.regexp_extract(t, r"^\s*", 0)))))


def pieces(text: Column) -> Column:
    """The text as an array of equally long pieces, the index behind ``cut``."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_PIECE}}}"), F.lit(0))


def word_pieces(text: Column, chars: int) -> Column:
    """The text in pieces of ``chars`` characters or a little more, as no piece ends inside a word."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{{chars}}}[^{_WS}]*|.+"), F.lit(0))


def cut(parts: Column, begin: Column, end: Column) -> Column:
    """Characters ``[begin, end)`` of a text given as ``pieces``; empty when ``begin >= end``.

    A direct substring walks the text from its start each time, which is
    quadratic for long notes with many spans; this touches only the pieces hit.
    """
    first = F.shiftright(begin, _PIECE_BITS)
    last = F.shiftright(end - 1, _PIECE_BITS)
    hit = F.array_join(F.slice(parts, first + 1, last - first + 1), "")
    return F.when(end > begin,
                  F.substring(hit, begin - first * _PIECE + 1, end - begin)).otherwise(F.lit(""))


def substring_span(text: Column, begin: Column, end: Column) -> Column:
    """Characters ``[begin, end)`` of a text; empty when ``begin >= end``."""
    return F.substring(text, begin + 1, F.greatest(end - begin, F.lit(0)))


def is_number(text: Column) -> Column:
    return F.rlike(text, F.lit(NUMBER_PATTERN))


def clean_name(name: Column) -> Column:
    """Keep letters, digits, ``-`` and ``.``."""
    return F.regexp_replace(name, NAME_DROP_PATTERN, "")


def last_bracketed(text: Column) -> Column:
    """The last bracketed phrase without inner brackets, trimmed; the input if there is none."""
    return (F.when(F.rlike(text, F.lit(LAST_BRACKET_PATTERN)),
                   trim_all(F.regexp_extract(text, LAST_BRACKET_PATTERN, 1)))
            .otherwise(text))


def entity_and_tag(line: Column) -> Column:
    """``struct<token, tag>``: the tag is the last field, the token the rest joined by one space."""
    return let(words(line), lambda p: F.struct(
        F.array_join(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), " ").alias("token"),
        F.get(p, F.size(p) - 1).alias("tag")))
