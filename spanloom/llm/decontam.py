"""Benchmark decontamination by pigeonhole edit matching.

A test item of n characters may be met with ``n // CHARS_PER_ERROR`` edits.  Cut into one piece
more than that, at least one piece must occur unchanged, so exact hits of the pieces (one
Aho-Corasick pass over each whole text) find every candidate; Myers' bit-parallel distance
verifies the item around each hit.  Items come in blocks of bounded size, each shipped to the
tasks that scan the documents, so neither side is ever joined or gathered.
"""

from __future__ import annotations

import string
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHARS_PER_ERROR = 20
BLOCK_CHARS = 1_000_000  # characters of test items that go to the tasks at once
_FOLD = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))


def folded(text: str | None) -> str:
    """Lower case, punctuation of ASCII as space, single spaces."""
    return b" ".join(text.lower().encode().translate(_FOLD).split()).decode() if text else ""


def nearest(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``item`` to a part of ``text`` and where the first such part ends."""
    size = len(item)
    full, top = (1 << size) - 1, 1 << (size - 1)
    places: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        places[c] |= 1 << i
    up, down, score = full, 0, size
    best, end = size, 0
    for j, c in enumerate(text, 1):
        equal = places.get(c, 0)
        across = (((equal & up) + up) ^ up) | equal
        plus, minus = down | (full & ~(across | up)), up & across
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        if score < best:
            best, end = score, j
        plus, minus = plus << 1 & full, minus << 1 & full
        level = equal | down
        up, down = minus | (full & ~(level | plus)), plus & level
    return best, end


class Items:
    """Test items with the automaton of their pieces."""

    def __init__(self, rows: list[tuple[object, str]]):
        self.rows = rows
        self.automaton = ahocorasick.Automaton()
        at: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, (_, item) in enumerate(rows):
            n_pieces = len(item) // CHARS_PER_ERROR + 1
            edges = [len(item) * k // n_pieces for k in range(n_pieces + 1)]
            for first, last in zip(edges, edges[1:]):
                at[item[first:last]].append((i, first))
        for piece, where in at.items():
            self.automaton.add_word(piece, (len(piece), where))
        if at:
            self.automaton.make_automaton()

    def found_in(self, text: str) -> Iterator[tuple[object, int, int]]:
        """``item id, distance, end`` of every item within its error budget."""
        return ((self.rows[i][0], distance, end) for i, distance, end in self.places_in(text))

    def places_in(self, text: str) -> Iterator[tuple[int, int, int]]:
        """The same with the item's place in ``rows``."""
        if not self.rows or not text:
            return
        regions: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for last, (length, where) in self.automaton.iter(text):
            for i, first in where:
                begin = last + 1 - length - first
                size = len(self.rows[i][1])
                budget = size // CHARS_PER_ERROR
                if not budget and not (text[begin - 1:begin] in ("", " ") and text[last + 1:last + 2] in ("", " ")):
                    continue  # a short item inside a word
                area = (max(0, begin - budget), min(len(text), begin + size + budget))
                known = regions[i]
                if known and area[0] <= known[-1][1]:
                    known[-1] = (min(known[-1][0], area[0]), max(known[-1][1], area[1]))
                else:
                    known.append(area)
        for i, areas in regions.items():
            item = self.rows[i][1]
            tried = ((distance, a + end) for a, b in areas for distance, end in [nearest(item, text[a:b])])
            distance, end = min(tried)
            if distance <= len(item) // CHARS_PER_ERROR:
                yield i, distance, end


def _scan(docs: DataFrame, rows: list[tuple[object, str]], item_type: pa.DataType, kinds: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows)
        for batch in batches:
            hits = [(i, *hit) for i, text in enumerate(batch["text"]) for hit in items.places_in(folded(text.as_py()))]
            owner, at, distance, end = zip(*hits) if hits else ((),) * 4
            key, short = ([items.rows[i][0] for i in at], [len(items.rows[i][1]) < CHARS_PER_ERROR for i in at])
            yield pa.record_batch([batch["id"].take(pa.array(owner, pa.int64())), pa.array(key, item_type),
                                   pa.array(distance, pa.int32()), pa.array(end, pa.int64()), pa.array(short, pa.bool_())],
                                  names=["id", "item", "distance", "end", "short"])

    return docs.mapInArrow(run, kinds)


def _blocks(items: DataFrame, item_col: str, text_col: str) -> Iterator[tuple[list[tuple[object, str]], pa.DataType]]:
    """Folded items in blocks of about ``BLOCK_CHARS`` characters, one at a time on the driver."""
    wanted = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    blocks = (wanted.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS + 1
    for block in range(blocks):
        part = wanted.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        yield ([(k, f) for k, t in zip(part["item"].to_pylist(), part["text"].to_pylist()) if (f := folded(t))],
               part.schema.field("item").type)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
          text_col: str = "text") -> DataFrame:
    """``id_col, item_col, distance, match_end, short`` for each document and test item found in it.

    Distance and end count characters of the folded text (lower case, no punctuation, single
    spaces); the closest match is given, of equal ones the first.  Items under
    ``CHARS_PER_ERROR`` characters must occur unchanged, as whole words; ``short`` marks them, since a word or two
    can be found without a leak.  Items without a letter or digit, or null,
    never match.  Null and empty texts hold no item, very long texts are searched whole.  Repeated documents and repeated items
    each come out again; null ids stay.  Empty tables give empty results; further columns are
    not carried.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = (f"id {source.schema['id'].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, "
             "distance int, end bigint, short boolean")
    scans = [_scan(source, rows, kind, kinds) for rows, kind in _blocks(items, item_col, text_col)]
    return (reduce(DataFrame.unionByName, scans)
            .select(F.col("id").alias(id_col), F.col("item").alias(item_col), "distance",
                    F.col("end").alias("match_end"), "short"))


def drop_leaks(docs: DataFrame, items: DataFrame, item_col: str = "item_id", text_col: str = "text",
               least_chars: int = 0) -> DataFrame:
    """Rows of ``docs`` in which no test item is found, all columns, without a shuffle.

    Items whose folded text is shorter than ``least_chars`` drop nothing.  Matches are those of ``leaks``.  Rows
    with a null or empty text stay, as do repeated rows and rows without an id; without items, or with an empty
    table, ``docs`` comes back as it is.
    """
    at = docs.columns.index(text_col)

    def without(rows: list[tuple[object, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = Items(rows)
            for batch in batches:
                clean = [next(found.found_in(folded(t.as_py())), None) is None for t in batch.column(at)]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return run

    for rows, _ in _blocks(items, item_col, text_col):
        rows = [(key, item) for key, item in rows if len(item) >= least_chars]
        docs = docs.mapInArrow(without(rows), docs.schema)
    return docs
