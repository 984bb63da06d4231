"""Substring dedup: winnowed seeds, extended both ways to the maximal repeats of 50 words.

Each window of ``LENGTH`` words selects the first least of its ``SEED_WORDS``-word hashes, so equal
windows select equal seeds at equal places.  One row per seed carries the run of windows that
select it and the hash of everything those windows cover, its reach to the left and right.

Seeds are joined over documents by (seed, reach): where the whole reach was met in a document
with a smaller id, the seed is extended to all of it, without comparing occurrences pairwise.
Only the first document of a reach needs a closer look, and only if its seed has other reaches:
there the extension stops at the first window that no smaller document has, found by joining the
hashes of the single windows.  Overlapping windows merge to maximal repeats.

A reach stands for its 64-bit polynomial hash under its seed's hash, a single window for two such hashes
over different bases, all over 64-bit word hashes; no words are compared.  So two different windows count as
equal with a chance of 2^-128 a pair, two different reaches with 2^-64 a pair of reaches of one seed: with a
million reaches of each of a million seeds that is one wrong match in some forty such corpora.  A seed may
occur in a third of all documents: rows meet under (seed, reach), pre-aggregated to their first and last document.
"""

from __future__ import annotations

import hashlib
import re
from itertools import compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut_lineage, fresh, map_batches, split_by_keys, words

LENGTH = 50
SEED_WORDS = 16
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd
KNOWN_WORDS = 100_000  # word hashes a worker keeps; it starts anew beyond them
_RUN_BITS = 6  # a seed is selected by at most LENGTH - SEED_WORDS + 1 = 35 windows in a row
_WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


class _Powers:
    """Powers of a base modulo 2^64, grown as longer texts come."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def up_to(self, n: int) -> np.ndarray:
        if len(self.known) <= n:
            steps = np.full(max(n + 1, 4096), self.base, np.uint64)
            steps[0] = 1
            self.known = np.multiply.accumulate(steps)
        return self.known[:n + 1]


class _WordHashes(dict):
    """Hash of each word met, at most ``KNOWN_WORDS`` of them at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_POWERS = [(_Powers(base), _Powers(pow(base, -1, 1 << 64))) for base in _BASES]
_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Hashes:
    """Hashes of all word ranges of one document, from prefix sums modulo 2^64."""

    def __init__(self, found: list[bytes], base: int = 0):
        forth, back = _POWERS[base]
        each = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
        self.sums = np.zeros(len(found) + 1, np.uint64)
        np.cumsum(each * forth.up_to(len(found))[:-1], out=self.sums[1:])
        self.back = back.up_to(len(found))

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[last] - self.sums[first]) * self.back[first])


def _first_least(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its first least one (by the upper 48 bits)."""
    chosen = np.empty(len(values) - width + 1, np.int64)
    block = (1 << 16) - width
    for at in range(0, len(chosen), block):
        part = values[at:at + block + width - 1]
        least = part & ~np.uint64(0xFFFF) | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < width:
            step = min(have, width - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        chosen[at:at + len(least)] = (least & np.uint64(0xFFFF)).astype(np.int64) + at
    return chosen


def _seeds(found: list[bytes]) -> tuple[np.ndarray, ...] | None:
    """Per run of windows with one seed: first window, windows, seed hash, hash of the reach."""
    if len(found) < LENGTH:
        return None
    hashes = _Hashes(found)
    at = np.arange(len(found) - SEED_WORDS + 1)
    seed = hashes.of(at, at + SEED_WORDS)
    chosen = _first_least(seed, LENGTH - SEED_WORDS + 1)
    starts = np.flatnonzero(np.diff(chosen, prepend=-1))
    runs = np.diff(starts, append=len(chosen))
    return starts, runs, seed[chosen[starts]], hashes.of(starts, starts + runs + LENGTH - 1)


def _id_type(rows: DataFrame) -> str:
    return rows.schema["id"].dataType.simpleString()


def _seed_rows(rows: DataFrame) -> DataFrame:
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, parts = [], []
        for i, text in enumerate(batch["text"]):
            if (found := _seeds(words(text.as_py()))) is not None:
                owner.append(np.full(len(found[0]), i))
                parts.append(found)
        if not parts:
            owner, parts = [np.zeros(0, np.int64)], [(np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2]
        start, run, seed, reach = (np.concatenate(p) for p in zip(*parts))
        take = pa.array(np.concatenate(owner))
        return pa.record_batch([batch["id"].take(take), batch["text_key"].take(take),
                                pa.array(start << _RUN_BITS | run), pa.array(seed.view(np.int64)),
                                pa.array(reach.view(np.int64))], names=["id", "text_key", "place", "seed", "reach"])

    return map_batches(rows, cook, f"id {_id_type(rows)}, text_key bigint, place bigint, seed bigint, reach bigint")


def _window_rows(rows: DataFrame) -> DataFrame:
    """Single windows of the seeds in ``places``."""
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        owner, starts, hashed = [], [], []
        for i, (text, places) in enumerate(zip(batch["text"], batch["places"])):
            found = words(text.as_py())
            first = np.concatenate([np.arange(p >> _RUN_BITS, (p >> _RUN_BITS) + (p & (1 << _RUN_BITS) - 1))
                                    for p in places.as_py()])
            owner.append(np.full(len(first), i))
            starts.append(first)
            hashed.append([_Hashes(found, base).of(first, first + LENGTH) for base in (0, 1)])
        take = pa.array(np.concatenate(owner))
        window, check = (pa.array(np.concatenate(h).view(np.int64)) for h in zip(*hashed))
        return pa.record_batch([batch["id"].take(take), batch["text_key"].take(take), pa.array(np.concatenate(starts)),
                                window, check], names=["id", "text_key", "start", "window", "check"])

    return map_batches(rows, cook, f"id {_id_type(rows)}, text_key bigint, start bigint, window bigint, check bigint")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_key"),
                       F.col(text_col).alias("text"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, text_key, places``: runs of repeated windows per text that has any.

    A place is ``first window << 6 | windows``; see :func:`removed_words` for the word ranges.
    """
    rows = _rows(docs, id_col, text_col).where("id is not null")
    seeds = _seed_rows(rows)
    shared = cut_lineage(seeds.groupBy("seed").agg(F.min("id").alias("least"), F.max("id").alias("most"))
                         .where("least < most").select("seed"))
    known = cut_lineage(seeds.join(shared, "seed"))
    reaches = known.groupBy("seed", "reach").agg(F.min("id").alias("first"))
    spread = cut_lineage(reaches.groupBy("seed").agg(F.count("*").alias("n_reaches")))
    met = cut_lineage(known.join(cut_lineage(reaches.join(spread, "seed")), ["seed", "reach"])
                      .select("id", "text_key", "place", "first", "n_reaches"))
    whole = met.where(F.col("id") > F.col("first")).select("id", "text_key", "place")

    closer = (met.where((F.col("id") == F.col("first")) & (F.col("n_reaches") > 1))
              .groupBy("id", "text_key").agg(F.collect_set("place").alias("places")))
    closer = cut_lineage(closer)
    near, _ = split_by_keys(rows, closer, "id", "text_key")
    windows = cut_lineage(_window_rows(near.join(closer, ["id", "text_key"]).select("id", "text_key", "text", "places")))
    first = cut_lineage(windows.groupBy("window", "check").agg(F.min("id").alias("least"), F.max("id").alias("most"))
                        .where("least < most"))
    single = (windows.join(first, ["window", "check"]).where(F.col("id") > F.col("least"))
              .select("id", "text_key", (F.shiftleft("start", _RUN_BITS) + 1).alias("place")))
    return whole.unionByName(single).groupBy("id", "text_key").agg(F.collect_set("place").alias("places"))


def removed_words(places: list[int] | None, n_words: int) -> np.ndarray:
    """Whether each of ``n_words`` words is covered by a repeated window."""
    edge = np.zeros(n_words + 1, np.int64)
    if places:
        at = np.array(places, np.int64)
        start = at >> _RUN_BITS
        np.add.at(edge, start, 1)
        np.add.at(edge, start + (at & (1 << _RUN_BITS) - 1) + LENGTH - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(text: str | None, places: list[int] | None) -> str | None:
    """The text without its repeated words; what stands between kept words stays."""
    if not places:
        return text
    raw = text.encode()
    spans = [m.span() for m in _WORD.finditer(raw)]
    gone = np.flatnonzero(np.diff(np.r_[False, removed_words(places, len(spans)), False].astype(np.int8)))
    kept, at = [], 0
    for first, last in zip(gone[::2], gone[1::2]):
        kept.append(raw[at:spans[first][0]])
        at = spans[last][0] if last < len(spans) else len(raw)
    return b"".join([*kept, raw[at:]]).decode()


def _with_places(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with the places of repeated windows as one more, last column.

    Only texts that may have such places are shuffled to meet them.
    """
    owner, key, places = (fresh(docs, c) for c in ("_owner", "_text_key", "_places"))
    found = cut_lineage(repeats(docs, id_col, text_col).toDF(owner, key, places))
    keyed = docs.withColumns({owner: F.col(id_col), key: F.xxhash64(text_col)})
    touched, clean = split_by_keys(keyed, found, owner, key)
    met = touched.join(found, [owner, key], "left").select(*docs.columns, places)
    none = F.lit(None).cast(found.schema[places].dataType)
    return met.unionByName(clean.select(*docs.columns, none.alias(places)))


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, the text without words that a smaller document id repeats in 50 words.

    Defined as in :func:`digest_repeats`; the text column alone changes.
    """
    rows = _with_places(docs, id_col, text_col)
    names, at, last = docs.columns, docs.columns.index(text_col), len(docs.columns)

    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [_cut(t.as_py(), p.as_py()) for t, p in zip(batch.column(at), batch.column(last))]
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns[:last])]
        return pa.record_batch(columns, names=names)

    return map_batches(rows, cook, docs.schema)


def digest_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_removed, kept_sha256`` for every row.

    A word goes if a window of 50 words that covers it has its word sequence in a document with a
    smaller id (of any type that can be ordered); windows are judged on the input, very long texts as a whole.  Null and empty texts have no words and the
    digest of nothing.  Rows with a null id neither lose words nor make others lose them; rows
    that repeat an id do not count against each other.  Repeated rows come out as often as they
    came in, an empty table gives an empty result, further columns are not carried.
    """
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple[int, int, str]] = []
        for text, places in zip(batch["text"], batch["_places"]):
            found = words(text.as_py())
            gone = removed_words(places.as_py(), len(found))
            kept = b" ".join(compress(found, ~gone) if gone.any() else found)
            out.append((len(found), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
        n_words, n_removed, kept_sha = zip(*out)
        return pa.record_batch([batch["id"], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                                pa.array(kept_sha)], names=[id_col, "n_words", "n_removed", "kept_sha256"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = _with_places(source, "id", "text").select("id", "text", "_places")
    kind = source.schema["id"].dataType.simpleString()
    return map_batches(rows, cook, f"`{id_col}` {kind}, n_words bigint, n_removed bigint, kept_sha256 string")
