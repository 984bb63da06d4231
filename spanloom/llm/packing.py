"""Packing by cutting-stock column generation.

Every document is cut into pieces of 2048 tokens and one remainder.  The lengths of all pieces form a histogram:
exact up to 256 tokens, beyond rounded up to a quantum, 480 bins at most.  For the long bins a linear program chooses
how often each pattern (bins that fit one sequence) is used; patterns are found where needed by a
knapsack dynamic program over the dual prices, and generation ends when the dual bound proves
the plan within ``GAP``.  Counts are rounded down, what is left is filled greedily.  Short pieces, the largest first,
fill the room that patterns leave and then sequences of their own, by their exact lengths.  The
ranks of the documents in a bin are dealt to the slots of the patterns.

Only the histogram goes to the driver and only the slot table comes back, both bounded by the
number of bins.  A rank is the rank in a hash bucket of the bin plus the sizes of the buckets
before it, so no bin is ever in one task.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spanloom.llm.common import cut_lineage, map_batches, spread

CAPACITY = 2048
QUANTUM = 8  # tokens to which long pieces are rounded up
EXACT = 256  # tokens up to which a piece is short
GAP = 1e-4  # proven distance to the best fractional plan at which generation stops
ROUNDS = 60  # simplex steps for each size, many more than a plan takes
CLOSING_ID = 1
CACHED_WORDS = 150_000  # per worker and generation, of which there are two; results do not depend on it
TAIL = b".,!?;:%$#*&|)-\"/"  # punctuation that neither contractions nor special tokens end in
WORD_END = "</w>"  # fixed value: how the tokenizer marks tokens that end a word
_SLICE_CHARS = 2_000_000


def _stem(word: bytes) -> bytes:
    """The word without the punctuation at its end, if what stands before that stays a letter or digit."""
    stem = word.rstrip(TAIL)
    if len(stem) == len(word) or stem[-1:].isalnum():
        return stem
    last = unicodedata.normalize("NFC", stem.decode()[-1:].lower())
    return stem if last.isalpha() else word


class WordTokens:
    """Token ids of texts, as little-endian uint32, by way of their white-space separated words.

    The tokenizer drops white space and never joins across it, and punctuation at the end of a
    word is a run of its own, so a text's ids are the ids of its words in a row.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _encode(self, parts: list[str]) -> list[bytes]:
        return [struct.pack(f"<{len(e.ids)}I", *e.ids)
                for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _encode_letters(self, parts: list[str]) -> list[bytes]:
        """Ids of parts that are one run of letters each: encoded at once, cut where a word ends."""
        joined = self.tokenizer.encode_batch_fast([" ".join(parts)], add_special_tokens=False)[0].ids
        ids = np.array(joined, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(parts):  # lower case of some letter is more than one letter
            return self._encode(parts)
        raw, ends = ids.tobytes(), ends.tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    def _learn(self, found: set[bytes]) -> None:
        if len(self.known) > CACHED_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        stems: dict[bytes, bytes] = {}
        for w in found:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    stems[w] = _stem(w)
        letters: dict[bytes, str] = {}
        others: dict[bytes, str] = {}
        for w, s in stems.items():
            for p in (s, w[len(s):]) if len(w) > len(s) else (s,):
                if p not in known:
                    text = p.decode()
                    (letters if text.isalpha() else others)[p] = text
        known.update(zip(letters, self._encode_letters(list(letters.values()))))
        known.update(zip(others, self._encode(list(others.values()))))
        known.update((w, known[s] + known[w[len(s):]]) for w, s in stems.items() if len(w) > len(s))

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text, the closing id included."""
        at = 0
        while at < len(texts):
            size, last = 0, at
            while last < len(texts) and (last == at or size + len(texts[last] or "") <= _SLICE_CHARS):
                size += len(texts[last] or "")
                last += 1
            found = [(t or "").encode().split() for t in texts[at:last]]
            self._learn(set().union(*found))
            for each in found:
                yield b"".join([*map(self.known.__getitem__, each), struct.pack("<I", CLOSING_ID)])
            at = last


@cache
def _tokens(path: str) -> WordTokens:
    """One tokenizer and word cache for all tasks of a worker."""
    return WordTokens(path)


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens``: pieces of at most ``CAPACITY`` tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer)
        for batch in batches:
            rows = []
            for i, ids in enumerate(tokens.of(batch["text"].to_pylist())):
                n = len(ids) // 4
                rows += [(i, s, min(CAPACITY, n - s), zlib.crc32(ids[4 * s:4 * (s + CAPACITY)]), n)
                         for s in range(0, n, CAPACITY)]
            owner, *columns = (pa.array(c, pa.int64()) for c in zip(*rows)) if rows else [pa.array([], pa.int64())] * 5
            yield pa.record_batch([batch["id"].take(owner), *columns],
                                  names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The dearest multiset of (ascending) sizes that fits, by dynamic programming over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for r, fit in enumerate(np.searchsorted(sizes, np.arange(1, room + 1), "right"), 1):
        best[r] = best[r - 1]
        if fit:
            worth = best[r - sizes[:fit]] + prices[:fit]
            top = worth.argmax()
            if worth[top] > best[r]:
                best[r], last[r] = worth[top], top
    pattern, r = np.zeros(len(sizes), np.int64), room
    while r > 0:
        if last[r] < 0:
            r -= 1
        else:
            pattern[last[r]] += 1
            r -= sizes[last[r]]
    return best[room], pattern


def fractional_plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used, fractions allowed: revised simplex with priced columns."""
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / (room // sizes))
    amount = inverse @ demand
    for _ in range(ROUNDS * len(sizes)):
        prices = np.maximum(inverse.sum(axis=0), 0)  # each pattern costs one sequence
        value, pattern = _best_pattern(sizes, prices, room)
        if value <= 1 + GAP:  # prices / value are feasible duals: the plan is at most this much above the best
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = ratio.argmin()
        basis[:, leave] = pattern
        row = inverse[leave] / step[leave]
        inverse -= np.outer(step, row)
        inverse[leave] = row
        amount = amount - step * ratio[leave]
        amount[leave] = ratio[leave]
    # Each basis on the way is a plan that holds everything, so one that ran out of rounds is only less tight.
    return basis.T.round().astype(np.int64), np.maximum(amount, 0)


def whole_plan(sizes: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts that hold all of ``demand``: rounded down, the rest greedily."""
    patterns, amount = fractional_plan(sizes, demand, room)
    left = demand.copy()
    plan = []
    for pattern, times in zip(patterns, np.floor(amount + 1e-9).astype(np.int64)):
        if times > 0 and pattern.any():
            plan.append((pattern, int(times)))
            left = np.maximum(left - pattern * times, 0)
    return plan + _greedy_plan(sizes, left, room)


def _greedy_plan(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns that take the largest sizes first, each used while all it takes is there."""
    plan = []
    while left.any():
        pattern, free = np.zeros_like(left), room
        for i in np.argsort(-sizes):
            pattern[i] = min(left[i], free // sizes[i])
            free -= pattern[i] * sizes[i]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        plan.append((pattern, times))
        left = left - pattern * times
    return plan


def filled_plan(sizes: np.ndarray, demand: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Patterns with whole counts over all bins (ascending, in tokens): long ones planned, short ones filled in."""
    first = int(np.searchsorted(sizes, EXACT, "right"))
    left, plan = demand.copy(), []
    left[first:] = 0
    for pattern, times in whole_plan(sizes[first:] // QUANTUM, demand[first:], CAPACITY // QUANTUM) if first < len(sizes) else ():
        full = np.concatenate([np.zeros(first, np.int64), pattern])
        todo = [(full, CAPACITY - int(full @ sizes), times, first - 1)]
        while todo:
            full, free, times, i = todo.pop()
            for i in range(i, -1, -1):
                full[i] = min(left[i] // times, free // sizes[i])
                left[i] -= full[i] * times
                free -= int(full[i] * sizes[i])
                if 0 < left[i] < times and sizes[i] <= free:  # the last of a size: some sequences take one more
                    todo.append((full.copy(), free, times - int(left[i]), i - 1))
                    times, left[i] = int(left[i]), 0
                    full[i] += 1
                    free -= int(sizes[i])
            plan.append((full, times))
    return plan + _greedy_plan(sizes, left, CAPACITY)


def _slots(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray, demand: np.ndarray) -> dict[int, np.ndarray]:
    """Per bin, rows (first rank, first sequence, slot): consecutive ranks go to consecutive sequences."""
    given, rows, base = np.zeros_like(demand), {int(s): [] for s in sizes}, 0
    for pattern, times in plan:
        slot = 0
        for i in np.flatnonzero(pattern)[::-1]:
            for _ in range(pattern[i]):
                take = min(times, demand[i] - given[i])
                if take > 0:
                    rows[int(sizes[i])].append((given[i], base, slot))
                given[i] += take
                slot += 1
        base += times
    return {size: np.array(r, np.int64) for size, r in rows.items()}


def pack(cut: DataFrame) -> DataFrame:
    """Add ``sequence_id, offset`` to pieces (``id, start, length, ...``) of at most ``CAPACITY``."""
    parts, length = spread(cut), F.col("length")
    bins = F.when(length <= EXACT, length).otherwise(F.ceil(length / QUANTUM) * QUANTUM).cast("int")
    binned = cut_lineage(cut.withColumn("bin", bins)
                         .withColumn("bucket", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.lit(parts))))
    per_bucket = cut_lineage(binned.groupBy("bin", "bucket").agg(F.count("*").alias("n")))
    histogram = per_bucket.groupBy("bin").agg(F.sum("n").alias("n")).orderBy("bin").collect()
    sizes = np.array([r.bin for r in histogram], np.int64)
    demand = np.array([r.n for r in histogram], np.int64)
    slots = _slots(filled_plan(sizes, demand), sizes, demand) if len(sizes) else {}

    in_bin = Window.partitionBy("bin").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = per_bucket.select("bin", "bucket", F.coalesce(F.sum("n").over(in_bin), F.lit(0)).alias("before"))
    in_bucket = Window.partitionBy("bin", "bucket").orderBy(F.desc("length"), "id", "start", "ids_crc32")
    ranked = (binned.withColumn("rank", F.row_number().over(in_bucket) - 1).join(before, ["bin", "bucket"])
              .withColumn("rank", F.col("rank") + F.col("before")).drop("before", "bucket"))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        bins, ranks = batch["bin"].to_numpy(), batch["rank"].to_numpy()
        sequence, slot = np.empty(len(bins), np.int64), np.empty(len(bins), np.int64)
        for size in np.unique(bins):
            rows, at = slots[int(size)], bins == size
            hit = rows[np.searchsorted(rows[:, 0], ranks[at], "right") - 1]
            sequence[at], slot[at] = hit[:, 1] + ranks[at] - hit[:, 0], hit[:, 2]
        return (batch.append_column("sequence_id", pa.array(sequence)).append_column("slot", pa.array(slot)))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema)
    dealt = map_batches(ranked, deal, f"{fields}, sequence_id bigint, slot bigint")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return (dealt.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0)))
            .drop("bin", "rank", "slot"))


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset`` per piece.

    Null text counts as empty: a document of the closing id alone.  Very long texts are cut into pieces of
    ``CAPACITY`` tokens.  Repeated rows and rows with
    a null id are packed like any other; an empty table gives an empty result; further columns
    are not carried.
    """
    packed = pack(pieces(docs, tokenizer, id_col, text_col))
    return packed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
                         "sequence_id", "offset")
