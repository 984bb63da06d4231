"""SimHash near-duplicates by Golay-code fuzzy hashing.

The 64 fingerprint bits are cut into segments of 23, 23 and 18 bits.  The binary Golay code
[23, 12, 7] is perfect: each word has one codeword within 3 bits, and a word at exactly 3 bits
has five more at 4.  A segment's keys are the indices of all codewords within 4 bits (one or
six), so segments that differ in at most one bit share a key.  Two fingerprints that differ in
at most two bits have one segment equal and a second within one bit, and of the three ordered
choices (A, B), (B, C), (C, A) at least one has that form: the key is the first segment itself
with a codeword index of the second.

Fingerprints are made distinct first.  Keys held by few fingerprints are verified pair by pair;
those of crowded keys go through balls of radius one: two fingerprints within two bits lie in
the ball of a common centre, a ball has 65 points and all of them are within two bits of each
other, so a star per ball holds every link without forming pairs.
"""

from __future__ import annotations

from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import cut_lineage, map_batches
from spanloom.llm.components import components

SEED = 42
# Fixed values of the contract: words of a shingle, bits in which linked fingerprints may differ.
SHINGLE = 3
MAX_BITS = 2
PAIRS_UP_TO = 64  # fingerprints of one key that are compared pair by pair; larger keys use balls
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
CHOICES = ((0, 1), (1, 2), (2, 0))
GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The eight fingerprint bytes, highest bit first; zero for a text without words."""
    found = text.encode().lower().split() if text else []
    if not found:
        return bytes(8)
    joined = b" ".join(found)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in found)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    width = min(shingle, len(found))
    total = np.zeros(64, np.int64)
    digest = xxhash.xxh64_digest
    for first in range(0, len(found) - width + 1, _CHUNK):
        last = min(first + _CHUNK, len(found) - width + 1)
        hashes = b"".join([digest(joined[s:e], SEED)
                           for s, e in zip(starts[first:last], ends[first + width - 1:last + width - 1])])
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(found) - width + 1).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id, print``: the fingerprint of every row as a signed bigint."""
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = b"".join(fingerprint(t.as_py(), shingle) for t in batch["text"])
        signed = np.frombuffer(prints, ">u8").astype(np.uint64).view(np.int64)
        return pa.record_batch([batch["id"], pa.array(signed)], names=["id", "print"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(source, cook, f"id {source.schema['id'].dataType.simpleString()}, print bigint")


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Per syndrome: the coset leader, and the message bits of the codewords five bits of keys add."""
    def remainder(x: int) -> int:
        for bit in range(22, 10, -1):
            if x >> bit & 1:
                x ^= GENERATOR << (bit - 11)
        return x

    codewords = np.array([m << 11 | remainder(m << 11) for m in range(4096)], np.int64)
    sevens = codewords[np.bitwise_count(codewords) == 7]
    leader, extra = np.zeros(2048, np.int64), np.full((2048, 5), -1, np.int64)
    single = [1 << i for i in range(23)]
    for a in range(23):
        leader[remainder(single[a])] = single[a]
        for b in range(a):
            two = single[a] | single[b]
            leader[remainder(two)] = two
            for c in range(b):
                three = two | single[c]
                at = remainder(three)
                leader[at] = three
                extra[at] = sevens[sevens & three == three] >> 11
    return leader, extra


def _syndromes(x: np.ndarray) -> np.ndarray:
    for bit in range(22, 10, -1):
        x = np.where(x >> bit & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def codeword_indices(segment: np.ndarray) -> np.ndarray:
    """(n, 6) indices of the codewords within 4 bits of 23-bit words; -1 where there is one only."""
    leader, extra = _golay()
    syndrome = _syndromes(segment)
    nearest = (segment ^ leader[syndrome]) >> 11
    more = np.where(extra[syndrome] >= 0, extra[syndrome] ^ nearest[:, None], -1)
    return np.column_stack([nearest, more])


def golay_keys(prints: np.ndarray) -> np.ndarray:
    """(n, 18) keys of fingerprints, -1 where there is none."""
    bits = prints.view(np.uint64)
    parts = [((bits >> np.uint64(at)) & np.uint64((1 << size) - 1)).astype(np.int64) for at, size in SEGMENTS]
    keys = []
    for choice, (exact, near) in enumerate(CHOICES):
        index = codeword_indices(parts[near])
        keys.append(np.where(index >= 0, (choice << 35 | parts[exact][:, None] << 12) | index, -1))
    return np.concatenate(keys, axis=1)


def _key_rows(nodes: DataFrame) -> DataFrame:
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = batch["print"].to_numpy(zero_copy_only=False)
        keys = golay_keys(prints)
        at, _ = np.nonzero(keys >= 0)
        return pa.record_batch([pa.array(keys[keys >= 0]), pa.array(prints[at]), batch["node"].take(pa.array(at))],
                               names=["key", "print", "node"])

    return map_batches(nodes, cook, "key bigint, print bigint, node bigint")


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``a, b``: links that connect all ``nodes`` (``print, node``; prints distinct) within ``max_bits`` bits.

    Keys are made for two bits; a smaller radius verifies fewer of their pairs.
    """
    if not 0 <= max_bits <= MAX_BITS:
        raise ValueError(f"the keys hold fingerprints within {MAX_BITS} bits together")
    keys = _key_rows(nodes)
    sizes = keys.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    shared = cut_lineage(keys.join(sizes, "key"))
    point = F.struct("print", "node")
    rows = (shared.where(F.col("size") <= PAIRS_UP_TO).groupBy("key").agg(F.collect_list(point).alias("points"))
            .select("points", F.explode("points").alias("x")))
    near = F.filter("points", lambda y: (y["print"] > F.col("x.print"))
                    & (F.bit_count(y["print"].bitwiseXOR(F.col("x.print"))) <= max_bits))
    pairs = rows.select("x", F.explode(near).alias("y")).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))

    crowded = shared.where(F.col("size") > PAIRS_UP_TO).select("print", "node").distinct()
    bits = F.array(*(F.lit(1 << i if i < 63 else -(1 << 63)).cast("bigint") for i in range(64)))
    if max_bits == MAX_BITS:
        around = F.transform(F.concat(F.array(F.lit(0).cast("bigint")), bits), lambda x: F.struct(
            x.bitwiseXOR(F.col("print")).alias("at"), F.lit(0).cast("bigint").alias("bit")))
    else:  # one bit: the two prints that differ in a given bit only; none: prints are distinct
        around = F.transform(F.slice(bits, 1, 64 * max_bits), lambda x: F.struct(
            x.bitwiseOR(F.col("print")).alias("at"), x.alias("bit")))
    balls = crowded.select("node", F.explode(around).alias("centre"))
    stars = (balls.groupBy("centre").agg(F.collect_list("node").alias("points")).where(F.size("points") > 1)
             .select(F.array_min("points").alias("a"), F.explode("points").alias("b")).where("a <> b"))
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """``id_col, fingerprint, component_id`` for every row; ids of any type that can be ordered.

    A-Z lower-cased, words between white space of ASCII, shingles of ``shingle`` words with repeats (fewer
    words: the whole sequence).  Fingerprints that differ in ``max_bits`` bits or fewer (2 at most) are linked;
    the component id is the smallest document id reachable.  Links run between fingerprints, so neither the
    type of an id nor a missing one matters to them.

    Null and empty texts have fingerprint zero and are linked like any other; very long texts are read whole.
    Repeated rows come out as often as they came in; rows that repeat an id with another text belong to the
    group of that text.  Rows with a null id take the component of their group, null if no row of it has an
    id.  An empty table gives an empty result; further columns are not carried.
    """
    prints = cut_lineage(fingerprints(docs, id_col, text_col, shingle))
    nodes = cut_lineage(prints.groupBy("print").agg(F.min("id").alias("least")))
    roots = components(near_links(nodes.select("print", F.col("print").alias("node")), max_bits))
    rooted = cut_lineage(nodes.join(roots.withColumnRenamed("node", "print"), "print", "left")
                         .select("print", "least", F.coalesce("root", "print").alias("root")))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = cut_lineage(rooted.join(groups, "root").select("print", "component_id"))
    return (prints.join(placed, "print")
            .select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
                    "component_id"))
