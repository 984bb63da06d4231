"""Ranked lexical search over a length-stratified index.

A term that occurs ``tf`` times in a document of normaliser ``m`` adds its weight times an impact that
depends on (tf, m) only.  The index therefore groups documents by equal ``m``: a stratum's postings are
ordered by term and tf, and a run of equal tf shares one impact, computed once.  A stratum's bound for an item
is the sum of its terms' largest impacts there; strata are visited by falling bounds, until the bounds fall
below the k-th score found so far (or meet it and no smaller id can follow).

Documents are read once for each block of items: the block's terms, a bounded number of characters, go to the
tasks, and what is kept of a document are its counts of these terms.  A stratum that holds many documents (a
third of all may share one length) is dealt to several tasks in chunks by a hash of the document; each chunk
is searched like a stratum of its own, and the best of all chunks are merged.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut_lineage, spread

BLOCK_CHARS = 1_000_000  # characters of items that go to the tasks at once
CHUNK_ROWS = 256  # strata of so many documents are never divided; larger ones if they exceed a task's even share
# Fixed values of the contract: impact scale, normaliser base and length share, weight scale.
IMPACT, TF_SCALE, M_SCALE, M_BASE, M_LENGTH, W_SCALE = 1_000_000_000, 1000, 20, 50, 50, 1000
_ALNUM = string.ascii_letters + string.digits
_TERM_BYTES = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b) in _ALNUM else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters and digits of ASCII and of all other characters beyond ASCII, A-Z lower-cased."""
    return text.encode().translate(_TERM_BYTES).split() if text else []


class _Items:
    """A block of items: their ids and their distinct terms, as numbers."""

    def __init__(self, rows: list[tuple[object, str]]):
        union: dict[object, set[bytes]] = defaultdict(set)
        for key, text in rows:
            union[key].update(terms(text))
        self.ids = list(union)
        self.number = {t: i for i, t in enumerate(sorted(set().union(*union.values())))}
        self.terms = [np.array(sorted(self.number[t] for t in union[key]), np.int64) for key in self.ids]


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks of about ``BLOCK_CHARS`` characters, one at a time on the driver; an id is in one block."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = chars // BLOCK_CHARS + 1
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).distinct().toArrow()
        yield list(zip(part["item"].to_pylist(), part["text"].to_pylist()))


def _counted(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """``id, n, term, tf``: each document's length and its counts of the block's terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, sizes, found, times = [], [0], [], []
            for text in batch["text"]:
                words = terms(text.as_py())
                lengths.append(len(words))
                mine = sorted((number[w], c) for w, c in Counter(filter(number.__contains__, words)).items())
                found.extend(t for t, _ in mine)
                times.extend(c for _, c in mine)
                sizes.append(len(found))
            edges = pa.array(sizes, pa.int32())
            yield pa.record_batch(
                [batch["id"], pa.array(lengths, pa.int64()), pa.ListArray.from_arrays(edges, pa.array(found, pa.int32())),
                 pa.ListArray.from_arrays(edges, pa.array(times, pa.int32()))], names=["id", "n", "term", "tf"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n bigint, term array<int>, tf array<int>")


class _Stratum:
    """Documents of one normaliser: postings ordered by (term, tf), one impact per run of equal tf."""

    def __init__(self, m: int, rank: np.ndarray, sizes: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray):
        self.rank = np.sort(rank)  # documents in the order of their ids
        place = np.repeat(np.argsort(np.argsort(rank)), sizes)
        order = np.lexsort((place, tf, term))
        self.doc, term, tf = place[order], term[order], tf[order]
        first = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(tf, prepend=-1))
        self.edges = np.append(first, len(term))
        impact = [w * (IMPACT * t // (TF_SCALE * t + M_SCALE * m))
                  for w, t in zip(weight[term[first]].tolist(), tf[first].tolist())]
        self.impact = np.array(impact, np.int64)
        self.runs_of: dict[int, tuple[int, int]] = {}
        run_term = term[first]
        heads = np.flatnonzero(np.diff(run_term, prepend=-1))
        for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(run_term)]):
            self.runs_of[int(run_term[a])] = (a, b)

    def bounds(self, size: int) -> np.ndarray:
        """The largest impact of every term; runs of a term rise with tf."""
        best = np.zeros(size, np.int64)
        for term, (_, end) in self.runs_of.items():
            best[term] = self.impact[end - 1]
        return best

    def best(self, wanted: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
        """``score, rank`` of the k best documents with a score above 0."""
        score = np.zeros(len(self.rank), np.int64)
        for term in wanted:
            for run in range(*self.runs_of.get(term, (0, 0))):
                score[self.doc[self.edges[run]:self.edges[run + 1]]] += self.impact[run]  # a document once a run
        at = np.flatnonzero(score)
        if len(at) > k:
            least = np.partition(score[at], len(at) - k)[len(at) - k]
            at = at[score[at] >= least]
        at = at[np.lexsort((at, -score[at]))][:k]
        return score[at], self.rank[at]


def _search(strata: list[_Stratum], wanted: list[np.ndarray], size: int, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``item number, ranks, scores`` of the k best documents of all ``strata``."""
    if not strata:
        return
    caps = np.stack([s.bounds(size) for s in strata])
    smallest = [int(s.rank[0]) for s in strata]
    for item, mine in enumerate(wanted):
        bound = caps[:, mine].sum(axis=1)
        score, rank = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for at in np.argsort(-bound, kind="stable").tolist():
            if bound[at] == 0 or (len(score) == k and bound[at] < score[-1]):
                break
            if len(score) == k and bound[at] == score[-1] and smallest[at] > rank[-1]:
                continue
            more, who = strata[at].best(mine.tolist(), k)
            score, rank = np.concatenate([score, more]), np.concatenate([rank, who])
            order = np.lexsort((rank, -score))[:k]
            score, rank = score[order], rank[order]
        if len(score):
            yield item, rank, score


def _search_block(docs: DataFrame, rows: list[tuple[object, str]], item_type: str, k: int) -> DataFrame:
    """``item, id, score``: at most k rows of each item from every partition of the index."""
    items = _Items(rows)
    size, id_type = len(items.number), docs.schema["id"].dataType.simpleString()
    counted = cut_lineage(_counted(docs, items.number))
    n_docs, n_terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = counted.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    ratio = F.lit(2 * n_docs + 2).cast("double") / (2 * F.col("df") + 1)
    weight = np.zeros(size, np.int64)
    for term, value in held.select("term", F.floor(W_SCALE * F.log(ratio)).alias("w")).collect():  # terms of the block
        weight[term] = value
    # Integer division of exact numbers: 50 * n * N outgrows 64 bits on very large corpora.
    length = (F.lit(M_LENGTH).cast("decimal(38,0)") * F.col("n") * F.lit(n_docs).cast("decimal(19,0)"))
    m = F.lit(M_BASE) + F.call_function("div", length, F.lit(max(n_terms, 1)).cast("decimal(19,0)"))
    index = counted.where(F.size("term") > 0).withColumn("m", m.cast("bigint"))
    parts = spread(docs)
    even = max(CHUNK_ROWS, n_docs // parts)
    # Fewer strata than there are tasks can exceed a task's share: a small table.
    crowd = index.groupBy("m").agg(F.count("*").alias("rows")).where(F.col("rows") > even)
    chunks = F.coalesce(F.ceil(F.col("rows") / even), F.lit(1))
    dealt = (index.join(F.broadcast(crowd), "m", "left")
             .withColumn("chunk", F.pmod(F.xxhash64("id", "n", "term", "tf"), chunks))
             .repartition(parts, "m", "chunk").sortWithinPartitions("m", "chunk")
             .select("id", "m", "chunk", "term", "tf"))
    keys, wanted = pa.array(items.ids), items.terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts).combine_chunks()
        ids, term, tf = (table[c].combine_chunks() for c in ("id", "term", "tf"))
        rank = pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy().astype(np.int64)
        by_rank = np.argsort(rank)
        offset = term.offsets.to_numpy()
        words, times = term.values.to_numpy().astype(np.int64), tf.values.to_numpy().astype(np.int64)
        m, chunk = (table[c].to_numpy() for c in ("m", "chunk"))
        heads = np.flatnonzero(np.diff(m, prepend=-1) | np.diff(chunk, prepend=-1))
        strata = [_Stratum(int(m[a]), rank[a:b], np.diff(offset[a:b + 1]), words[offset[a]:offset[b]], times[offset[a]:offset[b]],
                           weight) for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(m)])]
        for item, who, score in _search(strata, wanted, size, k):
            yield pa.record_batch([keys.take(pa.array([item] * len(who))), ids.take(pa.array(by_rank[who - 1])),
                                   pa.array(score)], names=["item", "id", "score"])

    return dealt.mapInArrow(run, f"item {item_type}, id {id_type}, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", item_col: str = "item_id",
                   text_col: str = "text") -> DataFrame:
    """``item_col, rank, id_col, score``: the ``k`` documents with the highest score above 0 for each item.

    Equal scores come by ascending document id, null ids last; ranks count from 1.  An item's terms count
    once each.  Rows with one item id are one item with the terms of all of them; a null item id is an id
    like any other.  Null and empty texts have no terms: as items they find nothing, as documents they
    don't count in any statistic.  Repeated documents rank one by one.  Very long texts are read whole.
    Empty tables give empty results; further columns are not carried.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    asked = items.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("text is not null")
    kind = asked.schema["item"].dataType.simpleString()
    found = reduce(DataFrame.unionByName, [_search_block(source, rows, kind, k) for rows in _blocks(asked)])
    place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return (found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
            .select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"))
