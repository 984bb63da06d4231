"""Hard negatives by exact inner-product search in an R-tree packed by Sort-Tile-Recursive.

Packing: slabs over the coordinates that vary most are cut at quantiles of a bounded sample; a row's tile is
its slab in each of them.  Rows are range-partitioned by (label, tile, id), and each task packs what it gets:
runs of rows are tiled once more by their own coordinates into leaves, a leaf keeps its minimum bounding box,
its labels' interval and its least id, and sixteen neighbours make a box of the next level.  Every row is in
the index; the sample only decides where cuts lie, never what is found.

Search: a box gives an interval per coordinate, and with the signs of the anchor's coordinates an interval of
inner products.  Each anchor has a queue of boxes, best upper bound first.  A box is dropped when its labels
rule it out, when its interval misses all score windows, or when its best possible score is strictly below the
k-th found so far (or equal with no smaller id inside).  Anchors that open the same box are served together, by
one matrix product.  Anchors go to the tasks in blocks of a stated size; rows never move again.

On vectors without structure boxes overlap and few are dropped: the search then costs what comparing all rows
with the anchors costs, and its result is as exact.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import cut_lineage, spread

FIT_ROWS = 20_000  # rows, chosen by a hash of the id, whose quantiles place the cuts
SLABS, CUT_COORDINATES = 8, 3
PART_ROWS = 1 << 17  # rows of one task's tree, at most about
RUN_ROWS, LEAF_ROWS, FANOUT = 1 << 14, 512, 16
ANCHOR_BLOCK = 1 << 14
_NONE = -(1 << 62)  # no score so far
_EXACT, _WIDEST = float(1 << 53), float(1 << 62)


# --- packing -----------------------------------------------------------------

def _cuts(sample: np.ndarray, coordinates: list[int]) -> tuple | None:
    """Nested quantile cuts: ``(coordinate, cuts, one tree per slab)``."""
    if not coordinates or len(sample) < 2 * SLABS:
        return None
    at, rest = coordinates[0], coordinates[1:]
    cuts = np.unique(np.quantile(sample[:, at], np.arange(1, SLABS) / SLABS, method="higher"))
    slab = np.searchsorted(cuts, sample[:, at], side="right")
    return at, cuts, [_cuts(sample[slab == s], rest) for s in range(len(cuts) + 1)]


def _tiles(rows: np.ndarray, tree: tuple | None, depth: int = CUT_COORDINATES) -> np.ndarray:
    """The tile number of every row."""
    tile = np.zeros(len(rows), np.int64)
    if tree is None:
        return tile
    at, cuts, below = tree
    slab = np.searchsorted(cuts, rows[:, at], side="right")
    for s in np.unique(slab).tolist():
        mine = slab == s
        tile[mine] = s * SLABS ** (depth - 1) + _tiles(rows[mine], below[s], depth - 1)
    return tile


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer vectors as rows, short ones filled up with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _leaf_rows(ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> Iterator[np.ndarray]:
    """Row numbers of each leaf: label first, then slabs of the two coordinates that vary most."""
    order = np.lexsort((ids, labels))
    edges = np.flatnonzero(np.diff(labels[order])) + 1
    small: list[np.ndarray] = []
    for run in np.split(order, edges):  # labels with few rows share a leaf
        if len(run) < LEAF_ROWS:
            small.append(run)
            if sum(map(len, small)) >= LEAF_ROWS:
                yield np.sort(np.concatenate(small))
                small = []
            continue
        leaves = -(-len(run) // LEAF_ROWS)
        a, b = np.argsort(-rows[run].var(axis=0), kind="stable")[[0, -1 if rows.shape[1] < 2 else 1]]
        for slab in np.array_split(run[np.lexsort((ids[run], rows[run, a]))], max(1, int(leaves ** 0.5))):
            slab = slab[np.lexsort((ids[slab], rows[slab, b]))]
            yield from np.array_split(slab, -(-len(slab) // LEAF_ROWS))
    if small:
        yield np.concatenate(small)


_LEAF = "least bigint, low_label bigint, high_label bigint, ids binary, labels binary, vectors binary, low binary, high binary"


def _pack(rows: DataFrame, width: int) -> DataFrame:
    """One row per leaf, in packing order."""
    names = [f.split()[0] for f in _LEAF.split(", ")]

    def leaf(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> tuple:
        kind = next(k for k in ("<i2", "<i4", "<i8") if np.abs(vectors).max(initial=0) <= np.iinfo(k).max)
        return (ids.min(), labels.min(), labels.max(), ids.tobytes(), labels.tobytes(), kind[1:].encode() + vectors.astype(kind).tobytes(),
                vectors.min(axis=0).tobytes(), vectors.max(axis=0).tobytes())

    def packed(table: pa.Table) -> pa.RecordBatch:
        ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("id", "label"))
        vectors = _matrix(table["vector"].combine_chunks(), width)
        leaves = [leaf(ids[at], labels[at], vectors[at]) for at in _leaf_rows(ids, labels, vectors)]
        kinds = [pa.int64()] * 3 + [pa.binary()] * 5
        return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*leaves), kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, RUN_ROWS - n)
                batch = batch.slice(part.num_rows)
                held.append(part)
                n += part.num_rows
                if n == RUN_ROWS:
                    yield packed(pa.Table.from_batches(held))
                    held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    return rows.mapInArrow(run, _LEAF)


def build_index(rows: DataFrame) -> tuple[DataFrame, int]:
    """The packed leaves of ``id, label, vector`` rows, and the length of the longest vector."""
    n_rows, width = rows.agg(F.count("*"), F.greatest(F.max(F.size("vector")), F.lit(1))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("vector").toArrow()
    fitted = _matrix(sample["vector"].combine_chunks(), width) if n_rows else np.zeros((0, width), np.int64)
    tree = _cuts(fitted, np.argsort(-fitted.var(axis=0), kind="stable")[:CUT_COORDINATES].tolist()) if n_rows else None

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tile = _tiles(_matrix(batch["vector"], width), tree)
            yield pa.record_batch([*batch.columns, pa.array(tile)], names=["id", "label", "vector", "tile"])

    parts = max(spread(rows), -(-n_rows // PART_ROWS))
    dealt = (rows.select("id", "label", "vector").mapInArrow(tiled, "id bigint, label bigint, vector array<bigint>, tile bigint")
             .repartitionByRange(parts, "label", "tile", "id").sortWithinPartitions("label", "tile", "id"))
    return cut_lineage(_pack(dealt, width)), width


# --- search ------------------------------------------------------------------

class _Tree:
    """One task's leaves with the levels above them; the last level has one box."""

    def __init__(self, table: pa.Table, width: int):
        def matrix(column: str) -> np.ndarray:
            return np.frombuffer(b"".join(table[column].to_pylist()), np.int64).reshape(-1, width).astype(np.float64)

        box = [matrix("low"), matrix("high"), *(table[c].to_numpy() for c in ("least", "low_label", "high_label"))]
        self.levels = [box]
        while len(box[0]) > 1:
            heads = np.arange(0, len(box[0]), FANOUT)
            box = [f.reduceat(part, heads, axis=0) for f, part in zip(
                (np.minimum, np.maximum, np.minimum, np.minimum, np.maximum), box)]
            self.levels.append(box)
        self.width, self.packed, self.open = width, {c: table[c] for c in ("ids", "labels", "vectors")}, {}

    def leaf(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if at not in self.open:
            ids, labels, vectors = (self.packed[c][at].as_py() for c in ("ids", "labels", "vectors"))
            rows = np.frombuffer(vectors[2:], f"<{vectors[:2].decode()}").reshape(-1, self.width).astype(np.float64)
            self.open[at] = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64), rows
        return self.open[at]


class _Search:
    """Queues and best rows of a block of anchors, each with one or more score windows."""

    def __init__(self, tree: _Tree, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, low: np.ndarray,
                 high: np.ndarray, k: int, same_label: bool):
        self.tree, self.ids, self.labels, self.k, self.same = tree, ids, labels, k, same_label
        self.low, self.high = low, high  # (anchors, windows); an unused window has low > high
        widest = max(np.abs(box).max(initial=0) for box in tree.levels[-1][:2])
        reach = float(np.abs(vectors).max(initial=0)) * float(widest) * max(tree.width, 1)
        if reach >= _WIDEST:
            raise ArithmeticError("inner products may not fit 64 bits")
        self.exact = np.float64 if reach < _EXACT else np.int64  # beyond 2^53 in whole numbers
        self.vectors = vectors.astype(self.exact)
        self.plus, self.minus = np.maximum(self.vectors, 0), np.minimum(self.vectors, 0)
        self.score = np.full((*low.shape, k), _NONE, np.int64)
        self.who = np.full((*low.shape, k), np.iinfo(np.int64).max, np.int64)

    def _useful(self, anchor: int, low: int, high: int, least: int) -> bool:
        """Whether a box with scores from ``low`` to ``high`` and ids from ``least`` may change a window's best."""
        for a, b, kth, last in zip(self.lows[anchor], self.highs[anchor], self.score[anchor, :, -1].tolist(),
                                   self.who[anchor, :, -1].tolist()):
            top = high if high < b else b
            if low <= b and high >= a and a <= b and (top > kth or (top == kth and least < last)):
                return True
        return False

    def _children(self, level: int, at: int, group: np.ndarray, queues: list) -> None:
        low, high, least, low_label, high_label = (
            x[at * FANOUT:(at + 1) * FANOUT] if level + 1 < len(self.tree.levels) else x for x in self.tree.levels[level])
        low, high = low.astype(self.exact), high.astype(self.exact)
        top = (self.plus[group] @ high.T + self.minus[group] @ low.T).astype(np.int64)
        bottom = (self.plus[group] @ low.T + self.minus[group] @ high.T).astype(np.int64)
        mine = self.labels[group][:, None]
        fits = ((low_label <= mine) & (mine <= high_label)) if self.same else ((low_label != mine) | (high_label != mine))
        fits &= (bottom <= self.high[group].max(axis=1)[:, None]) & (top >= self.low[group].min(axis=1)[:, None])
        for g, c in zip(*(x.tolist() for x in np.nonzero(fits))):
            anchor, best, worst = int(group[g]), int(top[g, c]), int(bottom[g, c])
            if self._useful(anchor, worst, best, int(least[c])):
                heapq.heappush(queues[anchor], (-best, int(least[c]), level, at * FANOUT + c, worst))

    def _visit(self, at: int, group: np.ndarray) -> None:
        ids, labels, rows = self.tree.leaf(at)
        score = (self.vectors[group] @ rows.astype(self.exact).T).astype(np.int64)
        floor = np.maximum(self.low[group], self.score[group, :, -1]).min(axis=1)
        ceiling = self.high[group].max(axis=1)
        g, c = np.nonzero((score >= floor[:, None]) & (score <= ceiling[:, None]))
        fits = ((labels[c] == self.labels[group[g]]) & (ids[c] != self.ids[group[g]])) if self.same else labels[c] != self.labels[group[g]]
        g, c = g[fits], c[fits]
        anchor, value, who = group[g], score[g, c], ids[c]
        for w in range(self.low.shape[1]):
            inside = (value >= self.low[anchor, w]) & (value <= self.high[anchor, w]) & (value >= self.score[anchor, w, -1])
            if not inside.any():
                continue
            owners = np.unique(anchor[inside])
            a = np.concatenate([anchor[inside], np.repeat(owners, self.k)])
            s = np.concatenate([value[inside], self.score[owners, w].ravel()])
            i = np.concatenate([who[inside], self.who[owners, w].ravel()])
            order = np.lexsort((i, -s, a))
            a, s, i = a[order], s[order], i[order]
            first = np.searchsorted(a, owners)
            keep = (first[:, None] + np.arange(self.k)).ravel()
            self.score[owners, w], self.who[owners, w] = s[keep].reshape(-1, self.k), i[keep].reshape(-1, self.k)

    def run(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """``anchor number, window, score, id`` of all rows found."""
        queues: list[list[tuple[int, int, int, int, int]]] = [[] for _ in self.ids]
        self.lows, self.highs = self.low.tolist(), self.high.tolist()
        self._children(len(self.tree.levels) - 1, 0, np.arange(len(self.ids)), queues)
        active = range(len(self.ids))
        while active:
            opened = defaultdict(list)
            for anchor in active:
                queue = queues[anchor]
                while queue:
                    best, least, level, at, worst = heapq.heappop(queue)
                    if self._useful(anchor, worst, -best, least):
                        opened[level, at].append(anchor)
                        break
            active = sorted(a for group in opened.values() for a in group)
            for (level, at), group in opened.items():
                if level:
                    self._children(level - 1, at, np.array(group), queues)
                else:
                    self._visit(at, np.array(group))
        anchor, window, place = np.nonzero(self.score > _NONE)
        return anchor, window, self.score[anchor, window, place], self.who[anchor, window, place]


def _nearest(leaves: DataFrame, width: int, anchors: DataFrame, k: int, same_label: bool) -> DataFrame:
    """``anchor, low, high, score, id``: at most k rows from each task for every anchor and window.

    ``anchors`` has ``id, label, vector, windows array<struct<low, high>>``.
    """
    blocks = -(-anchors.count() // ANCHOR_BLOCK) or 1

    def search(block: int) -> DataFrame:
        table = anchors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).select("id", "label", "vector", "windows").toArrow()
        ids, labels = (table[c].to_numpy().astype(np.int64) for c in ("id", "label"))
        vectors = _matrix(table["vector"].combine_chunks(), width) if len(ids) else np.zeros((0, width), np.int64)
        windows = table["windows"].to_pylist()
        most = max(map(len, windows), default=1)
        low, high = np.full((len(ids), most), -_NONE, np.int64), np.full((len(ids), most), _NONE, np.int64)
        for i, each in enumerate(windows):
            for w, x in enumerate(each):
                low[i, w], high[i, w] = x["low"], x["high"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [b for b in batches if b.num_rows]
            if parts and len(ids):
                tree = _Tree(pa.Table.from_batches(parts), width)
                anchor, window, score, who = _Search(tree, ids, labels, vectors, low, high, k, same_label).run()
                yield pa.record_batch([pa.array(ids[anchor]), pa.array(low[anchor, window]), pa.array(high[anchor, window]),
                                       pa.array(score), pa.array(who)], names=["anchor", "low", "high", "score", "id"])

        return leaves.mapInArrow(run, "anchor bigint, low bigint, high bigint, score bigint, id bigint")

    return reduce(DataFrame.unionByName, [search(b) for b in range(blocks)])


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(rows: DataFrame, is_anchor: Column, n_positives: int = 5, n_negatives: int = 3, low_percent: int = 50,
         high_percent: int = 95, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "vector") -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``vector_col`` holds integers, ``id_col`` and ``label_col`` are integers.  A row's score is its inner product
    with the anchor; higher scores come first, equal ones by smaller id.  Positives are the anchor's first
    ``n_positives`` other rows of its label; negatives the first ``n_negatives`` rows of other labels whose score
    is from ``low_percent`` to ``high_percent`` percent of the positive's.  A positive without such rows
    has none in the result.

    Rows with a null id, label or vector, or with a null component, take no part.  Rows that repeat an id
    count once: the one with the smallest label, then vector.  Shorter vectors are filled up with zeros.  Scores
    that may pass 2^62 are an error.  An empty table gives an empty result; further columns are not carried.
    """
    valid = F.col("id").isNotNull() & F.col("label").isNotNull() & F.forall("vector", lambda x: x.isNotNull())
    given = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
                        F.col(vector_col).cast("array<bigint>").alias("vector"),
                        is_anchor.alias("is_anchor")).where(valid)
    one = F.min(F.struct("label", "vector", "is_anchor"))
    clean = cut_lineage(given.groupBy("id").agg(one.alias("row")).select("id", "row.*"))
    leaves, width = build_index(clean)
    anchors = clean.where("is_anchor").drop("is_anchor")

    everywhere = F.array(F.struct(F.lit(_NONE + 1).alias("low"), F.lit(-_NONE).alias("high")))
    positives = cut_lineage(
        _first(_nearest(leaves, width, anchors.withColumn("windows", everywhere), n_positives, True), n_positives, "anchor")
        .select("anchor", F.col("id").alias("positive"), F.col("score").alias("positive_score")))
    # low * p <= 100 * n <= high * p, in whole numbers; nothing fits a negative p.
    p = F.col("positive_score").cast("decimal(38,0)")
    window = F.struct((-F.floor(-p * low_percent / 100)).cast("bigint").alias("low"),
                      F.floor(p * high_percent / 100).cast("bigint").alias("high"))
    windows = positives.where(p >= 0).groupBy("anchor").agg(F.collect_set(window).alias("windows"))
    asked = cut_lineage(anchors.join(windows.withColumnRenamed("anchor", "id"), "id"))
    negatives = (_first(_nearest(leaves, width, asked, n_negatives, False), n_negatives, "anchor", "low", "high")
                 .select("anchor", "low", "high", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")))
    return (positives.select("*", window["low"].alias("low"), window["high"].alias("high"))
            .join(negatives, ["anchor", "low", "high"])
            .select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id",
                    "positive_score", "negative_score"))
