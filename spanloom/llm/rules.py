"""Quality rules: boosted trees over document statistics, with monotonic constraints.

The statistics of every whole text are computed in one pass.  Trees are grown on a bounded
sample of labelled documents (histogram splits, logistic loss); a document with more
repetition, more repeated lines, more symbols or more capitals never scores better for it.  A
model is five node arrays; scoring walks all rows of a batch down a tree at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import WHITESPACE, map_batches
from spanloom.llm.sampling import training_texts

SYMBOLS = b"#*$%&|<>"  # fixed value of the contract
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
TRAIN_ROWS = 10_000  # labelled documents the trees are grown on, at most
TRAIN_CHARS = 1_000_000  # longer texts are not trained on; all are scored
TREES, DEPTH, RATE, BINS, MIN_LEAF, RIDGE = 60, 3, 0.2, 32, 10, 1.0
KEEP_FROM = 0.5

#: Statistics and the direction in which a growing value may move the score (0: either).
FEATURES = {"log_words": 0, "mean_word_chars": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
            "upper_share": -1, "digit_share": 0, "exclaim_share": -1, "punctuation_share": 0, "distinct_word_share": 0,
            "mean_line_words": 0, "longest_word_share": -1}
_UPPER, _DIGITS, _STOPS = bytes(range(65, 91)), bytes(range(48, 58)), b".,;:?"


def _count(raw: bytes, chars: bytes) -> int:
    return len(raw) - len(raw.translate(None, chars))


def _repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words in windows of three words that occur twice or more."""
    if len(ids) < 3:
        return 0
    pairs = np.unique(ids[:-1] * n_distinct + ids[1:], return_inverse=True)[1]
    _, at, times = np.unique(pairs[:-1] * n_distinct + ids[2:], return_inverse=True, return_counts=True)
    again = times[at] > 1
    covered = np.zeros(len(ids), bool)
    for shift in range(3):
        covered[shift:len(ids) - 2 + shift] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, ...], list[float]]:
    """Counts ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words``, and the features."""
    raw = text.encode() if text else b""
    found = raw.split()
    n = len(found)
    index: dict[bytes, int] = {}
    ids = np.array([index.setdefault(w, len(index)) for w in found], np.int64)
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    chars = len(text or "") - _count(raw, WHITESPACE)
    symbols, dups, repeats = _count(raw, SYMBOLS), len(lines) - len(set(lines)), _repeated_words(ids, len(index))
    top = int(np.bincount(ids).max()) if n else 0
    size, some = max(len(raw), 1), max(n, 1)
    features = [float(np.log1p(n)), chars / some, symbols / some, dups / max(len(lines), 1), repeats / some,
                _count(raw, _UPPER) / size, _count(raw, _DIGITS) / size, _count(raw, b"!") / some,
                _count(raw, _STOPS) / some, len(index) / some, n / max(len(lines), 1), top / some]
    return (n, chars, symbols, dups, repeats), features


@dataclass
class Trees:
    """Flattened trees: node arrays with the root of each tree, leaves pointing to themselves."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(DEPTH):
                low = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(low, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, directions: np.ndarray) -> Trees:
    """Boost trees on rows ``x`` with labels ``y``; without rows every document scores one half."""
    nodes: list[list[float]] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    rate = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    base = float(np.log(rate / (1 - rate)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) if len(y) else np.zeros(1) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)])
    total = np.full(len(y), base)

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(g / (h + RIDGE), low, high))

    def add(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, low: float, high: float) -> int:
        at = len(nodes)
        nodes.append([0, np.inf, at, at, RATE * leaf(g[rows].sum(), h[rows].sum(), low, high)])
        best = (1e-6, -1, 0, 0.0, 0.0)
        whole = g[rows].sum() ** 2 / (h[rows].sum() + RIDGE)
        for f in range(x.shape[1]) if depth < DEPTH and len(rows) >= 2 * MIN_LEAF else ():
            size = len(edges[f]) + 1
            gs, hs, ns = (np.cumsum(np.bincount(binned[rows, f], w, size)) for w in (g[rows], h[rows], None))
            gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
            gr, hr = gs[-1] - gl, hs[-1] - hl
            vl, vr = np.clip(gl / (hl + RIDGE), low, high), np.clip(gr / (hr + RIDGE), low, high)
            gain = gl * gl / (hl + RIDGE) + gr * gr / (hr + RIDGE) - whole
            allowed = (nl >= MIN_LEAF) & (len(rows) - nl >= MIN_LEAF) & (directions[f] * (vr - vl) >= 0)
            gain = np.where(allowed, gain, -np.inf)
            if len(gain) and gain.max() > best[0]:
                b = int(gain.argmax())
                best = (gain[b], f, b, vl[b], vr[b])
        if best[1] >= 0:
            _, f, b, vl, vr = best
            goes = binned[rows, f] <= b
            middle = (vl + vr) / 2
            bounds = {0: ((low, high),) * 2, -1: ((middle, high), (low, middle)), 1: ((low, middle), (middle, high))}
            to_left, to_right = bounds[int(directions[f])]
            nodes[at][:2] = [f, edges[f][b]]
            nodes[at][2] = add(rows[goes], g, h, depth + 1, *to_left)
            nodes[at][3] = add(rows[~goes], g, h, depth + 1, *to_right)
        return at

    for _ in range(TREES if len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        roots.append(len(nodes))
        add(np.arange(len(y)), y - p, p * (1 - p), 0, -np.inf, np.inf)
        tree = Trees(np.array(roots[-1:]), *_arrays(nodes), base=0.0)
        q = np.clip(tree.score(x), 1e-12, 1 - 1e-12)
        total += np.log(q / (1 - q))
    return Trees(np.array(roots, np.int64), *_arrays(nodes), base=base)


def _arrays(nodes: list[list[float]]) -> tuple[np.ndarray, ...]:
    table = np.array(nodes, float).reshape(-1, 5)
    return tuple(table[:, i].astype(np.int64 if i in (0, 2, 3) else float) for i in range(5))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Trees from at most ``TRAIN_ROWS`` documents with ``labels.quality``."""
    sample = training_texts(docs, labels.select(id_col, F.col("quality").alias("target")), TRAIN_ROWS, TRAIN_CHARS,
                            id_col, text_col)

    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [statistics(t.as_py())[1] for t in batch["text"]]
        return pa.record_batch([pa.array(found, pa.list_(pa.float64())), batch["target"].cast(pa.float64())],
                               names=["features", "target"])

    rows = map_batches(sample, cook, "features array<double>, target double").toArrow()
    x = np.array(rows["features"].to_pylist(), float).reshape(-1, len(FEATURES))
    y = rows["target"].to_numpy()
    order = np.lexsort([*x.T, y])  # the same trees whatever order the rows came in
    return grow(x[order], y[order], np.array(list(FEATURES.values())))


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics, ``base_failed``, ``kept`` and ``quality_score`` of every whole text.

    The base rules fail texts under ``MIN_WORDS`` words, null and empty ones among them, and texts
    with more than ``MAX_REPEAT_PERCENT`` percent repeated words.  Other texts are kept from a score
    of ``KEEP_FROM``.  Repeated rows and null ids come out as they came in; an empty table gives an
    empty result; further columns are not carried.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(t.as_py()) for t in batch["text"]]
        counts = np.array([c for c, _ in both], np.int64)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        score = trees.score(np.array([f for _, f in both], float))
        return pa.record_batch([batch["id"], *map(pa.array, counts.T), pa.array(failed),
                                pa.array(~failed & (score >= KEEP_FROM)), pa.array(score)],
                               names=[id_col, *names, "base_failed", "kept", "quality_score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_batches(source, cook, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in names)
                       + ", base_failed boolean, kept boolean, quality_score double")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, all columns, without a shuffle."""
    at = docs.columns.index(text_col)

    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        both = [statistics(t.as_py()) for t in batch.column(at)]
        counts = np.array([c for c, _ in both], np.int64)
        failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
        return batch.filter(pa.array(~failed & (trees.score(np.array([f for _, f in both], float)) >= KEEP_FROM)))

    return map_batches(docs, cook, docs.schema)
