"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE_WORDS`` words.  A passage is described by its character
class bigrams and word repetition and encoded by one layer; gated attention weighs the
passages, and the weighted sum of the encodings is scored.  Only document labels are known, the
attention learns which passages decide.  Everything is trained jointly (numpy, Adam) on a bounded
sample; all passages of every document are scored inside the tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import in_share, map_batches, words
from spanloom.llm.sampling import training_texts

PASSAGE_WORDS = 48
GOOD_FROM = 0.7
TRAIN_DOCS = 4_000  # labelled documents the network is trained on, at most
TRAIN_CHARS = 20_000  # longer texts are not trained on; all are scored
ENCODING, GATES, EPOCHS, BAGS, RATE, DECAY = 24, 12, 25, 64, 0.01, 1e-4
_SLICE_WORDS = 400_000

_CLASS = np.full(256, 9, np.int64)  # bytes of other letters
for _i, _chars in enumerate((range(97, 123), range(65, 91), range(48, 58), b" ", b".,;:?", b"!", b"#*$%&|<>",
                             b"-'\"()[]{}/\\", [*range(0, 32), 127])):
    _CLASS[list(_chars)] = _i
_PAIRS = 100
N_FEATURES = _PAIRS + 3


def _passages(found: list[bytes]) -> list[list[bytes]]:
    return [found[i:i + PASSAGE_WORDS] for i in range(0, len(found), PASSAGE_WORDS)] or [[]]


def describe(passages: list[list[bytes]]) -> np.ndarray:
    """Feature rows of passages; an empty passage is the zero row."""
    joined = [b" ".join(p) + b" " for p in passages]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined))
    kinds = _CLASS[np.frombuffer(b"".join(joined), np.uint8)]
    owner = np.repeat(np.arange(len(joined)), sizes)
    same = owner[:-1] == owner[1:]
    code = owner[:-1] * _PAIRS + kinds[:-1] * 10 + kinds[1:]
    pairs = np.bincount(code[same], minlength=len(joined) * _PAIRS).reshape(-1, _PAIRS)
    n = np.array([max(len(p), 1) for p in passages])
    distinct = np.array([len(set(p)) for p in passages])
    extra = np.column_stack([distinct / n, np.minimum((sizes - 1) / n / 10, 5), np.log1p(distinct) / 4])
    return np.hstack([np.sqrt(pairs / np.maximum(sizes, 1)[:, None]), extra * (distinct > 0)[:, None]])


@dataclass
class Network:
    """Encoder, gated attention and output layer; ``bag`` arrays give each bag's first passage."""

    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        h = np.tanh(x @ w["encode"] + w["encode0"])
        t, g = np.tanh(h @ w["attend"]), 1 / (1 + np.exp(-(h @ w["gate"])))
        s = (t * g) @ w["weigh"]
        sizes = np.diff(first, append=len(x))
        e = np.exp(s - np.repeat(np.maximum.reduceat(s, first), sizes))
        a = e / np.repeat(np.add.reduceat(e, first), sizes)
        z = np.add.reduceat(h * a[:, None], first, axis=0)
        p = 1 / (1 + np.exp(-(z @ w["out"] + w["out0"])))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": p, "sizes": sizes}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        w, f = self.weights, self.forward(x, first)
        d = (f["p"] - y) / len(y)
        dz = np.repeat(d, f["sizes"])[:, None] * w["out"]
        da = (dz * f["h"]).sum(axis=1)
        mean = np.repeat(np.add.reduceat(f["a"] * da, first), f["sizes"])
        ds = (f["a"] * (da - mean))[:, None]
        dt = ds * w["weigh"] * f["g"] * (1 - f["t"] ** 2)
        dg = ds * w["weigh"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ w["attend"].T + dg @ w["gate"].T) * (1 - f["h"] ** 2)
        return {"encode": x.T @ dh, "encode0": dh.sum(axis=0), "attend": f["h"].T @ dt, "gate": f["h"].T @ dg,
                "weigh": (ds * f["t"] * f["g"]).sum(axis=0), "out": f["z"].T @ d, "out0": d.sum(keepdims=True)}


def fit(bags: list[np.ndarray], y: np.ndarray) -> Network:
    """Train on bags of feature rows; without bags every document scores one half."""
    rng = np.random.default_rng(0)
    shapes = {"encode": (N_FEATURES, ENCODING), "attend": (ENCODING, GATES), "gate": (ENCODING, GATES)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) for k, s in shapes.items()}
    w |= {"encode0": np.zeros(ENCODING), "weigh": rng.normal(0, 0.3, GATES),
          "out": rng.normal(0, 0.3, ENCODING) if len(bags) else np.zeros(ENCODING), "out0": np.zeros(1)}
    net = Network(w)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BAGS):
            some = order[at:at + BAGS]
            first = np.cumsum([0, *(len(bags[i]) for i in some[:-1])])
            step += 1
            for k, g in net.gradient(np.concatenate([bags[i] for i in some]), first, y[some]).items():
                g = g + DECAY * w[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                w[k] -= RATE * (mean[k] / (1 - 0.9 ** step)) / (np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return net


def train(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network:
    """Train on at most ``TRAIN_DOCS`` texts with a target of 0 or 1 (``id_col, target``)."""
    sample = training_texts(docs, targets, TRAIN_DOCS, TRAIN_CHARS, id_col, text_col)
    rows = sorted((r.text, r.target) for r in sample.collect())  # the same order every time
    bags = [describe(_passages(words(text))) for text, _ in rows]
    return fit(bags, np.array([target for _, target in rows], float))


def classify(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, score, predicted`` for every whole text, from all its passages.

    Null and empty texts are one empty passage.  Repeated rows and null ids come out as they came
    in; an empty table gives an empty result; further columns are not carried.
    """
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores: list[float] = []
        passages: list[list[bytes]] = []
        first: list[int] = []

        def flush() -> None:
            scores.extend(net.forward(describe(passages), np.array(first))["p"])
            passages.clear()
            first.clear()

        for text in batch["text"]:
            first.append(len(passages))
            passages.extend(_passages(words(text.as_py())))
            if len(passages) * PASSAGE_WORDS > _SLICE_WORDS:
                flush()
        if first:
            flush()
        score = np.array(scores)
        return pa.record_batch([batch["id"], pa.array(score), pa.array((score >= GOOD_FROM).astype(np.int32))],
                               names=[id_col, "score", "predicted"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_batches(source, cook, f"`{id_col}` {kind}, score double, predicted int")


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted``; labels of held-out documents are not learned."""
    held_out = in_share("doc_id", 4, 2)
    targets = labels.where(~held_out).select("doc_id", F.col("quality").alias("target"))
    return (classify(docs, train(docs, targets))
            .select("doc_id", held_out.alias("held_out"), "score", "predicted"))
