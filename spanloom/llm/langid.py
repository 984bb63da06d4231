"""Language ID by hierarchical discrimination: the family first, then pairs inside the family.

Texts become square roots of hashed byte-trigram shares.  Linear support vector machines tell the
language families apart (one against the rest); inside a family one machine per pair of
languages votes.  All machines are trained on a bounded sample that takes turns over the
languages, and are applied as one matrix inside the tasks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import in_share, map_batches
from spanloom.llm.sampling import training_texts

UNKNOWN = "und"
SLOTS = 4096
TRAIN_DOCS = 3_000  # labelled documents the machines are trained on, at most
TRAIN_CHARS = 20_000  # longer texts are not trained on; all are scored
ROUNDS, PENALTY = 150, 1e-4
_SLICE_DOCS = 256

# Families of ISO 639-1 codes; a language that is not listed is its own family.
FAMILIES = {
    "germanic": "af da de en fy is lb nl no nb nn sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "turkic": "az kk ky tk tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "semitic": "ar he mt",
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if chr(b).islower() and b < 128 or b >= 128 else 32 for b in range(256))


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def describe(texts: list[str | None]) -> np.ndarray:
    """Rows of unit length over ``SLOTS`` hashed trigrams of lower-case letters and single spaces."""
    raw = [b" " + b" ".join((t or "").lower().encode().translate(_FOLD).split()) + b"  " for t in texts]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    code = flat[:-2] << np.uint32(16) | flat[1:-1] << np.uint32(8) | flat[2:]
    slot = (code * np.uint32(2654435761) >> np.uint32(20)).astype(np.int64)
    owner = np.repeat(np.arange(len(raw)), sizes)[:-2]
    counts = np.bincount(owner * SLOTS + slot, minlength=len(raw) * SLOTS)[:len(raw) * SLOTS].reshape(-1, SLOTS)
    return np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)).astype(np.float32)


def machine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights (and bias) of a linear support vector machine, squared hinge, accelerated gradient."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    cost = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w, ahead, rate = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32), 1 / (4 + PENALTY)
    for i in range(ROUNDS):
        miss = np.maximum(1 - y * (x @ ahead), 0)
        new = ahead - rate * (PENALTY * ahead - 2 * ((cost * y * miss) @ x))
        ahead = new + i / (i + 3) * (new - w)
        w = new
    return w


@dataclass
class Model:
    """Machines of the families, and per family the machines of its language pairs."""

    families: list[list[str]]
    pairs: list[list[tuple[int, int]]]
    weights: np.ndarray

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        margin = x @ self.weights[:, :-1].T + self.weights[:, -1]
        n, at = len(self.families), len(self.families)
        family = margin[:, :n].argmax(axis=1)
        ordered = np.sort(margin[:, :n], axis=1)
        gap = ordered[:, -1] - ordered[:, -2] if n > 1 else np.full(len(x), 10.0)
        names, score = np.empty(len(x), object), 1 / (1 + np.exp(-2 * gap))
        for f, (languages, pairs) in enumerate(zip(self.families, self.pairs)):
            rows = np.flatnonzero(family == f)
            votes, trust = np.zeros((len(rows), len(languages))), np.zeros((len(rows), len(languages)))
            for k, (a, b) in enumerate(pairs):
                m = margin[rows, at + k]
                votes[:, a] += m > 0
                votes[:, b] += m <= 0
                trust[:, a] += m
                trust[:, b] -= m
            at += len(pairs)
            if len(rows):
                best = (votes + 1e-3 * np.tanh(trust)).argmax(axis=1)
                names[rows] = np.array(languages, object)[best]
                if pairs:
                    score[rows] *= 1 / (1 + np.exp(-2 * trust[np.arange(len(rows)), best] / (len(languages) - 1)))
        return names.tolist(), score


def fit(x: np.ndarray, languages: np.ndarray) -> Model | None:
    """Train on feature rows and their languages; no rows, no model."""
    by_family: dict[str, list[str]] = {}
    for language in sorted(set(languages)):
        by_family.setdefault(_FAMILY_OF.get(language, f"own {language}"), []).append(language)
    families = list(by_family.values())
    if not families:
        return None
    pairs = [list(combinations(range(len(f)), 2)) for f in families]
    weights = [machine(x, np.where(np.isin(languages, f), 1, -1).astype(np.float32)) for f in families]
    for family, couples in zip(families, pairs):
        for a, b in couples:
            rows = np.isin(languages, (family[a], family[b]))
            weights.append(machine(x[rows], np.where(languages[rows] == family[a], 1, -1).astype(np.float32)))
    return Model(families, pairs, np.array(weights))


def train(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Train on at most ``TRAIN_DOCS`` texts with a letter and a language (``id_col, target``)."""
    sample = training_texts(docs, targets, TRAIN_DOCS, TRAIN_CHARS, id_col, text_col, balanced=True)
    rows = sorted((r.text, r.target) for r in sample.collect() if has_letter(r.text))
    return fit(np.concatenate([describe([t]) for t, _ in rows]) if rows else np.zeros((0, SLOTS)),
               np.array([target for _, target in rows]))


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, lang_pred, score`` for every whole text.

    Null and empty texts, and texts without a letter, are ``und`` with score 0, and so is all text
    if there was nothing to learn from.  Repeated rows and null ids come out as they came in; an
    empty table gives an empty result; further columns are not carried.
    """
    def cook(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch["text"].to_pylist()
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if has_letter(t)] if model else []
        for at in range(0, len(known), _SLICE_DOCS):
            rows = known[at:at + _SLICE_DOCS]
            found, score = model.predict(describe([texts[i] for i in rows]))
            scores[rows] = score
            for i, name in zip(rows, found):
                names[i] = name
        return pa.record_batch([batch["id"], pa.array(names, pa.string()), pa.array(scores)],
                               names=[id_col, "lang_pred", "score"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return map_batches(source, cook, f"`{id_col}` {kind}, lang_pred string, score double")


def predict_language(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``; held-out documents are not learned from."""
    held_out = in_share("doc_id", 5, 0)
    targets = docs.where(~held_out & F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("target"))
    return (identify(docs, train(docs, targets))
            .select("doc_id", held_out.alias("held_out"), "lang_pred", "score"))
