"""Sentences, batch tagging and the shapes predictions arrive in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at

Tagger = Callable[[list[list[str]]], list[list[str]]]

BATCH_TOKENS = 1 << 14  # tokens that a tagger gets at once
MODELS_KEPT = 4
_KEYS = ("doc_id", "sent_id")
_MODELS: dict[str, Tagger] = {}  # of this process


def describe_sentences(sentences: DataFrame) -> DataFrame:
    """``doc_id, sent_id, text, tags, pairs`` from sentence rows (``tokens`` and ``tags``)."""
    return sentences.select(
        *_KEYS, F.array_join("tokens", " ").alias("text"), "tags",
        F.zip_with("tags", "tokens", lambda t, w: F.struct(t.alias("tag"), w.alias("token"))).alias("pairs"))


def assemble_sentences(lines: DataFrame, keys: tuple[str, ...] = _KEYS,
                       order: str = "tok_idx") -> DataFrame:
    """Flat token rows -> one row per sentence with ordered ``tokens`` and ``tags``.

    The result is one row per sentence by definition, so sentences must be of a
    size that fits a row (windows are); ``window_docs`` needs no shuffle at all.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, "token", "tag")))
    return (lines.groupBy(*keys).agg(ordered.alias("_x"))
            .select(*keys, F.col("_x.token").alias("tokens"), F.col("_x.tag").alias("tags")))


def explode_sentences(sentences: DataFrame) -> DataFrame:
    """``doc_id, sent_id, tok_idx, token, tag``."""
    return (explode_at(sentences, [*_KEYS, "tags"], "tokens", "tok_idx", "token")
            .select(*_KEYS, "tok_idx", "token", F.get("tags", F.col("tok_idx")).alias("tag")))


def model_in_worker(key: str, load: Callable[[], Tagger]) -> Tagger:
    """The model of ``key``, loaded once in the life of this worker process.

    Workers outlive their tasks, so a later task, also of another query, finds the model in place.  A worker
    keeps ``MODELS_KEPT`` models; the one that was not used for longest goes first.
    """
    model = _MODELS.pop(key, None) or load()
    _MODELS[key] = model
    while len(_MODELS) > MODELS_KEPT:
        _MODELS.pop(next(iter(_MODELS)))
    return model


def _batches(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive ranges whose sizes sum to ``most`` or less; one that is larger stands alone."""
    first, total = 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > most:
            yield first, i
            first, total = i, 0
        total += size
    if first < len(sizes):
        yield first, len(sizes)


def tag_arrays(sentences: DataFrame, load: Callable[[], Tagger], batch_tokens: int = BATCH_TOKENS,
               keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, sent_id``, the columns ``keep``, ``tokens`` and, from a caller's tagger, ``tags``.

    ``load()`` runs once per worker process, see ``model_in_worker``, and returns ``fn(sentences) -> tags per
    sentence``, one tag per token of ``tokens``; another number of tags is an error.  A call gets sentences of
    ``batch_tokens`` tokens together at most, or a single longer one.
    """
    key = hashlib.sha256(cloudpickle.dumps(load)).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = model_in_worker(key, load)
        for batch in batches:
            tokens = batch["tokens"].to_pylist()
            sizes = [len(t) for t in tokens]
            tags: list[list[str]] = []
            for a, b in _batches(sizes, batch_tokens):
                tags.extend(fn(tokens[a:b]))
            if list(map(len, tags)) != sizes:
                raise ValueError("the tagger must return one tag per token")
            yield pa.record_batch([*batch.columns, pa.array(tags, pa.list_(pa.string()))], names=[*batch.schema.names, "tags"])

    fields = {f.name: f.dataType.simpleString() for f in sentences.schema}
    schema = ", ".join(f"{k} {fields[k]}" for k in (*_KEYS, *keep)) + ", tokens array<string>, tags array<string>"
    return sentences.select(*_KEYS, *keep, "tokens").mapInArrow(run, schema)


def tag_sentences(sentences: DataFrame, load: Callable[[], Tagger], batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """``doc_id, sent_id, prediction ARRAY<MAP<token, tag>>`` from a caller's tagger; see ``tag_arrays``."""
    return tag_arrays(sentences, load, batch_tokens).select(
        *_KEYS, F.zip_with("tokens", "tags", lambda w, t: F.create_map(w, t)).alias("prediction"))


def flatten_predictions(predictions: DataFrame) -> DataFrame:
    """``doc_id, sent_id, tok_idx, token, pred`` from nested predictions."""
    return (explode_at(predictions, _KEYS, "prediction", "tok_idx", "_map")
            .select(*_KEYS, "tok_idx", F.explode("_map").alias("token", "pred")))


def flatten_gold(sentences: DataFrame) -> DataFrame:
    """``doc_id, sent_id, tok_idx, token, true`` with every (tag, token) pair of a sentence."""
    return explode_sentences(sentences).withColumnRenamed("tag", "true")


def learn_frequent_tags(lines: DataFrame) -> DataFrame:
    """``token, tag``: the most frequent tag of each token, ties to the smallest tag.

    Counting by (token, tag) first keeps frequent tokens out of the second step.
    """
    counts = lines.groupBy("token", "tag").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("token").agg(F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("tag"))


def apply_frequent_tags(lines: DataFrame, model: DataFrame, hot_share: int = 1000,
                        default: str = vocab.OUTSIDE) -> DataFrame:
    """Add ``pred`` to token rows by looking the token up, ``default`` if unknown.

    The model grows with the vocabulary, so it is joined without a broadcast
    hint.  Tokens that make up more than 1/``hot_share`` of the rows would fill
    single tasks of that join; there are fewer than ``hot_share`` of them
    whatever the data, so these are broadcast, and their rows go through the
    shuffle under keys that spread evenly.
    """
    counts = lines.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select(F.sum("_n")).scalar()
    hot = counts.where(F.col("_n") * hot_share > total).select("token")
    known_hot = model.join(F.broadcast(hot), "token").select("token", F.col("tag").alias("_tag"))
    hot_tags = hot.join(F.broadcast(known_hot), "token", "left").select(
        "token", F.coalesce("_tag", F.lit(default)).alias("_hot"))

    order: list[Column] = [F.col(c) for c in ("doc_id", "sent_id", "tok_idx") if c in lines.columns]
    spread = F.concat(F.lit("\u0000"), F.xxhash64(*order).cast("string"))
    marked = (lines.join(F.broadcast(hot_tags), "token", "left")
              .withColumn("_key", F.when(F.col("_hot").isNull(), F.col("token")).otherwise(spread)))
    return (marked.join(model.select(F.col("token").alias("_key"), F.col("tag").alias("_cold")), "_key", "left")
            .withColumn("pred", F.coalesce("_hot", "_cold", F.lit(default)))
            .drop("_key", "_hot", "_cold"))


def tag_rows(sentences: DataFrame, model: DataFrame, default: str = vocab.OUTSIDE) -> DataFrame:
    """Add ``pred`` arrays to sentence rows (``tokens``) by looking tokens up in ``model``.

    Entries of the model that say ``default`` are not needed, so the distinct tokens of a sentence meet only the
    others; what is found, a few tokens of a sentence, goes back to it as a map.  Sentences must fit a row.
    """
    known = model.where(F.col("tag") != default).select("token", "tag")
    wanted = sentences.select(*_KEYS, F.explode(F.array_distinct("tokens")).alias("token"))
    found = (wanted.join(known, "token").groupBy(*_KEYS)
             .agg(F.map_from_entries(F.collect_list(F.struct("token", "tag"))).alias("_found")))
    pred = F.transform("tokens", lambda w: F.coalesce(F.try_element_at("_found", w), F.lit(default)))
    return sentences.join(found, list(_KEYS), "left").withColumn("pred", pred).drop("_found")
