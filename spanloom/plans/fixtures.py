"""Deterministic notes, spans and tags derived from the ``documents`` table.

Integer arithmetic on document id and token position only, so any engine gives
the same rows.  All of it happens inside the document row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.arrays import explode_at
from spanloom.functions.batches import before, codes_of, lists, sizes_of, word_places, words_of
from spanloom.functions.text import words, words_with_offsets
from spanloom.sources.listing import write_files
from spanloom.sources.readers import SPAN_FILE

SENTENCE_TOKENS = 50

# Concepts the spans cycle through: the vocabulary, then numbers and unmapped names.
CONCEPTS = (*vocab.CONCEPT_LABELS, "500", "12.5", "1e3", "Substance A", "Substance B")

# Classes of the generated gold tags by ``k``; larger ``k`` means outside.
_CLASS_BY_K = ("MED", "PRO", "UNI", "SUB", "TIM", "DEC", "ROU", "MEAS", "RTIM")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def note_tokens(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, token, begin``."""
    return (explode_at(docs, ["doc_id"], words_with_offsets(F.col("text")), "pos", "_t")
            .select("doc_id", "pos", "_t.token", "_t.begin"))


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, ann_id, begin, end, concept``: spans of 1 to 6 tokens that sometimes overlap."""
    doc, p, ends = F.col("doc_id"), F.col("_p"), F.col("_w.ends")
    n = F.size(ends)
    found = docs.select("doc_id", word_places(F.col("text")).alias("_w"))
    starts = explode_at(found, ["doc_id", "_w"], F.when(n > 0, F.sequence(F.lit(0), n - 1)), "_i", "_p")
    return starts.where((doc * 31 + p * 17) % 23 < 3).select(
        "doc_id", p.cast("bigint").alias("ann_id"), F.get("_w.begins", p).alias("begin"),
        F.get(ends, F.least(p + ((doc + p) % 6).cast("int"), n - 1)).alias("end"),
        F.element_at(vocab.literal_array(CONCEPTS), ((doc * 7 + p) % len(CONCEPTS)).cast("int") + 1).alias("concept"))


def _gold(doc: Column, pos: Column) -> Column:
    k = (doc * 5 + F.floor(pos / 3) * 11) % 20
    outside = (k >= len(_CLASS_BY_K)) | ((pos % 3 == 2) & (F.floor(pos / 6) % 2 == 0))
    name = F.get(vocab.literal_array(_CLASS_BY_K), k.cast("int"))
    return F.when(outside, vocab.OUTSIDE).otherwise(
        F.concat(F.when(pos % 3 == 0, F.lit("B-")).otherwise(F.lit("I-")), name))


def _pred(doc: Column, pos: Column, gold: Column, variant: int) -> Column:
    error = (doc * 13 + pos * (5 + variant)) % 17
    return (F.when(error == 0, vocab.OUTSIDE).when(error == 1, "B-SUB")
            .when((error == 2) & (gold != vocab.OUTSIDE), F.concat(F.lit("I-"), F.substr(gold, F.lit(3))))
            .when(error == 3, "B-TIM").otherwise(gold))


def tagged_tokens(docs: DataFrame, variant: int = 0) -> DataFrame:
    """The rows of ``tagged`` as ``doc_id, sent_id, tok_idx, token, true, pred``."""
    doc, pos = F.col("doc_id"), F.col("_pos")
    return (explode_at(docs, ["doc_id"], words(F.col("text")), "_pos", "token")
            .withColumn("true", _gold(doc, pos))
            .select("doc_id", F.floor(pos / SENTENCE_TOKENS).cast("int").alias("sent_id"),
                    (pos % SENTENCE_TOKENS).alias("tok_idx"), "token", "true",
                    _pred(doc, pos, F.col("true"), variant).alias("pred")))


def _tags_of(docs: pa.Array, first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document ids, whether they are missing, and places in the document of all tokens of some sentences."""
    doc = np.repeat(docs.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False), sizes)
    missing = np.repeat(docs.is_null().to_numpy(zero_copy_only=False), sizes)
    at = before(sizes)
    return doc, missing, np.repeat(first, sizes) + np.arange(at[-1]) - np.repeat(at[:-1], sizes)


def _gold_arrays(docs: pa.Array, first: pa.Array, n: pa.Array) -> pa.Array:
    """``_gold`` for the tokens of sentences of ``n`` tokens that begin at place ``first``."""
    sizes = n.to_numpy(zero_copy_only=False).astype(np.int64)
    doc, missing, pos = _tags_of(docs, first.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    k = np.fmod(doc * 5 + pos // 3 * 11, 20)
    outside = ((pos % 3 == 2) & (pos // 6 % 2 == 0)) | (~missing & (k >= len(_CLASS_BY_K)))
    kind = np.where(outside, 0, 1 + 2 * k + (pos % 3 > 0))
    unknown = ~outside & (missing | (k < 0))
    names = pa.array([vocab.OUTSIDE, *(f"{p}-{x}" for x in _CLASS_BY_K for p in "BI")])
    return lists(before(sizes), names.take(pa.array(kind, mask=unknown)))


def _pred_arrays(docs: pa.Array, first: pa.Array, gold: pa.Array, variant: int) -> pa.Array:
    """``_pred`` for the ``gold`` tags of sentences that begin at place ``first``."""
    sizes = sizes_of(gold)
    doc, missing, pos = _tags_of(docs, first.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
    error = np.where(missing, -1, np.fmod(doc * 13 + pos * (5 + variant), 17))
    code, names = codes_of(gold.flatten())
    n = len(names)
    outside = np.array([*[x == vocab.OUTSIDE for x in names], True])[code]
    kind = np.where(code < 0, 2 * n + 2, code)
    kind[(error == 2) & ~outside] += n
    kind[error == 0], kind[error == 1], kind[error == 3] = 2 * n + 1, 2 * n, 2 * n + 3
    tags = pa.array([*names, *(f"I-{x[2:]}" for x in names), "B-SUB", vocab.OUTSIDE, None, "B-TIM"], pa.string())
    return lists(before(sizes), tags.take(pa.array(kind)), gold.is_null())


def predicted(gold: Column, variant: int) -> Column:
    """Predicted tags of a model variant for the ``gold`` tags of a sentence row."""
    def run(docs: pa.Array, sent: pa.Array, tags: pa.Array) -> pa.Array:
        return _pred_arrays(docs, pa.compute.multiply(sent, SENTENCE_TOKENS), tags, variant)

    return F.arrow_udf(run, "array<string>")("doc_id", "sent_id", gold)


def tagged(docs: DataFrame, variant: int = 0) -> DataFrame:
    """``doc_id, sent_id, tokens, gold, pred``: sentences of 50 tokens with tags from a formula."""
    n = F.size("_tokens")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(SENTENCE_TOKENS))).otherwise(
        F.array().cast("array<int>"))
    split = docs.select("doc_id", words_of(F.col("text")).alias("_tokens"))
    sentences = (explode_at(split, ["doc_id", "_tokens"], starts, "sent_id", "_start")
                 .select("doc_id", "sent_id", "_start",
                         F.slice("_tokens", F.col("_start") + 1, F.lit(SENTENCE_TOKENS)).alias("tokens")))
    gold = F.arrow_udf(_gold_arrays, "array<string>")("doc_id", "_start", F.size("tokens"))
    return (sentences.withColumn("gold", gold).withColumn("pred", predicted(F.col("gold"), variant))
            .select("doc_id", "sent_id", "tokens", "gold", "pred"))


def write_notes(docs: DataFrame, path: str) -> None:
    """One folder ``n<doc_id>`` per note with its text in one file."""
    write_files(docs.select(F.concat(F.lit("n"), "doc_id", F.lit("/note.txt")).alias("below"), F.col("text").alias("content")), path)


def write_spans(rows: DataFrame, path: str) -> None:
    """One folder ``n<doc_id>`` per note with its annotations as XML elements in one file."""
    concept = F.col("concept")
    for sign, escaped in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        concept = F.replace(concept, F.lit(sign), F.lit(escaped))
    element = F.format_string('<custom:CustomMCN xmi:id="%s" begin="%s" end="%s" Concept="%s"/>', "ann_id", "begin", "end", concept)
    whole = F.concat(F.lit('<xmi:XMI xmlns:xmi="http://www.omg.org/XMI" xmlns:custom="http:///webanno/custom.ecore">'),
                     F.array_join(F.collect_list(element), "\n"), F.lit("</xmi:XMI>"))
    write_files(rows.groupBy("doc_id").agg(whole.alias("content")).select(
        F.concat(F.lit("n"), "doc_id", F.lit(f"/{SPAN_FILE}")).alias("below"), "content"), path)


def wide_notes(docs: DataFrame) -> DataFrame:
    """The notes with a character beyond the basic plane in place of every e."""
    return docs.withColumn("text", F.translate("text", "e", "\U0001F600"))


def utf16_spans(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """``doc_id, ann_id, begin, end`` with offsets in UTF-16 units, counted once for all spans of a text."""
    def units(texts: pa.Array, offsets: pa.Array) -> pa.Array:
        found = []
        for text, at in zip(texts, offsets):
            points = np.frombuffer(text.as_py().encode("utf-32-le"), "<u4")
            upto = np.concatenate([[0], np.cumsum(1 + (points > 0xFFFF))])
            found.append(upto[np.clip(at.values.to_numpy(), 0, len(points))])
        return pa.array(found, pa.list_(pa.int32()))

    counted = F.arrow_udf(units, "array<int>")
    texts = rows.groupBy("doc_id").agg(F.collect_list(F.struct("ann_id", "begin", "end")).alias("_s")).join(docs, "doc_id")
    placed = texts.select("doc_id", "_s", *[counted(F.col("text"), F.col(f"_s.{c}")).alias(c) for c in ("begin", "end")])
    at = F.col("_at")
    return explode_at(placed, ["doc_id", "begin", "end"], "_s", "_at", "_x").select(
        "doc_id", "_x.ann_id", F.get("begin", at).alias("begin"), F.get("end", at).alias("end"))
