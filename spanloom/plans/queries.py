"""The registered queries: every operator applied to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions import tags as tagfn
from spanloom.functions.arrays import explode_at
from spanloom.functions.text import clean_name, last_bracketed
from spanloom.operators import bio, entity_eval, lines, offsets, predict, profile, split, token_eval
from spanloom.plans import corpus, fixtures, scoring
from spanloom.session import stage, staging_path
from spanloom.sources import packed, readers, roundtrip, sinks, tables
from spanloom.streaming import parts

Query = Callable[[SparkSession, str], DataFrame]

SLIDING_SIZE, SLIDING_STEP = 50, 20


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _report_names(report: DataFrame) -> DataFrame:
    """Rounded scores under lower-case names."""
    report = _rounded(report, *[c for c in report.columns if c not in ("model", "entity_type")])
    return report.withColumnsRenamed({c: c.lower() for c in report.columns})


# --- shared inputs -----------------------------------------------------------

def _corpus(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs = fixtures.notes(spark, sf)
    return docs, fixtures.spans(docs)


def _labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    docs, spans = _corpus(spark, sf)
    return docs, bio.label_spans(spans)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return bio.bio_lines(*_labelled(spark, sf))


def _prepared(spark: SparkSession, sf: str) -> DataFrame:
    return corpus.prepared_lines(*_corpus(spark, sf))


def _tagged(spark: SparkSession, sf: str, variant: int = 0) -> DataFrame:
    return fixtures.tagged(fixtures.notes(spark, sf), variant)


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.tagged_tokens(fixtures.notes(spark, sf))


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    """Token pairs with their place in the corpus, for the by-token scores.

    One number, ids first: the greatest of numbers is found by hashing, that of structs by sorting all rows.
    """
    doc, least = F.col("doc_id").cast("decimal(19,0)"), F.lit(f"-{10 ** 19}").cast("decimal(20,0)")
    place = F.col("sent_id").cast("bigint") * fixtures.SENTENCE_TOKENS + F.col("tok_idx")
    at = F.coalesce(doc, least).cast("decimal(20,0)") * F.lit(10 ** 11).cast("decimal(12,0)") + place.cast("decimal(11,0)")
    return _pairs(spark, sf).withColumn("at", at)


def _tag_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"true": "true_tag", "pred": "pred_tag"})


# --- text and concepts -------------------------------------------------------

def note_tokens(spark, sf):
    return fixtures.note_tokens(fixtures.notes(spark, sf)).withColumnRenamed("begin", "b")


def file_name_clean(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", clean_name(F.col("url")).alias("name"))


def concept_labels(spark, sf):
    return _labelled(spark, sf)[1].select("doc_id", "ann_id", F.col("begin").alias("b"),
                                          F.col("end").alias("e"), "concept", "label")


def bracket_term(spark, sf):
    return _corpus(spark, sf)[1].select("doc_id", "ann_id", last_bracketed(F.col("concept")).alias("term"))


def concept_parents(spark, sf):
    return bio.concept_parents(_corpus(spark, sf)[1]).select("doc_id", "ann_id", "parent")


def span_text(spark, sf):
    return bio.span_texts(*_corpus(spark, sf))


# --- lines -------------------------------------------------------------------

def bio_lines(spark, sf):
    return _lines(spark, sf)


def bio_lines_unbounded(spark, sf):
    return bio.bio_lines_unbounded(*_labelled(spark, sf), annotated_only=False)


def bio_unannotated(spark, sf):
    docs, labelled = _labelled(spark, sf)
    labelled = labelled.where("doc_id % 10 <> 9")  # every tenth note is left without annotations
    bare = docs.join(labelled, "doc_id", "left_anti")
    return bio.explode_lines(bio.bio_docs(bare, labelled.limit(0)))


def dedupe_pass1(spark, sf):
    return corpus.prepared_lines(*_corpus(spark, sf), passes=lines.LOOK_BACK_PASSES[:1])


def dedupe_chain(spark, sf):
    return _prepared(spark, sf)


def windows_fixed(spark, sf):
    return lines.fixed_windows(_prepared(spark, sf))


def windows_sliding(spark, sf):
    return lines.sliding_windows(_prepared(spark, sf), SLIDING_SIZE, SLIDING_STEP)


def blank_collapse(spark, sf):
    docs = fixtures.notes(spark, sf)
    kept = lines.collapse_blank_array(F.split("text", "\n"))
    return explode_at(docs, ["doc_id"], kept, "pos", "line")


def sentences(spark, sf):
    rows = predict.describe_sentences(corpus.prepared_sentences(*_corpus(spark, sf)))
    return rows.select("doc_id", "sent_id", "text", F.array_join("tags", " ").alias("tags"))


# --- profiles ----------------------------------------------------------------

def label_counts(spark, sf):
    return profile.label_counts(_labelled(spark, sf)[1])


def tag_counts(spark, sf):
    return profile.tag_counts(_lines(spark, sf))


def tag_chars(spark, sf):
    return profile.tag_chars(_lines(spark, sf))


def parent_rollup(spark, sf):
    return profile.parent_rollup(bio.concept_parents(_labelled(spark, sf)[1]))


def class_weights(spark, sf):
    return _rounded(profile.class_weights(_lines(spark, sf)), "weight")


def distinct_labels(spark, sf):
    return profile.distinct_values(_labelled(spark, sf)[1], "label")


def concept_usage(spark, sf):
    used = _corpus(spark, sf)[1].groupBy("concept").agg(F.count(F.lit(1)).alias("n"))
    listed = vocab.concept_list(spark).withColumn("n", F.lit(0).cast("bigint"))
    return (used.join(F.broadcast(vocab.concept_list(spark)), "concept", "left_semi")
            .unionByName(listed).groupBy("concept").agg(F.sum("n").alias("n")))


def tag_set_counts(spark, sf):
    counts = profile.tag_counts(_pairs(spark, sf).select(F.col("true").alias("tag")))
    known = vocab.tag_set(spark).withColumn("n", F.lit(0).cast("bigint"))
    listed = counts.where(F.col("tag").isin(*vocab.TAGS)).select(
        "tag", F.lit(None).cast("string").alias("prefix"), F.lit(None).cast("string").alias("class"), "n")
    return known.unionByName(listed).groupBy("tag").agg(
        F.max("prefix").alias("prefix"), F.max("class").alias("class"), F.sum("n").alias("n"))


def first_seen_labels(spark, sf):
    return lines.first_seen(_labelled(spark, sf)[1], "label", "doc_id", "ann_id")


# --- split -------------------------------------------------------------------

def split_map(spark, sf):
    return split.split_map(fixtures.notes(spark, sf))


def split_counts(spark, sf):
    docs, spans = _corpus(spark, sf)
    per_doc = corpus.prepared_lines(docs, spans).groupBy("doc_id", "tag").agg(F.count(F.lit(1)).alias("n"),
                                                F.sum(F.length("token")).alias("n_chars"))
    return (split.assign_split(per_doc, split.split_map(docs)).groupBy("split", "tag")
            .agg(F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars")))


# --- tags --------------------------------------------------------------------

def tag_rename(spark, sf):
    return _pairs(spark, sf).select("doc_id", "sent_id", "tok_idx",
                                    tagfn.display_gold(F.col("true")).alias("true_tag"),
                                    tagfn.display_pred(F.col("pred")).alias("pred_tag"))


def _stripped(spark, sf, mode):
    return _tag_names(token_eval.strip_pairs(_pairs(spark, sf), mode)).drop("token")


def tag_strip_listed(spark, sf):
    return _stripped(spark, sf, "listed")


def tag_strip_all(spark, sf):
    return _stripped(spark, sf, "all")


# --- predictions -------------------------------------------------------------

def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    nested = F.zip_with("tokens", "pred", lambda w, t: F.create_map(w, t))
    return _tagged(spark, sf).select("doc_id", "sent_id", nested.alias("prediction"))


def flatten_predictions(spark, sf):
    return predict.flatten_predictions(_predictions(spark, sf)).withColumnRenamed("pred", "pred_tag")


def flatten_gold(spark, sf):
    rows = _tagged(spark, sf).select("doc_id", "sent_id", "tokens", F.col("gold").alias("tags"))
    return predict.flatten_gold(rows).withColumnRenamed("true", "true_tag")


def _digit_tagger():
    def tag(sentences: list[list[str]]) -> list[list[str]]:
        return [["B-DEC" if w.isascii() and w.isdigit() else "O" for w in tokens] for tokens in sentences]
    return tag


def user_tagger(spark, sf):
    return (predict.flatten_predictions(predict.tag_sentences(_tagged(spark, sf), _digit_tagger))
            .withColumnRenamed("pred", "pred_tag"))


def mft_tagger(spark, sf):
    rows = _tagged(spark, sf).select("doc_id", "sent_id", "tokens", F.col("gold").alias("tags"))
    tagged = predict.tag_rows(rows, predict.learn_frequent_tags(predict.explode_sentences(rows)))
    at = F.col("tok_idx")
    return explode_at(tagged, ["doc_id", "sent_id", "tags", "pred"], "tokens", "tok_idx", "token").select(
        "doc_id", "sent_id", "tok_idx", "token", F.get("tags", at).alias("true_tag"), F.get("pred", at).alias("pred_tag"))


def _model_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of (gold, predicted) per model, the one pass over the data."""
    rows = _model_rows(spark, sf)
    return token_eval.pair_counts(token_eval.pairs_in_rows(rows, "model"), "model")


def _model_rows(spark: SparkSession, sf: str) -> DataFrame:
    """``model, doc_id, sent_id, tokens, gold, pred`` of three taggers."""
    variants = F.array(*[F.struct(F.lit(f"model{v + 1}").alias("model"),
                                  fixtures.predicted(F.col("gold"), v).alias("pred")) for v in range(3)])
    return _tagged(spark, sf).select("doc_id", "sent_id", "tokens", "gold", F.inline(variants))


def model_entity_scores(spark, sf):
    return _report_names(scoring.entity_report(_model_rows(spark, sf), by=("model",)))


def model_span_scores(spark, sf):
    scores = entity_eval.span_scores(entity_eval.graded_entities(_model_rows(spark, sf), ("model",)), ("model",))
    return _rounded(scores, "precision", "recall", "f1")


def model_class_scores(spark, sf):
    return _rounded(token_eval.class_scores(_model_counts(spark, sf), vocab.SCORED_TAGS, by=("model",)),
                    "precision", "recall", "f1")


def model_confusion(spark, sf):
    return _tag_names(_model_counts(spark, sf))


def model_compare(spark, sf):
    scores = token_eval.class_scores(_model_counts(spark, sf), by=("model",))
    return _rounded(token_eval.average_scores(scores, by=("model",)), "precision", "recall", "f1")


# --- token scores ------------------------------------------------------------

def pairs_by_token(spark, sf):
    return _tag_names(token_eval.last_pairs(_placed(spark, sf)))


def pairs_by_token_no_outside(spark, sf):
    return _tag_names(token_eval.last_pairs(_placed(spark, sf), outside=False))


def pair_counts_by_token(spark, sf):
    return _tag_names(token_eval.pair_counts_in_rows(_pairs(spark, sf)))


def pairs_by_position(spark, sf):
    rows = _pairs(spark, sf)
    return _tag_names(token_eval.pairs_by_position(rows.drop("pred"), rows.drop("true")))


def _counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_eval.pair_counts(_pairs(spark, sf))


def _class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return token_eval.pair_counts(token_eval.strip_pairs(_pairs(spark, sf)))


def confusion(spark, sf):
    return _tag_names(token_eval.confusion(_counts(spark, sf), vocab.SCORED_TAGS))


def confusion_classes(spark, sf):
    return _tag_names(token_eval.confusion(_class_counts(spark, sf), vocab.SCORED_CLASSES))


def confusion_wide(spark, sf):
    wide = token_eval.confusion_wide(_class_counts(spark, sf), vocab.SCORED_CLASSES)
    return wide.withColumnRenamed("true", "true_tag")


def prf_by_class(spark, sf):
    return _rounded(token_eval.class_scores(_counts(spark, sf), vocab.SCORED_TAGS),
                    "precision", "recall", "f1")


def prf_no_bio(spark, sf):
    return _rounded(token_eval.class_scores(_class_counts(spark, sf), vocab.SCORED_CLASSES),
                    "precision", "recall", "f1")


def _averages(counts: DataFrame) -> DataFrame:
    return _rounded(token_eval.average_scores(token_eval.class_scores(counts)),
                    "precision", "recall", "f1")


def prf_averages(spark, sf):
    return _averages(_counts(spark, sf))


def prf_averages_no_bio(spark, sf):
    return _averages(_class_counts(spark, sf))


def prf_by_token(spark, sf):
    return _averages(token_eval.pair_counts(token_eval.last_pairs(_placed(spark, sf))))


def prf_wide(spark, sf):
    scores = token_eval.class_scores(_class_counts(spark, sf), vocab.SCORED_CLASSES)
    return _rounded(token_eval.scores_wide(scores, vocab.SCORED_CLASSES), *vocab.SCORED_CLASSES)


# --- entity scores -----------------------------------------------------------

def _runs(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    merged = entity_eval.merge_runs(F.col("gold"), F.col("tokens"), mode)
    return entity_eval.explode_runs(_tagged(spark, sf).select("doc_id", "sent_id", merged.alias("runs")))


def entity_runs(spark, sf):
    return _runs(spark, sf, "suffix")


def entity_runs_bio(spark, sf):
    return _runs(spark, sf, "bio")


def _runs_unbounded(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    rows = _pairs(spark, sf).select("doc_id", "sent_id", F.col("tok_idx").alias("pos"),
                                    F.col("true").alias("entity_type"), F.col("token").alias("surface_string"))
    return entity_eval.merge_runs_flat(rows, mode)


def entity_runs_unbounded(spark, sf):
    return _runs_unbounded(spark, sf, "suffix")


def entity_runs_bio_unbounded(spark, sf):
    return _runs_unbounded(spark, sf, "bio")


def _aligned(spark: SparkSession, sf: str) -> DataFrame:
    return entity_eval.aligned_pairs(scoring.entity_rows(_tagged(spark, sf)))


def aligned_pairs(spark, sf):
    return _aligned(spark, sf)


def _graded(spark: SparkSession, sf: str) -> DataFrame:
    return entity_eval.graded_pairs(_aligned(spark, sf))


def _grade_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({m: f"{m}_grade" for m in vocab.MODES})


def graded_pairs(spark, sf):
    return _grade_names(_graded(spark, sf)).select("doc_id", "sent_id", "pos",
                                                   *[f"{m}_grade" for m in vocab.MODES])


def graded_preview(spark, sf):
    return _grade_names(_graded(spark, sf)).orderBy("doc_id", "sent_id", "pos").limit(20)


def grade_counts(spark, sf):
    return _mode_names(entity_eval.grade_counts(_graded(spark, sf)))


def grade_counts_spurious(spark, sf):
    return _mode_names(entity_eval.grade_counts(_graded(spark, sf), count_spurious=True,
                                                include_outside=False))


def _mode_names(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"Measure": "measure",
                                  **{m.capitalize(): f"n_{m}" for m in vocab.MODES}})


def entity_metrics(spark, sf):
    return _report_names(scoring.entity_report(_tagged(spark, sf)))


def entity_metrics_bio(spark, sf):
    return _report_names(scoring.entity_report(_tagged(spark, sf), mode="bio"))


def mode_metrics(spark, sf):
    return _rounded(entity_eval.mode_metrics(entity_eval.grade_counts(_graded(spark, sf)))
                    .withColumnRenamed("mode", "grading"), "precision", "recall", "f1")


def bio_spans(spark, sf):
    return (entity_eval.bio_spans(_tagged(spark, sf), "gold")
            .withColumnsRenamed({"start": "first_tok", "end": "end_tok"}))


def _graded_entities(spark: SparkSession, sf: str) -> DataFrame:
    return entity_eval.graded_entities(_tagged(spark, sf))


def span_prf(spark, sf):
    return _rounded(entity_eval.span_scores(_graded_entities(spark, sf)), "precision", "recall", "f1")


def muc_by_sentence(spark, sf):
    counts = entity_eval.muc_by_sentence(_tagged(spark, sf))
    return counts.select("doc_id", "sent_id", F.col("mode").alias("grading"),
                         *[F.col(g).cast("int").alias(g.lower()) for g in vocab.GRADES])


def muc_scores(spark, sf):
    scores = entity_eval.muc_scores(_graded_entities(spark, sf))
    return _rounded(scores.withColumnRenamed("mode", "grading")
                    .withColumnsRenamed({g: g.lower() for g in vocab.GRADES}),
                    "precision", "recall", "f1")


def tagger_report(spark, sf):
    return _report_names(scoring.tagger_report(*_corpus(spark, sf)))


# --- files -------------------------------------------------------------------

def io_roundtrip(spark, sf):
    return roundtrip.check(spark, *_corpus(spark, sf))


def file_entities(spark, sf):
    """Sentences written as JSON lines of (tag, token) pairs and read back."""
    rows = corpus.prepared_sentences(*_corpus(spark, sf))
    path = staging_path(spark, "entities")
    sinks.write_entity_lines(rows.select("doc_id", "sent_id", entity_eval.as_entities(
        F.col("tokens"), F.col("tags")).alias("entities")), path)
    read = readers.read_entity_lines(spark, path, "bigint")
    return (explode_at(read, ["doc_id", "sent_id"], "entities", "pos", "_x")
            .select("doc_id", "sent_id", "pos", F.col("_x.entity_type").alias("tag"),
                    F.col("_x.surface_string").alias("token")))


def _sentence_files(spark: SparkSession, sf: str) -> str:
    docs, spans = _corpus(spark, sf)
    path = staging_path(spark, "sentences")
    sinks.write_split_sentences(corpus.split_sentences(docs, spans, *split.SPLITS), path)
    return path


def file_sentences(spark, sf):
    """Counts of lines from the split files, read back sentence by sentence."""
    rows = readers.read_sentences(spark, _sentence_files(spark, sf))
    name = F.regexp_extract("doc_id", "split=([A-Z]+)/", 1)
    return (explode_at(rows.select(name.alias("split"), "tokens", "tags"), ["split", "tags"], "tokens", "pos", "token")
            .groupBy("split", "token", F.get("tags", F.col("pos")).alias("tag")).agg(F.count(F.lit(1)).alias("n")))


def file_tag_counts(spark, sf):
    """Tag counts from the strictly parsed lines of the split files; lines that don't parse have no tag."""
    parsed = readers.parse_strict(spark.read.option("recursiveFileLookup", "true").text(_sentence_files(spark, sf)))
    return parsed.groupBy("ok", "tag").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("token")).alias("n_chars"))


def strict_parse(spark, sf):
    """Every line of the notes, parsed strictly; ``ok`` false is the quarantine."""
    notes = fixtures.notes(spark, sf)
    lines_ = explode_at(notes, ["doc_id"], F.split("text", "\n"), "pos", "value")
    return readers.parse_strict(lines_).groupBy("ok").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.length("token"), F.lit(0))).alias("n_chars"))


def file_tables(spark, sf):
    """Tag counts written as CSV and TSV with header and read back."""
    counts, sides = stage(profile.tag_counts(_lines(spark, sf)), "counts"), []
    for kind, separator in (("csv", ","), ("tsv", "\t")):
        path = staging_path(spark, f"counts-{kind}")
        sinks.write_table(counts, path, separator)
        sides.append(spark.read.schema("tag string, n bigint").option("header", "true").option("sep", separator).csv(path)
                     .withColumn("kind", F.lit(kind)))
    return sides[0].unionByName(sides[1])


def _note_files(spark: SparkSession, sf: str) -> str:
    path = staging_path(spark, "notes")
    fixtures.write_notes(fixtures.notes(spark, sf), path)
    return path


def file_folders(spark, sf):
    """The document folders of the notes written as files."""
    return readers.list_folders(spark, _note_files(spark, sf)).select("folder", "depth")


def file_sizes(spark, sf):
    """Number and bytes of the text files of every document folder."""
    files = readers.list_files(spark, _note_files(spark, sf), recursive=True)
    return files.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("n_bytes"))


def file_notes(spark, sf):
    """The notes written as files and read back."""
    return readers.read_notes(spark, _note_files(spark, sf)).select(
        F.substring("doc_id", 2, 40).cast("bigint").alias("doc_id"), "text")


def file_spans(spark, sf):
    """The annotations written as XML and read back."""
    path = staging_path(spark, "annotations")
    fixtures.write_spans(_corpus(spark, sf)[1], path)
    return readers.read_spans(spark, path).select(
        F.substring("doc_id", 2, 40).cast("bigint").alias("doc_id"), "ann_id", F.col("begin").alias("b"),
        F.col("end").alias("e"), "concept")


def utf16_spans(spark, sf):
    """Offsets counted in UTF-16 units, on notes with characters beyond the basic plane, back to characters."""
    docs, spans = _corpus(spark, sf)
    wide = fixtures.wide_notes(docs)
    return offsets.from_utf16(fixtures.utf16_spans(spans, wide), wide).select("doc_id", "ann_id", F.col("begin").alias("b"), F.col("end").alias("e"))


def packed_lines(spark, sf):
    """The lines of the cleaned documents, written packed with an index by document and read back."""
    path = staging_path(spark, "packed")
    sinks.write_packed_docs(corpus.prepared_docs(*_corpus(spark, sf)), path)
    raw = packed.read_packed(spark, path, "bigint").select("doc_id", lines.parse_raw_array(F.split("text", "\n")).alias("_x"))
    return bio.explode_lines(raw.select("doc_id", F.col("_x.token").alias("tokens"), F.col("_x.tag").alias("tags")))


def _entity_tables(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Gold and predicted sentences with ``entities``."""
    tagged = _tagged(spark, sf)
    return [tagged.select("doc_id", "sent_id", entity_eval.as_entities(F.col("tokens"), F.col(c)).alias("entities"))
            for c in ("gold", "pred")]


def join_sentences(spark, sf):
    """Entity scores from a gold and a predicted table in buckets: the join moves nothing."""
    sides = [tables.write_bucketed(side, tables.fresh_name(name)) for side, name in zip(_entity_tables(spark, sf), ("gold", "pred"))]
    return _report_names(scoring.table_entity_report(*sides))


def json_entity_report(spark, sf):
    """Entity scores from a gold and a predicted folder of nested JSON files, each read in blocks."""
    paths = []
    for side, name in zip(_entity_tables(spark, sf), ("gold", "pred")):
        paths.append(staging_path(spark, f"json-{name}"))
        sinks.write_entity_json(side, paths[-1])
    return _report_names(scoring.json_entity_report(spark, *paths, key="folder"))


def conll_token_report(spark, sf):
    """Token scores of a tagger on the split files."""
    scores, _ = scoring.conll_report(spark, _sentence_files(spark, sf), _digit_tagger)
    return _rounded(scores, "precision", "recall", "f1")


def conll_span_report(spark, sf):
    """Span scores of a tagger on the split files."""
    _, scores = scoring.conll_report(spark, _sentence_files(spark, sf), _digit_tagger)
    return _rounded(scores, "precision", "recall", "f1")


PART_LINES = 400


def streamed_lines(spark, sf):
    """De-duplicated lines of documents that arrive in parts, as a stream with state per document."""
    docs = bio.bio_docs(*_labelled(spark, sf))
    cuts = F.sequence(F.lit(0), F.greatest(F.size("tokens") - 1, F.lit(0)), F.lit(PART_LINES))
    arriving = explode_at(docs, ["doc_id", "tokens", "tags"], cuts, "part", "_at").select(
        F.col("doc_id").cast("string").alias("doc_id"), "part",
        *[F.slice(c, F.col("_at") + 1, F.lit(PART_LINES)).alias(c) for c in ("tokens", "tags")])
    source, target, state = (staging_path(spark, n) for n in ("parts", "cleaned", "state"))
    arriving.write.parquet(source)
    stream = spark.readStream.schema(arriving.schema).option("maxFilesPerTrigger", 8).parquet(source)
    (parts.dedupe_parts(stream).writeStream.format("parquet").option("checkpointLocation", state)
     .trigger(availableNow=True).start(target).awaitTermination())
    return (spark.read.schema(parts.OUTPUT).parquet(target)
            .select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("line_no").cast("int").alias("line_no"), "token", "tag"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    note_tokens, file_name_clean, concept_labels, bracket_term, concept_parents, span_text,
    bio_lines, bio_lines_unbounded, bio_unannotated, dedupe_pass1, dedupe_chain, windows_fixed, windows_sliding,
    blank_collapse, sentences, label_counts, tag_counts, tag_chars, parent_rollup, class_weights,
    distinct_labels, concept_usage, tag_set_counts, first_seen_labels, split_map, split_counts,
    tag_rename, tag_strip_listed, tag_strip_all, flatten_predictions, flatten_gold, user_tagger,
    mft_tagger, model_compare, model_class_scores, model_confusion, model_entity_scores, model_span_scores,
    pairs_by_token, pairs_by_token_no_outside, pair_counts_by_token,
    pairs_by_position, confusion, confusion_classes, confusion_wide, prf_by_class, prf_no_bio,
    prf_averages, prf_averages_no_bio, prf_by_token, prf_wide, entity_runs, entity_runs_bio,
    entity_runs_unbounded, entity_runs_bio_unbounded,
    aligned_pairs, graded_pairs, graded_preview, grade_counts, grade_counts_spurious,
    entity_metrics, entity_metrics_bio, mode_metrics, bio_spans, span_prf, muc_by_sentence, muc_scores, tagger_report,
    io_roundtrip, file_entities, file_sentences, file_tag_counts, strict_parse, file_tables,
    file_folders, file_sizes, file_notes, file_spans, utf16_spans, packed_lines, join_sentences, json_entity_report,
    conll_token_report, conll_span_report, streamed_lines,
)}
