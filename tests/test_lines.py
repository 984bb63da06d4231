"""Spans to lines, de-duplication, windows, ordering: rules checked against plain loops."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from spanloom import vocab
from spanloom.functions.text import is_number, last_bracketed, plain_spaces, words, words_with_offsets
from spanloom.operators import bio, lines, profile, split
from spanloom.plans.corpus import prepared_lines, prepared_lines_unbounded, prepared_sentences

LABELS = ["SUB", "TIM", "DEC"]
WORDS = ["a", "bb", "ยาน้ำ", "x😀y", "mg", "O"]
GAPS = [" ", "  ", "\n", " ", "\x1d", " "]


def _corpus(seed, docs, spans_per_doc):
    rnd = random.Random(seed)
    notes, spans = [], []
    for d in range(docs):
        text = "".join(rnd.choice(GAPS + [""]) + rnd.choice(WORDS) for _ in range(rnd.randint(0, 400)))
        text = text if d else ""
        notes.append((d, text))
        for a in range(rnd.randint(0, spans_per_doc) if d % 4 else 0):
            b = rnd.randint(0, len(text))
            spans.append((d, a, b, min(len(text) + 3, b + rnd.choice([0, 1, 3, 9, 40])), rnd.choice(LABELS)))
    return notes, spans


def _expected_lines(text, spans):
    out, at = [], 0
    for begin, end, _, label in sorted(spans):
        out += [(w, "O") for w in text[at:begin].split()]
        out += [(w, ("B-" if i == 0 else "I-") + label) for i, w in enumerate(text[begin:end].split())]
        at = end
    return out + [(w, "O") for w in text[at:].split()]


def _expected_dedupe(rows, n):
    out = []
    for i, (token, tag) in enumerate(rows):
        buffer = rows[max(0, i - n):i]
        hit = any(s % 4 in (0, 3) and token == w and t != "O" for s, (w, t) in enumerate(buffer))
        if not (hit and tag != "O"):
            out.append((token, tag))
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    notes, spans = _corpus(7, 40, 30)
    return (notes, spans, spark.createDataFrame(notes, "doc_id bigint, text string"),
            spark.createDataFrame(spans, "doc_id bigint, ann_id bigint, begin int, end int, label string"))


def _by_doc(df):
    frame = df.toPandas().sort_values(["doc_id", "line_no"])
    assert all(g["line_no"].tolist() == list(range(1, len(g) + 1)) for _, g in frame.groupby("doc_id"))
    return {d: list(zip(g["token"], g["tag"])) for d, g in frame.groupby("doc_id")}


def _expected(corpus, *passes):
    notes, spans = corpus[:2]
    out = {}
    for d, text in notes:
        rows = _expected_lines(text, [s[2:4] + (s[1], s[4]) for s in spans if s[0] == d])
        for n in passes:
            rows = _expected_dedupe(rows, n)
        if rows:
            out[d] = rows
    return out


def test_lines_match_the_loop(corpus):
    assert _by_doc(bio.bio_lines(corpus[2], corpus[3])) == _expected(corpus)


def test_ungathered_notes_give_the_same_lines(corpus):
    annotated = corpus[2].join(corpus[3], "doc_id", "left_semi")
    expected = _expected(corpus)
    with_spans = {r.doc_id for r in annotated.collect()}
    assert _by_doc(bio.bio_lines_unbounded(corpus[2], corpus[3])) == {d: x for d, x in expected.items() if d in with_spans}


@pytest.mark.parametrize("annotated_only", [True, False])
@pytest.mark.parametrize("chars,spans", [(0, 0), (40, 3), (1 << 20, 1 << 16)])
def test_only_large_notes_are_cut_up(corpus, chars, spans, annotated_only):
    """All, some and no notes in pieces: the same lines, and without a window over spans when no note is large."""
    kept = {r.doc_id for r in corpus[3].collect()} if annotated_only else {d for d, _ in corpus[0]}
    rows = bio.bio_lines_unbounded(corpus[2], corpus[3], annotated_only, chars, spans)
    assert _by_doc(rows) == {d: x for d, x in _expected(corpus).items() if d in kept}
    if spans > 3:
        rows.collect()
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


@pytest.mark.parametrize("chars", [1, 7, 64])
def test_notes_in_pieces_give_the_same_lines(corpus, chars):
    pieces = bio.note_pieces(corpus[2], chars)
    assert _by_doc(bio.bio_lines_pieces(pieces, corpus[3], chars)) == _expected(corpus)
    whole = {r.doc_id: r.t for r in pieces.groupBy("doc_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("begin", "text"))), lambda x: x["text"]), "").alias("t")).collect()}
    assert whole == {d: t for d, t in corpus[0] if t}


@pytest.mark.parametrize("chunk", [1, 2, 1 << 16])
def test_lines_are_numbered_over_chunks_of_spans(corpus, monkeypatch, chunk):
    """Words are found in batches, and numbered by chunks of a few spans as by one chunk."""
    monkeypatch.setattr(bio, "CHUNK_LINES", chunk)
    rows = bio.bio_lines_pieces(bio.note_pieces(corpus[2], 7), corpus[3], 7)
    assert "\\S+" not in rows._jdf.queryExecution().executedPlan().toString()
    assert _by_doc(rows) == _expected(corpus)


def test_only_pieces_stand_beside_spans(spark):
    """No row of the way from a long note to its lines holds more text than a piece."""
    note = " ".join(f"w{i}" for i in range(9000))
    notes = spark.createDataFrame([(1, note)], "doc_id bigint, text string")
    pieces = bio.note_pieces(notes)
    assert pieces.count() > 10 and pieces.agg(F.max(F.length("text"))).first()[0] <= bio.PIECE_CHARS + 5
    spans = spark.createDataFrame([(1, i, 0, len(note) - i, "SUB") for i in range(3)],
                                  "doc_id bigint, ann_id bigint, begin int, end int, label string")
    rows = [(s[2], s[3], s[1], s[4]) for s in map(tuple, spans.collect())]
    assert _by_doc(bio.bio_lines_pieces(pieces, spans)) == {1: _expected_lines(note, rows)}


def test_spans_without_offsets_place_no_text(spark):
    notes = spark.createDataFrame([(1, "aa bb cc")], "doc_id bigint, text string")
    spans = spark.createDataFrame([(1, 0, 0, 2, "SUB"), (1, 1, 2, None, "TIM"), (1, 2, None, 4, "TIM")],
                                  "doc_id bigint, ann_id bigint, begin int, end int, label string")
    want = [("aa", "B-SUB"), ("bb", "O"), ("cc", "O")]
    assert _by_doc(bio.bio_lines(notes, spans)) == {1: want}
    assert _by_doc(bio.bio_lines_unbounded(notes, spans)) == {1: want}
    assert bio.broken_spans(spans).count() == 2


@pytest.mark.parametrize("passes", [(5,), (4,), (5, 4), (8,)])
def test_dedupe_in_the_row(corpus, passes):
    docs = lines.dedupe_docs(bio.bio_docs(corpus[2], corpus[3]), passes)
    assert _by_doc(bio.explode_lines(docs)) == _expected(corpus, *passes)


@pytest.mark.parametrize("passes", [(5, 4), (4,)])
def test_dedupe_flat_over_chunk_borders(corpus, passes):
    flat = bio.bio_lines(corpus[2], corpus[3])
    assert _by_doc(lines.dedupe_lines_chain(flat, passes, chunk=16)) == _expected(corpus, *passes)


def test_prepared_lines_and_sentences_agree(corpus):
    spans = corpus[3].withColumnRenamed("label", "concept")
    usual = _by_doc(prepared_lines(corpus[2], spans))
    flat = _by_doc(prepared_lines_unbounded(corpus[2], spans))
    assert flat == {d: usual[d] for d in flat} and flat
    sentences = prepared_sentences(corpus[2], spans).toPandas()
    for d, g in sentences.sort_values(["doc_id", "sent_id"]).groupby("doc_id"):
        joined = [p for w, t in zip(g["tokens"], g["tags"]) for p in zip(w, t)]
        assert joined == usual[d]
        assert all(len(w) == 50 for w in g["tokens"][:-1])


@pytest.mark.parametrize("size,step", [(50, 50), (50, 20), (10, 30)])
def test_sliding_windows(spark, size, step):
    n = 137
    df = spark.range(1, n + 1).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("line_no"))
    got = {tuple(r) for r in lines.sliding_windows(df, size, step).select("window_id", "line_no").collect()}
    rows = list(range(1, n + 1))
    assert got == {(w, x) for w, start in enumerate(range(0, n, step)) for x in rows[start:start + size]}


def test_numbers_follow_the_float_grammar(spark):
    texts = ["1", "1.5", ".5", "5.", "1e3", "1E+3", " 5 ", " 5", "1_000", "1__0", "_1", "1_", "๑", "1d", "nan",
             "-inf", "+Infinity", "infinit", "", ".", "e5", "1e", "0x10", "1 2", "5\n", "٣.٤", "--1", "1_0.0_1e1_0"]

    def parses(text):
        try:
            float(text)
            return True
        except ValueError:
            return False
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r.t: r.n for r in df.select("t", is_number(F.col("t")).alias("n")).collect()} == {
        t: parses(t) for t in texts}


def test_words_and_offsets_follow_unicode_whitespace(spark):
    text = " a b\x1cยาน้ำ　 x😀y\x85z\n"
    row = spark.createDataFrame([(text,)], "t string").select(
        words(F.col("t")).alias("w"), words_with_offsets(F.col("t")).alias("o"),
        plain_spaces(F.col("t")).alias("p")).first()
    assert row.w == text.split()
    assert all(text[x.begin:x.begin + len(x.token)] == x.token for x in row.o)
    assert [x.token for x in row.o] == text.split() and len(row.p) == len(text)


def test_labels_and_brackets(spark):
    concepts = ["258773002 |Milliliter (qualifier value)|", "nan", "1d", "RTIM", "x", None]
    df = spark.createDataFrame([(c,) for c in concepts], "concept string")
    assert {r.concept: r.label for r in bio.label_spans(df).collect()} == {
        concepts[0]: "MEAS", "nan": "DEC", "1d": "SUB", "RTIM": "RTIM", "x": "SUB"}
    assert bio.null_concepts(df).count() == 1
    terms = df.select(last_bracketed(F.col("concept")).alias("t")).where("t is not null").collect()
    assert terms[0].t == "qualifier value" and terms[1].t == "nan"
    assert len(vocab.CONCEPT_LABELS) == 49 and vocab.concept_list(spark).count() == 48


@pytest.mark.parametrize("n", [0, 1, 9, 90, 5000])
def test_split_sizes_and_determinism(spark, n):
    docs = spark.range(n).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.split for r in split.split_map(docs).collect()}
    sizes = pd.Series(got, dtype=object).value_counts().to_dict()
    train, validation = int(n * 0.11), int(n * 0.78)
    expected = {"TRAIN": train, "VALIDATION": validation, "TEST": n - train - validation}
    assert sizes == {k: v for k, v in expected.items() if v}
    assert got == {r.doc_id: r.split for r in split.split_map(docs.repartition(3)).collect()}


def test_split_ratios_must_sum_to_one(spark):
    with pytest.raises(ValueError):
        split.split_map(spark.range(3).withColumnRenamed("id", "doc_id"), 0.5, 0.4, 0.2)


def test_class_weights(spark):
    df = spark.createDataFrame([("a", "O")] * 6 + [("b", "B-SUB")] * 2, "token string, tag string")
    assert {r.tag: round(r.weight, 6) for r in profile.class_weights(df).collect()} == {
        "O": round(8 / (2 * 6), 6), "B-SUB": 2.0}
