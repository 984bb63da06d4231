"""Functions on Arrow batches against plain loops, in stretches of any length."""

import random
import re

import pyarrow as pa
import pytest

from spanloom import vocab
from spanloom.functions import batches
from spanloom.operators import offsets
from spanloom.plans import corpus, fixtures, queries

WORDS = ["a", "bb", "ยาน้ำ", "x😀y", "mg", "O", "é"]
GAPS = [" ", "  ", "\n", " ", "\x1d", " ", "　", "\t"]


def _texts(seed):
    rnd = random.Random(seed)
    texts = ["".join(rnd.choice(GAPS + [""]) + rnd.choice(WORDS) for _ in range(rnd.randint(0, 60))) for _ in range(40)]
    return [*texts, "", None, " ", " ", "é", None, *texts[:3]]


@pytest.mark.parametrize("stretch", [1, 50, 1 << 20])
def test_word_places(monkeypatch, stretch):
    monkeypatch.setattr(batches, "STRETCH", stretch)
    texts = _texts(stretch)
    for slice_of in (slice(None), slice(3, None)):
        array = pa.array(texts, pa.string())[slice_of]
        got = batches._word_places(array).to_pylist()
        for text, row in zip(array.to_pylist(), got):
            if text is None:
                assert row == {"begins": None, "ends": None}
            else:
                assert [text[b:e] for b, e in zip(row["begins"], row["ends"])] == text.split()


@pytest.mark.parametrize("stretch", [1, 50, 1 << 20])
def test_wide_places(monkeypatch, stretch):
    monkeypatch.setattr(batches, "STRETCH", stretch)
    for text, places in zip(_texts(1), batches.by_stretch(
            batches._wide_places, batches.sizes_of(pa.array(_texts(1))), pa.array(_texts(1))).to_pylist()):
        units = [] if text is None else [len(text[:i].encode("utf-16-le")) // 2 for i, c in enumerate(text) if ord(c) > 0xFFFF]
        assert places == (None if text is None else units)


def test_utf16_offsets_meet_one_index_per_note(spark):
    """Many spans of a note share one row with its index; rows without a note stay as they are."""
    text = "".join(random.Random(5).choice("ab😀 ") for _ in range(3000))
    units = [len(text[:i].encode("utf-16-le")) // 2 for i in range(len(text) + 1)]
    rows = [(1, i, units[i], units[min(i + 7, len(text))]) for i in range(len(text))] + [(None, 1, 4, 5), (None, 2, None, 6), (2, 1, 0, 3)]
    spans = spark.createDataFrame(rows, "doc_id int, ann_id int, begin int, end int")
    assert offsets.by_doc(spans).count() == 4
    got = offsets.from_utf16(spans, spark.createDataFrame([(1, text), (2, "abc")], "doc_id int, text string"))
    want = [(1, i, i, min(i + 7, len(text))) for i in range(len(text))] + rows[-3:]
    assert got.columns == spans.columns and got.schema == spans.schema
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_last_tags_are_found_by_hashing(spark, sf_dir):
    """Token rows are not sorted to find the last tag: their place is a number, and null ids come first."""
    plan = _plan(queries.pairs_by_token(spark, sf_dir))
    assert not re.search(r"SortAggregate\(key=\[token[^\]]*, side", plan)


def test_lines_stay_in_the_batch(spark, sf_dir):
    """One pass through Arrow makes the lines of a note and drops their repeats."""
    plan = _plan(corpus.prepared_docs(*queries._corpus(spark, sf_dir)))
    assert len(re.findall(r"ArrowEvalPython", plan)) == 2  # the places of the words, for the spans, is the other


@pytest.mark.parametrize("stretch", [1, 7, 1 << 20])
def test_merged_runs_of_missing_types(monkeypatch, stretch):
    monkeypatch.setattr(batches, "STRETCH", stretch)
    types = pa.array([["B-TIM", "I-TIM", "O", "B-MEAS", "I-MEAS"], None, [], ["EAS", "B-MEAS", None, "I-PRO"]], pa.list_(pa.string()))
    words = pa.array([["a", "b", "c", "d", None], None, [], ["a", "b", "c", "d"]], pa.list_(pa.string()))
    got = batches.by_stretch(lambda *c: batches._merged(*c, "suffix", "O", vocab.RUN_SUFFIXES), batches.sizes_of(types), types, words)
    assert got.to_pylist() == [
        {"types": ["TIM", None, "O", "EAS", None], "surfaces": ["a b", None, "c", "d", None]},
        {"types": None, "surfaces": None}, {"types": [], "surfaces": []},
        {"types": ["EAS", "EAS", None, None], "surfaces": ["a", "b", None, None]}]


def test_a_pair_is_graded_once(spark, sf_dir):
    """Texts are compared for overlap in two places of the plan at most, both ways each, not once per mode."""
    assert _plan(queries.graded_pairs(spark, sf_dir)).count("Contains(") <= 4


@pytest.mark.parametrize("variant", [0, 2])
def test_tags_of_sentences_are_those_of_their_tokens(spark, variant):
    """The formulas on batches agree with those on rows, for missing and negative ids too."""
    docs = spark.createDataFrame([(i, t) for i, t in zip([*range(-30, 20), None, None, 7, 10 ** 12], [" ".join("ab" * 70), *_texts(3), *_texts(4)])],
                                 "doc_id bigint, text string")
    rows = fixtures.tagged(docs, variant)
    assert not re.search(r"transform\(|aggregate\(", _plan(rows))
    got = [(r.doc_id, r.sent_id, i, *x) for r in rows.collect() for i, x in enumerate(zip(r.tokens, r.gold, r.pred))]
    want = [tuple(r) for r in fixtures.tagged_tokens(docs, variant).collect()]
    assert len(got) > 1000 and sorted(got, key=str) == sorted(want, key=str)


def test_classes_are_counted_once_for_all_models(spark, sf_dir):
    plan = _plan(queries.model_class_scores(spark, sf_dir))
    assert plan.count("FileScan parquet") == 1
