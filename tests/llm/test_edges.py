"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spanloom.llm import decontam, langid, licences, lm, packing, quality, rules, simhash, substrings, urls

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(40_000))
PASSAGE = " ".join(f"pass{i}" for i in range(60))
ROWS = [
    (1, PASSAGE + " then more", "en"), (2, None, None), (3, "", "en"), (4, " \n\t ", "fr"), (5, LONG, "en"),
    (6, "same text twice", "fr"), (6, "same text twice", "fr"), (7, "same text twice", None), (None, PASSAGE, "en"),
    (None, None, None), (8, "!!! ### 123 \u00a0", "en"), (9, "before " + PASSAGE + " after", "en"), (10, "\u0000 a", "de"),
]
CLASHES = ("id", "text_key", "key", "print", "node", "rank", "bin", "bucket", "slot", "word", "pair", "target", "turn",
           "_places", "_key", "_found", "item", "score", "n_words", "whole", "digest", "first", "component_id", "source")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string")
    return rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (6, 0, 0), (7, None, 1), (None, 1, 0), (99, 0, 0)],
                                 "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(0, PASSAGE[:200]), (1, None), (2, ""), (3, "..."), (None, "same text twice"),
                                  (4, "same TEXT, twice!"), (4, "same TEXT, twice!")], "item_id bigint, text string")


OPERATORS = {
    "licences": lambda s, d, l, b: licences.scan_licences(d, licences.known_digests(s)),
    "quality": lambda s, d, l, b: quality.score_quality(d, l),
    "simhash": lambda s, d, l, b: simhash.near_duplicates(d),
    "packing": lambda s, d, l, b: packing.pack_documents(d, TOKENIZER).where("start = 0"),
    "substrings": lambda s, d, l, b: substrings.digest_repeats(d),
    "cut": lambda s, d, l, b: substrings.cut_repeats(d),
    "rules": lambda s, d, l, b: rules.judge(d, rules.train(d, l)),
    "langid": lambda s, d, l, b: langid.predict_language(d),
    "lm": lambda s, d, l, b: lm.score_documents(d, l),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_comes_out_once(spark, docs, labels, bench, name):
    rows = OPERATORS[name](spark, docs, labels, bench).select("doc_id").collect()
    key = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert sorted(key) == sorted(-1 if r[0] is None else r[0] for r in ROWS)


def test_models_kept_as_tables_take_edge_rows(spark, docs, labels, bench, monkeypatch):
    want = {(r.doc_id, r.n_tokens): r.score for r in lm.score_documents(docs, labels).collect()}
    monkeypatch.setattr(lm, "MODEL_ROWS", 0)
    rows = lm.score_documents(docs, labels).collect()
    assert len(rows) == len(ROWS) and {(r.doc_id, r.n_tokens) for r in rows} == set(want)
    assert all(r.score == pytest.approx(want[r.doc_id, r.n_tokens]) for r in rows)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_give_empty_results(spark, docs, labels, bench, name):
    none = [x.where("1 = 0") for x in (docs, labels, bench)]
    assert OPERATORS[name](spark, *none).count() == 0
    some = OPERATORS[name](spark, docs, none[1], none[2])  # nothing to learn from
    assert some.count() == len(ROWS)


def test_stages_take_edge_rows_and_empty_tables(spark, docs, labels, bench, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0
        assert stage(spark, docs.where("1 = 0"), str(tmp_path)).count() == 0
        if stage is not corpus_pipeline.pack:
            assert out.columns == docs.columns


def test_near_dedup_keeps_one_and_rows_without_id(spark, docs):
    kept = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect()]
    assert kept.count(6) == 1 and 7 not in kept and kept.count(None) == 2
    assert kept.count(2) == 1 and 3 not in kept and 4 not in kept  # texts without words are one group


def test_defined_results(spark, docs, labels):
    found = {r.doc_id: r for r in simhash.near_duplicates(docs).where("doc_id is not null").collect()}
    assert found[7].component_id == 6 and found[4].component_id == 2 and found[2].fingerprint == "0" * 16
    cut = {r.doc_id: r for r in substrings.digest_repeats(docs).where("doc_id is not null").collect()}
    assert (cut[9].n_words, cut[9].n_removed) == (62, 60) and cut[1].n_removed == 0  # the row without id is no source
    text = {r.doc_id: r.text for r in substrings.cut_repeats(docs).where("doc_id is not null").collect()}
    assert text[9] == "before after" and text[2] is None and text[5] == LONG
    lang = {r.doc_id: r for r in langid.predict_language(docs).where("doc_id is not null").collect()}
    assert all(lang[i].lang_pred == "und" for i in (2, 3, 4, 8)) and lang[5].lang_pred != "und"
    pieces = packing.pack_documents(docs, TOKENIZER)
    empty = pieces.where("doc_id = 2").collect()
    assert [(r.start, r.length, r.doc_tokens) for r in empty] == [(0, 1, 1)]
    assert pieces.where("doc_id = 5").agg(F.sum("length") == F.max("doc_tokens")).first()[0]
    judged = {r.doc_id: r for r in rules.judge(docs, rules.train(docs, labels)).where("doc_id is not null").collect()}
    assert all(judged[i].base_failed and not judged[i].kept for i in (2, 3, 4, 6))
    scored = {r.doc_id: r for r in lm.score_documents(docs, labels).where("doc_id is not null").collect()}
    assert scored[2].score is None and scored[3].n_tokens == 0 and scored[1].score is not None


def test_leaks_of_edge_items(spark, docs, bench):
    rows = decontam.leaks(docs, bench).collect()
    assert sorted((r.doc_id or -1, r.item_id if r.item_id is not None else -1) for r in rows) == sorted(
        [(1, 0), (9, 0), (-1, 0)] + 3 * [(0, 0)][:0] + [(i, j) for i in (6, 6, 7) for j in (-1, 4, 4)])
    kept = {r.doc_id for r in decontam.drop_leaks(docs, bench).select("doc_id").collect()}
    assert {2, 3, 4, 5, 8, 10} <= kept and not kept & {1, 6, 7, 9}


def test_urls_of_edge_rows(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "no scheme"), (4, "http://A.Net/x"), (4, "http://A.Net/x"), (None, "x://net"),
         (5, "http://example.net:80/en/"), (6, "http://a.b.example.net/en/q?x#y"), (7, "://net/"), (8, "http://x.net?/y")],
        "page_id bigint, url string").withColumns({c: F.lit("x") for c in ("id", "key", "part", "host", "rule", "tie")})
    rules_ = spark.createDataFrame([("net", "/", "block"), ("net", "/", "allow"), ("example.net", "/en/", "allow"),
                                    (None, "/", "block"), ("org", None, "block")], "host string, path string, verdict string")
    got = sorted(((r.page_id or 0, r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules_).collect()),
                 key=repr)
    assert got == sorted([
        (0, "net", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"), (3, "", "", None, "allow"),
        (4, "a.net", "/x", "net/", "block"), (4, "a.net", "/x", "net/", "block"),
        (5, "example.net:80", "/en/", None, "allow"), (6, "a.b.example.net", "/en/q", "example.net/en/", "allow"),
        (7, "net", "/", "net/", "block"), (8, "x.net", "", None, "allow")], key=repr)
    assert urls.judge_urls(pages.where("1 = 0"), rules_).count() == 0
    assert {r.verdict for r in urls.judge_urls(pages, rules_.where("1 = 0")).collect()} == {"allow"}
